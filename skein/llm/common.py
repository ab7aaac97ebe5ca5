"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.lineage import saved, shared_folder  # noqa: F401

TEXT_TABLE = "documents"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null counts as empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def as_texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """The texts of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def doc_text(docs: DataFrame) -> DataFrame:
    """Only the id and the text, under fixed names: other columns can't clash with results."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def held(column: Column) -> Column:
    """The column, worked out once for each row. As it is, an expression that a lambda of a later
    projection reads is moved into the lambda and worked out for each element."""
    return F.explode(F.array(column))


def batches_of(columns: dict[str, Iterable[Any]], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=schema.field(k).type) for k, x in columns.items()], schema=schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches in which equal keys stand together.

    A table holds at least one whole group and as many others as came with it; a group that
    goes on in the next batch waits for it, so that memory holds one batch and one group.
    """
    rest: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        end = tuple(batch.column(k)[-1].as_py() for k in keys)
        cut = batch.num_rows
        lo, hi = 0, batch.num_rows - 1
        while lo < hi:  # the first row of the last group
            mid = (lo + hi) // 2
            if tuple(batch.column(k)[mid].as_py() for k in keys) == end:
                hi = mid
            elif _still_before(batch, keys, mid, end):
                lo = mid + 1
            else:
                hi = mid
        cut = lo
        if cut or last != end:
            if cut:
                rest.append(batch.slice(0, cut))
            if rest:
                yield pa.Table.from_batches(rest)
            rest = [batch.slice(cut)]
        else:
            rest.append(batch)
        last = end
    if rest:
        yield pa.Table.from_batches(rest)


def _still_before(batch: pa.RecordBatch, keys: list[str], at: int, end: tuple) -> bool:
    """Rows are sorted by the keys, so that all rows unlike the last come before its group."""
    return tuple(batch.column(k)[at].as_py() for k in keys) != end
