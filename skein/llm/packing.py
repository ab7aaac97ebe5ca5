"""Packing of tokenised documents into sequences of a fixed length, with bounded space.

Each partition keeps a fixed number of open windows. A document's full windows go out at once;
its rest goes into the open window that it fills best. If it fits none, a new window opens, or,
when all are open, the fullest one is emitted: its gap is filled with the head of the rest (cuts
are free), unless the gap is too small to be worth a cut. When the partition ends, the pieces in
windows still open are merged with those of a bounded number of other partitions, largest first.

Defined results: a null or empty text is a document of one token, the end mark; texts of any
length are cut as often as needed; repeated rows are packed each on its own; a null doc_id is
passed on; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import as_texts, batches_of, doc_text, saved, sorted_groups, table
from skein.llm.vocab import Memo, byte_alphabet, default_path

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECE_ARROW = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
OPEN_ARROW = PIECE_ARROW.append(pa.field("ids", pa.binary()))
MERGED = 1 << 62
#: Gaps below this many tokens are padded rather than filled by a cut.
LEAST_CUT = 16
#: So many partitions share one merge of leftovers.
MERGE_PARTITIONS = 64


class ByteEncoder:
    """Byte-level BPE with the identifiers of a vocabulary file; special strings are special.

    The splitting pattern always starts a word at a blank before a character that isn't white
    space, so a text is cut at such blanks, and the identifiers of the chunks are remembered.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in self.special}
        self.core = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.marks = tuple(self.special)
        self.by_chunk = Memo(self.after_blank, 250_000)

    def plain(self, text: str) -> bytes:
        return array("I", self.core.encode_ordinary(text)).tobytes()

    def after_blank(self, chunk: str) -> bytes | None:
        """None where the blank is followed by white space or the end: not a place to cut."""
        return None if not chunk or chunk[0].isspace() else self.plain(" " + chunk)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit identifiers."""
        if any(m in text for m in self.marks):
            return array("I", self.core.encode(text, allowed_special="all")).tobytes()
        first, *rest = text.split(" ")
        parts = list(map(self.by_chunk.__getitem__, rest))
        if None in parts:
            return self.plain(text)
        return self.plain(first) + b"".join(parts)


@cache
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


class Packer:
    """The open windows of one partition."""

    def __init__(self, size: int, windows: int, first_sequence: int) -> None:
        self.size, self.windows, self.next = size, windows, first_sequence
        self.open: list[list] = []  # [filled, pieces]; a piece: doc_id, start, doc_tokens, ids
        self.done: dict[str, list[int]] = {name: [] for name in PIECE_ARROW.names}

    def emit(self, pieces: list[tuple]) -> None:
        offset, put = 0, self.done
        for doc_id, start, total, ids in pieces:
            n = len(ids) // 4
            put["doc_id"].append(doc_id)
            put["start"].append(start)
            put["length"].append(n)
            put["ids_crc32"].append(zlib.crc32(ids))
            put["doc_tokens"].append(total)
            put["sequence_id"].append(self.next)
            put["offset"].append(offset)
            offset += n
        self.next += 1

    def add(self, doc_id: int | None, start: int, total: int, ids: bytes) -> None:
        size = self.size
        while len(ids) >= 4 * size:
            self.emit([(doc_id, start, total, ids[: 4 * size])])
            start, ids = start + size, ids[4 * size :]
        while n := len(ids) // 4:
            best = max((w for w in self.open if w[0] + n <= size), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.windows:
                self.open.append(best := [0, []])
            if best is not None:
                best[0] += n
                best[1].append((doc_id, start, total, ids))
                if best[0] == size:
                    self.close(best)
                return
            fullest = max(self.open, key=lambda w: w[0])
            gap = size - fullest[0]
            if gap >= LEAST_CUT:
                fullest[1].append((doc_id, start, total, ids[: 4 * gap]))
                start, ids = start + gap, ids[4 * gap :]
            self.close(fullest)

    def close(self, window: list) -> None:
        self.open.remove(window)
        self.emit(window[1])

    def taken(self) -> dict[str, list[int]]:
        out, self.done = self.done, {name: [] for name in PIECE_ARROW.names}
        return out


def pack(docs: DataFrame, path: str, size: int = 2048, windows: int = 8, end_id: int = 1) -> DataFrame:
    """One row for each piece: where it comes from, its sequence and its place there.

    The first pass tokenises and packs within the input's partitions, without a shuffle. Only
    what is left in open windows (at most windows * size tokens a partition) moves, to tasks
    that each merge MERGE_PARTITIONS partitions.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(path), array("I", [end_id]).tobytes()
        packer = Packer(size, windows, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_texts(batch.column("text"))):
                ids = own.encode(text) + end
                packer.add(doc_id, 0, len(ids) // 4, ids)
            done = packer.taken()
            yield batches_of(done | {"ids": [None] * len(done["doc_id"])}, OPEN_ARROW)
        left = [piece for _, pieces in packer.open for piece in pieces]
        for window in list(packer.open):
            packer.close(window)
        yield batches_of(packer.taken() | {"ids": [x[3] for x in left]}, OPEN_ARROW)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in sorted_groups(batches, ["merge"]):
            rows = groups.to_pylist()
            for key in dict.fromkeys(r["merge"] for r in rows):
                packer = Packer(size, 1, MERGED + (key << 33))  # one window: only the last stays unfilled
                own = sorted((r for r in rows if r["merge"] == key), key=lambda r: (-r["length"], r["sequence_id"], r["offset"]))
                for r in own:
                    packer.add(r["doc_id"], r["start"], r["doc_tokens"], r["ids"])
                for window in sorted(packer.open, key=lambda w: -w[0]):
                    packer.close(window)
                yield batches_of(packer.taken(), PIECE_ARROW)

    once = saved(doc_text(docs).mapInArrow(first, PIECE + ", ids binary"))
    left = once.where("ids is not null").withColumn("merge", F.shiftright("sequence_id", 33).cast("long") / MERGE_PARTITIONS).withColumn("merge", F.floor("merge"))
    merged = left.repartition("merge").sortWithinPartitions("merge").mapInArrow(merge, PIECE)
    return once.where("ids is null").drop("ids").unionByName(merged)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"))
