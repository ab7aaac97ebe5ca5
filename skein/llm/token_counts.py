"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as a doubly linked list of byte symbols. A heap holds the rank of every adjacent
pair that some merge joins; the lowest rank is popped again and again, leftmost first among
equals, and the pair is joined. The count is the number of symbols at first less the number of
merges; no identifiers are emitted. Counts of words and chunks are remembered in each worker.

Defined results: a null or empty text has 0 tokens; texts of any length are read whole;
repeated rows give repeated rows; a null doc_id is passed on; extra columns aren't read; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import as_bytes, batches_of, doc_text, table
from skein.llm.vocab import Memo, WordVocabulary, default_path

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class HeapCounter:
    """Counts tokens of texts under one vocabulary."""

    def __init__(self, path: str) -> None:
        self.vocab = WordVocabulary(path)
        self.rank = {(a, b): (r, ab) for r, (a, b, ab) in enumerate(self.vocab.merges)}
        self.by_word = Memo(self.count_word)
        self.by_chunk = Memo(self.count_chunk)

    def count_word(self, word: str) -> int:
        symbols = self.vocab.symbols(word)
        n = len(symbols)
        get = self.rank.get
        heap = []
        i = 0
        for pair in zip(symbols, symbols[1:]):
            if found := get(pair):
                heap.append((found[0], i, found[1]))
            i += 1
        if not heap:
            return n
        heapify(heap)
        right = list(range(1, n + 2))
        left = list(range(-1, n))  # a last symbol of no pair stands at n, and at -1
        symbols.append(-1)
        count = n
        merge = self.vocab.merges
        while heap:
            r, i, joined = heappop(heap)
            j = right[i]
            a, b, _ = merge[r]
            if symbols[i] != a or symbols[j] != b:  # one of the two has been joined since
                continue
            symbols[i], symbols[j] = joined, -1
            count -= 1
            k = right[i] = right[j]
            left[k] = i
            if found := get((joined, symbols[k])):
                heappush(heap, (found[0], i, found[1]))
            h = left[i]
            if h >= 0 and (found := get((symbols[h], joined))):
                heappush(heap, (found[0], h, found[1]))
        return count

    def count_chunk(self, chunk: bytes) -> int:
        return sum(map(self.by_word.__getitem__, self.vocab.words(chunk)))

    def count(self, raw: bytes) -> int:
        """Tokens of a text in UTF-8."""
        total = 0
        for part, special in self.vocab.segments(raw):
            total += sum(map(self.by_chunk.__getitem__, part.split())) + (special is not None)
        return total


@cache
def counter(path: str) -> HeapCounter:
    return HeapCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than limit tokens) of each document.

    One pass without a shuffle; a worker keeps the vocabulary between tasks.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            n = [own.count(t) for t in texts]
            yield batches_of({"doc_id": batch.column("doc_id"), "n_bytes": [len(t) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}, out)

    return doc_text(docs).mapInArrow(run, SCHEMA)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"))
