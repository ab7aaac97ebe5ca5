"""Removal of passages that repeat, by suffix trees over groups of suffixes that share a prefix.

Every window of WINDOW words is a suffix of a document, cut to that depth; a window repeats if its
suffix is a leaf below an internal node of that depth. Suffixes are dealt to groups by words that
all of a group's windows share, so many of them that the group's tree fits into memory:

* A window's anchor is the smallest hash among its runs of ANCHOR words. Equal windows have equal
  anchors at the same place, and neighbouring windows mostly share one, so a group receives whole
  stretches of text rather than single windows. Anchors that occur once have no repeats.
* Equal stretches of a group are counted before anything else is done with them. Those that occur
  again repeat in all their windows; of each different one, only one goes on, so that groups of
  near copies bring little more than their differences.
* A group with more than LARGEST different stretches gets a longer prefix: the starts of its
  windows are halved by their distance from the anchor, and the windows of either half share more
  words (of 35: 8, then 22, 29, 32, 34, 35), by which they are dealt anew. A window alone has its
  whole text as its prefix, and then equal ones are one, so the lengthening ends for any group.
* In a group, the suffixes are sorted by prefix doubling, with the length of the prefix that each
  shares with the next one. Intervals of lengths of WINDOW and more are the subtrees below internal
  nodes of that depth; their leaves are the repeats.

Texts that occur more than once are found first and enter once; being repeats as a whole, they
need no tree. Anchors are told apart by 64 bits, equal stretches and texts by 128; in the trees,
words are compared as they are.

Defined results: a null or empty text has 0 words, none removed, and the digest of the empty
text. A window may repeat within its own document, and copies may overlap. Windows are judged on
the input. Equal rows are copies of each other. Rows that share a doc_id are judged each by its
own text; a null doc_id is passed on; extra columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import as_bytes, batches_of, doc_text, saved, sorted_groups, table
from skein.llm.near_dedup import mixed, rolled, word_hashes

WINDOW = 35
ANCHOR = 8
#: Different stretches of text in the largest group that one task takes; 2 at least.
LARGEST = 20_000
#: Words whose hashes are worked on at a time (or one text, if that is longer).
AT_ONCE = 1 << 18
#: A place is first word, distance to the anchor, windows, and least and greatest distance in its group.
BASE = 64
assert WINDOW - ANCHOR + 1 < BASE

MULTIPLY = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def text_key(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), F.coalesce("text", F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    return doc_text(docs).withColumns({"t1": text_key(1), "t2": text_key(2)})


def placed(first, ahead, windows, low, high):
    return (((first * BASE + ahead) * BASE + windows) * BASE + low) * BASE + high


def unplaced(place):
    rest, high = divmod(place, BASE)
    rest, low = divmod(rest, BASE)
    rest, windows = divmod(rest, BASE)
    return (*divmod(rest, BASE), windows, low, high)


def words_covered(place: Column, window: int) -> Column:
    """First and end word of a place, as a struct."""
    first = F.shiftright(place, 24)
    return F.struct(first.alias("first"), (first + F.shiftright(place, 12).bitwiseAND(BASE - 1) + (window - 1)).alias("end"))


def anchored(h: np.ndarray, doc: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first word, distance to the anchor and number of windows of each stretch.

    h: hashes of the words of several texts one after another; doc: the text of each.
    """
    if len(h) < window:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    runs = rolled(h, anchor)
    width = window - anchor + 1
    low, at = runs.copy(), np.arange(len(runs))
    reach = 1
    while reach < width:  # the leftmost smallest of the next `reach` runs
        step = min(reach, width - reach)
        take = low[step:] < low[: len(low) - step]
        at = np.where(take, at[step:], at[: len(at) - step])
        low = np.minimum(low[step:], low[: len(low) - step])
        reach += step
    whole = np.flatnonzero(doc[: len(at)] == doc[window - 1 :])  # windows within one text
    at = at[whole]
    new = np.flatnonzero(np.diff(at, prepend=-1))
    return runs[at[new]], whole[new], at[new] - whole[new], np.diff(new, append=len(at))


def segment_hashes(h: np.ndarray, first: np.ndarray, end: np.ndarray, multiply: int) -> np.ndarray:
    """A hash of the words of each segment, wherever it stands."""
    power = np.full(len(h) + 1, multiply, np.uint64)
    back = np.full(len(h) + 1, pow(multiply, -1, 1 << 64), np.uint64)
    power[0] = back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1])])
    return mixed((total[end] - total[first]) * back[first] ^ (end - first).astype(np.uint64))


SIGNED = "t1 long, t2 long, doc_id long, n_words long, keys array<long>, places array<long>, s1 array<long>, s2 array<long>"


def signatures(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """t1, t2, n_words and the stretches of each row: anchor, place and the words' 128 bits."""

    def signed(batch: pa.RecordBatch, words: list[list[bytes]]) -> pa.RecordBatch:
        n = np.array([len(w) for w in words], np.int64)
        h = word_hashes(chain.from_iterable(words), int(n.sum()))
        doc = np.repeat(np.arange(len(n)), n)
        key, first, ahead, windows = anchored(h, doc, window, anchor)
        end = first + windows + window - 1
        s1, s2 = segment_hashes(h, first, end, MULTIPLY[0]), segment_hashes(mixed(h), first, end, MULTIPLY[1])
        owner = doc[first]
        place = placed(first - (np.cumsum(n) - n)[owner], ahead, windows, 0, window - anchor)
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.view(np.int64))) for x in (key, place, s1, s2)]
        own = [batch.column(k) for k in ("t1", "t2", "doc_id")]
        return pa.RecordBatch.from_arrays([*own, pa.array(n), *lists], names=["t1", "t2", "doc_id", "n_words", "keys", "places", "s1", "s2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, held, start = [], 0, 0
            for r in range(batch.num_rows):
                words.append(as_bytes(batch.column("text").slice(r, 1))[0].split())
                held += len(words[-1])
                if held > AT_ONCE or r == batch.num_rows - 1:
                    yield signed(batch.slice(start, len(words)), words)
                    words, held, start = [], 0, r + 1

    return docs.mapInArrow(run, SIGNED)


PIECE = pa.schema([("tid", pa.int64()), ("key", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("words", pa.binary())])


def stretches(texts: DataFrame, window: int) -> DataFrame:
    """The words of each listed stretch. texts: tid, text and own, an array of (key, place, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in PIECE.names}
            for tid, text, own in zip(batch.column("tid").to_pylist(), as_bytes(batch.column("text")), batch.column("own")):
                words = text.split()
                for key, place, n in zip(*(own.values.field(k).to_pylist() for k in ("key", "place", "n"))):
                    first, _, windows, _, _ = unplaced(place)
                    for k, x in zip(PIECE.names, (tid, key, place, n, b" ".join(words[first : first + windows + window - 1]))):
                        rows[k].append(x)
                if len(rows["tid"]) > 50_000:
                    yield batches_of(rows, PIECE)
                    rows = {k: [] for k in PIECE.names}
            yield batches_of(rows, PIECE)

    return texts.mapInArrow(run, "tid long, key long, place long, n long, words binary")


def halves(pieces: DataFrame, window: int) -> DataFrame:
    """Both halves of stretches, dealt by more words than before: tid, key, place, s1, s2, n."""
    import xxhash

    out = pa.schema([("tid", pa.int64()), ("key", pa.int64()), ("place", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in out.names}
            for tid, place, n, text in zip(*(batch.column(k).to_pylist() for k in ("tid", "place", "n", "words"))):
                words = text.split()
                first, ahead, windows, low, high = unplaced(place)
                middle = (low + high) // 2
                for lo, hi in ((low, middle), (middle + 1, high)):
                    most, least = min(hi, ahead), max(lo, ahead - windows + 1)
                    if most < least:
                        continue
                    skip = ahead - most  # the half's first window starts so many words later
                    here = b" ".join(words[skip : skip + most - least + window])
                    run_ = b" ".join(words[ahead - lo : ahead - hi + window])  # shared by all windows of the half
                    digest = np.frombuffer(xxhash.xxh3_128_digest(here, seed=lo), np.int64).tolist()
                    key = int(np.uint64(xxhash.xxh3_64_intdigest(run_, seed=lo)).view(np.int64))
                    for k, x in zip(out.names, (tid, key, placed(first + skip, most, most - least + 1, lo, hi), *digest, n)):
                        rows[k].append(x)
            yield batches_of(rows, out)

    return pieces.mapInArrow(run, "tid long, key long, place long, s1 long, s2 long, n long")


def suffix_order(ids: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at `starts` in order, and the length of the prefix each shares with the next, up to `depth` and more.

    By prefix doubling: the ranks of prefixes of 1, 2, 4, … symbols. ids: small whole numbers.
    """
    ranks, reach = [ids.astype(np.int64)], 1
    while reach < depth:
        last = ranks[-1]
        beyond = np.zeros(len(last), np.int64)
        beyond[: len(last) - reach] = last[reach:] + 1
        ranks.append(np.unique(last * (len(last) + 2) + beyond, return_inverse=True)[1])
        reach *= 2
    order = np.argsort(ranks[-1][starts], kind="stable")
    i = starts[order]
    a, b = i[:-1].copy(), i[1:].copy()
    shared = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        within = (a < len(ids)) & (b < len(ids))
        same = np.zeros(len(a), bool)
        same[within] = ranks[k][a[within]] == ranks[k][b[within]]
        shared += same * (1 << k)
        a, b = a + same * (1 << k), b + same * (1 << k)
    return order, shared


def below_deep_nodes(words: list[list[bytes]], row: np.ndarray, inside: np.ndarray, window: int) -> np.ndarray:
    """Which suffixes (row, word) are leaves below an internal node of depth `window` or more."""
    size = np.array([len(w) + 1 for w in words])
    flat = list(chain.from_iterable([*w, b""] for w in words))
    ids = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    ends = np.cumsum(size) - 1
    ids[ends] = len(flat) + np.arange(len(ends))  # no prefix goes beyond a stretch
    ids = np.unique(ids, return_inverse=True)[1]
    order, shared = suffix_order(ids, (np.cumsum(size) - size)[row] + inside, window)
    deep = np.zeros(len(row) + 1, bool)
    deep[1:-1] = shared >= window
    out = np.zeros(len(row), bool)
    out[order] = deep[1:] | deep[:-1]
    return out


RANGES = pa.schema([("tid", pa.int64()), ("first", pa.int64()), ("end", pa.int64())])


def word_ranges(stretch: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch, first and end word of the runs of neighbouring repeated windows."""
    new = np.ones(len(first), bool)
    new[1:] = (stretch[1:] != stretch[:-1]) | (first[1:] > first[:-1] + window)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(first)) - 1 if len(at) else at
    return stretch[at], first[at], first[last] + window


def tree_repeats(pieces: DataFrame, window: int) -> DataFrame:
    """Word ranges (tid, first, end) that repeated windows cover, from the groups' trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["key"]):
            words = [w.split() for w in as_bytes(group.column("words"))]
            first, _, windows, _, _ = unplaced(group.column("place").to_numpy())
            row = np.repeat(np.arange(len(words)), windows)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            found = below_deep_nodes(words, row, inside, window)
            found &= group.column("n").to_numpy()[row] == 1  # the others are known to repeat
            s, a, b = word_ranges(row[found], first[row[found]] + inside[found], window)
            yield batches_of({"tid": group.column("tid").to_numpy()[s], "first": a, "end": b}, RANGES)

    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(run, "tid long, first long, end long")


def repeated_ranges(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, largest: int = LARGEST) -> DataFrame:
    """For each text with repeats: t1, t2, copies and an array of word ranges (first, end).

    Texts with copies repeat as a whole; they have copies > 1 and need no ranges. docs: keyed().
    """
    signed = signatures(docs, window, anchor)
    lists = ("keys", "places", "s1", "s2")
    texts = signed.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in lists))
    texts = saved(texts.withColumn("tid", F.monotonically_increasing_id()))
    names = texts.select("tid", F.col("t1").alias("k1"), F.col("t2").alias("k2"), "least")

    def words_of(members: DataFrame) -> DataFrame:
        own = members.groupBy("tid").agg(F.collect_list(F.struct("key", "place", "n")).alias("own")).join(names, "tid")
        # by the text's key alone, as without_ranges joins: both read the same shuffled texts
        # (a test of equality would become part of the join's key)
        ends = [F.coalesce(c, F.lit(-(1 << 63))) for c in (own["least"], docs["doc_id"])]
        one = (ends[0] <= ends[1]) & (ends[0] >= ends[1])
        return stretches(own.join(docs, (own["k1"] == docs["t1"]) & (own["k2"] == docs["t2"]) & one).select("tid", "text", "own"), window)

    zipped = F.arrays_zip(F.col("keys").alias("key"), F.col("places").alias("place"), "s1", "s2")
    rows = texts.select("tid", F.explode(zipped).alias("p")).select("tid", "p.key", "p.place", "p.s1", "p.s2", F.lit(1).cast("long").alias("n"))
    found: list[DataFrame] = []
    while True:
        often = saved(rows.groupBy("key").agg(F.sum("n").alias("total")).where("total > 1").select("key"))
        shared = saved(rows.join(often, "key"))
        different = shared.groupBy("s1", "s2").agg(F.first("key").alias("key"), F.sum("n").alias("n"), F.min(F.struct("tid", "place")).alias("p"))
        different = saved(different.select("s1", "s2", "key", "n", "p.tid", "p.place"))
        # a text's stretches repeat but for those that stand alone, which are known by now
        own = shared.where("n = 1").select("tid", "place", F.lit(False).alias("alone"))
        alone = different.where("n = 1").select("tid", "place", F.lit(True).alias("alone"))
        lists = [F.collect_list(F.when(test, F.col("place"))) for test in (~F.col("alone"), F.col("alone"))]
        again = own.unionByName(alone).groupBy("tid").agg(F.array_except(*lists).alias("places")).where(F.size("places") > 0)
        found.append(again.select("tid", F.transform("places", lambda x: words_covered(x, window)).alias("ranges")))
        sized = different.join(different.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key")
        trees = tree_repeats(words_of(sized.where(F.col("m") <= largest)), window)
        found.append(trees.groupBy("tid").agg(F.collect_list(F.struct("first", "end")).alias("ranges")))
        large = sized.where(F.col("m") > largest)
        if large.isEmpty():
            break
        rows = saved(halves(words_of(large), window))
    ranges = reduce(DataFrame.unionByName, found).groupBy("tid").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    return texts.select("tid", "t1", "t2", "copies").join(ranges, "tid", "left").where("copies > 1 or ranges is not null").drop("tid")


def without_ranges(docs: DataFrame, ranges: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Cuts the repeated words out: doc_id, n_words, n_removed, kept_sha256 and, on demand, kept.

    docs: keyed(). Other columns of docs are passed on with the text.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "t1", "t2")] if with_text else []
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, digest, kept = [], [], [], []
            for text, copies, spans in zip(as_bytes(batch.column("text")), batch.column("copies").to_pylist(), batch.column("ranges")):
                words = text.split()
                n.append(len(words))
                if copies and copies > 1 and len(words) >= window:
                    words = []
                elif spans.is_valid:
                    change = np.zeros(len(words) + 1, np.int64)
                    own = spans.values
                    np.add.at(change, own.field("first").to_numpy(), 1)
                    np.add.at(change, own.field("end").to_numpy(), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                removed.append(n[-1] - len(words))
                line = b" ".join(words)
                digest.append(hashlib.sha256(line).hexdigest())
                kept.append(line.decode() if removed[-1] else None)
            columns = {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(kept, pa.string())}
            yield pa.RecordBatch.from_arrays([columns.get(c) if c in columns else batch.column(c) for c in names + ["text"] * with_text + rest], names=names + ["text"] * with_text + rest)

    joined = docs.join(ranges, ["t1", "t2"], "left")
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, text string" * with_text + "".join(f", `{c}` {types[c]}" for c in rest)
    return joined.mapInArrow(run, schema)


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, largest: int = LARGEST) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs."""
    own = keyed(docs)
    return without_ranges(own, repeated_ranges(own, window, anchor, largest), window)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
