"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens.

A document's set holds its distinct word shingles. Equal sets form a class, and one row stands
for it. In each of several independent trees, nodes branch by the minwise token that a random
function of the branch's path picks from their sets: sets of similarity s take the same branch
with probability s. What becomes of a tree node depends on its members:

* A node of up to LEAF members (four times as many with each level, up to LARGEST_LEAF) is compared
  exhaustively, by sketches.
* In a larger one, every member meets the node's representative (of some random members, the one
  with which most of them agree). Those that agree with it become its candidates; the others meet WITNESSES of these. If those that agree
  with none are no more than that, or a minority of no more than CHUNK, they meet all members, in
  chunks, and the node ends: a hot node of near copies doesn't branch, and loses no pair.
* Otherwise all its members branch on, by one function or, for every other node, by two.

A node of up to IN_TASK members, whose sketches fit into a task, goes through all its further levels
there; a level of larger ones is a Spark job. The rules are the same in both places.

Candidates that hang together form groups, which are confirmed on full sets. A group of one block
has all its pairs counted. In a larger one, each block is counted by itself, together with the
group's hubs, the members nearest to its most common minwise tokens; this joins most of a group of
near copies. Only what is not yet joined to the group's largest component meets all other blocks.
Of what is linked, only stars leave a task.

Recall: a pair of similarity t is missed by one tree with probability of at most 1 - t at the
first level (0.15 at 0.85). Below it, a node branches by 1.5 functions in the mean, so that a pair
stays together somewhere with a probability of 0.76 or more, however deep the branches (the
process has a mean of 1.28 children and dies out with 0.24). All TREES trees miss such a pair with
(1 - 0.85 * 0.76) ** 12, about 4e-6, and with 1e-10 if nothing branches. The sketch comparison
passes pairs whose 128 functions agree less than expected at the threshold by up to SKETCH_SLACK
standard deviations, and misses about 1e-7 of the pairs that stand there. Sets, texts and nodes are
told apart by 64-bit and 128-bit hashes.

Defined results: a document without words (null, empty, or white space only) has an empty set,
links with nothing and is its own component. Rows that share a doc_id get the class of their own
text. A row without doc_id has no component of its own: its component_id is the smallest doc_id
that it is linked with, or null. Extra columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.common import as_bytes, batches_of, doc_text, saved, sorted_groups, table
from skein.operators.components import connected_components
from skein.llm.vocab import Memo

FUNCTIONS = 128
TREES = 12
#: Largest tree node that is compared exhaustively: at the first level, and at any. The limit grows
#: by four with each level, so that nodes which hardly thin out end after some levels too.
LEAF, LARGEST_LEAF = 64, 4096
#: Members of a tree node up to which its levels are worked out in one task (4 MB of sketches).
IN_TASK = 32_768
#: Random members of a large tree node of which one becomes its representative, and members, besides
#: it, that those unlike it meet.
SAMPLES, WITNESSES = 6, 4
#: Members of a large tree node that one task compares with the few that differ.
CHUNK = 1024
#: A candidate pair's sketches may agree less than at the threshold by so many standard deviations.
SKETCH_SLACK = 5.3
#: Sets, and their elements, of a block in the exact comparison.
BLOCK_SETS, BLOCK_ELEMENTS = 512, 4_000_000
#: Hubs of a large candidate group, and members that vote on its most common tokens (in the mean).
HUBS, VOTERS = 4, 256

_rng = np.random.Generator(np.random.PCG64(20240607))
MULTIPLY = _rng.integers(1, 1 << 31, FUNCTIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _rng.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint32)
#: Elements of sets that are hashed at a time (or one set, if that is larger).
AT_ONCE = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


WORDS = Memo(_word_hash, 100_000)


def word_hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, n)


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of so many words (of the whole sequence, if it is shorter)."""
    width = min(width, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for j in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
    return mixed(out ^ np.uint64(width))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of the lower-cased text."""
    words = text.lower().split()
    return np.unique(rolled(word_hashes(words, len(words)), width)) if words else np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of 64-bit hashes, as two signed numbers."""
    import xxhash

    raw = s.tobytes()
    return tuple(np.array([xxhash.xxh3_64_intdigest(raw), xxhash.xxh3_64_intdigest(raw, seed=1)], np.uint64).astype(np.int64).tolist())


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest value of each set under each function, [sets, FUNCTIONS]; no set is empty."""
    out = np.empty((FUNCTIONS, len(sets)), np.uint32)
    size = np.cumsum([0] + [len(s) for s in sets])
    lo = 0
    while lo < len(sets):
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + AT_ONCE, side="right")) - 1)
        s = np.concatenate(sets[lo:hi])
        low = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
        starts = (size[lo:hi] - size[lo]).astype(np.intp)
        for i in range(FUNCTIONS):  # a permutation of the 32-bit numbers
            np.minimum.reduceat(low * MULTIPLY[i] + ADD[i], starts, out=out[i, lo:hi])
        lo = hi
    return out.T


SIGNED = pa.schema([("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("path", pa.list_(pa.int32())), ("sketch", pa.binary())])


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """Set size, 128-bit key, minwise tokens and their low bytes, for each document. docs: doc_id, text, t1, t2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in as_bytes(batch.column("text"))]
            keys = [set_key(s) for s in sets]
            tokens = np.ascontiguousarray(minwise([s for s in sets if len(s)]))
            path, sketch = iter(tokens.view(np.int32)), iter(tokens.astype(np.uint8))
            yield batches_of(
                {
                    **{k: batch.column(k) for k in ("doc_id", "t1", "t2")},
                    "n_shingles": [len(s) for s in sets],
                    "s1": [k[0] for k in keys],
                    "s2": [k[1] for k in keys],
                    "path": [next(path) if len(s) else None for s in sets],
                    "sketch": [next(sketch).tobytes() if len(s) else None for s in sets],
                },
                SIGNED,
            )

    return docs.mapInArrow(run, "doc_id long, t1 long, t2 long, n_shingles long, s1 long, s2 long, path array<int>, sketch binary")


def _child(j: int) -> Column:
    """The j-th branch of a tree node: its path picks a function, the low byte of the set's minwise token the child."""
    function = F.pmod(F.xxhash64("node", F.lit(j)), F.lit(FUNCTIONS)).cast("int")
    return F.xxhash64("node", F.lit(j), F.substring("sketch", function + 1, F.lit(1)))


def sketch_share(percent: int) -> float:
    """The least share of agreeing functions of a candidate pair."""
    t = percent / 100
    return t - SKETCH_SLACK * (t * (1 - t) / FUNCTIONS) ** 0.5


def _lowest(test: Column, salt: int) -> Column:
    """A random one of the members that pass a test, with its sketch."""
    return F.min(F.when(test, F.struct(F.xxhash64("nid", F.lit(salt)).alias("h"), "nid", "sketch")))


def tokens_of(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, FUNCTIONS)


def agree(tokens: np.ndarray, other: np.ndarray, share: float) -> np.ndarray:
    return np.count_nonzero(tokens == other, axis=1) >= share * FUNCTIONS


def leaf_limit(depth: int, leaf: int) -> int:
    return max(leaf, min(leaf << 2 * depth, LARGEST_LEAF))


def judged_against(pairs: DataFrame, share: float) -> DataFrame:
    """Whether `sketch` and `other` agree, as `near` in place of `other`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = (tokens_of(batch.column(k).to_pylist()) for k in ("sketch", "other"))
            near = pa.array(agree(own, other, share))
            rest = [k for k in batch.schema.names if k != "other"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), near], names=[*rest, "near"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields if f.name != "other")
    return pairs.mapInArrow(run, types + ", near boolean")


def central(few: np.ndarray, share: float) -> int:
    return int(((few[:, None] == few[None]).sum(axis=2) >= share * FUNCTIONS).sum(axis=1).argmax())


def most_central(some: DataFrame, share: float) -> DataFrame:
    """Of a few members of each node (an array of nid and sketch), the one with which most agree: node, chosen, other."""
    out = pa.schema([("node", pa.int64()), ("chosen", pa.int64()), ("other", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen, other = [], []
            for few in batch.column("some").to_pylist():
                best = central(tokens_of([x["sketch"] for x in few]), share)
                chosen.append(few[best]["nid"])
                other.append(few[best]["sketch"])
            yield batches_of({"node": batch.column("node"), "chosen": chosen, "other": other}, out)

    return some.mapInArrow(run, "node long, chosen long, other binary")


def branches(nodes: DataFrame, trees: int, share: float, leaf: int = LEAF, in_task: int = 0) -> tuple[DataFrame, DataFrame]:
    """(tree node, nid, far, depth) rows in which whatever is far meets all of its node, and candidate links (a, b).

    nodes: nid, path, sketch. Each level counts the members of its tree nodes; those with one
    member have nothing to compare and end. Members of large nodes carry their sketches along.
    Nodes of up to in_task members may be larger than leaves of their depth: they are still to branch.
    Of nodes that have come to their end, the depth is -1.
    """
    first = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(t, F.element_at("path", t + 1)))
    level = nodes.select("nid", F.explode(first).alias("node"))
    sketches = nodes.select("nid", "sketch")
    meet, links = [], []
    for depth in count():
        limit = leaf_limit(depth, leaf)
        here = F.col("n") <= max(limit, in_task)
        sizes = level.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        sized = saved(level.join(sizes, "node"))
        meet.append(sized.where(here).select("node", "nid", F.lit(True).alias("far"), F.lit(depth).alias("depth")))
        large = sized.where(~here)
        if large.isEmpty():
            break
        if "sketch" not in large.columns:
            large = saved(large.join(sketches, "nid"))

        # of some random members, the one with which most of them agree
        some = large.groupBy("node").agg(F.array_distinct(F.transform(F.array(*(_lowest(F.lit(True), i) for i in range(SAMPLES))), lambda x: F.struct(x["nid"].alias("nid"), x["sketch"].alias("sketch")))).alias("some"))
        chosen = most_central(some, share)
        judged = saved(judged_against(large.join(chosen, "node").select("node", "nid", "n", "chosen", "sketch", "other"), share).withColumn("far", ~F.col("near")).drop("near"))

        # the far ones meet some that agree with the representative, and so hang together with it
        salted = F.array_compact(F.array(*(_lowest(~F.col("far"), SAMPLES + i) for i in range(WITNESSES))))
        apart = judged.groupBy("node").agg(F.count_if("far").alias("m"), salted.alias("w")).where(F.col("m") > limit)
        witness = apart.select("node", F.explode("w").alias("w")).select("node", F.col("w.nid").alias("by"), F.col("w.sketch").alias("other")).distinct()
        meetings = judged.where("far").select("node", "nid", "sketch").join(witness, "node")
        reached = judged_against(meetings, share).where("near").groupBy("node", "nid").agg(F.min("by").alias("by"))
        judged = judged.join(reached, ["node", "nid"], "left").withColumn("far", F.col("far") & F.col("by").isNull())
        rest = saved(judged.join(judged.groupBy("node").agg(F.count_if("far").alias("m")), "node"))
        links.append(rest.where("not far and nid <> chosen").select(F.col("nid").alias("a"), F.coalesce("by", "chosen").alias("b")))
        # few differ: they meet every chunk of the others
        chunks = F.ceil(F.col("n") / CHUNK)
        places = F.when(F.col("far"), F.sequence(F.lit(0).cast("long"), chunks - 1)).otherwise(F.array(F.pmod(F.xxhash64("nid"), chunks)))
        ends = (F.col("m") <= limit) | ((F.col("m") <= CHUNK) & (2 * F.col("m") < F.col("n")))
        few = rest.where("m > 0").where(ends).select("node", "nid", "far", F.explode(places).alias("chunk"))
        meet.append(few.select(F.xxhash64("node", F.lit(-1), "chunk").alias("node"), "nid", "far", F.lit(-1).alias("depth")))
        two = F.when(F.pmod(F.xxhash64("node", F.lit(-2)), F.lit(2)) == 0, F.array(_child(0), _child(1))).otherwise(F.array(_child(0)))
        level = rest.where(~ends).select("nid", "sketch", F.explode(two).alias("node"))
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    return union(meet), union(links or [nodes.select(F.col("nid").alias("a"), F.col("nid").alias("b")).limit(0)])


def tasks(spark: SparkSession) -> int:
    """How many tasks CPU-heavy groups are dealt to, whatever their bytes: the session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def stars(names: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """For what the pairs join, links from each member to the one with the smallest name."""
    root = np.arange(len(names))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for left, right in pairs:
        while len(left) and not np.array_equal(root, onward := root[root]):
            root = onward
        apart = root[left] != root[right]  # few, once a group hangs together
        for a, b in zip(left[apart].tolist(), right[apart].tolist()):
            x, y = find(a), find(b)
            if x != y:
                if names[y] < names[x]:
                    x, y = y, x
                root[y] = x
    top = np.array([find(x) for x in range(len(names))], np.int64)
    away = np.flatnonzero(top != np.arange(len(names)))
    return names[away], names[top[away]]


def branched(node: int, rows: np.ndarray, depth: int, nid: np.ndarray, tokens: np.ndarray, share: float, leaf: int, leaves: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Agreeing pairs of a tree node that branches within a task; its leaves, yet to be compared, are added to a list."""
    todo = [(np.array([node], np.int64).view(np.uint64), rows, depth)]
    while todo:
        node, rows, depth = todo.pop()
        if len(rows) <= (limit := leaf_limit(depth, leaf)):
            leaves.append(rows)
            continue
        drawn = rows[np.argsort(mixed(nid[rows].view(np.uint64) ^ node))]  # in random order
        chosen = drawn[central(tokens[drawn[:SAMPLES]], share)]
        near = agree(tokens[drawn], tokens[chosen], share)
        alike, far = drawn[near], drawn[~near]
        yield alike, np.full(len(alike), chosen)
        for w in alike[-WITNESSES:] if len(far) > limit else ():
            near = agree(tokens[far], tokens[w], share)
            yield far[near], np.full(np.count_nonzero(near), w)
            far = far[~near]
        if len(far) <= limit or len(far) <= CHUNK and 2 * len(far) < len(rows):
            for x in far:
                like = rows[agree(tokens[rows], tokens[x], share)]
                yield like, np.full(len(like), x)
            continue
        for j in range(1 + int(mixed(node)[0] & np.uint64(1))):
            path = mixed(node ^ np.uint64(2 * j + 3))
            token = tokens[rows, int(path[0] % np.uint64(FUNCTIONS))]
            order = np.argsort(token, kind="stable")
            cut = np.flatnonzero(np.diff(token[order])) + 1
            for part, value in zip(np.split(rows[order], cut), token[order][np.r_[0, cut]].astype(np.uint64)):
                if len(part) > 1:
                    todo.append((mixed(path + value), part, depth + 1))


def compare_leaves(leaves: DataFrame, share: float, leaf: int = LEAF) -> DataFrame:
    """Candidate links (a, b) of sets in the same tree node, one of them far, whose sketches agree enough.
    Nodes too large for their depth branch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["node"]):
            node, nid, far, depth = (group.column(k).to_numpy() for k in ("node", "nid", "far", "depth"))
            tokens = tokens_of(group.column("sketch").to_pylist())

            def pairs():
                ends: list[np.ndarray] = []
                for rows in np.split(np.arange(len(node)), np.flatnonzero(np.diff(node)) + 1):
                    if depth[rows[0]] < 0:
                        ends.append(rows)
                    else:
                        yield from branched(node[rows[0]], rows, int(depth[rows[0]]), nid, tokens, share, leaf, ends)
                at = np.concatenate(ends) if ends else np.zeros(0, np.intp)
                end = np.repeat(np.arange(len(ends)), [len(x) for x in ends])
                i, k = np.flatnonzero(far[at]), 0  # far ones stand first
                while len(i):  # row i against row i + k, as long as they share an end
                    k += 1
                    i = i[i + k < len(at)]
                    i = i[end[i] == end[i + k]]
                    for part in np.array_split(i, len(i) // 20_000 + 1):
                        close = agree(tokens[at[part]], tokens[at[part + k]], share)
                        yield at[part[close]], at[part[close] + k]

            a, b = stars(nid, pairs())
            yield batches_of({"a": a, "b": b}, LINK)

    return leaves.repartition(tasks(leaves.sparkSession), "node").sortWithinPartitions("node", F.desc("far")).mapInArrow(run, "a long, b long")


def exact_links(names: np.ndarray, sets: list[np.ndarray], over: int, under: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars over what is joined by pairs with under * intersection >= over * union, on full sets.

    Intersections are counted for all pairs at once, as products of 0/1 matrices, a slice of
    the shared elements at a time.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    element, count = np.unique(np.concatenate(sets), return_counts=True)
    element = element[count > 1]
    common = np.zeros((n, n), np.float32 if size.max(initial=0) < 1 << 23 else np.float64)
    row = np.repeat(np.arange(n), size)
    if not len(element):
        return names[:0], names[:0]
    flat = np.concatenate(sets)
    place = np.minimum(np.searchsorted(element, flat), len(element) - 1)
    held = element[place] == flat
    place, row = place[held], row[held]
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    step = max(64, (1 << 22) // n)
    for lo in range(0, len(element), step):
        a, b = np.searchsorted(place, [lo, lo + step])
        m = np.zeros((n, step), common.dtype)
        m[row[a:b], place[a:b] - lo] = 1
        common += m @ m.T
    union = size[:, None] + size[None, :] - common
    close = np.triu(under * common >= over * union, 1)
    return stars(names, iter([np.nonzero(close)]))


def confirm(placed: DataFrame, texts: DataFrame, width: int, over: int, under: int) -> DataFrame:
    """Links (a, b) within each cell, enough to join what belongs together.

    placed: nid and cells, an array of (group, i, j); texts: nid, text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["group", "i", "j"]):
            key = np.stack([group.column(k).to_numpy() for k in ("group", "i", "j")], axis=1)
            nid = group.column("nid").to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            a, b = [], []
            for part in np.split(np.arange(len(nid)), cut):
                if len(part) > 1:
                    sets = [shingle_set(t, width) for t in as_bytes(group.column("text").slice(part[0], len(part)))]
                    x, y = exact_links(nid[part], sets, over, under)
                    a += x.tolist()
                    b += y.tolist()
            yield batches_of({"a": a, "b": b}, LINK)

    keys = ["group", "i", "j"]
    rows = placed.join(texts, "nid").select(F.explode("cells").alias("c"), "nid", "text").select(*(f"c.{k}" for k in keys), "nid", "text")
    return rows.repartition(tasks(texts.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def cell(i, j):
    return F.struct("group", i.cast("int").alias("i"), j.cast("int").alias("j"))


def blocks_of(sets, elements) -> Column:
    return F.ceil(F.greatest(sets / BLOCK_SETS, elements / BLOCK_ELEMENTS)).cast("int")


def hubs(member: DataFrame, sketches: DataFrame) -> DataFrame:
    """group and nid of the HUBS members of each group nearest to its most common tokens. member: group, nid, size."""
    own = member.join(sketches, "nid").select("group", "nid", "size", "sketch")
    voters = own.where(F.pmod(F.xxhash64("nid", F.lit(7)), F.ceil(F.col("size") / VOTERS)) == 0)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cast in batch.column("cast").to_pylist():
                tokens = np.frombuffer(b"".join(cast), np.uint8).reshape(len(cast), FUNCTIONS)
                out.append(bytes(int(np.bincount(tokens[:, f]).argmax()) for f in range(FUNCTIONS)))
            yield pa.RecordBatch.from_arrays([batch.column("group"), pa.array(out, pa.binary())], names=["group", "common"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, FUNCTIONS) for k in ("sketch", "common")]
            agree = pa.array((pair[0] == pair[1]).sum(axis=1), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("nid"), agree], names=["group", "nid", "agree"])

    common = voters.groupBy("group").agg(F.collect_list("sketch").alias("cast")).mapInArrow(vote, "group long, common binary")
    # a group without voters, however unlikely, takes its smallest names
    judged = own.join(common, "group", "left").select("group", "nid", "sketch", F.coalesce("common", "sketch").alias("common")).mapInArrow(near, "group long, nid long, agree long")
    best = Window.partitionBy("group").orderBy(F.desc("agree"), "nid")
    return judged.withColumn("r", F.row_number().over(best)).where(F.col("r") <= HUBS).select("group", "nid")


def confirmed(candidates: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join what exact comparison joins within the candidate groups.

    candidates: nid and group; classes: nid, n, sketch; texts: nid, text.
    """
    member = candidates.join(classes.select("nid", "n"), "nid")
    sizes = member.groupBy("group").agg(F.count("*").alias("size"), blocks_of(F.count("*"), F.sum("n")).alias("blocks"))
    member = saved(member.join(sizes, "group"))
    small = member.where("blocks = 1").select("nid", F.array(cell(F.lit(0), F.lit(0))).alias("cells"))
    large = member.where("blocks > 1")
    if large.isEmpty():
        return confirm(small, texts, width, percent, 100)

    # every block by itself, and the hubs with all of them
    b = F.pmod(F.xxhash64("nid", F.lit(1)), "blocks").cast("int")
    chosen = saved(hubs(large.select("group", "nid", "size"), classes.select("nid", "sketch")).withColumn("hub", F.lit(True)))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: cell(x, x))
    by_block = large.join(chosen, ["group", "nid"], "left").select("nid", F.when(F.col("hub"), every).otherwise(F.array(cell(b, b))).alias("cells"))
    first = saved(confirm(small.unionByName(by_block), texts, width, percent, 100))

    # what isn't in the group's largest component by now meets all blocks
    root = connected_components(first).withColumnRenamed("node", "nid")
    held = large.join(root, "nid", "left").select("nid", "group", "n", F.coalesce("root", "nid").alias("root"))
    most = held.groupBy("group", "root").agg(F.count("*").alias("k"))
    most = most.groupBy("group").agg(F.max(F.struct("k", "root"))["root"].alias("main"))
    held = saved(held.join(most, "group").withColumn("rest", F.col("root") != F.col("main")))
    split = held.groupBy("group").agg(blocks_of(F.count_if("rest"), F.sum(F.when(F.col("rest"), F.col("n")).otherwise(0))).alias("br"), blocks_of(F.count_if(~F.col("rest")), F.sum(F.when(F.col("rest"), 0).otherwise(F.col("n")))).alias("bm"))
    own = held.join(split.where("br > 0"), "group").withColumn("b", F.when(F.col("rest"), F.pmod(F.xxhash64("nid", F.lit(2)), "br")).otherwise(F.col("br") + F.pmod(F.xxhash64("nid", F.lit(2)), "bm")).cast("int"))
    to = F.sequence(F.lit(0), F.when(F.col("rest"), F.col("br") + F.col("bm")).otherwise(F.col("br")).cast("int") - 1)
    pairs = F.transform(to, lambda x: cell(F.least(x, "b"), F.greatest(x, "b")))
    return first.unionByName(confirm(own.select("nid", pairs.alias("cells")), texts, width, percent, 100))


def text_key(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), F.coalesce("text", F.lit("")))


def components(docs: DataFrame, width: int = 5, percent: int = 85, trees: int = TREES, leaf: int = LEAF, in_task: int = IN_TASK) -> DataFrame:
    """doc_id, the text's keys t1 and t2, n_shingles, component_id and kept for every row of docs.

    Rows are linked if 100 * intersection >= percent * union of their shingle sets.
    """
    docs = doc_text(docs).withColumns({"t1": text_key(1), "t2": text_key(2)})
    signed = saved(signatures(docs, width))
    some = signed.where("n_shingles > 0")
    row = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "t1", "t2")
    classes = some.groupBy("s1", "s2").agg(F.min(row).alias("row"), F.first("n_shingles").alias("n"), F.first("path").alias("path"), F.first("sketch").alias("sketch"))
    classes = saved(classes.select("s1", "s2", "n", "path", "sketch", F.col("s1").alias("nid"), F.col("row.doc_id").alias("least"), "row.t1", "row.t2"))
    meet, links = branches(classes.select("nid", "path", "sketch"), trees, sketch_share(percent), leaf, in_task)
    leaves = meet.join(classes.select("nid", "sketch"), "nid")
    candidates = connected_components(compare_leaves(leaves, sketch_share(percent), leaf).unionByName(links))
    candidates = candidates.select(F.col("node").alias("nid"), F.col("root").alias("group"))

    # one text for each candidate: rows are found by the text's hash and the doc_id, and repeated ones go
    wanted = candidates.join(classes, "nid").select("nid", "least", F.col("t1").alias("k1"), F.col("t2").alias("k2"))
    ends = [F.coalesce(c, F.lit(-(1 << 63))) for c in (wanted["least"], docs["doc_id"])]
    found = wanted.join(docs, (wanted["k1"] == docs["t1"]) & (wanted["k2"] == docs["t2"]) & (ends[0] <= ends[1]) & (ends[0] >= ends[1]))
    texts = saved(found.select("t1", "t2", "nid", "text").dropDuplicates(["t1", "t2"]).select("nid", "text"))

    roots = connected_components(confirmed(candidates, classes.select("nid", "n", "sketch"), texts, width, percent))
    joined = classes.select("nid", "s1", "s2", "least").join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    lowest = joined.groupBy("root").agg(F.min("least").alias("lowest"))
    component = joined.join(lowest, "root").select("s1", "s2", "lowest")
    out = signed.select("doc_id", "t1", "t2", "n_shingles", "s1", "s2").join(component, ["s1", "s2"], "left")
    cid = F.when(F.col("n_shingles") > 0, F.col("lowest")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "t1", "t2", "n_shingles", cid.alias("component_id"), F.col("doc_id").eqNullSafe(cid).alias("kept"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 85, trees: int = TREES, leaf: int = LEAF, in_task: int = IN_TASK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs; see components."""
    return components(docs, width, percent, trees, leaf, in_task).select("doc_id", "n_shingles", "component_id", "kept")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
