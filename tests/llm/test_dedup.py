import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import near_dedup, substring_dedup
from skein.operators import components
from tests.llm.helpers import empty_documents, near_groups, odd_documents, odd_texts, without_repeats, words_of


def test_components(spark):
    rng = random.Random(5)
    path = list(range(300))
    rng.shuffle(path)
    edges = [*zip(path, path[1:]), *((1000, 1000 + i) for i in range(1, 50)), (2000, 2001), (2001, 2002), (2002, 2000), (5, 5)]
    rows = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(len, groups.values())) == [3, 50, 300] and len(rows) == 353
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies(n: int, words: int, edits: int, seed: int) -> list[str]:
    rng, base = random.Random(seed), words_of(seed, words)
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = "w%d" % rng.randrange(10**6)
        out.append(" ".join(own))
    return out


def held(df) -> dict:
    return {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in df.collect()}


def test_near_duplicates(spark):
    """Odd texts, pairs on either side of the threshold, and a large group of near copies."""
    extra = [x for s in range(6) for x in near_copies(4, 150, 4, 100 + s)] + near_copies(150, 80, 3, 50)
    docs = odd_documents(spark, extra)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got, want = held(near_dedup.near_duplicates(docs)), near_groups(rows)
    assert near_dedup.near_duplicates(docs).count() == len(rows)
    for i, (doc_id, _) in enumerate(rows):
        n, least = want[i]
        assert got[doc_id, n] == (least if n else doc_id, (least if n else doc_id) == doc_id)


def test_near_duplicates_at_another_threshold(spark):
    docs = odd_documents(spark, [x for s in range(8) for x in near_copies(4, 150, 6, 400 + s)])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got, want = held(near_dedup.near_duplicates(docs, percent=80)), near_groups(rows, 80)
    for i, (doc_id, _) in enumerate(rows):
        n, least = want[i]
        assert got[doc_id, n][0] == (least if n else doc_id)


@pytest.mark.parametrize("in_task", [0, 40, near_dedup.IN_TASK])
def test_large_tree_nodes_and_blocks(spark, monkeypatch, in_task):
    """With small limits, the same result comes by deep trees, by chunks, hubs and pairs of blocks,
    whether levels are Spark's jobs or a task's loops."""
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 16)
    monkeypatch.setattr(near_dedup, "CHUNK", 16)
    monkeypatch.setattr(near_dedup, "VOTERS", 12)
    common = " ".join(words_of(41, 40))
    docs = odd_documents(spark, near_copies(60, 80, 3, 50) + near_copies(30, 80, 9, 51) + [common + " " + " ".join(words_of(900 + i, 25 + i % 9)) for i in range(30)])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = near_groups(rows)
    got = held(near_dedup.near_duplicates(docs, leaf=16, in_task=in_task))
    for i, (doc_id, _) in enumerate(rows):
        n, least = want[i]
        assert got[doc_id, n][0] == (least if n else doc_id)


def test_trees_branch_on_the_table(spark):
    """Unlike sets with common tokens thin out over further levels; hot nodes of near copies end."""
    docs = near_dedup.doc_text(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64("text")})
    signed = near_dedup.saved(near_dedup.signatures(docs, 5).where("n_shingles > 0").dropDuplicates(["s1"]).select(F.col("s1").alias("nid"), "path", "sketch"))
    n, trees = signed.count(), near_dedup.TREES
    for leaf in (8, 64):
        meet, links = near_dedup.branches(signed, trees, near_dedup.sketch_share(85), leaf)
        assert meet.groupBy("node").agg(F.count_if("far").alias("m")).agg(F.max("m")).first()[0] <= max(near_dedup.CHUNK, leaf)
        assert meet.count() + links.count() < 4 * trees * n
        roots = signed.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(t, F.element_at("path", t + 1)))).alias("node")).distinct()
        assert meet.join(roots, "node", "left_anti").count() > 0 or leaf > 8


def test_tree_nodes_branch_in_tasks():
    """Pairs that agree are joined by a node's links and leaves; unlike sets thin out."""
    rng = np.random.default_rng(11)
    n, leaf, share = 3000, 16, near_dedup.sketch_share(85)
    tokens = rng.integers(0, 256, (n, near_dedup.FUNCTIONS), dtype=np.uint8)
    tokens[:, :64] = tokens[0, :64]  # half of all tokens are common
    for i in range(0, 1000, 2):
        tokens[i + 1] = tokens[i]
        tokens[i + 1, :8] = 0
    tokens[1000:1400] = tokens[1000]  # a hot group of copies
    nid, found = rng.integers(-(1 << 62), 1 << 62, n), set()
    for tree in range(8):
        leaves: list = []
        for a, b in near_dedup.branched(tree, np.arange(n), 0, nid, tokens, share, leaf, leaves):
            assert near_dedup.agree(tokens[a], tokens[b], share).all()
            found.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
        assert all(len(x) <= near_dedup.LARGEST_LEAF for x in leaves) and sum(map(len, leaves)) < 30 * n
        assert any(len(x) < n // 10 for x in leaves)
        for x in leaves:
            inside = set(x.tolist())
            found.update((i, i + 1) for i in inside if i < 1000 and i % 2 == 0 and i + 1 in inside)
    assert {(i, i + 1) for i in range(0, 1000, 2)} <= found


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(empty_documents(spark)).count() == 0


def test_exact_links_count_all_pairs():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, 60, dtype=np.uint64)) for _ in range(40)] + [np.arange(50, dtype=np.uint64), np.arange(2, 52, dtype=np.uint64)]
    a, b = near_dedup.exact_links(np.arange(len(sets)), sets, 85, 100)
    assert (a.tolist(), b.tolist()) == ([41], [40])


def place_rows(df) -> list[tuple]:
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.parametrize("largest", [20_000, 2])
def test_substrings(spark, largest):
    passage = " ".join(words_of(77, 50))
    short = " ".join(words_of(78, 34))
    extra = [" ".join(words_of(200 + i, 20 + i)) + " " + (passage if i % 2 else short) + " " + " ".join(words_of(300 + i, 9)) for i in range(12)]
    extra += [passage + " " + passage, short + " x " + short, passage[: len(passage) // 2] + " " + passage]
    # near copies, and a phrase in many places: groups of many different stretches
    extra += near_copies(12, 90, 5, 60)
    extra += [" ".join([*words_of(500 + i, 30), *words_of(79, 8 + i % 30), *words_of(600 + i // 2, 30)]) for i in range(40)]
    docs = odd_documents(spark, extra)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted((str(i), *x) for (i, _), x in zip(rows, without_repeats([t for _, t in rows])))
    assert place_rows(substring_dedup.substring_dedup(docs, largest=largest)) == want


def test_substrings_of_nothing(spark):
    assert substring_dedup.substring_dedup(empty_documents(spark)).count() == 0


def test_every_window_has_an_anchor():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 1 << 62, n, dtype=np.uint64) for n in (34, 35, 0, 36, 200)]
    h, doc = np.concatenate(texts), np.repeat(np.arange(5), [len(t) for t in texts])
    anchors, first, ahead, windows = substring_dedup.anchored(h, doc, 35, 8)
    assert windows.sum() == sum(max(0, len(t) - 34) for t in texts) and (windows <= 28).all()
    runs = near_dedup.rolled(h, 8)
    for a, f, o, k in zip(anchors, first, ahead, windows):
        assert runs[f + o] == a
        for p in range(f, f + k):
            assert runs[p : p + 28].min() == a and doc[p] == doc[p + 34]


def test_suffix_order():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 3, 300)
    starts = np.arange(0, 300, 2)
    order, shared = substring_dedup.suffix_order(ids, starts, 16)
    cut = [tuple(ids[s : s + 16]) for s in starts[order]]
    assert cut == sorted(cut)
    for x, y, n in zip(starts[order], starts[order][1:], shared):
        m = 0
        while max(x, y) + m < 300 and ids[x + m] == ids[y + m]:
            m += 1
        assert min(m, 16) == min(n, 16)


def test_equal_segments_have_equal_hashes():
    h = np.random.default_rng(4).integers(0, 1 << 62, 40, dtype=np.uint64)
    twice = np.concatenate([h, h[:1], h])
    one, two = substring_dedup.segment_hashes(twice, np.array([0, 41]), np.array([40, 81]), substring_dedup.MULTIPLY[0])
    other = substring_dedup.segment_hashes(twice, np.array([0, 1]), np.array([39, 41]), substring_dedup.MULTIPLY[0])
    assert one == two and one not in other


def test_texts_of_the_table(spark):
    assert len(odd_texts()) == 20
