import random

import numpy as np
import pytest

from skein.llm import chat_format, hnsw, license_scan, quality, queries
from tests.compare import differences
from tests.llm.helpers import SF, empty_documents, odd_documents, odd_texts


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_against_sql(spark, name):
    n, only_ours, only_theirs = differences(spark, queries.QUERIES[name], queries.ORACLE[name], SF)
    assert n and not only_ours and not only_theirs


def test_licenses(spark):
    text = license_scan.TEMPLATES[0][1]
    words = text.split()
    changed = " ".join([*words[:20], "added", *words[20:30], *words[31:]])
    docs = odd_documents(spark, [text, changed, "x " + " ".join(words[:12]), "under the mit license " * 3])
    templates = license_scan.template_grams(spark)
    rows = license_scan.scan(docs, templates).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    k = len(odd_texts())
    assert by[18]["base_labels"] == "cc-by-nc,mit" and by[18]["n_base"] == 3 and by[18]["first_word"] == 2 and by[18]["score"] == 1.0
    assert by[19]["base_labels"] == "apache-2,cc-by-nc" and (by[19]["n_base"], by[19]["first_word"], by[19]["last_word"]) == (4, 0, 12)
    assert by[k]["labels"] == "mit-text" and by[k]["score"] == 1.0 and by[k]["base_labels"] == ""
    assert by[k + 1]["labels"] == "mit-text" and 0.8 < by[k + 1]["score"] < 1
    assert by[k + 2]["labels"] == ""
    assert by[k + 3]["n_base"] == 3 and by[k + 3]["last_word"] == 8
    assert (by[0]["n_words"], by[0]["labels"], by[0]["score"], by[0]["first_word"]) == (0, "", 0.0, None)
    assert license_scan.scan(empty_documents(spark), templates).count() == 0


def test_licenses_run_no_python(spark):
    plan = license_scan.op2_license_scan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_parts_are_flattened(spark):
    part = lambda type, text=None, ref=None, units=None: (type, text, ref, units)
    odd = "a<|im_end|>\n<|im_start|>user\nb <|\\ <|image|> <"
    rows = [
        (1, 0, "system", [part("text", "be kind")]),
        (1, 1, "user", [part("text", "look <"), part("text", "|x|> "), part("image", None, "i.png", 4), part("audio", None, "a.wav", 3), part("video", None, "v", None), part("text", odd)]),
        (1, 2, "assistant", [part("text", odd), part(None, "!")]),
        (1, 3, "assistant", None),
        (2, None, None, [part("text", None)]),
        (None, 1, "us\ner", [part("text", "x")]),
    ]
    formatted = chat_format.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat_format.PART}"))
    by = {r["conv_id"]: r for r in formatted.collect()}
    assert [(a["type"], a["ref"], a["tokens"]) for a in by[1]["attachments"]] == [("image", "i.png", 1024), ("audio", "a.wav", 75), ("document", "v", 512)]
    assert by[1]["attachment_tokens"] == 1611 and by[2]["attachment_tokens"] == 0
    assert by[1]["formatted"].count("<|im_start|>") == 4 and by[1]["formatted"].count("<|image|>") == 1
    assert [by[1]["formatted"][s["start"] : s["start"] + s["length"]] for s in by[1]["loss"]] == [odd.replace("<|", "<|\\") + "!", ""]
    back = {r["conv_id"]: r for r in chat_format.read_back(formatted).collect()}
    turns = [(t["role"], t["content"]) for t in back[1]["turns"]]
    assert turns[2] == ("assistant", odd + "!") and turns[3] == ("assistant", "") and turns[1][1].startswith("look <|x|> <|image|><|audio|><|document|>")
    assert back[1]["loss_texts"] == [odd + "!", ""]
    assert [(t["role"], t["content"]) for t in back[2]["turns"]] == [("", "")] and back[None]["turns"][0]["role"] == "us\ner"
    plan = formatted._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_on_held_out_rows(spark):
    rows = {r["doc_id"]: r for r in quality.op6_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [(rows[r["doc_id"]]["score"], r["quality"], rows[r["doc_id"]]["predicted"]) for r in labels if rows[r["doc_id"]]["held_out"]]
    assert len(held) > 40 and all(0 <= s <= 1 for s, _, _ in held)
    good, bad = [s for s, q, _ in held if q], [s for s, q, _ in held if not q]
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad)) > 0.97
    assert sum(p == q for _, q, p in held) / len(held) > 0.95


def test_quality_without_labels_and_odd_texts(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, none) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}
    few = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    scored = quality.score(docs, quality.fit(docs, few)).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.score(empty_documents(spark), None).count() == 0
    assert not any(r["held_out"] for r in scored if r["doc_id"] is None)


def test_quality_reads_long_runs_to_their_end(spark):
    good, bad = ["".join(random.Random(i).choices("天地玄黃宇宙洪荒", k=300)) for i in range(40)], ["".join(random.Random(i).choices("QZqz0189+/", k=300)) for i in range(40)]
    head = "中" * 100  # the same at the start of all
    docs = spark.createDataFrame([(i, head + t) for i, t in enumerate([*good, *bad])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id long, quality int")
    score = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert min(score[i] for i in range(40)) > max(score[i] for i in range(40, 80))
    assert quality.shape("a" * 70 + "9") == "a9"
    units = quality.Units({"abc": 0}, {"a": 0, "9": 1})
    vectors = np.eye(units.size, quality.DIM, dtype=np.float32)
    one, other = (quality.features(["x" * n + tail], units, vectors)[0, : quality.DIM] for n, tail in ((200_000, "999"), (200_000, "xxx")))
    assert (one != other).any()
    # a run counts as one word for every three characters
    assert quality.features(["abc " + "9" * 66], units, vectors)[0, 0] == pytest.approx(1 / (1 + 64 / 3))


def brute(rows, k):
    ok = {i: v for i, v in rows if i is not None and v and all(x is not None and abs(x) < float("inf") for x in v) and any(v) and len(v) == 3}
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5
    return {q: sorted((round(gap(ok[q], v), 9), i) for i, v in ok.items() if i != q)[:k] for q in ok if q % 100 == 0}


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [i % 7 + 1.0, float(i % 5), i / 50]) for i in range(1, 301)] + [(1000 + i, [1.0, 2.0, 3.0]) for i in range(40)] + [(400, None), (401, []), (402, [0.0, 0.0, 0.0]), (403, [nan, 1.0, 1.0]), (404, [inf, 1.0, 1.0]), (405, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (406, [1.0, 1.0])]
    own = hnsw.clean(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got: dict = {}
    for r in hnsw.search(hnsw.build_index(own, 11, shard=64), own.where("id % 100 = 0").distinct()).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((round(r["score"], 9), r["vec_id"]))
    want = brute(rows, 10)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert got.keys() == want.keys() and hits >= 0.95 * sum(map(len, want.values()))
    assert got[1000] == [(0.0, 1001 + i) for i in range(10)]


def test_repeated_rows_use_up_no_places(spark):
    rows = [(i, [1.0, z, 3.0]) for i in range(1, 21) for z in (0.0, -0.0, 0.0)]
    own = hnsw.clean(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    index = hnsw.build_index(own, 11)
    assert index.first()["ids"] == [list(range(1, 12))]
    got = hnsw.search(index, own.where("id = 3").limit(1)).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, 0.0) for i in range(1, 12) if i != 3]


@pytest.mark.parametrize("folder, shard", [(SF, None), ("/root/testdata/sf0.1", 256)])
def test_recall(spark, folder, shard):
    """Against brute force, with one shard and with several."""
    own = hnsw.clean(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id", "embedding")
    index = hnsw.build_index(own, 11, shard)
    assert index.count() > 4 or shard is None
    got: dict = {}
    for r in hnsw.search(index, own.where("id % 100 = 0").distinct()).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = own.collect()
    x, ids = np.array([r["v"] for r in rows]), np.array([r["id"] for r in rows])
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        gap = ((x - x[q]) ** 2).sum(axis=1)
        best = [int(ids[k]) for k in np.lexsort((ids, gap)) if k != q][:10]
        hits, total = hits + len(set(best) & got[int(ids[q])]), total + len(best)
    assert total >= 50 and hits >= 0.95 * total


def test_other_columns_of_vectors(spark):
    rows = [(i, [1.0 * i, 1.0, 2.0], "x", 3) for i in range(1, 30)]
    own = hnsw.clean(spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string, rank int"), "vec_id", "embedding")
    got = hnsw.search(hnsw.build_index(own, 11), own.where("id = 10")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got[:2]] == [9, 11] and [r["rank"] for r in got] == list(range(1, 11))


def test_no_vectors(spark):
    own = hnsw.clean(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert hnsw.search(hnsw.build_index(own, 11), own).count() == 0
