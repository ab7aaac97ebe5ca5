import corpus_pipeline
from tests.llm.helpers import SF, empty_documents, odd_documents, without_repeats


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert after.columns == docs.columns, name
        if k == 2:
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            want = {i: x for i, x in zip(texts, without_repeats(list(texts.values())))}
            rows = after.collect()
            assert len(rows) == len(texts)
            assert all((len((r["text"] or "").split()) == want[r["doc_id"]][0] - want[r["doc_id"]][1]) for r in rows)
            assert all(r["text"] == texts[r["doc_id"]] for r in rows if not want[r["doc_id"]][1])
        else:
            assert 0.6 * seen < after.count() < seen
        docs, seen = after, after.count()


def test_stages_of_odd_and_of_no_documents(spark):
    for docs in (odd_documents(spark), empty_documents(spark)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= docs.count() + 200


def test_near_copies_without_or_with_shared_ids(spark):
    words = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, words), (None, words), (None, other), (7, words + " end"), (7, "something else altogether here now")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.one_of_near_copies(spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, words), (None, other), (7, rows[4][1])], key=str)
