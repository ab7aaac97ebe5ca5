import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skein.llm import bpe_codec, packing, token_counts
from skein.llm.vocab import default_path
from tests.llm.helpers import SF, empty_documents, odd_documents, odd_texts

WORD, BYTE = default_path("word_bpe_49k.json"), default_path("byte_bpe_50k.json")
word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
ids = lambda t, x: t.encode(x or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def texts(spark):
    return odd_texts() + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()]


def test_word_vocabulary(texts):
    count, codec = token_counts.counter(WORD), bpe_codec.codec(WORD)
    for t in texts:
        want = ids(word, t)
        assert count.count((t or "").encode()) == len(want)
        got = codec.encode((t or "").encode())
        assert list(np.frombuffer(got, "<u4")) == want
        assert codec.decode(got) == word.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text(t):
    want = ids(word, t)
    assert token_counts.counter(WORD).count(t.encode()) == len(want)
    assert list(np.frombuffer(bpe_codec.codec(WORD).encode(t.encode()), "<u4")) == want
    assert list(np.frombuffer(packing.encoder(BYTE).encode(t), "<u4")) == ids(byte, t)


def test_every_code_point():
    """Each one between letters, beside the library; several to a text, which the library cuts at blanks too."""
    count, codec = token_counts.counter(WORD), bpe_codec.codec(WORD)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 500):
        t = " ".join(f":{chr(c)}a" for c in points[lo : lo + 500])
        want = ids(word, t)
        assert count.count(t.encode()) == len(want)
        assert np.frombuffer(codec.encode(t.encode()), "<u4").tolist() == want, hex(points[lo])


def test_table_begun_anew(monkeypatch):
    monkeypatch.setattr(bpe_codec, "STATES", 50)
    own = bpe_codec.Codec(WORD)
    t = " ".join(odd_texts()[6].split() + ["antidisestablishmentarianism"] * 3)
    assert np.frombuffer(own.encode(t.encode()), "<u4").tolist() == ids(word, t)


def test_automaton_against_plain_merging():
    """Overlapping merges, and a token that no path reaches."""
    a, b, c = 0, 1, 2
    merges = [(a, a, 3), (a, b, 4), (3, b, 5), (b, c, 6), (4, c, 7), (3, 3, 8)]
    own = bpe_codec.MergeAutomaton(merges, {a: a, b: b, c: c})
    rank = {(x, y): (r, z) for r, (x, y, z) in enumerate(merges)}

    def plain(s):
        s = list(s)
        while True:
            best = min(((rank[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in rank), default=None)
            if best is None:
                return s
            i = best[1]
            s[i : i + 2] = [rank[s[i], s[i + 1]][1]]

    for n in range(1, 7):
        for code in range(3**n):
            s = [code // 3**i % 3 for i in range(n)]
            assert own.path(s) == plain(s)


def test_queries_of_counts(spark):
    docs = odd_documents(spark)
    rows = {(r["doc_id"], r["n_bytes"]): r for r in token_counts.token_counts(docs, WORD).collect()}
    for i, t in enumerate(odd_texts()):
        r = rows[i, len((t or "").encode())]
        assert r["n_tokens"] == len(ids(word, t)) and r["over_limit"] == (r["n_tokens"] > 2048)
    coded = bpe_codec.encode_decode(docs, WORD, keep=True).collect()
    assert len(coded) == docs.count()
    for r in coded:
        assert hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() == r["ids_sha256"]
        assert hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"]
    assert token_counts.token_counts(empty_documents(spark), WORD).count() == 0
    assert bpe_codec.encode_decode(empty_documents(spark), WORD).count() == 0


def test_packing(spark):
    docs = odd_documents(spark)
    pieces = [r.asDict() for r in packing.pack(docs, BYTE).collect()]
    by_place: dict = {}
    for p in pieces:
        by_place.setdefault(p["sequence_id"], []).append(p)
    for own in by_place.values():
        own.sort(key=lambda p: p["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    assert sum(p["length"] for p in pieces) > 0.9 * 2048 * (len(by_place) - 1)
    for i, t in enumerate(odd_texts()):
        if i == 6:
            continue  # stands twice
        want = np.array([*ids(byte, t), 1], "<u4")
        own = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        at = 0
        for p in own:
            assert p["start"] == at and p["doc_tokens"] == len(want)
            at += p["length"]
            assert zlib.crc32(want[p["start"] : at].tobytes()) == p["ids_crc32"]
        assert at == len(want)
    assert packing.pack(empty_documents(spark), BYTE).count() == 0
