"""Small documents with every odd case, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, component_id string"


def words_of(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def odd_texts() -> list[str | None]:
    base = words_of(1, 120)
    near = base[:60] + ["changed"] + base[61:]
    far = base[:60] + words_of(2, 60)
    long_ = words_of(3, 30_000)
    return [
        None, "", "   \t\n", "word", "Word", "two words", " ".join(base), " ".join(base), " ".join(base).upper(), " ".join(near), " ".join(far), " ".join(long_), " ".join(long_[:29_000]),
        " ".join(["same"] * 90), "a b c\x1cd e\x85f", "été ÉTÉ ß ΑΣ 漢字 İ", "x <|endoftext|> y<|startoftext|>z", "  lead and  double  \n\n tail  ", "MIT licence under the MIT license. Under the mit-license, CC BY NC!", "Apache License, Version 2.0 apache license version 2 cc by nc cc by nc",
    ]


def odd_documents(spark, extra: list[str | None] = ()):
    """Extra columns with the names of results, a null id, repeated rows."""
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", "y") for i, t in enumerate([*odd_texts(), *extra])]
    rows += [rows[6], (None, "only a null id here", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "n_chars")


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def near_groups(rows: list[tuple[int | None, str | None]], percent: int = 85) -> dict[int, tuple[int, int]]:
    """By row: set size and smallest linked doc_id (rows may repeat)."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return {i: (len(sets[i]), least.get(find(i))) for i in range(len(rows))}


def without_repeats(texts: list[str | None], window: int = 35) -> list[tuple[int, int, str]]:
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        kept = [x for x, k in zip(w, keep) if k]
        out.append((len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out
