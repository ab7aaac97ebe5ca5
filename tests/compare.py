"""Holds a query's rows against SQL run by DuckDB over the same tables."""

from __future__ import annotations

import math
import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return round(x, 6)
    return x


def rows(records: list[dict]) -> Counter:
    return Counter(tuple((k, plain(v)) for k, v in sorted(r.items())) for r in records)


def duck(sf_dir: str, sql: str) -> list[dict]:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    r = con.sql(sql)
    names = [c[0] for c in r.description]
    return [dict(zip(names, x)) for x in r.fetchall()]


def differences(spark, query, sql: str, sf_dir: str) -> tuple[int, list, list]:
    """Number of rows, then rows that only one of the two has."""
    got, want = rows([r.asDict() for r in query(spark, sf_dir).collect()]), rows(duck(sf_dir, sql))
    return sum(got.values()), list((got - want).elements())[:5], list((want - got).elements())[:5]
