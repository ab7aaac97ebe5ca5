"""License scan by diagonal voting, with DataFrame operations only.

All runs of GRAM words of a text are hashed and joined to the places of the templates' runs. A
hit at word p of the text and word t of the template votes for the diagonal p - t. A diagonal
with all of a template's runs is a verbatim place of it; words that were added or left out move
the following hits to a neighbouring diagonal, so diagonals of a template that lie close
together are merged to one span, and the span is verified: the share of the template's distinct
runs that it holds, and its length against the template's.

The templates are a table of bounded size, so it is broadcast; nothing else is. A text's votes
are summed up per diagonal before they are shuffled. Hashes of 64 bits stand for runs of words.

Phrases are templates too: they count only where they stand verbatim.

Defined results: null and empty texts have no words, no labels and score 0. Each input row gives
a row, so repeated rows give repeated rows; a null doc_id is passed on; extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.common import doc_text, held, table

GRAM = 3
#: Words, for Spark and for DuckDB: letters, digits and all that isn't ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Label and phrase; a place counts only verbatim.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Label and opening of the license's public text; found with small differences too.
TEMPLATES = (
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("apache-2-text", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by-text", "this work is licensed under a creative commons attribution 4 0 international license"),
)
#: Diagonals at most so many words apart are merged.
NEIGHBOUR = 4
#: Least share of a template's runs in a span, and most length of a span against the template's.
COVERED, STRETCHED = 0.6, 1.5


def template_grams(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES, gram: int = GRAM) -> DataFrame:
    """g (hash), label, place, words and runs of the template, and whether it must be verbatim."""
    rows = [(label, text, True) for label, text in phrases] + [(label, text, False) for label, text in templates]
    own = spark.createDataFrame(rows, "label string, phrase string, verbatim boolean").withColumn("w", F.split("phrase", " "))
    own = own.withColumn("runs", F.size("w") - (gram - 1))
    place = F.explode(F.sequence(F.lit(0), F.col("runs") - 1))
    return own.select("label", "verbatim", F.size("w").alias("words"), "runs", "w", place.alias("place")).select(_hash("w", F.col("place"), gram).alias("g"), "label", "verbatim", "words", "runs", "place")


def _hash(words: str, at, gram: int):
    return F.xxhash64(*(F.get(F.col(words), at + j) for j in range(gram)))


def scan(docs: DataFrame, templates: DataFrame, gram: int = GRAM) -> DataFrame:
    """One row for each row of docs: word count, places of phrases, labels and a score.

    score is the largest verified share of a template that the text holds: 1 for verbatim places.
    """
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = doc_text(docs).select("doc_id", held(F.regexp_extract_all(lower, F.lit(f"({WORD})"), 1)).alias("w")).withColumn("row", F.monotonically_increasing_id())
    # the first entry has no hash and stands for the row itself, so that rows without hits stay
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - gram, F.lit(-1)) + 1), lambda i: F.when(i > 0, F.xxhash64(*(F.get("w", i - 1 + j) for j in range(gram)))))
    votes = words.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode(F.when(F.size("w") < gram, F.array(F.lit(None).cast("long"))).otherwise(runs)).alias("i", "g"))
    hits = votes.join(F.broadcast(templates), "g", "left").where("label is not null or i = 0")
    shift = (F.col("i") - 1 - F.col("place")).cast("long")
    diagonal = hits.groupBy("row", "doc_id", "n_words", "label", "verbatim", "words", "runs", shift.alias("d")).agg(F.collect_set("place").alias("places"), F.min("place").alias("low"), F.max("place").alias("high"))
    diagonal = diagonal.where("not verbatim or size(places) = runs or label is null")
    # neighbouring diagonals of a template in a text become one span
    by_d = Window.partitionBy("row", "label").orderBy("d")
    new = F.col("verbatim") | (F.col("d") - F.lag("d").over(by_d) > NEIGHBOUR)
    span = diagonal.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(by_d))
    found = span.groupBy("row", "doc_id", "n_words", "label", "verbatim", "words", "runs", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"), F.min(F.col("d") + F.col("low")).alias("start"), F.max(F.col("d") + F.col("high") + gram).alias("end")
    )
    share = F.col("covered") / F.col("runs")
    good = (share >= COVERED) & (F.col("end") - F.col("start") <= STRETCHED * F.col("words"))
    found = found.withColumn("share", F.when(good, F.round(share, 6)))
    base = F.col("verbatim") & F.col("share").isNotNull()
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return found.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        names(F.when(base, F.col("label"))).alias("base_labels"),
        names(F.when(F.col("share").isNotNull(), F.col("label"))).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    ).drop("row")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), template_grams(spark))


def _values(rows) -> str:
    return ", ".join("('" + "', '".join(r) + "')" for r in rows)


ORACLE = f"""
WITH t AS (SELECT label, string_split(phrase, ' ') AS w, verbatim FROM (SELECT *, true AS verbatim FROM (VALUES {_values(PHRASES)}) p(label, phrase) UNION ALL SELECT *, false FROM (VALUES {_values(TEMPLATES)}) q(label, phrase))),
tg AS (SELECT label, verbatim, len(w) AS words, len(w) - 2 AS runs, i AS place, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM (SELECT *, unnest(range(0, len(w) - 2)) AS i FROM t)),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT row, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM (SELECT row, w, unnest(range(0, greatest(len(w) - 2, 0))) AS i FROM d)),
diag AS (SELECT row, label, verbatim, words, runs, i - place AS d, list(DISTINCT place) AS places, min(place) AS low, max(place) AS high FROM g JOIN tg USING (g) GROUP BY ALL),
kept AS (SELECT * FROM diag WHERE NOT verbatim OR len(places) = runs),
flagged AS (SELECT *, CASE WHEN verbatim OR lag(d) OVER o IS NULL OR d - lag(d) OVER o > {NEIGHBOUR} THEN 1 ELSE 0 END AS new FROM kept WINDOW o AS (PARTITION BY row, label ORDER BY d)),
spans AS (SELECT *, sum(new) OVER (PARTITION BY row, label ORDER BY d ROWS UNBOUNDED PRECEDING) AS span FROM flagged),
found AS (SELECT row, label, verbatim, words, runs, span, len(list_distinct(flatten(list(places)))) AS covered, min(d + low) AS start, max(d + high + {GRAM}) AS stop FROM spans GROUP BY ALL),
good AS (SELECT *, round(covered / runs, 6) AS share FROM found WHERE covered / runs >= {COVERED} AND stop - start <= {STRETCHED} * words)
SELECT d.doc_id, CAST(any_value(len(d.w)) AS BIGINT) AS n_words, count(*) FILTER (WHERE verbatim) AS n_base,
  CAST(min(start) FILTER (WHERE verbatim) AS BIGINT) AS first_word, CAST(max(start) FILTER (WHERE verbatim) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE verbatim), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE share IS NOT NULL), '') AS labels,
  CAST(coalesce(max(share), 0) AS DOUBLE) AS score
FROM d LEFT JOIN good ON d.row = good.row GROUP BY d.row, d.doc_id
"""
