"""From raw documents to packed training sequences, in four stages.

Each stage takes all rows that the one before it kept and returns the columns of documents; the
last one returns the packed pieces. Between stages the rows are written as Parquet to the shared
folder and read again, so that a stage that loses executors starts from its own input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import near_dedup, packing, quality, substring_dedup
from skein.llm.common import shared_folder, table
from skein.llm.vocab import default_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier doesn't reject."""
    docs = docs.select(COLUMNS)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of a similarity of 0.8 or more;
    rows that repeat go to one. Rows are told apart by doc_id and text: one that shares its doc_id, or
    its lack of one, with a row that stays may still go."""
    docs = docs.select(COLUMNS).withColumns({"t1": near_dedup.text_key(1), "t2": near_dedup.text_key(2)})
    kept = near_dedup.components(docs, percent=80).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("t1").alias("k1"), F.col("t2").alias("k2")).distinct()
    same = docs["doc_id"].eqNullSafe(kept["kept_id"]) & (docs["t1"] == kept["k1"]) & (docs["t2"] == kept["k2"])
    return docs.join(kept, same, "left_semi").select(COLUMNS).dropDuplicates(["doc_id", "text"])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts; no document goes, even if nothing is left of it."""
    docs = docs.select(COLUMNS)
    own = docs.withColumns({"t1": substring_dedup.text_key(1), "t2": substring_dedup.text_key(2)})
    cut = substring_dedup.without_ranges(own, substring_dedup.repeated_ranges(substring_dedup.keyed(docs)), with_text=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    length = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", length.alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into sequences of 2048."""
    return packing.pack(docs, default_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_near_copies),
    ("substring dedup", without_repeats),
    ("packing", packed),
]

#: The classifier is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
