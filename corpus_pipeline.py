"""The corpus pipeline: quality rules, near-dedup, repeated passages, personal data, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame, which is written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents; n_chars follows the text.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomata.llm import near_dedup, packing, quality_rules, repeat_index, sanitise
from axiomata.llm.tables import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that policy v1 of the rule ledger rejects."""
    return quality_rules.passing(docs, "v1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of near-duplicates, of a similarity of 0.8 or more."""
    return near_dedup.representatives(docs.select(*COLUMNS), percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller doc_id has too."""
    done = repeat_index.without_repeats(docs.select(*COLUMNS), with_text=True)
    return done.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that disclose it, by the names of their kinds."""
    return sanitise.sanitised(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("personal data", personal_data),
    ("best-fit packing", packed),
]

#: MinHash, run-length indexes and packing have no SQL form; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
