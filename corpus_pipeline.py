"""From documents to training sequences in five stages, each written and read again before the next.

quality classifier (rejected documents go) -> line dedup (repeated lines are cut; a document of which nothing is left
goes) -> MinHash near-dedup (one document of each group stays) -> benchmark decontamination (documents that hold a test
item go) -> best-fit packing of what is left into sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listloom.llm import decontaminate, line_dedup, lsh_forest, packing, quality
from listloom.llm.common import small, stored, table
from listloom.llm.tokens import default_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(quality.held_out(F.col("doc_id"), 3) != 1)
    return quality.classify(docs.select(*COLUMNS), labels).filter("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(docs.select(*COLUMNS))
    changed = F.size("removed_lines") > 0
    left = cut.filter(~changed | F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]")))
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, _ = lsh_forest.keyed(docs.select(*COLUMNS))
    labels = lsh_forest.grouped(docs.select(F.col("_key").alias("doc"), "text"), n=5, percent=80)
    gone = stored(labels.filter("doc <> label").select(F.col("doc").alias("_gone")), "near-duplicates")
    return docs.join(small(gone, 1_000_000), F.col("_key") == F.col("_gone"), "left_anti").select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, default_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: The classifier's network can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
