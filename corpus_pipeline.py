"""A training-data pipeline: five stages, each an operator over all that the stage before it kept.

Part of the corpus operators (`sigmill.llm`). A stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written and read again before the next stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm import line_crf, near_copies, packing, quality_rules, suffix_dedup
from sigmill.llm.shared import materialize, set_aside


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their group's robust ellipsoid go. Null doc_ids stay."""
    rejected = quality_rules.judge(docs).filter("not kept").select(F.col("doc_id").alias("gone"))
    return docs.join(rejected, docs["doc_id"].cast("long") == rejected["gone"], "left_anti")


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model predicts bad go; it learns from labels of documents that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~line_crf.is_held_out("doc_id", 5, 0))
    model = line_crf.train(docs, labels)
    docs, own = set_aside(docs, "score")
    return line_crf.score(docs, model, tuple(docs.columns)).filter(F.col("score") >= line_crf.THRESHOLD).select(*own)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest doc_id stays. SimHash links
    come first, an exact join finds the pairs that they miss."""
    return near_copies.keep_one(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut from the texts."""
    docs, own = set_aside(docs, *suffix_dedup.ADDED)
    cut = suffix_dedup.dedup(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*own)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining texts, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("quality_classifier", classifier_stage),
    ("near_dedup", near_copy_stage),
    ("suffix_dedup", suffix_stage),
    ("packing", packing_stage),
]

#: A fitted ellipsoid, a trained model and a tokenizer are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
