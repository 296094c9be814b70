"""A corpus pipeline: quality classifier, line dedup, near-dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written and read again before
the next. All but the last return the columns of documents; the last returns what the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import decontaminate, lines, mixing, quality, simhash
from tablewright.llm.common import table, without, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=("text", "lang", "source", "n_chars"))
    return scored.filter("score >= 0.5").select(F.col("id").alias("doc_id"), *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(COLUMNS[1:])))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the first document that has them. A document that loses lines and has no
    text left goes."""
    out = lines.drop_lines(docs, carry=("lang", "source", "n_chars"))
    out = out.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    changed = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("rest.n_chars"))
    return out.select(F.col("id").alias("doc_id"), "text", "rest.lang", "rest.source", changed.alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    gone = written(simhash.near_duplicates(docs).select(F.col("id").alias("doc_id")))
    return without(docs, gone, "doc_id").select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark items are cut out; a document of which no word is left goes."""
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=("lang", "source", "n_chars"))
    out = out.filter(~F.col("contaminated") | F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    changed = F.when(F.col("contaminated"), F.char_length("text").cast("long")).otherwise(F.col("rest.n_chars"))
    return out.select(F.col("id").alias("doc_id"), "text", "rest.lang", "rest.source", changed.alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken."""
    return mixing.mix(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: The classifier and the near-duplicate groups can't be put in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs) if k < len(STAGES) - 1 else docs
    return docs
