"""From documents to a training mix, in five stages; each takes and returns documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import leaks, lines, mixing, near, quality
from millrace.llm.common import count_words, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, expects to have the top grade."""
    labels = table(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.train(docs, labels, quality.graded(labels)))
    return scored.where(F.col("quality.p_top") >= quality.KEEP).select(docs.columns)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stood before; documents of which no line is left go, those that had none stay."""
    out = lines.dedup_lines(docs).where("n_lines = 0 OR n_dropped < n_lines")
    return out.select(*[{"text": F.col("kept_text").alias("text"), "n_chars": F.length("kept_text").cast("long").alias("n_chars")}.get(c, F.col(c)) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near.drop_near(docs, 80)


def leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return leaks.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their targets: each document as often as the mix takes it, with the number of the repetition."""
    mixed = mixing.mix(docs, count_words(F.col("text"))).where("repeats > 0")
    return mixed.select(*docs.columns, "size", "target", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("repetition"))


STAGES = [("quality", quality_stage), ("lines", lines_stage), ("near", near_stage), ("leaks", leaks_stage), ("mixing", mixing_stage)]

#: SQL can neither fit the classifier nor contract a link graph of this size; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
