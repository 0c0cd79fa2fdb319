"""A corpus pipeline of five of the training-data operators.

Every stage takes (spark, docs, sf_dir), docs with the columns of documents, and works on all its predecessor kept. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontamination, line_dedup, mixing, near_dedup, quality_rules
from plumbline.llm.common import dropped, row_key, scratch, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept_rows(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line passages and chunks of earlier places; those left without a word go."""
    out = line_dedup.passage_dedup(docs.select(*COLUMNS))
    left = (F.col("removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    n_chars = F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(left).withColumn("n_chars", n_chars).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, Jaccard 0.8 or more) the document with the least id.

    Null ids rank first. Rows are told apart by id and text; of rows with the same id and text one stays.
    """
    keyed = docs.select(*COLUMNS).withColumn("key", row_key("doc_id", "text"))
    ranked = near_dedup.near_dedup(keyed.select(F.struct("doc_id", "key").alias("rank"), "text"), id_col="rank")
    stays = stored(ranked.where(F.col("rank") == F.col("component_id")).select("rank.key"), "stays")
    repeated = stays.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    out = keyed.join(stays.distinct(), "key", "left_semi")
    return (out.dropDuplicates(["key"]) if repeated else out).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    keyed = docs.select(*COLUMNS).withColumn("key", row_key("doc_id", "text"))
    leaks = decontamination.decontaminate(keyed, table(spark, sf_dir, "benchmark"), id_col="key").select("key").distinct()
    return keyed.join(leaks, "key", "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target, rate, copies (1 or more) and taken.

    Rows with the same id and text get the same number of copies.
    """
    keyed = docs.select(*COLUMNS).withColumn("key", row_key("doc_id", "text"))
    counts = mixing.mix(keyed, id_col="key").where("copies > 0")
    per = counts.groupBy("key").agg(*[F.max(c).alias(c) for c in ("size", "source_size", "target", "rate", "copies", "taken")])
    return keyed.join(per, "key").drop("key")


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_duplicates), ("decontamination", decontaminated), ("mixing", mixed)]

#: Fingerprints (XXH64) and Newton iterations have no form in SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again; then its own tables are deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            after = stage(spark, docs, sf_dir)
            docs = stored(after, "pipeline-" + name.replace(" ", "-"), lasting=True)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
