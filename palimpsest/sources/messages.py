"""The message view that all core operators read, and its siblings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.runtime import table

MESSAGE = "id bigint, content string, sender string, recipient string, ts string, category string, modality string, directive boolean, metadata string"


def messages_view(raw: DataFrame, keep: str | None = None) -> DataFrame:
    """One row for each id with '' for missing text, false for a missing directive and '{}' for missing metadata.

    Whole rows delivered twice count once; an optional column that is absent gets its default. ``keep`` is a
    condition on the raw columns: as a repeated id is the same row, it is put before the repeats are
    dropped, so it reaches the scan and only what it keeps is shuffled.
    """
    have = set(raw.columns)
    text = lambda c, d="": F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d)
    return (raw if keep is None else raw.where(keep)).select(
        F.col("id").cast("bigint").alias("id"), text("content").alias("content"), text("sender").alias("sender"), text("recipient").alias("recipient"), text("timestamp").alias("ts"),
        text("category").alias("category"), text("modality").alias("modality"), (F.coalesce("directive", F.lit(False)) if "directive" in have else F.lit(False)).alias("directive"), text("metadata", "{}").alias("metadata"),
    ).dropDuplicates(["id"])


def load_messages(spark: SparkSession, folder: str, keep: str | None = None) -> DataFrame:
    return messages_view(table(spark, folder, "messages"), keep)


def messages_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a JSON array file or of JSON lines; blank contents are left out, ids are numbered in file order if absent."""
    raw = spark.read.option("multiLine", True).json(path)
    if "id" not in raw.columns:
        raw = raw.withColumn("id", F.monotonically_increasing_id() + 1)
    return messages_view(raw).where(F.trim("content") != "")
