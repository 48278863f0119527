"""Conversations of benchmarks as message rows, and telemetry rows within their retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP_SECONDS, KEEP_DAYS = 30, 7


def session_messages(sessions: DataFrame, step: int = STEP_SECONDS) -> DataFrame:
    """(conversation, session, sender, content, timestamp) of sessions (conversation, session, begins, turns array<struct<speaker, text>>).

    Turn i is ``step`` * i seconds after the begin; turns without text are left out, a session without a begin has empty stamps.
    """
    rows = sessions.select("conversation", "session", F.expr("try_cast(begins as timestamp_ntz)").alias("at"), F.posexplode("turns").alias("i", "t"))
    stamp = F.coalesce(F.date_format(F.timestamp_add("SECOND", (F.col("i") * step).cast("int"), F.col("at")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    return rows.where(F.trim("t.text") != "").select("conversation", "session", F.col("t.speaker").alias("sender"), F.col("t.text").alias("content"), stamp.alias("timestamp"))


def chat_messages(chats: DataFrame) -> DataFrame:
    """(conversation, batch, sender, content, timestamp) of chats (conversation, chat array<array<struct<role, content, time_anchor>>>): batches in order, the last time anchor before a turn counts."""
    rows = chats.select("conversation", F.posexplode("chat").alias("batch", "turns"))
    anchored = F.aggregate("turns", F.struct(F.array().cast("array<struct<role:string,content:string,at:string>>").alias("done"), F.lit("").alias("at")), lambda acc, t: F.struct(
        F.array_append(acc["done"], F.struct(t["role"].alias("role"), t["content"].alias("content"), F.coalesce(F.nullif(t["time_anchor"], F.lit("")), acc["at"]).alias("at"))).alias("done"),
        F.coalesce(F.nullif(t["time_anchor"], F.lit("")), acc["at"]).alias("at"),
    ), lambda acc: acc["done"])
    return rows.select("conversation", "batch", F.explode(anchored).alias("t")).where(F.trim("t.content") != "").select("conversation", "batch", F.col("t.role").alias("sender"), F.col("t.content").alias("content"), F.col("t.at").alias("timestamp"))


def emit(spark: SparkSession, path: str, signals: list[tuple[datetime, str, str]]) -> None:
    """Append telemetry (ts, signal, payload as JSON)."""
    spark.createDataFrame(signals, "ts timestamp_ntz, signal string, payload string").write.mode("append").parquet(path)


def recent_signals(rows: DataFrame, signal: str | None, since: datetime, limit: int = 100) -> DataFrame:
    """Telemetry after ``since``, newest first."""
    out = rows.where(F.col("ts") > F.lit(since).cast("timestamp_ntz"))
    return (out if signal is None else out.where(F.col("signal") == signal)).orderBy(F.desc("ts")).limit(limit)


def kept_signals(rows: DataFrame, column: str, now: datetime, days: int = KEEP_DAYS) -> DataFrame:
    """Telemetry within its retention of ``days``."""
    return rows.where(F.col(column) > F.timestamp_add("DAY", F.lit(-days), F.lit(now).cast("timestamp_ntz")))
