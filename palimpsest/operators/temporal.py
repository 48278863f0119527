"""Timelines, gap sessionisation, episode expansion and landmark events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import lexicon

GAP_SECONDS = 6 * 3600


def naive(ts: str = "ts") -> Column:
    """Wall time of a stamp: an offset is stripped, not converted; null if it can't be read."""
    bare = F.regexp_replace(F.trim(F.col(ts)), r"([+-]\d{2}:\d{2}|Z)$", "")
    return F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"), F.expr(f"try_cast(regexp_replace(trim(`{ts}`), '([+-][0-9]{{2}}:[0-9]{{2}}|Z)$', '') as timestamp_ntz)"))


def exclusive_upper(before: str) -> str:
    """A date counts to its end: the next day, exclusively; a stamp counts to its next microsecond as text."""
    import datetime
    import re

    if re.fullmatch(r"\d{4}-\d\d-\d\d", before):
        return (datetime.date.fromisoformat(before) + datetime.timedelta(days=1)).isoformat()
    return before


def timeline(m: DataFrame, entity: str | None = None, after: str | None = None, before: str | None = None) -> DataFrame:
    """Messages with a stamp in [after, before], of an entity as sender or recipient in any case."""
    out = m.where("ts <> ''")
    if entity is not None:
        e = entity.lower()
        out = out.where((F.lower("sender") == e) | (F.lower("recipient") == e))
    if after is not None:
        out = out.where(F.col("ts") >= after)
    return out if before is None else out.where(F.col("ts") < exclusive_upper(before))


def backfilled(hits: DataFrame, line: DataFrame, limit: int) -> DataFrame:
    """Hits first; up to ``limit`` rows are filled from the timeline in its order."""
    rest = line.join(hits.select("id"), "id", "left_anti").select("id", "ts").withColumn("hit", F.lit(0))
    return hits.select("id", "ts").withColumn("hit", F.lit(1)).unionByName(rest).orderBy(F.desc("hit"), "ts", "id").limit(limit)


def episodes(m: DataFrame, gap: int = GAP_SECONDS, key: str | None = None, day_seconds: int = 86_400) -> DataFrame:
    """(id, at, episode): a new episode begins after a gap of more than ``gap`` seconds (globally, or per ``key``).

    Gaps and islands in two levels: rows are windowed within days only, days are chained by their
    borders, so no task sorts the whole timeline. Rows without a readable stamp have no episode;
    ties of time keep the order of ids.
    """
    keys = [key] if key else []
    at = m.withColumn("at", naive()).where("at is not null")
    at = at.withColumn("s", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', at) / 1000000.0D")).withColumn("day", F.floor(F.col("s") / day_seconds))
    inner, outer = Window.partitionBy(*keys, "day").orderBy("s", "id"), Window.partitionBy(*(keys or [F.lit(0)])).orderBy("day")
    rows = at.withColumn("new", (F.col("s") - F.lag("s").over(inner) > gap).cast("int"))
    days = rows.groupBy(*keys, "day").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.sum(F.coalesce("new", F.lit(0))).alias("inside"))  # one row for a day
    days = days.withColumn("opens", F.coalesce((F.col("lo") - F.lag("hi").over(outer) > gap).cast("int"), F.lit(1)))
    days = days.withColumn("base", F.sum(F.col("opens") + F.col("inside")).over(outer) - F.col("inside"))
    return rows.join(days.select(*keys, "day", "base"), [*keys, "day"]).withColumn(
        "episode", (F.col("base") + F.sum(F.coalesce("new", F.lit(0))).over(inner)).cast("bigint")
    ).select(*keys, "id", "ts", "at", "episode")


def episode_table(rows: DataFrame) -> DataFrame:
    return rows.groupBy("episode").agg(F.min("at").alias("start_at"), F.max("at").alias("end_at"), F.count("*").alias("message_count"))


def expand(hits: DataFrame, rows: DataFrame, most: int = 3, factor: float = 0.6) -> DataFrame:
    """Hits (id, score) and the other messages of their ``most`` best episodes with ``factor`` times the hit's score."""
    of = hits.join(rows.select("id", "episode"), "id")
    best = of.groupBy("episode").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "episode").limit(most)
    around = rows.join(F.broadcast(best), "episode").join(hits.select("id"), "id", "left_anti").select("id", (F.col("score") * factor).alias("score"))
    return hits.select("id", "score").unionByName(around)


def landmarks(m: DataFrame) -> DataFrame:
    """(id, event_type, event_name): the first landmark type that a dated message shows, with 30 characters before and 50 after."""
    kind = F.lit(None).cast("string")
    word = F.lit(None).cast("string")
    for name, words in reversed(lexicon.LANDMARKS.items()):
        p = rf"(?i)\b(?:{words})\b"
        kind = F.when(F.col("content").rlike(p), name).otherwise(kind)
        word = F.when(F.col("content").rlike(p), F.regexp_extract("content", p, 0)).otherwise(word)
    found = m.where("ts <> ''").withColumn("event_type", kind).withColumn("__w", word).where("event_type is not null")
    p = F.coalesce(*(F.when(F.col("event_type") == n, F.regexp_instr("content", F.lit(rf"(?i)\b(?:{w})\b"))) for n, w in lexicon.LANDMARKS.items()))
    start = F.greatest(F.lit(0), p - 1 - 30)
    return found.select("id", "ts", "event_type", F.trim(F.col("content").substr(start + 1, p - 1 + F.length("__w") + 50 - start)).alias("event_name"))


def entity_timeline(m: DataFrame) -> DataFrame:
    """(entity, id, ts): each message once for each of its parties."""
    return m.select(F.explode(F.array_distinct(F.array(F.lower("sender"), F.lower("recipient")))).alias("entity"), "id", "ts").where("entity <> ''")
