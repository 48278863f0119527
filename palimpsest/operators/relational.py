"""Look-ups, filters, counts and copy-on-write deletes over the message view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_sender(m: DataFrame, sender: str) -> DataFrame:
    return m.where(F.col("sender") == sender)


def in_range(m: DataFrame, after: str | None = None, before: str | None = None) -> DataFrame:
    """Inclusive string range of ts, as stamps are compared as text."""
    if after is not None:
        m = m.where(F.col("ts") >= after)
    if before is not None:
        m = m.where(F.col("ts") <= before)
    return m


def senders(m: DataFrame) -> DataFrame:
    return m.where("sender <> ''").select("sender").distinct()


def known_entities(m: DataFrame) -> DataFrame:
    """Lower-case names of senders and recipients, without '' and 'self'."""
    both = m.select(F.lower("sender").alias("entity")).union(m.select(F.lower("recipient")))
    return both.where("entity <> '' and entity <> 'self'").distinct()


def contact_counts(m: DataFrame, primary: str) -> DataFrame:
    """(name, cnt, last_ts) of everybody who exchanges messages with ``primary``, in either direction."""
    p = primary.lower()
    out = m.where((F.lower("sender") == p) & (F.col("recipient") != "")).select(F.lower("recipient").alias("name"), "ts")
    back = m.where((F.lower("recipient") == p) & (F.col("sender") != "")).select(F.lower("sender").alias("name"), "ts")
    return out.unionByName(back).groupBy("name").agg(F.count("*").alias("cnt"), F.max("ts").alias("last_ts"))


def contact_layers(m: DataFrame, primary: str) -> DataFrame:
    """Contacts by frequency relative to the most frequent one: intimate > .6, close > .3, friend > .1, else acquaintance."""
    c = contact_counts(m, primary)
    f = F.col("cnt") / F.lit(c.agg(F.max("cnt")).first()[0])  # one number
    return c.select(
        "name", "cnt", "last_ts", F.round(f, 3).alias("strength"),
        F.when(f > 0.6, "intimate").when(f > 0.3, "close").when(f > 0.1, "friend").otherwise("acquaintance").alias("layer"),
    )


def senders_with(m: DataFrame, least: int) -> DataFrame:
    return m.where("sender <> ''").groupBy("sender").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)


def top_sender(m: DataFrame) -> DataFrame:
    return m.where("sender <> ''").groupBy("sender").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "sender").limit(1)


def page(m: DataFrame, limit: int, offset: int) -> DataFrame:
    return m.orderBy(F.desc("id")).offset(offset).limit(limit)


def metadata_field(name: str) -> Column:
    """A field of the metadata; broken JSON has none."""
    return F.get_json_object("metadata", f"$.{name}")


def forget(derived: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """A derived table without the rows of forgotten messages (ids: id); hash anti-join, no row is looked up alone."""
    return derived.join(ids.select(F.col("id").alias(column)), column, "left_anti")


def forget_summaries(summaries: DataFrame, ids: DataFrame) -> DataFrame:
    """Summaries (sid, message_ids array) of which no source message is forgotten."""
    hit = summaries.select("sid", F.explode("message_ids").alias("id")).join(ids.select("id"), "id", "left_semi").select("sid").distinct()
    return summaries.join(hit, "sid", "left_anti")


def median_row(m: DataFrame, column: str) -> DataFrame:
    """The value at position floor(n / 2) in order (no interpolation), with count, mean, min and max."""
    from pyspark.sql import Window

    n, mean, least, most = m.agg(F.count(column), F.round(F.avg(column), 6), F.min(column), F.max(column)).first()  # one row
    # values are first counted, so the global order is over distinct values only
    per = m.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    run = per.withColumn("upto", F.sum("c").over(Window.orderBy("v"))).where(F.col("upto") > n // 2)
    return run.agg(F.lit(n).alias("n"), F.lit(mean).alias("mean"), F.lit(least).alias("least"), F.lit(most).alias("most"), F.min("v").alias("median"))
