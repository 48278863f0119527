"""Validity history of entity attributes, kept by rebuilding the affected chains.

A *statement* says that an entity's subject had a value from an instant on, or (value
null) that it had none. A *chain* is the list of versions of one (entity, subject).
Late or corrected statements can change any part of a chain, so ``apply_updates`` fetches
all statements of the touched entities only, rebuilds all their chains and publishes a
new table version in which just those chains are replaced.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.runtime import delete, publish_text, read_text, require, squash

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
#: Window groups hold at most one chain's statements of this many seconds, so that a chain with a third of all rows is spread.
SPAN_SECONDS = 30 * 86_400
#: Statement folders of so many updates are folded into one.
MOST_PARTS = 16


def utc_seconds(text: str) -> Column:
    """Seconds since 1970 of an ISO stamp; without offset it is UTC; null if it denotes no instant."""
    t = f"trim(`{text}`)"
    return F.expr(
        f"case when {t} rlike '[T ][0-9:.]+[+-][0-9]{{2}}(:?[0-9]{{2}})?$' then unix_seconds(try_cast({t} as timestamp)) "
        f"else timestampdiff(SECOND, {EPOCH}, try_cast(regexp_replace({t}, '[zZ]$', '') as timestamp_ntz)) end"
    )


def utc_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_add("SECOND", seconds, F.expr(EPOCH)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def statements(timeline: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Raw changes in one form: (entity, subject, at, value, seq, origin).

    ``timeline`` has (id, entity_scope, subject, fact, valid_from), ``snapshots`` has
    (as_of, entity_scope, subject, fact). Rows with a null or blank entity or subject, a
    null fact or an unusable time state nothing and are left out. Extra columns are ignored.
    """
    require(timeline, ["id", "entity_scope", "subject", "fact", "valid_from"], "statements")
    require(snapshots, ["as_of", "entity_scope", "subject", "fact"], "statements")

    def shape(df: DataFrame, at: str, seq: Column, origin: str) -> DataFrame:
        return df.select(
            squash("entity_scope").alias("entity"), squash("subject").alias("subject"), utc_seconds(at).alias("at"),
            squash("fact").alias("value"), seq.alias("seq"), F.lit(origin).alias("origin"),
        ).where("entity <> '' and subject <> '' and at is not null and value is not null")

    return shape(timeline, "valid_from", F.col("id").cast("bigint"), "timeline").unionByName(
        shape(snapshots, "as_of", F.lit(-1).cast("bigint"), "snapshot")
    )


def build_chains(stated: DataFrame) -> DataFrame:
    """All versions of all chains in ``stated``: (entity, subject, value, valid_from, valid_to), seconds.

    * Of several statements at one moment the timeline row with the largest ``seq`` holds;
      a snapshot holds only beside no timeline row (ties: the larger value).
    * A snapshot date of an entity ends the value of each of its subjects that has no
      statement at that very moment.
    * Restating a value changes nothing; ``valid_to`` is null while the version is open.

    An empty input gives an empty result; repeated rows have no effect.
    """
    key = ["entity", "subject"]
    at_once = stated.groupBy(*key, "at").agg(
        F.max_by("value", F.struct(F.col("seq"), F.col("value"))).alias("value")
    )
    # dates are few (one per day at most), so an entity's list is bounded by the calendar, not by its rows
    dates = stated.where("origin = 'snapshot'").groupBy("entity").agg(F.array_sort(F.collect_set("at")).alias("dates"))
    points = (
        at_once.join(dates, "entity", "left")
        .withColumn("gone", F.array_min(F.filter("dates", lambda d: d > F.col("at"))))
        .drop("dates")
        .withColumn("span", F.floor(F.col("at") / SPAN_SECONDS))
    )
    inner = Window.partitionBy(*key, "span").orderBy("at")
    last = points.groupBy(*key, "span").agg(
        F.max_by(F.struct("value", "gone"), "at").alias("tail"), F.min("at").alias("head_at")
    )
    outer = Window.partitionBy(*key).orderBy("span")
    spans = last.select(
        *key, "span", F.lag("tail").over(outer).alias("before"), F.lead("head_at").over(outer).alias("after_at")
    )
    points = (
        points.withColumn("prev", F.lag(F.struct("value", "gone")).over(inner))
        .withColumn("next_at", F.lead("at").over(inner))
        .join(spans, [*key, "span"])
        .withColumn("prev", F.coalesce("prev", "before"))
        .withColumn("next_at", F.coalesce("next_at", "after_at"))
    )
    # the value before holds until the first date that lacks the subject
    points = points.withColumn(
        "starts", F.col("prev").isNull() | (F.col("prev.value") != F.col("value")) | F.coalesce(F.col("prev.gone") < F.col("at"), F.lit(False))
    ).withColumn("stops", F.when(F.coalesce(F.col("gone") < F.col("next_at"), F.col("gone").isNotNull()), F.col("gone")))
    # version number = running count of starts, again in two levels
    count = F.sum(F.col("starts").cast("int")).over(inner)
    per_span = points.groupBy(*key, "span").agg(F.sum(F.col("starts").cast("int")).alias("n"))
    base = per_span.select(*key, "span", (F.sum("n").over(outer) - F.col("n")).alias("base"))
    numbered = points.withColumn("version", count).join(base, [*key, "span"]).withColumn("version", F.col("version") + F.col("base"))
    versions = numbered.groupBy(*key, "version").agg(
        F.first("value").alias("value"), F.min("at").alias("valid_from"), F.max_by("next_at", "at").alias("next_at"), F.max_by("stops", "at").alias("stops")
    )
    return versions.select(*key, "value", "valid_from", F.coalesce("stops", "next_at").alias("valid_to"))


class HistoryStore:
    """Statements and chains on disk, in hash buckets of the entity.

    ``CURRENT`` names the live version; it is replaced by one rename, so readers see the
    chains before an update or after it. Buckets no update touches are carried over by
    reference, never rewritten. Statements of MOST_PARTS updates are folded into one folder.
    The number of buckets is fixed when the store is made: an update reads and writes the
    touched ones, so there should be many of them beside what an update touches. One writer
    at a time is assumed.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path
        text = read_text(spark, os.path.join(path, "CURRENT"))
        self.state = json.loads(text) if text else {"buckets": buckets, "statements": [], "chains": {}}

    def _read(self, folders: list[str], buckets: list[int] | None = None) -> DataFrame | None:
        parts = [self.spark.read.option("basePath", f).parquet(f) for f in folders]
        if buckets is not None:
            parts = [p.where(F.col("bucket").isin(buckets)) for p in parts]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def _write(self, rows: DataFrame, name: str) -> str:
        at = os.path.join(self.path, f"{name}-{uuid.uuid4().hex}")
        rows.withColumn("bucket", F.pmod(F.xxhash64("entity"), F.lit(self.state["buckets"])).cast("int")).repartition("bucket").write.partitionBy("bucket").parquet(at)
        return at

    def _publish(self, state: dict) -> None:
        publish_text(self.spark, os.path.join(self.path, "CURRENT"), json.dumps(state))
        before, self.state = self.state, state
        gone = {*before["statements"], *before["chains"].values()} - {*state["statements"], *state["chains"].values()}
        for folder in gone:
            delete(self.spark, folder)

    def chains(self) -> DataFrame | None:
        """The live chains; None before the first update."""
        live: dict[str, list[int]] = {}
        for b, folder in self.state["chains"].items():
            live.setdefault(folder, []).append(int(b))
        out = None
        for folder, buckets in live.items():
            part = self._read([folder], buckets)
            out = part if out is None else out.unionByName(part)
        return None if out is None else out.drop("bucket")

    def apply_updates(self, new: DataFrame) -> None:
        """Add raw statements, rebuild the chains of the entities they touch and publish at once.

        Only the buckets of touched entities are read and written; their untouched entities'
        chains are copied, not recomputed. Buckets have a fixed number.
        """
        if new.isEmpty():
            return
        now = self.state
        added = self._write(new, "statements")
        fresh = self.spark.read.option("basePath", added).parquet(added)
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most as many as buckets
        entities = fresh.select("entity").distinct()
        raw = self._read([*now["statements"], added], touched).join(entities, "entity", "left_semi")
        rebuilt = build_chains(raw.drop("bucket"))
        old: dict[str, list[int]] = {}
        for b in touched:
            if str(b) in now["chains"]:
                old.setdefault(now["chains"][str(b)], []).append(b)
        for folder, buckets in old.items():
            kept = self._read([folder], buckets).drop("bucket").join(entities, "entity", "left_anti")
            rebuilt = rebuilt.unionByName(kept)
        target = self._write(rebuilt, "chains")
        statements_ = [*now["statements"], added]
        if len(statements_) > MOST_PARTS:
            statements_ = [self._write(self._read(statements_).drop("bucket"), "statements")]
        self._publish({"buckets": now["buckets"], "statements": statements_, "chains": now["chains"] | {str(b): target for b in touched}})

    def drop(self) -> None:
        delete(self.spark, self.path)


def rebuild_affected(chains: DataFrame | None, raw: DataFrame, touched: DataFrame | None) -> DataFrame:
    """The chains after an update, without a store.

    ``raw`` are all statements, ``touched`` the entities of late or corrected ones (None: all
    are touched, as on the first load), ``chains`` the table before. Chains of other entities
    are passed through.
    """
    if touched is None or chains is None:
        return build_chains(raw)
    touched = touched.select("entity").distinct()
    return build_chains(raw.join(touched, "entity", "left_semi")).unionByName(chains.join(touched, "entity", "left_anti"))


def versions_text(chains: DataFrame) -> DataFrame:
    """(entity_scope, subject, valid_from, valid_to) with times as text, '' while open."""
    return chains.select(
        F.col("entity").alias("entity_scope"), "subject", utc_text(F.col("valid_from")).alias("valid_from"),
        F.coalesce(utc_text(F.col("valid_to")), F.lit("")).alias("valid_to"),
    ).distinct()
