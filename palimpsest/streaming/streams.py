"""Structured Streaming forms: event-time windows, sessions, budgets, and stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, ts: str, width: str, keys: list[str], watermark: str | None = None) -> DataFrame:
    df = events.withWatermark(ts, watermark) if watermark else events
    return df.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))


def sliding(events: DataFrame, ts: str, width: str, slide: str, keys: list[str], watermark: str | None = None) -> DataFrame:
    df = events.withWatermark(ts, watermark) if watermark else events
    return df.groupBy(F.window(ts, width, slide), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], watermark: str | None = None) -> DataFrame:
    df = events.withWatermark(ts, watermark) if watermark else events
    return df.groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))


def hourly_budget(events: DataFrame, ts: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each clock hour; rows beyond are dropped before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.date_trunc("hour", ts)).orderBy(ts, order)
    return events.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


def _accepted(times: list[pd.Timestamp], last: pd.Timestamp | None, gap: pd.Timedelta) -> tuple[list[bool], pd.Timestamp | None]:
    out = []
    for t in times:
        ok = last is None or t - last >= gap
        out.append(ok)
        last = t if ok else last
    return out, last


def _chain(rows: Iterator[pd.DataFrame], key: str, ts: str, gap: pd.Timedelta) -> Iterator[pd.DataFrame]:
    """Accepted rows of keys that arrive sorted by key and time; only the last acceptance is held."""
    now, last = None, None
    for f in rows:
        keep = []
        for k, t in zip(f[key], f[ts]):
            if k != now:
                now, last = k, None
            ok = last is None or t - last >= gap
            keep.append(ok)
            last = t if ok else last
        yield f[keep]


def debounced(events: DataFrame, key: str, ts: str, seconds: float, schema: str, watermark: str = "10 minutes") -> DataFrame:
    """Rows at least ``seconds`` after the last accepted row of their key. In a stream the last acceptance is kept as state.

    The window restarts on acceptance only, so neither dropDuplicates nor a session window can say it. A
    batch is sorted within partitions and read in Arrow batches, so no key is held as a whole. A stream's
    rows behind the watermark are dropped, and a key's state ends when the watermark passes the time from
    which every row is accepted anyway.
    """
    gap = pd.Timedelta(seconds=seconds)
    if events.isStreaming:

        def stateful(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            if state.hasTimedOut:
                state.remove()
                return
            last = pd.Timestamp(state.get[0]) if state.exists else None
            rows = pd.concat(list(frames)).sort_values(ts)
            keep, last = _accepted(list(rows[ts]), last, gap)
            if last is not None:
                state.update((last.to_pydatetime(),))
                state.setTimeoutTimestamp(max(int((last + gap).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
            yield rows[keep]

        return events.withWatermark(ts, watermark).groupBy(key).applyInPandasWithState(stateful, schema, "last timestamp", "append", GroupStateTimeout.EventTimeTimeout)
    return events.repartition(key).sortWithinPartitions(key, ts).mapInPandas(lambda rows: _chain(rows, key, ts, gap), schema)


def deep(prompts: DataFrame, window: int = 5, least: int = 3) -> DataFrame:
    """Add ``deep`` to prompts (session_id, ts, prompt): whether at least ``least`` words of four letters or more occur in the ``window`` prompts before it."""
    from pyspark.sql import Window

    from palimpsest.functions.prompts import long_words

    w = Window.partitionBy("session_id").orderBy("ts").rowsBetween(-window, -1)
    before = F.flatten(F.collect_list("__w").over(w))
    return prompts.withColumn("__w", long_words(F.col("prompt"))).withColumn("deep", F.size(F.array_intersect("__w", before)) >= least).drop("__w")


def recall_due(prompts: DataFrame, intensity: str = "standard", every: int = 5) -> DataFrame:
    """Add ``due`` to prompts (session_id, ts, prompt): with intensity 'max' each, with 'enhanced' every fifth of a session or one that asks to recall, else only one that asks."""
    from pyspark.sql import Window

    from palimpsest.functions.prompts import asks_to_recall

    n = F.row_number().over(Window.partitionBy("session_id").orderBy("ts"))
    rule = {"max": F.lit(True), "enhanced": (n % every == 0) | asks_to_recall(F.col("prompt")), "standard": asks_to_recall(F.col("prompt"))}
    return prompts.withColumn("due", rule[intensity])


class RecallCache:
    """Results by key for ``ttl`` seconds; a write to the store (another version) makes all older ones void."""

    def __init__(self, ttl: float = 300.0, most: int = 256):
        self.ttl, self.most, self.held = ttl, most, {}

    def get(self, key: tuple, version: str, now: float) -> object | None:
        at = self.held.get(key)
        return at[2] if at and at[0] == version and now - at[1] < self.ttl else None

    def put(self, key: tuple, version: str, now: float, value: object) -> None:
        if len(self.held) >= self.most:
            self.held.pop(min(self.held, key=lambda k: self.held[k][1]))
        self.held[key] = (version, now, value)


def grown(files: DataFrame, markers: DataFrame, least: int = 1024) -> DataFrame:
    """Files (session_id, mtime, size_bytes) that are new or grew by more than ``least`` bytes since their marker (session_id, size)."""
    return files.join(markers, "session_id", "left").where(F.col("size").isNull() | (F.col("size_bytes") - F.col("size") > least)).drop("size")


def stale_scan(files: DataFrame, watermark: str | None, most: int, now: str | None = None, apart: int = 900, lookback: int = 86_400, last_scan: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` files changed after the watermark, and the next watermark: held while files are left over.

    Without a watermark the scan looks ``lookback`` seconds back from ``now``. With ``last_scan`` less than ``apart`` seconds
    before ``now`` nothing is taken.
    """
    stamp = lambda x: F.lit(x).cast("timestamp_ntz")
    since = stamp(watermark) if watermark is not None else F.timestamp_add("SECOND", F.lit(-lookback), stamp(now))
    due = files.where(F.col("mtime") > since)
    if now is not None and last_scan is not None:
        due = due.where(F.timestamp_diff("SECOND", stamp(last_scan), stamp(now)) >= apart)
    taken = due.orderBy("mtime", "session_id").limit(most)
    mark = due.agg(F.count("*").alias("due"), F.max("mtime").alias("latest")).select("due", F.when((F.col("due") > most) | F.col("latest").isNull(), since).otherwise(F.col("latest")).alias("watermark"))
    return taken, mark


def counted_batches(stream: DataFrame, consolidate: Callable[[DataFrame], None], folder: str, every: int = 25):
    """Run ``consolidate`` on the rows that arrived since its last run whenever at least ``every`` have; the others wait in ``folder``."""
    from palimpsest.runtime import delete

    waiting = f"{folder}/waiting"

    def merge(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(waiting)
        rows = batch.sparkSession.read.schema(batch.schema).parquet(waiting)
        if rows.count() >= every:
            consolidate(rows)
            delete(batch.sparkSession, waiting)

    return maintain(stream, merge, f"{folder}/checkpoint")


def maintain(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``merge`` on every micro-batch of what is there now (incremental index, profile merge)."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
