"""Mixed timestamp formats and time zones, normalised by Viterbi over each source's record order.

Each value gets all its interpretations as an array. A path through a source's records
costs ``RULE_COST`` for each convention that a reading breaks, ``SWITCH_COST`` for each
change of form between neighbours and ``BACK_COST`` for each jump back in time; the
cheapest path wins. RULE_COST exceeds what any single reading can save on its two
neighbours, so the conventions decide where they speak and the path costs elsewhere.

A source may hold any share of the rows: rows are range-partitioned by (source, order), so
one source spreads over many tasks. Each task reduces the run that crosses its border to a
min-plus matrix over the border's readings; the driver chains these few matrices (two per
task) and a second pass decodes every run between the fixed ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.stamps import interpretations
from palimpsest.runtime import cut, shuffle_partitions

RULE_COST, SWITCH_COST, BACK_COST = 100, 1, 2
READINGS = "array<struct<cost:int,form:string,us:bigint>>"


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("cost", pa.int32()), ("form", pa.string()), ("us", pa.int64())]))
    for b in batches:
        texts, zones = b.column("stamp").to_pylist(), b.column("zone").to_pylist()
        found = [[{"cost": c, "form": f, "us": u} for c, f, u in interpretations(t, z)] for t, z in zip(texts, zones)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], [*b.schema.names, "readings"])


def _step(before: tuple[str, int], form: str, us: int) -> int:
    return (SWITCH_COST if before[0] != form else 0) + (BACK_COST if us < before[1] else 0)


def _advance(costs: list[float], last: list, now: list) -> tuple[list[float], list[int]]:
    """One Viterbi step: costs and back pointers of ``now`` (entries (cost, form, us)) given those of ``last``."""
    if len(last) == 1 and len(now) == 1:  # nothing to choose
        return [costs[0] + _step(last[0][1:], *now[0][1:]) + RULE_COST * now[0][0]], [0]
    out, back = [], []
    for c, form, us in now:
        best, at = min((costs[i] + _step(p[1:], form, us), i) for i, p in enumerate(last))
        out.append(best + RULE_COST * c)
        back.append(at)
    return out, back


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[object, list]]:
    """(source, readings) row by row; rows without a reading are left out (they have no state)."""
    for f in frames:
        for s, r in zip(f["source"], f["readings"]):
            yield s, ([] if r is None else [(x["cost"], x["form"], x["us"]) for x in r])


def _border(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First and last run of the partition with the min-plus matrix from its first to its last readings."""
    pid = TaskContext.get().partitionId()
    runs: list[dict] = []
    for source, now in _runs(frames):
        if not now:
            continue
        if not runs or runs[-1]["source"] != source:
            runs = [*runs[:1], {"source": source, "n": 0}] if runs else [{"source": source, "n": 0}]
            runs[-1] |= {"first": now, "last": now, "m": [[RULE_COST * x[0] if i == j else float("inf") for j, x in enumerate(now)] for i in range(len(now))]}
            continue
        run = runs[-1]
        run["m"] = [_advance(row, run["last"], now)[0] for row in run["m"]]
        run["last"] = now
    rows = [(pid, k, r["source"], _pack(r["first"]), _pack(r["last"]), [[float(x) for x in row] for row in r["m"]]) for k, r in enumerate(runs)]
    yield pd.DataFrame(rows, columns=["pid", "k", "source", "first", "last", "m"])


def _pack(readings: list) -> list[dict]:
    return [{"cost": c, "form": f, "us": u} for c, f, u in readings]


def _chain(borders: list) -> dict[int, dict]:
    """Per partition: the reading before its first run, and the fixed last reading of its last run, where a source crosses."""
    borders = sorted(borders, key=lambda r: (r["pid"], r["k"]))
    read = lambda xs: [(x["cost"], x["form"], x["us"]) for x in xs]
    groups: list[list] = []
    for r in borders:
        if groups and groups[-1][-1]["source"] == r["source"] and groups[-1][-1]["pid"] != r["pid"]:
            groups[-1].append(r)
        else:
            groups.append([r])
    fixed: dict[int, dict] = {}
    for g in (g for g in groups if len(g) > 1):
        # states are last readings of each run; costs with back pointers
        costs = [min(row[j] for row in g[0]["m"]) for j in range(len(g[0]["last"]))]
        backs = []
        for before, r in zip(g, g[1:]):
            last, first = read(before["last"]), read(r["first"])
            enter = [[costs[i] + _step(p[1:], *x[1:]) for i, p in enumerate(last)] for x in first]
            new, back = [], []
            for j in range(len(r["last"])):
                best = min((enter[a][i] + r["m"][a][j], i) for a in range(len(first)) for i in range(len(last)))
                new.append(best[0])
                back.append(best[1])
            costs, _ = new, backs.append(back)
        at = costs.index(min(costs))
        picks = [at]
        for back in reversed(backs):
            picks.append(at := back[at])
        picks.reverse()
        for n, (r, pick) in enumerate(zip(g, picks)):
            if n + 1 < len(g):
                fixed.setdefault(r["pid"], {})["end"] = pick
            if n:
                x = g[n - 1]["last"][picks[n - 1]]
                fixed.setdefault(r["pid"], {})["before"] = (x["form"], x["us"])
                fixed[r["pid"]]["source"] = r["source"]
    return fixed


class _Decoder:
    """Viterbi decoding of one partition, with rows numbered from 0; frames leave as soon as their rows are decided."""

    def __init__(self, mine: dict):
        self.mine, self.chosen, self.waiting, self.costs = mine, {}, [], []

    def settle(self, end: int | None) -> None:
        """Decide the waiting rows (row, readings, back pointers) from the last one's state ``end`` (None: the cheapest)."""
        if self.waiting:
            at = self.costs.index(min(self.costs)) if end is None else end
            for row, now, back in reversed(self.waiting):
                self.chosen[row] = now[at][2]
                at = back[at]
        self.waiting = []

    def begin(self, row: int, now: list, before: tuple | None) -> None:
        self.costs = [RULE_COST * x[0] + (_step(before, x[1], x[2]) if before else 0) for x in now]
        self.waiting = [(row, now, [0] * len(now))]

    def follow(self, row: int, now: list) -> None:
        new, back = _advance(self.costs, self.waiting[-1][1], now)
        if len(now) == 1:  # a certain row decides all that wait before it, and stays as the state
            self.settle(back[0])
            back = [0]
            self.chosen[row] = now[0][2]
        self.costs = new
        self.waiting.append((row, now, back))

    def undecided(self, rows: int) -> int:
        """The first row whose reading is still open."""
        return next((w[0] for w in self.waiting if w[0] not in self.chosen), rows)


def _decoder(fixed: dict[int, dict]):
    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = fixed.get(TaskContext.get().partitionId(), {})
        d = _Decoder(mine)
        held: list[tuple[int, pd.DataFrame]] = []
        source, rows = None, 0

        def leave(g: tuple[int, pd.DataFrame]) -> pd.DataFrame:
            at, f = g
            return f.assign(utc_us=pd.array([d.chosen.pop(i, None) for i in range(at, at + len(f))], dtype="Int64"))

        for f in frames:
            held.append((rows, f.drop(columns=["readings"])))
            for s, r in zip(f["source"].tolist(), f["readings"].tolist()):
                now = [] if r is None else [(x["cost"], x["form"], x["us"]) for x in r]
                if now and d.waiting and s == source:
                    d.follow(rows, now)
                elif now:
                    d.settle(None)
                    crosses = source is None and "before" in mine and mine["source"] == s
                    d.begin(rows, now, mine["before"] if crosses else None)
                    source = s
                rows += 1
            done = d.undecided(rows)
            while held and held[0][0] + len(held[0][1]) <= done:
                yield leave(held.pop(0))
        d.settle(mine.get("end"))
        yield from map(leave, held)

    return decode


def normalise_timestamps(rows: DataFrame) -> DataFrame:
    """Add ``utc_us`` (microseconds since 1970 UTC, null if the stamp denotes no instant).

    ``rows`` has exactly what identifies a row plus ``source`` (string), ``ord`` (record order
    within the source), ``stamp`` (text) and ``zone`` (IANA zone for stamps without one, or
    null: UTC). Ties in ``ord`` keep any order; repeated rows get the same result if their
    neighbours allow no other. Null or unusable stamps take no part in the path.
    """
    spark = rows.sparkSession
    n = shuffle_partitions(spark)
    placed = rows.repartitionByRange(n, "source", "ord").sortWithinPartitions("source", "ord")
    schema = rows.schema
    read = placed.mapInArrow(_readings, _with(schema, f"readings {READINGS}"))
    read = cut(read)  # both passes must see the same partitions
    borders = read.select("source", "readings").mapInPandas(
        _border, f"pid int, k int, source string, first {READINGS}, last {READINGS}, m array<array<double>>"
    ).collect()  # at most two runs of each partition
    fixed = _chain([r.asDict(recursive=True) for r in borders])
    return read.mapInPandas(_decoder(fixed), _with(schema, "utc_us bigint"))


def _with(schema, extra: str):
    from pyspark.sql.types import StructType

    return StructType([*schema.fields, *StructType.fromDDL(extra).fields])


def message_stamps(messages: DataFrame, profiles: DataFrame) -> DataFrame:
    """(tbl, row_key, source, ord, stamp, zone) of messages: zone is metadata.tz, else the sender's home zone.

    Broken or null metadata has no tz; senders are compared in lower case, trimmed.
    """
    homes = profiles.select(F.lower(F.trim("entity")).alias("who"), F.col("home_zone")).groupBy("who").agg(F.max("home_zone").alias("home_zone"))
    return (
        messages.select("id", "sender", "timestamp", "metadata")
        .dropDuplicates(["id"])
        .withColumn("who", F.lower(F.trim(F.coalesce("sender", F.lit("")))))
        .join(homes, "who", "left")
        .select(
            F.lit("messages").alias("tbl"), F.col("id").cast("string").alias("row_key"), F.col("who").alias("source"), F.col("id").cast("bigint").alias("ord"),
            F.col("timestamp").alias("stamp"), F.coalesce(F.nullif(F.get_json_object("metadata", "$.tz"), F.lit("")), "home_zone").alias("zone"),
        )
    )


def record_order(rows: DataFrame) -> Column:
    """The place of a row in its file, if it comes from one (files count by their names), else its place in the partitions."""
    try:
        rows.select("_metadata.row_index")
    except AnalysisException:
        return F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("row"))
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def transcript_stamps(lines: DataFrame, sessions: DataFrame) -> DataFrame:
    """The same of transcript lines with uuid; zone is the session's host zone. Lines carry no record number: they stand in the order of their file.

    ``ord`` holds the row's place in its file; of repeated lines the first place counts.
    """
    zones = sessions.select(F.col("session_id").alias("source"), "host_zone").groupBy("source").agg(F.max("host_zone").alias("zone"))
    once = (
        lines.where("uuid is not null and uuid <> ''").select("uuid", F.col("sessionId").alias("source"), F.col("timestamp").alias("stamp"), record_order(lines).alias("at"))
        .groupBy("uuid").agg(F.min(F.struct("at", "source", "stamp")).alias("r")).select("uuid", "r.at", "r.source", "r.stamp")
    )
    return once.join(zones, "source", "left").select(
        F.lit("transcript").alias("tbl"), F.col("uuid").alias("row_key"), F.concat_ws(" ", F.coalesce("source", F.lit("")), "at.file").alias("source"), F.col("at.row").alias("ord"), "stamp", "zone"
    )


def unusual_stamps(normalised: DataFrame) -> DataFrame:
    """(tbl, row_key, utc_us) of the rows that denote an instant and aren't plain UTC stamps already."""
    return normalised.where(
        F.col("utc_us").isNotNull() & ~F.col("stamp").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z\z")
    ).select("tbl", "row_key", "utc_us")
