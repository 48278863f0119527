"""Queries for problems 2 and 6: attribute history and timestamps."""

import os
import uuid

from pyspark.sql import functions as F

from palimpsest.operators.history import HistoryStore, build_chains, rebuild_affected, statements, versions_text
from palimpsest.operators.timestamps import message_stamps, normalise_timestamps, transcript_stamps, unusual_stamps
from palimpsest.plans.registry import Registry
from palimpsest.runtime import checkpoint_dir, store, table

registry = Registry()

NORM = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
HISTORY_SQL = f"""
with t as (
  select {NORM.format('entity_scope')} e, {NORM.format('subject')} s, strptime(valid_from, '%Y-%m-%dT%H:%M:%SZ') tm, {NORM.format('fact')} v, id
  from fact_timeline where fact is not null
), n as (
  select {NORM.format('entity_scope')} e, {NORM.format('subject')} s, strptime(as_of, '%Y-%m-%d') tm, {NORM.format('fact')} v, -1 id
  from fact_snapshots where fact is not null
), told as (
  select e, s, tm, arg_max(v, id) v from (select * from t union all select * from n)
  where e <> '' and s <> '' and tm is not null group by e, s, tm
), none as (
  select distinct c.e, c.s, d.tm from (select distinct e, s from told) c join (select distinct e, tm from n) d on c.e = d.e
  where not exists (select 1 from told x where x.e = c.e and x.s = c.s and x.tm = d.tm)
), every as (select e, s, tm, v from told union all select e, s, tm, null from none),
changed as (
  select *, lag(v) over w before, row_number() over w n from every window w as (partition by e, s order by tm)
), starts as (select e, s, tm, v from changed where v is distinct from before or (n = 1 and v is not null)),
versions as (select e, s, v, tm, lead(tm) over (partition by e, s order by tm) until_tm from starts)
select e entity_scope, s subject, strftime(tm, '%Y-%m-%dT%H:%M:%SZ') valid_from, coalesce(strftime(until_tm, '%Y-%m-%dT%H:%M:%SZ'), '') valid_to
from versions where v is not null
"""


def _statements(spark, folder):
    return statements(table(spark, folder, "fact_timeline"), table(spark, folder, "fact_snapshots"))


def _is_late():
    """Which statements come late: the snapshots since 2025 and every tenth fact."""
    return (F.col("seq") % 10 == 0) | ((F.col("origin") == "snapshot") & (F.col("at") >= 1_735_689_600))


@registry.add("p2_found", HISTORY_SQL)
def p2_found(spark, folder):
    """The history in a store: first load, then the late and corrected statements, which rebuild the chains of their entities."""
    store_ = HistoryStore(spark, os.path.join(checkpoint_dir(spark), f"history-{uuid.uuid4().hex}"))
    every = store(_statements(spark, folder).withColumn("late", _is_late()))
    store_.apply_updates(every.where("not late").drop("late"))
    store_.apply_updates(every.where("late").drop("late"))
    chains = store_.chains()
    if chains is None:
        chains = build_chains(every.drop("late"))
    out = store(versions_text(chains))
    store_.drop()
    return out


@registry.add("p2_late_update", HISTORY_SQL)
def p2_late_update(spark, folder):
    """The same history without a store: built without the late statements, then brought up to date."""
    every = _statements(spark, folder)
    before = build_chains(every.where(~_is_late()))
    return versions_text(rebuild_affected(before, every, every.where(_is_late())))


def _stamps(spark, folder):
    return message_stamps(table(spark, folder, "messages"), table(spark, folder, "entity_profiles")).unionByName(
        transcript_stamps(table(spark, folder, "sample_real_claude_code_transcript"), table(spark, folder, "session_files"))
    )


@registry.add("p6_found")
def p6_found(spark, folder):
    return unusual_stamps(normalise_timestamps(_stamps(spark, folder)))
