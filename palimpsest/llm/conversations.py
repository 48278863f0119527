"""Conversations rebuilt from single message lines.

A session's lines form a chain by parent links. Lines are partitioned by session, put in
chain order and read by a finite-state automaton. A session of more than ``HOT_LINES`` lines
never enters one task: its order comes from pointer doubling over (session, line) keys. The
automaton (``STEPS``) runs in two levels for every session alike: each block of ``BLOCK`` lines
is reduced to the function from the state before it to the state behind it, and the blocks'
functions are applied one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.runtime import cut

HOT_LINES, BLOCK, SALTS = 20_000, 5_000, 16
#: States: nothing said yet, a user waits, answered, broken. For each turn, the state that follows each state.
EMPTY, WAITING, ANSWERED, BROKEN = range(4)
STEPS = {"user": [WAITING, BROKEN, WAITING, BROKEN], "assistant": [ANSWERED, ANSWERED, ANSWERED, BROKEN]}
_KIND = "session string, uuid string, seq int, kind string, has_text boolean"


def has_text(content: str) -> Column:
    """Whether content holds non-blank text: plain, or a text block of a JSON array.

    Null and blank content and arrays without a text block hold none. Text that merely
    starts with a bracket and is no JSON array of objects is plain text.
    """
    c = F.col(content)
    blocks = F.from_json(c, "array<struct<type:string,text:string>>")
    in_blocks = F.exists(blocks, lambda b: (b["type"] == "text") & F.coalesce(b["text"].rlike(r"(?U)\S"), F.lit(False)))
    return F.coalesce(F.when(c.rlike(r"^\s*\[") & blocks.isNotNull(), in_blocks).otherwise(c.rlike(r"(?U)\S")), F.lit(False))


def chain_lines(lines: DataFrame) -> DataFrame:
    """(session, uuid, parent, kind, has_text): lines with uuid and session that aren't side chains, once each; parent '' for a first line."""
    return (
        lines.where("uuid is not null and uuid <> '' and sessionId is not null and not coalesce(isSidechain, false)")
        .select(
            F.col("sessionId").alias("session"), "uuid", F.coalesce("parentUuid", F.lit("")).alias("parent"),
            F.lower(F.trim("type")).alias("kind"), has_text("message.content").alias("has_text"),
        )
        .dropDuplicates(["session", "uuid"])
    )


def single_chains(chain: DataFrame) -> DataFrame:
    """(session, n) of the sessions with one first line, every parent present and no line with two children (loops are still possible)."""
    children = chain.where("parent <> ''").groupBy("session", F.col("parent").alias("uuid")).agg(F.count("*").alias("children"))
    linked = chain.join(children, ["session", "uuid"], "left")
    return (
        linked.groupBy("session")
        .agg(
            F.count("*").alias("n"), F.count_if(F.col("parent") == "").alias("roots"),
            F.coalesce(F.sum("children"), F.lit(0)).alias("found"), F.coalesce(F.max("children"), F.lit(0)).alias("most"),
        )
        .where("roots = 1 and found = n - 1 and most <= 1")
        .select("session", "n")
    )


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chain order of whole sessions, which arrive sorted by session; those with a loop give no rows."""

    def session(rows: list) -> list:
        after = {r[2]: r for r in rows}
        out, at = [], ""
        while at in after and len(out) <= len(rows):
            r = after[at]
            out.append((r[0], r[1], len(out), r[3], r[4]))
            at = r[1]
        return out if len(out) == len(rows) else []

    held: list = []
    for f in frames:
        out: list = []
        for r in f[["session", "uuid", "parent", "kind", "has_text"]].itertuples(index=False, name=None):
            if held and held[0][0] != r[0]:
                out += session(held)
                held = []
            held.append(r)
        yield pd.DataFrame(out, columns=["session", "uuid", "seq", "kind", "has_text"])
    yield pd.DataFrame(session(held) if held else [], columns=["session", "uuid", "seq", "kind", "has_text"])


def _double(lines: DataFrame) -> DataFrame:
    """The same for hot sessions by pointer doubling: a line's distance to the first line, in log2(n) joins on (session, uuid)."""
    state = cut(lines.select("session", "uuid", F.col("parent").alias("up"), F.when(F.col("parent") == "", 0).otherwise(1).alias("d")))
    for _ in range(40):
        if state.where("up <> ''").isEmpty():
            break
        far = state.select("session", F.col("uuid").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        before = state.where("up <> ''").count()
        state = cut(
            state.join(far, ["session", "up"], "left").select(
                "session", "uuid", F.coalesce("up2", F.lit("")).alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d")
            )
        )
        if state.where("up <> ''").count() == before:  # what remains are loops, all of them
            break
    looped = state.where("up <> ''").select("session").distinct()
    return (
        state.join(looped, "session", "left_anti").join(lines, ["session", "uuid"])
        .select("session", "uuid", F.col("d").cast("int").alias("seq"), "kind", "has_text")
    )


def ordered_lines(chain: DataFrame) -> DataFrame:
    """(session, uuid, seq, kind, has_text) of every session whose chain is a single line. The sessions' sizes meet their lines by salted keys."""
    salt = F.pmod(F.xxhash64("uuid"), F.lit(SALTS)).cast("int")
    sizes = single_chains(chain).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lines = cut(chain.withColumn("salt", salt).join(sizes, ["session", "salt"]).drop("salt"))
    small = lines.where(F.col("n") <= HOT_LINES).drop("n").repartition("session").sortWithinPartitions("session").mapInPandas(_walk, _KIND)
    hot = lines.where(F.col("n") > HOT_LINES).drop("n")
    return small if hot.isEmpty() else small.unionByName(_double(hot))


def automaton(kinds: Column) -> Column:
    """The function of a block of turns, as the array of states behind it for each state before it."""
    step = lambda f, k: F.transform(f, lambda s: F.get(F.when(k == "user", F.array(*map(F.lit, STEPS["user"]))).otherwise(F.array(*map(F.lit, STEPS["assistant"]))), s))
    return F.aggregate(kinds, F.array(*map(F.lit, range(4))), step)


def conversations(lines: DataFrame) -> DataFrame:
    """The turns of all sound sessions: (session_id, turn_no, uuid, role).

    ``lines`` has (type, uuid, parentUuid, sessionId, isSidechain, message.content); other columns
    are ignored and repeated lines count once. A session is dropped if its chain is broken, it has
    no turn, or the turn after some user turn isn't an assistant turn. An empty input gives no rows.
    """
    turns = ordered_lines(chain_lines(lines)).where("kind in ('user', 'assistant') and has_text").withColumn("block", F.floor(F.col("seq") / BLOCK))
    turns = turns.withColumn("rn", F.row_number().over(Window.partitionBy("session", "block").orderBy("seq")))
    blocks = turns.groupBy("session", "block").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind"))), lambda x: x["kind"]).alias("kinds"))  # at most BLOCK
    blocks = blocks.select("session", "block", "n", automaton(F.col("kinds")).alias("f"))
    blocks = blocks.withColumn("base", F.sum("n").over(Window.partitionBy("session").orderBy("block")) - F.col("n"))
    whole = blocks.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("block", "f"))).alias("fs"))  # one entry for BLOCK lines
    sound = whole.where(F.aggregate("fs", F.lit(EMPTY), lambda s, b: F.get(b["f"], s)) == ANSWERED).select("session")
    sound = blocks.join(sound, "session")
    return turns.join(sound.select("session", "block", "base"), ["session", "block"]).select(
        F.col("session").alias("session_id"), (F.col("base") + F.col("rn")).cast("int").alias("turn_no"), "uuid", F.col("kind").alias("role")
    )
