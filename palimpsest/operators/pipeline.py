"""From transcripts to stored memories: facts, the encoding gate, resolution against what is stored, writing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import encoding, ingest as ing
from palimpsest.operators.nearest_texts import nearest_texts
from palimpsest.runtime import store

NEIGHBOURS = 10


def neighbours(facts: DataFrame, docs: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(fid, id, content, rank): the k stored texts (id, content) with most weight of words in common with each fact (fid, fact).

    Rare words weigh more; ties by id as text. How they are found, see ``nearest_texts``.
    """
    return nearest_texts(facts, docs, k).join(docs.select("id", "content"), "id").select("fid", "id", "content", "rank")


def user_facts(turns: DataFrame) -> DataFrame:
    """(fid, doc, fact, category, confidence): pattern facts of the user's turns (doc, pos, role, text), each fact of a transcript once."""
    said = turns.where("role = 'human'").select(F.concat_ws("-", "doc", "pos").alias("id"), "doc", "pos", F.col("text").alias("content"))
    found = ing.pattern_facts(said.select("id", "content")).join(said.select("id", "doc", "pos"), "id")
    w = Window.partitionBy("doc", F.lower("fact")).orderBy("pos", "category")
    once = found.withColumn("r", F.row_number().over(w)).where("r = 1")
    return once.select(F.xxhash64("doc", F.lower("fact")).alias("fid"), "doc", "fact", "category", "confidence")


def judged(facts: DataFrame, docs: DataFrame, error=None) -> DataFrame:  # noqa: ANN001
    """Facts (fid, fact, category, ...) with novelty, salience, error, score, encode, and against their nearest stored text: existing_id, existing, similarity, action.

    ``docs`` has (id, content). Novelty is by compression against the NEIGHBOURS nearest texts, similarity the share of words in common
    with the nearest. ``error`` is what ``ingest.prediction_error`` gives for an embedder; without one the gate passes no
    judgement by error (0). Facts of one batch don't see each other, except that equal texts are resolved before.
    """
    near = neighbours(facts.select("fid", "fact"), docs)
    context = near.groupBy("fid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), " ").alias("memory"),  # NEIGHBOURS texts
        F.min_by("id", "rank").alias("existing_id"), F.min_by("content", "rank").alias("existing"),
    )
    rows = facts.join(context, "fid", "left").withColumn("content", F.col("fact"))
    rows = rows.withColumn("novelty", ing.compression_novelty("fact", F.coalesce("memory", F.lit("")))).withColumn("salience", encoding.encoding_salience("fact"))
    rows = rows.withColumn("error", error("fact", F.coalesce("existing", F.lit(""))) if error is not None else F.lit(0.0))
    rows = rows.withColumn("similarity", F.when(F.col("existing").isNotNull(), ing.jaccard(F.col("fact"), F.col("existing"))).otherwise(0.0))
    return ing.resolve_duplicate(ing.gate(rows)).drop("memory", "content")


class IngestionPipeline:
    """Transcripts into a ``Memory``: each fact is judged, and what passes is added, replaces what it corrects, or is skipped."""

    def __init__(self, memory, llm: Callable[[str], str] | None = None, embed: Callable | None = None):  # noqa: ANN001
        self.memory, self.llm = memory, llm
        self.error = ing.prediction_error(embed) if embed is not None else None

    def run(self, files: DataFrame, sender: str = "", timestamp: str = "", trace: str | None = None) -> dict[str, int]:
        """Ingest transcripts (doc, text); gives the counters. ``trace`` is a folder for the decisions on each fact, as JSON."""
        turns = ing.transcript_turns(files)
        if self.llm is None:
            facts = user_facts(turns)
        else:
            texts = ing.formatted(turns.withColumnRenamed("doc", "key"), "key", "pos").select(F.col("key").alias("doc"), F.col("transcript").alias("text"))
            facts = ing.model_facts(texts, self.llm).select(F.xxhash64("doc", F.lower("fact")).alias("fid"), "doc", "fact", "category", "confidence")
        facts = ing.first_facts(facts.select("fact", "fid", "doc", "category", "confidence"), "doc", "fid")
        rows = store(judged(facts, self.memory.messages().select("id", "content")))
        if trace is not None:
            rows.write.mode("overwrite").json(trace)
        kept = rows.where("encode and action <> 'SKIP'").withColumn("content", F.concat(F.lit("["), ing.category(F.col("category")), F.lit("] "), F.col("fact")))
        first = (self.memory.messages().agg(F.max("id")).first()[0] or 0) + 1
        new = kept.where("action = 'ADD'").withColumn("id", F.lit(first) + F.row_number().over(Window.orderBy("doc", "fid")) - 1)  # one transcript batch's facts
        told = kept.where("action = 'UPDATE'").groupBy(F.col("existing_id").alias("id")).agg(F.max_by("content", "fid").alias("content"))
        both = new.select("id", "content").unionByName(told.select("id", "content"))
        both = store(both.select("id", "content", F.lit(sender).alias("sender"), F.lit(timestamp).alias("timestamp"), F.lit("fact").alias("modality")))
        if not both.isEmpty():
            self.memory.add_all(both)
        count = {r["k"]: r["n"] for r in rows.groupBy(F.when(~F.col("encode"), "BLOCKED").otherwise(F.col("action")).alias("k")).agg(F.count("*").alias("n")).collect()}
        return {"facts": sum(count.values()), "blocked": count.get("BLOCKED", 0), "added": count.get("ADD", 0), "updated": count.get("UPDATE", 0), "skipped": count.get("SKIP", 0)}
