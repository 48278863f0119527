"""Fusion of ranked lists and the algebra of scores. Inputs are bounded pools, so windows without partition are small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def ranked(df: DataFrame, score: str, limit: int = 200) -> DataFrame:
    """(id, rank) of the best ``limit`` rows; the top-k comes before the window."""
    top = df.orderBy(F.desc(score), F.col("id").cast("string")).limit(limit)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc(score), F.col("id").cast("string"))).alias("rank"))


def reciprocal_rank_fusion(lists: list[tuple[str, DataFrame, float]]) -> DataFrame:
    """(id, rrf_score, source) from ranked lists (name, DataFrame(id, rank), weight); null ids are skipped."""
    every = None
    for order, (name, df, weight) in enumerate(lists):
        one = df.where("id is not null").select("id", (F.lit(weight) / (RRF_K + F.col("rank"))).alias("part"), F.lit(order).alias("order"), F.lit(name).alias("name"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("id").agg(
        F.round(F.sum("part"), 8).alias("rrf_score"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("order", "name"))), lambda s: s["name"]), "+").alias("source"),
    )


def normalised_or_half(df: DataFrame, score: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Min-max in [0, 1]; a single row or equal scores get 0.5."""
    from palimpsest.operators.keyword_search import min_max

    return min_max(df, score, out, by, 0.5)


def weighted_fusion(df: DataFrame, rerank: str, original: str, w_rerank: float = 0.6, w_original: float = 0.4) -> DataFrame:
    both = normalised_or_half(normalised_or_half(df, rerank, "__r"), original, "__o")
    return both.withColumn("fused_score", w_rerank * F.col("__r") + w_original * F.col("__o")).drop("__r", "__o")


def first_by_id_and_prefix(df: DataFrame, position: str = "pos", prefix: int = 200) -> DataFrame:
    """A pool without directives and repetitions: the first row of each id, then the first of each content prefix; negative scores become 0."""
    kept = df.where(~F.col("directive"))
    by_id = Window.partitionBy("id").orderBy(position)
    by_text = Window.partitionBy(F.substring("content", 1, prefix)).orderBy(position)
    once = kept.withColumn("__i", F.row_number().over(by_id)).where("__i = 1")
    once = once.withColumn("__c", F.row_number().over(by_text)).where("__c = 1").drop("__i", "__c")
    return once.withColumn("score", F.greatest("score", F.lit(0.0)))


def diversity_cap(df: DataFrame, per_session: int, limit: int) -> DataFrame:
    """At most ``per_session`` rows of a category first, the others behind them, ``limit`` in all."""
    order = [F.desc("score"), F.col("id").cast("string")]
    over = (F.row_number().over(Window.partitionBy("category").orderBy(*order)) > per_session).cast("int")
    return df.withColumn("overflow", over).orderBy("overflow", *order).limit(limit)


def quota_merge(df: DataFrame, per_query: int) -> DataFrame:
    """Rows (qid, id, score) of several queries: the best ``per_query`` of each, each id under its first query only."""
    order = [F.desc("score"), F.col("id").cast("string")]
    best = df.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("r") <= per_query)
    return best.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("qid"))).where("k = 1").drop("r", "k")


def within_budget(df: DataFrame, budget: int, text: str = "content") -> DataFrame:
    """The best rows of a pool whose running length stays within ``budget`` characters."""
    order = [F.desc("score"), F.col("id").cast("string")]
    run = F.sum(F.length(text)).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("upto", run).where(F.col("upto") <= budget)
