"""Analysis of query texts as column expressions, so that a table of queries is analysed in one pass."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import lexicon as L

WEIGHTS = ("fts", "vec", "temporal", "personality", "consolidation")


def _matches(text: Column, patterns: list[str]) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + text.rlike(p).cast("int")
    return out


def classify(df: DataFrame, query: str = "query") -> DataFrame:
    """Add query_type, confidence and the weights w_fts ... w_consolidation: the type with most matching patterns, the first on ties."""
    low = F.lower(query)
    hits = {t: _matches(low, ps) for t, (ps, _) in L.QUERY_TYPES.items()}
    best = F.greatest(*hits.values())
    kind = F.when(best == 0, "general")
    for t, h in hits.items():
        kind = kind.when(h == best, t)
    out = df.withColumn("query_type", kind).withColumn("confidence", F.when(best == 0, 0.5).otherwise(F.least(F.lit(1.0), best * 0.4 + 0.3)))
    for i, w in enumerate(WEIGHTS):
        c = F.lit(1.0)
        for t, (_, ws) in L.QUERY_TYPES.items():
            c = F.when(F.col("query_type") == t, ws[i]).otherwise(c)
        out = out.withColumn(f"w_{w}", c)
    return out


def kind_and_weights(query: str) -> tuple[str, dict[str, float]]:
    """The type of one question and the weights that its type gives the searches."""
    low = query.lower()
    hits = {t: sum(bool(re.search(p, low)) for p in ps) for t, (ps, _) in L.QUERY_TYPES.items()}
    best = max(hits.values())
    kind = next(t for t, n in hits.items() if n == best) if best else "general"
    return kind, dict(zip(WEIGHTS, L.QUERY_TYPES[kind][1] if best else (1.0,) * len(WEIGHTS)))


def is_diffuse(query: str) -> bool:
    return any(re.search(p, query.lower()) for p in L.DIFFUSE)


def kind_of_answer(query: str) -> str:
    """detail, synthesis or general, for one question."""
    low = query.lower().strip()
    return "detail" if any(re.search(p, low) for p in L.DETAIL) else "synthesis" if any(re.search(p, low) for p in L.SYNTHESIS) else "general"


def search_mode(query: Column) -> Column:
    return F.when(_matches(F.lower(query), L.DIFFUSE) > 0, "diffuse").otherwise("spotlight")


def question_type(query: Column) -> Column:
    q = F.trim(F.lower(query))
    return F.when(_matches(q, L.DETAIL) > 0, "detail").when(_matches(q, L.SYNTHESIS) > 0, "synthesis").otherwise("general")


def named_entities(queries: DataFrame, entities: DataFrame, most_words: int = 8) -> DataFrame:
    """(qid, entity): known entities whose words stand in the query as a whole.

    By equi-join on runs of up to ``most_words`` words; the few entities of more words meet the queries that hold their first word.
    """
    words = F.regexp_extract_all(F.lower("query"), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))
    w = queries.select("qid", words.alias("w"))

    def of(n: int) -> Column:
        at = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))
        return F.when(F.size("w") >= n, at).otherwise(F.array().cast("array<string>"))

    runs = [of(n) for n in range(1, most_words + 1)]
    short = w.select("qid", F.explode(F.array_distinct(F.concat(*runs))).alias("entity")).join(entities.select("entity"), "entity").select("qid", "entity")
    long = entities.select("entity", F.split("entity", " ").alias("e")).where(F.size("e") > most_words).select("entity", F.col("e")[0].alias("first"))
    met = w.select("qid", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("t"), F.explode(F.array_distinct("w")).alias("first")).join(long, "first")
    return short.unionByName(met.where(F.contains("t", F.concat(F.lit(" "), F.col("entity"), F.lit(" ")))).select("qid", "entity"))
