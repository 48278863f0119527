"""Composed retrieval: follow-up hops, fallbacks, the whole ranking pipeline and its multi-round form.

Every stage is a DataFrame over a pool of at most a few hundred rows. Branches that depend on
data (diversity of senders, weak scores, sufficiency) read a handful of rows on the driver.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import intents, lexicon as L, query_analysis as qa
from palimpsest.functions.dates import time_window
from palimpsest.operators import consolidation as co, fusion, keyword_search as kw, profiles as pr, salience as sal, temporal as tm, vector_search as vs

# Words of a question that say nothing of its subject.
STOP_WORDS = set("what did does do how where when who which why is are was were has have had would could should will can the a an in on at to for of with about their they them his her its".split())
POOL, HOP_NAMES, HOP_NOUNS, HOP_ROWS, HOP_FACTOR = 200, 3, 5, 5, 0.7
COLUMNS = ("id", "content", "sender", "recipient", "ts", "category", "modality", "directive", "metadata")


def content_words(query: str) -> list[str]:
    return [w for w in kw.query_terms(query) if w not in STOP_WORDS]


def settled(pool: DataFrame, most: int = 8 * POOL) -> DataFrame:
    """A pool as local rows, so that later stages don't compute it again; every pool is bounded by its limits, far below ``most``."""
    rows = pool.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a pool has more than {most} rows")
    return pool.sparkSession.createDataFrame(rows, pool.schema)


def _rows(df: DataFrame, source: str) -> DataFrame:
    return df.select(*COLUMNS, "score", F.lit(source).alias("source"))


def _new(pool: DataFrame, more: DataFrame) -> DataFrame:
    """Pool and the rows of ``more`` whose id it lacks, each id once with its best score."""
    once = more.groupBy("id").agg(F.max_by(F.struct(*[c for c in more.columns if c != "id"]), "score").alias("r")).select("id", "r.*")
    return pool.unionByName(once.join(pool.select("id"), "id", "left_anti").select(*pool.columns))


def diverse(m: DataFrame, least: int = 5) -> bool:
    """Whether more than ``least`` distinct senders exist; the count stops there."""
    return m.where("sender <> ''").select("sender").distinct().limit(least + 1).count() > least


def hybrid(m: DataFrame, query: str, vectors: DataFrame | None = None, vector: list[float] | None = None, limit: int = 30, weights: tuple[float, float] = (1.0, 1.0), separation: DataFrame | None = None, score: kw.Score = kw.scan_search) -> DataFrame:
    """Pool of keyword and vector hits fused by reciprocal ranks; the separation list (weight 0.8) joins in for diverse senders only.

    ``vectors`` and ``separation`` have (id, vec). Without them it is keyword search alone.
    """
    words = kw.best(score(m, query, keep=~F.col("directive")).withColumn("bm25", F.round("bm25", 9)), POOL)
    lists = [("fts", fusion.ranked(words, "bm25", POOL), weights[0])]
    allowed = m.where("not directive").select("id")
    for name, table, w in (("vec", vectors, weights[1]), ("sep", separation if separation is not None and diverse(m) else None, 0.8 * weights[1])):
        if table is not None and vector is not None:
            near = vs.nearest(table.join(allowed, "id", "left_semi"), vector, POOL)
            lists.append((name, fusion.ranked(near, "cosine", POOL), w))
    fused = fusion.reciprocal_rank_fusion(lists).orderBy(F.desc("rrf_score"), F.col("id").cast("string")).limit(limit)
    return settled(m.join(F.broadcast(fused), "id").select(*COLUMNS, F.col("rrf_score").alias("score"), "source"))  # at most ``limit`` rows


def scent_trail(m: DataFrame, query: str, pool: DataFrame, score: kw.Score = kw.scan_search) -> DataFrame:
    """Pool plus messages by the people, and with the names, of its three best rows (names in sorted order, senders in any case)."""
    best = pool.orderBy(F.desc("score"), F.col("id").cast("string")).limit(3).select("content", "sender", "recipient").collect()
    if len(best) < 3:
        return pool
    people = sorted({p.lower() for r in best for p in (r["sender"], r["recipient"]) if p})[:HOP_NAMES]
    common = {"The", "This", "That", "What", "When", "Where", "How", "But", "And", "Just", "Not"}
    nouns = sorted({n.lower() for r in best for n in re.findall(L.PROPER_NOUN, r["content"]) if n not in common and len(n) > 2})[:HOP_NOUNS]
    out = pool
    for p in people:
        hop = kw.min_max(kw.best(score(m, query, keep=~F.col("directive") & (F.lower("sender") == p)), HOP_ROWS), "bm25", "score")
        out = _new(out, _rows(hop, "scent_trail"))
    if nouns:
        hop = kw.search(m, " ".join(nouns), HOP_ROWS, score=score).withColumn("score", F.col("score") * HOP_FACTOR)
        out = _new(out, _rows(hop, "scent_trail"))
    return settled(out)


def quality_fallback(m: DataFrame, query: str, pool: DataFrame, score: kw.Score = kw.scan_search) -> DataFrame:
    """If the five best scores are all below .04 and within .005, single-word searches at half their score join the pool."""
    top = [r["score"] for r in pool.orderBy(F.desc("score")).limit(5).select("score").collect()]
    if len(top) < 5 or max(top) >= 0.04 or max(top) - min(top) >= 0.005:
        return pool
    out = pool
    for w in [w for w in query.lower().split() if len(w) > 3][:3]:
        out = _new(out, _rows(kw.search(m, w, 10, score=score).withColumn("score", F.col("score") * 0.5), "fallback_broad"))
    return settled(out)


def named_in(m: DataFrame, query: str, most: int = 2) -> list[str]:
    """Senders and recipients that the query names, in lower case and sorted."""
    low = f" {' '.join(re.findall(r'[\w]+', query.lower()))} "
    names = m.select(F.explode(F.array(F.lower(F.trim("sender")), F.lower(F.trim("recipient")))).alias("e")).where("e <> '' and e <> 'self'").distinct()
    return [r["e"] for r in names.where(F.contains(F.lit(low), F.concat(F.lit(" "), F.col("e"), F.lit(" ")))).orderBy("e").limit(most).collect()]


def entity_focused(m: DataFrame, query: str, k: int, score: kw.Score = kw.scan_search) -> DataFrame:
    """Content words searched among the messages of the senders named (two at most), else among all."""
    words = " ".join(content_words(query)) or query
    names = named_in(m, query)
    if not names:
        return _rows(kw.search(m, words, k, score=score), "entity")
    hits = score(m, words, keep=~F.col("directive") & F.lower(F.trim("sender")).isin(names))
    return _rows(kw.min_max(kw.best(hits, k), "bm25", "score"), "entity")


def sufficient(pool: DataFrame) -> bool:
    """Whether the five best rows are at least three, above .02 on average, with three different beginnings."""
    top = pool.orderBy(F.desc("score"), F.col("id").cast("string")).limit(5).select("score", F.substring("content", 1, 100).alias("p")).collect()
    return len(top) >= 3 and sum(r["score"] for r in top) / len(top) > 0.02 and len({r["p"] for r in top}) >= 3


def in_window(pool: DataFrame, m: DataFrame, after: str | None, before: str | None, factor: float = 1.3) -> DataFrame:
    """Rows within the window weigh ``factor``; the window's other messages join without score."""
    inside = tm.timeline(m.where("not directive"), None, after, before)
    hit = inside.select("id").withColumn("__in", F.lit(True))
    out = pool.join(hit, "id", "left").withColumn("source", F.when(F.col("__in"), F.concat("source", F.lit("+temporal"))).otherwise(F.col("source")))
    out = out.withColumn("score", F.when(F.col("__in"), F.col("score") * factor).otherwise(F.col("score"))).select(*COLUMNS, "score", "source")
    fill = inside.join(pool.select("id"), "id", "left_anti").orderBy("ts", "id").limit(POOL).withColumn("score", F.lit(0.0))
    return settled(out.unionByName(_rows(fill, "temporal")))


def finish(pool: DataFrame, limit: int) -> DataFrame:
    """No directive, no id or content prefix twice, scores from 0, best first; ties by the id as text."""
    from pyspark.sql import Window

    order = [F.desc("score"), F.col("id").cast("string")]
    placed = pool.orderBy(*order).limit(4 * POOL).withColumn("pos", F.row_number().over(Window.orderBy(*order)))
    return fusion.first_by_id_and_prefix(placed).drop("pos").orderBy(*order).limit(limit)


def _best_score(pool: DataFrame, empty: float = 0.05) -> float:
    return pool.agg(F.max("score")).first()[0] or empty


def _supplement(pool: DataFrame, rows: DataFrame) -> DataFrame:
    """Pool and the rows whose id it lacks."""
    return settled(_new(pool, rows.select(*COLUMNS, "score", "source")))


def _as_row(text: str, **values) -> list:  # noqa: ANN003
    """Columns of a result row that stands for derived text."""
    blank = {c: F.lit("") for c in COLUMNS} | {"directive": F.lit(False), "metadata": F.lit("{}"), "content": F.col(text)} | values
    return [blank[c].alias(c) for c in COLUMNS]


def personality(m: DataFrame, query: str, limit: int = 5, score: kw.Score = kw.scan_search) -> DataFrame:
    """Rows (COLUMNS, score, source) on a person's character: messages with the aspect's words, then lines of the person's profile.

    A message scores 5 if it is from the person named, plus half its style's cosine to the question and half that to the
    person's style. Profile lines have score 1 and negative ids; they come first.
    """
    what = intents.aspect(query)
    low = query.lower()
    names = m.where("sender <> ''").select(F.lower("sender").alias("e")).distinct().where(F.contains(F.lit(low), F.col("e"))).orderBy("e").limit(1).collect()
    who = names[0]["e"] if names else None
    words = intents.aspect_words(what) or [w for w in content_words(query) if len(w) > 3]
    pool = settled(kw.best(score(m, " ".join(words), keep=~F.col("directive")), 3 * limit).select(*COLUMNS))
    if who is not None and pool.isEmpty():
        pool = settled(m.where(~F.col("directive") & (F.lower("sender") == who)).orderBy("ts", "id").limit(3 * limit).select(*COLUMNS))
    asked = {r["bucket"]: float(r["c"]) for r in pr.style_grams(m.sparkSession.createDataFrame([(0, query)], "id int, content string"), ["id"]).collect()}  # at most BUCKETS
    own = {}
    if who is not None:
        own = {r["bucket"]: r["value"] for r in pr.style_vectors(m.where(F.lower("sender") == who)).select("bucket", "value").collect()}  # at most BUCKETS
    grams: dict[int, dict[int, float]] = {}
    for r in pr.style_grams(pool, ["id"]).collect():  # a pool of at most 3 * limit rows
        grams.setdefault(r["id"], {})[r["bucket"]] = float(r["c"])

    def cosine(x: dict[int, float], y: dict[int, float]) -> float:
        n = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
        return sum(v * y.get(k, 0.0) for k, v in x.items()) / n if n else 0.0

    scored = m.sparkSession.createDataFrame([(i, 0.5 * cosine(asked, g) + 0.5 * cosine(own, g)) for i, g in grams.items()], "id bigint, style double")
    same = F.when(F.lower("sender") == who, 5.0).otherwise(0.0) if who is not None else F.lit(0.0)
    rows = pool.join(scored, "id").select(*COLUMNS, (same + F.col("style")).alias("score"), F.lit("style_vec").alias("source")).orderBy(F.desc("score"), F.col("id").cast("string")).limit(limit)
    lines = profile_lines(m, who, what) if who is not None else []
    if lines:
        told = m.sparkSession.createDataFrame([(-1 - i, x) for i, x in enumerate(lines)], "id bigint, line string")
        told = told.select(*_as_row("line", id=F.col("id"), sender=F.lit(who)), F.lit(1.0).alias("score"), F.lit("profile").alias("source"))
        rows = told.unionByName(rows)
    return rows.limit(limit + len(lines))


def profile_lines(m: DataFrame, who: str, what: str = "personality") -> list[str]:
    """Sentences on a person's style, traits, contacts and topics, as far as the aspect asks for them."""
    own, out = m.where(F.lower("sender") == who), []
    if what in ("personality", "communication"):
        p, f = pr.profiles(own).first(), pr.formality(own).first()
        if p:
            out.append(f"Communication style: {f['formality'] if f else 'unknown'}, avg message length: {p['avg_length']:.0f} chars, emoji: {'yes' if p['uses_emoji'] else 'no'}, typical greeting: '{pr.greeting(own)}'")
        if traits := [r["trait"] for r in pr.traits(own).orderBy(F.desc("hits"), "trait").collect()]:
            out.append(f"Traits: {', '.join(traits)}")
    if what in ("personality", "relationships"):
        top = pr.relationships(own).orderBy(F.desc("message_count"), "partner").limit(5).collect()
        if top:
            out.append("Top contacts: " + ", ".join(f"{r['partner']} ({r['message_count']} msgs, {r['primary_category'] or 'general'})" for r in top))
    if what == "personality" and (topics := [r["topic"] for r in pr.topics(own).orderBy(F.desc("hits"), "topic").limit(5).collect()]):
        out.append(f"Key topics: {', '.join(topics)}")
    return out


def _in_time(m: DataFrame, query: str, pool: DataFrame, w, limit: int, score: kw.Score) -> DataFrame:  # noqa: ANN001
    """The pool within a window, joined by keyword hits of the window where it is closed."""
    if w.after or w.before:
        pool = in_window(pool, m, w.after, w.before)
    if w.after and w.before:
        top = _best_score(pool)
        hits = kw.search_in_range(m, query, w.after, tm.exclusive_upper(w.before), limit, score)
        pool = _supplement(pool, _rows(hits.withColumn("score", F.lit(0.8 * top) * F.col("score")), "temporal_rescoped"))
    return pool


def _derived(pool: DataFrame, query: str, chain: DataFrame | None, summaries: DataFrame | None) -> DataFrame:
    """Current facts that the query touches, at 0.8 of the best score, and up to three consolidated rows by relevance."""
    words = [w for w in content_words(query) if len(w) > 2]
    if not words or (chain is None and summaries is None):
        return pool
    top = _best_score(pool)
    if chain is not None:
        hit = co.changed_fact_search(chain, words).where("current is not null").orderBy(F.desc("relevance"), "subject").limit(limit_facts := 10)
        last = chain.where("status = 'active'").groupBy("subject").agg(F.max_by("id", "seq").alias("id"), F.max_by("ts", "seq").alias("ts"))
        rows = hit.join(last, "subject").select(*_as_row("current", id=F.col("id"), ts=F.col("ts")), F.lit(0.8 * top).alias("score"), F.lit("contradiction").alias("source"))
        pool = _supplement(pool, rows.limit(limit_facts))
    low = lambda c: F.lower(c)
    n = lambda c: F.size(F.filter(F.array(*map(F.lit, words)), lambda x: F.contains(low(c), x)))
    parts = []
    if summaries is not None:
        parts.append(summaries.select(F.col("summary").alias("text"), (-1_000 - F.row_number().over(_all("month"))).cast("bigint").alias("id"), n(F.col("summary")).alias("relevance")))
    if chain is not None:
        parts.append(chain.select(F.concat_ws(": ", "subject", "fact").alias("text"), "id", (2 * n(F.concat_ws(" ", "subject", "fact"))).alias("relevance")))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    best = every.where("relevance > 0").orderBy(F.desc("relevance"), "id").limit(3).collect()
    if not best:
        return pool
    most = best[0]["relevance"]
    rows = pool.sparkSession.createDataFrame([(r["id"], r["text"], 0.8 * top * r["relevance"] / most) for r in best], "id bigint, text string, score double")
    return _supplement(pool, rows.select(*_as_row("text", id=F.col("id")), "score", F.lit("summary").alias("source")))


def _all(order: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.orderBy(order)  # over one row for each month


def guarded(pool: DataFrame, query: str, m: DataFrame, floor: float, rescue: tuple[int, ...] = ()) -> DataFrame:
    """Boost of the people named, saturation of senders, then the salience floor; changed facts stay if they have any salience."""
    names = named_in(m, query)
    if names:
        boosted = sal.sender_saturation(sal.entity_boost(pool, names))
        pool = boosted.select(*COLUMNS, F.col("final").alias("score"), F.concat("source", F.lit("+entity_boost")).alias("source"))
    told = F.arrays_overlap(F.split("source", r"\+"), F.array(F.lit("contradiction"))) & (sal.salience() > 0)
    keep = (sal.salience() >= floor) | told
    return pool.where(keep | F.col("id").isin(list(rescue)) if rescue else keep)


def _reranked(pool: DataFrame, query: str, rerank: Callable[[DataFrame, str], DataFrame], most: int) -> DataFrame:
    """Scores fused with a reranker's; stored facts and episodes weigh 0.7 where a detail is asked for and 1.2 where a synthesis is."""
    factor = {"detail": 0.7, "synthesis": 1.2}.get(qa.kind_of_answer(query), 1.0)
    top = rerank(pool.orderBy(F.desc("score"), F.col("id").cast("string")).limit(most), query)
    top = top.withColumn("rerank_score", F.when(F.col("modality").isin("episode", "fact"), F.col("rerank_score") * factor).otherwise(F.col("rerank_score")))
    return fusion.weighted_fusion(top, "rerank_score", "score").withColumn("score", F.col("fused_score")).select(*COLUMNS, "score", "source")


def pipeline(
    m: DataFrame, query: str, limit: int = 10, vectors: DataFrame | None = None, vector: list[float] | None = None, surprise: DataFrame | None = None, after: str | None = None, before: str | None = None,
    rerank: Callable[[DataFrame, str], DataFrame] | None = None, separation: DataFrame | None = None, chain: DataFrame | None = None, summaries: DataFrame | None = None, now: datetime.date | None = None,
    score: kw.Score = kw.scan_search, guard: bool = True,
) -> DataFrame:
    """Ranked memories for one query.

    Hybrid pool weighted by the query's type, follow-up hops for diverse senders, the time window that the query names (or
    ``after`` and ``before``), character, changed facts (``chain`` of ``consolidation.supersessions``) and ``summaries``,
    entity boost and salience floor, surprise boost, optional reranking, cleaning.
    """
    _, weights = qa.kind_and_weights(query)
    pool = hybrid(m, query, vectors, vector, 3 * limit, (weights["fts"], weights["vec"]), separation, score)
    if diverse(pool):
        pool = quality_fallback(m, query, scent_trail(m, query, pool, score), score)
    w = time_window(query, now or datetime.date.today())
    if after or before:
        w.after, w.before = after, before
    pool = _in_time(m, query, pool, w, limit, score)
    if intents.asks_for_character(query):
        top = _best_score(pool)
        rows = personality(m, query, 5, score)
        pool = _supplement(pool, rows.withColumn("score", F.lit(top) * F.when(F.col("source") == "profile", 0.8).otherwise(0.9)))
    pool = _derived(pool, query, chain, summaries)
    if guard:
        pool = guarded(pool, query, m, 0.02 if qa.is_diffuse(query) else 0.05)
        if surprise is not None:
            pool = sal.surprise_boost(pool, surprise).select(*COLUMNS, "score", "source")
        if rerank is not None:
            pool = _reranked(pool, query, rerank, 3 * limit)
    return finish(pool, limit)


def multi_round(
    m: DataFrame, query: str, limit: int = 10, vectors: DataFrame | None = None, vector: list[float] | None = None, surprise: DataFrame | None = None, llm: Callable[[str], str] | None = None,
    rerank: Callable[[DataFrame, str], DataFrame] | None = None, llm_rerank: Callable[[str], str] | None = None, embed: Callable[[str], list[float]] | None = None, centroids: DataFrame | None = None, members: DataFrame | None = None,
    now: datetime.date | None = None, score: kw.Score = kw.scan_search, **options,  # noqa: ANN003
) -> DataFrame:
    """The multi-round search.

    Pool without guard, hypothetical answers fused by ranks (``llm``, embedded by ``embed``), min-max, members of the nearest
    clusters (``centroids`` (cluster_id, vec), ``members`` (id, cluster_id)), entity search (overlap weighs 1.5, rows outside the
    query's window 0.1), salience with the entity rows rescued, refined queries if the best rows don't suffice, surprise,
    reranking, cleaning.
    """
    width = max(8 * limit, 100) if rerank is not None else max(3 * limit, 30)
    w = time_window(query, now or datetime.date.today())
    pool = settled(pipeline(m, query, width, vectors, vector, now=now, score=score, guard=False, **options))
    if llm is not None:
        pool = hypothetical(m, query, pool, llm, embed, vectors, vector, width, score)
    pool = fusion.normalised_or_half(pool, "score", "n").withColumn("score", F.col("n")).drop("n")
    if centroids is not None and members is not None and vectors is not None and vector is not None:
        pool = _supplement(pool, clustered(m, vectors, vector, centroids, members, limit))
    more = entity_focused(m, query, limit, score)
    inside = F.lit(True)
    if w.after:
        inside = inside & (F.col("ts") >= w.after)
    if w.before:
        inside = inside & (F.col("ts") < tm.exclusive_upper(w.before))
    more = settled(more.withColumn("score", F.when(inside, F.col("score")).otherwise(F.col("score") * 0.1)))
    both = pool.join(more.select("id", F.lit(True).alias("__e")), "id", "left").withColumn("score", F.when(F.col("__e") & inside, F.col("score") * 1.5).otherwise(F.col("score"))).drop("__e")
    rescue = tuple(r["id"] for r in more.select("id").collect())  # at most ``limit`` rows
    pool = settled(guarded(_new(both.select(*COLUMNS, "score", "source"), more), query, m, 0.02, rescue))
    if llm is not None and not sufficient(pool):
        for line in refined_queries(llm, query):
            again = hybrid(m, line, vectors, embed(line) if embed else vector, limit, score=score)
            hit = pool.join(again.select("id", F.lit(True).alias("__r")), "id", "left").withColumn("score", F.when(F.col("__r"), F.col("score") * 1.15).otherwise(F.col("score"))).drop("__r")
            pool = _supplement(hit.select(*COLUMNS, "score", "source"), again.withColumn("score", F.col("score") * 0.9).withColumn("source", F.concat("source", F.lit("+refined"))))
    if surprise is not None:
        pool = sal.surprise_boost(pool, surprise).select(*COLUMNS, "score", "source")
    if rerank is not None:
        pool = _reranked(pool, query, rerank, 5 * limit)
    if llm_rerank is not None:
        pool = reranked_by_model(pool, query, llm_rerank, 5 * limit)
    return finish(pool, limit)


def refined_queries(llm: Callable[[str], str], query: str, most: int = 3) -> list[str]:
    """Other ways to ask: the first lines of more than five characters of a model's answer."""
    return [x.strip() for x in llm(f"Other ways to ask: {query}").splitlines() if len(x.strip()) > 5][:most]


def hypothetical(
    m: DataFrame, query: str, pool: DataFrame, llm: Callable[[str], str], embed: Callable[[str], list[float]] | None, vectors: DataFrame | None, vector: list[float] | None, limit: int, score: kw.Score = kw.scan_search, answers: int = 1,
) -> DataFrame:
    """The pool fused by ranks with the hybrid pools of made-up answers to the query."""
    lists, every = [("query", fusion.ranked(pool, "score", limit), 1.0)], pool
    for k in range(answers):
        text = llm(f"Write a short passage that answers: {query}")
        if not text.strip():
            continue
        other = hybrid(m, text, vectors, embed(text) if embed else vector, limit, score=score)
        lists.append((f"answer{k}", fusion.ranked(other, "score", limit), 1.0))
        every = _new(every, other)
    fused = fusion.reciprocal_rank_fusion(lists).select("id", "rrf_score")
    return settled(every.join(fused, "id").withColumn("score", F.col("rrf_score")).select(*COLUMNS, "score", "source").orderBy(F.desc("score"), F.col("id").cast("string")).limit(limit))


def clustered(m: DataFrame, vectors: DataFrame, vector: list[float], centroids: DataFrame, members: DataFrame, k: int, nearest: int = 3) -> DataFrame:
    """Members of the ``nearest`` clusters (by their centroids' cosines), best first: (COLUMNS, score, source)."""
    near = [r["id"] for r in vs.nearest(centroids, vector, nearest, "cluster_id").collect()]
    own = members.where(F.col("cluster_id").isin(near)).select("id").distinct()
    hits = vs.nearest(vectors.join(own, "id", "left_semi"), vector, k)
    return m.where("not directive").join(F.broadcast(hits), "id").withColumn("score", vs.similarity_score(F.col("cosine"))).transform(lambda d: _rows(d, "cluster"))


def reranked_by_model(pool: DataFrame, query: str, llm: Callable[[str], str], most: int) -> DataFrame:
    """Order by a language model's marks, lines 'D<i>: <0 to 10>' for the numbered texts; texts without a mark have 0, ties keep the scores before."""
    rows = pool.orderBy(F.desc("score"), F.col("id").cast("string")).limit(most).collect()
    answer = llm(f"Mark each text from 0 to 10 by how well it answers: {query}\n" + "\n".join(f"D{i}: {r['content'][:500]}" for i, r in enumerate(rows, 1)))
    marks = {int(a): min(10.0, float(b)) for a, b in re.findall(r"D(\d+):\s*(\d+(?:\.\d+)?)", answer)}
    placed = sorted(enumerate(rows, 1), key=lambda x: (-marks.get(x[0], 0.0), -x[1]["score"], str(x[1]["id"])))
    out = [tuple(r[c] for c in COLUMNS) + (marks.get(i, 0.0) / 10 + r["score"] * 1e-6, r["source"]) for i, r in placed]
    return pool.sparkSession.createDataFrame(out, pool.select(*COLUMNS, "score", "source").schema)


def lexical_rerank(pool: DataFrame, query: str) -> DataFrame:
    """``rerank_score``: the share of the query's content words in a row; the default where no scoring model is given."""
    words = content_words(query) or [""]
    n = F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("content"), w)))
    return pool.withColumn("rerank_score", n / F.lit(float(len(words))))


def model_rerank(pool: DataFrame, query: str, score: Callable[[list[tuple[str, str]]], list[float]]) -> DataFrame:
    """``rerank_score`` from any scorer of (query, text) pairs, in Arrow batches."""
    from pyspark.sql.types import DoubleType

    @F.pandas_udf(DoubleType())
    def scored(text):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(score([(query, t) for t in text]))

    return pool.withColumn("rerank_score", scored("content"))
