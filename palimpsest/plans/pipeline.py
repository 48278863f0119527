"""Queries of preferences, greetings, prompts, encoding salience, transcripts and the composed search, with their checking SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from palimpsest.functions import intents, prompts as pm
from palimpsest.operators import consolidation as co, encoding as en, ingest as ing, keyword_search as kw, pipeline as pl, profiles as pr, salience as sal, search, temporal as tm
from palimpsest.plans.insight import BASE, FEATS, PLAIN, SALIENCE, count, hits, inlist, q
from palimpsest.plans.memory import BM25, MSG, WHO, with_msg
from palimpsest.plans.registry import Registry
from palimpsest.runtime import checkpoint_dir, table
from palimpsest.sources.messages import load_messages
from palimpsest.streaming import streams as st

registry = Registry()
add = registry.add

BUCKET_SQL = " union all ".join(
    f"select entity, id, ts, '{b}' bucket, substr(content, 1, 300) \"text\", list_filter({list(ws.split('|'))!r}, lambda w: contains(lower(content), w))[1:5] keywords from msg_own".replace('"can\'t sleep"', "'can''t sleep'") for b, ws in pr.PREFERENCES.items()
)


@add("preferences", f"""with {MSG}, msg_own as (select lower(sender) entity, id, ts, content from msg where not directive and sender <> ''), x as ({BUCKET_SQL}), y as (select *, row_number() over (partition by entity, bucket, substr("text", 1, 80) order by ts, id) r from x where len(keywords) > 0)
select entity, bucket, "text", array_to_string(keywords, ',') keywords, ts first_ts from y where r = 1""")
def preferences(spark, d):
    p = pr.preferences(load_messages(spark, d))
    return p.withColumn("keywords", F.array_join("keywords", ","))


@add("preferred_people", with_msg("select lower(sender) entity, recipient person, count(*) message_count from msg where not directive and sender <> '' and recipient <> '' group by 1, 2"))
def preferred_people(spark, d):
    return pr.preferred_people(load_messages(spark, d))


@add("greetings", with_msg("""select entity, arg_min(greeting, (-n, greeting)) greeting, max(n) n from (select entity, greeting, count(*) n from (select lower(sender) entity, regexp_split_to_array(trim(lower(content)), '\\s+') w,
case when array_to_string(w[1:2], ' ') in ('what''s up', 'good morning') then array_to_string(w[1:2], ' ') when w[1] in ('hey', 'hi', 'hello', 'yo', 'sup', 'morning', 'heyy', 'heyyy') then w[1] else '' end greeting from msg where sender <> '')
where greeting <> '' group by 1, 2) group by 1"""))
def greetings(spark, d):
    return pr.greetings(load_messages(spark, d))


CHARACTER = ["What kind of person is Ann?", "what food does Bob like to eat for dinner", "When is the demo?", "How does Cy communicate by text", "what are Ann's fears", "who is nervous about stress and worry", "the talk about music", ""]


@add("character_intent", """select * from (values (0, true, 'personality'), (1, true, 'food'), (2, false, 'personality'), (3, true, 'communication'), (4, true, 'fears'), (5, true, 'fears'), (6, false, 'communication'), (7, false, 'personality')) t(qid, asks, aspect)""")
def character_intent(spark, d):
    return spark.createDataFrame([(i, intents.asks_for_character(x), intents.aspect(x)) for i, x in enumerate(CHARACTER)], "qid int, asks boolean, aspect string")


@add("prompts_to_recall", with_msg(f"select id from msg where regexp_matches(content, '{q(pm.RECALL)}') and not regexp_matches(content, '{q(pm.CODE)}')"))
def prompts_to_recall(spark, d):
    return load_messages(spark, d).where(pm.asks_to_recall(F.col("content"))).select("id")


@add("prompts_to_store", with_msg(f"""select id from (select id, content, regexp_replace(content, '{q(pm.QUOTED)}', ' ', 'g') bare from msg) where length(content) between 15 and 2000 and not regexp_matches(content, '{q(pm.CODE)}')
and not regexp_matches(bare, '\\?\\s*$') and not regexp_matches(ltrim(bare), '{q(pm.ASKS)}') and regexp_matches(bare, '{q(pm.STORABLE)}')"""))
def prompts_to_store(spark, d):
    return load_messages(spark, d).where(pm.worth_storing(F.col("content"))).select("id")


def _prompts(m):
    return m.where("category <> ''").select(F.col("category").alias("session_id"), F.col("id").alias("ts"), F.col("content").alias("prompt"))


@add("conversation_depth", f"""with {MSG}, p as (select category s, id, list_distinct(list_filter(regexp_extract_all({PLAIN.format('lower(content)')}, '[0-9a-z_]+'), lambda x: length(x) >= 4)) w, row_number() over (partition by category order by id) n from msg where category <> ''),
b as (select a.s, a.id, count(distinct x.t) c from p a join (select s, n, unnest(w) t from p) x on x.s = a.s and x.n < a.n and x.n >= a.n - 5 and list_contains(a.w, x.t) group by 1, 2) select s session_id, id from b where c >= 3""")
def conversation_depth(spark, d):
    return st.deep(_prompts(load_messages(spark, d))).where("deep").select("session_id", F.col("ts").alias("id"))


@add("recall_cadence", f"with {MSG}, p as (select category s, id, content, row_number() over (partition by category order by id) n from msg where category <> '') select s session_id, id from p where n % 5 = 0 or (regexp_matches(content, '{q(pm.RECALL)}') and not regexp_matches(content, '{q(pm.CODE)}'))")
def recall_cadence(spark, d):
    return st.recall_due(_prompts(load_messages(spark, d)), "enhanced").where("due").select("session_id", F.col("ts").alias("id"))


SPEECH = f"""case when low in {inlist(en.NOISE)} then .02 when ends_with(t, '?') or {' or '.join(f"starts_with(low, '{p}')" for p in en.ASKING)} then .2 when regexp_matches(low, '{q(en.COMMITMENT)}') then .8
when {hits('low', en.ANNOUNCEMENTS)} > 0 then .7 when regexp_matches(low, '\\b(?:no longer|not anymore|instead|correction)\\b') or {hits('low', en.UPDATE_VERBS)} > 0 or (contains(low, 'actually') and regexp_matches(low, '\\bnot\\b')) then .6
when regexp_matches(low, '^(?:hey|hi|hello|yo|sup|what''s up|howdy)') then .05 when regexp_matches(low, '^(?:haha|lol|lmao|omg|wow|damn|ugh|yikes)') then .08 when {count('content', '[a-zA-Z]+')} >= 5 then .5 else .25 end"""
CHAT = SALIENCE.replace("(lower(modality) in", "(false and lower(modality) in")


@add("encoding_salience", f"{CHAT}, e as (select id, content, trim(content) t, lower(trim(content)) low from msg) select id, round(case when t = '' then 0 when length(t) <= 50 then {SPEECH} else s end, 6) salience from e join sal using (id)")
def encoding_salience(spark, d):
    return load_messages(spark, d).select("id", F.round(en.encoding_salience(), 6).alias("salience"))


LOGIT_A = " + ".join(f"({w!r}) * {f}" for f, w in zip(sal.FEATURES, en.WEIGHTS_A))


@add("encoding_reweighted", f"with {MSG}, {BASE}, {FEATS} select id, round(case when t = '' then 0 else 1 / (1 + exp(-({en.BIAS_A} + {LOGIT_A}))) end, 6) salience from feats".replace("(lower(modality) in", "(false and lower(modality) in"))
def encoding_reweighted(spark, d):
    return load_messages(spark, d).select("id", F.round(en.reweighted_salience(), 6).alias("salience"))


@add("encoding_rules")
def encoding_rules(spark, d):
    """The rule-based and the modelled salience of messages as facts without a category."""
    m = load_messages(spark, d)
    return m.select("id", F.round(en.rule_salience(category=None), 6).alias("rules"), F.round(en.modelled_salience(category=None), 6).alias("model"), F.round(en.boosted_salience(), 6).alias("boosted"))


@add("judged_facts")
def judged_facts(spark, d):
    """Every thirtieth message as a fact, judged against the others: gate and resolution with real neighbours."""
    m = load_messages(spark, d)
    facts = m.where("id % 30 = 0 and trim(content) <> ''").select(F.col("id").alias("fid"), F.col("content").alias("fact"), F.when(F.lower("content").contains("actually"), "correction").otherwise("general").alias("category"))
    return pl.judged(facts, m.where("id % 30 <> 0").select("id", "content")).select("fid", "existing_id", F.round("novelty", 4).alias("novelty"), F.round("salience", 6).alias("salience"), F.round("score", 4).alias("score"), "encode", "action")


@add("gate_batch_summary", f"""{CHAT}, e as (select id, content, trim(content) t, lower(trim(content)) low from msg), g as (select id, content, case when t = '' then 0 when length(t) <= 50 then {SPEECH} else s end sl from e join sal using (id)),
h as (select id, content, sl, greatest(0, least(1, (.25 * 1.0 + .2 * sl) / .75)) score from g), k as (select *, (sl >= .1 and score >= .3) or regexp_matches(content, '{q('(?i)' + '|'.join([*(f'{chr(92)}b{m}{chr(92)}b' if m[-1].isalnum() else f'{chr(92)}b{m}' for m in ing.UPDATE_MARKERS), *ing.UPDATE_PATTERNS]))}') encode from h)
select count(*) evaluated, count(*) filter (where encode) passed, count(*) filter (where not encode) blocked, round(min(score), 6) score_min, round(max(score), 6) score_max, round(avg(score), 6) score_mean from k""")
def gate_batch_summary(spark, d):
    """The gate over all messages as facts of an empty memory (novelty 1, no error)."""
    m = load_messages(spark, d).select("content", F.lit("general").alias("category"), F.lit(1.0).alias("novelty"), en.encoding_salience().alias("salience"), F.lit(0.0).alias("error"))
    s = ing.gate_summary(ing.gate(m))
    return s.select("evaluated", "passed", "blocked", *(F.round(c, 6).alias(c) for c in ("score_min", "score_max", "score_mean")))


@add("fact_categories", f"select id, case when lower(trim(coalesce(category, ''))) in {inlist(ing.CATEGORIES)} then lower(trim(category)) else 'general' end category from (select distinct id, entity_scope category from fact_timeline)")
def fact_categories(spark, d):
    return table(spark, d, "fact_timeline").select("id", ing.category(F.coalesce("entity_scope", F.lit(""))).alias("category")).distinct()


@add("first_facts", "select fact, id from (select fact, id, row_number() over (partition by lower(trim(fact)) order by id) r from (select distinct id, fact from fact_timeline where fact is not null)) where r = 1")
def first_facts(spark, d):
    return ing.first_facts(table(spark, d, "fact_timeline").where("fact is not null").select("fact", "id").distinct(), "id")


@add("parsed_transcripts", """with l as (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(0, len(string_split(text, chr(10))))) pos from documents where source in ('transcript', 'benchmark_chat') and text is not null and ltrim(text)[1] not in ('[', '{')),
m as (select *, lower(regexp_extract(line, '(?i)^(human|user|assistant|system|claude)\\s*:\\s*', 1)) mk from l), t as (select *, sum((mk <> '')::int) over (partition by doc_id order by pos)::int turn from m)
select doc_id doc, turn pos, case when max(mk) in ('human', 'user') then 'human' else 'assistant' end "role", trim(string_agg(regexp_replace(line, '(?i)^(human|user|assistant|system|claude)\\s*:\\s*', ''), chr(10) order by pos), ' ') "text" from t where turn > 0 group by doc_id, turn""")
def parsed_transcripts(spark, d):
    """Transcripts by the dispatch on their first character (those of the documents are plain text)."""
    docs = table(spark, d, "documents").where("source in ('transcript', 'benchmark_chat')").select(F.col("doc_id").alias("doc"), "text")
    return ing.transcript_turns(docs)


@add("inert_texts", with_msg(r"select id, regexp_replace(regexp_replace('<system-note> ' || content, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '(?i)<(/?(?:memory-|system\b))', '&lt;\1', 'g') txt from msg"))
def inert_texts(spark, d):
    return load_messages(spark, d).select("id", ing.inert(F.concat(F.lit("<system-note> "), F.col("content")), "memory").alias("txt"))


@add("context_block")
def context_block(spark, d):
    m = load_messages(spark, d)
    return ing.context_block(search.hybrid(m, "vector index of the write lock", limit=20), "context")


@add("separation_pool")
def separation_pool(spark, d):
    """Hybrid pool with the separation list (the same vectors stand for it here)."""
    from palimpsest.plans.insight import _vectors

    v, vec = _vectors(spark, d)
    return search.hybrid(load_messages(spark, d), "retry queue", v, vec, 30, (1.2, 0.8), v).select("id", F.round("score", 8).alias("score"), "source")


@add("personality_search")
def personality_search(spark, d):
    """What the memory tells of a person's fears."""
    r = search.personality(load_messages(spark, d), f"what are {WHO}'s fears", 5)
    return r.select("id", "content", F.round("score", 6).alias("score"), "source")


@add("search_all_stages")
def search_all_stages(spark, d):
    """Every stage of the composed search: weights by type, window, character, changed facts, summaries, guard, reranking."""
    m = load_messages(spark, d)
    chain = co.supersessions(co.changes(m))
    r = search.pipeline(m, f"how did the plan of {WHO} change from January 2024 to December 2024", 10, chain=chain, summaries=co.monthly_summaries(m), rerank=search.lexical_rerank, now=datetime.date(2025, 1, 1))
    return r.select("id", F.round("score", 6).alias("score"), "source")


@add("rescoped_by_window", f"""{BM25}, pool as (select id, bm25, ts from scored join docs using (id) where not directive order by round(bm25, 9) desc, id::varchar limit 150),
inside as (select id, bm25, case when max(bm25) over () = min(bm25) over () then 1 else (bm25 - min(bm25) over ()) / (max(bm25) over () - min(bm25) over ()) end score from pool where ts <> '' and ts >= '2024-01-01' and ts < '2025-01-01')
select id, round(.8 * .05 * score, 6) score from inside order by round(score, 9) desc, id::varchar limit 15""")
def rescoped_by_window(spark, d):
    """Keyword hits of a closed window, scaled to 0.8 of a pool's best score of .05."""
    h = kw.search_in_range(load_messages(spark, d), "vector index of the write lock", "2024-01-01", tm.exclusive_upper("2024-12-31"), 15)
    return h.select("id", F.round(F.lit(0.8 * 0.05) * F.col("score"), 6).alias("score"))


@add("stemmed_index")
def stemmed_index(spark, d):
    """The on-disk postings of stems: the best hits of a query whose words stand in other forms."""
    import os
    import uuid

    at = os.path.join(checkpoint_dir(spark), f"index-{uuid.uuid4().hex}")
    m = load_messages(spark, d)
    return kw.best(kw.Index(spark, at).build(m).search(m, "vector indexes of write locks"), 20).select("id", F.round("bm25", 6).alias("bm25"))


@add("benchmark_sessions", """select * from (values ('c1', 1, 'Ann', 'hi there', '2023-05-08T13:56:00'), ('c1', 1, 'Bob', 'hello', '2023-05-08T13:56:30'), ('c1', 2, 'Ann', 'again', '2023-06-01T09:00:00')) t(conversation, session, sender, content, "timestamp")""")
def benchmark_sessions(spark, d):
    """Benchmark conversations flattened: a message every thirty seconds from its session's begin."""
    from palimpsest.sources.benchmarks import session_messages

    rows = [("c1", 1, "2023-05-08T13:56:00", [("Ann", "hi there"), ("Bob", "hello")]), ("c1", 2, "2023-06-01T09:00:00", [("Ann", "again")])]
    return session_messages(spark.createDataFrame(rows, "conversation string, session int, begins string, turns array<struct<speaker:string,text:string>>"))


@add("telemetry_kept", "select event_id from events where ts > (select max(ts) - interval 7 days from events)")
def telemetry_kept(spark, d):
    from palimpsest.sources.benchmarks import kept_signals

    e = table(spark, d, "events")
    return kept_signals(e, "ts", e.agg(F.max("ts")).first()[0], 7).select("event_id")
