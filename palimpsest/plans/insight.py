"""Queries of salience, surprise, consolidation, profiles, query analysis, ingestion and streams, each with its checking SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from palimpsest.functions import lexicon as L, query_analysis as qa
from palimpsest.functions.dates import first_day_column, time_window
from palimpsest.operators import consolidation as co, fusion, ingest as ing, keyword_search as kw, profiles as pr, salience as sal
from palimpsest.plans.memory import BM25, DOCS, MSG, WHO, with_msg
from palimpsest.plans.registry import Registry
from palimpsest.runtime import checkpoint_dir, table
from palimpsest.sources.messages import load_messages
from palimpsest.streaming import streams as st

registry = Registry()
add = registry.add


def q(s: str) -> str:
    return s.replace("'", "''")


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{q(pattern)}'))"


def hits(low: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({low}, '{q(w)}')::int" for w in words) + ")"


def inlist(words) -> str:
    return "(" + ", ".join(f"'{q(w)}'" for w in words) + ")"


# --- salience ----------------------------------------------------------------------------------------------------

BASE = "base as (select *, trim(content) t, regexp_replace(lower(trim(content)), '^[!?.… ]+|[!?.… ]+$', '', 'g') bare from msg)"
FEATS = f"""feats as (select id, content, modality, t, bare, (bare in {inlist(L.NOISE)})::int::double f_noise, case when length(t) > 0 then least(1, {count('t', L.EMOJI)} / length(t)) else 0 end f_emoji,
ln(1 + length(t)) / 7 f_length, ln(1 + {count('t', L.NUMBER)}) / 3 f_num, least(1, {count('t', L.MONEY)} / 2) f_money, least(1, {count('t', L.MONTH_DAY)} / 2) f_date, (lower(modality) in {inlist(L.HIGH_SIGNAL)})::int::double f_mod,
(contains(t, chr(10)) and length(t) > 50)::int::double f_nl, regexp_matches(t, '(?m)^[-*•]\\s')::int::double f_bul, least(1, {count('t', '!')} / 3) f_excl, least(1, {count('t', L.CAPITALS)} / 5) f_caps,
least(1, {hits('bare', L.AROUSAL)} / 3) f_arou, least(1, {hits('bare', L.LIFE_EVENTS)} / 2) f_life from base)"""
LOGIT = " + ".join(f"({w!r}) * {f}" for f, w in zip(sal.FEATURES, L.SALIENCE_WEIGHTS))
SALIENCE = f"with {MSG}, {BASE}, {FEATS}, sal as (select id, case when t = '' then 0 else 1 / (1 + exp(-({L.SALIENCE_BIAS} + {LOGIT}))) end s from feats)"


@add("salience_features", f"with {MSG}, {BASE}, {FEATS} select id, {', '.join(f'round({f}, 6) {f}' for f in sal.FEATURES)} from feats")
def salience_features(spark, d):
    return load_messages(spark, d).select("id", *(F.round(c, 6).alias(n) for n, c in sal.salience_features().items()))


@add("salience_logistic", f"{SALIENCE} select id, round(s, 6) salience from sal")
def salience_logistic(spark, d):
    return load_messages(spark, d).select("id", F.round(sal.salience(), 6).alias("salience"))


@add("salience_legacy", f"""with {MSG}, {BASE}, {FEATS} select id, round(case when content = '' then 0 else greatest(0, least(1, .3 - .3 * f_noise - case when regexp_matches(t, '^(?:{L.EMOJI}|\\s)+$') then .2 else 0 end
+ case when length(t) < 10 then -.1 when length(t) < 30 then 0 when length(t) < 100 then .1 when length(t) < 200 then .2 else .25 end
+ case when regexp_matches(t, '{L.MONEY}') then .15 when regexp_matches(t, '{L.NUMBER}') or regexp_matches(t, '{L.MONTH_DAY}') then .1 else 0 end + .15 * f_mod + .05 * f_nl + .05 * f_bul
+ case when {count('t', '!')} >= 3 then .15 when {count('t', '!')} >= 1 then .05 else 0 end + least(.1, {count('t', L.CAPITALS)} * .05) + least(.2, {hits('bare', L.AROUSAL)} * .1) + least(.3, {hits('bare', L.LIFE_EVENTS)} * .15))) end, 6) salience from feats""")
def salience_legacy(spark, d):
    return load_messages(spark, d).select("id", F.round(sal.salience_additive(), 6).alias("salience"))


@add("salience_guard", f"{SALIENCE} select id, round(s, 6) salience from sal where s >= .5 or id in (5, 12)")
def salience_guard(spark, d):
    return sal.salience_guard(load_messages(spark, d), 0.5, [5, 12]).select("id", F.round("salience", 6).alias("salience"))


POOL = f"{BM25}, pool as (select id, bm25 score, sender, recipient, content from scored join docs using (id) where not directive order by round(bm25, 9) desc, id::varchar limit 60)"
TARGETS = ["jovanka bramholt", "query cache"]
BOOSTED = f"""{POOL}, b as (select *, max(score) over () mx, case when lower(sender) in {inlist(TARGETS)} or lower(recipient) in {inlist(TARGETS)} then .3 else 0 end + case when {hits('lower(content)', TARGETS)} > 0 then .2 else 0 end raw from pool),
boosted as (select *, mx * case when raw = 0 then -.15 else raw end boost from b)"""


def _pool(spark, d):
    return kw.best(kw.scan_search(load_messages(spark, d), "vector index of the write lock", keep=~F.col("directive")).withColumn("score", F.round("bm25", 9)), 60, "score")


@add("entity_boost", f"{BOOSTED} select id, round(boost, 6) entity_boost, round(score + boost, 6) boosted from boosted")
def entity_boost(spark, d):
    return sal.entity_boost(_pool(spark, d), TARGETS).select("id", F.round("entity_boost", 6).alias("entity_boost"), F.round("boosted", 6).alias("boosted"))


@add("sender_saturation", f"""{BOOSTED}, n as (select *, row_number() over (partition by lower(sender) order by round(score + boost, 9) desc, id::varchar) nth, (select count(distinct lower(sender)) from pool where sender <> '') many from boosted)
select id, nth, round(case when many > 5 and nth > 3 and sender <> '' then greatest(.01, score - .03 * (nth - 3)) + boost else score + boost end, 6) final from n""")
def sender_saturation(spark, d):
    p = sal.entity_boost(_pool(spark, d), TARGETS).withColumn("boosted", F.round("boosted", 9))
    return sal.sender_saturation(p).select("id", "nth", F.round("final", 6).alias("final"))


#: RE2 knows word borders of ASCII only, so other letters become a digit, which has no border to a letter either.
PLAIN = "regexp_replace({}, '[\\x{{C0}}-\\x{{24F}}]', '0', 'g')"
NUM, NOUN, DATE = q(L.FACT_NUMBERS), q(L.PROPER_NOUN), q(sal.ISO_OR_NAMED_DATE)
DEF = q(sal.DEFINITION)
FACTS = f"""w as (select id, list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> '') ws from msg),
ev as (select id, unnest(range(1, len(ws) + 1)) i, ws from w), facts as (select distinct id, fact from (
  select id, 'num:' || replace(lower(trim(unnest(regexp_extract_all(content, '{NUM}')))), ',', '') fact from msg
  union all select id, 'entity:' || lower(x) from (select id, unnest(regexp_extract_all({PLAIN.format('content')}, '{NOUN}')) x from msg) where x not in {inlist(sal.COMMON_NOUNS)} and length(x) > 1
  union all select id, 'date:' || lower(trim(unnest(regexp_extract_all(content, '{DATE}')))) from msg
  union all select id, 'event:' || array_to_string(ws[greatest(1, i - 2):i + 2], ' ') from ev where regexp_replace(ws[i], '^[.,!?"''()]+|[.,!?"''()]+$', '', 'g') in {inlist(sal.EVENT_WORDS)}
  union all select id, 'def:' || s || '=' || p from (select id, lower(trim(unnest(regexp_extract_all(content, '{DEF}', 1)))) s, lower(trim(unnest(regexp_extract_all(content, '{DEF}', 2)))) p from msg) where length(s) > 3 and length(p) > 3))"""
ONE_WORD = [x for x in L.SURPRISE_NOISE if " " not in x]
SURPRISE = f"""with {MSG}, {FACTS}, firsts as (select fact, arg_min(id, (ts, id)) id from facts join msg using (id) group by fact), new as (select id, count(*) n_new, count(*) filter (where starts_with(fact, 'event:')) n_ev from firsts group by id),
tot as (select id, count(*) n from facts group by id), x as (select m.id, m.content c, coalesce(n, 0) n, coalesce(n_new, 0) n_new, coalesce(n_ev, 0) n_ev, regexp_replace(lower(trim(content)), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g') cl from msg m left join tot using (id) left join new using (id)),
y as (select *, cl in {inlist(L.SURPRISE_NOISE)} or length(cl) < 4 or (len(list_filter(regexp_split_to_array(cl, '\\s+'), lambda w: w <> '')) <= 2
  and len(list_filter(regexp_split_to_array(cl, '\\s+'), lambda w: w <> '' and w not in {inlist(ONE_WORD)})) = 0) noise from x),
surprise as (select id message_id, round(case when noise then .05 when n = 0 and length(c) < 30 then .1 when n = 0 and length(c) < 80 then .2 when n = 0 then .3 when n_new = 0 then .1
  else greatest(.05, least(1, n_new / n * .6 + case when length(c) > 300 then .15 when length(c) > 150 then .1 when length(c) > 80 then .05 else 0 end
  + least(.15, (len(regexp_extract_all(c, '{NUM}')) + len(regexp_extract_all(c, '{DATE}'))) * .05) + least(.1, n_ev * .05))) end, 4) surprise, n fact_count, n_new new_fact_count from y)"""


@add("fact_fingerprints", f"with {MSG}, {FACTS} select id, fact from facts")
def fact_fingerprints(spark, d):
    return load_messages(spark, d).select("id", F.explode(sal.fact_fingerprints()).alias("fact"))


@add("surprise_scores", f"{SURPRISE} select * from surprise")
def surprise_scores(spark, d):
    return sal.surprise_index(load_messages(spark, d))


@add("high_surprise", f"{SURPRISE} select id, surprise, content from surprise join msg on id = message_id where surprise >= .75")
def high_surprise(spark, d):
    m = load_messages(spark, d)
    s = sal.surprise_index(m).where("surprise >= 0.75").withColumnRenamed("message_id", "id")
    return m.join(s, "id").select("id", "surprise", "content")


@add("surprise_stats", f"{SURPRISE} select count(*) n, round(avg(surprise), 6) mean, min(surprise) least, max(surprise) most, (select surprise from surprise order by surprise limit 1 offset (select count(*) // 2 from surprise)) median from surprise")
def surprise_stats(spark, d):
    from palimpsest.operators.relational import median_row

    return median_row(sal.surprise_index(load_messages(spark, d)), "surprise")


@add("surprise_boost", SURPRISE + f""", {DOCS}, pool as (select id, bm25 score from scored join docs using (id) where not directive order by round(bm25, 9) desc, id::varchar limit 60)
select id, round(case when id % 5 = 0 then score else score * (1 + .2 * coalesce(surprise, 0)) end, 6) score from pool left join surprise on message_id = id""")
def surprise_boost(spark, d):
    pool = _pool(spark, d).withColumn("source", F.when(F.col("id") % 5 == 0, "fts+summary").otherwise("fts+vec"))
    return sal.surprise_boost(pool, sal.surprise_index(load_messages(spark, d))).select("id", F.round("score", 6).alias("score"))


# --- consolidation -----------------------------------------------------------------------------------------------


def _subject(raw: str) -> str:
    whens = " ".join(f"when contains(lower({raw}), '{w}') or contains(lower(content), '{w}') then '{s}'" for w, s in L.SUBJECTS.items())
    return f"case {whens} else substr(regexp_replace(trim(lower({raw})), '\\s+', '_', 'g'), 1, 50) end"


def _changes_sql() -> str:
    parts = []
    for p, (kind, category, pattern) in enumerate(L.CHANGES):
        two = kind in ("explicit_change", "pricing")
        rows = f"(select id, ts, content, unnest(range(0, len(regexp_extract_all(content, '{q(pattern)}', 1)))) k, regexp_extract_all(content, '{q(pattern)}', 1) ga, regexp_extract_all(content, '{q(pattern)}', {2 if two else 1}) gb from msg where not directive)"
        a, b = "trim(ga[k + 1])", "trim(gb[k + 1])"
        if kind == "explicit_change":
            cols = (_subject(a), a, b)
        elif kind == "pricing":
            cols = (f"'pricing_' || lower({b})", "null::varchar", a)
        elif kind in ("location_change", "schedule_change"):
            cols = ("'" + {"location": "office_location", "schedule": "gym_schedule"}[category] + "'", "null::varchar", a)
        elif kind == "status_change":
            cols = (f"'status_' || regexp_replace(lower({a}), '\\s+', '_', 'g')", "null::varchar", a)
        else:
            cols = (f"case when {_subject(chr(39) * 2)} = '' then 'correction' else {_subject(chr(39) * 2)} end", "null::varchar", a)
        parts.append(f"select id, ts, '{kind}' kind, {cols[0]} subject, {cols[1]} old_fact, {cols[2]} new_fact, {p} p, k from {rows}")
    return " union all ".join(parts)


CHANGES = f"with {MSG}, found as ({_changes_sql()})"
CHAIN = f"""{CHANGES}, n as (select *, row_number() over (partition by subject order by ts, id, p, k) n from found),
half as (select subject, new_fact fact, id, ts, kind, p, k, 1 h from n union all select subject, old_fact, id, ts, kind, p, k, 0 from n where n = 1 and kind = 'explicit_change'),
s as (select *, row_number() over w seq, lead(kind) over w nk, lead(fact) over w nf, lead(ts) over w nt from half window w as (partition by subject order by ts, id, p, k, h)),
o as (select *, coalesce(nk in ('explicit_change', 'informal_correction', 'negation_change', 'retraction') or (nk = 'pricing' and nf <> fact) or (nk in ('location_change', 'schedule_change') and lower(nf) <> lower(fact)), false) over_ from s),
chain as (select subject, fact, id, ts, seq, case when over_ then seq + 1 end superseded_by, case when over_ then nt end valid_to, case when over_ then 'superseded' else 'active' end status from o)"""


@add("contradictions", f"{CHANGES} select id, kind, subject, old_fact, new_fact from found")
def contradictions(spark, d):
    return co.changes(load_messages(spark, d)).select("id", "kind", "subject", "old_fact", "new_fact")


@add("fact_supersession", f"{CHAIN} select subject, fact, id, seq, superseded_by, valid_to, status from chain")
def fact_supersession(spark, d):
    return co.supersessions(co.changes(load_messages(spark, d))).select("subject", "fact", "id", "seq", "superseded_by", "valid_to", "status")


WORDS = ["query", "cache", "office"]


@add("contradiction_search", f"""{CHAIN}, h as (select *, {hits("(lower(subject) || ' ' || lower(fact))", WORDS)} hit from chain), g as (select subject, max(hit) hit, arg_max(fact, seq) filter (where status = 'active') cur, count(*) versions from h group by subject)
select subject, cur "current", versions, case when cur is null then hit * .5 else hit * 1.0 end relevance from g where hit > 0""")
def contradiction_search(spark, d):
    return co.changed_fact_search(co.supersessions(co.changes(load_messages(spark, d))), WORDS)


@add("consolidated_search", f"{CHAIN} select subject, fact, seq, {hits(chr(40) + 'lower(subject) || chr(32) || lower(fact))', WORDS)} * 2 + case when substr(ts, 1, 7) = '2024-05' then 2 else 0 end relevance from chain where {hits(chr(40) + 'lower(subject) || chr(32) || lower(fact))', WORDS)} > 0")
def consolidated_search(spark, d):
    return co.overlap_search(co.supersessions(co.changes(load_messages(spark, d))), WORDS, "2024-05")


DENS_NUM = " + ".join(count("content", p if p.startswith("(?i)") else f"(?i){p}") for p in L.SUMMARY_NUMBERS)
DENSITY = f"""dens as (select id, ts, content, case when regexp_matches(ts, '^\\d{{4}}-\\d{{2}}') then substr(ts, 1, 7) else 'unknown' end mon, round(greatest(0, least(1, case when length(content) > 200 then .3 when length(content) > 100 then .2 when length(content) > 50 then .1 when length(content) < 20 then -.2 else 0 end
+ least(.3, ({DENS_NUM}) * .1) + least(.3, {hits('lower(content)', L.DECISIONS)} * .1) + least(.1, {count(PLAIN.format('content'), L.PROPER_NOUN)} * .02))), 6) sal from msg where not directive)"""
MONTHLY = f"""{CHANGES}, {DENSITY}, cc as (select id, count(*) n_changes from found group by id), mm as (select mon, count(*) n, count(*) filter (where sal > .5) + 2 * coalesce(sum(n_changes), 0) ring from dens left join cc using (id) group by mon),
kept as (select mon, n, ring, case when ring > 10 then greatest(25, n // 3) when ring > 5 then greatest(15, n // 5) else greatest(8, n // 8) end top_count from mm),
ranked as (select mon, id, ts, content, sal, top_count, row_number() over (partition by mon order by sal desc, ts, id) rn from dens join kept using (mon)), top as (select * from ranked where rn <= top_count)"""


def _change_counts(m):
    return co.changes(m).groupBy("id").agg(F.count("*").alias("n_changes"))


@add("monthly_messages", f"{MONTHLY} select mon \"month\", id, sal, rn, top_count from top")
def monthly_messages(spark, d):
    m = load_messages(spark, d)
    return co.monthly_messages(m, _change_counts(m))


SENT = f"case when length(s) > 100 then .2 when length(s) > 50 then .1 else 0 end + case when regexp_matches(s, '\\d') then .15 else 0 end + case when regexp_matches(s, '\\$[\\d,.]+') then .2 else 0 end + least(.3, {hits('lower(s)', L.SENTENCE_EVENTS)} * .1) + least(.1, {count(PLAIN.format('s'), L.PROPER_NOUN)} * .02)"


@add("monthly_summary", f"""{MONTHLY}, cut as (select mon, id, ts, sal, list_filter(list_transform(string_split(regexp_replace(trim(content), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 10) ss from top),
sen as (select mon, id, ts, sal, unnest(ss) s, unnest(range(0, len(ss))) pos from cut), sc as (select *, round({SENT} + .3 * sal, 6) score, count(*) over (partition by mon) n from sen), rk as (select *, row_number() over (partition by mon order by score desc, ts, id, pos) rn from sc)
select mon "month", count(*) n_sentences, string_agg(s, ' ' order by ts, id, pos) summary from rk where rn <= greatest(20, n // 3) group by mon""")
def monthly_summary(spark, d):
    m = load_messages(spark, d)
    return co.monthly_summaries(m, _change_counts(m))


@add("entity_monthly", with_msg("""select entity, mon "month", n, greatest(5, n // 4) kept from (select lower(sender) entity, case when regexp_matches(ts, '^\\d{4}-\\d{2}') then substr(ts, 1, 7) else 'unknown' end mon, count(*) n from msg where not directive and sender <> '' group by 1, 2)
qualify sum(n) over (partition by entity) >= 10 and n >= 3"""))
def entity_monthly(spark, d):
    return co.entity_months(load_messages(spark, d))


@add("key_numbers", "with " + MSG + " " + " union all ".join(f"select id, unnest(regexp_extract_all(content, '{q(p if p.startswith('(?i)') else '(?i)' + p)}')) number from msg" for p in L.SUMMARY_NUMBERS))
def key_numbers(spark, d):
    return co.key_numbers(load_messages(spark, d))


# --- profiles ----------------------------------------------------------------------------------------------------


@add("entity_profiles", with_msg(f"""select lower(sender) entity, count(*) message_count, round(avg(length(content)), 4) avg_length, max(regexp_matches(content, '{L.EMOJI}')::int) uses_emoji, count(distinct case when recipient <> '' then lower(recipient) end) n_partners,
min(case when ts <> '' then ts end) first_ts, max(ts) last_ts from msg where sender <> '' group by 1"""))
def entity_profiles(spark, d):
    return pr.profiles(load_messages(spark, d))


@add("relationships", with_msg("""select entity, partner, sum(n) message_count, arg_max(category, (n, category)) primary_category from (select lower(sender) entity, lower(recipient) partner, category, count(*) n from msg where sender <> '' and recipient <> '' group by 1, 2, 3) group by 1, 2"""))
def relationships(spark, d):
    return pr.relationships(load_messages(spark, d))


@add("communication_pattern", with_msg("""select count(*) n, count(*) filter (where s = 'jovanka bramholt') n_from_a, arg_min(id, (ts, id)) first_id, arg_max(id, (ts, id)) last_id, arg_max(id, (length(content), -id)) longest_id
from (select *, lower(sender) s, lower(recipient) r from msg) where (s = 'jovanka bramholt' and r = 'felka brammont') or (r = 'jovanka bramholt' and s = 'felka brammont')"""))
def communication_pattern(spark, d):
    return pr.communication_pattern(load_messages(spark, d), WHO, "Felka Brammont")


GRAMS = """tx as (select id, lower(sender) entity, regexp_replace(lower(trim(content)), '\\s+', ' ', 'g') t from msg where sender <> '' and trim(content) <> ''),
gr as (select id, entity, n, t, unnest(range(1, length(t) - n + 2)) i from tx, (values (3), (4), (5)) v(n) where length(t) >= n),
bk as (select id, entity, ('0x' || substr(md5(substr(t, i, n)), 1, 2))::int bucket, count(*) c from gr group by 1, 2, 3),
un as (select entity, bucket, sum(c / nrm) v from (select *, sqrt(sum(c * c) over (partition by id)) nrm from bk) group by 1, 2), sv as (select entity, bucket, round(v / sqrt(sum(v * v) over (partition by entity)), 6) "value" from un)"""


@add("entity_style_vector", f"with {MSG}, {GRAMS} select * from sv")
def entity_style_vector(spark, d):
    return pr.style_vectors(load_messages(spark, d))


@add("style_similarity", f"with {MSG}, {GRAMS} select a.entity, round(sum(a.value * b.value), 4) cosine from sv a join sv b on b.bucket = a.bucket and b.entity = lower('{WHO}') group by a.entity")
def style_similarity(spark, d):
    return pr.style_similarity(pr.style_vectors(load_messages(spark, d)), WHO)


# --- queries about queries ---------------------------------------------------------------------------------------

QUESTIONS = [
    "What is the budget of the write lock?", "when did we move the weekly call in March 2024", "Who is Jovanka Bramholt?", "tell me about felka brammont and her hobbies", "Summarize the journey of the project over time", "list all team members",
    "how many rows does the cache keep", "what topics does Nadrec talk about", "explain why the retry queue is slow", "what is likely next", "everything about the office", "late 2024 plans", "notes from June 15, 2025", "early March 2024", "2024-05-06 call", "just words", "", "How did the plan change and evolve",
]
QS = "qs(qid, query) as (values " + ", ".join(f"({i}, '{q(x)}')" for i, x in enumerate(QUESTIONS)) + ")"


def _questions(spark):
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "qid int, query string")


def _n(text: str, ps: list[str]) -> str:
    return "(" + " + ".join(f"regexp_matches({text}, '{q(p)}')::int" for p in ps) + ")"


TYPED = f"with {QS}, h as (select *, {', '.join(f'{_n('lower(query)', ps)} h_{t}' for t, (ps, _) in L.QUERY_TYPES.items())} from qs), b as (select *, greatest({', '.join(f'h_{t}' for t in L.QUERY_TYPES)}) best from h), k as (select *, case when best = 0 then 'general' {' '.join(f'when h_{t} = best then {chr(39)}{t}{chr(39)}' for t in L.QUERY_TYPES)} end query_type from b)"


@add("classify_queries", TYPED + " select qid, query_type, case when best = 0 then .5 else least(1, best * .4 + .3) end confidence, " + ", ".join(f"case {' '.join(f'when query_type = {chr(39)}{t}{chr(39)} then {ws[i]}' for t, (_, ws) in L.QUERY_TYPES.items())} else 1.0 end w_{w}" for i, w in enumerate(qa.WEIGHTS)) + " from k")
def classify_queries(spark, d):
    return qa.classify(_questions(spark)).drop("query")


@add("search_mode", f"with {QS} select qid, case when {_n('lower(query)', L.DIFFUSE)} > 0 then 'diffuse' else 'spotlight' end mode from qs")
def search_mode(spark, d):
    return _questions(spark).select("qid", qa.search_mode(F.col("query")).alias("mode"))


@add("question_type", f"with {QS} select qid, case when {_n('trim(lower(query))', L.DETAIL)} > 0 then 'detail' when {_n('trim(lower(query))', L.SYNTHESIS)} > 0 then 'synthesis' else 'general' end kind from qs")
def question_type(spark, d):
    return _questions(spark).select("qid", qa.question_type(F.col("query")).alias("kind"))


@add("entities_in_query", f"with {MSG}, {QS}, e as (select distinct entity from (select lower(sender) entity from msg union select lower(recipient) from msg) where entity not in ('', 'self')) select qid, entity from qs, e where entity = trim(entity) and contains(' ' || regexp_replace(lower(query), '[^\\p{{L}}\\p{{N}}_'']+', ' ', 'g') || ' ', ' ' || entity || ' ')")
def entities_in_query(spark, d):
    from palimpsest.operators.relational import known_entities

    return qa.named_entities(_questions(spark), known_entities(load_messages(spark, d)))


@add("parse_dates", """select * from (values (0, null), (1, '2024-03-01'), (2, null), (3, null), (4, null), (5, null), (6, null), (7, null), (8, null), (9, null), (10, null), (11, '2024-09-01'), (12, '2025-06-15'), (13, '2024-03-01'),
(14, '2024-05-06'), (15, null), (16, null), (17, null)) t(qid, "day")""")
def parse_dates(spark, d):
    return _questions(spark).select("qid", first_day_column(F.col("query")).alias("day"))


TIMES = [
    "What changed from January 2024 to March 2024?", "notes between 2024-01-05 and 2024-02-10", "calls in June 2025", "plans in 2024", "after January 15, 2026 what happened", "before mid 2024", "as of 2024-05-01, upcoming trips", "yesterday",
    "last 3 weeks", "last month", "the month after the launch (June 15, 2025)", "late 2024 plans", "just words", "", "next week after 2024-02-01",
]


@add("time_windows", """select * from (values (0, true, '2024-01-01', '2024-03-01', true, true, null), (1, true, '2024-01-05', '2024-02-10', false, false, null), (2, true, '2025-06-01', '2025-06-30', false, false, null),
(3, true, '2024-01-01', '2024-12-31', false, false, null), (4, true, '2026-01-15', null, true, false, '2026-01-15'), (5, true, null, '2024-05-01', false, false, null), (6, true, '2024-05-01', null, true, false, '2024-05-01'),
(7, true, '2025-07-09', '2025-07-09', true, false, null), (8, true, '2025-06-19', '2025-07-10', true, false, null), (9, true, '2025-06-10', '2025-07-10', true, false, null), (10, true, '2025-06-15', '2025-07-16', true, false, '2025-06-15'),
(11, true, null, null, false, false, '2024-09-01'), (12, false, null, null, false, false, null), (13, false, null, null, false, false, null), (14, true, '2024-02-01', '2024-02-08', true, false, '2024-02-01'))
t(qid, temporal, "after", "before", chronological, trajectory, reference)""")
def time_windows(spark, d):
    """The windows of questions, as of 10 July 2025."""
    rows = [(i, *time_window(x, datetime.date(2025, 7, 10)).row()) for i, x in enumerate(TIMES)]
    return spark.createDataFrame(rows, "qid int, temporal boolean, after string, before string, chronological boolean, trajectory boolean, reference string")


@add("multi_query_merge", f"""with {MSG}, terms(qid, term) as (values (0, 'cache'), (1, 'parcel'), (2, 'invoice')), s as (select qid, id, length(content) - length(replace(lower(content), term, '')) score from msg, terms where contains(lower(content), term)),
b as (select *, row_number() over (partition by qid order by score desc, id::varchar) r from s), k as (select *, row_number() over (partition by id order by qid) n from b where r <= 12) select qid, id, score from k where n = 1""")
def multi_query_merge(spark, d):
    m = load_messages(spark, d)
    terms = F.explode(F.array(*(F.struct(F.lit(i).alias("qid"), F.lit(t).alias("term")) for i, t in enumerate(("cache", "parcel", "invoice")))))
    low = F.lower("content")
    rows = m.select("id", "content", terms.alias("t")).where(F.contains(low, F.col("t.term")))
    rows = rows.select(F.col("t.qid").alias("qid"), "id", (F.length("content") - F.length(F.replace(low, F.col("t.term"), F.lit("")))).cast("bigint").alias("score"))
    return fusion.quota_merge(rows, 12)


# --- ingestion ---------------------------------------------------------------------------------------------------


def _lines(spark, d):
    return table(spark, d, "sample_real_claude_code_transcript")


@add("transcript_turns", f"""with x as (select distinct sessionId s, uuid u, type, message.role r, message.content c from sample_real_claude_code_transcript where type not in {inlist(ing.NO_CONVERSATION)} and message is not null),
b as (select *, case when regexp_matches(c, '^\\s*\\[') and json_valid(c) then from_json(c, '[{{"type":"VARCHAR","text":"VARCHAR","name":"VARCHAR","content":"VARCHAR"}}]') end bl from x),
t as (select s, u, type, bl, lower(trim(coalesce(nullif(r, ''), type))) r, trim(case when bl is not null then array_to_string(list_filter(list_transform(bl, lambda k: case k.type when 'text' then k.text when 'tool_use' then '[tool: ' || k.name || ']' when 'tool_result' then k.content end), lambda v: v is not null and trim(v) <> ''), chr(10)) else c end) txt from b)
select s "session", u uuid, case when type = 'user' and bl is not null and len(bl) > 0 and len(list_filter(bl, lambda k: k.type <> 'tool_result')) = 0 then 'tool_result' when r in ('user', 'human') then 'human' when r in ('assistant', 'claude', 'system') then 'assistant' else r end "role", txt "text" from t where txt <> ''""")
def transcript_turns(spark, d):
    return ing.turns(_lines(spark, d))


@add("format_turns", f"with {MSG}, x as (select category, id, case when id % 2 = 0 then 'User: ' || content else 'Assistant: ' || case when length(content) > 500 then substr(content, 1, 500) || '...' else content end end l from msg where category <> '') select category, string_agg(l, chr(10) || chr(10) order by id) transcript from x group by category")
def format_turns(spark, d):
    m = load_messages(spark, d).where("category <> ''").select("category", "id", F.when(F.col("id") % 2 == 0, "human").otherwise("assistant").alias("role"), F.col("content").alias("text"))
    return ing.formatted(m, "category", "id")


@add("transcript_text", """with l as (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(0, len(string_split(text, chr(10))))) pos from documents where source in ('transcript', 'benchmark_chat') and text is not null),
m as (select *, lower(regexp_extract(line, '(?i)^(human|user|assistant|system|claude)\\s*:\\s*', 1)) mk from l), t as (select *, sum((mk <> '')::int) over (partition by doc_id order by pos)::bigint turn from m)
select doc_id doc, turn, case when max(mk) in ('human', 'user') then 'human' else 'assistant' end "role", trim(string_agg(regexp_replace(line, '(?i)^(human|user|assistant|system|claude)\\s*:\\s*', ''), chr(10) order by pos), ' ') "text" from t where turn > 0 group by doc_id, turn""")
def transcript_text(spark, d):
    docs = table(spark, d, "documents").where("source in ('transcript', 'benchmark_chat')").select(F.col("doc_id").alias("doc"), "text")
    return ing.plain_turns(docs)


@add("chunk_budget")
def chunk_budget(spark, d):
    c = ing.chunked(table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), "text"), 2_000)
    return c.select("doc", "chunk", F.length("text").alias("chars"))


@add("extract_simple", "with " + MSG + ", f as (" + " union all ".join(f"select id, '{c}' category, '{k}' confidence, unnest(regexp_extract_all(translate(content, '‘’“”', '''''\"\"'), '{q(p)}')) raw from msg" for c, k, p in ing.FACTS) + ") select distinct id, category, confidence, regexp_replace(trim(raw), '[.,!]+$', '') fact from f where regexp_replace(trim(raw), '[.,!]+$', '') <> ''")
def extract_simple(spark, d):
    return ing.pattern_facts(load_messages(spark, d))


MARK = q("(?i)" + "|".join([*(f"\\b{m}\\b" if m[-1].isalnum() else f"\\b{m}" for m in ing.UPDATE_MARKERS), *ing.UPDATE_PATTERNS]))


@add("update_markers", with_msg(f"select id from msg where regexp_matches(content, '{MARK}')"))
def update_markers(spark, d):
    return load_messages(spark, d).where(ing.update_markers(F.col("content"))).select("id")


@add("gate_score", f"""{SALIENCE}, g as (select id, content, case id % 4 when 0 then 'correction' when 1 then 'decision' when 2 then 'activity' else 'general' end category, (id % 10) / 10.0 novelty, s, (id % 7) / 10.0 err from msg join sal using (id)),
h as (select *, greatest(0, least(1, (.25 * novelty + .2 * s + .3 * err) / .75)) score from g)
select id, round(score, 6) score, (s >= .1 and score >= greatest(.1, .3 + case category when 'correction' then -.06 when 'decision' then -.04 when 'activity' then -.02 else 0 end)) or category = 'correction' or regexp_matches(content, '{MARK}') encode from h""")
def gate_score(spark, d):
    m = load_messages(spark, d)
    c = F.when(F.col("id") % 4 == 0, "correction").when(F.col("id") % 4 == 1, "decision").when(F.col("id") % 4 == 2, "activity").otherwise("general")
    g = ing.gate(m.select("id", "content", c.alias("category"), (F.col("id") % 10 / 10).alias("novelty"), sal.salience().alias("salience"), (F.col("id") % 7 / 10).alias("error")))
    return g.select("id", F.round("score", 6).alias("score"), "encode")


NEXT = f"with {MSG}, p as (select id, content fact, lag(content) over (partition by category order by id) existing, (id % 100) / 100.0 similarity, case when id % 9 = 0 then 'correction' else 'general' end cat from msg)"


def _neighbours(spark, d):
    from pyspark.sql import Window

    m = load_messages(spark, d)
    return m.select("id", F.col("content").alias("fact"), F.lag("content").over(Window.partitionBy("category").orderBy("id")).alias("existing"), (F.col("id") % 100 / 100).alias("similarity"), F.when(F.col("id") % 9 == 0, "correction").otherwise("general").alias("category"))


DIG = "list_sort(regexp_extract_all(coalesce({}, ''), '[0-9]+'))"
WSET = "list_distinct(regexp_extract_all(lower({}), '[0-9A-Za-z_]+'))"
JAC = f"case when len(list_distinct(list_concat({WSET.format('fact')}, {WSET.format('existing')}))) = 0 then 0 else len(list_intersect({WSET.format('fact')}, {WSET.format('existing')})) / len(list_distinct(list_concat({WSET.format('fact')}, {WSET.format('existing')}))) end"


@add("digit_divergence", f"{NEXT} select id, {DIG.format('fact')} <> {DIG.format('existing')} divergent from p where existing is not null")
def digit_divergence(spark, d):
    return _neighbours(spark, d).where("existing is not null").select("id", (ing.digit_runs(F.col("fact")) != ing.digit_runs(F.col("existing"))).alias("divergent"))


@add("word_jaccard", f"{NEXT} select id, round({JAC}, 6) jaccard from p where existing is not null")
def word_jaccard(spark, d):
    return _neighbours(spark, d).where("existing is not null").select("id", F.round(ing.jaccard(F.col("fact"), F.col("existing")), 6).alias("jaccard"))


@add("dedup_ladder", f"""{NEXT}, x as (select *, cat = 'correction' or regexp_matches(fact, '{MARK}') corr, {JAC} j, trim(lower(fact)) f, trim(lower(existing)) e from p)
select id, case when existing is null or similarity < .15 then 'ADD' when similarity > .92 then case when corr then 'UPDATE' when {DIG.format('fact')} <> {DIG.format('existing')} then 'ADD' else 'SKIP' end when corr then 'UPDATE' when contains(e, f) then 'SKIP' when contains(f, e) then 'UPDATE'
when j > .6 and length(f) >= length(e) then 'UPDATE' when j > .6 then 'SKIP' else 'ADD' end "action" from x""")
def dedup_ladder(spark, d):
    return ing.resolve_duplicate(_neighbours(spark, d)).select("id", "action")


@add("gzip_novelty")
def gzip_novelty(spark, d):
    n = _neighbours(spark, d)
    return n.select("id", F.round(ing.compression_novelty(F.col("fact"), F.coalesce("existing", F.lit(""))), 6).alias("novelty"))


@add("markdown_facts", """with l as (select doc_id doc, unnest(string_split(text, chr(10))) line, unnest(range(0, len(string_split(text, chr(10))))) pos from documents where source = 'memory_md' and text is not null),
f as (select *, sum(regexp_matches(line, '^\\s*```')::int) over (partition by doc order by pos) fence from l), h as (select *, last_value(case when regexp_matches(line, '^#{1,6}\\s') then regexp_replace(line, '^#{1,6}\\s+', '') end ignore nulls) over (partition by doc order by pos) hd from f where fence % 2 = 0)
select doc, pos, case when hd is null then '' else hd || ': ' end || trim(regexp_replace(line, '^\\s*[-*+]\\s+', '')) fact from h where regexp_matches(line, '^\\s*[-*+]\\s+\\S')""")
def markdown_facts(spark, d):
    return ing.markdown_facts(table(spark, d, "documents").where("source = 'memory_md' and text is not null").select(F.col("doc_id").alias("doc"), "text"))


# --- streams -----------------------------------------------------------------------------------------------------


def _through_stream(spark, d, name, plan):
    """Run a stream over the events that are there now, into a table that is read back."""
    import uuid

    at = f"{checkpoint_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    once = f"{at}/in"
    table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(once)
    events = spark.readStream.schema(spark.read.parquet(once).schema).parquet(once)
    out = plan(events)
    job = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


@add("tumbling_counts", "select epoch(date_trunc('hour', ts))::bigint start_s, event_type, count(*) n from events group by 1, 2")
def tumbling_counts(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return st.tumbling(e, "ts", "1 hour", ["event_type"]).select(F.unix_seconds("window.start").alias("start_s"), "event_type", "n")


@add("sliding_counts", "with k as (select epoch(time_bucket(interval 15 minutes, ts))::bigint b from events) select b - o * 900 start_s, count(*) n from k, range(0, 4) r(o) group by 1")
def sliding_counts(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return st.sliding(e, "ts", "1 hour", "15 minutes", []).select(F.unix_seconds("window.start").alias("start_s"), "n")


@add("session_windows", """with g as (select user_id, ts, case when ts - lag(ts) over w <= interval 6 hours then 0 else 1 end new from events window w as (partition by user_id order by ts)), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) k from g)
select user_id, epoch_us(min(ts)) start_us, count(*) n from s group by user_id, k""")
def session_windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return st.sessions(e, "ts", "6 hours", ["user_id"]).select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


@add("streamed_tumbling")
def streamed_tumbling(spark, d):
    """Closed hourly windows of a stream with a ten-minute watermark (the last windows stay open)."""
    return _through_stream(spark, d, "tumbling", lambda e: st.tumbling(e, "ts", "1 hour", ["event_type"], "10 minutes").select(F.unix_seconds("window.start").alias("start_s"), "event_type", "n"))


DEBOUNCE = """with recursive e as (select user_id, ts, event_id, row_number() over (partition by user_id order by ts, event_id) n from events),
w as (select user_id, ts, event_id, n, ts last, true ok from e where n = 1 union all select e.user_id, e.ts, e.event_id, e.n, case when e.ts - w.last >= interval 2 hours then e.ts else w.last end, e.ts - w.last >= interval 2 hours from w join e on e.user_id = w.user_id and e.n = w.n + 1)
select event_id, user_id from w where ok"""


@add("streamed_debounce", DEBOUNCE)
def streamed_debounce(spark, d):
    """Accepted events of each user, two hours apart at least, with the last acceptance as state."""
    kind = "event_id bigint, ts timestamp, user_id bigint"
    return _through_stream(spark, d, "debounce", lambda e: st.debounced(e.select("event_id", "ts", "user_id"), "user_id", "ts", 7_200, kind)).select("event_id", "user_id")


@add("debounce", DEBOUNCE)
def debounce(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return st.debounced(e, "user_id", "ts", 7_200, "event_id bigint, ts timestamp, user_id bigint").select("event_id", "user_id")


@add("hourly_budget", "select event_id, nth from (select event_id, row_number() over (partition by date_trunc('hour', ts) order by ts, event_id) nth from events) where nth <= 5")
def hourly_budget(spark, d):
    return st.hourly_budget(table(spark, d, "events"), "ts", "event_id", 5).select("event_id", "nth")


@add("watermark_scan", "select session_id from session_files where mtime > '2025-01-01' order by mtime, session_id limit 3")
def watermark_scan(spark, d):
    return st.stale_scan(table(spark, d, "session_files"), "2025-01-01 00:00:00", 3)[0].select("session_id")


@add("growth_rule", "select session_id from session_files where substr(session_id, 1, 1) > '7' or size_bytes - size_bytes // 2 > 1024")
def growth_rule(spark, d):
    f = table(spark, d, "session_files")
    marks = f.where("substr(session_id, 1, 1) <= '7'").select("session_id", F.expr("size_bytes div 2").alias("size"))
    return st.grown(f, marks).select("session_id")


# --- further builders and composed searches ----------------------------------------------------------------------


@add("structured_places", "with " + MSG + ", f as (" + " union all ".join(f"select trim(unnest(regexp_extract_all(content, '{q(p)}', 1))) place from msg where not directive" for p in co.PLACES) + ") select distinct place from f where length(place) > 3 and length(place) < 50")
def structured_places(spark, d):
    return co.places(load_messages(spark, d))


@add("structured_roster")
def structured_roster(spark, d):
    return co.roster(load_messages(spark, d))


TOPIC_SQL = " union all ".join(f"select entity, '{t}' topic, sum({' + '.join(f'list_contains(w, {chr(39)}{x}{chr(39)})::int' for x in ws.split())}) hits from w group by entity" for t, ws in pr.TOPICS.items())


@add("entity_topics", f"with {MSG}, w as (select lower(sender) entity, regexp_split_to_array(lower(content), '\\s+') w from msg where sender <> ''), x as ({TOPIC_SQL}) select entity, topic, hits from x where hits >= 2")
def entity_topics(spark, d):
    return pr.topics(load_messages(spark, d))


TRAIT_SQL = " union all ".join(f"select entity, count(*) n, '{t}' trait, sum({hits('c', ws.split('|'))}) hits from w group by entity" for t, ws in pr.TRAITS.items())


@add("entity_traits", f"with {MSG}, w as (select lower(sender) entity, lower(content) c from msg where sender <> ''), x as ({TRAIT_SQL}) select entity, trait, hits from x where hits >= greatest(2, n // 50)")
def entity_traits(spark, d):
    return pr.traits(load_messages(spark, d))


@add("entity_formality", f"""with {MSG}, k as (select lower(sender) entity, content c, length(content) < 50 and (list_has_any(regexp_split_to_array(lower(content), '\\s+'), {list(pr.CASUAL)}) or content = lower(content) or regexp_matches(content, '{L.EMOJI}')) cas from msg where sender <> ''),
g as (select entity, count(*) filter (where cas) casual, count(*) filter (where not cas and ((regexp_matches(c, '^[A-Z]') and regexp_matches(c, '\\.\\s*$')) or length(c) > 200)) formal from k group by entity)
select entity, casual, formal, case when casual + formal = 0 then 'mixed' when casual / (casual + formal) > .65 then 'casual' when casual / (casual + formal) < .35 then 'formal' else 'mixed' end formality from g""")
def entity_formality(spark, d):
    return pr.formality(load_messages(spark, d))


@add("profiles_incremental", with_msg("select lower(sender) entity, count(*) message_count, round(avg(length(content)), 6) avg_length from msg where sender <> '' group by 1"))
def profiles_incremental(spark, d):
    m = load_messages(spark, d).where("sender <> ''")
    part = lambda rows: rows.groupBy(F.lower("sender").alias("entity")).agg(F.count("*").alias("message_count"), F.avg(F.length("content")).alias("avg_length"))
    return pr.merged(part(m.where("id % 3 = 0")), part(m.where("id % 3 <> 0"))).select("entity", "message_count", F.round("avg_length", 6).alias("avg_length"))


@add("resolve_entity", with_msg("select entity from (select distinct lower(trim(sender)) entity from msg where trim(sender) <> '') where contains(entity, 'bram') order by (entity <> 'bram')::int, entity limit 1"))
def resolve_entity(spark, d):
    return pr.resolve(load_messages(spark, d).select(F.lower(F.trim("sender")).alias("entity")).where("entity <> ''").distinct(), "bram")


@add("telemetry_recent", "select event_id, event_type from events where event_type in ('error', 'signup') and ts > (select max(ts) - interval 24 hours from events)")
def telemetry_recent(spark, d):
    """Signals of the last day before the newest event."""
    e = table(spark, d, "events")
    cutoff = e.agg(F.max("ts") - F.expr("interval 24 hours")).first()[0]
    return e.where(F.col("event_type").isin("error", "signup") & (F.col("ts") > F.lit(cutoff).cast("timestamp_ntz"))).select("event_id", "event_type")


def _vectors(spark, d):
    v = table(spark, d, "vec_messages").where("size(embedding) = 64 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    v = v.select(F.col("message_id").alias("id"), F.col("embedding").alias("vec")).dropDuplicates(["id"])
    return v, v.orderBy("id").limit(1).first()["vec"]


def _ranked(df):
    return df.select("id", F.round("score", 6).alias("score"), "source")


@add("search_pipeline")
def search_pipeline(spark, d):
    from palimpsest.operators import search

    v, vec = _vectors(spark, d)
    m = load_messages(spark, d)
    return _ranked(search.pipeline(m, "what did Jovanka Bramholt say about the vector index", 10, v, vec, sal.surprise_index(m)))


@add("search_agentic_no_llm")
def search_agentic_no_llm(spark, d):
    from palimpsest.operators import search

    v, vec = _vectors(spark, d)
    return _ranked(search.multi_round(load_messages(spark, d), "what did Jovanka Bramholt say about the vector index", 10, v, vec))


@add("rerank_fused")
def rerank_fused(spark, d):
    from palimpsest.operators import search

    v, vec = _vectors(spark, d)
    return _ranked(search.pipeline(load_messages(spark, d), "the retry queue and the write lock", 10, v, vec, rerank=search.lexical_rerank))


@add("scent_trail")
def scent_trail(spark, d):
    from palimpsest.operators import search

    m = load_messages(spark, d)
    return _ranked(search.scent_trail(m, "retry queue", search.hybrid(m, "retry queue", limit=20)))


@add("entity_focused", f"""with {MSG}, docs as (select id, directive, sender, regexp_extract_all(strip_accents(lower(concat_ws(' ', content, sender, recipient, category, modality))), '[\\p{{L}}\\p{{N}}]+') t from msg), corpus as (select count(*) n, avg(len(t)) a from docs),
terms as (select * from (values ('felka'), ('brammont'), ('say'), ('budget')) x(term)), freq as (select id, term, len(list_filter(t, lambda x: x = term)) tf, len(t) dl from docs, terms where list_contains(t, term)), dfs as (select term, count(*) df from freq group by term),
scored as (select id, sum(greatest(1e-6, ln((n - df + .5) / (df + .5))) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * dl / a))) b from freq join dfs using (term), corpus group by id),
best as (select id, b from scored join docs using (id) where not directive and lower(trim(sender)) = 'felka brammont' order by round(b, 9) desc, id::varchar limit 8)
select id, round(case when max(b) over () = min(b) over () then 1 else (b - min(b) over ()) / (max(b) over () - min(b) over ()) end, 6) score from best""")
def entity_focused(spark, d):
    from palimpsest.operators import search

    return search.entity_focused(load_messages(spark, d), "what did Felka Brammont say about the budget", 8).select("id", F.round("score", 6).alias("score"))
