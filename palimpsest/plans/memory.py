"""Queries over the message view, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import lexicon as L
from palimpsest.operators import fusion, keyword_search as kw, relational as rel, temporal as tm, vector_search as vs
from palimpsest.plans.registry import Registry
from palimpsest.runtime import table
from palimpsest.sources.messages import load_messages

registry = Registry()
add = registry.add

MSG = """msg as (select distinct id, coalesce(content, '') content, coalesce(sender, '') sender, coalesce(recipient, '') recipient, coalesce("timestamp", '') ts,
  coalesce(category, '') category, coalesce(modality, '') modality, coalesce(directive, false) directive, coalesce(metadata, '{}') metadata from messages)"""
ALL = "id, content, sender, recipient, ts, category, modality, directive, metadata"
WHO = "Jovanka Bramholt"


def with_msg(sql: str) -> str:
    return f"with {MSG} {sql}"


@add("message_lookup", with_msg(f"select {ALL} from msg where id in (1, 77, 4242)"))
def message_lookup(spark, d):
    return load_messages(spark, d).where(F.col("id").isin(1, 77, 4242))


@add("messages_by_sender", with_msg(f"select id, content, ts from msg where sender = '{WHO}'"))
def messages_by_sender(spark, d):
    return load_messages(spark, d, f"sender = '{WHO}'").select("id", "content", "ts")


@add("messages_in_range", with_msg("select id, ts from msg where ts >= '2024-03-01' and ts <= '2024-06-30'"))
def messages_in_range(spark, d):
    return load_messages(spark, d, "timestamp >= '2024-03-01' and timestamp <= '2024-06-30'").select("id", "ts")


@add("distinct_senders", with_msg("select distinct sender from msg where sender <> ''"))
def distinct_senders(spark, d):
    return rel.senders(load_messages(spark, d))


@add("message_count", with_msg("select count(*) n, count(*) filter (where directive) directives from msg"))
def message_count(spark, d):
    return load_messages(spark, d).agg(F.count("*").alias("n"), F.count_if("directive").alias("directives"))


@add("known_entities", with_msg("select distinct entity from (select lower(sender) entity from msg union select lower(recipient) from msg) where entity not in ('', 'self')"))
def known_entities(spark, d):
    return rel.known_entities(load_messages(spark, d))


CONTACTS = f"""contacts as (select name, count(*) cnt, max(ts) last_ts from (
  select lower(recipient) name, ts from msg where lower(sender) = lower('{WHO}') and recipient <> ''
  union all select lower(sender), ts from msg where lower(recipient) = lower('{WHO}') and sender <> '') group by name)"""


@add("contact_union_counts", f"with {MSG}, {CONTACTS} select * from contacts")
def contact_union_counts(spark, d):
    return rel.contact_counts(load_messages(spark, d), WHO)


@add("dunbar", f"""with {MSG}, {CONTACTS} select name, cnt, last_ts, round(cnt / (select max(cnt) from contacts), 3) strength,
  case when cnt / (select max(cnt) from contacts) > .6 then 'intimate' when cnt / (select max(cnt) from contacts) > .3 then 'close' when cnt / (select max(cnt) from contacts) > .1 then 'friend' else 'acquaintance' end layer from contacts""")
def dunbar(spark, d):
    return rel.contact_layers(load_messages(spark, d), WHO)


@add("senders_having_min", with_msg("select sender, count(*) cnt from msg where sender <> '' group by sender having count(*) >= 5"))
def senders_having_min(spark, d):
    return rel.senders_with(load_messages(spark, d), 5)


@add("sender_diversity", with_msg("select count(distinct sender) n from msg where sender <> ''"))
def sender_diversity(spark, d):
    return load_messages(spark, d).where("sender <> ''").agg(F.count_distinct("sender").alias("n"))


@add("top_sender", with_msg("select sender, count(*) cnt from msg where sender <> '' group by sender order by cnt desc, sender limit 1"))
def top_sender(spark, d):
    return rel.top_sender(load_messages(spark, d))


@add("page_offset", with_msg("select id, content from msg order by id desc limit 20 offset 40"))
def page_offset(spark, d):
    return rel.page(load_messages(spark, d), 20, 40).select("id", "content")


@add("directive_list", with_msg("select id, content from msg where directive"))
def directive_list(spark, d):
    return load_messages(spark, d, "directive").select("id", "content")


@add("metadata_json_extract", with_msg("select id, case when json_valid(metadata) then metadata ->> '$.client' end client, case when json_valid(metadata) then metadata ->> '$.tz' end tz from msg"))
def metadata_json_extract(spark, d):
    return load_messages(spark, d).select("id", rel.metadata_field("client").alias("client"), rel.metadata_field("tz").alias("tz"))


@add("any_derived_rows", "select exists(select 1 from fact_timeline) or exists(select 1 from message_clusters) present")
def any_derived_rows(spark, d):
    some = [table(spark, d, t).limit(1).select(F.lit(1).alias("x")) for t in ("fact_timeline", "message_clusters")]
    return some[0].unionByName(some[1]).agg((F.count("*") > 0).alias("present"))


@add("high_water_delta", with_msg("select id from msg where id > (select max(message_id) * 9 // 10 from vec_messages)"))
def high_water_delta(spark, d):
    mark = table(spark, d, "vec_messages").agg(F.expr("max(message_id) * 9 div 10")).first()[0]
    return load_messages(spark, d).where(F.col("id") > mark).select("id")


@add("median_length_stats", with_msg("""select count(*) n, round(avg(length(content)), 6) mean, min(length(content)) least, max(length(content)) most,
  (select length(content) from msg order by length(content) limit 1 offset (select count(*) // 2 from msg)) median from msg"""))
def median_length_stats(spark, d):
    return rel.median_row(load_messages(spark, d).select(F.length("content").alias("n_chars")), "n_chars")


FORGOTTEN = f"forgotten as (select id from msg where sender = '{WHO}')"


def _forgotten(m):
    return m.where(F.col("sender") == WHO).select("id")


@add("forget_cascade_facts", f"with {MSG}, {FORGOTTEN} select id from fact_timeline where source_message_id is null or source_message_id not in (select id from forgotten)")
def forget_cascade_facts(spark, d):
    ids = _forgotten(load_messages(spark, d))
    return rel.forget(table(spark, d, "fact_timeline"), "source_message_id", ids).select("id")


@add("forget_cascade_clusters", f"with {MSG}, {FORGOTTEN} select message_id, cluster_id from message_clusters where message_id not in (select id from forgotten)")
def forget_cascade_clusters(spark, d):
    return rel.forget(table(spark, d, "message_clusters"), "message_id", _forgotten(load_messages(spark, d))).select("message_id", "cluster_id")


@add("orphan_centroid_purge", f"with {MSG}, {FORGOTTEN} select cluster_id from cluster_centroids where cluster_id in (select cluster_id from message_clusters where message_id not in (select id from forgotten))")
def orphan_centroid_purge(spark, d):
    left = rel.forget(table(spark, d, "message_clusters"), "message_id", _forgotten(load_messages(spark, d)))
    return table(spark, d, "cluster_centroids").join(left.select("cluster_id"), "cluster_id", "left_semi").select("cluster_id")


SESSIONS = "summaries as (select category sid, list(id) message_ids from msg where category <> '' group by category)"


@add("summary_explode_delete", f"with {MSG}, {FORGOTTEN}, {SESSIONS} select sid from summaries where sid not in (select sid from (select sid, unnest(message_ids) id from summaries) where id in (select id from forgotten))")
def summary_explode_delete(spark, d):
    m = load_messages(spark, d)
    summaries = m.where("category <> ''").groupBy(F.col("category").alias("sid")).agg(F.collect_list("id").alias("message_ids"))
    return rel.forget_summaries(summaries, _forgotten(m)).select("sid")


# --- keyword retrieval -------------------------------------------------------------------------------------------

QUERY = "vector index of the write lock"
TERMS = sorted(kw.query_terms(QUERY))
DOCS = f"""docs as (select {ALL}, regexp_extract_all(strip_accents(lower(concat_ws(' ', content, sender, recipient, category, modality))), '[\\p{{L}}\\p{{N}}]+') t from msg),
corpus as (select count(*) n, avg(len(t)) a from docs),
terms as (select * from (values {', '.join(f"('{t}', {q})" for t, q in kw.query_terms(QUERY).items())}) x(term, q)),
freq as (select id, term, q, len(list_filter(t, lambda x: x = term)) tf, len(t) dl from docs, terms where list_contains(t, term)),
dfs as (select term, count(*) df from freq group by term),
scored as (select id, sum(q * greatest(1e-6, ln((n - df + .5) / (df + .5))) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * dl / a))) bm25 from freq join dfs using (term), corpus group by id)"""
BM25 = f"with {MSG}, {DOCS}"


def top_sql(where: str, k: int, pre: str = BM25, extra: str = "") -> str:
    return f"""{pre}, best as (select id, bm25, ts, sender{extra} from scored join docs using (id) where {where} order by round(bm25, 9) desc, id::varchar limit {k})
select id, round(bm25, 6) bm25, round(case when max(bm25) over () = min(bm25) over () then 1 else (bm25 - min(bm25) over ()) / (max(bm25) over () - min(bm25) over ()) end, 6) score from best"""


def _rounded(df):
    return df.select("id", F.round("bm25", 6).alias("bm25"), F.round("score", 6).alias("score"))


@add("bm25_topk", top_sql("not directive", 20))
def bm25_topk(spark, d):
    return _rounded(kw.search(load_messages(spark, d), QUERY, 20))


@add("bm25_by_sender", top_sql(f"not directive and sender = '{WHO}'", 10))
def bm25_by_sender(spark, d):
    return _rounded(kw.search_by_sender(load_messages(spark, d), QUERY, WHO, 10))


@add("bm25_in_range", f"""{BM25}, pool as (select id, bm25, ts from scored join docs using (id) where not directive order by round(bm25, 9) desc, id::varchar limit 150),
inside as (select id, bm25, case when max(bm25) over () = min(bm25) over () then 1 else (bm25 - min(bm25) over ()) / (max(bm25) over () - min(bm25) over ()) end score from pool where ts >= '2024-02-01' and ts < '2025-01-01' and ts <> '')
select id, round(bm25, 6) bm25, round(score, 6) score from inside order by round(score, 9) desc, id::varchar limit 15""")
def bm25_in_range(spark, d):
    return _rounded(kw.search_in_range(load_messages(spark, d), QUERY, "2024-02-01", "2025-01-01", 15))


@add("bm25_raw", f"{BM25} select id, round(-bm25, 6) rank from scored")
def bm25_raw(spark, d):
    return kw.scan_search(load_messages(spark, d), QUERY).select("id", F.round(-F.col("bm25"), 6).alias("rank"))


@add("bm25_index", f"{BM25} select id, round(bm25, 6) bm25 from scored")
def bm25_index(spark, d):
    postings, stats = kw.build_postings(load_messages(spark, d))
    return kw.postings_search(postings, stats, QUERY).select("id", F.round("bm25", 6).alias("bm25"))


@add("bm25_phrase", f"""with {MSG}, docs as (select id, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(concat_ws(' ', content, sender, recipient, category, modality))), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' t from msg)
select id, ((length(t) - length(replace(t, ' vector index ', ' '))) // length('vector index '))::bigint n from docs where contains(t, ' vector index ')""")
def bm25_phrase(spark, d):
    return kw.phrase_hits(kw.build_postings(load_messages(spark, d))[0], "vector index")


@add("term_stats", f"with {MSG}, t as (select id, unnest(regexp_extract_all(strip_accents(lower(content)), '[\\p{{L}}\\p{{N}}]+')) term from msg) select term, count(*) cf, count(distinct id) df from t group by term having count(distinct id) >= 50")
def term_stats(spark, d):
    t = load_messages(spark, d).select("id", F.explode(kw.tokens(F.col("content"))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    return t.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")).where("df >= 50")


@add("bm25_topk_stemmed")
def bm25_topk_stemmed(spark, d):
    """Porter stems on both sides; the query's stems are searched in stemmed documents."""
    from palimpsest.functions.stemmer import stem

    m = load_messages(spark, d)
    docs = m.withColumn("content", F.array_join(kw.stemmed(kw.tokens(F.col("content"))), " "))
    hits = kw.search(docs, " ".join(stem(w) for w in QUERY.split()), 20)
    return _rounded(hits)


# --- vectors -----------------------------------------------------------------------------------------------------

VEC = """v as (select vec_id id, list_transform(embedding, lambda x: x::double) e from embeddings), q as (select e qe from v where id = 0),
cos as (select id, round(list_cosine_similarity(e, qe), 12) c from v, q)"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _query_vector(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


@add("knn_cosine", f"with {VEC} select id, round(1 / (1 + (1 - c)), 6) score from cos order by c desc, id::varchar limit 20")
def knn_cosine(spark, d):
    return vs.nearest(_vectors(spark, d), _query_vector(spark, d), 20).select("id", vs.distance_score(F.col("cosine")).alias("score"))


@add("knn_cosine_sim", f"with {VEC} select id, round(greatest(0, least(1, c)), 6) score from cos order by c desc, id::varchar limit 20")
def knn_cosine_sim(spark, d):
    return vs.nearest(_vectors(spark, d), _query_vector(spark, d), 20).select("id", F.round(vs.similarity_score(F.col("cosine")), 6).alias("score"))


@add("knn_filtered", f"with {VEC} select id, round(c, 6) cosine from cos join embeddings on vec_id = id where label = 1 order by c desc, id::varchar limit 10")
def knn_filtered(spark, d):
    v = table(spark, d, "embeddings").where("label = 1").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return vs.nearest(v, _query_vector(spark, d), 10).select("id", F.round("cosine", 6).alias("cosine"))


@add("normalize_vectors", f"with {VEC} select id, round(e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) first, len(e) dim from v where list_sum(list_transform(e, lambda x: x * x)) > 1e-24")
def normalize_vectors(spark, d):
    return vs.normalised(_vectors(spark, d), "vec").select("id", F.round(F.col("vec")[0], 6).alias("first"), F.size("vec").alias("dim"))


@add("separation_text", with_msg("select id, case when sender = '' then '?' else sender end || ' to ' || case when recipient = '' then '?' else recipient end || ' on ' || case when ts = '' then '?' else substr(ts, 1, 10) end || ': ' || content txt from msg"))
def separation_text(spark, d):
    return load_messages(spark, d).select("id", vs.separation_text().alias("txt"))


@add("cluster_centroids", """select label cluster_id, count(*) message_count, round(avg(embedding[1]::double), 6) c0, round(avg(embedding[64]::double), 6) c63 from embeddings group by label""")
def cluster_centroids(spark, d):
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("cluster_id")).agg(
        F.count("*").alias("message_count"), F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("c0"), F.round(F.avg(F.col("embedding")[63].cast("double")), 6).alias("c63")
    )


@add("clustered_search", f"""with {VEC}, cent as (select label, list_transform(range(1, 65), lambda k: avg_k) dummy from (select label, avg(embedding[1]) avg_k from embeddings group by label)),
flat as (select label, k, avg(x) m from (select label, generate_subscripts(embedding, 1) k, unnest(embedding)::double x from embeddings) group by label, k),
cvec as (select label, list(m order by k) ce from flat group by label), near as (select label from cvec, q order by round(list_cosine_similarity(ce, qe), 12) desc, label::varchar limit 3)
select id, round(c, 6) cosine from cos join embeddings on vec_id = id where label in (select label from near) order by c desc, id::varchar limit 15""")
def clustered_search(spark, d):
    """Two stages: the three nearest centroids, then the nearest of their members."""
    v = table(spark, d, "embeddings")
    q = _query_vector(spark, d)
    mean = v.groupBy("label").agg(F.array(*(F.avg(F.col("embedding")[i].cast("double")) for i in range(64))).alias("vec"))
    near = [r["id"] for r in vs.nearest(mean, q, 3, "label").collect()]
    return vs.nearest(v.where(F.col("label").isin(near)).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), q, 15).select("id", F.round("cosine", 6).alias("cosine"))


# --- fusion ------------------------------------------------------------------------------------------------------

VMSG = """vm as (select message_id id, any_value(list_transform(embedding, lambda x: x::double)) e from vec_messages where embedding is not null and len(embedding) = 64
  and list_sum(list_transform(embedding, lambda x: case when isfinite(x) then 0 else 1 end)) = 0 and list_max(list_transform(embedding, lambda x: abs(x))) > 0 group by message_id),
vq as (select e qe from vm where id = (select min(id) from vm)), vcos as (select id, round(list_cosine_similarity(e, qe), 12) c from vm, vq)"""
LISTS = f"""{BM25}, {VMSG}, l1 as (select id, row_number() over (order by round(bm25, 9) desc, id::varchar) r from scored join docs using (id) where not directive qualify r <= 200),
l2 as (select id, row_number() over (order by c desc, id::varchar) r from vcos join docs using (id) where not directive qualify r <= 200)"""


def _lists(spark, d):
    m = load_messages(spark, d)
    words = kw.best(kw.scan_search(m, QUERY, keep=~F.col("directive")).withColumn("bm25", F.round("bm25", 9)), 200)
    v = table(spark, d, "vec_messages").where("size(embedding) = 64 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)").select(F.col("message_id").alias("id"), F.col("embedding").alias("vec")).dropDuplicates(["id"])
    q = v.orderBy("id").limit(1).first()["vec"]
    near = vs.nearest(v.join(m.where("directive").select("id"), "id", "left_anti").join(m.select("id"), "id", "left_semi"), q, 200)
    return m, fusion.ranked(words, "bm25"), fusion.ranked(near, "cosine")


@add("rrf_two_lists", f"{LISTS} select id, round(sum(s), 8) rrf_score, string_agg(n, '+' order by n) source from (select id, 1.0 / (60 + r) s, 'fts' n from l1 union all select id, 1.0 / (60 + r), 'vec' from l2) group by id")
def rrf_two_lists(spark, d):
    _, a, b = _lists(spark, d)
    return fusion.reciprocal_rank_fusion([("fts", a, 1.0), ("vec", b, 1.0)])


HYBRID = f"""{LISTS}, fused as (select id, round(sum(s), 8) rrf_score, string_agg(n, '+' order by n) source from (select id, 1.2 / (60 + r) s, 'fts' n from l1 union all select id, .8 / (60 + r), 'vec' from l2) group by id),
pool as (select id, rrf_score, source from fused order by rrf_score desc, id::varchar limit 30)"""


@add("hybrid_topk", f"{HYBRID} select id, rrf_score, source, content, sender from pool join docs using (id)")
def hybrid_topk(spark, d):
    """Flagship: keyword and vector lists of 200 fused by weighted reciprocal ranks; the pool of 30 is then joined to its messages."""
    return _pool(spark, d).select("id", "rrf_score", "source", "content", "sender")


def _pool(spark, d, k=30):
    m, a, b = _lists(spark, d)
    fused = fusion.reciprocal_rank_fusion([("fts", a, 1.2), ("vec", b, 0.8)])
    return m.join(F.broadcast(fused.orderBy(F.desc("rrf_score"), F.col("id").cast("string")).limit(k)), "id")


@add("minmax_norm", f"{HYBRID} select id, round(case when max(rrf_score) over () = min(rrf_score) over () then .5 else (rrf_score - min(rrf_score) over ()) / (max(rrf_score) over () - min(rrf_score) over ()) end, 6) norm from pool")
def minmax_norm(spark, d):
    return fusion.normalised_or_half(_pool(spark, d), "rrf_score", "norm").select("id", F.round("norm", 6).alias("norm"))


@add("minmax_per_source", f"{HYBRID} select id, source, round(case when max(rrf_score) over w = min(rrf_score) over w then .5 else (rrf_score - min(rrf_score) over w) / (max(rrf_score) over w - min(rrf_score) over w) end, 6) norm from pool window w as (partition by source)")
def minmax_per_source(spark, d):
    return fusion.normalised_or_half(_pool(spark, d), "rrf_score", "norm", ("source",)).select("id", "source", F.round("norm", 6).alias("norm"))


@add("fuse_weighted", f"""{HYBRID}, x as (select id, rrf_score o, length(content)::double r from pool join docs using (id))
select id, round(.6 * case when max(r) over () = min(r) over () then .5 else (r - min(r) over ()) / (max(r) over () - min(r) over ()) end + .4 * case when max(o) over () = min(o) over () then .5 else (o - min(o) over ()) / (max(o) over () - min(o) over ()) end, 6) fused_score from x""")
def fuse_weighted(spark, d):
    p = _pool(spark, d).withColumn("rerank", F.length("content").cast("double"))
    return fusion.weighted_fusion(p, "rerank", "rrf_score").select("id", F.round("fused_score", 6).alias("fused_score"))


@add("dedup_id_prefix", f"""{BM25}, p as (select *, row_number() over (order by round(bm25, 9) desc, id::varchar) pos from scored join docs using (id)), x as (select * from p where pos <= 300 and not directive),
c as (select *, row_number() over (partition by substr(content, 1, 200) order by pos) k from x) select id, round(bm25, 6) score from c where k = 1""")
def dedup_id_prefix(spark, d):
    from pyspark.sql import Window

    p = kw.best(kw.scan_search(load_messages(spark, d), QUERY).withColumn("o", F.round("bm25", 9)), 300, "o")
    p = p.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("o"), F.col("id").cast("string")))).withColumn("score", F.col("bm25"))
    return fusion.first_by_id_and_prefix(p).select("id", F.round("score", 6).alias("score"))


@add("session_diversity_cap", f"""{HYBRID}, x as (select id, category, rrf_score, row_number() over (partition by category order by rrf_score desc, id::varchar) n from pool join docs using (id))
select id, (n > 2)::int overflow from x order by overflow, rrf_score desc, id::varchar limit 15""")
def session_diversity_cap(spark, d):
    p = _pool(spark, d).withColumn("score", F.col("rrf_score"))
    return fusion.diversity_cap(p, 2, 15).select("id", "overflow")


@add("recall_budget", f"{HYBRID}, x as (select id, sum(length(content)) over (order by rrf_score desc, id::varchar rows unbounded preceding)::bigint upto from pool join docs using (id)) select id, upto from x where upto <= 2000")
def recall_budget(spark, d):
    p = _pool(spark, d).withColumn("score", F.col("rrf_score"))
    return fusion.within_budget(p, 2000).select("id", "upto")


# --- time --------------------------------------------------------------------------------------------------------


@add("timeline_entity", with_msg(f"select id, ts from msg where ts <> '' and (lower(sender) = lower('{WHO}') or lower(recipient) = lower('{WHO}')) and ts >= '2024-02-01' and ts < '2024-07-01'"))
def timeline_entity(spark, d):
    return tm.timeline(load_messages(spark, d), WHO, "2024-02-01", "2024-06-30").select("id", "ts")


@add("temporal_filter_backfill", f"""{BM25}, hits as (select id, ts from scored join docs using (id) where ts >= '2024-05-01' and ts < '2024-05-11' and bm25 > 3), rest as (select id, ts from msg where ts >= '2024-05-01' and ts < '2024-05-11' and id not in (select id from hits))
select id, hit from (select id, ts, 1 hit from hits union all select id, ts, 0 from rest) order by hit desc, ts, id limit 40""")
def temporal_filter_backfill(spark, d):
    m = load_messages(spark, d)
    hits = kw.scan_search(m, QUERY).where("bm25 > 3 and ts >= '2024-05-01' and ts < '2024-05-11'")
    return tm.backfilled(hits, tm.timeline(m, None, "2024-05-01", "2024-05-10"), 40).select("id", "hit")


NAIVE = r"""nv as (select id, ts, try_cast(regexp_replace(trim(ts), '([+-]\d{2}:\d{2}|Z)$', '') as timestamp) tm from msg
  where regexp_matches(regexp_replace(trim(ts), '([+-]\d{2}:\d{2}|Z)$', ''), '^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$'))"""
EPISODES = f"""with {MSG}, {NAIVE}, ok as (select * from nv where tm is not null), g as (select *, case when epoch_us(tm) - lag(epoch_us(tm)) over (order by tm, id) <= 21600000000 then 0 else 1 end new from ok),
ep as (select id, ts, tm, sum(new) over (order by tm, id rows unbounded preceding)::bigint episode from g)"""


@add("episodes", f"{EPISODES} select id, episode from ep")
def episodes(spark, d):
    return tm.episodes(load_messages(spark, d)).select("id", "episode")


@add("episode_table", f"{EPISODES} select episode, count(*) message_count, strftime(min(tm), '%Y-%m-%d %H:%M:%S') start_at, strftime(max(tm), '%Y-%m-%d %H:%M:%S') end_at from ep group by episode")
def episode_table(spark, d):
    t = tm.episode_table(tm.episodes(load_messages(spark, d)))
    return t.select("episode", "message_count", F.date_format("start_at", "yyyy-MM-dd HH:mm:ss").alias("start_at"), F.date_format("end_at", "yyyy-MM-dd HH:mm:ss").alias("end_at"))


@add("episode_expand", EPISODES.replace("with ", "with ", 1) + f""", {DOCS}, hits as (select id, bm25 score from scored order by round(bm25, 9) desc, id::varchar limit 5),
best as (select episode, max(score) score from hits join ep using (id) group by episode order by round(max(score), 9) desc, episode limit 3)
select id, round(score, 6) score from hits union all select ep.id, round(best.score * .6, 6) from ep join best using (episode) where ep.id not in (select id from hits)""")
def episode_expand(spark, d):
    m = load_messages(spark, d)
    hits = kw.best(kw.scan_search(m, QUERY).withColumn("score", F.round("bm25", 9)), 5, "score")
    return tm.expand(hits, tm.episodes(m)).select("id", F.round("score", 6).alias("score"))


LAND = "case " + " ".join(f"when regexp_matches(content, '(?i)\\b(?:{w})\\b') then '{k}'" for k, w in L.LANDMARKS.items()) + " end"
LANDW = "case " + " ".join(f"when regexp_matches(content, '(?i)\\b(?:{w})\\b') then regexp_extract(content, '(?i)\\b(?:{w})\\b')" for k, w in L.LANDMARKS.items()) + " end"


@add("landmarks", with_msg(f"select id, {LAND} event_type from msg where ts <> '' and {LAND} is not null"))
def landmarks(spark, d):
    return tm.landmarks(load_messages(spark, d)).select("id", "event_type")


@add("landmark_context")
def landmark_context(spark, d):
    return tm.landmarks(load_messages(spark, d))


@add("entity_timelines", with_msg("select distinct e entity, id from (select lower(sender) e, id from msg union all select lower(recipient), id from msg) where e <> ''"))
def entity_timelines(spark, d):
    return tm.entity_timeline(load_messages(spark, d)).select("entity", "id")
