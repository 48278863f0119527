"""Queries of this subpackage and the SQL that checks them."""

from pyspark.sql import functions as F

from palimpsest.plans.registry import Registry
from palimpsest.runtime import table

registry = Registry()

CHAIN_SQL = """
with recursive lines as (
  select distinct sessionId s, uuid u, coalesce(parentUuid, '') p, lower(trim(type)) kind, message.content c
  from sample_real_claude_code_transcript
  where uuid is not null and uuid <> '' and sessionId is not null and not coalesce(isSidechain, false)
), texts as (
  select s, u, p, kind, case
    when regexp_matches(c, '^\\s*\\[') and json_valid(c) then len(list_filter(from_json(c, '[{"type":"VARCHAR","text":"VARCHAR"}]'),
      lambda b: b.type = 'text' and coalesce(regexp_matches(b.text, '\\S'), false))) > 0
    else coalesce(regexp_matches(c, '\\S'), false) end has_text
  from lines
), shape as (
  select s, count(*) n, count(*) filter (where p = '') roots, count(distinct p) parents,
    count(*) filter (where p <> '' and not exists (select 1 from lines x where x.s = l.s and x.u = l.p)) lost
  from lines l group by s
), ok as (select s, n from shape where roots = 1 and parents = n and lost = 0),
walk as (
  select t.s, t.u, t.kind, t.has_text, 1 seq from texts t join ok on ok.s = t.s where t.p = ''
  union all
  select t.s, t.u, t.kind, t.has_text, w.seq + 1 from walk w join texts t on t.s = w.s and t.p = w.u
), whole as (select w.s from walk w join ok on ok.s = w.s group by w.s, ok.n having count(*) = ok.n),
turns as (
  select s, u, kind, row_number() over v turn_no, lead(kind) over v after
  from walk where s in (select s from whole) and kind in ('user', 'assistant') and has_text window v as (partition by s order by seq)
)
select s session_id, turn_no::int turn_no, u uuid from turns
where s not in (select s from turns where kind = 'user' and after is distinct from 'assistant')
"""

LEAK_SQL = """
with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+') w from eval_items where item_text is not null),
dg as (select doc_id, array_to_string(w[k:k + 9], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 8)) k from d where len(w) >= 10)),
ig as (select distinct item_id, array_to_string(w[k:k + 9], ' ') g from (select item_id, w, unnest(range(1, len(w) - 8)) k from i where len(w) >= 10))
select distinct doc_id, item_id from dg join ig using (g)
"""


@registry.add("p5_found", CHAIN_SQL)
def p5_found(spark, folder):
    from palimpsest.llm.conversations import conversations

    return conversations(table(spark, folder, "sample_real_claude_code_transcript")).select("session_id", "turn_no", "uuid")


@registry.add("p9_found", LEAK_SQL)
def p9_found(spark, folder):
    from palimpsest.llm.leakage import leaked_documents

    return leaked_documents(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


@registry.add("p9_removed")
def p9_removed(spark, folder):
    """Length of each document that loses leaked spans, before and after."""
    from palimpsest.llm.leakage import find_leaks, remove_leaks

    docs = table(spark, folder, "documents").select("doc_id", "text", F.length("text").alias("chars"))
    leaks = find_leaks(docs, table(spark, folder, "eval_items"))
    return remove_leaks(docs, leaks).where(F.length("text") < F.col("chars")).select("doc_id", "chars", F.length("text").alias("chars_left"))


@registry.add("p8_containers")
def p8_containers(spark, folder):
    from palimpsest.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents"))


@registry.add("p10_found")
def p10_found(spark, folder):
    from palimpsest.llm.language import mislabelled

    return mislabelled(table(spark, folder, "documents")).select("doc_id", "para_no", "lang_found").distinct()


@registry.add("p10_documents")
def p10_documents(spark, folder):
    """Each document's main language with its confidence."""
    from palimpsest.llm.language import document_languages, language_parts

    return document_languages(language_parts(table(spark, folder, "documents")))


def _index_folder(spark) -> str:
    import os
    import uuid

    from palimpsest.runtime import checkpoint_dir

    return os.path.join(checkpoint_dir(spark), f"dedup-{uuid.uuid4().hex}")


@registry.add("p1_found")
def p1_found(spark, folder):
    """All messages as one batch, the first load of an index."""
    from palimpsest.llm.dedup import resolve

    return resolve(table(spark, folder, "messages")).cases


@registry.add("p1_incremental")
def p1_incremental(spark, folder):
    """The same cases through the index: the history as one load, then the last batch against all accepted before it."""
    from palimpsest.llm.dedup import in_batches

    rows = table(spark, folder, "messages")
    last = rows.agg(F.max("batch_no")).first()[0]
    return in_batches(rows.withColumn("late", (F.col("batch_no") == F.lit(last)).cast("int")), _index_folder(spark), "late")


@registry.add("p7_found")
def p7_found(spark, folder):
    from palimpsest.llm.pii import find_pii

    return find_pii(table(spark, folder, "messages"), table(spark, folder, "entity_profiles")).select("message_id", "kind", "found_text").distinct()


@registry.add("p7_masked")
def p7_masked(spark, folder):
    """All messages with typed placeholders."""
    from palimpsest.llm.pii import mask_pii

    return mask_pii(table(spark, folder, "messages").dropDuplicates(["id"]), table(spark, folder, "entity_profiles")).select("id", "content")


@registry.add("p3_found")
def p3_found(spark, folder):
    from palimpsest.llm.clusters import spectral_clusters

    return spectral_clusters(table(spark, folder, "vec_messages"))


@registry.add("p3_described")
def p3_described(spark, folder):
    """Each cluster's size and most typical messages, in place of the outdated centroids."""
    from palimpsest.llm.clusters import describe, spectral_clusters

    vectors = table(spark, folder, "vec_messages")
    return describe(spectral_clusters(vectors), vectors).select("cluster_key", "message_count", "typical")


@registry.add("p4_found")
def p4_found(spark, folder):
    from palimpsest.llm.vectors import near_pairs

    return near_pairs(table(spark, folder, "vec_messages")).select("message_id_a", "message_id_b")


@registry.add("p4_nearest")
def p4_nearest(spark, folder):
    """The five most similar messages of every message whose id is divisible by 100, against all."""
    from palimpsest.llm.vectors import nearest

    vectors = table(spark, folder, "vec_messages")
    return nearest(vectors, vectors.where("message_id % 100 = 0").select(F.col("message_id").alias("id")))
