import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as some

from palimpsest.functions.stemmer import stem
from palimpsest.operators import consolidation as co, fusion, ingest as ing, keyword_search as kw, relational as rel, salience as sal, temporal as tm, vector_search as vs
from palimpsest.sources.messages import MESSAGE, messages_view
from palimpsest.streaming import streams as st


def messages(spark, rows):
    full = [(i, c, s, r, t, "", "", False, "{}") for i, c, s, r, t in rows]
    return spark.createDataFrame(full, MESSAGE)


def test_view_fills_defaults_and_drops_repeats(spark):
    raw = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "b", None)], "id bigint, content string, sender string")
    out = {r["id"]: r for r in messages_view(raw).collect()}
    assert out[1]["content"] == "" and out[2]["sender"] == "" and out[2]["metadata"] == "{}" and out[1]["directive"] is False


def test_bm25_scan_and_index_agree(spark):
    rng = random.Random(1)
    words = "cache index lock queue vector garden".split()
    m = messages(spark, [(i, " ".join(rng.choices(words, k=rng.randint(0, 12))), "", "", "") for i in range(60)])
    a = {r["id"]: r["bm25"] for r in kw.scan_search(m, "vector cache cache").collect()}
    p, s = kw.build_postings(m)
    b = {r["id"]: r["bm25"] for r in kw.postings_search(p, s, "vector cache cache").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    assert kw.scan_search(m, "...").count() == 0 and kw.search(m.limit(0), "cache", 5).count() == 0


def test_search_scales_best_to_one(spark):
    m = messages(spark, [(1, "cache", "", "", ""), (2, "cache cache and more", "", "", ""), (3, "other", "", "", "")])
    scores = [r["score"] for r in kw.search(m, "cache", 5).collect()]
    assert max(scores) == 1.0 and min(scores) == 0.0


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"), ("adjustable", "adjust"), ("sky", "sky"), ("controlling", "control"), ("é", "é")])
def test_stems(word, want):
    assert stem(word) == want


@settings(max_examples=5, deadline=None)
@given(some.lists(some.lists(some.integers(1, 30), unique=True, max_size=10), min_size=1, max_size=3))
def test_rrf_matches_its_formula(spark, lists):
    dfs = [(f"l{k}", spark.createDataFrame([(i, r + 1) for r, i in enumerate(ids)], "id bigint, rank int"), 1.0) for k, ids in enumerate(lists)]
    got = {r["id"]: (r["rrf_score"], r["source"]) for r in fusion.reciprocal_rank_fusion(dfs).collect()}
    want = {}
    for k, ids in enumerate(lists):
        for r, i in enumerate(ids):
            s, n = want.get(i, (0.0, []))
            want[i] = (s + 1 / (61 + r), [*n, f"l{k}"])
    assert got.keys() == want.keys()
    assert all(abs(got[i][0] - want[i][0]) < 1e-7 and got[i][1] == "+".join(want[i][1]) for i in want)


def test_episodes_match_the_sequential_fold(spark):
    rng = random.Random(4)
    t = datetime(2024, 1, 1)
    rows = []
    for i in range(120):
        t += timedelta(seconds=rng.choice([60, 3600, 6 * 3600, 6 * 3600 + 1, 90_000]))
        rows.append((i, "c", "a", "b", t.isoformat() + rng.choice(["", "Z", "+02:00"])))
    rows += [(500, "c", "a", "b", "soon"), (501, "c", "a", "b", "")]
    got = {r["id"]: r["episode"] for r in tm.episodes(messages(spark, rows)).collect()}
    want, e, last = {}, 1, None
    for i, *_, s in rows[:120]:
        at = datetime.fromisoformat(s[:19])
        e += last is not None and (at - last).total_seconds() > 6 * 3600
        want[i], last = e, at
    assert got == want


def test_surprise_matches_the_sequential_fold(spark):
    rng = random.Random(2)
    words = ["Paris", "quit", "$40", "2024-05-06", "moved", "the plan is quite good today", "15%"]
    m = messages(spark, [(i, " ".join(rng.choices(words, k=4)), "", "", f"2024-01-{i % 28 + 1:02d}") for i in range(50)])
    facts = {r["id"]: (r["ts"], set(r["f"])) for r in m.select("id", "ts", sal.fact_fingerprints().alias("f")).collect()}
    seen, want = set(), {}
    for i in sorted(facts, key=lambda i: (facts[i][0], i)):
        want[i] = len(facts[i][1] - seen)
        seen |= facts[i][1]
    got = {r["message_id"]: r["new_fact_count"] for r in sal.surprise_index(m).collect()}
    assert got == want


def test_salience_of_blank_and_noise(spark):
    s = {r["id"]: r["s"] for r in messages(spark, [(1, "  ", "", "", ""), (2, "ok!!", "", "", ""), (3, "We raised $5,000 on March 3 and moved to Berlin, amazing!", "", "", "")]).select("id", sal.salience().alias("s")).collect()}
    assert s[1] == 0.0 and s[2] < 0.05 < s[3]


def test_chain_supersedes_only_where_the_rule_says(spark):
    m = messages(spark, [(1, "we switched from Postgres to MySQL today", "a", "", "2024-01-01"), (2, "It costs $5/month", "a", "", "2024-01-02"), (3, "It costs $5/month", "a", "", "2024-01-03"), (4, "It costs $9/month", "a", "", "2024-01-04")])
    c = [(r["subject"], r["fact"], r["status"]) for r in co.supersessions(co.changes(m)).orderBy("subject", "seq").collect()]
    assert c == [("database", "Postgres", "superseded"), ("database", "MySQL", "active"), ("pricing_month", "$5", "active"), ("pricing_month", "$5", "superseded"), ("pricing_month", "$9", "active")]


def test_nearest_skips_unusable_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (10, [2.0, 0.0]), (6, [0.0, 3.0])], "id bigint, vec array<double>")
    assert [r["id"] for r in vs.nearest(v, [5.0, 0.0], 2).collect()] == [1, 10]
    assert {r["id"] for r in vs.normalised(v, "vec").collect()} == {1, 4, 10, 6}


def test_duplicate_ladder(spark):
    rows = [("a b", "general", None, 0.9), ("cost is 5", "general", "cost is 6", 0.95), ("same", "general", "same", 0.95), ("same", "correction", "same", 0.95), ("big cat", "general", "a big cat sat", 0.5), ("x y z w v", "general", "x y z w q", 0.5), ("u", "general", "v", 0.5)]
    df = spark.createDataFrame(rows, "fact string, category string, existing string, similarity double")
    assert [r["action"] for r in ing.resolve_duplicate(df).collect()] == ["ADD", "ADD", "SKIP", "UPDATE", "SKIP", "UPDATE", "ADD"]


def test_forget_and_contacts(spark):
    m = messages(spark, [(1, "a", "Ann", "bob", "1"), (2, "b", "bob", "ANN", "2"), (3, "c", "ann", "cy", "3")])
    assert {(r["name"], r["cnt"], r["layer"]) for r in rel.contact_layers(m, "Ann").collect()} == {("bob", 2, "intimate"), ("cy", 1, "close")}
    derived = spark.createDataFrame([(1, "x"), (2, "y")], "message_id bigint, v string")
    assert [r["v"] for r in rel.forget(derived, "message_id", m.where("id = 1")).collect()] == ["y"]


def test_debounce_restarts_on_acceptance(spark):
    t = datetime(2024, 1, 1)
    e = spark.createDataFrame([(i, t + timedelta(seconds=s), 1) for i, s in enumerate([0, 1.5, 2.5, 3.0, 4.6])], "event_id bigint, ts timestamp, user_id bigint")
    got = st.debounced(e, "user_id", "ts", 2, "event_id bigint, ts timestamp, user_id bigint").orderBy("event_id").collect()
    assert [r["event_id"] for r in got] == [0, 2, 4]


def test_chunks_keep_every_paragraph(spark):
    text = "\n\n".join("p" * n for n in (5, 30, 2, 2, 40, 1))
    got = [r["text"] for r in ing.chunked(spark.createDataFrame([(1, text)], "doc bigint, text string"), 40).orderBy("chunk").collect()]
    assert "\n\n".join(got) == text and all(len(x) <= 40 for x in got)


def test_long_texts_keep_their_tail(spark):
    text = "\n\n".join(f"{n:030d}" for n in range(50))
    got = [r["text"] for r in ing.chunked(spark.createDataFrame([(1, text)], "doc bigint, text string"), 40).orderBy("chunk").collect()]
    assert len(got) == 50 and "\n\n".join(got) == text


def test_scan_holds_the_watermark_while_files_are_left(spark):
    f = spark.createDataFrame([(f"s{i}", datetime(2024, 1, i + 1)) for i in range(5)], "session_id string, mtime timestamp_ntz")
    taken, mark = st.stale_scan(f, "2024-01-01 12:00:00", 3)
    assert [r["session_id"] for r in taken.collect()] == ["s1", "s2", "s3"] and mark.first()["watermark"] == datetime(2024, 1, 1, 12)
    assert st.stale_scan(f, "2024-01-01 12:00:00", 9)[1].first()["watermark"] == datetime(2024, 1, 5)


def test_every_query_is_registered_once():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert len(names) == len(set(names)) and set(entry.oracle_sql()) <= set(names)
    assert {"p2_found", "p6_found", "hybrid_topk"} <= set(names)


def test_each_fact_pattern_finds_its_fact(spark):
    want = [
        ("personal", "medium", "I'm a nurse from Lyon"), ("personal", "medium", "call me José"), ("personal", "medium", "I live in Oslo"), ("personal", "medium", "I work at Brightwater"),
        ("preference", "low", "I like green tea"), ("preference", "low", "I avoid red meat"), ("preference", "low", "I never eat late"),
        ("correction", "low", "no, it's the second door"), ("correction", "low", "I meant the other one"),
        ("temporal", "low", "until March 14 at noon"), ("temporal", "low", "next week the audit begins"), ("temporal", "low", "scheduled for Tuesday"),
        ("technical", "low", "our stack is Spark"), ("technical", "low", "we deployed the gateway"), ("technical", "low", "our architecture has two tiers"),
        ("activity", "low", "working on the parser"), ("activity", "low", "we're building a bridge"),
        ("event", "low", "we started the trial"), ("event", "low", "we shipped the release"), ("event", "low", "I switched to tea"),
        ("relationship", "low", "we hired a cook"), ("decision", "low", "we decided to wait"),
    ]
    m = spark.createDataFrame([(i, f"So {fact}.") for i, (_, _, fact) in enumerate(want)] + [(98, "we’re using Kafka, since monday"), (99, "we chose Rust")], "id bigint, content string")
    got = {tuple(r) for r in ing.pattern_facts(m).collect()}
    assert len(ing.FACTS) == 22 and {(i, *w) for i, w in enumerate(want)} <= got
    assert {r[1:] for r in got if r[0] == 98} == {("technical", "low", "we're using Kafka")} and {r[1] for r in got if r[0] == 99} == {"technical", "decision"}


def test_not_anymore_is_a_change(spark):
    from palimpsest.operators.consolidation import changes

    m = spark.createDataFrame([(1, "1", "We do not use Jira anymore.", False), (2, "2", "we no longer use Slack", False), (3, "3", "not now", False)], "id bigint, ts string, content string, directive boolean")
    assert {(r["id"], r["kind"], r["new_fact"]) for r in changes(m).collect()} == {(1, "negation_change", "use Jira"), (2, "negation_change", "use")}
