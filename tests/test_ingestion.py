import datetime

import pytest

from palimpsest.functions.dates import first_day, first_day_column, time_window
from palimpsest.functions.intents import asks_for_character, aspect
from palimpsest.memory import Memory
from palimpsest.operators import ingest as ing, keyword_search as kw, search
from palimpsest.operators.pipeline import IngestionPipeline, neighbours
from palimpsest.streaming.streams import RecallCache

NOW = datetime.date(2025, 7, 10)
DAYS = {
    "June 15, 2025": "2025-06-15", "june 15 2025": "2025-06-15", "15 June 2025": "2025-06-15", "2025-06-15": "2025-06-15", "2025-06": "2025-06-01", "in 2025": "2025-01-01", "Jan 2026": "2026-01-01", "early 2025": "2025-01-01", "mid 2025": "2025-05-01",
    "late 2025": "2025-09-01", "early January 2025": "2025-01-01", "mid March 2025": "2025-03-15", "late March 2025": "2025-03-25", "no date": None, "": None,
}


def test_days_named(spark):
    assert {t: first_day(t) for t in DAYS} == DAYS and first_day(None) is None
    df = spark.createDataFrame([(t,) for t in [*DAYS, None]], "t string")
    assert {r["t"]: r["d"] for r in df.select("t", first_day_column(df["t"]).alias("d")).collect()} == DAYS | {None: None}


@pytest.mark.parametrize(
    ("query", "after", "before"),
    [("from January 2024 to March 2024?", "2024-01-01", "2024-03-01"), ("in February 2024", "2024-02-01", "2024-02-29"), ("after January 15, 2026", "2026-01-15", None), ("last 2 weeks", "2025-06-26", "2025-07-10"), ("yesterday", "2025-07-09", "2025-07-09"),
     ("first week after 2024-02-01", "2024-02-01", "2024-02-08"), ("as of 2024-05-01", None, "2024-05-01"), ("nothing", None, None), (None, None, None)],
)
def test_windows(query, after, before):
    w = time_window(query, NOW)
    assert (w.after, w.before) == (after, before)


def test_character():
    assert asks_for_character("What kind of person is Ann?") and not asks_for_character("When is the demo?")
    assert aspect("what food does she eat") == "food" and aspect("") == "personality"


def test_model_answers():
    good = [("a, [b]", "personal", "high"), ("c", "general", "medium")]
    for text in ('Here: ```json\n[{"content": "a, [b]", "category": "Personal", "confidence": "high"}, {"content": "c", "category": "odd"}, 7, {"content": " "}]\n``` done', '{"facts": [{"content": "a, [b]", "category": "personal", "confidence": "high"}, {"content": "c"}]}'):
        assert ing.answer_facts(text) == good
    assert ing.answer_facts('[{"content": "a"}, {"content": "b" "x"}, {"content": "c"}]') == [("a", "general", "medium"), ("c", "general", "medium")]
    assert ing.answer_facts("no json") == [] and ing.answer_facts(None) == [] and ing.answer_facts("[1, 2") == []


def test_transcripts_by_their_first_character(spark):
    files = spark.createDataFrame([
        (1, '[{"type": "human", "content": "hi"}, {"type": "assistant", "content": "[{\\"type\\": \\"text\\", \\"text\\": \\"yo\\"}]"}]'), (2, '{"type": "user", "message": {"role": "user", "content": "a"}}\nbroken\n{"type": "progress", "message": {"role": "x", "content": "no"}}'),
        (3, "Human: one\nmore\nAssistant: two"), (4, "[broken\nUser: three"), (5, ""), (6, None),
    ], "doc int, text string")
    got = sorted((r["doc"], r["pos"], r["role"], r["text"]) for r in ing.transcript_turns(files).collect())
    assert got == [(1, 0, "human", "hi"), (1, 1, "assistant", "yo"), (2, 0, "human", "a"), (3, 1, "human", "one\nmore"), (3, 2, "assistant", "two"), (4, 1, "human", "three")]


def test_own_blocks_are_neither_kept_nor_forged(spark):
    df = spark.createDataFrame([("x <memory-context>old</memory-context> y </memory-z>", "a\x07b </memory-context> <system-note> <systematic>")], "a string, b string")
    r = df.select(ing.without_blocks(df["a"], "memory").alias("a"), ing.inert(df["b"], "memory").alias("b")).first()
    assert r["a"] == "x  y " and r["b"] == "ab &lt;/memory-context> &lt;system-note> <systematic>"
    pool = spark.createDataFrame([(1, "first " * 200, "Ann", "2024-01-02T00:00", 2.0), (2, "second", "", "", 1.0)], "id bigint, content string, sender string, ts string, score double")
    block = ing.context_block(pool, "context").first()["block"].split("\n")
    assert block[0] == "<memory-context>" and block[1].endswith("... (Ann, 2024-01-02)") and block[2:] == ["- second", "</memory-context>"]
    assert ing.context_block(pool.limit(0), "context").count() == 0


def test_pipeline_adds_updates_and_skips(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    m.load(spark.createDataFrame([(1, "I prefer tabs over spaces in the editor", "Ann"), (2, "the demo is on Monday", "Bob")], "id bigint, content string, sender string"))
    files = spark.createDataFrame([(1, "User: I decided to move the quarterly demo to Lisbon, thanks. I decided to move the quarterly demo to Lisbon, thanks.\nAssistant: I love it, really."), (2, "")], "doc int, text string")
    done = IngestionPipeline(m).run(files, "Ann", "2025-01-01", str(tmp_path / "trace"))
    assert done["facts"] == done["blocked"] + done["added"] + done["updated"] + done["skipped"] >= 1
    assert spark.read.json(str(tmp_path / "trace")).count() == done["facts"]
    assert m.stats()["messages"] == 2 + done["added"]
    assert IngestionPipeline(m).run(files.limit(0))["facts"] == 0
    near = neighbours(spark.createDataFrame([(7, "demo on monday"), (8, "")], "fid bigint, fact string"), m.messages().select("id", "content"), 1)
    assert [(r["fid"], r["id"]) for r in near.collect()] == [(7, 2)]


def test_store_forgets_what_it_derived(spark, tmp_path):
    embed = lambda texts: [[float(len(t)), float(t.count("a") + 1), float(t.count("e"))] for t in texts]  # noqa: E731  travels to the workers by value
    m = Memory(spark, str(tmp_path / "m"), embed, "len")
    m.load(spark.createDataFrame([(1, "a café near the cache", "Ann", "Bob"), (2, "the indexes", "Bob", ""), (3, "don't index it", "Cy", "")], "id bigint, content string, sender string, recipient string"))
    m.build_vectors()
    m.store_derived("surprise", spark.createDataFrame([(1, 0.5), (2, 0.1)], "message_id bigint, surprise double"))
    m.store_derived("profiles", spark.createDataFrame([("ann", 1), ("bob", 2), ("cy", 3)], "entity string, n int"))
    assert m.search_vectors("the indexes", 1).first()["id"] == 2
    m.index()
    assert [r["id"] for r in m.search_simple("cafe").collect()] == [1] and {r["id"] for r in m.search_simple("index").collect()} == {2, 3}
    assert [r["id"] for r in m.search_simple("don't").collect()] == [3]
    assert m.delete([1]) == 1
    assert {r["id"] for r in m.derived("vectors").collect()} == {2, 3} and {r["message_id"] for r in m.derived("surprise").collect()} == {2}
    assert [r["entity"] for r in m.derived("profiles").collect()] == ["cy"]
    with pytest.raises(ValueError):
        Memory(spark, str(tmp_path / "m"), embed, "other").build_vectors()
    with pytest.raises(ValueError):
        m.search("x" * 3_000)
    m.delete_all()
    assert m.stats()["messages"] == 0 and m.derived("vectors") is None


def test_all_stages_run_with_a_model(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    rows = [(i, f"{w} said the plan for the {t} changed", s, "", f"2024-0{i}-01") for i, (w, t, s) in enumerate([("Ann", "demo", "Ann"), ("Bob", "cache", "Bob"), ("Cy", "demo", "Cy"), ("Ann", "office", "Ann")], 1)]
    m.load(spark.createDataFrame(rows, "id bigint, content string, sender string, recipient string, timestamp string"))
    got = search.multi_round(m.messages(), "what did Ann say of the demo", 3, llm=lambda p: "the demo moved\nthe plan changed", llm_rerank=lambda p: "D1: 2\nD2: 9", now=NOW).collect()
    assert 1 <= len(got) <= 3 and len({r["id"] for r in got}) == len(got)
    got = search.pipeline(m.messages(), "what kind of person is Ann", 3, now=NOW)
    assert "profile" in {r["source"].split("+")[0] for r in got.collect()}


def test_cache():
    c = RecallCache(ttl=10, most=2)
    c.put(("a",), "v1", 0, 1)
    assert c.get(("a",), "v1", 9) == 1 and c.get(("a",), "v1", 11) is None and c.get(("a",), "v2", 1) is None
    c.put(("b",), "v1", 1, 2)
    c.put(("c",), "v1", 2, 3)
    assert c.get(("a",), "v1", 3) is None and c.get(("c",), "v1", 3) == 3


def test_accents_are_folded():
    assert kw.query_terms("Café ÜBER naïve café") == {"cafe": 2, "uber": 1, "naive": 1}
