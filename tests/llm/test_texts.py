import random

from palimpsest.llm.conversations import chain_lines, conversations, ordered_lines
from palimpsest.llm.leakage import find_leaks, leaked_documents, remove_leaks, word_spans
from palimpsest.llm.packing import OpenBins, _encoding, pack_documents
from palimpsest.llm.words import words

DOC = "doc_id bigint, text string, item_id string"
ITEM = "item_id bigint, item_text string, answer string"


def shared_run(a, b, n):
    x, y = words(a or ""), words(b or "")
    grams = {tuple(y[i : i + n]) for i in range(len(y) - n + 1)}
    return any(tuple(x[i : i + n]) in grams for i in range(len(x) - n + 1))


def leak_data(spark):
    rng = random.Random(1)
    v = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(v, k=25)), "") for i in range(6)] + [(7, None, ""), (8, "short", ""), (9, "", "")]
    docs = []
    for i in range(60):
        t = rng.choices(v, k=rng.randint(0, 40))
        if i % 3 == 0:
            own = items[rng.randrange(6)][1].split()
            at, n = rng.randrange(10), rng.choice([9, 10, 12])
            t[5:5] = own[at : at + n]
        docs.append((i, rng.choice([" ", "_", "\n- "]).join(x.upper() if rng.random() < 0.2 else x for x in t), "z"))
    docs += [(100, None, ""), (101, "", ""), (102, "ü" * 40_000, "")]
    return docs + docs[:4], items


def test_leaks_match_brute_force(spark):
    docs, items = leak_data(spark)
    d, i = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    want = {(a, b) for a, t, _ in docs for b, u, _ in items if shared_run(t, u, 10)}
    assert want and {tuple(r) for r in leaked_documents(d, i).collect()} == want
    spans = lambda most: {tuple(r) for r in find_leaks(d, i, most=most).collect()}
    assert spans(60) == spans(10**6)  # several rounds or one
    left = {r["doc_id"]: r["text"] for r in remove_leaks(d, find_leaks(d, i)).collect()}
    assert not any(shared_run(left[a], u, 10) for a, b in want for c, u, _ in items if b == c)
    assert left[100] is None and left[102] == "ü" * 40_000
    assert leaked_documents(d.limit(0), i).count() == 0 and leaked_documents(d, i.limit(0)).count() == 0


def test_spans_of_letters_that_grow_in_lower_case(spark):
    text = "İstanbul one two three four five six seven eight nine ten İ end"
    assert [text[a:b].lower() for a, b in word_spans(text)][1:3] == ["stanbul", "one"] or text[slice(*word_spans(text)[-1])] == "end"
    d = spark.createDataFrame([(1, text, "")], DOC)
    i = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", "")], ITEM)
    assert [r["text"] for r in remove_leaks(d, find_leaks(d, i)).collect()] == ["İstanbul  İ end"]


def test_every_token_is_packed_once(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(["plan", "Straße", "12", "meeting,", "été"], k=rng.choice([0, 3, 40, 90, 400]))), "") for i in range(200)] + [(900, None, ""), (901, "", ""), (902, "word " * 3_000, "")]
    rows = pack_documents(spark.createDataFrame(docs, DOC).repartition(6), capacity=128, limit=4).collect()
    enc = _encoding("/opt/tokenizers")
    sizes = {d: len(enc.encode_ordinary(t)) for d, t, _ in docs if t}
    spans, used = {}, {}
    for r in rows:
        spans.setdefault(r["doc_id"], []).append((r["first_token"], r["tokens"]))
        used[r["container"]] = used.get(r["container"], 0) + r["tokens"]
    assert max(used.values()) <= 128 and {r["container"]: r["used"] for r in rows} == used
    for d, n in sizes.items():
        at = 0
        for first, k in sorted(spans.pop(d)):
            assert first == at
            at += k
        assert at == n
    assert not spans and all(r["part_no"] == 0 for r in rows if sizes[r["doc_id"]] <= 128)
    assert sum(used.values()) / (128 * len(used)) > 0.9
    assert pack_documents(spark.createDataFrame([], DOC)).count() == 0


def test_bins_keep_their_bound():
    b, gone = OpenBins(10, 3), []
    for k, n in enumerate([6, 6, 6, 6, 4, 10, 9]):
        gone += b.put(n, k)
        assert len(b.free) <= 3
    assert sorted(i for _, items in gone + b.rest() for i in items) == list(range(7))


LINE = "type string, uuid string, parentUuid string, sessionId string, isSidechain boolean, timestamp string, message struct<role:string,content:string,model:string>, version string"


def line(session, uuid, parent, kind="user", text="hi", side=False):
    return (kind, uuid, parent, session, side, None, ("User", text, None), "1")


def turns(spark, lines):
    return {tuple(r)[:3] for r in conversations(spark.createDataFrame(lines, LINE)).collect()}


SESSIONS = [
    line("ok", "a1", None), line("ok", "a2", "a1", "system", "note"), line("ok", "a3", "a2", "assistant", '[{"type":"thinking","thinking":"x"}]'), line("ok", "a4", "a3", "assistant", '[{"type":"text","text":"yo"}]'), line("ok", "a5", "a4", "user", "   "),
    line("ok", "a1", None), line("ok", "zz", "a1", side=True), line("ok", None, "a1"),
    line("unanswered", "b1", ""), line("fork", "c1", None), line("fork", "c2", "c1", "assistant"), line("fork", "c3", "c1", "assistant"), line("lost", "d1", None), line("lost", "d2", "d9", "assistant"),
    line("loop", "e1", None), line("loop", "e4", "e1", "assistant"), line("loop", "e2", "e3", "assistant"), line("loop", "e3", "e2", "assistant"), line("two", "f1", None), line("two", "f2", None), line("empty", "g1", None, "assistant", ""),
    line("bracket", "h1", None, "user", "[edited] ok"), line("bracket", "h2", "h1", "assistant", "[]"), line("bracket", "h3", "h2", "assistant", "fine"), line(None, "i1", None),
]
SOUND = {("ok", 1, "a1"), ("ok", 2, "a4"), ("bracket", 1, "h1"), ("bracket", 2, "h3")}


def test_sound_sessions_only(spark):
    assert turns(spark, SESSIONS) == SOUND
    assert turns(spark, []) == set()


def test_automaton_rejects_and_accepts_over_blocks(spark, monkeypatch):
    from palimpsest.llm import conversations as c

    monkeypatch.setattr(c, "BLOCK", 2)
    rng = random.Random(4)
    lines, want = [], set()
    for k in range(40):
        kinds = [rng.choice(["user", "assistant"]) for _ in range(rng.randint(1, 9))]
        lines += [line(f"s{k}", f"{k}-{i}", f"{k}-{i - 1}" if i else None, x) for i, x in enumerate(kinds)]
        if all(b == "assistant" for a, b in zip(kinds, [*kinds[1:], None]) if a == "user"):
            want |= {(f"s{k}", i + 1, f"{k}-{i}") for i in range(len(kinds))}
    assert want and turns(spark, lines) == want


def test_hot_sessions_take_pointer_doubling(spark, monkeypatch):
    from palimpsest.llm import conversations as c

    monkeypatch.setattr(c, "HOT_LINES", 1)
    assert turns(spark, SESSIONS) == SOUND
    long = [line("big", f"u{i}", f"u{i - 1}" if i else None, "user" if i % 2 == 0 else "assistant") for i in range(300)]
    random.Random(1).shuffle(long)
    assert turns(spark, long) == {("big", i + 1, f"u{i}") for i in range(300)}
    assert ordered_lines(chain_lines(spark.createDataFrame(long, LINE))).count() == 300
