import itertools
import os
import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from palimpsest.llm.dedup import DedupIndex, _parse, _shared, resolve, signatures
from palimpsest.llm.words import words

KIND = "id bigint, content string, h string, key string"


def brute(rows):
    accepted, out, seen = [], set(), set()
    for i, text in sorted(rows, key=lambda r: r[0]):
        if i in seen or text is None:
            continue
        seen.add(i)
        w, d = set(re.findall(r"[^\W_]+", text.lower())), sorted(re.findall("[0-9]+", text))
        if len(w) < 8:
            continue
        hit = [a for a, v, e in accepted if e == d and 10 * len(v & w) >= 8 * len(v | w)]
        if hit:
            out.add((hit[0], i))
        else:
            accepted.append((i, w, d))
    return out


def sample(rng, n):
    base = [[rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho".split()) + rng.choice(["", "x", "y"]) for _ in range(rng.randint(9, 16))] for _ in range(6)]
    rows = []
    for i in range(1, n + 1):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(["new", "other", "word", "7", "8"])
        rows.append((i, " ".join(w), "a", "b"))
    rows += [(n + 1, None, "", ""), (n + 2, "", "", ""), (n + 3, "too short", "", ""), (n + 4, "ß" * 50_000, "", "")]
    hot = "the same long text comes back again and again in this table"
    rows += [(n + 10 + k, hot + rng.choice(["", "!", " now"]), "", "") for k in range(60)]
    return rows + rows[:9]


def found(df):
    return {tuple(r) for r in df.collect()}


def test_cases_match_the_sequential_rule(spark):
    rows = sample(random.Random(11), 150)
    assert found(resolve(spark.createDataFrame(rows, KIND)).cases) == brute([r[:2] for r in rows])


def test_index_gives_the_same_in_batches(spark, tmp_path):
    rows = sample(random.Random(12), 80)
    df = spark.createDataFrame(rows, KIND)
    index = DedupIndex(spark, str(tmp_path / "i"), buckets=4)
    got = set()
    for low, high in ((0, 30), (30, 30), (30, 100), (100, 10_000)):
        got |= found(index.add(df.where(f"id > {low} and id <= {high}")))
    assert got == brute([r[:2] for r in rows])


def test_empty(spark):
    assert found(resolve(spark.createDataFrame([], KIND)).cases) == set()


def keys_of(own, digits, common):
    """The definition of the signatures, word by word."""
    n, least, rare = len(own), -(-4 * len(own) // 5), [w for w in own if w not in common]
    r, out = len(rare), [(hash((w, digits)), 2) for w in rare[: len(own) + 1 - -(-4 * len(own) // 5)]]
    if r <= n - least:
        pairs = itertools.combinations([w for _, w in sorted((common[w], w) for w in own if w in common)][: n - least + 2 - r], 2)
        out += [(hash((a, c, digits, min(r, q), max(r, q))), 2 if q == r else 0 if r < q else 1) for a, c in pairs for q in range(5 * (n - r) // 4 - n + 1)]
    return out


def test_signatures_of_a_batch_are_those_of_its_messages():
    rng = random.Random(13)
    for few in (0, 5, 300):
        common = {rng.randrange(-(1 << 31), 1 << 31): rng.randrange(3, 9) for _ in range(few)}
        known = list(common) + [rng.randrange(-(1 << 31), 1 << 31) for _ in range(40)] + [-1, 0, 1]
        rows = [(sorted(rng.sample(known, rng.randint(8, 40))), rng.choice([-(1 << 63), (1 << 63) - 1, -1, (1 << 61) - 1, rng.getrandbits(62)])) for _ in range(60)]
        every = sorted(common.items())
        ends = np.cumsum([0] + [len(w) for w, _ in rows])
        got = [[] for _ in rows]
        for k, key, role in signatures(ends, np.array([w for ws, _ in rows for w in ws], np.int32), np.array([d for _, d in rows], np.int64), *(np.array([p[j] for p in every], np.int64) for j in (0, 1))):
            for i, own, kind in zip(k.tolist(), key.tolist(), role.tolist()):
                got[i].append((own, kind))
        assert [sorted(g) for g in got] == [sorted(keys_of(*r, common)) for r in rows]


def test_texts_are_parsed_as_words_and_digits_say(monkeypatch):
    texts = ["A_b-C\x00d\x1ce f g H i j k 007 7 \t 7", "İstanbul ſ K a b c d e f ٣ 12 ١٢ x_y", "ΣΑΣ σας ὈΔΥΣΣΕΎΣ a b c d e f g", "ß" * 99, "", "a a a a a a a a a", "  one two three four five six seven eight  "]
    monkeypatch.setattr("palimpsest.llm.dedup.AT_ONCE", 40)
    batch = pa.record_batch({"id": pa.array(range(len(texts)), pa.int64()), "content": pa.array(texts)})
    got = pa.Table.from_batches(_parse(iter([batch]))).to_pylist()
    want = {i: sorted(xxhash.xxh32_intdigest(w) - (1 << 31) for w in ws) for i, t in enumerate(texts) if len(ws := set(words(t))) >= 8}
    assert {r["id"]: r["words"] for r in got} == want
    assert {r["id"]: r["digits"] for r in got} == {i: xxhash.xxh3_64_intdigest(" ".join(sorted(re.findall("[0-9]+", texts[i])))) - (1 << 63) for i in want}


def test_one_batch_leaves_only_its_cases_and_moves_its_keys_once(spark, tmp_path):
    keys = spark.range(100).selectExpr("id", "id % 7 as key", "cast(2 as tinyint) as role")
    assert _shared(keys)._jdf.queryExecution().sparkPlan().toString().count("Window") == 1
    assert _shared(keys)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    at = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(at))
    done = resolve(spark.createDataFrame(sample(random.Random(14), 40), KIND))
    assert len([x for x in set(os.listdir(at)) - before if x.startswith("table-")]) == 1
    assert done.cases.count() > 0
