"""Style vectors against a direct computation."""

import hashlib
import math
from collections import Counter, defaultdict

from palimpsest.operators import profiles as pr
from palimpsest.runtime import ship

TEXTS = [
    (1, "Ann", "The  cache\tis slow, the cache is OLD"), (2, "ann", "ab"), (3, "Ann", " Größe 漢字漢字 \U0001f600\U0001f600\U0001f600 "), (4, "Bo", "abc\x00abc\x00d"), (5, "Bo", "abc"),
    (6, "Cy", "  "), (7, "", "nobody wrote this"), (8, "Di", "xy"), *((k, f"s{k % 7}", f"row {k * k} of the query cache, moved on {k}") for k in range(10, 60)),
]


def direct(rows):
    sums = defaultdict(Counter)
    for _, sender, text in rows:
        t = " ".join(text.strip(" ").lower().split())
        if sender and t:
            c = Counter(hashlib.md5(t[i : i + n].encode()).digest()[0] for n in (3, 4, 5) for i in range(len(t) - n + 1))
            norm = math.sqrt(sum(v * v for v in c.values()))
            for k, v in c.items():
                sums[sender.lower()][k] += v / norm
    return {(e, k): v / math.sqrt(sum(x * x for x in s.values())) for e, s in sums.items() for k, v in s.items()}


def test_style_vectors_without_a_row_for_each_gram(spark, monkeypatch):
    ship(spark)
    vectors = pr.style_vectors(spark.createDataFrame(TEXTS, "id bigint, sender string, content string"))
    assert "Generate" not in vectors._jdf.queryExecution().executedPlan().toString()
    got, want = {(r["entity"], r["bucket"]): r["value"] for r in vectors.collect()}, direct(TEXTS)
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-6 for k, v in want.items())
    # few slots, stretches and senders at a time give the same
    import pyarrow as pa

    for name, value in (("GRAM_SLOTS", 4), ("STRETCH", 7), ("ROWS", 3), ("SENDERS", 2)):
        monkeypatch.setattr(pr, name, value)
    rows = [(s.lower(), " ".join(t.strip(" ").lower().split())) for _, s, t in TEXTS if s and t.strip()]
    sums = Counter()
    for b in pr._style_sums([pa.record_batch([[e for e, _ in rows], [t for _, t in rows]], ["entity", "t"])]):
        for r in b.to_pylist():
            sums[r["entity"], r["bucket"]] += r["v"]
    length = Counter()
    for (e, _), v in sums.items():
        length[e] += v * v
    assert sums.keys() == want.keys() and all(abs(v / math.sqrt(length[k[0]]) - want[k]) < 1e-9 for k, v in sums.items())


def test_style_similarity_forms_the_vectors_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([("ann", 1, 0.6), ("ann", 2, 0.8), ("bo", 2, 1.0), ("cy", 3, 1.0)], "entity string, bucket int, value double")
    out = pr.style_similarity(rows.mapInArrow(count, rows.schema), "Ann").collect()
    assert {(r["entity"], r["cosine"]) for r in out} == {("ann", 1.0), ("bo", 0.8)} and seen.value == 4
