import random
import re
from collections import defaultdict

from palimpsest.operators.history import HistoryStore, build_chains, rebuild_affected, statements, versions_text

TIMELINE = "id bigint, entity_scope string, subject string, fact string, valid_from string, note string"
SNAPSHOTS = "as_of string, entity_scope string, subject string, fact string"


def brute(timeline, snapshots):
    n = lambda s: re.sub(r"\s+", " ", s.lower()).strip()
    at, dates = defaultdict(dict), defaultdict(set)
    for d, e, s, f in snapshots:
        at[n(e), n(s)][d + "T00:00:00Z"] = n(f)
        dates[n(e)].add(d + "T00:00:00Z")
    for _, e, s, f, t, _ in sorted(timeline):
        at[n(e), n(s)][t] = n(f)
    out = set()
    for (e, s), told in at.items():
        for t in dates[e]:
            told.setdefault(t, None)
        now = since = None
        for t in sorted(told):
            if told[t] != now:
                if now is not None:
                    out.add((e, s, since, t))
                now, since = told[t], t
        if now is not None:
            out.add((e, s, since, ""))
    return out


def sample(rng, n):
    day = lambda: f"2024-{rng.randint(1, 6):02d}-{rng.randint(1, 28):02d}"
    timeline = [(i, rng.choice(["Ann", " ann", "BOB"]), rng.choice(["job", "Home "]), rng.choice(["x", "y", "X ", "z  z"]), day() + rng.choice(["T00:00:00Z", "T05:06:07Z"]), "n") for i in range(n)]
    snapshots = [(day(), rng.choice(["ann", "Bob"]), rng.choice(["job", "home"]), "x") for _ in range(n // 3)]
    seen, once = set(), []
    for s in snapshots:
        k = (s[0], s[1].lower(), s[2])
        if k not in seen:
            seen.add(k)
            once.append(s)
    return timeline, once


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_random_histories_match_brute_force(spark):
    rng = random.Random(5)
    for n in (12, 60):
        t, s = sample(rng, n)
        st = statements(spark.createDataFrame(t + t[:3], TIMELINE), spark.createDataFrame(s, SNAPSHOTS))
        assert rows(versions_text(build_chains(st))) == brute(t, s)


def test_nulls_and_empty(spark):
    t = spark.createDataFrame([(1, None, "a", "b", "2024-01-01T00:00:00Z", ""), (2, "e", "a", None, "2024-01-01T00:00:00Z", ""), (3, "e", "a", "v", "not a time", ""), (4, "e", " ", "v", "2024-01-01T00:00:00Z", "")], TIMELINE)
    s = spark.createDataFrame([], SNAPSHOTS)
    assert rows(versions_text(build_chains(statements(t, s)))) == set()
    assert rows(versions_text(build_chains(statements(t.limit(0), s)))) == set()


def test_late_updates_replace_touched_chains_only(spark, tmp_path):
    t, s = sample(random.Random(9), 40)
    every = statements(spark.createDataFrame(t, TIMELINE), spark.createDataFrame(s, SNAPSHOTS))
    late = every.where("seq % 4 = 1 and entity = 'ann'")
    first = every.where("not (seq % 4 = 1 and entity = 'ann')")
    assert rows(versions_text(rebuild_affected(build_chains(first), every, late))) == brute(t, s)
    store = HistoryStore(spark, str(tmp_path / "h"), buckets=4)
    assert store.chains() is None
    store.apply_updates(first)
    store.apply_updates(late)
    assert rows(versions_text(store.chains())) == brute(t, s)
