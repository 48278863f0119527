import random
from datetime import datetime

import pytest

from palimpsest.functions.stamps import interpretations
from palimpsest.operators import timestamps as ts


def us(text):
    return int(datetime.fromisoformat(text + "+00:00").timestamp()) * 1_000_000


@pytest.mark.parametrize(
    ("text", "zone", "want"),
    [
        ("2024-01-08T01:14:04Z", None, "2024-01-08T01:14:04"), (" 2024-01-08 01:14 ", "Asia/Kolkata", "2024-01-07T19:44:00"), ("2024-01-08T14:26:06+11:00", None, "2024-01-08T03:26:06"), ("2024-01-08T14:26:06+11", None, "2024-01-08T03:26:06"),
        ("2024-01-08T14:26:06-0530", None, "2024-01-08T19:56:06"), ("2024-01-08 00:57:59 PST", "Asia/Tokyo", "2024-01-08T08:57:59"), ("2024-07-08 00:57:59 CEST", None, "2024-07-07T22:57:59"), ("2024-01-08T09:46:44-05:00[Europe/Berlin]", None, "2024-01-08T14:46:44"),
        ("2024-01-08T09:46:44[Europe/Berlin]", "UTC", "2024-01-08T08:46:44"), ("1704760463", None, "2024-01-09T00:34:23"), ("1704760463000", None, "2024-01-09T00:34:23"), ("1704760463000000", None, "2024-01-09T00:34:23"), ("1704760463.000", None, "2024-01-09T00:34:23"),
        ("01/08/2024 3:09 AM", None, "2024-01-08T03:09:00"), ("01/08/2024 12:09 AM", None, "2024-01-08T00:09:00"), ("08.01.2024 17:29:32", None, "2024-01-08T17:29:32"), ("January 10, 2024 at 4:20 pm", None, "2024-01-10T16:20:00"), ("Mon, 08 Jan 2024 04:36:55 GMT", None, "2024-01-08T04:36:55"),
        ("30 Mar 2025 02:10:38 +0100", None, "2025-03-30T01:10:38"), ("20240107T205740", None, "2024-01-07T20:57:40"), ("2024-01-08", None, "2024-01-08T00:00:00"),
        ("2024-11-03T01:30:00", "America/New_York", "2024-11-03T05:30:00"), ("2024-03-10T02:30:00", "America/New_York", "2024-03-10T07:30:00"), ("2024-03-31 02:30:00", "Europe/Berlin", "2024-03-31T01:30:00"),
    ],
)
def test_conventional_reading(text, zone, want):
    assert interpretations(text, zone)[0][0] == 0
    assert interpretations(text, zone)[0][2] == us(want)


@pytest.mark.parametrize("text", [None, "", "  ", "yesterday", "NaT", "unknown", "0000-00-00 00:00:00", "2025-02-30T10:00:00", "2024-13-04", "13/40/2024", "25:00", "2024-01-08T25:00:00Z", "x" * 100_000])
def test_no_instant(text):
    assert interpretations(text, "UTC") == []


KIND = "tbl string, row_key string, source string, ord bigint, stamp string, zone string"


def best_path(cands):
    """Brute-force Viterbi over one source."""
    state = None
    for now in cands:
        if state is None:
            state = [(ts.RULE_COST * c, [u], f, u) for c, f, u in now]
        else:
            state = [min(((s[0] + (ts.SWITCH_COST if s[2] != f else 0) + (ts.BACK_COST if u < s[3] else 0) + ts.RULE_COST * c, s[1] + [u], f, u) for s in state), key=lambda x: x[0]) for c, f, u in now]
    return min(state, key=lambda x: x[0]) if state else (0, [])


def test_paths_across_partitions_are_optimal(spark, monkeypatch):
    rng = random.Random(3)
    stamps = ["05-06-2024 10:00:00", "03-04-2024", "2024-11-03T01:30:00", "03/04/2024 1:00 AM", "05.06.2024 10:00:00", "2024-05-01T00:00:00Z", "nonsense", None, "20240108", "1704760463"]
    data = [("t", f"{s}-{i}", s, i, rng.choice(stamps), rng.choice(["America/New_York", None])) for s in ("hot", "a", "b") for i in range(80 if s == "hot" else 6)]
    out = ts.normalise_timestamps(spark.createDataFrame(data, KIND)).collect()
    assert len(out) == len(data)
    for source in ("hot", "a", "b"):
        rows = sorted((r for r in out if r["source"] == source), key=lambda r: r["ord"])
        cands = [(r, interpretations(r["stamp"], r["zone"])) for r in rows]
        cost = lambda us_: None
        del cost
        usable = [(r, c) for r, c in cands if c]
        assert all(r["utc_us"] is None for r, c in cands if not c)
        want = best_path([c for _, c in usable])
        # the chosen readings cost as little as the best path
        forms = [[x for x in c if x[2] == r["utc_us"]][0] for r, c in usable]
        got = sum(ts.RULE_COST * f[0] for f in forms) + sum((ts.SWITCH_COST if b[1] != a[1] else 0) + (ts.BACK_COST if b[2] < a[2] else 0) for a, b in zip(forms, forms[1:]))
        assert got == want[0]


def test_the_path_decides_where_no_convention_does(spark):
    """Dates like 05-06-2024 have two readings of equal cost: the neighbours' order and form choose, over partitions too."""
    def chosen(stamps):
        rows = [("t", str(i), "s", i, x, None) for i, x in enumerate(stamps)]
        return {r["row_key"]: r["utc_us"] for r in ts.normalise_timestamps(spark.createDataFrame(rows, KIND).repartition(3)).collect()}

    assert chosen(["2024-05-01T00:00:00Z", "05-06-2024", "2024-05-20T00:00:00Z"])["1"] == us("2024-05-06T00:00:00")
    assert chosen(["2024-05-20T00:00:00Z", "05-06-2024", "2024-07-01T00:00:00Z"])["1"] == us("2024-06-05T00:00:00")
    days = chosen([f"{d:02d}-03-2024" for d in range(1, 29)])
    assert [days[str(i)] for i in range(28)] == [us(f"2024-03-{d:02d}T00:00:00") for d in range(1, 29)]


def test_empty_table(spark):
    assert ts.normalise_timestamps(spark.createDataFrame([], KIND)).count() == 0
