"""Dates and time windows that a question names, as Python values for one question and as columns for tables of them."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names with their usual short forms, and the day or month that early, mid and late stand for.
MONTH = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
PART_DAY = {"early": 1, "mid": 15, "late": 25}
PART_MONTH = {"early": 1, "mid": 5, "late": 9}
_M = "(" + "|".join(MONTH) + ")"
_P = "(early|mid|late)"
#: Forms in order of preference: pattern, and what its groups are (y year, m number of a month, n name of a month, d day, p part of a month, q part of a year).
FORMS = (
    (r"\b(\d{4})-(\d{2})-(\d{2})\b", "ymd"), (r"\b(\d{4})-(\d{2})\b", "ym"), (rf"\b{_M}\s+(\d{{1,2}}),?\s+(\d{{4}})\b", "ndy"), (rf"\b(\d{{1,2}})\s+{_M}\s+(\d{{4}})\b", "dny"),
    (rf"\b{_P}\s+{_M}\s+(\d{{4}})\b", "pny"), (rf"\b{_P}\s+(\d{{4}})\b", "qy"), (rf"\b{_M}\s+(\d{{4}})\b", "ny"), (r"\b(20\d{2})\b", "y"),
)
# Words of change over time.
TRAJECTORY = (
    r"\bover\s+time\b", r"\btrajectory\b", r"\bgrew\b", r"\bgrow\b", r"\bgrowth\b", r"\bchanged?\b", r"\bevolved?\b", r"\bevolution\b", r"\bprogress(?:ion|ed)?\b", r"\bdecline[ds]?\b", r"\bimproved?\b", r"\bdeteriorate[ds]?\b",
    r"\bfrom\s+.+\bto\s+", r"\btimeline\b", r"\bchronolog",
)
AHEAD = r"\b(?:upcoming|future|next|scheduled)\b"
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
AFTER_DAYS = {"week": 7, "month": 31, "year": 365}


def first_day(text: str | None) -> str | None:
    """The first day that a text names, as yyyy-MM-dd (not checked against the calendar); None if it names none."""
    low = (text or "").lower()
    for pattern, kinds in FORMS:
        if m := re.search(pattern, low):
            g = dict(zip(kinds, m.groups()))
            month = g.get("m") or (MONTH[g["n"]] if "n" in g else PART_MONTH[g["q"]] if "q" in g else 1)
            day = g.get("d") or (PART_DAY[g["p"]] if "p" in g else 1)
            return f"{g['y']}-{int(month):02d}-{int(day):02d}"
    return None


def first_day_column(text: Column) -> Column:
    """The same as a column."""
    low, out = F.lower(text), F.lit(None).cast("string")
    table = lambda c, d: F.element_at(F.create_map(*(F.lit(x) for kv in d.items() for x in kv)), c)
    for pattern, kinds in reversed(FORMS):
        g = {k: F.regexp_extract(low, pattern, i + 1) for i, k in enumerate(kinds)}
        month = g["m"].cast("int") if "m" in g else table(g["n"], MONTH) if "n" in g else table(g["q"], PART_MONTH) if "q" in g else F.lit(1)
        day = g["d"].cast("int") if "d" in g else table(g["p"], PART_DAY) if "p" in g else F.lit(1)
        named = F.concat_ws("-", g["y"], F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
        out = F.when(low.rlike(pattern), named).otherwise(out)
    return out


def _later(day: str, days: int) -> str | None:
    try:
        return (date.fromisoformat(day) + timedelta(days=days)).isoformat()
    except ValueError:
        return None


class TimeWindow:
    """What a question says of time: window (days, inclusive), whether order matters, and the date it refers to."""

    def __init__(self) -> None:
        self.temporal = self.chronological = self.trajectory = False
        self.after: str | None = None
        self.before: str | None = None
        self.reference: str | None = None

    def set(self, after: str | None = None, before: str | None = None, chronological: bool = False) -> None:
        """Take bounds that are told and not yet known."""
        if after or before:
            self.temporal = True
            self.chronological |= chronological
        self.after, self.before = self.after or after, self.before or before

    def row(self) -> tuple:
        return self.temporal, self.after, self.before, self.chronological, self.trajectory, self.reference


def time_window(query: str | None, now: date) -> TimeWindow:
    """The window of one question; ``now`` resolves yesterday and last week. Null and empty questions say nothing."""
    w, text = TimeWindow(), (query or "").strip()
    low = text.lower()
    w.trajectory = w.chronological = w.temporal = any(re.search(p, low) for p in TRAJECTORY)
    bracket = lambda at: m[1] if (m := re.search(r"\(([^)]+)\)", text[at:])) else ""

    for a, b in (("from", "to"), ("between", "and")):  # a range
        m = re.search(rf"\b{a}\s+(.+?)\s+{b}\s+(.+?)(?:\?|$|\.)", low)
        if m and (a == "from" or not w.after):
            first, last = first_day(m[1]), first_day(m[2])
            w.temporal |= bool(first or last)
            w.after, w.before = first or w.after, last or w.before
    if not w.after and not w.before and (m := re.search(rf"\bin\s+{_M}\s+(\d{{4}})\b", low)):
        first = date(int(m[2]), MONTH[m[1]], 1)
        w.set(first.isoformat(), ((first + timedelta(days=31)).replace(day=1) - timedelta(days=1)).isoformat())
    if not w.after and not w.before and (m := re.search(r"\bin\s+(20\d{2})\b", low)):
        w.set(f"{m[1]}-01-01", f"{m[1]}-12-31")
    for word in ("after", "before"):  # up to the sentence's end, with a date in brackets behind it
        m = re.search(rf"\b{word}\s+(.+?)(?:\?|$|\.\s|\band\b)", low)
        if m and getattr(w, word) is None and (day := first_day(f"{m[1].rstrip(', ')} {bracket(m.start())}")):
            w.set(**{word: day})
            if word == "after":
                w.reference, w.chronological = day, True
    if (m := re.search(r"\bas\s+of\s+(.+?)(?:\?|$|,)", low)) and (day := first_day(m[1])):
        w.reference = day
        w.set(**{"after" if re.search(AHEAD, low) else "before": day})
    if re.search(AHEAD, low):
        w.temporal = w.chronological = True
        w.after = w.after or w.reference
    m = re.search(r"\b(?:first|next)\s+(month|week|year)\b", low) or re.search(r"\b(month)\s+after\b", low)
    if m and w.after and not w.before:
        w.set(before=_later(w.after, AFTER_DAYS[m[1]]), chronological=True)
    if not w.after and not w.before:  # relative to now
        if re.search(r"\byesterday\b", low):
            w.set(_later(now.isoformat(), -1), _later(now.isoformat(), -1), True)
        elif m := re.search(r"\blast\s+(\d+)\s+(day|week|month|year)s?\b", low) or re.search(r"\blast\s+()(week|month|year)\b", low):
            w.set(_later(now.isoformat(), -int(m[1] or 1) * UNIT_DAYS[m[2]]), now.isoformat(), True)
    if w.reference is None and (day := first_day(bracket(0))):
        w.reference, w.temporal = day, True
        if w.after is None and re.search(r"\bafter\b", low):
            w.set(day, chronological=True)
            if re.search(r"\bmonth\s+after\b", low):
                w.before = _later(day, 31)
    if not w.temporal and (day := first_day(text)):
        w.reference, w.temporal = day, True
    return w
