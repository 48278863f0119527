"""All valid interpretations of one textual timestamp.

``interpretations(text, zone)`` gives a list of (cost, form, utc_us). ``cost`` counts how
many conventions the reading breaks (0: none), ``form`` names format and zone handling so
that switches of format can be seen. Dates with dashes and the year last have two readings
that no convention separates; the path over the neighbouring records chooses. Text that
denotes no instant gives an empty list.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

# Offsets in minutes of European and North American zone abbreviations.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "HDT": -540,
}
# English month names by their first three letters.
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
FULL_MONTHS = {
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "sept", *MONTHS,
}
PLAIN = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?Z")
_TIME = r"(?P<h>\d{1,2})(?::(?P<mi>\d\d)(?::(?P<s>\d\d)(?:[.,](?P<f>\d+))?)?)?\s*(?P<ap>[ap]\.?m\.?)?"
_TAIL = r"\s*(?P<off>[+-]\d{2}(?::?\d{2})?(?::?\d{2})?|[A-Za-z]{1,4})?\s*(?:\[(?P<zone>[A-Za-z][A-Za-z0-9_+/-]*)\])?"
_DAY_NAME = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_DATES = (
    ("iso", r"(?P<y>\d{4})-(?P<mo>\d{1,2})-(?P<d>\d{1,2})"),
    ("ymd_slash", r"(?P<y>\d{4})/(?P<mo>\d{1,2})/(?P<d>\d{1,2})"),
    ("slash", r"(?P<a>\d{1,2})/(?P<b>\d{1,2})/(?P<y>\d{4})"),
    ("dot", r"(?P<a>\d{1,2})\.(?P<b>\d{1,2})\.(?P<y>\d{4})"),
    ("dash", r"(?P<a>\d{1,2})-(?P<b>\d{1,2})-(?P<y>\d{4})"),
    ("dmy_name", _DAY_NAME + r"(?P<d>\d{1,2})(?:st|nd|rd|th)?[\s-]+(?P<mon>[A-Za-z]{3,9})\.?,?[\s-]+(?P<y>\d{4})"),
    ("mdy_name", _DAY_NAME + r"(?P<mon>[A-Za-z]{3,9})\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})"),
    ("compact", r"(?P<y>\d{4})(?P<mo>\d\d)(?P<d>\d\d)(?=T)"),
)
_FORMS = [(n, re.compile(d + r"(?:(?:[T\s]|,?\s+at\s+|,\s*)\s*" + _TIME + ")?" + _TAIL, re.I)) for n, d in _DATES]
_COMPACT_TIME = re.compile(r"(\d{8})T(\d\d)(\d\d)(\d\d)?(?:\.(\d+))?(.*)", re.I | re.S)
_DIGITS = re.compile(r"[+-]?\d+")
_DECIMAL = re.compile(r"(-?\d+)\.(\d+)")
_EPOCH = datetime(1970, 1, 1)
_MICRO = timedelta(microseconds=1)


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


def _us(local: datetime) -> int:
    return (local - _EPOCH) // _MICRO


@lru_cache(maxsize=65_536)
def _hour_offsets(zone: ZoneInfo, hour: datetime) -> tuple[int, ...] | None:
    """Offsets in minutes if they are the same through the local hour: (earlier reading, later); else None."""
    ends = [tuple(int(t.replace(tzinfo=zone, fold=k).utcoffset().total_seconds()) for k in (0, 1)) for t in (hour, hour + timedelta(minutes=59, seconds=59))]
    return ends[0] if ends[0] == ends[1] else None


def _local(local: datetime, zone: ZoneInfo) -> list[tuple[int, str, int]]:
    """Readings of a local time: the earlier one, or in a gap the one by the offset before, breaks no convention."""
    both = _hour_offsets(zone, local.replace(minute=0, second=0, microsecond=0))
    if both is None:
        both = tuple(int(local.replace(tzinfo=zone, fold=k).utcoffset().total_seconds()) for k in (0, 1))
    base = _us(local)
    out = [(0, "", base - both[0] * 1_000_000)]
    if both[1] != both[0]:
        out.append((1, "~late", base - both[1] * 1_000_000))
    return out


def _offset(text: str) -> int | None:
    """Seconds of an offset or abbreviation; None if there is no such thing."""
    if text[0] in "+-":
        d = text[1:].replace(":", "")
        h, m, s = int(d[:2]), int(d[2:4] or 0), int(d[4:6] or 0)
        if h > 18 or m > 59 or s > 59:
            return None
        return (-1 if text[0] == "-" else 1) * (h * 3600 + m * 60 + s)
    m = ABBREVIATIONS.get(text.upper())
    return None if m is None else m * 60


def _digits(t: str) -> list[tuple[int, str, int]]:
    m = _DECIMAL.fullmatch(t)
    if m:
        return [(0, "epoch_s.f", int(m[1]) * 1_000_000 + (-1 if t[0] == "-" else 1) * int((m[2] + "000000")[:6]))]
    n = int(t)
    scales = (("epoch_s", 1_000_000, 10**11), ("epoch_ms", 1_000, 10**14), ("epoch_us", 1, 10**17))
    for i, (name, unit, limit) in enumerate(scales):
        if abs(n) < limit:
            out = [(0, name, n * unit)]
            if len(t) == 8 and t[0] in "12":  # the same digits could be a compact date
                try:
                    out.append((1, "compact", _us(datetime.strptime(t, "%Y%m%d"))))
                except ValueError:
                    pass
            return out
    return []


def interpretations(text: str | None, zone: str | None) -> list[tuple[int, str, int]]:
    """All readings of ``text``; ``zone`` is the IANA zone that holds where the text states none (None: UTC).

    Null, blank, impossible dates and other text give []. White space around is ignored.
    """
    if text is None:
        return []
    t = text.strip()
    if not t:
        return []
    if PLAIN.fullmatch(t):
        try:
            whole, _, frac = t[:-1].partition(".")
            return [(0, "iso_z", _us(datetime.fromisoformat(whole)) + int((frac + "000000")[:6]))]
        except ValueError:
            return []
    if _DIGITS.fullmatch(t) or _DECIMAL.fullmatch(t):
        return _digits(t)
    if m := _COMPACT_TIME.fullmatch(t):
        t = f"{m[1][:4]}-{m[1][4:6]}-{m[1][6:]}T{m[2]}:{m[3]}:{m[4] or '00'}" + (f".{m[5]}" if m[5] else "") + m[6]
    for name, form in _FORMS:
        m = form.fullmatch(t)
        if m:
            break
    else:
        return []
    g = m.groupdict()
    if g.get("ap") and not 1 <= int(g["h"]) <= 12:
        return []
    hour = int(g["h"] or 0)
    if g.get("ap"):
        hour = hour % 12 + (12 if g["ap"][0] in "pP" else 0)
    if g.get("h") and g.get("mi") is None and not g.get("ap"):
        return []
    micro = int(((g.get("f") or "") + "000000")[:6])
    if "a" in g:
        a, b = int(g["a"]), int(g["b"])
        # slashes are month first, dots day first; no convention tells for dashes, so both orders cost the same
        order = {"slash": [(0, "mdy", a, b), (1, "dmy", b, a)], "dot": [(0, "dmy", b, a), (1, "mdy", a, b)], "dash": [(0, "mdy", a, b), (0, "dmy", b, a)]}[name]
        if a == b and name != "dash":
            order.pop()
    elif "mon" in g:
        if g["mon"].lower() not in FULL_MONTHS:
            return []
        order = [(0, "", MONTHS[g["mon"][:3].lower()], int(g["d"]))]
    else:
        order = [(0, "", int(g["mo"]), int(g["d"]))]
    locals_: list[tuple[int, str, datetime]] = []
    for k, (cost, tag, mo, d) in enumerate(order):
        try:
            locals_.append((cost, tag, datetime(int(g["y"]), mo, d, hour, int(g["mi"] or 0), int(g["s"] or 0), micro)))
        except ValueError:
            if k == 0 and name != "dash":  # the conventional order names no date, so the text denotes none
                return []
    stated = _offset(g["off"]) if g.get("off") else None
    if g.get("off") and stated is None:
        return []
    named = _zone(g["zone"]) if g.get("zone") else None
    if g.get("zone") and named is None and stated is None:
        return []
    out: list[tuple[int, str, int]] = []
    for cost, tag, local in locals_:
        form = f"{name}{tag}"
        if stated is not None:
            out.append((cost, f"{form}+off", _us(local) - stated * 1_000_000))
        elif named is not None:
            out += [(cost + c, f"{form}+zone{x}", us) for c, x, us in _local(local, named)]
        else:
            z = _zone(zone) if zone else None
            if z is not None:
                out += [(cost + c, f"{form}+home{x}", us) for c, x, us in _local(local, z)]
                out.append((cost + 2, f"{form}+utc", _us(local)))
            else:
                out.append((cost, f"{form}+utc", _us(local)))
    return out
