"""Personal information in free text, by a semi-Markov conditional random field.

Candidate segments of each type come from bounded patterns; features look at a whole
segment and at the words on both sides. The field gives each segmentation of a text the
exponential of the sum of its segments' weights (text outside segments weighs 0, and two
neighbouring segments weigh by their types); dynamic programming over segment ends finds
the best segmentation, so boundaries and types are decided jointly. A segment has at most
MAX_SEGMENT characters. Weights are trained here, by gradient ascent on the likelihood of
TRAINING_TEXTS and NEW_TEXTS made-up texts. Candidates for names of persons are spans around a
family name of the lexicon of known ones, in any case, and spans of capitalised words or initials;
whether the lexicon knows their parts is a feature.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")
MAX_SEGMENT, TRAINING_TEXTS, TRAINING_ROUNDS, CUE_WORDS = 120, 1_500, 60, 3
#: Made-up texts more, with names and capitalised words that are in no lexicon.
NEW_TEXTS = 600
#: A worker remembers whether so many words are family names.
CACHE_WORDS = 500_000

_W = r"[^\W\d_]"
_NAMEWORD = rf"{_W}+(?:[-'’]{_W}+)*"
_DASH = r"[-‐-―]"

# Street words and number labels by language.
_STREET = (
    "street|st|road|rd|avenue|ave|lane|ln|court|ct|drive|dr|boulevard|blvd|way|place|pl|terrace|close|crescent|square|sq|row|gardens|parkway|pkwy|circle|trail|hill|grove|mews|walk|highway|hwy|loop|alley"
)
_UNIT = rf"(?:,?\s+(?:(?:apt|apartment|flat|unit|suite|ste|room|rm|floor|fl|apto|piso|appt|appartement|whg|bus)\b\.?\s*#?\s*(?:\d{{1,5}}{_W}?|{_W})\b|\#\s?\d{{1,5}}{_W}?\b))?"
_PARTICLES = r"(?:(?:de\s+la|de\s+los|de\s+las|de|du|des|del|della|do|da|dos|das|van\s+der|van\s+de|van|der|den)\s+|(?:de\s+l|d|l)['’]\s*)?"

_AT = r"(?:\s*(?:\[\s*at\s*\]|\(\s*at\s*\)|\{\s*at\s*\}|<\s*at\s*>)\s*|\s+at\s+)"
_AT_SURE = r"(?:\s*(?:\[\s*at\s*\]|\(\s*at\s*\)|\{\s*at\s*\}|<\s*at\s*>)\s*|\s+@\s+|\s+@|@\s+)"
_DOT = r"(?:\s*(?:\[\s*dot\s*\]|\(\s*dot\s*\)|\{\s*dot\s*\}|<\s*dot\s*>)\s*|\s+dot\s+)"
EMAIL = re.compile(
    r"(?<![\w.+%'-])[\w.+%'-]*\w@(?:[\w-]+\.)+[^\W\d_][\w-]*"
    rf"|(?<![\w.+%-])[\w.+%-]*\w(?:{_AT}|{_AT_SURE}|@)[\w-]+(?:\.[\w-]+)*(?:{_DOT}[\w-]+(?:\.[\w-]+)*)+"
    rf"|(?<![\w.+%-])[\w.+%-]*\w{_AT_SURE}[\w-]+(?:\.[\w-]+)+", re.I,
)
PHONE = re.compile(r"(?<![\w/#.@-])(?:\+\s?\d|\(\+?\d|\d)[\d() ./ ‐-―-]{5,24}\d(?![\w/]|[.-]\d)")
ID = re.compile(
    rf"(?<![\w/-])(?:\d{{3}}[- ]?\d{{2}}[- ]?\d{{4}}|{_W}{{2}} ?\d\d ?\d\d ?\d\d ?[A-Da-d]|{_W}?\d{{7,8}}[- ]?{_W}|{_W}{{1,2}}\d{{6,9}}|{_W}\d{{3}}(?:[- ]\d{{3,4}}){{2,3}}"
    rf"|\d{{2,3}}/\d{{3}}/\d{{4,5}}|\d{{2,3}}(?: \d{{3}}){{3}}|\d{{9,12}}|\d{{3}}\.\d{{3}}\.\d{{3}}-\d\d|[12] ?\d\d ?\d\d ?\d\d ?\d{{3}} ?\d{{3}}(?: ?\d\d)?"
    rf"|{_W}{{5,6}}\d{{6}}{_W}{{2}}\d{{0,2}}|(?=[\w-]*\d[\w-]*\d[\w-]*\d[\w-]*\d)[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)(?![\w/]|-\w)"
)
_NUMBER_FIRST = rf"(?<![\w/.-])\d{{1,5}}(?:{_W}|\s?(?:bis|ter))?,?\s+"
_ROMANCE = "calle|avenida|avda|plaza|paseo|camino|carrera|rua|travessa|praça|praca|largo|via|viale|piazza"
_FRENCH = "rue|avenue|allée|allee|boulevard|place|chemin|impasse|quai|cours|route|passage|square"
_GERMANIC = "straße|strasse|straat|str.|gasse|weg|platz|allee|ring|damm|ufer|laan|gracht|plein|kade|singel"
_BOX = "box|postfach|postbus|apartado|boîte|bp|b|caixa"
#: Patterns of addresses; each is tried on texts with one of its words (as a whole word, or None) or strings (anywhere).
ADDRESSES = [
    (set(_STREET.split("|")), (), re.compile(
        rf"{_NUMBER_FIRST}(?:(?:old|new|north|south|east|west|upper|lower|great|little|[nsew])\.?\s+)*{_NAMEWORD}(?:\s+{_NAMEWORD}){{0,2}}?\s+(?:{_STREET})\b\.?(?:\s+(?:north|south|east|west|[nsew])\b\.?)?{_UNIT}", re.I)),
    (set(_FRENCH.split("|")), (), re.compile(rf"{_NUMBER_FIRST}(?:{_FRENCH})\s+{_PARTICLES}{_NAMEWORD}(?:-{_NAMEWORD})*{_UNIT}", re.I)),
    ({*_ROMANCE.split("|"), "c"}, (), re.compile(rf"(?<!\w)(?:{_ROMANCE}|avda\.|c/)\s*{_PARTICLES}{_NAMEWORD}(?:\s+{_NAMEWORD})?,?\s+(?:n\.?\s?[º°o]\.?\s*)?\d{{1,5}}{_W}?\b{_UNIT}", re.I)),
    (set(), tuple(_GERMANIC.split("|")), re.compile(rf"(?<!\w){_NAMEWORD}(?:\s+)?(?:{_GERMANIC.replace('.', chr(92) + '.')})\s+\d{{1,5}}{_W}?\b{_UNIT}", re.I)),
    (set(_BOX.split("|")), (), re.compile(
        r"(?<!\w)(?:p\.?\s?o\.?\s?box|post\s?office\s+box|postal\s+box|postfach|postbus|apartado(?:\s+de\s+correos)?|boîte\s+postale|b\.?p\.?|caixa\s+postal)\s+(?:no\.?\s*)?\d{1,6}\b", re.I)),
]
_DIGIT = re.compile(r"\d")
#: Five digits with little between them, which every phone and identity number has.
_DIGITS = re.compile(r"\d[^\d]{0,4}\d[^\d]{0,4}\d[^\d]{0,4}\d[^\d]{0,4}\d")
_TOKEN = re.compile(rf"{_W}+(?:['’]{_W}+)?")
# Words before a segment that speak for or against a type.
CUES = {
    "phone": "call me on text cell mobile phone tel telephone fax number reach whatsapp ring dial contact hotline".split(),
    "id_number": "ssn social security passport licence license dni nie nif tax id ni national insurance sozialversicherungsnummer steuer steuernummer nino tin cpf bsn identity card no number nr soc sec".split(),
    "address": "lives live at to moved address ship send street home visit near is".split(),
    "name": "ask mr mrs ms miss dr prof dentist doctor contact met with from by friend colleague boss neighbour named signed regards cc meet sister brother called lawyer landlord talked spoke".split(),
    "email": "mail mailto email write to cc contact send".split(),
    "reference": "parcel order invoice case build port ticket folder gate flight version v room row rows birds issue pr commit line step page chapter ratio from plan costs".split(),
}
_CUE_OF = defaultdict(set)
for _kind, _ws in CUES.items():
    for _w in _ws:
        _CUE_OF[_w].add(_kind)
_AFTER = {"called", "said", "says", "at", "they", "moved", "wrote", "asked", "is", "was", "will", "told", "thinks", "lives", "and", "or", "signed", "agreed", "takes", "took"}


class Lexicon:
    """Known parts of persons' names: given names, family names, and family names put together from their halves."""

    def __init__(self, persons: list[str]):
        parts = [p.split() for p in persons if p and len(p.split()) >= 2]
        self.given = {x[0] for x in parts}
        self.family = {x[-1] for x in parts}
        heads, tails = defaultdict(set), defaultdict(set)
        for f in self.family:
            for i in range(3, len(f) - 2):
                heads[f[:i]].add(f[i:])
                tails[f[i:]].add(f[:i])
        self.heads = {h for h, t in heads.items() if len(t) >= 3}
        self.tails = {t for t, h in tails.items() if len(h) >= 3}
        self.seen: dict[str, bool] = {}

    def known(self, w: str) -> bool:
        """Whether a word is a family name or put together like one; the last CACHE_WORDS words are remembered."""
        out = self.seen.get(w)
        if out is None:
            if len(self.seen) >= CACHE_WORDS:
                self.seen.clear()
            out = self.seen[w] = w in self.family or self.like(w)
        return out

    def like(self, w: str) -> bool:
        return any(w[:i] in self.heads and w[i:] in self.tails for i in range(3, len(w) - 2))


def _before(text: str, at: int) -> list[str]:
    return [w.lower() for w in _TOKEN.findall(text[max(0, at - 40) : at])[-CUE_WORDS:]]


def _context(kind: str, text: str, a: int, b: int) -> list[str]:
    words, out = _before(text, a), []
    for d, w in enumerate(reversed(words)):
        for k in _CUE_OF.get(w, ()):
            if k == kind or (k == "reference" and kind in ("phone", "id_number")):
                out.append(f"{kind}:cue_{'own' if k == kind else 'ref'}{1 if d == 0 else 2}")
    return list(dict.fromkeys(out))


def _phone_features(text: str, a: int, b: int) -> list[str]:
    s = text[a:b]
    digits = sum(c.isdigit() for c in s)
    groups = re.findall(r"\d+", s)
    out = ["phone", f"phone:digits{min(max(digits, 7), 15)}"]
    if s.startswith(("+", "(+")) or (s.startswith("00") and digits >= 11):
        out.append("phone:country")
    elif s[0] == "(":
        out.append("phone:area")
    elif re.fullmatch(r"\d{3}[-. ]\d{3}[-. ]\d{4}", s):
        out.append("phone:us")
    elif s[0] == "0" and digits >= 10:
        out.append("phone:trunk")
    else:
        out.append("phone:other")
    if len(groups) == 1 and s[0] not in "+0":
        out.append("phone:plain")
    if "/" in s:
        out.append("phone:slash")
    if min(map(len, groups)) == 1 and not out[-1] == "phone:country" and "(" not in s:
        out.append("phone:single")
    if re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}", s):
        out.append("phone:ssn_shape")
    return out


def _id_features(text: str, a: int, b: int) -> list[str]:
    s = text[a:b]
    shape = re.sub(r"9+", lambda m: f"9{len(m[0])}" if len(m[0]) < 10 else "9x", re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "9", s)))
    return ["id_number", f"id_number:{shape}" if len(shape) <= 24 else "id_number:long", f"id_number:letters{bool(re.search(_W, s))}"]


def _address_features(text: str, a: int, b: int) -> list[str]:
    s = text[a:b].lower()
    out = ["address"]
    if re.match(r"p\.?\s?o|post|apartado|b\.?p|bo[iî]te|caixa", s):
        out.append("address:box")
    elif s[0].isdigit():
        out.append("address:number_first")
        inner = [w for w in _TOKEN.findall(s)][:-1]
        if any(w in ("on", "of", "in", "the", "a", "for", "and", "to", "from", "rows", "birds", "behind", "is") for w in inner):
            out.append("address:stop_word")
    else:
        out.append("address:street_first")
    if re.search(_UNIT[:-1], s) and s[-1:].isalnum() and ("#" in s or re.search(r"apt|flat|unit|suite|room|floor|appt", s)):
        out.append("address:unit")
    return out


_NAME_FORMS = (
    ("gf", re.compile(rf"({_NAMEWORD})\s({_NAMEWORD})")), ("gif", re.compile(rf"({_NAMEWORD})\s{_W}\.?\s({_NAMEWORD})")),
    ("if", re.compile(rf"({_W})\.?\s(?:{_W}\.\s?)?({_NAMEWORD})")), ("fg", re.compile(rf"({_NAMEWORD}),?\s({_NAMEWORD})(?:\s{_W}\b\.?)?")), ("fi", re.compile(rf"({_NAMEWORD}),?\s({_W})\.")),
)


def _shape(w: str) -> str:
    return "up" if len(w) > 1 and w.isupper() else "cap" if w[0].isupper() else "low"


_TITLES = set("ask mr mrs ms miss dr prof dentist doctor friend colleague boss neighbour sister brother lawyer landlord named called met signed regards".split())
_PLACES = {"project", "lake", "gate", "port", "room", "version"}
_THINGS = {"hall", "desk", "street", "road", "lane", "avenue", "group", "plan", "house", "test", "example", "invalid"}


def _new_names(text: str, tokens: list[tuple[int, int, str]], known: set[str], lex: Lexicon) -> list[tuple[int, int, list[str]]]:
    """Spans of capitalised words and initials whose family name no lexicon knows, with features of their own."""
    out = []
    shape = [_shape(text[a:b]) if b - a > 1 else "init" if text[a].isupper() else "low" for a, b, _ in tokens]

    def add(form: str, i: int, j: int, g: int, fam: int) -> None:
        x, y, kind = tokens[i][0], tokens[j][1], "init" if shape[g] == "init" else "given" if tokens[g][2] in lex.given else "word"
        beside = [shape[q] for q in (i - 1, j + 1) if 0 <= q < len(tokens) and tokens[q][2] not in _TITLES]
        if kind != "given" and beside and (set(beside) & {"up", "init"} if shape[fam] == "up" else set(beside) == {"cap"}):
            return  # all words around have capitals, so they say nothing
        before, nxt = _before(text, x), _TOKEN.search(text[y : y + 20])
        title = bool(before) and before[-1] in _TITLES
        start = not text[:x].rstrip() or text[:x].rstrip()[-1] in ".!?:-" and not title
        f = ["new", f"new:{form}", f"new:{kind}", f"new:{kind}:title{title}", f"new:{kind}:{shape[fam]}", f"new:{kind}:start{start}"]
        if before and "name" in _CUE_OF.get(before[-1], ()):
            f.append(f"new:{kind}:cue")
        if nxt and nxt[0].lower() in _AFTER:
            f.append(f"new:{kind}:after")
        if before and before[-1] in ("project", "lake", "the", "a", "in", "to", "at") or nxt and nxt[0].lower() in _THINGS or tokens[fam][2] in _THINGS or tokens[i][2] in _PLACES:
            f.append("new:thing")
        out.append((x, y, f))

    word = lambda i: tokens[i][2] not in _CUE_OF and tokens[i][2] not in _AFTER
    for k, (a, b, w) in enumerate(tokens):
        if shape[k] not in ("cap", "up") or b - a < 3 or w in known or not word(k):
            continue
        if k and shape[k - 1] == "init" and re.fullmatch(r"\.?\s+", text[tokens[k - 1][1] : a]) and tokens[k - 1][2] != "i":
            add("if", k - 1, k, k - 1, k)
            if k > 1 and shape[k - 2] == shape[k] and word(k - 2) and text[tokens[k - 2][1] : tokens[k - 1][0]].isspace():
                add("gif", k - 2, k, k - 2, k)
        elif k and shape[k - 1] == shape[k] and word(k - 1) and re.fullmatch(r"[^\S\n]+", text[tokens[k - 1][1] : a]):
            add("gf", k - 1, k, k - 1, k)
        if k + 1 < len(tokens) and tokens[k + 1][2] in lex.given and shape[k + 1] == shape[k] and re.fullmatch(r",\s", text[b : tokens[k + 1][0]]):
            add("f,g", k, k + 1, k + 1, k)
    return out


def _name_candidates(text: str, lex: Lexicon, tokens: list[tuple[int, int, str]], known: set[str]) -> list[tuple[int, int, list[str]]]:
    """Spans around each known or likely family name, with features."""
    out = []
    for k, (a, b, w) in enumerate(tokens):
        if w not in known:
            continue
        fam = "fam" if w in lex.family else "like"

        def gap(i: int) -> str:  # text between token i and the next
            return text[tokens[i][1] : tokens[i + 1][0]]

        def given(i: int) -> str:
            g = tokens[i][2]
            return "init" if len(g) == 1 else "given" if g in lex.given else "fam2" if g in known else "word"

        def add(form: str, x: int, y: int, g: int) -> None:
            shapes = {_shape(text[tokens[g][0] : tokens[g][1]]), _shape(text[a:b])}
            kind = given(g)
            case = "up" if shapes == {"up"} else "cap" if shapes == {"cap"} or (kind == "init" and "cap" in shapes | {"cap"} and "low" not in shapes) else "low" if shapes == {"low"} else "mixed"
            nxt = _TOKEN.search(text[y : y + 20])
            f = ["name", f"name:{kind}+{fam}", f"name:{form}", f"name:{kind}:{case}", *_context("name", text, x, y)]
            if nxt and nxt[0].lower() in _AFTER:
                f.append("name:after")
            before = _before(text, x)
            if before and before[-1] in ("project", "lake", "the", "a"):
                f.append("name:thing")
            if nxt and nxt[0].lower() in ("hall", "desk", "street", "road", "lane", "avenue", "group", "plan", "house", "test", "example", "invalid"):
                f.append("name:thing")
            out.append((x, y, f))

        if k and re.fullmatch(r"\s+", gap(k - 1)) or (k and given(k - 1) == "init" and re.fullmatch(r"\.?\s*", gap(k - 1))):
            if given(k - 1) != "init":
                add("gf", tokens[k - 1][0], b, k - 1)
            else:
                two = k > 1 and re.fullmatch(r"\s+", gap(k - 2)) and given(k - 2) in ("given", "word", "fam2")
                if two and given(k - 2) == "given":
                    add("gif", tokens[k - 2][0], b, k - 2)
                elif k > 1 and given(k - 2) == "init" and re.fullmatch(r"\.\s?", gap(k - 2)):
                    add("iif", tokens[k - 2][0], b, k - 2)
                elif two and _shape(text[tokens[k - 2][0] : tokens[k - 2][1]]) != "low":
                    add("gif", tokens[k - 2][0], b, k - 2)
                add("if", tokens[k - 1][0], b, k - 1)
        if k + 1 < len(tokens) and re.fullmatch(r",?\s+", gap(k)):
            comma, end = "," in gap(k), tokens[k + 1][1]
            if given(k + 1) == "init":
                if text[end : end + 1] == ".":
                    end += 1
                if comma:
                    more = re.match(rf"\s?({_W})\.(?!\w)", text[end:])
                    add("f,i", a, end + (more.end() if more else 0), k + 1)
            elif given(k + 1) == "given":
                add("f,g" if comma else "fg", a, end, k + 1)
                more = re.match(rf"\s({_W})\b(\.?)(?!\w)", text[end:])
                if more and (more[2] or more[1].isupper()):
                    add("f,gi" if comma else "fgi", a, end + more.end(), k + 1)
            elif comma and _shape(text[tokens[k + 1][0] : end]) == _shape(text[a:b]) == "cap":
                add("f,w", a, end, k + 1)
    return out


#: A capital soon followed by another word with a capital (letters of other scripts may pass without being one).
_TWO_CAPITALS = re.compile(r"[^\W\d_a-z][\w'’]*[.,]?\s+[^\W\d_a-z]")


def candidates(text: str, lex: Lexicon) -> list[tuple[int, int, str, list[str]]]:
    """Candidate segments (begin, end, kind, features) of a text."""
    out: list[tuple[int, int, str, list[str]]] = []
    low = text.lower()
    tokens = _TOKEN.findall(low)
    if "@" in text or "dot" in low or ("at" in tokens and ("[" in text or "(" in text or "{" in text or "<" in text)):
        for m in EMAIL.finditer(text):
            s = m[0]
            a = m.start() + (len(s) - len(s.lstrip(".+-%'")))
            tld = re.search(rf"({_W}+)$", s.rstrip("-_0123456789"))
            out.append((a, m.end(), "email", ["email", "email:at" if "@" in s else "email:words", "email:dots" if "." in s.split("@")[-1] else "email:nodot",
                                              f"email:tld{bool(tld and 2 <= len(tld[1]) <= 12)}", *_context("email", text, a, m.end())]))
    if _DIGITS.search(text):
        for m in PHONE.finditer(text):
            a, b = m.span()
            if 7 <= sum(c.isdigit() for c in m[0]) <= 15 and m[0].count("(") == m[0].count(")"):
                out.append((a, b, "phone", [*_phone_features(text, a, b), *_context("phone", text, a, b)]))
        for m in ID.finditer(text):
            a, b = m.span()
            if sum(c.isdigit() for c in m[0]) >= 5:
                out.append((a, b, "id_number", [*_id_features(text, a, b), *_context("id_number", text, a, b)]))
    if _DIGIT.search(text):
        for words, parts, pattern in ADDRESSES:
            if not words.isdisjoint(tokens) or any(p in low for p in parts):
                for m in pattern.finditer(text):
                    a, b = m.span()
                    out.append((a, b, "address", [*_address_features(text, a, b), *_context("address", text, a, b)]))
    get = lex.seen.get
    known = {w for w in tokens if (k := get(w)) or k is None and lex.known(w)}
    capitals = _TWO_CAPITALS.search(text)
    if known or capitals:
        spans = [(m.start(), m.end(), m[0].lower()) for m in _TOKEN.finditer(text)]
        if known:
            out += [(a, b, "name", f) for a, b, f in _name_candidates(text, lex, spans, known)]
        if capitals:
            out += [(a, b, "name", f) for a, b, f in _new_names(text, spans, known, lex)]
    return [c for c in out if c[1] - c[0] <= MAX_SEGMENT]


def _ordered(cands: list[tuple[int, int, str, list[str]]]) -> tuple[list, list[int]]:
    """Candidates in order of their ends, and for each the number of those that end before it begins."""
    cs = sorted(cands, key=lambda c: (c[1], c[0]))
    ends = [c[1] for c in cs]
    return cs, [bisect_right(ends, c[0], 0, i) for i, c in enumerate(cs)]


class Field:
    """Weights of the field's features, and of each pair of types of neighbouring segments (the first has none before it)."""

    def __init__(self, weights: dict[str, float], steps: dict[tuple[str, str], float]):
        self.weights, self.steps = weights, steps

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def best(self, cands: list[tuple[int, int, str, list[str]]]) -> list[tuple[int, int, str]]:
        """The segmentation of largest weight; on ties the one with fewer, then earlier segments.

        The state behind the first i candidates is the type of the last segment taken: at most one
        entry for each type, so the work is linear in the candidates.
        """
        if not cands:
            return []
        if len(cands) == 1:
            a, b, kind, f = cands[0]
            return [(a, b, kind)] if self.score(f) + self.steps.get(("", kind), 0.0) > 0 else []
        cs, before = _ordered(cands)
        tops: list[dict[str, tuple[float, tuple | None]]] = [{"": (0.0, None)}]  # weight, chain of segments
        for (a, b, kind, f), j in zip(cs, before):
            now = dict(tops[-1])
            w, last = max(((v + self.steps.get((k, kind), 0.0), chain) for k, (v, chain) in tops[j].items()), key=lambda x: x[0])
            w += self.score(f)
            if kind not in now or w > now[kind][0]:
                now[kind] = (w, ((a, b, kind), last))
            tops.append(now)
        out, chain = [], max(tops[-1].values(), key=lambda x: x[0])[1]
        while chain is not None:
            out.append(chain[0])
            chain = chain[1]
        return out[::-1]


def _made_up(rng: random.Random, lex: Lexicon) -> tuple[str, set[tuple[int, int, str]]]:
    """One training text with its segments."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    syl = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    word = lambda: rng.choice([syl(), syl().capitalize()])
    given = lambda: rng.choice(_GIVEN) if rng.random() < 0.75 else syl().capitalize()
    family = lambda: rng.choice(_FAMILY)

    def name() -> str:
        g, f, i = given(), family(), rng.choice("ABCDEFGHKLMNPRST")
        s = rng.choice([f"{g} {f}"] * 6 + [f"{f}, {g}", f"{g[0]}. {f}", f"{g} {i}. {f}", f"{f} {g}", f"{f}, {g} {i}.", f"{f}, {g[0]}."])
        return rng.choice([s] * 6 + [s.upper(), s.lower()])

    def email() -> str:
        local = rng.choice([f"{syl()}.{syl()}", f"{syl()}{d(2)}", f"{syl()}_{syl()}", syl(), f"{given()[0].lower()}.{family().lower()}", f"{family().lower()}_{given().lower()}"])
        host = rng.choice([syl(), f"{syl()}-{syl()}"])
        tld = rng.choice(["com", "test", "example", "org", "invalid", "co"])
        return rng.choice([f"{local}@{host}.{tld}"] * 3 + [f"{local} at {host} dot {tld}", f"{local} [at] {host}.{tld}", f"{local} @ {host}.{tld}", f"{local} (at) mail.{host} (dot) {tld}", f"{local}(at){host}(dot){tld}"])

    def phone() -> str:
        return rng.choice([
            f"+1 {d(3)} 555 0{d(3)}", f"({d(3)}) 555-0{d(3)}", f"{d(3)}-555-{d(4)}", f"{d(3)}.555.{d(4)}", f"+44 7700 {d(6)}", f"+44 (0)20 7946 0{d(3)}", f"07700 {d(6)}",
            f"+33 1 {d(2)} {d(2)} {d(2)} {d(2)}", f"+49 30 {d(5)} {d(3)}", f"0049 (0)30 {d(5)}-{d(3)}", f"+1{d(10)}", f"01 {d(2)} {d(2)} {d(2)} {d(2)}", f"020 7946 {d(4)}", f"+31 6 {d(8)}",
        ])

    def id_number() -> tuple[str, str]:
        L = rng.choice("KLMNX")
        return rng.choice([
            ("ssn", f"{d(3)}-{d(2)}-{d(4)}"), ("soc sec", f"{d(3)} {d(2)} {d(4)}"), ("my social is", f"{d(3)}-{d(2)}-{d(4)}"), ("social security number:", f"{d(3)}-{d(2)}-{d(4)}"), ("ssn", d(9)),
            ("NI number", f"QQ {d(2)} {d(2)} {d(2)} {rng.choice('ABCD')}"), ("national insurance", f"QQ{d(6)}C"), ("DNI", f"{d(8)}{L}"), ("DNI", f"{d(8)}-{L}"), ("NIE", f"X{d(7)}{L}"),
            ("passport no.", f"{L}{d(8)}"), ("Passport:", f"{L}{d(8)}"), ("my passport is", f"{L}{L}{d(7)}"), ("passport", d(9)), ("driver's licence", f"{L}{d(3)}-{d(4)}-{d(4)}"), ("license #", f"{L}{d(3)}-{d(4)}-{d(4)}"),
            ("tax id", f"{d(2)}/{d(3)}/{d(5)}"), ("Steuernummer", f"{d(2)}/{d(3)}/{d(5)}"), ("Steuer-ID", f"{d(2)} {d(3)} {d(3)} {d(3)}"), ("tax id", d(11)), ("identity card", f"{L}{d(8)}"), ("driver's license", f"{L}{d(8)}"),
        ])

    def address() -> str:
        n, w = str(rng.randint(1, 400)), word().capitalize()
        unit = rng.choice(["", "", f", Apt {rng.randint(1, 30)}", f" #{rng.randint(1, 50)}", ", Flat A"])
        return rng.choice([
            f"{n} {w} {rng.choice(['Street', 'Road', 'Lane', 'Ave', 'Avenue', 'Court', 'Blvd', 'Drive'])}{unit}", f"{n} {rng.choice(['Old', 'West', 'North'])} {w} Lane{unit}", f"{n} {w.lower()} street",
            f"{n} rue de la {w}", f"{n} allée des {w}", f"{n} avenue {w}", f"Calle {w} {n}", f"Plaza {w} {n}", f"{w}straße {n}", f"{w}weg {n}", f"{w}gasse {n}a", f"PO Box {rng.randint(1, 2000)}", f"P.O. Box {n}",
        ])

    text, segs = "", set()

    def put(s: str, kind: str | None = None) -> None:
        nonlocal text
        if kind:
            segs.add((len(text), len(text) + len(s), kind))
        text += s

    for _ in range(rng.randint(1, 3)):
        r = rng.random()
        if r < 0.3:
            a, b = str(rng.randint(1, 30000)), str(rng.randint(1, 20))
            put(rng.choice([
                f"order {b}-{a}-{b} for {word()} left {word()}", f"the {word()} parcel {a} {b} {a} never reached the counter", f"case {b}/{a}/{b} about {word()} is closed, says the {word().capitalize()} Desk", f"invoice {a} for {word()} was paused",
                f"build {a} of {word()} is slow", f"{word()} v{b}.{a}.{b} ships today", f"the cache at port {a} answers", f"saw {a} birds on {word()} road behind {word()}", f"Project {word().capitalize()} and Lake {word().capitalize()} both count",
                f"meet at the {word().capitalize()} Hall entrance", f"the clone url is git@{word()}:core/{word()}", f"@{word()} can you look at {word()} dot matrix", f"the ratio fell from {a} to {b} percent", f"ticket {d(9)} is open", f"commit {d(10)} broke it",
                f"the {family()} report for {word()}", f"flight from {word()} to {word()} leaves at gate {a}", f"session {d(8)} was long", f"tracking number {d(12)}", f"pages {d(3)}-{d(3)}", f"the {family()} {word().lower()} plan", f"{word()} at {word()} was cheap",
            ]))
        elif r < 0.45:
            put(rng.choice(["call me on ", "new number ", "text ", "reach the plumber at ", "tel: ", "my cell is ", "the hotline moved to "]))
            put(phone(), "phone")
            put(rng.choice([" after the call", ", please save it", " when it is done", ", ask about it", ""]))
        elif r < 0.57:
            put(rng.choice(["write to ", "send it to ", "cc ", "new contact: ", "mailto:", "my mail is "]))
            put(email(), "email")
            put(rng.choice([" about the plan", " please", ", the other one bounced"]))
        elif r < 0.7:
            cue, s = id_number()
            put(rng.choice(["they asked again: ", "for the form, ", ""]) + cue + " ")
            put(s, "id_number")
            put(rng.choice([", keep it private", " in case they ask", ""]))
        elif r < 0.83:
            put(rng.choice(["she lives at ", "the party is at ", "ship it to ", "we moved to "]))
            put(address(), "address")
            put(rng.choice([f", near {word()}", f", not at {word()}", " before Monday", f", bring the {word()}"]))
        else:
            put(rng.choice(["ask ", "Ms ", "my dentist, ", "Dr. ", "", "contact ", "I met ", "talked to ", "we spoke to "]))
            put(name(), "name")
            put(rng.choice([" called about it", ", moved away", f" at the {word()} fair", "; they know", " said so", " takes over"]))
        put(rng.choice([". ", ".\n", "! ", " - "]))
    return text, segs


# Name parts for made-up texts only.
_GIVEN = "Arden Brisa Colm Dessa Elric Fenna Garrin Hedda Ivo Jessamy Kerrin Lysa Merrit Nolan Orla Perrin Quilla Roswin Sabra Tolan".split()
_FAMILY = [h + t for h in ("Ash", "Black", "Cold", "Dunn", "East", "Fair", "Green", "Hart") for t in ("borough", "combe", "field", "ley", "mere", "stead", "ton", "wood")]


def _made_up_new(rng: random.Random) -> tuple[str, set[tuple[int, int, str]]]:
    """One training text with a name, or capitalised words that are none, of made-up syllables."""
    syl = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    cap = lambda: syl().capitalize()
    if rng.random() < 0.5:
        return rng.choice([
            f"the {cap()} {cap()} board met", f"{cap()} {cap()} ships today", f"we use {cap()} {cap()} for {syl()}", f"in {cap()} {cap()} it rained", f"flight to {cap()} {cap()} is late", f"trip from {cap()} {cap()} to {cap()}",
            f"meet at {cap()} {cap()}", f"with {cap()} {cap()} installed", f"{cap()} {cap()} was slow", f"Project {cap()} {cap()} is out", f"Project {cap()} and Lake {cap()} both count", f"{cap()} and Lake {cap()} are far", f"the {cap()} Hall and the {cap()} Desk", f"plan {rng.choice('ABCX')} {cap()} wins", f"{cap()} {cap()}, {cap()} and {cap()}",
        ]) + ".", set()
    cue = rng.choice(["ask ", "Ms ", "Mr. ", "Dr. ", "my dentist ", "I met ", "my friend ", "our landlord ", "a colleague named ", "contact ", "with ", "from ", "", ""])
    known = rng.choice(_GIVEN)
    g, f, i = known if not cue.strip() or cue in ("with ", "from ", "contact ") or rng.random() < 0.5 else cap(), cap(), rng.choice("ABCDEFGHKLMNPRST")
    name = rng.choice([f"{g} {f}"] * 5 + [f"{g} {i}. {f}", f"{g[0]}. {f}", f"{f}, {known}"])
    text = rng.choice(["", "so ", f"the {syl()} is done, "]) + cue
    return text + name + rng.choice([" called about it", ", moved away", f" at the {syl()} fair", " said so", " and others"]) + ".", {(len(text), len(text) + len(name), "name")}


def _log_sum(xs: list[float]) -> float:
    top = max(xs)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in xs))


def train(seed: int = 7) -> Field:
    """Weights by gradient ascent on the conditional likelihood, with a small quadratic penalty."""
    rng = random.Random(seed)
    lex = Lexicon([f"{g} {f}".lower() for k, f in enumerate(_FAMILY) if k % 3 for g in (rng.choice(_GIVEN), rng.choice(_GIVEN))])
    names: dict[str, int] = {}
    kinds = {"": 0, **{k: i + 1 for i, k in enumerate(KINDS)}}
    n_kinds = len(kinds)
    data = []
    new = random.Random(seed + 1)
    for k in range(TRAINING_TEXTS + NEW_TEXTS):
        text, segs = _made_up(rng, lex) if k < TRAINING_TEXTS else _made_up_new(new)
        cs, before = _ordered(candidates(text, lex))
        if cs:
            # a true segment may stand there as several candidates: they share it
            gold = [[i for i, c in enumerate(cs) if c[:3] == s] for s in sorted(segs)]
            data.append(([np.array([names.setdefault(f, len(names)) for f in c[3]]) for c in cs], before, [kinds[c[2]] for c in cs], [g for g in gold if g]))
    n_steps = n_kinds * n_kinds
    w, total = np.zeros(len(names) + n_steps), np.zeros(len(names) + n_steps)
    for _ in range(TRAINING_ROUNDS):
        grad = -0.01 * w
        step = w[len(names) :].reshape(n_kinds, n_kinds).tolist()
        grad_step = [[0.0] * n_kinds for _ in range(n_kinds)]
        for feats, before, kind, gold in data:
            n = len(feats)
            s = [float(w[f].sum()) for f in feats]
            # log weight of all segmentations of the first i candidates, by the type of the last segment
            alpha = [[0.0] + [-math.inf] * (n_kinds - 1)]
            enter = []
            for i in range(n):
                k, from_ = kind[i], alpha[before[i]]
                enter.append(s[i] + _log_sum([from_[x] + step[x][k] for x in range(n_kinds)]))
                row = alpha[i][:]
                row[k] = _log_sum([row[k], enter[i]])
                alpha.append(row)
            whole = _log_sum(alpha[n])
            out = [[0.0] * n_kinds for _ in range(n)] + [[math.exp(x - whole) for x in alpha[n]]]  # gradient of the log partition by alpha
            for i in range(n - 1, -1, -1):
                k, j = kind[i], before[i]
                for x in range(n_kinds):
                    out[i][x] += out[i + 1][x] * (math.exp(alpha[i][x] - alpha[i + 1][x]) if x == k and alpha[i][x] > -math.inf else x != k)
                take = out[i + 1][k] * math.exp(enter[i] - alpha[i + 1][k])
                if take > 1e-9:
                    for x in range(n_kinds):
                        if alpha[j][x] > -math.inf:
                            share = take * math.exp(alpha[j][x] + step[x][k] + s[i] - enter[i])
                            out[j][x] += share
                            grad_step[x][k] -= share
                    grad[feats[i]] -= take
            last = 0
            for same in gold:
                top = _log_sum([s[i] for i in same])
                for i in same:
                    grad[feats[i]] += math.exp(s[i] - top)
                grad_step[last][kind[same[0]]] += 1
                last = kind[same[0]]
        grad[len(names) :] += np.array(grad_step).ravel()
        total += grad * grad
        w += 0.7 * grad / np.sqrt(total + 1e-8)
    back = list(kinds)
    return Field({f: float(w[i]) for f, i in names.items()}, {(back[x], back[k]): float(w[len(names) + x * n_kinds + k]) for x in range(n_kinds) for k in range(1, n_kinds)})


@lru_cache(maxsize=1)
def trained() -> Field:
    return train()


def lexicon(profiles: DataFrame) -> Lexicon:
    """The known persons (entity), by their distinct first and last words."""
    words = F.split(F.lower(F.trim("entity")), r"\s+")
    return Lexicon([" ".join(r) for r in profiles.where("entity is not null").select(words.alias("w")).where(F.size("w") >= 2).select(F.col("w")[0], F.element_at("w", -1)).distinct().collect()])


class Finder:
    def __init__(self, field: Field, lex: Lexicon):
        self.field, self.lex = field, lex

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        """(begin, end, kind) in order, without overlaps; [] for null, empty and clean texts."""
        return self.field.best(candidates(text, self.lex)) if text else []

    def mask(self, text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for a, b, kind in self.find(text):
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        return "".join([*out, text[at:]])


def _finder(bc):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(*bc.value)
        for b in batches:
            out = [(i, kind, t[x:y], x, y) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x, y, kind in finder.find(t)]
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["message_id", "kind", "found_text", "begin", "end"])

    return find


def find_pii(messages: DataFrame, profiles: DataFrame, field: Field | None = None) -> DataFrame:
    """(message_id, kind, found_text, begin, end) of all personal information in ``content``.

    ``messages`` has (id, content), ``profiles`` (entity); other columns are ignored. Null and empty
    contents and empty tables give no rows; a repeated id counts once.
    """
    bc = messages.sparkSession.sparkContext.broadcast((field or trained(), lexicon(profiles)))
    rows = messages.select(F.col("id").cast("bigint"), "content")
    return rows.mapInArrow(_finder(bc), "message_id bigint, kind string, found_text string, begin int, end int").distinct()


def mask_pii(messages: DataFrame, profiles: DataFrame, column: str = "content", field: Field | None = None) -> DataFrame:
    """``messages`` with typed placeholders like [PHONE] in place of personal information; the rest of the text stays."""
    bc = messages.sparkSession.sparkContext.broadcast((field or trained(), lexicon(profiles)))

    @F.pandas_udf("string")
    def masked(text):  # noqa: ANN001, ANN202
        finder = Finder(*bc.value)
        return text.map(finder.mask, na_action="ignore")

    return messages.withColumn(column, masked(F.col(column)))


def kinds_found(found: DataFrame) -> Counter:
    return Counter({r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()})
