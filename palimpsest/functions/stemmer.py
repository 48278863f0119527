"""Porter's stemming algorithm (1980), as data: steps of (suffix, replacement, condition)."""

from __future__ import annotations

from functools import lru_cache

# Suffix rules of the published algorithm.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _kinds(w: str) -> str:
    out = ""
    for i, c in enumerate(w):
        vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(w: str) -> int:
    return _kinds(w).count("vc")


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return _kinds(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _longest(w: str, rules: dict[str, str]) -> str:
    for s in sorted(rules, key=len, reverse=True):
        if w.endswith(s):
            base = w[: -len(s)]
            return base + rules[s] if _measure(base) > 0 else w
    return w


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    tail = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in _kinds(w[:-2]):
        tail = w[:-2]
    elif w.endswith("ing") and "v" in _kinds(w[:-3]):
        tail = w[:-3]
    if tail is not None:
        if tail.endswith(("at", "bl", "iz")):
            w = tail + "e"
        elif _double(tail) and tail[-1] not in "lsz":
            w = tail[:-1]
        else:
            w = tail + "e" if _measure(tail) == 1 and _cvc(tail) else tail
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    w = _longest(_longest(w, STEP2), STEP3)
    ends = [s for s in STEP4 if w.endswith(s)] + (["ion"] if w.endswith(("sion", "tion")) else [])
    if ends:
        s = max(ends, key=len)
        if _measure(w[: -len(s)]) > 1:
            w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if _measure(w) > 1 and _double(w) and w[-1] == "l" else w
