"""Words: the longest runs of letters and digits of the lower-cased text."""

from __future__ import annotations

import re

_FIND = re.compile(r"[^\W_]+").findall


def words(text: str) -> list[str]:
    return _FIND(text.lower())
