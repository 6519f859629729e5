"""Opening hours. The grammar is small: day ranges that wrap, times past midnight, lists; anything else is unknown, not closed."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAYS = ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su")
_DAY = "|".join(DAYS)
_RULE = re.compile(rf"^(?:((?:{_DAY}|PH|SH)(?:-(?:{_DAY}))?(?:,\s*(?:{_DAY}|PH|SH)(?:-(?:{_DAY}))?)*)\s*)?(off|closed|24/7|\d\d?:\d\d.*)$")
_SPAN = re.compile(r"^(\d\d?):(\d\d)(?:-(\d\d?):(\d\d)|(\+))$")


def _days(text: str | None) -> set[int] | None:
    if not text:
        return set(range(7))
    out: set[int] = set()
    for part in re.split(r",\s*", text):
        if part in ("PH", "SH"):
            continue
        a, _, b = part.partition("-")
        first = DAYS.index(a)
        out |= {(first + k) % 7 for k in range((DAYS.index(b or a) - first) % 7 + 1)}
    return out


def week(text: str) -> list[tuple[int, int]] | None:
    """Open intervals in minutes of the week; the end may lie beyond it. None if the text isn't understood."""
    by_day: dict[int, list[tuple[int, int]]] = {}
    text = re.sub(r'"[^"]*"', "", text).strip()
    for rule in filter(None, (r.strip() for r in text.split(";"))):
        m = _RULE.match(rule)
        if not m:
            return None
        days, times = _days(m[1]), m[2]
        if times in ("off", "closed"):
            spans: list[tuple[int, int]] = []
        elif times == "24/7":
            spans = [(0, 1440)]
        else:
            spans = []
            for part in re.split(r",\s*", times.strip()):
                s = _SPAN.match(part.strip())
                if not s:
                    return None
                a = int(s[1]) * 60 + int(s[2])
                b = 1440 if s[5] else int(s[3]) * 60 + int(s[4])
                if a > 1440 or b > 48 * 60:
                    return None
                spans.append((a, b if b > a else b + 1440))
        for d in days or ():
            by_day[d] = spans
    return sorted((d * 1440 + a, d * 1440 + b) for d, spans in by_day.items() for a, b in spans)


def open_at(text: str | None, minute: int) -> bool | None:
    """Whether it is open at a minute of the week; None if unknown."""
    if not text:
        return None
    if text.strip() == "24/7":
        return True
    spans = week(text)
    if spans is None:
        return None
    return any(a <= m < b for a, b in spans for m in (minute, minute + 7 * 1440))


@F.pandas_udf(T.BooleanType())
def is_open(hours: pd.Series, minute: pd.Series) -> pd.Series:
    return pd.Series([open_at(h, int(m)) if m is not None else None for h, m in zip(hours, minute, strict=True)], dtype="object")
