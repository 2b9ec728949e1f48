"""Five-field schedules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))


def field_values(text: str, low: int, high: int) -> list[int]:
    """The numbers of one field: ``*``, ``a``, ``a-b``, each with ``/step``, in a comma list."""
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        first, dash, last = span.partition("-")
        a, b = (low, high) if span == "*" else (int(first), int(last) if dash else high if step else int(first))
        if not low <= a <= b <= high or int(step or 1) < 1:
            raise ValueError(f"not a field from {low} to {high}: {text}")
        out |= set(range(a, b + 1, int(step or 1)))
    return sorted(out)


def fires(ts: Column, spec: str) -> Column:
    """True in the minutes that the schedule names; of two day fields that are set, either is enough. 7 is Sunday, too."""
    texts = spec.split()
    if len(texts) != len(FIELDS):
        raise ValueError(f"five fields are needed: {spec}")
    at = dict(zip(("minute", "hour", "day", "month", "weekday"), (F.minute(ts), F.hour(ts), F.dayofmonth(ts), F.month(ts), F.dayofweek(ts) - 1), strict=True))
    hit = {name: at[name].isin(sorted({v % 7 if name == "weekday" else v for v in field_values(t, low, high)})) for (name, low, high), t in zip(FIELDS, texts, strict=True)}
    both = texts[2] != "*" and texts[4] != "*"
    day = hit["day"] | hit["weekday"] if both else hit["day"] & hit["weekday"]
    return hit["minute"] & hit["hour"] & hit["month"] & day
