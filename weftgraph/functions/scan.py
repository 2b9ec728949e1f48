"""Values found in texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"-?\d+(?:\.\d+)?"
LINK = r"(?:href|src|action)=\"([^\"]*)\""


def last_number(text: Column) -> Column:
    """The last number of a text as a double; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), F.lit(-1)).try_cast("double")


def links(html: Column) -> Column:
    """Values of attributes that name another resource, in order, repeats kept; null for a null text."""
    return F.regexp_extract_all(html, F.lit(LINK), F.lit(1))


def json_number(text: Column, *paths: str) -> Column:
    """The number at the first path that has one; 0 if none has, or it is negative or not finite."""
    parsed = F.try_parse_json(text)
    found = F.coalesce(*[F.try_variant_get(parsed, p, "double") for p in paths])
    return F.when((found > 0) & (found < float("inf")), found).otherwise(0.0)
