"""Tests on paths and names, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a path as a test, a name as an HTTP handler and a line as public.
TEST_PATH = r"^tests?/|/tests?/|__tests__|\.test\.|\.spec\.|_test\.|(^|/)test_[^/]*$|^e2e/|/e2e/"
HANDLER_NAME = r"^handle|(H|_h)andler$"
PUBLIC_MARKS = ("pub ", "pub(", "export ")


def is_test(path: Column) -> Column:
    return F.lower(path).rlike(TEST_PATH)


def is_handler(name: Column) -> Column:
    return name.rlike(HANDLER_NAME)


def is_public(text: Column, name: Column, marks: tuple[str, ...] = PUBLIC_MARKS) -> Column:
    """A line that holds the name begins, blanks aside, with one of the marks; null texts have no line."""
    begins = "^\\s*(" + "|".join(map(re.escape, marks)) + ")"
    return F.exists(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.contains(line, name) & line.rlike(begins))


def file_box(path: Column, query: str) -> Column:
    """What a filter box means: terms between ``|`` are globs of a path or its last part, folders (with a last ``/``), or parts of a path."""
    low, fits = F.lower(path), None
    for term in filter(None, (t.strip().lower() for t in query.split("|"))):
        if re.search(r"[*?]", term):
            glob = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x) or re.escape(x) for x in re.split(r"(\*\*|\*|\?)", term))
            one = low.rlike(f"^{glob}$") | F.substring_index(low, "/", -1).rlike(f"^{glob}$")
        elif term.endswith("/"):
            one = low.startswith(term) | low.contains("/" + term)
        else:
            one = low.contains(term)
        fits = one if fits is None else fits | one
    return F.lit(True) if fits is None else fits


def common_folder(path: Column) -> Column:
    """Aggregate: the deepest folder that holds all paths of a group, ``root`` if none does.

    The least and the greatest path agree in what all have in common, so two texts a group are kept.
    """
    least, most = F.split(F.min(path), "/"), F.split(F.max(path), "/")
    folders = F.slice(least, F.lit(1), F.size(least) - 1)
    same = F.aggregate(
        F.sequence(F.lit(0), F.size(folders)), F.lit(0), lambda n, i: F.when((n == i) & F.get(folders, i).eqNullSafe(F.get(most, i)) & F.get(folders, i).isNotNull(), n + 1).otherwise(n)
    )
    return F.when(same > 0, F.array_join(F.slice(least, F.lit(1), same), "/")).otherwise(F.lit("root"))


def folder_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def folders_of(path: Column) -> Column:
    """All folders above a path, the outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.slice(F.sequence(F.lit(0), F.size(parts) - 1), F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
