"""Ranked text search over an inverted index that is one aggregation."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.ranking import smallest_k
from weftgraph.session import cut

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def _starts(term: str) -> Callable[[Column], Column]:
    return lambda word: F.startswith(word, F.lit(term))


def bm25(docs: DataFrame, key: str, text: str, prefixes: list[str]) -> DataFrame:
    """``id, score`` of documents in which every prefix begins a word.

    One pass over the texts leaves a length and a count for each prefix; the number of documents, their mean length
    and how many hold each prefix are added up from these, and nothing is shuffled by word.
    """
    words = docs.select(F.col(key).alias("id"), tokens(F.col(text)).alias("w"))
    tf = F.array(*[F.size(F.filter("w", _starts(p))) for p in prefixes])
    return _ranked(words.select("id", F.size("w").alias("len"), tf.alias("tf")), len(prefixes))


def _ranked(counts: DataFrame, terms: int) -> DataFrame:
    """``id, score`` of ``id, len, tf``, an array with a count for each term."""
    rows = cut(counts)
    df = F.array(*[F.count_if(F.col("tf")[k] > 0) for k in range(terms)])
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"), df.alias("df"))  # one row
    score = F.lit(0.0)
    for k in range(terms):
        n, own = F.col("df")[k], F.col("tf")[k]
        score += F.log(1 + (F.col("n") - n + 0.5) / (n + 0.5)) * own * (K1 + 1) / (own + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    hits = rows.where(F.forall("tf", lambda c: c > 0))
    return hits.join(F.broadcast(totals)).select("id", F.round(score, 6).alias("score"))


def bm25_fields(docs: DataFrame, key: str, weights: dict[str, float], prefixes: list[str]) -> DataFrame:
    """Like :func:`bm25` over several fields: a word in one counts as often as the field's weight says."""
    tf = F.array(*[sum((F.lit(float(w)) * F.size(F.filter(tokens(F.col(c)), _starts(q))) for c, w in weights.items()), F.lit(0.0)) for q in prefixes])
    length = sum((F.size(tokens(F.col(c))) for c in weights), F.lit(0))
    return _ranked(docs.select(F.col(key).alias("id"), length.alias("len"), tf.alias("tf")), len(prefixes))


#: fixed values: words of a goal that aren't searched for
STOP_WORDS = ("the", "and", "for", "with", "into", "from", "that", "this", "add", "fix", "make", "use", "all")


def goal_words(text: Column) -> Column:
    """Different words of three letters or more of a goal, in their order, without fillers."""
    return F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS)))


def tfidf_names(docs: DataFrame, group: str, text: str, k: int = 2) -> DataFrame:
    """The k words that tell each group apart: ``group, term, score``; ties alphabetical."""
    counts = docs.select(F.col(group).alias("group"), F.explode(tokens(F.col(text))).alias("term")).groupBy("group", "term").agg(F.count(F.lit(1)).alias("c"))
    total = counts.groupBy("group").agg(F.sum("c").alias("total"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count_distinct(group).alias("n"))
    scored = counts.join(df, "term").join(total, "group").join(F.broadcast(n)).withColumn("score", F.round(F.col("c") / F.col("total") * F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)), 9))
    return smallest_k(scored.select("group", "term", "score"), ["group"], [F.desc("score"), "term"], k)


def identifier_words(name: Column) -> Column:
    """Words of an identifier, lower-cased: breaks at case, ``_``, ``-`` and ``.``; a run of capitals stays together."""
    broken = F.regexp_replace(name, r"(\p{Ll}|\p{N})(\p{Lu})", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(broken, r"[\s_.\-]+", " ")))


def prefix_match(rows: DataFrame, key: str, text: Column, query: str) -> DataFrame:
    """``id`` of rows in which every term of the query begins a word; one pass, no join."""
    words, terms = tokens(text), [t for t in re.split(r"[^\w]+", query.lower()) if t]
    begins = [F.exists(words, _starts(t)) for t in terms]
    return rows.where(reduce(Column.__and__, begins, F.lit(bool(terms)))).select(F.col(key).alias("id"))


def search_or_contain(rows: DataFrame, key: str, text: Column, query: str) -> DataFrame:
    """``id, exact`` by ``prefix_match``; only if that finds nothing, rows that contain the query anywhere."""
    found = prefix_match(rows, key, text, query).select("id", F.lit(True).alias("exact"))
    loose = rows.where(F.contains(F.lower(text), F.lit(query.lower()))).select(F.col(key).alias("id"), F.lit(False).alias("exact"))
    return loose if found.isEmpty() else found
