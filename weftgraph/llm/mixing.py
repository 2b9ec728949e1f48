"""Mixing sources to target weights by Poisson replication (operator 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import broadcast_if_small, cut, spare

SEED = "mix-1"
#: above this mean exp(-rate) comes near the least double; a larger rate is a sum of equal parts
MOST_RATE = 700
#: a count's chance beyond mean + 12 deviations + 40 is below 2**-52, the grain of the uniform number
TAIL = "cast(ceil(rate + 12 * sqrt(rate) + 40) as int)"


def unit(key: Column, seed: str) -> Column:
    """52-bit number in [0, 1) from md5 of key and seed."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(":" + seed))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_table(rates: DataFrame) -> DataFrame:
    """Adds ``cdf``, the array of P(X <= j) for j = 0, 1, ..., rounded to 12 digits."""
    step = """aggregate(sequence(1, {n}), struct(array(exp(-rate)) as cdf, exp(-rate) as p),
        (s, j) -> struct(concat(s.cdf, array(element_at(s.cdf, -1) + s.p * rate / j)) as cdf, s.p * rate / j as p),
        s -> transform(s.cdf, v -> round(v, 12)))"""
    return rates.withColumn("cdf", F.expr(step.format(n=TAIL)))


def mixing_rates(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """``source, rate``: mean repetitions that give each source its share of all bytes.

    ``weights`` maps sources to relative weights, 1 for those it doesn't name. A source of B_s
    bytes (each text's bytes plus one) gets rate = share * total / B_s.
    """
    size = (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("long")
    sums = docs.groupBy("source").agg(F.sum(size).alias("bytes"))
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    sums = sums.withColumn("w", weight)
    total = sums.agg(F.sum("bytes").alias("all_bytes"), F.sum("w").alias("all_w"))
    return sums.crossJoin(F.broadcast(total)).select("source", (F.col("w") / F.col("all_w") * F.col("all_bytes") / F.col("bytes")).alias("rate"))


def poisson_mix(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: str = SEED, shuffle: bool = True) -> DataFrame:
    """All columns of ``docs`` plus ``copy`` (from 0) and ``mix_key``, in a global random order.

    A document's count inverts the Poisson distribution of its source's rate at a number hashed
    from its id and the seed: the same id always gets the same count, however often the job is
    run. Repeated ids share it. A null source is a source of its own, a null id hashes as the
    empty text, a null text counts one byte. A rate above ``MOST_RATE`` is cut into equal parts, each
    inverted at a number of its own: a sum of Poisson counts is Poisson with the sum of the rates.
    The order is that of ``mix_key``, md5 of id, copy and seed: its leading digits are uniform, so rows are
    dealt to partitions by them and sorted there, without a look at the data first. Columns of ``docs`` all
    stay; if one is called ``copy`` or ``mix_key``, the added one has a ``_`` behind its name.
    """
    copy, mix_key, source, parts, cdf, times, place = spare(docs, "copy", "mix_key", "_source", "_parts", "_cdf", "_times", "_place")
    rates = mixing_rates(docs, weights).select(F.col("source").alias(source), "rate")
    rates = rates.withColumn(parts, F.greatest(F.ceil(F.col("rate") / MOST_RATE), F.lit(1)).cast("int")).withColumn("rate", F.col("rate") / F.col(parts))
    listed = broadcast_if_small(cut(poisson_table(rates).select(source, parts, F.col("cdf").alias(cdf))), 10_000)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    own = docs.join(listed, F.col("source").eqNullSafe(F.col(source)))
    more = F.transform(F.sequence(F.lit(1), F.col(parts) - 1), lambda k: unit(F.concat(key, F.lit("/"), k.cast("string")), seed))
    numbers = F.when(F.col(parts) > 1, F.concat(F.array(unit(key, seed)), more)).otherwise(F.array(unit(key, seed)))
    own = own.withColumn(times, F.aggregate(numbers, F.lit(0), lambda n, u: n + F.size(F.filter(cdf, lambda v: v <= u))))
    many = own.where(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(times) - 1)))
    many = many.drop(times, cdf, parts, source).withColumn(mix_key, F.md5(F.concat(key, F.lit("#"), F.col(copy).cast("string"), F.lit(":" + seed))))
    if not shuffle:
        return many
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = many.withColumn(place, F.floor(F.conv(F.substring(mix_key, 1, 8), 16, 10).cast("double") * n / F.lit(float(1 << 32))).cast("int"))
    return dealt.repartitionById(n, F.col(place)).drop(place).sortWithinPartitions(mix_key)


ORACLE = f"""
WITH d AS (SELECT *, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS bytes FROM d GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE / (SELECT count(*)::DOUBLE FROM s) * (SELECT sum(bytes) FROM s) / bytes AS rate FROM s),
k AS (SELECT r.source, rate, j FROM r, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS t(j)),
p AS (SELECT source, j, exp(-rate) * coalesce(exp(sum(CASE WHEN j = 0 THEN 0 ELSE ln(rate / j) END) OVER (PARTITION BY source ORDER BY j)), 1) AS p FROM k),
c AS (SELECT source, j, round(sum(p) OVER (PARTITION BY source ORDER BY j), 12) AS cdf FROM p),
u AS (SELECT doc_id, source, text, lang, n_chars, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM d),
n AS (SELECT u.doc_id, u.source, u.text, u.lang, u.n_chars, count(*) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf <= u.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, md5(coalesce(doc_id::VARCHAR, '') || '#' || copy::VARCHAR || ':{SEED}') AS mix_key
FROM n, unnest(range(0, n)) AS t(copy)
"""
