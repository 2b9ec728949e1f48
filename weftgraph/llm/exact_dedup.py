"""Exact deduplication with streaming state (operator 8).

A file stream of ``(digest, doc_id, locator)`` runs through a stateful streaming aggregation whose
state lives in RocksDB, has no watermark and hence never expires. For every digest the state keeps
the stable identifier of the row that stays (the largest ``doc_id``), the locator of its content
and how many rows had that digest. Partial aggregation runs before the shuffle, so a digest that a
third of all rows share reaches the state as one row per input task. What changed is written per
micro-batch under the batch's number, so a batch that is run again after a loss replaces itself.

A hit (a digest seen more than once) is never trusted: the full normalised texts of its rows are fetched
by their locators and compared byte for byte, as the least and the greatest text of the digest, which partial
aggregation finds without ever gathering a group; rows of a digest with two texts are grouped by their own full
text instead. With a ``state_dir`` the state outlives the run, and rows are also held against those of earlier runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import broadcast_if_small, cut, filed, fresh_dir, lower_ascii, session_conf, spare

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def streaming_keepers(fingerprints: DataFrame, max_bytes_per_trigger: int = 4 << 30, files_per_trigger: int | None = None, state_dir: str | None = None) -> DataFrame:
    """``(digest, keep_id, keep_at, n)`` from a stream over ``(digest, doc_id, at)``.

    ``fingerprints`` is staged in the shared folder and read back as a file stream, each
    micro-batch up to the given size, until all of it is read. A ``state_dir`` in a shared folder keeps state, staged rows and
    results for the next run, which then continues the stream with its own rows; without one every run begins anew. The same rows, places included, are one run.
    """
    spark = fingerprints.sparkSession
    home = (state_dir or fresh_dir(spark, "dedup")).rstrip("/")
    staged, out, state = (f"{home}/{x}" for x in ("in", "out", "state"))
    # a run is staged under a name that its rows give: what died after that, or runs again, is not counted twice
    run = "rows"
    if state_dir:
        n, mark = fingerprints.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*fingerprints.columns).cast("decimal(38,0)"))).first()
        run = f"{n}-{mark}"
    if not _complete(spark, f"{staged}/{run}"):
        fingerprints.write.mode("overwrite").parquet(f"{staged}/{run}")
    reader = spark.readStream.schema(fingerprints.schema).option("recursiveFileLookup", "true")
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    seen = (
        reader.parquet(staged)
        .groupBy("digest")
        .agg(F.max(F.struct(F.col("doc_id").alias("keep_id"), F.col("at").alias("keep_at"))).alias("keep"), F.count(F.lit(1)).alias("n"))
        .select("digest", "keep.keep_id", "keep.keep_at", "n")
    )
    with session_conf(
        spark,
        spark__sql__streaming__stateStore__providerClass=ROCKSDB,
        spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true",
        spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB="64",
        # each of the many stores takes an eighth of this for its first row
        spark__sql__streaming__stateStore__rocksdb__writeBufferSizeMB="2",
        spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled="true",
        # else each of the many small stores reserves megabytes for its logs
        spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false",
        # executors close stores of a stream that has ended after such a time
        spark__sql__streaming__stateStore__maintenanceInterval="10s",
    ):
        query = (
            seen.writeStream.outputMode("update")
            .option("checkpointLocation", state)
            .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    schema = "digest string, keep_id long, keep_at string, n long"
    changed = spark.read.schema(f"{schema}, batch int").parquet(out)
    return changed.groupBy("digest").agg(F.max_by(F.struct("keep_id", "keep_at", "n"), "batch").alias("s")).select("digest", "s.*")


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder has ended."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def located(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows of ``docs`` with the place of their content, and that column's name.

    Rows read straight from files are found by file and row number; others are written to the shared folder first.
    """
    docs = docs if file_locator(docs) is not None else filed(docs, "located")
    at = spare(docs, "at")[0]
    return docs.withColumn(at, file_locator(docs)), at


def exact_dedup(
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256_digest,
    state_dir: str | None = None,
    **stream_options,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, at, keep_at``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the
    largest doc_id of a group stays; among rows that share this doc_id too all are marked kept,
    as they can't be told apart by id. A null doc_id sorts below all others; a group of null ids
    only keeps ``keep_id`` null and all its rows. No rows in, no rows out. Other columns of ``docs`` are
    ignored, whatever their names. ``at`` says where a row's content is, ``keep_at`` where that of the row that stays is. Each row is read once for its digest and, if its
    digest was seen twice, once more for its bytes. Very long texts are compared whole.
    With ``state_dir`` groups reach over all runs, and ``keep_at`` may lie in files of an earlier one, which must still be there.
    A run over the same rows of the same files is the same run: it may be repeated, also after it died, and counts once.
    """
    return _judged(*located(docs), digest, state_dir, **stream_options)


def _judged(docs: DataFrame, at: str, digest: Callable[[Column], Column] = sha256_digest, state_dir: str | None = None, **stream_options) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(at).alias("at"))
    body = lower_ascii(F.col("text"))
    rows = cut(texts.select("doc_id", digest(body).cast("string").alias("digest"), F.sha2(body, 256).alias("text_sha256"), "at"))
    keepers = cut(streaming_keepers(rows.select("digest", "doc_id", "at"), state_dir=state_dir, **stream_options))

    hits = keepers.where("n > 1").select("digest", "keep_at")
    places = rows.join(broadcast_if_small(hits.select("digest")), "digest", "left_semi").select("at", "digest")
    bodies = texts.join(broadcast_if_small(cut(places)), "at").select("doc_id", "digest", body.alias("body"), "at")
    ends = bodies.select("digest", "body")
    if state_dir:
        ends = ends.unionByName(_earlier(hits, rows))
    broken = cut(ends.groupBy("digest").agg(F.min("body").alias("lo"), F.max("body").alias("hi")).where("lo <> hi").select("digest"))
    out = rows.join(keepers, "digest").withColumnRenamed("n", "group_size")
    if not broken.isEmpty():
        # two texts under one digest: those rows go by their full text
        whole = bodies.join(broken, "digest", "left_semi")
        regroup = whole.groupBy("digest", "body").agg(F.max(F.struct("doc_id", "at")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        fixed = whole.join(regroup, ["digest", "body"]).select(
            "doc_id", "digest", F.col("keep.doc_id").alias("keep_id"), "group_size", F.sha2("body", 256).alias("text_sha256"), "at", F.col("keep.at").alias("keep_at")
        )
        out = out.join(broken, "digest", "left_anti").select(*fixed.columns).unionByName(fixed)
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "at", "keep_at")


def _earlier(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """``digest, body`` of rows that stay since an earlier run; the driver sees the names of their files only."""
    old = cut(hits.join(rows.select(F.col("at").alias("keep_at")), "keep_at", "left_anti"))
    files = [r["f"] for r in old.select(F.substring_index("keep_at", "#", 1).alias("f")).distinct().collect()]
    spark = hits.sparkSession
    if not files:
        return spark.createDataFrame([], "digest string, body string")
    base = spark.read.parquet(*files)
    body = base.select(file_locator(base).alias("keep_at"), lower_ascii(F.col("text")).alias("body"))
    return body.join(old, "keep_at").select("digest", "body")


def file_locator(docs: DataFrame) -> Column | None:
    """File and row of a row, if ``docs`` is read straight from files."""
    try:
        probe = docs.select(F.col("_metadata.file_path"), F.col("_metadata.row_index")).schema
    except AnalysisException:  # not a file scan
        return None
    return F.concat_ws("#", "_metadata.file_path", "_metadata.row_index") if probe else None


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns; of rows with equal id and text one stays."""
    rows, at = located(docs)
    verdict = cut(_judged(rows, at, **options).select("doc_id", "text_sha256", "at", "kept"))
    twice = verdict.where("kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).where("n > 1")
    repeats = verdict.where("kept").join(twice, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha"))).where("at <> first").select("at")
    gone = broadcast_if_small(cut(verdict.where("not kept").select("at").union(repeats).withColumnRenamed("at", at)))
    return rows.join(gone, at, "left_anti").drop(at)


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g ON d.body = g.body
"""
