"""Session set-up that every query needs."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: rows of a part that is grouped or sorted: some 100 MB
PART_ROWS = 500_000


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers on the same file system find this package.

    On a cluster the package is installed or shipped with ``--py-files``; this only adds the
    folder that the driver itself imported it from.
    """
    root = str(Path(__file__).resolve().parent.parent)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join(filter(None, [root, *paths]))
    if spark.conf.get(BATCH_ROWS) == "10000":  # the default, which holds tens of MB of whole texts a batch
        spark.conf.set(BATCH_ROWS, "1000")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only on a one-machine master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="weftgraph-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: ends the lineage of a loop, and survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as compressed files in the shared folder: for whole tables that are read more than once.

    A checkpoint writes rows as they lie in memory, several times as much.
    """
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores, for work that costs much a row: a small file of many rows is one task otherwise.

    The number is given, as partitions would be merged again by their size in bytes.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def parts_of(table: DataFrame) -> int:
    """Into how many parts rows made of a table are to be shuffled: one for each half million of its rows, and one a core at least.

    Without a number Spark merges parts until there is one a core, and what a task holds grows with the table. ``table`` is a plain
    scan: its rows are counted from the footers of its files.
    """
    return max(-(-table.count() // PART_ROWS), table.sparkSession.sparkContext.defaultParallelism)


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows shuffled by keys into so many parts, which a grouping or join by these keys then keeps; None leaves it to Spark."""
    return df.repartition(parts, *keys) if parts else df


def wide(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the tables, to be shuffled: Spark judges it by its compressed file, a few bytes a row, and would send all of it through the driver."""
    return df.hint("merge")
