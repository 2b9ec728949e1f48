"""Live runs and moved slices as a stream: keyed state with event-time timers.

A run that says nothing for a while ends without an event, so a timer must end it; and of the states that a key reports only those that
differ from the one before are passed on. Rows may come out of order within the watermark's delay: they wait in the key's
state until the watermark is past them, and are then taken in order, so the stream says what the batch twin says.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftgraph.operators import ledger
from weftgraph.session import cut

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "key string, kind string, at long, started long, n long, before string, state string"
#: of a key: rows that the watermark isn't past yet, the open session, and the last state said
_KEPT = "waiting array<struct<at: long, event_id: long, state: string>>, started long, last long, n long, said string"


def _advance(gap_us: int, key: tuple, new: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
    """What is certain of a key at the watermark; a timer is set for what isn't. The state comes and goes with the rows, many keys at a time."""
    watermark_ms, out = kept.getCurrentWatermarkMs(), []
    upto = watermark_ms * 1000
    waiting, *session, said = kept.get if kept.exists else (None, None, None, None, None)
    now = tuple(session) if session[0] is not None else None
    rows = [tuple(r) for r in waiting or []]
    rows += [(int(a), int(e), s) for df in new for a, e, s in zip(df["at"], df["event_id"], df["state"], strict=True)]
    rows.sort(key=lambda r: r[:2])
    past, rest = [r for r in rows if r[0] <= upto], [r for r in rows if r[0] > upto]

    def ended() -> None:
        out.append((key[0], "end", now[1], now[0], now[2], None, None))

    for at, _, state in past:
        if now and at - now[1] > gap_us:
            ended()
            now = None
        now = (now[0], at, now[2] + 1) if now else (at, at, 1)
        if state != said:
            out.append((key[0], "change", at, None, None, said, state))
            said = state
    if now and now[1] + gap_us < upto:
        ended()
        now = None
    if rest or now or said is not None:
        kept.update((rest, *(now or (None, None, None)), said))
    elif kept.exists:
        kept.remove()
    # a timer fires once the watermark is greater
    due = [-(-rest[0][0] // 1000) - 1] if rest else []
    due += [(now[1] + gap_us) // 1000] if now else []
    if due:
        kept.setTimeoutTimestamp(max(watermark_ms, 1, min(due)))
    if out:
        yield pd.DataFrame(out, columns=["key", "kind", "at", "started", "n", "before", "state"]).astype({"at": "Int64", "started": "Int64", "n": "Int64"})


def live_log(events: DataFrame, key: str, state: str, silence_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """``key, kind, at, started, n, before, state`` of a stream ``key, ts, event_id, state``; times are microseconds.

    ``end``: a key was silent for more than ``silence_ms``; it had ``n`` events from ``started`` to ``at``. ``change``: it said a
    ``state`` other than the one ``before``. Rows later than ``late`` are dropped. What a key holds is bounded by its events
    within that delay.
    """
    rows = events.withWatermark("ts", late).select(F.col(key).cast("string").alias("key"), "ts", F.unix_micros("ts").alias("at"), "event_id", F.col(state).alias("state"))
    return rows.groupBy("key").applyInPandasWithState(partial(_advance, silence_ms * 1000), _OUT, _KEPT, "append", GroupStateTimeout.EventTimeTimeout)


def settled_log(events: DataFrame, key: str, state: str, silence_ms: int, upto_us: int) -> DataFrame:
    """The batch twin of :func:`live_log`, as of a watermark."""
    rows = cut(events.select(F.col(key).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col(state).alias("state")).where(F.unix_micros("ts") <= upto_us))
    # windows that touch are one session, so an interval longer than the silence by the least step is the same
    ends = ledger.sessions(rows, "key", f"{silence_ms * 1000 + 1} microseconds").where(F.unix_micros("ended") + silence_ms * 1000 < upto_us)
    ends = ends.select("key", F.lit("end").alias("kind"), F.unix_micros("ended").alias("at"), F.unix_micros("started").alias("started"), "n", F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("state"))
    moved = ledger.changes(rows, "key", "state").select("key", F.lit("change"), F.unix_micros("ts"), F.lit(None), F.lit(None), "before", "state")
    return ends.union(moved)


def run_live(log: DataFrame, base: str) -> DataFrame:
    """Run a stream to the end of what is there, from where the folder ``base`` says it ended; gives all rows so far. A batch that runs again replaces its own files."""
    spark = log.sparkSession
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        query = (
            log.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state")
            .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out/batch={n}")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return spark.read.schema(_OUT).parquet(f"{base}/out")
