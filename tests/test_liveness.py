"""The live log against its batch twin, with rows out of order, a late one and a restart."""

import random
import tempfile

from pyspark.sql import functions as F

from weftgraph.streaming import liveness

HOUR = 3_600_000_000


def test_stream_equals_batch_over_a_restart(spark):
    rng = random.Random(4)
    base = tempfile.mkdtemp(prefix="spark-")
    rows, at = [], 1_700_000_000_000_000
    for n in range(150):
        at += rng.randrange(0, 1_500_000_000)
        run = rng.choice("abc")
        rows.append((run, at - rng.randrange(0, 300_000_000), n, rng.choice(["wait", "run", "done"])))
    rows.append(("d", rows[40][1] + 7, 500, "run"))  # silent from then on
    rows.sort(key=lambda r: r[2] if r[2] < 500 else 41)
    late = ("a", rows[5][1] + 1, 900, "lost")
    parts = [rows[:60], rows[60:100], [*rows[100:], late]]
    schema = "run string, us long, event_id long, state string"
    write = lambda k: spark.createDataFrame(parts[k], schema).coalesce(1).select("run", F.timestamp_micros("us").alias("ts"), "event_id", "state").write.mode("append").parquet(f"{base}/in")

    def run():
        stream = spark.readStream.schema("run string, ts timestamp, event_id long, state string").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        return liveness.run_live(liveness.live_log(stream, "run", "state", late="10 minutes"), f"{base}/log")

    key = lambda df: sorted(map(str, (tuple(r) for r in df.select("key", "kind", "at", "started", "n", "before", "state").collect())))
    write(0)
    write(1)
    first = key(run())
    write(2)  # the stream begins anew from its state
    got = key(run())
    assert set(first) <= set(got) and len(got) == len(set(got))
    upto = (max(r[1] for r in rows) - 600_000_000) // 1000 * 1000
    whole = spark.createDataFrame(rows, schema).select("run", F.timestamp_micros("us").alias("ts"), "event_id", "state")
    want = key(liveness.settled_log(whole, "run", "state", 3_600_000, upto))
    assert got == want
    assert sum("'end'" in r for r in got) >= 3 and any(r.startswith("('d', 'end'") for r in got)


def test_a_row_at_the_watermark_is_said_and_no_state_is_asked_for_key_by_key(spark):
    base, at = tempfile.mkdtemp(prefix="spark-"), 1_700_000_000_000_000
    rows = spark.createDataFrame([("a", at, 1, "run"), ("b", at + 600_000_000, 2, "run")], "run string, us long, event_id long, state string")
    rows.coalesce(1).select("run", F.timestamp_micros("us").alias("ts"), "event_id", "state").write.parquet(f"{base}/in")
    log = liveness.live_log(spark.readStream.schema("run string, ts timestamp, event_id long, state string").parquet(f"{base}/in"), "run", "state", late="10 minutes")
    assert "TransformWithState" not in log._jdf.queryExecution().analyzed().toString()
    assert [(r.key, r.kind, r.at, r.state) for r in liveness.run_live(log, f"{base}/log").collect()] == [("a", "change", at, "run")]
