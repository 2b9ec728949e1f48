"""Runs, logs, memories and their trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators.ranking import smallest_k
from weftgraph.session import dealt, wide

#: fixed values: share of each part in a seat's score of 100
WEIGHTS = {"gate": 40.0, "tests": 20.0, "refusals": 15.0, "retries": 10.0, "cost": 10.0, "duration": 5.0}
#: fixed value: 1500 tokens of four letters
PAGE_LETTERS = 6000


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """``key, started, ended, n``: events of a key without a silence of ``gap``."""
    return events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n")).drop("w")


def current_runs(events: DataFrame, key: str, end_type: str, now: str, silence: str) -> DataFrame:
    """Runs with no end event whose last event is less than a silence ago."""
    last = events.where(F.col("ts") <= F.expr(f"timestamp_ntz'{now}'")).groupBy(key).agg(F.max("ts").alias("last"), F.count_if(F.col("event_type") == end_type).alias("ends"))
    return last.where((F.col("ends") == 0) & (F.col("last") > F.expr(f"timestamp_ntz'{now}' - interval {silence}"))).drop("ends")


def changes(events: DataFrame, key: str, state: str) -> DataFrame:
    """Rows at which a key's state differs from the one before: ``key, ts, event_id, before, state``."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    return events.withColumn("before", F.lag(state).over(w)).where(~F.col("before").eqNullSafe(F.col(state))).select(key, "ts", "event_id", "before", F.col(state).alias("state"))


def running_best(scores: DataFrame, key: str, order: str, score: str) -> DataFrame:
    """Each score with the best before it and whether it is kept (strictly better)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return scores.withColumn("best_before", F.max(score).over(w)).withColumn("kept", F.coalesce(F.col(score) > F.col("best_before"), F.lit(True)))


def precision_recall(got: DataFrame, want: DataFrame) -> DataFrame:
    """One row of tp, fp, fn, precision and recall of two sets of ids."""
    both = got.select("id", F.lit(True).alias("g")).join(want.select("id", F.lit(True).alias("w")), "id", "full")
    n = both.agg(F.count_if(F.expr("g and w")).alias("tp"), F.count_if(F.expr("g and w is null")).alias("fp"), F.count_if(F.expr("w and g is null")).alias("fn"))
    return n.select("tp", "fp", "fn", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 6).alias("recall"))


def seat_scores(seats: DataFrame) -> DataFrame:
    """``seats`` with ``score`` (0 to 100, one decimal).

    Needs ``passed, tests`` (null: as the gate), ``refusals, attempts, tokens, cost`` (both 0: unknown), ``duration_ms``.
    """
    gate = F.when(F.col("passed"), 1.0).otherwise(0.0)
    parts = {
        "gate": gate,
        "tests": F.when(F.col("tests"), 1.0).when(F.col("tests").isNull(), gate).otherwise(0.0),
        "refusals": 1.0 / (1.0 + F.col("refusals")),
        "retries": 1.0 / F.greatest(F.col("attempts"), F.lit(1)),
        "cost": F.when((F.col("tokens") == 0) & (F.col("cost") == 0), 0.5).otherwise(1.0 / (1.0 + F.col("tokens") / 200_000.0 + F.col("cost"))),
        "duration": 1.0 / (1.0 + F.col("duration_ms") / 1_800_000.0),
    }
    total = sum((F.lit(WEIGHTS[k]) * v for k, v in parts.items()), F.lit(0.0))
    return seats.withColumn("score", F.round(total, 1))


def run_summary(seats: DataFrame) -> DataFrame:
    """``run, seats, passed, refusals, score, state`` of each run."""
    rows = seats.groupBy("run").agg(F.count(F.lit(1)).alias("seats"), F.count_if("passed").alias("passed"), F.sum("refusals").alias("refusals"), F.round(F.avg("score"), 1).alias("score"))
    state = F.when(F.col("passed") == F.col("seats"), "passed").when(F.col("passed") > 0, "partial").otherwise("failed")
    return rows.withColumn("state", state)


def trends(seats: DataFrame, key: str, last: int = 20) -> DataFrame:
    """One row a key: runs, mean score, newest scores (oldest first), tokens, refusals and passes a run.

    A key may hold most rows: sums combine before the shuffle, and the newest scores are found in hashed parts first.
    """
    n = F.count(F.lit(1))
    sums = seats.groupBy(key).agg(
        n.alias("runs"), F.round(F.avg("score"), 1).alias("score"), F.sum("tokens").alias("tokens"),
        F.round(F.sum("refusals") / n, 2).alias("refusal_rate"), F.round(F.count_if("passed") / n, 2).alias("pass_rate"),
    )
    newest = smallest_k(seats.select(key, "started", "run", F.col("score").alias("s")), [key], [F.desc("started"), F.desc("run")], last)
    ordered = F.sort_array(F.collect_list(F.struct("started", "run", "s")))
    return sums.join(newest.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["s"].cast("string")), " ").alias("scores")), key)


def changelog(seats: DataFrame, files: DataFrame, domains: DataFrame, parts: int | None = None) -> DataFrame:
    """``domain, files, runs`` of what passed seats touched; a path without a domain is ``outside``.

    ``files``: ``run, seat, path``, or ``run, path`` where a run has one seat; ``domains``: ``path, domain``. The first row of a path stands for it,
    so one grouping by domain and run counts both: distinct counts of two columns would make two rows of each. With ``parts`` rows are dealt
    into so many parts for each step; files follow the seats there, as Spark asks what a semi-join keeps before it deals.
    """
    on, outside = [c for c in ("run", "seat") if c in files.columns], F.lit("outside")
    done = files.join(wide(dealt(seats.where("passed").select(*on), parts, *on)), on, "left_semi").select("run", "path")
    named = dealt(domains.select("path", F.coalesce("domain", outside).alias("domain")), parts, "path").distinct()
    first = F.col("path").isNotNull() & (F.row_number().over(Window.partitionBy("path").orderBy("run")) == 1)
    done = dealt(done, parts, "path").withColumn("first", first).join(wide(named), "path", "left").select(F.coalesce("domain", outside).alias("domain"), "run", "first")
    each = dealt(done, parts, "domain", "run").groupBy("domain", "run").agg(F.count_if("first").alias("files"))
    return each.groupBy("domain").agg(F.sum("files").alias("files"), F.count("run").alias("runs"))


def ready(slices: DataFrame, deps: DataFrame) -> DataFrame:
    """``id`` of queued slices whose dependencies have all passed. ``slices``: ``id, state``; ``deps``: ``id, needs``."""
    passed = slices.where("state = 'passed'").select(F.col("id").alias("needs"))
    blocked = deps.join(passed, "needs", "left_anti").select("id").distinct()
    return slices.where("state = 'queued'").join(blocked, "id", "left_anti").select("id")


def trailing(events: DataFrame, at: str, span: str) -> DataFrame:
    """Events later than a span before an instant, up to it; the start is not included."""
    end = F.lit(at).cast("timestamp_ntz")
    return events.where((F.col("ts") > end - F.expr(f"interval {span}")) & (F.col("ts") <= end))


def tail(events: DataFrame, since: int, newest: int) -> DataFrame:
    """The newest events after a position."""
    return events.where(F.col("event_id") > since).orderBy(F.desc("event_id")).limit(newest)


def ledger_seats(changes: DataFrame, refusals: DataFrame, tested: bool = True) -> DataFrame:
    """``run, slice, verdict, tests, attempts, refusals, tokens, cost, duration_ms, passed, score``: what is left of each slice of a finished plan.

    ``changes``: ``run, slice, at, state, reason, tokens, cost`` (``at`` in milliseconds, ties by ``state``); ``refusals``: ``run, slice``. The last state is the verdict, ``failed`` unless passed or
    rejected; a start of work is an attempt; without a test command there is no test result, and none of a slice that didn't pass for another
    reason. One pass of partial aggregates, so a long history never meets in one task.
    """
    last = F.max_by("state", F.struct("at", "state"))
    rows = changes.groupBy("run", "slice").agg(
        last.alias("last"), F.count_if(F.col("state") == "running").alias("attempts"), F.max(F.contains(F.lower(F.coalesce("reason", F.lit(""))), F.lit("test"))).alias("blamed"),
        F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"), (F.max("at") - F.min("at")).alias("duration_ms"),
    )
    refused = refusals.groupBy("run", "slice").agg(F.count(F.lit(1)).alias("refusals"))
    passed = F.col("last") == "passed"
    tests = F.when(F.lit(not tested), F.lit(None).cast("boolean")).when(passed, True).when(F.col("blamed"), False)
    rows = rows.join(refused, ["run", "slice"], "left").select(
        "run", "slice", F.when(F.col("last").isin("passed", "rejected"), F.col("last")).otherwise("failed").alias("verdict"), tests.alias("tests"), "attempts",
        F.coalesce("refusals", F.lit(0)).alias("refusals"), "tokens", "cost", "duration_ms", passed.alias("passed"),
    )
    return seat_scores(rows)


def ledger_copies(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Every run once, by ``id``: its file copy, else the one in the document; of several copies of a kind the last ``ended``, ties by all columns.

    A ranked aggregate, not a join: copies meet after they were cut to one a task and kind.
    """
    names = [c for c in documents.columns if c != "id"]
    both = documents.withColumn("_rank", F.lit(0)).unionByName(files.select(documents.columns).withColumn("_rank", F.lit(1)))
    best = both.groupBy("id").agg(F.max(F.struct("_rank", "ended", *[n for n in names if n != "ended"])).alias("_b"))
    return best.select("id", *[F.col("_b")[n].alias(n) for n in names])


def synopses(seats: DataFrame) -> DataFrame:
    """``run, no, text``: what became of each run of :func:`ledger_seats`, as lines: a headline, a line a slice, and where fences held."""
    some = lambda n, one, many: F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many))
    whole = seats.groupBy("run").agg(
        F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("seats"), F.round(F.avg("score"), 1).alias("score"), F.sum("tokens").alias("tokens"),
        F.array_sort(F.collect_list(F.when(F.col("refusals") > 0, F.col("slice")))).alias("held"),  # as many as a plan has slices
    )
    head = F.concat_ws(", ", F.format_string("%d of %d seats passed", "passed", "seats"), F.format_string("score %.1f", "score"), F.when(F.col("tokens") > 0, some(F.col("tokens"), "token", "tokens")))
    line = F.concat_ws(
        ", ", F.concat_ws(" ", F.col("slice").cast("string"), "verdict"), F.when(F.col("attempts") > 1, some(F.col("attempts"), "attempt", "attempts")),
        F.when(F.col("refusals") > 0, F.concat(some(F.col("refusals"), "refusal", "refusals"), F.lit(" by fences"))), F.when(~F.col("tests"), "tests failed"),
    )
    lines = seats.select("run", F.row_number().over(Window.partitionBy("run").orderBy("slice")).cast("long").alias("no"), line.alias("text"))
    fences = whole.where(F.size("held") > 0).select("run", F.col("seats") + 1, F.concat(F.lit("Fences held on "), F.array_join(F.transform("held", lambda s: s.cast("string")), ", ")))
    return whole.select("run", F.lit(0).cast("long").alias("no"), head.alias("text")).union(lines).union(fences)


def one_page(lines: DataFrame, key: str, most: int = PAGE_LETTERS) -> DataFrame:
    """``lines`` (``key, no, text``) of each key as far as they fit, with their line ends, into ``most`` letters: cut on a line, and nothing follows the first that doesn't fit."""
    upto = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_upto", F.sum(F.length("text") + 1).over(upto) - 1).where(F.col("_upto") <= most).drop("_upto")
