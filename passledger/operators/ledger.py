"""Append-only event ledgers: ordered reduction, stalls, orphan reconciliation, usage, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passledger import constants as C
from passledger import functions as fn
from passledger.operators.ranking import with_lags


def reduce_ledger(events: DataFrame, order: list[str], chunk_seconds: int = 3600, ts: str = "ts") -> DataFrame:
    """Per lane: deaths, closures, open (outstanding) and over_closures of the ordered ledger.

    A closure consumes an already open death, otherwise it is over-closure and never offsets a later death. As a walk
    S of +1/-1 steps: over = -min(0, min S), open = S_last + over. (sum, lowest prefix) composes over pieces, so each
    lane is reduced per time chunk and the few chunk rows are combined in order: a lane of any length is many tasks.
    """
    relevant = events.filter(F.col("event").isin(C.LEDGER_DEATH, *C.LEDGER_CLOSURES) & (F.trim(F.coalesce("lane", F.lit(""))) != ""))
    step = F.when(F.col("event") == C.LEDGER_DEATH, 1).otherwise(-1)
    chunk = F.floor(F.unix_timestamp(ts) / chunk_seconds)
    w = Window.partitionBy("lane", "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    prefix = relevant.select("lane", chunk.alias("_chunk"), step.alias("_step"), *order).withColumn("_s", F.sum("_step").over(w))
    pieces = prefix.groupBy("lane", "_chunk").agg(
        F.sum("_step").alias("_sum"), F.min("_s").alias("_low"), F.count_if(F.col("_step") == 1).alias("_deaths"), F.count("*").alias("_n")
    )
    before = Window.partitionBy("lane").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("_low", F.coalesce(F.sum("_sum").over(before), F.lit(0)) + F.col("_low"))
    return (
        placed.groupBy("lane")
        .agg(F.sum("_deaths").alias("deaths"), (F.sum("_n") - F.sum("_deaths")).alias("closures"),
             F.sum("_sum").alias("_last"), F.min("_low").alias("_low"))
        .withColumn("over_closures", -F.least(F.lit(0).cast("bigint"), F.col("_low")))
        .withColumn("outstanding", F.col("_last") + F.col("over_closures"))
        .select("lane", "deaths", "closures", "outstanding", "over_closures")
    )


def ledger_totals(events: DataFrame, per_lane: DataFrame) -> DataFrame:
    """unreconciled (outstanding plus rows without a usable lane), over_closures, invalid_rows."""
    blank = F.col("event").isin(C.LEDGER_DEATH, *C.LEDGER_CLOSURES) & (F.trim(F.coalesce("lane", F.lit(""))) == "")
    invalid = events.agg(F.count_if(blank).alias("invalid_rows"))
    lanes = per_lane.agg(
        F.coalesce(F.sum("outstanding"), F.lit(0)).cast("bigint").alias("_open"),
        F.coalesce(F.sum("over_closures"), F.lit(0)).cast("bigint").alias("over_closures"),
    )
    return lanes.join(F.broadcast(invalid)).select(
        (F.col("_open") + F.col("invalid_rows")).alias("unreconciled"), "over_closures", "invalid_rows"
    )


def stalls(sweeps: DataFrame, key: str, order: list[str], size: str, sweeps_needed: int = 2) -> DataFrame:
    """Rows where the size has not grown over the last ``sweeps_needed`` sweeps of the lane."""
    names = {f"_lag{n}": (size, n) for n in range(1, sweeps_needed + 1)}
    lagged = with_lags(sweeps, [key], order, names)
    series = [F.col(size)] + [F.col(n) for n in names]
    still = fn.all_of([F.coalesce(a <= b, F.lit(False)) for a, b in zip(series, series[1:])])
    return lagged.withColumn("dead", still).drop(*names)


def deltas(totals: DataFrame, key: str, order: list[str], total: str) -> DataFrame:
    """Growth since the previous observation of the key (null on the first)."""
    return with_lags(totals, [key], order, {"_before": (total, 1)}).withColumn("delta", F.col(total) - F.col("_before")).drop("_before")


def evidence_union(sources: list[tuple[int, DataFrame]]) -> DataFrame:
    """(source, pass, lens, unit_id, basis): evidence of redone work; a null lens covers every lens of the unit."""
    out = None
    for rank, df in sources:
        part = df.select(F.lit(rank).alias("source"), F.col("pass").cast("bigint").alias("pass"), "lens", "unit_id", "basis")
        out = part if out is None else out.unionByName(part)
    return out


def reconcile_orphans(per_lane: DataFrame, evidence: DataFrame) -> DataFrame:
    """Closure rows (lane, n, basis) for outstanding deaths whose work was redone at the same or a later pass.

    Evidence shrinks to the latest pass per (unit, lens, source), so each lane meets a handful of rows.
    """
    label = fn.parse_lane_label("lane")
    open_lanes = per_lane.filter("outstanding > 0").withColumn("_l", label).filter("_l IS NOT NULL").select(
        "lane", "outstanding", F.col("_l.pass").alias("_pass"), F.col("_l.lens").alias("_lens"), F.col("_l.unit_id").alias("unit_id")
    )
    latest = evidence.groupBy("unit_id", "lens", "source").agg(
        F.max("pass").alias("pass"), F.max_by("basis", "pass").alias("basis")
    )
    covered = open_lanes.join(latest, "unit_id").filter(
        (F.col("pass") >= F.col("_pass")) & (F.col("lens").isNull() | (F.col("lens") == F.col("_lens")))
    )
    best = covered.groupBy("lane", "outstanding").agg(F.min_by("basis", F.struct("source", "basis")).alias("basis"))
    return best.select(
        F.lit("lane-relaunched").alias("event"), "lane", F.explode(F.expr("sequence(1, CAST(outstanding AS INT))")).alias("n"),
        F.concat(F.lit("reconciled: superseded by "), "basis").alias("basis"),
    )


def usage_summary(usage: DataFrame, group: list[str], tokens: list[str], start: str = "started_at", end: str = "completed_at") -> DataFrame:
    """Calls, successes, failures, token sums of successful calls, distinct models, wall seconds."""
    ok = F.col("status") == "ok"
    return usage.groupBy(*group).agg(
        F.count("*").alias("calls"), F.count_if(ok).alias("successful"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"),
        *[F.coalesce(F.sum(F.when(ok, F.col(t))), F.lit(0)).cast("bigint").alias(t) for t in tokens],
        F.count_distinct("model").alias("models"),
        (F.unix_seconds(F.max(end)) - F.unix_seconds(F.min(start))).alias("wall_seconds"),
    )


def invocation_summary(stream: DataFrame, key: str, order: str) -> DataFrame:
    """Per invocation: last agent message, usage over completed turns, error flag without a message.

    ``stream``: type, item_type, text, tokens. ``kind`` comes from the task's first line when a ``task`` column exists.
    """
    message = (F.col("type") == "item.completed") & (F.col("item_type") == "agent_message") & F.col("text").isNotNull()
    return stream.groupBy(key).agg(
        F.max_by(F.when(message, F.col("text")), F.when(message, F.col(order))).alias("final_text"),
        F.coalesce(F.sum(F.when(F.col("type") == "turn.completed", F.col("tokens"))), F.lit(0)).cast("bigint").alias("tokens"),
        F.count("*").alias("events"),
    ).withColumn("is_error", F.col("final_text").isNull())


def task_kind(task, prefixes: dict[str, str], default: str = "agent"):
    """Kind of an invocation from the first line of its task text."""
    first = F.element_at(F.split(F.regexp_replace(task, r"^\s+", ""), C.LINE_BREAKS), 1)
    out = F.when(F.lit(False), F.lit(default))
    for prefix, kind in prefixes.items():
        out = out.when(first.startswith(prefix), F.lit(kind))
    return out.otherwise(F.lit(default))


def timeline(files: DataFrame, group: list[str]) -> DataFrame:
    """First and last modification time of first-pass lane files, and of the verdict file."""
    lane = F.col("name").rlike(r"^lane-pass1-.*\.jsonl$")
    return files.groupBy(*group).agg(
        F.min(F.when(lane, F.col("modified"))).alias("first_lane"), F.max(F.when(lane, F.col("modified"))).alias("last_lane"),
        F.max(F.when(F.col("name") == "verdicts.jsonl", F.col("modified"))).alias("verdicts"),
    )


def run_pace(widths: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Average lane width (one decimal), minutes from first lane to verdicts (floored at 0), run duration."""
    avg = widths.filter("width IS NOT NULL").groupBy(key).agg(F.bround(F.avg("width"), 1).alias("avg_width"))
    lag = F.greatest(F.lit(0).cast("bigint"), F.floor((F.unix_seconds("verdicts") - F.unix_seconds("first_lane")) / 60))
    seconds = F.unix_seconds("ended_at") - F.unix_seconds("started_at")
    return runs.join(avg, key, "left").withColumn("lag_minutes", F.coalesce(lag, F.lit(0))).withColumn(
        "duration", fn.format_duration(seconds)
    )
