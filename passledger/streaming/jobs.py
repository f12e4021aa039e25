"""Structured Streaming versions of the ledger operators.

Inputs are append-only tables. Where a stateful operator needs the event clock, the watermark is taken upstream and the event
time goes on as a plain column, so Spark moves timers by it and yet drops no row: rows behind a limit come out marked as
late. State has a time to live, or there is none: a batch then leaves pieces that add up.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from passledger import constants as C
from passledger import functions as fn
from passledger.operators import detect as de
from passledger.session import fresh_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def drain(
    stream: DataFrame, out: str, checkpoint: str, mode: str = "append", query_name: str | None = None, each: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Run a stream over what is available and return its output table.

    Each micro-batch goes to its own ``batch`` folder, overwritten on replay, so a restart does not double rows. ``each``
    makes a batch's rows first: a stateless step in which a batch may be grouped.
    """
    each = each or (lambda batch: batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    handle = (writer.queryName(query_name) if query_name else writer).start()
    handle.awaitTermination()
    schema = each(stream.sparkSession.createDataFrame([], stream.schema)).schema
    return stream.sparkSession.read.option("basePath", out).schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(out)


def latest(table: DataFrame, *key: str) -> DataFrame:
    """Last state per key of an update-mode output."""
    rest = [c for c in table.columns if c not in (*key, "batch")]
    return table.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*key, "_r.*")


def clocked(events: DataFrame, ts: str) -> DataFrame:
    """``events`` with a watermark at the newest ``ts`` so far, and ``ts`` as a plain column: no operator behind drops late rows."""
    return events.withWatermark(ts, "0 seconds").withColumn(ts, F.timestamp_micros(F.unix_micros(ts)))


# -- lane ledger: ordered reduction and stall alerts ------------------------------------------------
LANE_OUTPUT = "lane string, kind string, piece bigint, deaths bigint, closures bigint, outstanding bigint, over_closures bigint, ts timestamp"
LANE_STATE = "deaths bigint, closures bigint, outstanding bigint, over_closures bigint, first_us bigint, ts_us bigint, seq bigint, timer_ms bigint, told boolean"


class LaneReducer(StatefulProcessor):
    """State per lane: the walk of its present piece (deaths, closures, open deaths, over-closures), its last place, its timer.

    Rows of a batch are taken in (ts, seq) order; a row before the last place seen is emitted as 'late'. A lane with no row
    for more than ``stall_us`` of event time raises 'stalled' as of its last event: by a timer while it is silent, or when
    the row behind the gap comes first. A lane silent for ``retain_us`` is forgotten; what it had is a finished piece, and
    pieces of a lane compose (``lane_totals``). A row that old which finds no state is late as well.
    """

    def __init__(self, stall_us: int, retain_us: int):
        self.stall_us, self.retain_us = stall_us, retain_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lane", LANE_STATE)

    def _wake(self, held: list, told: bool) -> None:
        """One timer per lane: for the alarm first, then for the end of its state."""
        if held[7] >= 0:
            self.handle.deleteTimer(held[7])
        wait = self.retain_us if told or not self.stall_us else self.stall_us
        held[7], held[8] = ((held[5] + wait) // 1000 + 1 if wait else -1), told
        if held[7] >= 0:
            self.handle.registerTimer(held[7])
        self.state.update(tuple(held))

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["lane", "kind", "piece", "deaths", "closures", "outstanding", "over_closures", "ts"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lane, clock_us = key[0], timerValues.getCurrentWatermarkInMs() * 1000
        held = self.state.get()
        held = list(held) if held else None
        table = pd.concat(list(rows)).sort_values(["ts", "seq"])
        stamps = table["ts"].astype("datetime64[us]").astype("int64").tolist()
        out = []
        for at, number, event, ts in zip(stamps, table["seq"].tolist(), table["event"].tolist(), table["ts"].tolist()):
            if held is None:
                if self.retain_us and at + self.retain_us <= clock_us:
                    out.append((lane, "late", at, 0, 0, 0, 0, ts))
                    continue
                held = [0, 0, 0, 0, at, -1, -1, -1, False]
            deaths, closures, outstanding, over, first, ts_us, seq, _, told = held
            if (at, number) < (ts_us, seq):
                out.append((lane, "late", first, deaths, closures, outstanding, over, ts))
                continue
            if self.stall_us and ts_us >= 0 and at - ts_us > self.stall_us and not told:
                out.append((lane, "stalled", first, deaths, closures, outstanding, over, pd.Timestamp(ts_us, unit="us")))
            if event == C.LEDGER_DEATH:
                deaths, outstanding = deaths + 1, outstanding + 1
            else:
                closures += 1
                outstanding, over = (outstanding - 1, over) if outstanding else (0, over + 1)
            held[:7], held[8] = [deaths, closures, outstanding, over, first, at, number], False
        if held is not None:
            self._wake(held, held[8])
            out.append((lane, "state", held[4], *held[:4], pd.Timestamp(held[5], unit="us")))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        out = []
        if held and held[7] == expiredTimerInfo.getExpiryTimeInMs():
            held = list(held)
            clock_us = timerValues.getCurrentWatermarkInMs() * 1000
            held[7] = -1  # it has gone off
            if self.stall_us and not held[8]:
                out.append((key[0], "stalled", held[4], *held[:4], pd.Timestamp(held[5], unit="us")))
                held[8] = True
            if self.retain_us and held[5] + self.retain_us < clock_us:
                self.state.clear()
            elif self.retain_us:
                self._wake(held, True)
            else:
                self.state.update(tuple(held))
        yield self._frame(out)

    def close(self) -> None:
        pass


def lane_ledger(events: DataFrame, stall_seconds: int = 2 * C.SWEEP_SECONDS, retain_seconds: int = 0) -> DataFrame:
    """Streaming ledger reduction per lane (update mode). ``events``: event, lane, ts, seq.

    Kinds of rows: 'state' (the lane's piece so far), 'stalled' (raised while the stream runs), 'late' (a row out of order,
    kept apart). ``stall_seconds`` 0 raises none. With ``retain_seconds`` the state of a lane silent for so long is dropped,
    so state follows the lanes at work; without, it is one small row per lane.
    """
    use_rocksdb(events.sparkSession)
    if 0 < retain_seconds < stall_seconds:
        raise ValueError("a lane must be kept until it counts as stalled")
    relevant = events.filter(
        F.col("event").isin(C.LEDGER_DEATH, *C.LEDGER_CLOSURES) & (F.trim(F.coalesce("lane", F.lit(""))) != "")
    ).select("lane", "event", "ts", "seq")
    return clocked(relevant, "ts").groupBy("lane").transformWithStateInPandas(
        statefulProcessor=LaneReducer(stall_seconds * 1_000_000, retain_seconds * 1_000_000), outputStructType=LANE_OUTPUT, outputMode="Update", timeMode="EventTime"
    )


def lane_totals(table: DataFrame) -> DataFrame:
    """(lane, deaths, closures, outstanding, over_closures) from the output of ``lane_ledger``: the pieces of a lane in order.

    A piece is a walk with sum outstanding - over and lowest prefix -over; walks compose by adding sums before prefixes.
    """
    pieces = latest(table.filter("kind = 'state'"), "lane", "piece")
    step = F.col("outstanding") - F.col("over_closures")
    earlier = Window.partitionBy("lane").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    low = F.least(F.lit(0), F.coalesce(F.sum(step).over(earlier), F.lit(0)) - F.col("over_closures"))
    walked = pieces.select("lane", "deaths", "closures", step.alias("_step"), low.alias("_low")).groupBy("lane").agg(
        F.sum("deaths").alias("deaths"), F.sum("closures").alias("closures"), F.sum("_step").alias("_sum"), F.min("_low").alias("_low"))
    return walked.select("lane", "deaths", "closures", (F.col("_sum") - F.col("_low")).alias("outstanding"), (-F.col("_low")).alias("over_closures"))


def stalls(table: DataFrame) -> DataFrame:
    """(lane, outstanding, ts): the alerts among the output of ``lane_ledger``."""
    return table.filter("kind = 'stalled'").select("lane", "outstanding", "ts")


# -- first sight of ids -----------------------------------------------------------------------------
def first_sight(observed: DataFrame) -> DataFrame:
    """``observed``: candidate_id, slot, sev_rank -> per id its first slot and the first slot with rank >= HIGH.

    'New' is the smallest slot, 'new serious' the smallest slot whose rank reaches HIGH, so both are minima: a native
    streaming aggregate (update mode) with partial aggregation and two numbers of state per id, right for late rows too.
    """
    use_rocksdb(observed.sparkSession)
    place = F.col("slot") * 10 + (F.lit(9) - F.col("sev_rank"))
    return observed.groupBy("candidate_id").agg(
        F.min(place).alias("first"), F.min(F.when(F.col("sev_rank") >= C.SERIOUS_RANK, place)).alias("serious")
    )


def sight_events(sights: DataFrame) -> DataFrame:
    """(candidate_id, slot, sev_rank, is_new, is_new_serious) from the latest ``first_sight`` row of each id."""
    places = F.array_distinct(F.array_compact(F.array("first", "serious")))
    rows = sights.select("candidate_id", "first", "serious", F.explode(places).alias("p"))
    return rows.select(
        "candidate_id", F.floor(F.col("p") / 10).cast("bigint").alias("slot"), (F.lit(9) - F.col("p") % 10).cast("int").alias("sev_rank"),
        (F.col("p") == F.col("first")).alias("is_new"), F.coalesce(F.col("p") == F.col("serious"), F.lit(False)).alias("is_new_serious"),
    )


# -- convergence ------------------------------------------------------------------------------------
class Convergence(StatefulProcessor):
    """State per unit: closed state, and the open cycle (slot, mode, count). Sweep rows add to the open cycle."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("unit", "state string, slot bigint, mode string, n bigint, bar bigint")

    @staticmethod
    def step(state: str, mode: str, n: int, bar: int) -> str:
        if mode == "confirm":
            return "quiet" if state == "confirm" and n == 0 else "loud"
        if n > bar:
            return "loud"
        return "quiet" if state in ("quiet", "confirm") else "confirm"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, slot, mode, n, bar = self.state.get() or ("loud", -1, "", 0, 0)
        table = pd.concat(list(rows)).groupby(["slot", "phase", "mode"], as_index=False).agg({"n": "sum", "bar": "max"}).sort_values("slot")
        for row in table.itertuples(index=False):
            bar = int(row.bar)
            if row.phase == "sweep":
                n += int(row.n) if slot >= 0 else 0
            elif row.mode != "partial":
                if row.slot == slot:
                    n += int(row.n)
                else:
                    if slot >= 0:
                        state = self.step(state, mode, n, bar)
                    slot, mode, n = int(row.slot), row.mode, int(row.n)
        self.state.update((state, slot, mode, n, bar))
        shown = self.step(state, mode, n, bar) if slot >= 0 else state
        yield pd.DataFrame([(key[0], shown, slot)], columns=["unit_id", "state", "open_slot"])

    def close(self) -> None:
        pass


def live_convergence(counts: DataFrame) -> DataFrame:
    """``counts``: unit_id, slot, phase, mode, n (new serious ids, addable), bar. Update-mode state per unit."""
    use_rocksdb(counts.sparkSession)
    return counts.groupBy("unit_id").transformWithStateInPandas(
        statefulProcessor=Convergence(), outputStructType="unit_id string, state string, open_slot bigint", outputMode="Update", timeMode="None"
    )


# -- progress, usage, redaction, resume -------------------------------------------------------------
class FactBook(StatefulProcessor):
    """Map state of one (run, kind, shard): piece -> its facts, id -> [value, seq] as JSON. Emits how counts of values change, and nothing where none does.

    A call of the state is a round trip to the JVM, so ids are not kept one by one: a batch reads and writes a piece once,
    however many of its ids it brings.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.facts = handle.getMapState("facts", "piece int", "held string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run, kind, _ = key
        table = pd.concat(list(rows)).sort_values(["seq", "value"]).drop_duplicates("id", keep="last").sort_values("piece")
        known = self.facts.exists()
        change: dict[str, int] = {}
        held, at, moved = {}, None, False
        for piece, ident, value, seq in zip(table["piece"].tolist(), table["id"].tolist(), table["value"].tolist(), table["seq"].tolist()):
            if piece != at:
                if moved:
                    self.facts.updateValue((at,), (json.dumps(held),))
                held = json.loads(self.facts.getValue((piece,))[0]) if known and self.facts.containsKey((piece,)) else {}
                at, moved = piece, False
            before = held.get(ident)
            if before is not None:
                if (seq, value) <= (before[1], before[0]):
                    continue
                change[before[0]] = change.get(before[0], 0) - 1
            change[value] = change.get(value, 0) + 1
            held[ident], moved = [value, seq], True
        if moved:
            self.facts.updateValue((at,), (json.dumps(held),))
        out = [(run, kind, value, n) for value, n in change.items() if n]
        yield pd.DataFrame(out, columns=["run", "kind", "value", "delta"])

    def close(self) -> None:
        pass


def fact_changes(facts: DataFrame, shards: int = 32, pieces: int = 4096) -> DataFrame:
    """``facts``: run, kind, id, value, seq -> (run, kind, value, delta), update mode: how many ids more or fewer have a value.

    Of several facts on one id the one with the largest seq holds (of ties, the larger value), in whatever order they come;
    a repeated fact changes nothing. Ids of a kind are dealt over ``shards`` map states of at most ``pieces`` entries each.
    Facts without id are left out.
    """
    use_rocksdb(facts.sparkSession)
    code = F.xxhash64("id")
    given = facts.filter("id is not null").select(
        F.coalesce("run", F.lit("")).alias("run"), "kind", F.col("id").cast("string").alias("id"), F.coalesce("value", F.lit("")).alias("value"),
        F.coalesce(F.col("seq").cast("bigint"), F.lit(0)).alias("seq"), F.pmod(code, F.lit(shards)).cast("int").alias("shard"),
        F.pmod(F.shiftright(code, 32), F.lit(pieces)).cast("int").alias("piece"))
    return given.groupBy("run", "kind", "shard").transformWithStateInPandas(
        statefulProcessor=FactBook(), outputStructType="run string, kind string, value string, delta bigint", outputMode="Update", timeMode="None"
    )


def progress(changes: DataFrame, lenses: int = len(C.FAMILY_KEYWORDS)) -> DataFrame:
    """One row per run and batch in which something changed, from the output of ``fact_changes``.

    Kinds: unit (value quiet or not), lane (pass-<n> or sweep), candidate (serious or not), verdict (verified, conditional,
    refuted). phase is preflight, reading (lanes) or courts (verdicts); lanes_due is units x lenses while pass 1 is the only
    one, else null; gained counts candidates since the row before.
    """
    is_kind = {k: F.col("kind") == k for k in ("unit", "lane", "candidate", "verdict")}
    is_pass = is_kind["lane"] & F.col("value").startswith("pass-")
    counted = {
        "units": is_kind["unit"], "quiet": is_kind["unit"] & (F.col("value") == "quiet"), "lanes": is_pass,
        "_later": is_pass & (F.col("value") != "pass-1"), "sweeps": is_kind["lane"] & (F.col("value") == "sweep"),
        "candidates": is_kind["candidate"], "serious": is_kind["candidate"] & (F.col("value") == "serious"), "verdicts": is_kind["verdict"],
        **{v: is_kind["verdict"] & (F.col("value") == v) for v in ("verified", "conditional", "refuted")},
    }
    number = F.when(is_pass & (F.col("delta") > 0), F.expr("try_cast(substring(value, 6) as int)"))
    by_batch = changes.groupBy("run", "batch").agg(
        *(F.coalesce(F.sum(F.when(c, F.col("delta"))), F.lit(0)).alias(n) for n, c in counted.items()), F.max(number).alias("pass"))
    so_far = Window.partitionBy("run").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    totals = by_batch.select("run", "batch", F.col("candidates").alias("gained"), *(F.sum(n).over(so_far).alias(n) for n in counted), F.max("pass").over(so_far).alias("pass"))
    return totals.select(
        "run", "batch", F.when(F.col("verdicts") > 0, "courts").when(F.col("lanes") > 0, "reading").otherwise("preflight").alias("phase"),
        "units", "quiet", "lanes", F.when((F.col("units") > 0) & (F.col("_later") == 0), F.col("units") * lenses).alias("lanes_due"), "pass",
        *(c for c in counted if c not in ("units", "quiet", "lanes", "_later")), "gained")


def usage_windows(usage: DataFrame, width: str = "1 hour", ts: str = "started_at") -> DataFrame:
    """Calls, successes and tokens per window and model of one batch (``each`` of ``drain``): pieces that add up, without any state."""
    ok = F.col("status") == "ok"
    return usage.groupBy(F.window(ts, width).alias("w"), "model").agg(
        F.count("*").alias("calls"), F.count_if(ok).alias("successful"),
        F.coalesce(F.sum(F.when(ok, F.col("output_tokens"))), F.lit(0)).alias("output_tokens"), F.max(ts).alias("newest"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "model", "calls", "successful", "output_tokens", "newest")


def closed_windows(table: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The windows that end ``delay`` or more before the newest event, late calls included, from pieces of ``usage_windows``."""
    now = table.groupBy("window_start", "window_end", "model").agg(
        *(F.sum(c).cast("bigint").alias(c) for c in ("calls", "successful", "output_tokens")))
    clock = table.agg(F.max("newest").alias("_clock"))
    return now.join(F.broadcast(clock)).filter(F.col("window_end") <= F.col("_clock") - F.expr(f"INTERVAL {delay}")).drop("_clock")


def redact_stream(lines: DataFrame, column: str = "text") -> DataFrame:
    return lines.withColumn(column, fn.redact_text(column))


def sweep_stream(documents: DataFrame, detectors=None) -> DataFrame:
    """Detector hits of arriving documents; stateless."""
    return de.sweep_lines(de.exclude_dirs(documents), detectors)


class OnceGate(StatefulProcessor):
    """Keys of one shard in two generations of map state. Emits first arrivals, and rows behind the limit as late.

    The younger generation takes keys for ``delay`` of the event clock; then it becomes the older, and the older one is
    dropped whole, if all its rows are behind the limit by then (else the change waits).
    """

    def __init__(self, key: list[str], ts: str, delay_us: int):
        self.key, self.ts, self.delay_us = key, ts, delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.maps = [handle.getMapState(f"seen{k}", "key string", "there boolean") for k in (0, 1)]
        self.turn = handle.getValueState("turn", "young int, since_us bigint, newest0_us bigint, newest1_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clock = max(0, timerValues.getCurrentWatermarkInMs() * 1000)
        young, since, *newest = self.turn.get() or (0, clock, -1, -1)
        limit = clock - self.delay_us
        if clock - since >= self.delay_us and newest[1 - young] <= limit:
            young, since = 1 - young, clock
            newest[young] = -1
            self.maps[young].clear()
        table = pd.concat(list(rows), ignore_index=True)
        stamps = table[self.ts].astype("datetime64[us]").astype("int64").where(table[self.ts].notna(), limit).tolist()
        kinds = []
        held = [m.exists() for m in self.maps]
        for name, at in zip(table["once_key"].tolist(), stamps):
            if at <= limit:
                kinds.append("late")
            elif any(m.containsKey((name,)) for m, h in zip(self.maps, held) if h):
                kinds.append(None)
            else:
                self.maps[young].updateValue((name,), (True,))
                held[young] = True
                newest[young] = max(newest[young], at)
                kinds.append("first")
        self.turn.update((young, since, *newest))
        yield table.drop(columns=["once_key", "once_shard"], errors="ignore").assign(kind=kinds).dropna(subset=["kind"])

    def close(self) -> None:
        pass


def once(items: DataFrame, key: list[str], ts: str = "ts", delay: str | None = "1 day", shards: int = 32) -> DataFrame:
    """Each item once. With ``delay`` (append mode) a column kind is added: 'first' arrivals, and 'late' rows.

    Keys are remembered for ``delay`` of event time at least and twice that at most, so the state levels off. A redelivery
    has the time of its item; a row behind the limit, or without a time, may be one or not: it comes out as 'late', and
    ``delivered`` settles it against the table. Without ``delay`` every key is kept, however late it may come again.
    """
    if delay is None:
        return items.dropDuplicates(key)
    use_rocksdb(items.sparkSession)
    width = items.sparkSession.sql(f"SELECT CAST(unix_micros(TIMESTAMP'1970-01-01 00:00:00Z' + INTERVAL {delay}) AS BIGINT) AS us").first().us
    named = F.to_json(F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(key))), {"ignoreNullFields": "false"})
    dealt = clocked(items, ts).withColumn("once_key", named).withColumn("once_shard", F.pmod(F.xxhash64("once_key"), F.lit(shards)).cast("int"))
    return dealt.groupBy("once_shard").transformWithStateInPandas(
        statefulProcessor=OnceGate(key, ts, width), outputStructType=StructType([*items.schema.fields, StructField("kind", StringType())]),
        outputMode="Append", timeMode="EventTime")


def delivered(table: DataFrame, key: list[str]) -> DataFrame:
    """Each item once, from the output of ``once``: late rows whose key is not there yet are added, one per key."""
    firsts, late = table.filter("kind = 'first'"), table.filter("kind = 'late'").dropDuplicates(key)
    same = [firsts[k].eqNullSafe(late[k]) for k in key]
    return firsts.unionByName(late.join(firsts, same, "left_anti"))


def append_ledger(events: DataFrame, path: str, checkpoint: str):
    """Append-only JSON ledger sink with exactly-once files; returns the started query."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
