"""Streaming jobs run to completion over the generated tables, cut into several micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passledger import constants as C
from passledger.catalog import query
from passledger.catalog.corpus import HITS
from passledger.catalog.history import SLOTS, STATES, _modes, _placed, _rows
from passledger.catalog.ledger import WALK
from passledger.operators import convergence as cv
from passledger.operators import history as hist
from passledger.session import cut
from passledger.streaming import jobs
from passledger.views import view


ROWS_PER_FILE = 200_000
#: Below this many rows a delivery gains nothing from a file per core.
ROWS_FOR_A_CORE = 1_000


def arriving(df: DataFrame, by: str, parts: int = 3, files: int = 4) -> DataFrame:
    """The rows of ``df`` as a stream of ``parts`` deliveries in ``by`` order (a bigint column).

    Rows are computed once and stored; deliveries are written from there one after the other, in at least ``files`` files
    each, one per core and more with more rows; a trigger takes as many files as one delivery has.
    """
    spark: SparkSession = df.sparkSession
    place = jobs.fresh_dir(spark, "arriving")
    df = cut(df)
    seen = df.agg(F.coalesce(F.max(by), F.lit(0)).alias("top"), F.count("*").alias("n")).first()
    files = max(files, min(spark.sparkContext.defaultParallelism, -(-seen.n // ROWS_FOR_A_CORE)), -(-seen.n // (parts * ROWS_PER_FILE)))
    dealt = df.withColumn("_delivery", F.floor(F.col(by) * parts / (F.lit(seen.top) + 1)))
    for i in range(parts):
        dealt.filter(F.col("_delivery") == i).select(*df.columns).repartition(files).write.mode("append").parquet(place)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(place)


def run(stream: DataFrame, mode: str = "append", each=None) -> DataFrame:
    spark = stream.sparkSession
    return jobs.drain(stream, jobs.fresh_dir(spark, "out"), jobs.fresh_dir(spark, "stream"), mode, each=each)


@query("stream_ledger", "R1", f"WITH {WALK.replace('{src}', 'f6')} SELECT * FROM lanes")
def stream_ledger(spark, sf):
    """Lanes silent for a day are forgotten; what they had comes back from their pieces."""
    events = view(spark, sf, "f6").select("event", "lane", "ts", F.col("event_id").alias("seq"))
    return jobs.lane_totals(run(jobs.lane_ledger(arriving(events, "seq", 6), stall_seconds=0, retain_seconds=86_400), "update"))


@query("stream_stalls", "R5", """
WITH l AS (SELECT * FROM f6 WHERE lane IS NOT NULL AND trim(lane) <> '' AND event IN ('lane-dead', 'lane-relaunched', 'lane-adopted-empty')),
w AS (SELECT lane, ts, event_id, lead(ts) OVER (PARTITION BY lane ORDER BY ts, event_id) AS after, max(ts) OVER () AS clock,
  sum(CASE WHEN event = 'lane-dead' THEN 1 ELSE -1 END) OVER (PARTITION BY lane ORDER BY ts, event_id) AS s FROM l),
o AS (SELECT lane, ts, after, clock, CAST(s - least(0, min(s) OVER (PARTITION BY lane ORDER BY ts, event_id)) AS BIGINT) AS outstanding FROM w)
SELECT lane, outstanding, ts FROM o WHERE coalesce(after, clock) - ts > to_seconds({LIMIT})""".replace("{LIMIT}", str(2 * C.SWEEP_SECONDS)))
def stream_stalls(spark, sf):
    events = view(spark, sf, "f6").select("event", "lane", "ts", F.col("event_id").alias("seq"))
    return jobs.stalls(run(jobs.lane_ledger(arriving(events, "seq")), "update"))


@query("stream_first_sight", "R2", f"WITH {SLOTS} SELECT slot, candidate_id, sev_rank, is_new, is_new_serious FROM marked WHERE is_new OR is_new_serious")
def stream_first_sight(spark, sf):
    observed = hist.observed_ids(_rows(spark, sf)).select("candidate_id", "slot", "sev_rank")
    return jobs.sight_events(jobs.latest(run(jobs.first_sight(arriving(observed, "slot")), "update"), "candidate_id"))


@query("stream_convergence", "R4", f"""
WITH RECURSIVE {SLOTS}, {STATES} SELECT s.unit_id, s.state FROM steps s WHERE s.at = (SELECT count(*) FROM cycles c WHERE c.unit_id = s.unit_id)""")
def stream_convergence(spark, sf):
    observed, candidates, files = _placed(spark, sf)
    marked = hist.mark_new(observed)
    placed = candidates.select("candidate_id", "path").join(files, "path")
    units = files.groupBy("unit_id").agg((F.count("*") * 1700).alias("loc"))
    slots = marked.select("slot", "slot_pass", "phase").distinct()
    modes = _modes(spark, sf).select("unit_id", F.col("pass").alias("slot_pass"), "mode")
    n = marked.filter("is_new_serious").join(placed, "candidate_id").groupBy("unit_id", "slot").agg(F.count("*").alias("n"))
    every = units.join(F.broadcast(slots.agg(F.collect_set(F.struct("slot", "slot_pass", "phase")).alias("s")))).select("unit_id", "loc", F.inline("s"))  # slots are few
    counts = every.join(n, ["unit_id", "slot"], "left").join(modes, ["unit_id", "slot_pass"], "left").select(
        "unit_id", "slot", "phase", F.coalesce("mode", F.lit("full")).alias("mode"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        cv.quiet_threshold("loc").alias("bar"))
    return jobs.latest(run(jobs.live_convergence(arriving(counts, "slot", 4)), "update"), "unit_id").select("unit_id", "state")


@query("stream_progress", "R3 A26", """
WITH u AS (SELECT unit_id, pass, count(*) FILTER (WHERE severity = 'CRITICAL') % 2 AS odd FROM f2_valid GROUP BY ALL),
q AS (SELECT count(DISTINCT unit_id) AS units, count(*) FILTER (WHERE odd = 0 AND pass = (SELECT max(x.pass) FROM u x WHERE x.unit_id = u.unit_id)) AS quiet FROM u),
l AS (SELECT DISTINCT CASE WHEN l_suppkey % 12 = 1 THEN concat('sweep-', lens) ELSE concat(pass, lens, unit_id) END AS id, CASE WHEN l_suppkey % 12 = 1 THEN 0 ELSE pass END AS pass FROM f2_valid),
m AS (SELECT count(*) FILTER (WHERE pass > 0) AS lanes, CAST(max(pass) AS INT) AS pass, count(*) FILTER (WHERE pass = 0) AS sweeps FROM l),
c AS (SELECT count(*) AS candidates, count(*) FILTER (WHERE top >= 3) AS serious FROM (SELECT id, max(sev_rank) AS top FROM f2_valid GROUP BY id)),
v AS (SELECT count(*) AS verdicts, count(*) FILTER (WHERE verdict = 'VERIFIED') AS verified, count(*) FILTER (WHERE verdict = 'CONDITIONAL') AS conditional,
             count(*) FILTER (WHERE verdict = 'REFUTED') AS refuted FROM f4)
SELECT 'courts' AS phase, units, quiet, lanes, CAST(NULL AS BIGINT) AS lanes_due, pass, sweeps, candidates, serious, verdicts, verified, conditional, refuted FROM q, m, c, v""")
def stream_progress(spark, sf):
    """Facts on units, lanes, candidates and verdicts of one run; the last row of its progress."""
    rows = view(spark, sf, "f2_valid")
    per_unit = rows.groupBy("unit_id", "pass").agg((F.count_if(F.col("severity") == "CRITICAL") % 2).alias("odd"))
    sweep = F.col("l_suppkey") % 12 == 1
    lanes = rows.select(
        F.when(sweep, F.concat(F.lit("sweep-"), "lens")).otherwise(F.concat("pass", "lens", "unit_id")).alias("id"),
        F.when(sweep, F.lit("sweep")).otherwise(F.concat(F.lit("pass-"), "pass")).alias("value"), "pass").distinct()
    facts = [
        per_unit.select(F.lit("unit").alias("kind"), F.col("unit_id").alias("id"), F.when(F.col("odd") == 0, "quiet").otherwise("loud").alias("value"), F.col("pass").alias("seq"), "pass"),
        lanes.select(F.lit("lane").alias("kind"), "id", "value", F.lit(0).alias("seq"), "pass"),
        rows.select(F.lit("candidate").alias("kind"), "id", F.when(F.col("sev_rank") >= C.SERIOUS_RANK, "serious").otherwise("minor").alias("value"), F.col("sev_rank").alias("seq"), "pass"),
        view(spark, sf, "f4").select(F.lit("verdict").alias("kind"), F.col("o_orderkey").cast("string").alias("id"), F.lower("verdict").alias("value"), F.lit(0).alias("seq"), F.lit(3).alias("pass")),
    ]
    every = facts[0]
    for f in facts[1:]:
        every = every.unionByName(f)
    changes = run(jobs.fact_changes(arriving(every.select(F.lit("run").alias("run"), "*"), "pass")), "update")
    return jobs.progress(changes).orderBy(F.desc("batch")).limit(1).drop("run", "batch", "gained")


@query("stream_usage", "R6", """
WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, started_at) AS window_start, model, count(*) AS calls, count(*) FILTER (WHERE status = 'ok') AS successful, CAST(coalesce(sum(output_tokens) FILTER (WHERE status = 'ok'), 0) AS BIGINT) AS output_tokens FROM f10 GROUP BY ALL)
SELECT CAST(epoch(window_start) AS BIGINT) AS window_start, model, calls, successful, output_tokens FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(started_at) - INTERVAL 10 MINUTE FROM f10)""")
def stream_usage(spark, sf):
    out = jobs.closed_windows(run(arriving(view(spark, sf, "f10"), "event_id"), each=jobs.usage_windows))
    return out.drop("window_end").withColumn("window_start", F.unix_seconds("window_start"))


@query("stream_redaction", "R7", r"""
SELECT conv_id, turn, concat('id [REDACTED] ', text) AS text FROM conversations""")
def stream_redaction(spark, sf):
    rows = view(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("id 123-45-6789 "), "text").alias("text"))
    return run(jobs.redact_stream(arriving(rows, "conv_id"))).drop("batch")


@query("stream_sweep", "R7 D1", f"WITH {HITS} SELECT * FROM hits")
def stream_sweep(spark, sf):
    return run(jobs.sweep_stream(arriving(view(spark, sf, "f1_code"), "doc_id"))).drop("batch", "doc_id")


@query("stream_once", "R8", "SELECT event_id, event_type FROM events")
def stream_once(spark, sf):
    e = view(spark, sf, "events").select("event_id", "ts", "event_type")
    twice = e.unionByName(e.filter("event_id % 5 = 0"))
    return jobs.delivered(run(jobs.once(arriving(twice, "event_id"), ["event_id"])), ["event_id"]).select("event_id", "event_type")


@query("stream_append", "S12", "SELECT event_id AS seq, event, lane FROM f6")
def stream_append(spark, sf):
    from passledger.sources.readers import read_ledger

    events = view(spark, sf, "f6").select("event", "lane", F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("basis"), "ts", F.col("event_id").alias("seq"))
    place = jobs.fresh_dir(spark, "ledger")
    jobs.append_ledger(arriving(events, "seq"), place, jobs.fresh_dir(spark, "stream")).awaitTermination()
    return read_ledger(spark, place).select("seq", "event", "lane")
