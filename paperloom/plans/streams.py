"""Registered streaming queries: the event table as a file stream, processed as far as available."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import ledger as L
from paperloom.operators import sketches as Q
from paperloom.plans import adapters as A
from paperloom.plans import corpus, ledger, repos, web  # noqa: F401
from paperloom.plans.ledger import CALLS
from paperloom.session import cut_lineage, work_folder
from paperloom.streaming import live
from paperloom.streaming.rollups import KeptRollup
from paperloom.streaming.running import run_available, run_batches, table_stream


def _stream(spark, folder, name, sql):
    """An adapter over a table read as a stream."""
    schema = A.table(spark, folder, name).schema
    return spark.sql(sql, **{name: table_stream(spark, folder, name, schema)})


def _events(spark, folder, sql):
    return _stream(spark, folder, "events", sql).withColumn("ts", F.col("ts").cast("timestamp"))


def live_ledger(spark, folder):
    out = run_available(live.live_ledger(L.price_calls(_events(spark, folder, CALLS))), "update", ["window_start", "window_end", "task", "model"])
    return out.select(F.unix_seconds("window_start").alias("window_start"), "task", "model", "calls", "tokens_in", "tokens_out",
                      F.col("cost_usd").cast("double").alias("cost_usd"), F.col("latency_ms").cast("double").alias("latency_ms"))


PROGRESS = f"""SELECT {ledger.USER} || '-' || CAST(event_id % 50 AS STRING) AS trace_id, CASE event_type WHEN 'click' THEN 'parse_start' WHEN 'view' THEN 'parse_done' WHEN 'signup' THEN 'refine_start'
  WHEN 'purchase' THEN 'refine_failed' ELSE 'refine_skipped' END AS event, ts FROM {{events}}"""


def live_stages(spark, folder):
    out = run_available(live.live_stage_durations(_events(spark, folder, PROGRESS), "24 hours", NOW, slot=SLOT), closing=True)
    return out.select("trace_id", "stage", F.unix_micros("started").alias("started"), F.coalesce(F.unix_micros("ended"), F.lit(0)).alias("ended"),
                      F.coalesce("outcome", F.lit("")).alias("outcome"), "timed_out")


def stage_pairs(spark, folder):
    events = A.bind(spark, folder, PROGRESS).withColumn("ts", F.col("ts").cast("timestamp"))
    return live.stage_durations(events, "24 hours").select(
        "trace_id", "stage", F.unix_micros("started").alias("started"), F.coalesce(F.unix_micros("ended"), F.lit(0)).alias("ended"), "timed_out")


def live_stage_join(spark, folder):
    out = run_available(live.live_stage_join(_events(spark, folder, PROGRESS), "24 hours", NOW), closing=True)
    return out.select("trace_id", "stage", F.unix_micros("started").alias("started"), F.coalesce(F.unix_micros("ended"), F.lit(0)).alias("ended"),
                      F.coalesce("outcome", F.lit("")).alias("outcome"), "timed_out")


def _steps(spark, folder):
    return _events(spark, folder, web.STEPS.replace("SELECT ", "SELECT ts, ", 1)).withColumn("after", F.struct("url"))


def _finished(spark, folder):
    """The guard on finished runs: every batch of runs is judged with its recorded steps."""
    # One run is finished by its latest event; DISTINCT is for the batch form, a stream takes each run's first row.
    # It is remembered until the watermark is WHOLE behind it, so the state is that of the runs of that time.
    runs = _events(spark, folder, web.RUNS.replace("SELECT DISTINCT ", "SELECT ts, ")).withWatermark("ts", WHOLE).dropDuplicatesWithinWatermark(["trace_id"]).drop("ts")
    none = web._steps(spark, folder).schema["after"].dataType

    def steps_of(batch):
        return web._steps(spark, folder).withColumn("before", F.lit(None).cast(none)).join(batch.select("trace_id").distinct(), "trace_id", "left_semi")

    out = run_batches(lambda home: live.guard_finished_runs(runs, steps_of, home + "/out", home + "/checkpoint"), spark)
    return out.select("trace_id", "status", "guarded_status", F.coalesce("guard_mode", F.lit("")).alias("guard_mode"))


KEPT = {"calls": "count", "tokens_in": "sum", "tokens_out": "sum", "cost_usd": "sum", "slowest": "max", "latency": "quantiles", "traces": "distinct"}
KEPT_KEYS = ["hour", "task", "model"]


def hourly(priced):
    """The kept summary of priced calls: per hour, task and model."""
    of = {"calls": F.col("call_id"), "tokens_in": F.col("tokens_in"), "tokens_out": F.col("tokens_out"), "cost_usd": F.col("cost_usd").cast("decimal(28,12)"),
          "slowest": F.col("latency_ms"), "latency": F.col("latency_ms"), "traces": F.col("trace_id")}
    return Q.summarise(priced.withColumn("hour", Q.time_slot("ts")), KEPT_KEYS, {n: (kind, of[n]) for n, kind in KEPT.items()})


def kept_ledger(spark, folder):
    """The ledger as a kept table of a stream; its exact measures."""
    home = work_folder(spark, "kept")
    table = KeptRollup(spark, home, hourly, KEPT_KEYS, KEPT)
    table.writer(L.price_calls(_events(spark, folder, CALLS)), home + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return table.read().select(F.unix_seconds("hour").alias("hour"), "task", "model", "calls", "tokens_in", "tokens_out", F.col("cost_usd").cast("double").alias("cost_usd"), "slowest")


QUANTILES = (0.5, 0.95)


def sketch_quantiles(spark, folder):
    """Quantiles of a task's and model's latencies merged from hourly sketches, and whether the rank each has among
    all rows is within the stated bound."""
    priced = L.price_calls(A.bind(spark, folder, CALLS).withColumn("ts", F.col("ts").cast("timestamp")))
    whole = Q.merged(cut_lineage(hourly(priced)), ["task", "model"], {"latency": "quantiles", "calls": "count"})
    points = whole.select("task", "model", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), Q.quantile(F.col("latency"), q).alias("at")) for q in QUANTILES])).alias("p")).select("task", "model", "p.*")
    ranked = priced.select("task", "model", "latency_ms").join(points, ["task", "model"]).groupBy("task", "model", "q").agg(
        F.avg((F.col("latency_ms") <= F.col("at")).cast("double")).alias("upto"), F.avg((F.col("latency_ms") < F.col("at")).cast("double")).alias("below"), F.count(F.lit(1)).alias("calls"))
    bound = F.lit(Q.rank_error()) + 1 / F.col("calls")
    return ranked.select("task", "model", "q", "calls", ((F.col("below") - bound <= F.col("q")) & (F.col("upto") + bound >= F.col("q"))).alias("within"))


def sketch_distinct(spark, folder):
    """Distinct traces per task merged from hourly sketches, and whether they are within the stated bound."""
    priced = L.price_calls(A.bind(spark, folder, CALLS).withColumn("ts", F.col("ts").cast("timestamp")))
    whole = Q.merged(cut_lineage(hourly(priced)), ["task"], {"traces": "distinct"}).select("task", Q.distinct(F.col("traces")).alias("about"))
    exact = priced.groupBy("task").agg(F.countDistinct("trace_id").alias("traces"))
    return exact.join(whole, "task").select("task", "traces", (F.abs(F.col("about") - F.col("traces")) <= F.greatest(F.lit(1.0), F.col("traces") * Q.distinct_error())).alias("within"))


# The whole table is there at once, so the watermark need not wait for stragglers; the closing empty batch
# releases every row.
NOW = "0 seconds"
# And its rows are released together: those of a day lie together where a key has many.
SLOT = "1 day"
# Longer than the tables reach: what is remembered this long is remembered over the whole table.
WHOLE = "60 days"


QUERIES = {
    "live_ledger": live_ledger,
    "live_ledger_sliding": lambda s, d: run_available(live.live_ledger(L.price_calls(_events(s, d, CALLS)), "2 minutes", "1 minute"), "update", ["window_start", "window_end", "task", "model"]).select(
        F.unix_seconds("window_start").alias("window_start"), "task", "model", "calls", "tokens_in"),
    "live_budget_alerts": lambda s, d: run_available(live.live_budget_guard(L.price_calls(_events(s, d, CALLS)), NOW, slot=SLOT), closing=True),
    "live_stuck_loops": lambda s, d: run_available(live.live_stuck_loops(_steps(s, d), NOW, slot=SLOT), closing=True),
    "live_breaker": lambda s, d: run_available(live.live_breaker(_events(s, d, repos.BREAKER), late=NOW, slot=SLOT), closing=True),
    "live_stage_pairs": live_stages,
    "stage_pairs": stage_pairs,
    "live_reuse": lambda s, d: run_available(live.live_reuse(_events(s, d, repos.REUSE), 43200, NOW, slot=SLOT), closing=True),
    "live_stage_join": live_stage_join,
    "live_reuse_cheap": lambda s, d: run_available(live.live_reuse_cheap(_events(s, d, repos.REUSE), WHOLE)).select("cache_key"),
    "kept_ledger": kept_ledger,
    "sketch_quantiles": sketch_quantiles,
    "sketch_distinct": sketch_distinct,
    "live_guarded_runs": _finished,
    "live_secret_scan": lambda s, d: run_available(live.live_secret_scan(_stream(s, d, "documents", repos.FILES), extra=True)).select(
        "repo", "path", "line", "severity", "description", "match_preview"),
}

_PAIRS = f"""WITH p AS (SELECT *, regexp_replace(event, '_(start|done|failed|skipped)$', '') AS stage, regexp_extract(event, '_(done|failed|skipped)$', 1) AS outcome FROM ({A.duck(PROGRESS)}) x),
  n AS (SELECT trace_id, stage, outcome, ts AS started, lead(ts) OVER w AS nxt, lead(outcome) OVER w AS nxt_outcome FROM p WINDOW w AS (PARTITION BY trace_id, stage ORDER BY ts, (outcome <> '')::INT)),
  j AS (SELECT trace_id, stage, started, CASE WHEN nxt_outcome <> '' AND nxt <= started + INTERVAL 24 HOUR THEN nxt END AS ended, nxt, nxt_outcome FROM n WHERE outcome = '') """
ORACLE = {
    "live_ledger": ledger._PRICED + """SELECT epoch(date_trunc('minute', ts))::BIGINT AS window_start, task, model, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out,
      sum(cost_usd)::DOUBLE AS cost_usd, sum(latency_ms::DECIMAL(24,6))::DOUBLE AS latency_ms FROM priced GROUP BY ALL""",
    "live_budget_alerts": f"SELECT trace_id, call_id, task, cap_usd, cost_usd FROM ({ledger.ORACLE['budget_breaches']}) b",
    "live_stuck_loops": f"""SELECT trace_id, step_number, action, url FROM (SELECT trace_id, step_number, action_type || ': ' || target AS action, url, lag(action_type || ': ' || target) OVER w AS a1, lag(action_type || ': ' || target, 2) OVER w AS a2,
      lag(url) OVER w AS u1, lag(url, 2) OVER w AS u2 FROM ({A.duck(web.STEPS.replace("SELECT ", "SELECT ts, ", 1))}) s WINDOW w AS (PARTITION BY trace_id ORDER BY ts, step_number)) x WHERE action = a1 AND action = a2 AND url = u1 AND url = u2""",
    "live_breaker": repos.ORACLE["breaker_timeline"],
    "live_ledger_sliding": ledger._PRICED + """SELECT epoch(date_trunc('minute', ts) - INTERVAL (k) MINUTE)::BIGINT AS window_start, task, model, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in FROM priced, (SELECT unnest([0, 1]) AS k) s GROUP BY ALL""",
    # A start is out once the stream knows its next event or its timeout has passed.
    "live_stage_pairs": _PAIRS + f"""SELECT trace_id, stage, epoch_us(started) AS started, coalesce(epoch_us(ended), 0) AS ended, CASE WHEN ended IS NULL THEN '' ELSE nxt_outcome END AS outcome, ended IS NULL AS timed_out FROM j
      WHERE nxt IS NOT NULL OR epoch_us(started) // 1000 + 86400000 < (SELECT max(epoch_us(ts)) // 1000 FROM ({A.duck(PROGRESS)}) x)""",
    # A start is out once the watermark, the latest time of all, is a timeout behind it.
    "live_stage_join": _PAIRS + f"""SELECT trace_id, stage, epoch_us(started) AS started, coalesce(epoch_us(ended), 0) AS ended, CASE WHEN ended IS NULL THEN '' ELSE nxt_outcome END AS outcome, ended IS NULL AS timed_out FROM j
      WHERE epoch_us(started) // 1000 + 86400000 < (SELECT max(epoch_us(ts)) // 1000 FROM ({A.duck(PROGRESS)}) x)""",
    "live_reuse_cheap": f"SELECT DISTINCT 'cicd:v1:' || repo || ':main:' || skill || ':' || substr(sha, 1, 12) || ':' || dry_run AS cache_key FROM ({A.duck(repos.REUSE)}) x",
    "stage_pairs": _PAIRS + "SELECT trace_id, stage, epoch_us(started) AS started, coalesce(epoch_us(ended), 0) AS ended, ended IS NULL AS timed_out FROM j",
    "kept_ledger": ledger._PRICED + """SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour, task, model, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, sum(cost_usd)::DOUBLE AS cost_usd,
      max(latency_ms) AS slowest FROM priced GROUP BY ALL""",
    "sketch_quantiles": ledger._PRICED + "SELECT task, model, unnest([0.5::DOUBLE, 0.95::DOUBLE]) AS q, count(*) AS calls, true AS within FROM priced GROUP BY task, model",
    "sketch_distinct": ledger._PRICED + "SELECT task, count(DISTINCT trace_id) AS traces, true AS within FROM priced GROUP BY task",
    "live_guarded_runs": web.ORACLE["guarded_runs"],
    "live_reuse": repos.ORACLE["result_reuse"],
    "live_secret_scan": repos.ORACLE["secret_findings"],
}
