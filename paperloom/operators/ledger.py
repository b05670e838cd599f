"""Call ledger: pricing, summaries, per-request cost, budgets, rate-limit runs, token estimates.

Money is exact decimal arithmetic, so a sum does not depend on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions.ordered import running_sums, time_chunk

MONEY = "decimal(34,12)"


def model_rates(spark: SparkSession) -> DataFrame:
    """Rates per 1000 tokens, as a table (a fixed list of seven models)."""
    return spark.createDataFrame([(m, i, o) for m, i, o in fixed.MODEL_RATES], "model string, input string, output string") \
        .select("model", F.col("input").cast("decimal(15,9)").alias("input"), F.col("output").cast("decimal(15,9)").alias("output"))


def _per_token(rate: Column) -> Column:
    return (rate.cast("decimal(15,9)") * F.lit("0.001").cast("decimal(3,3)")).cast("decimal(18,12)")


def cost_of(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    big = "decimal(15,0)"
    return (tokens_in.cast(big) * _per_token(rate_in) + tokens_out.cast(big) * _per_token(rate_out)).cast(MONEY)


def price_calls(calls: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Adds `cost_usd`; unknown models get the default rate. The fixed list is matched in place; a
    caller's own rate table is joined, and Spark broadcasts it only if it is small."""
    default_in, default_out = (F.lit(r).cast("decimal(15,9)") for r in fixed.DEFAULT_RATE)
    if rates is None:
        rate_in, rate_out = (
            F.coalesce(*[F.when(F.col("model") == r[0], F.lit(r[k]).cast("decimal(15,9)")) for r in fixed.MODEL_RATES], d)
            for k, d in ((1, default_in), (2, default_out)))
        return calls.withColumn("cost_usd", cost_of(F.col("tokens_in"), F.col("tokens_out"), rate_in, rate_out))
    named = rates.select("model", F.col("input").alias("_in"), F.col("output").alias("_out"))
    return calls.join(named, "model", "left").withColumn("cost_usd", cost_of(
        F.col("tokens_in"), F.col("tokens_out"), F.coalesce("_in", default_in), F.coalesce("_out", default_out))).drop("_in", "_out")


def exact(c: str) -> Column:
    """A float column as a decimal, for sums that do not depend on row order."""
    return F.col(c).cast("decimal(24,6)")


def ledger_summary(priced: DataFrame) -> DataFrame:
    """Totals, by task and by model in one pass. An empty ledger still has a total row of zeros."""
    spark = priced.sparkSession
    rows = priced.select("task", "model", "tokens_in", "tokens_out", "cost_usd", exact("latency_ms").alias("lat"), F.lit(1).alias("w"))
    zero = spark.range(1).select(
        F.lit(None).cast("string").alias("task"), F.lit(None).cast("string").alias("model"), F.lit(0).cast("bigint").alias("tokens_in"),
        F.lit(0).cast("bigint").alias("tokens_out"), F.lit(0).cast(MONEY).alias("cost_usd"), F.lit(0).cast("decimal(24,6)").alias("lat"),
        F.lit(0).alias("w"))
    t, m = F.col("task"), F.col("model")
    grouped = rows.unionByName(zero).groupingSets([[], [t], [m]], t, m).agg(
        F.grouping_id().alias("g"), F.sum("w").alias("calls"), F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"), F.sum("cost_usd").alias("cost"), F.sum("lat").alias("lat"))
    level = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "task").otherwise("model")
    return grouped.filter((F.col("g") == 3) | (F.col("calls") > 0)).select(
        level.alias("level"), F.coalesce("task", "model", F.lit("")).alias("key"), "calls", "tokens_in", "tokens_out",
        F.round("cost", 6).cast("double").alias("cost_usd"),
        (F.col("lat").cast("double") / F.greatest("calls", F.lit(1))).alias("avg_latency_ms"))


def request_costs(priced: DataFrame) -> DataFrame:
    """Per trace: calls, tokens, cost, latency, the models used. Partial sums before the shuffle."""
    return priced.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.round(F.sum("cost_usd"), 6).cast("double").alias("cost_usd"),
        F.sum(exact("latency_ms")).cast("double").alias("latency_ms"),
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models_used"))


def request_operations(calls: DataFrame, order: tuple[str, ...] = ("ts", "call_id"), chunk_seconds: int = 3600) -> DataFrame:
    """Operations of a trace in order, one row each (a trace may have any number of calls)."""
    rows = calls.select("trace_id", "operation", *order)
    return running_sums(rows, ["trace_id"], list(order), time_chunk(order[0], chunk_seconds), {"seq": F.lit(1)}, time_chunk(order[0], 1))


def cap_of(task: Column, explicit: Column | None = None) -> Column:
    by_task = F.coalesce(*[F.when(task == t, F.lit(c)) for t, c in fixed.TASK_CAPS], F.lit(fixed.DEFAULT_CAP))
    return by_task if explicit is None else F.coalesce(explicit, by_task)


def running_costs(priced: DataFrame, order: tuple[str, ...] = ("ts", "call_id"), chunk_seconds: int = 3600) -> DataFrame:
    return running_sums(priced, ["trace_id"], list(order), time_chunk(order[0], chunk_seconds), {"running_cost": F.col("cost_usd")}, time_chunk(order[0], 1))


def budget_breaches(priced: DataFrame, caps: DataFrame | None = None, inclusive: bool = False,
                    order: tuple[str, ...] = ("ts", "call_id"), chunk_seconds: int = 3600) -> DataFrame:
    """First call of each trace whose running cost passes the cap. A cap of zero or less disables it.

    `caps(trace_id, cap_usd)` overrides the task default. `inclusive` also counts reaching the cap.
    """
    explicit = None
    if caps is not None:
        priced = priced.join(caps.select("trace_id", F.col("cap_usd").alias("_cap")), "trace_id", "left")
        explicit = F.col("_cap")
    rows = running_costs(priced.withColumn("cap_usd", cap_of(F.col("task"), explicit).cast("decimal(12,6)")), order, chunk_seconds)
    over = F.col("running_cost") >= F.col("cap_usd") if inclusive else F.col("running_cost") > F.col("cap_usd")
    first = F.struct(*order)
    return rows.filter((F.col("cap_usd") > 0) & over).groupBy("trace_id").agg(
        F.min_by(F.struct("call_id", "task", "cap_usd", "running_cost"), first).alias("b")).select(
        "trace_id", F.col("b.call_id").alias("call_id"), F.col("b.task").alias("task"), F.col("b.cap_usd").cast("double").alias("cap_usd"),
        F.round("b.running_cost", 6).cast("double").alias("cost_usd"),
        F.round(F.col("b.running_cost") - F.col("b.cap_usd"), 6).cast("double").alias("overspend_usd"))


def rate_limit_runs(calls: DataFrame, min_run: int = 3, order: tuple[str, ...] = ("ts", "call_id"),
                    chunk_seconds: int = 3600) -> DataFrame:
    """Runs of rate-limited calls (status 429) per trace; only a success ends a run."""
    rows = running_sums(calls.select("trace_id", "status", *order), ["trace_id"], list(order), time_chunk(order[0], chunk_seconds),
                        {"successes": (F.col("status") < 400).cast("int")}, time_chunk(order[0], 1))
    limited = F.col("status") == 429
    return rows.filter(limited).groupBy("trace_id", "successes").agg(
        F.count(F.lit(1)).alias("run_length"), F.min_by("call_id", F.struct(*order)).alias("first_call"),
        F.max_by("call_id", F.struct(*order)).alias("last_call")).filter(F.col("run_length") >= min_run).drop("successes")


def estimate_tokens(messages: DataFrame) -> DataFrame:
    """Tokens as characters divided by four, per task and operation."""
    return messages.groupBy("task", "operation").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(F.floor(F.length("prompt") / 4)).alias("tokens_in"), F.sum(F.floor(F.length("response") / 4)).alias("tokens_out"))
