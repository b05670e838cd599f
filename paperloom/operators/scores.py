"""Evaluation: output checks, case scoring for the three suites, metrics, comparisons, matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions.ordered import pick_ranks
from paperloom.functions.text import collapse, left, slice_text, strip, text_array


def _check(name: Column | str, passed: Column, expected: Column | str = "", actual: Column | None = None) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), lit(expected).cast("string").alias("expected"),
                    (actual if actual is not None else F.lit("")).cast("string").alias("actual"))


def run_checks(df: DataFrame, required: list[str] = (), non_empty: list[str] = (), extra: dict[str, Column] | None = None) -> DataFrame:
    """Long table of checks per row of `df(id, ...)`. `required` fields must be non-null, `non_empty`
    strings non-empty; `char_range`/`content`/`source_text` columns, when present, must agree; `extra`
    adds a caller's own boolean columns."""
    checks = []
    if required:
        missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull())
        checks.append(_check("json_schema", F.size(missing) == 0, "all required fields", F.array_join(missing, ",")))
    checks += [_check(f"non_empty_{c}", F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) > 0, "non-empty") for c in non_empty]
    if {"range_start", "range_end", "content", "source_text"} <= set(df.columns):
        lo, hi = F.col("range_start"), F.col("range_end")
        bad = (lo < 0) | (hi > F.length("source_text")) | (lo >= hi)
        want, got = collapse("content"), collapse(slice_text(F.col("source_text"), lo, hi))
        ok = ~bad & (F.contains(got, want) | F.contains(want, got))
        checks.append(_check("char_range", ok, "content at range"))
    checks += [_check(n, c) for n, c in (extra or {}).items()]
    return df.select("id", F.explode(F.array(*checks)).alias("c")).select("id", "c.name", "c.passed", "c.expected", "c.actual")


def check_coverage(items: DataFrame, expected: list[str], key: str = "item_number") -> DataFrame:
    """Per output: which expected items are absent."""
    per = items.groupBy("id").agg(F.collect_set(key).alias("have"))
    missing = F.array_except(text_array(expected), F.col("have"))
    return per.select("id", F.lit("coverage").alias("name"), (F.size(missing) == 0).alias("passed"),
                      F.array_join(missing, ",").alias("missing"))


# --- report extraction --------------------------------------------------------------------------------

def filing_checks(cases: DataFrame, items: DataFrame, reports: DataFrame) -> DataFrame:
    """cases(case_id, min_items, required_items array, expected_status map) x items -> checks.

    Items are pre-aggregated to one short row per case before the joins. Of repeated items the first
    that was found counts, so a duplicate is scored like its first row.
    """
    real = (F.col("status") != "not_found") & ((strip(F.coalesce("content_text", F.lit(""))) != "") | (F.col("status") != "extracted"))
    once = items.groupBy("case_id", "item_number").agg(
        F.count_if(real).alias("n"), F.min_by("status", F.struct((F.col("status") == "not_found").cast("int"), F.coalesce("range_start", F.lit(0)), "status")).alias("status")) \
        if "range_start" in items.columns else items.groupBy("case_id", "item_number").agg(
        F.count_if(real).alias("n"), F.min_by("status", F.struct((F.col("status") == "not_found").cast("int"), "status")).alias("status"))
    per = once.groupBy("case_id").agg(
        F.sum("n").alias("extracted"), F.map_from_entries(F.collect_list(F.struct("item_number", "status"))).alias("by_item"))
    rows = cases.join(per, "case_id", "left").join(reports.select("case_id", "overall_valid"), "case_id", "left")
    status = lambda n: F.element_at(F.col("by_item"), n)
    checks = F.concat(
        F.array(_check("min_items_extracted", F.coalesce("extracted", F.lit(0)) >= F.col("min_items"), F.col("min_items"),
                       F.coalesce("extracted", F.lit(0)))),
        F.transform("required_items", lambda n: _check(
            F.concat(F.lit("required_item_"), n), status(n).isNotNull() & (status(n) != "not_found"), "present",
            F.coalesce(status(n), F.lit("missing")))),
        F.transform(F.map_entries("expected_status"), lambda e: _check(
            F.concat(F.lit("status_item_"), e["key"]), status(e["key"]) == e["value"], e["value"],
            F.coalesce(status(e["key"]), F.lit("missing")))),
        F.when(F.col("overall_valid").isNotNull(), F.array(_check("pipeline_validation", F.col("overall_valid"), "true",
                                                                  F.col("overall_valid")))).otherwise(F.array().cast(
            "array<struct<name:string,passed:boolean,expected:string,actual:string>>")))
    return rows.select("case_id", F.explode(checks).alias("c")).select("case_id", "c.name", "c.passed", "c.expected", "c.actual")


def score_filings(cases: DataFrame, items: DataFrame, reports: DataFrame) -> DataFrame:
    """One score per case: verdict, counts by status, missing items, mean confidence, failure type."""
    checks = filing_checks(cases, items, reports).groupBy("case_id").agg(
        F.bool_and("passed").alias("passed"), F.count(F.lit(1)).alias("checks"))
    real = (F.col("status") != "not_found") & ((strip(F.coalesce("content_text", F.lit(""))) != "") | (F.col("status") != "extracted"))
    conf = F.when(F.col("confidence") > 0, F.col("confidence").cast("decimal(12,6)"))
    per = items.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("items_returned"), F.count_if(real).alias("items_extracted"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in fixed.STATUSES],
        F.collect_set(F.when(F.col("status") == "not_found", F.col("item_number"))).alias("absent"),
        F.round(F.coalesce(F.sum(conf).cast("double") / F.count(conf), F.lit(0.0)), 3).alias("avg_confidence"))
    allowed = cases.select("case_id", F.coalesce("allow_missing", F.array().cast("array<string>")).alias("allow_missing"))
    missing = F.array_sort(F.array_except("absent", "allow_missing"))
    return checks.join(per, "case_id", "left").join(allowed, "case_id").withColumn(
        "missing_items", F.array_join(missing, ",")).withColumn(
        "failure_type", F.when(F.col("passed"), None).when(F.coalesce("items_extracted", F.lit(0)) == 0, "parsing_error")
        .when(F.size(missing) > 0, "missing_section").otherwise("parsing_error")).drop("absent", "allow_missing")


# --- agent runs -----------------------------------------------------------------------------------------

_CHECK_TYPE = "array<struct<name:string,passed:boolean,expected:string,actual:string>>"


def run_score_checks(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """Universal checks on every run, plus the case's own expectations (null = not stated)."""
    rows = runs.join(cases, "case_id", "left")
    answer = F.coalesce("final_answer", F.lit(""))
    low = F.lower(answer)
    least = F.greatest(F.lit(0), F.coalesce("min_steps", F.when(F.col("fast_path_hit"), 0).otherwise(1)))
    most = F.coalesce(F.when(F.col("max_steps") > 0, F.col("max_steps")), F.lit(20))
    none = F.array().cast(_CHECK_TYPE)
    listed = lambda c, fn: F.coalesce(F.transform(c, fn), none)
    present = lambda s: F.contains(low, F.lower(s))
    checks = F.concat(
        F.array(
            _check("no_crash", F.col("status") != "failed", "not failed", F.col("status")),
            _check("took_steps", F.col("total_steps") >= least, F.concat(F.lit(">= "), least.cast("string")), F.col("total_steps")),
            _check("reasonable_steps", F.col("total_steps") <= most, F.concat(F.lit("<= "), most.cast("string")), F.col("total_steps")),
            _check("has_answer", strip(answer) != "", "non-empty answer")),
        F.when(F.col("expected_status").isNotNull(), F.array(_check(
            "expected_status", F.col("status") == F.col("expected_status"), F.col("expected_status"), F.col("status")))).otherwise(none),
        F.when(F.col("allowed_statuses").isNotNull(), F.array(_check(
            "status_in_allowed", F.array_contains("allowed_statuses", F.col("status")),
            F.array_join(F.array_sort("allowed_statuses"), ","), F.col("status")))).otherwise(none),
        listed("must_contain", lambda s: _check(F.concat(F.lit("must_contain["), s, F.lit("]")), present(s), s)),
        listed("must_not_contain", lambda s: _check(F.concat(F.lit("must_not_contain["), s, F.lit("]")), ~present(s), s)),
        listed("failure_modes_expected", lambda m: _check(
            F.concat(F.lit("failure_mode["), m, F.lit("]")),
            F.exists(F.coalesce("failure_modes", F.array().cast("array<string>")), lambda x: F.contains(x, m)), m)))
    return rows.select("case_id", F.explode(checks).alias("c")).select("case_id", "c.name", "c.passed", "c.expected", "c.actual")


def score_from_checks(checks: DataFrame) -> DataFrame:
    return checks.groupBy("case_id").agg(F.bool_and("passed").alias("passed"), F.count(F.lit(1)).alias("checks"),
                                         F.count_if(~F.col("passed")).alias("failed_checks"))


# --- skill runs ------------------------------------------------------------------------------------------

def skill_score_checks(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Edge cases must fail with an error; the rest need a result, the right skill, no tag in dry runs
    and a summary."""
    rows = results.join(cases, "case_id")
    want = F.regexp_replace(F.lower(F.coalesce("skill_name", F.lit(""))), "_", "-")
    got = F.coalesce("skill", F.lit(""))
    edge = F.col("difficulty") == "edge_case"
    error = F.coalesce("error", F.lit(""))
    none = F.array().cast(_CHECK_TYPE)
    normal = F.concat(
        F.array(
            _check("has_result", (F.col("status") == "success") & F.coalesce("has_payload", F.lit(False)), "success with result", F.col("status")),
            _check("correct_skill", (got == want) | F.contains(got, want) | F.contains(want, got), want, got)),
        F.when(F.contains(want, F.lit("build")) | F.contains(want, F.lit("release")), F.array(_check(
            "dry_run_no_tag", ~F.coalesce("dry_run", F.lit(True)) | ~F.coalesce("tag_created", F.lit(False))))).otherwise(none),
        F.array(_check("has_summary", F.length(F.coalesce("summary", F.lit(""))) > 10, "summary")))
    checks = F.concat(
        F.array(_check("no_crash", F.col("status").isNotNull(), "has status", F.col("status"))),
        F.when(edge, F.array(_check("error_case_detected", (F.col("status") == "failed") & (error != ""), "failed with error"))).otherwise(normal))
    return rows.select("case_id", F.explode(checks).alias("c")).select("case_id", "c.name", "c.passed", "c.expected", "c.actual")


# --- metrics ---------------------------------------------------------------------------------------------

def _mean(c: Column) -> Column:
    d = c.cast("decimal(24,6)")
    return F.sum(d).cast("double") / F.count(d)


def eval_metrics(results: DataFrame, by: list[str], approximate: bool = False) -> DataFrame:
    """Per group: totals, success rate, mean and index-rule p50/p95 latency, cost, mean confidence.

    The percentile index is max(0, floor(n q) - 1) on the sorted latencies. `approximate` takes
    Spark's percentile sketch instead, in the same single aggregation.
    """
    ranks = pick_ranks(results, by, "latency_ms", {
        "p50_latency_ms": F.greatest(F.lit(0), F.floor(F.col("n") * 0.5) - 1),
        "p95_latency_ms": F.greatest(F.lit(0), F.floor(F.col("n") * 0.95) - 1)})
    sketch = [F.percentile_approx("latency_ms", q).alias(n) for n, q in (("p50_latency_ms", 0.5), ("p95_latency_ms", 0.95))]
    base = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_cases"), F.count_if("passed").alias("passed"),
        (F.count_if("passed") / F.count(F.lit(1))).alias("success_rate"), _mean(F.col("latency_ms")).alias("avg_latency_ms"),
        F.sum(F.col("cost_usd").cast("decimal(24,9)")).cast("double").alias("total_cost_usd"),
        _mean(F.col("confidence")).alias("avg_confidence"), *(sketch if approximate else []))
    base = base.withColumn("failed", F.col("total_cases") - F.col("passed"))
    return base if approximate else base.join(ranks, by, "left")


def failure_distribution(results: DataFrame, by: list[str]) -> DataFrame:
    return results.filter(~F.col("passed") & F.col("failure_type").isNotNull()).groupBy(*by, "failure_type").agg(
        F.count(F.lit(1)).alias("cases"))


def suite_summary(scores: DataFrame, skip_zero_latency: bool = False) -> DataFrame:
    """Per suite: success and cache-hit rates, mean and p95 latency (index floor(0.95 n)), costs."""
    latency = F.when(F.col("latency_ms") > 0, F.col("latency_ms")) if skip_zero_latency else F.col("latency_ms")
    rows = scores.withColumn("lat", latency)
    p95 = pick_ranks(rows, ["suite"], "lat", {"p95_latency_ms": F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)})
    cost = F.col("cost_usd").cast("decimal(24,9)")
    conf = F.when(F.col("avg_confidence") > 0, F.col("avg_confidence"))
    base = rows.groupBy("suite").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"),
        F.round(F.count_if("passed") / F.count(F.lit(1)), 3).alias("success_rate"),
        F.round(F.count_if("cache_hit") / F.count(F.lit(1)), 3).alias("cache_hit_rate"),
        F.coalesce(_mean(F.col("lat")), F.lit(0.0)).alias("avg_latency_ms"),
        F.sum(cost).cast("double").alias("total_cost_usd"), (F.sum(cost).cast("double") / F.count(F.lit(1))).alias("avg_cost_usd"),
        F.coalesce(_mean(conf), F.lit(0.0)).alias("avg_confidence"),
        F.count_if(F.col("llm_calls") > 0).alias("model_triggered_cases"),
        _mean(F.col("self_corrections")).alias("avg_self_corrections"))
    return base.join(p95, "suite", "left")


def check_pass_rates(checks: DataFrame) -> DataFrame:
    return checks.groupBy("suite", "name").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg(F.col("passed").cast("int")), 3).alias("pass_rate"))


def compare_variants(rows: DataFrame) -> DataFrame:
    """Per task, model and vision flag: cases, success, cost, latency, calls."""
    return rows.groupBy("task", "model", "use_vision").agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.count_if("ok") / F.count(F.lit(1)), 3).alias("ok_rate"),
        F.sum(F.col("cost_usd").cast("decimal(24,9)")).cast("double").alias("total_cost_usd"),
        _mean(F.col("latency_ms")).alias("avg_latency_ms"), F.sum("llm_calls").alias("llm_calls"))


def variant_deltas(rows: DataFrame) -> DataFrame:
    """On minus off, per task and model; one aggregation over both settings."""
    on, off = F.col("use_vision"), ~F.col("use_vision")
    pick = lambda c, v: F.when(c, v)
    ok = F.col("ok").cast("int")
    return rows.groupBy("task", "model").agg(
        F.count_if(on).alias("cases_on"), F.count_if(off).alias("cases_off"),
        (_mean(pick(on, ok)) - _mean(pick(off, ok))).alias("ok_rate_delta"),
        (_mean(pick(on, F.col("latency_ms"))) - _mean(pick(off, F.col("latency_ms")))).alias("latency_delta_ms"))


def model_matrix(rows: DataFrame, models: list[str], value: str) -> DataFrame:
    """Case by model cross-table of one measure; the model list is given, so no extra pass is needed."""
    return rows.groupBy("case_id").pivot("model", models).agg(F.max(value))
