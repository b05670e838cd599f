"""Recorded agent runs: step verification, failure triage, recovery, stuck loops, answer guard, roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions.ordered import previous_rows, running_sums
from paperloom.functions.text import contains_any, extract, first_contained, left, rlike, strip

STEP_CHUNK = 4096


def _chunk(step: str = "step_number") -> Column:
    return F.floor(F.col(step) / STEP_CHUNK)


def with_before(steps: DataFrame) -> DataFrame:
    """Logs that only keep the page after a step: the page before is the previous step's."""
    rows = previous_rows(steps, ["trace_id"], ["step_number"], _chunk(), ["after"], 1)
    return rows.withColumn("before", F.get("previous", F.lit(0))["after"]).drop("previous")


def verify_steps(steps: DataFrame) -> DataFrame:
    """Did the page change the way the action meant it to? Adds success, confidence and a low flag."""
    b, a = F.col("before"), F.col("after")
    none = F.array().cast("array<string>")
    url = ~b["url"].eqNullSafe(a["url"])
    dom = ~b["text"].eqNullSafe(a["text"]) | ~b["a11y"].eqNullSafe(a["a11y"])
    # Repeated messages count each time, so this is a filter and not a set difference.
    fresh = F.filter(F.coalesce(a["errors"], none), lambda e: ~F.array_contains(F.coalesce(b["errors"], none), e))
    intent = F.lower(F.concat(F.col("action_type"), F.lit(": "), F.coalesce("target", F.lit(""))))
    has = lambda *w: contains_any(intent, list(w))
    rows = steps.filter(b.isNotNull() & a.isNotNull() & (F.coalesce("error", F.lit("")) == "")) \
        .withColumn("url_changed", url).withColumn("dom_changed", dom).withColumn("new_errors", fresh)
    changed = F.col("url_changed") | F.col("dom_changed")
    broken = F.size("new_errors") > 0
    moves, clicks = has("navigate", "go to"), has("click")
    sure = has("fill", "type") | has("extract", "read") | has("scroll") | has("wait")
    success = F.when(broken, False).when(moves, F.col("url_changed")).when(clicks, changed).when(sure, True).otherwise(changed)
    score = (
        F.when(broken, 0.2).when(moves, F.when(F.col("url_changed"), 0.9).otherwise(0.3))
        .when(clicks, F.when(changed, 0.8).otherwise(0.4)).when(has("fill", "type"), 0.7).when(has("extract", "read"), 0.9)
        .when(has("scroll"), 0.8).when(has("wait"), 0.9).otherwise(F.when(changed, 0.6).otherwise(0.4))
    )
    reason = (
        F.when(broken, F.concat(F.lit("New errors detected: "), F.array_join("new_errors", "; ")))
        .when(moves, F.when(F.col("url_changed"), "URL changed").otherwise("URL did not change after navigation"))
        .when(clicks, F.when(changed, "Page state changed after click").otherwise("No observable change after click"))
        .when(has("fill", "type"), "Fill action performed").when(has("extract", "read"), "Extract action — data captured from page state")
        .when(has("scroll"), "Scroll action performed").when(has("wait"), "Wait completed").otherwise("Generic action verification")
    )
    return rows.withColumn("success", success).withColumn("confidence", score).withColumn("reason", reason) \
        .withColumn("low_confidence", F.col("confidence") < 0.4)


# (root cause, retry, confidence) in the order the tests are made.
def triage_failures(steps: DataFrame) -> DataFrame:
    """Root cause of failed steps from the error text and the page it happened on."""
    e = F.lower("error")
    page = F.coalesce("after", "before")
    text = F.lower(F.coalesce(page["text"], F.lit("")))
    url = F.coalesce(page["url"], F.lit(""))
    any_of = lambda *w: contains_any(e, list(w))
    messages = F.coalesce(F.size(page["errors"]), F.lit(0)) > 0
    hidden = any_of("not visible", "not interactable", "hidden")
    tests = [
        (any_of("429", "too many requests", "rate limit", "ratelimit"), "network_error", True, 0.95),
        (any_of("403", "forbidden", "access denied", "blocked"), "captcha_detected", False, 0.9),
        (any_of("ssl", "cert"), "network_error", False, 0.95),
        (any_of("frame was detached", "target closed", "execution context was destroyed"), "page_not_loaded", True, 0.85),
        (any_of("timeout") & any_of("waiting for", "locator"), "element_not_found", True, 0.8),
        (any_of("timeout"), "timeout", True, 0.7),
        (any_of("net::", "err_"), "network_error", True, 0.9),
        (any_of("strict mode violation") | (any_of("resolved to") & any_of("elements")), "selector_ambiguous", True, 0.85),
        (any_of("element is not attached", "element handle is detached"), "page_not_loaded", True, 0.85),
        (hidden & (messages | F.contains(text, F.lit("cookie"))), "unexpected_popup", True, 0.7),
        (hidden, "element_hidden", True, 0.7),
        (any_of("captcha") | F.contains(text, F.lit("captcha")), "captcha_detected", False, 0.9),
        (url.isin("", "about:blank"), "page_not_loaded", True, 0.8),
        (any_of("not found"), "element_not_found", True, 0.6),
    ]
    cause = F.coalesce(*[F.when(t, F.struct(F.lit(c).alias("root_cause"), F.lit(r).alias("should_retry"), F.lit(k).alias("confidence")))
                         for t, c, r, k in tests],
                       F.struct(F.lit("unknown").alias("root_cause"), F.lit(True).alias("should_retry"), F.lit(0.3).alias("confidence")))
    return steps.filter(F.coalesce("error", F.lit("")) != "").withColumn("_d", cause).select("*", "_d.*").drop("_d")


def triage_counts(triaged: DataFrame) -> DataFrame:
    return triaged.groupBy("root_cause").agg(
        F.count(F.lit(1)).alias("failures"), F.count_if("should_retry").alias("retryable"),
        (F.count_if("should_retry") / F.count(F.lit(1))).alias("retryable_share"))


def model_diagnosis(df: DataFrame, column: str = "diagnosis") -> DataFrame:
    """Root cause from a model's free-text diagnosis: the first keyword that occurs."""
    words = [("selector", "selector_changed"), ("not loaded", "page_not_loaded"), ("wrong page", "wrong_page"), ("hidden", "element_hidden"),
             ("not found", "element_not_found"), ("network", "network_error"), ("captcha", "captcha_detected"),
             ("popup", "unexpected_popup"), ("overlay", "unexpected_popup"), ("timeout", "timeout")]
    low, text = F.lower(column), F.col(column)
    cause = F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(c)) for w, c in words], F.lit("unknown"))
    return df.withColumn("root_cause", cause).withColumn("should_retry", F.col("root_cause") != "captcha_detected") \
        .withColumn("confidence", F.lit(0.6)).withColumn(
        "recovery", F.when(strip(F.coalesce(text, F.lit(""))) != "", text).otherwise("Try alternative approach"))


def recovery_target(recovery: Column, fallback: Column) -> Column:
    """The element a recovery text names: [role] 'name', role=x name=y, or a labelled control."""
    text = strip(F.coalesce(recovery, F.lit("")))
    shapes = [r"\[(\w+)\]\s*['\"]([^'\"]+)['\"]",
              r"role[=:]\s*(\w+).{0,15}name[=:]\s*['\"]?([^'\"]+?)['\"]?(?:\s|$|,|\.)"]
    named = [F.when(rlike(text, p), F.concat_ws(" ", extract(text, p, 1), extract(text, p, 2))) for p in shapes]
    control = (r"(?i)(button|link|textbox|searchbox|field|input|tab|menuitem)\s+(?:labelled|named|with text)?\s*['\"]([^'\"]+)['\"]")
    labelled = F.when(rlike(text, control), F.concat_ws(" ", F.lower(extract(text, control, 1)), extract(text, control, 2)))
    brief = F.when(contains_any(F.lower(text), ["click", "select", "fill", "press"]),
                   F.regexp_replace(text, r"(?i)^(click|tap|select|fill|press)\s+(?:the\s+)?", ""))
    return F.when(text == "", fallback).otherwise(F.coalesce(*named, labelled, brief, fallback))


def recovery_actions(triaged: DataFrame) -> DataFrame:
    """The alternative action for each diagnosed failure; none for causes that have no remedy."""
    cause = F.col("root_cause")
    retry = cause.isin("selector_changed", "element_not_found")
    action = F.when(cause == "unexpected_popup", "click").when(cause == "element_hidden", "scroll").when(cause == "page_not_loaded", "wait") \
        .when(retry, F.col("action_type")).when(cause == "wrong_page", "navigate")
    target = F.when(cause == "unexpected_popup", "close button or dismiss popup").when(cause == "element_hidden", F.col("target")) \
        .when(cause == "page_not_loaded", "page to load").when(retry, recovery_target(F.col("recovery"), F.col("target"))) \
        .when(cause == "wrong_page", "Go back to previous page")
    value = F.when(cause == "unexpected_popup", "").when(cause == "element_hidden", "down").when(cause == "page_not_loaded", "3") \
        .when(retry, F.col("value")).when(cause == "wrong_page", "javascript:history.back()")
    return triaged.withColumn("alt_action", action).withColumn("alt_target", target).withColumn("alt_value", value)


def stuck_loops(steps: DataFrame, min_length: int = 3) -> DataFrame:
    """Stretches of the same action on the same URL, three and more in a row, per run."""
    key = F.concat_ws(": ", "action_type", F.coalesce("target", F.lit("")))
    rows = steps.select("trace_id", "step_number", key.alias("action"), F.coalesce(F.col("after.url"), F.lit("")).alias("url"))
    rows = previous_rows(rows, ["trace_id"], ["step_number"], _chunk(), ["action", "url"], 1)
    last = F.get("previous", F.lit(0))
    rows = rows.withColumn("_new", (last.isNull() | (last["action"] != F.col("action")) | (last["url"] != F.col("url"))).cast("int")).drop("previous")
    rows = running_sums(rows, ["trace_id"], ["step_number"], _chunk(), {"_stretch": F.col("_new")})
    return rows.groupBy("trace_id", "_stretch").agg(
        F.count(F.lit(1)).alias("length"), F.min("step_number").alias("first_step"), F.max("step_number").alias("last_step"),
        F.max("action").alias("action"), F.max("url").alias("url")).filter(F.col("length") >= min_length).drop("_stretch")


def guard_runs(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Downgrade runs whose success is not credible: blocked final page, evasive answer, or numbers
    that no observed page shows.

    Page texts are never gathered per run: each step is tested against the few numbers of its run's
    answer, and only the numbers found are aggregated.
    """
    page = F.coalesce("after", "before")
    last = steps.groupBy("trace_id").agg(F.max_by(F.coalesce(page["url"], F.lit("")), "step_number").alias("_last"))
    rows = runs.join(last, "trace_id", "left")
    answer = strip(F.coalesce("final_answer", F.lit("")))
    marker = first_contained(F.lower(F.coalesce("_last", F.lit(""))), fixed.BLOCKED_URL_MARKERS)
    evasive = contains_any(F.lower(answer), fixed.NO_ANSWER_PHRASES)
    rows = rows.withColumn("_marker", F.when(F.col("status").isin("success", "partial"), marker)) \
        .withColumn("_open", (F.col("status") == "success") & F.col("_marker").isNull() & (F.coalesce("final_answer", F.lit("")) != "")) \
        .withColumn("_evasive", F.col("_open") & evasive) \
        .withColumn("_nums", F.when(F.col("_open") & ~F.col("_evasive"), F.regexp_extract_all(answer, F.lit(fixed.NUMBER_TOKEN), 0)))
    wanted = rows.filter(F.size("_nums") > 0).select("trace_id", F.array_distinct("_nums").alias("_want"))
    texts = steps.select("trace_id", F.explode(F.array(F.col("before.text"), F.col("after.text"))).alias("_t")).filter(F.col("_t") != "")
    bare = lambda c: F.replace(c, F.lit(","), F.lit(""))
    seen = texts.join(wanted, "trace_id").select("trace_id", F.explode(F.concat(
        F.array(F.lit("")), F.filter("_want", lambda n: F.contains(F.col("_t"), n) | F.contains(bare(F.col("_t")), bare(n))))).alias("_n")) \
        .groupBy("trace_id").agg(F.collect_set("_n").alias("_seen"))
    rows = rows.join(seen, "trace_id", "left")
    ungrounded = (F.size("_nums") > 0) & F.col("_seen").isNotNull() & (F.size("_seen") == 1)
    mode = F.when(F.col("_marker").isNotNull(), F.concat(F.lit("blocked_url:"), F.col("_marker"))).when(F.col("_evasive"), "hedged_answer") \
        .when(ungrounded, F.concat(F.lit("ungrounded_numbers:["), F.array_join(F.transform("_nums", lambda n: F.concat(
            F.lit("'"), n, F.lit("'"))), ", "), F.lit("]")))
    guarded = F.when(F.col("_marker").isNotNull() | F.col("_evasive"), "not_found").when(ungrounded, "unverified").otherwise(F.col("status"))
    return rows.withColumn("guard_mode", mode).withColumn("guarded_status", guarded).drop(
        "_last", "_marker", "_open", "_evasive", "_nums", "_seen")


def run_summary(steps: DataFrame, costs: DataFrame, runs: DataFrame) -> DataFrame:
    """Steps and ledger to one row per run."""
    page = F.coalesce("after", "before")
    per = steps.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("total_steps"), F.count_if("healer_activated").alias("healer_activations"),
        F.max_by(F.coalesce(page["url"], F.lit("")), "step_number").alias("final_url"),
        F.sum(F.col("duration_ms").cast("decimal(24,6)")).cast("double").alias("total_duration_ms"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("failed_steps"))
    out = runs.join(per, "trace_id", "left").join(
        costs.select("trace_id", F.col("calls").alias("llm_calls"), "cost_usd"), "trace_id", "left")
    # Only a healed step counts as a correction, so the two numbers agree.
    return out.withColumn("self_corrections", F.col("healer_activations")).fillna(
        0, ["total_steps", "healer_activations", "self_corrections", "llm_calls", "cost_usd", "failed_steps", "total_duration_ms"])


def fast_path_share(summary: DataFrame) -> DataFrame:
    """Share of runs served without an agent, and what they would have cost at the agent's mean."""
    hit = F.col("fast_path_hit")
    mean = F.avg(F.when(~hit, F.col("cost_usd")))
    return summary.agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(hit).alias("fast_path_runs"), (F.count_if(hit) / F.count(F.lit(1))).alias("fast_path_share"),
        F.round(F.coalesce(mean, F.lit(0.0)) * F.count_if(hit), 6).alias("cost_saved_usd"))
