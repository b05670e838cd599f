"""Ledger, budgets, ordered helpers (also with one dominant key), metrics, errors."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions.ordered import pick_ranks, previous_rows, running_sums, time_chunk
from paperloom.operators import errors as X
from paperloom.operators import ledger as L
from paperloom.operators import scores as S

T0 = dt.datetime(2024, 1, 1)
CALLS = "call_id bigint, trace_id string, task string, operation string, model string, tokens_in bigint, tokens_out bigint, latency_ms double, ts timestamp, status int"


def calls(spark, rows):
    return spark.createDataFrame([(i, t, task, "op", m, a, b, 10.0, T0 + dt.timedelta(seconds=s), st) for i, (t, task, m, a, b, s, st) in enumerate(rows)], CALLS)


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows belong to one key."""
    rng = random.Random(1)
    return [("hot" if rng.random() < 0.33 else f"k{rng.randrange(20)}", rng.randrange(50_000), i, rng.randrange(100)) for i in range(3000)]


def test_running_sums_match_a_plain_scan(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, at int, id int, v int")
    got = {r["id"]: r["s"] for r in running_sums(df, ["k"], ["at", "id"], F.floor(F.col("at") / 997), {"s": F.col("v")}).collect()}
    want, total = {}, {}
    for k, at, i, v in sorted(skewed, key=lambda r: (r[1], r[2])):
        total[k] = total.get(k, 0) + v
        want[i] = total[k]
    assert got == want


def test_previous_rows_cross_chunks(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, at int, id int, v int")
    got = {r["id"]: [x["id"] for x in r["previous"]] for r in previous_rows(df, ["k"], ["at", "id"], F.floor(F.col("at") / 97), ["id"], 3).collect()}
    want, seen = {}, {}
    for k, at, i, v in sorted(skewed, key=lambda r: (r[1], r[2])):
        want[i] = seen.get(k, [])[-3:]
        seen.setdefault(k, []).append(i)
    assert got == want


def test_pick_ranks_is_exact(spark, skewed):
    df = spark.createDataFrame([(k, float(v)) for k, _, _, v in skewed], "k string, v double")
    got = {r["k"]: (r["a"], r["b"]) for r in pick_ranks(df, ["k"], "v", {"a": F.floor(F.col("n") * 0.5), "b": F.col("n") - 1}).collect()}
    by = {}
    for k, _, _, v in skewed:
        by.setdefault(k, []).append(float(v))
    assert got == {k: (sorted(v)[len(v) // 2], max(v)) for k, v in by.items()}


def test_prices_and_summary(spark):
    df = L.price_calls(calls(spark, [("a", "task3_sec", "openai/gpt-5.5", 1000, 1000, 0, 200), ("a", "task3_sec", "who/knows", 1000, 0, 1, 200)]))
    assert [float(r[0]) for r in df.orderBy("call_id").select("cost_usd").collect()] == [0.02, 0.003]
    rows = {(r["level"], r["key"]): r for r in L.ledger_summary(df).collect()}
    assert rows[("total", "")]["calls"] == 2 and rows[("total", "")]["cost_usd"] == 0.023
    assert rows[("model", "who/knows")]["cost_usd"] == 0.003
    empty = L.ledger_summary(df.filter("false")).collect()
    assert [(r["level"], r["calls"], r["cost_usd"], r["avg_latency_ms"]) for r in empty] == [("total", 0, 0.0, 0.0)]


def test_budget_caps(spark):
    rows = [("a", "task1_cicd", "openai/gpt-5.5", 60_000, 0, i, 200) for i in range(3)] + [("b", "other", "openai/gpt-5.5", 100_000, 0, 9, 200)]
    priced = L.price_calls(calls(spark, rows))
    hit = L.budget_breaches(priced).collect()
    assert [(r["trace_id"], r["call_id"], r["cost_usd"], r["overspend_usd"]) for r in hit] == [("a", 1, 0.6, 0.3)]
    assert [r["call_id"] for r in L.budget_breaches(priced, inclusive=True).orderBy("trace_id").collect()] == [0, 3]
    caps = spark.createDataFrame([("a", 0.0), ("b", 0.1)], "trace_id string, cap_usd double")
    assert [r["trace_id"] for r in L.budget_breaches(priced, caps).collect()] == ["b"]


def test_only_success_resets_a_rate_limit_run(spark):
    status = [429, 500, 429, 429, 200, 429, 429, 200, 429]
    runs = L.rate_limit_runs(calls(spark, [("t", "x", "m", 1, 1, i * 4000, s) for i, s in enumerate(status)])).collect()
    assert [(r["run_length"], r["first_call"], r["last_call"]) for r in runs] == [(3, 0, 3)]


def test_two_percentile_rules(spark):
    rows = [("s", True, float(i), 0.0, 0.5, None, False, 0, 0.5, 0) for i in range(1, 21)]
    df = spark.createDataFrame(rows, "suite string, passed boolean, latency_ms double, cost_usd double, confidence double, failure_type string, cache_hit boolean, llm_calls int, avg_confidence double, self_corrections int")
    m, s = S.eval_metrics(df, ["suite"]).first(), S.suite_summary(df).first()
    assert (m["p50_latency_ms"], m["p95_latency_ms"], s["p95_latency_ms"]) == (10.0, 19.0, 20.0)
    assert set(S.eval_metrics(df, ["suite"], approximate=True).columns) == set(S.eval_metrics(df, ["suite"]).columns)


@pytest.mark.parametrize("raw,category,code,retry", [
    ("Error code: 401 - Incorrect API key provided", "invalid_key", 401, False), ("429 Too Many Requests", "rate_limit", 429, True),
    ("maximum context length exceeded", "context_length", None, False), ("read timed out", "timeout", None, True), ("HTTP 503 from upstream", "server_error", 503, True),
    ("what (200) is this", "unknown", None, True), ("status_code: 402 insufficient credit", "insufficient_credit", 402, False)])
def test_error_triage(spark, raw, category, code, retry):
    r = X.triage_errors(spark.createDataFrame([(1, "s", "p", "m", raw)], "id int, stage string, provider string, model string, raw string")).first()
    assert (r["category"], r["status_code"], r["retryable"]) == (category, code, retry)


@pytest.mark.parametrize("mid,hint,provider,error", [
    ("qwen/qwen3", None, "nvidia", None), ("mistralai/mistral-small-3.1", None, "nvidia", None), ("mistralai/large", None, "openrouter", None),
    ("x/y", "NVIDIA ", "nvidia", None), ("x/y", "azure", None, "bad_provider_hint"), ("x/y", None, None, "ambiguous_provider"), ("plain", None, None, "bad_model_id_shape"),
    ("", None, None, "missing_model_id"), ("a b/c", None, None, "bad_model_id_shape"), (" openai/gpt-5.5 ", "", "openrouter", None)])
def test_model_resolution(spark, mid, hint, provider, error):
    r = X.resolve_models(spark.createDataFrame([(1, mid, hint)], "id int, model_id string, provider_hint string")).first()
    assert (r["provider"], r["error_category"]) == (provider, error)


def test_run_checks(spark):
    df = spark.createDataFrame([(1, "a", "hello  world", 4, 15, "xxx hello world yyy"), (2, None, "hello", 5, 3, "hello")],
                               "id int, f string, content string, range_start int, range_end int, source_text string")
    got = {(r["id"], r["name"]): r["passed"] for r in S.run_checks(df, required=["f"], non_empty=["content"]).collect()}
    assert got == {(1, "json_schema"): True, (1, "non_empty_content"): True, (1, "char_range"): True,
                   (2, "json_schema"): False, (2, "non_empty_content"): True, (2, "char_range"): False}


def test_a_key_with_most_rows_in_one_hour(spark):
    """Chunks within the hour give the sums and neighbours of a plain window."""
    from paperloom.functions.ordered import previous_rows, running_sums, time_chunk

    rows = [(i, "hot" if i % 10 else f"k{i % 3}", dt.datetime(2024, 1, 1 + i // 900) + dt.timedelta(seconds=(i * 7) % 3600, microseconds=i % 5), i % 13) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp, v long")
    for fine in (None, time_chunk("ts", 1), time_chunk("ts", 60)):
        sums = running_sums(df, ["key"], ["ts", "id"], time_chunk("ts"), {"s": F.col("v"), "n": F.lit(1)}, fine)
        got = {r["id"]: (r["s"], r["n"]) for r in sums.collect()}
        near = {r["id"]: [x["id"] for x in r["previous"]] for r in previous_rows(df, ["key"], ["ts", "id"], time_chunk("ts"), ["id"], 3, fine).collect()}
        want, before, history = {}, {}, {}
        for i, k, ts, v in sorted(rows, key=lambda r: (r[2], r[0])):
            s, n = want.get(("last", k), (0, 0))
            want[i] = want["last", k] = (s + v, n + 1)
            before[i] = history.get(k, [])[-3:]
            history[k] = [*history.get(k, []), i]
        assert got == {k: v for k, v in want.items() if not isinstance(k, tuple)} and near == before
