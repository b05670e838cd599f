"""Registered queries over the call ledger, error log and evaluation results."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.operators import errors as X
from paperloom.operators import ledger as L
from paperloom.operators import scores as S
from paperloom.plans import adapters as A
from paperloom.plans.filings_oracle import q

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
USER = "'u' || CAST(user_id AS STRING)"


def _case(expr: str, values: list[str], other: str | None = None) -> str:
    tail = f" ELSE {q(other)}" if other is not None else ""
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values)) + tail + " END"


TASK = ("CASE event_type WHEN 'click' THEN 'task1_cicd' WHEN 'view' THEN 'task2_browser' "
        "WHEN 'purchase' THEN 'task3_sec' ELSE 'other' END")
MODEL = _case("event_id % 8", [m for m, _, _ in fixed.MODEL_RATES], "local/unpriced")

CALLS = f"""SELECT event_id AS call_id, {USER} AS trace_id, {TASK} AS task, event_type AS operation, {MODEL} AS model,
  CAST(floor(value * 10) AS BIGINT) AS tokens_in, {K} AS tokens_out, value AS latency_ms, ts,
  CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 3 = 2 THEN 500 ELSE 429 END AS status FROM {{events}}"""

MESSAGES = [
    "Error code: 401 - invalid api key supplied", "HTTP 429 Too Many Requests: slow down", "status_code: 402 insufficient credit left",
    "quota exceeded for this month", "Error code: 400 maximum context length is 8192 tokens", "404 Not Found: model not found",
    "prompt was blocked by content policy", "request timed out after 30 s", "connection was reset by peer", "upstream said 503 Service Unavailable",
    "status: 500 internal server error", "something odd happened (418) in transit", "plain failure without any hint", "Unauthorized: wrong API key (401)",
    "403 Forbidden by the gateway", "http/502 bad gateway", "error code 999 unknown_model alpha",
]
ERRORS = f"""SELECT event_id AS id, {_case('event_id % 4', ['plan', 'act', 'verify', 'extract'])} AS stage,
  CASE WHEN user_id % 2 = 0 THEN 'openrouter' ELSE 'nvidia' END AS provider, {MODEL} AS model,
  {_case(f'({K} + event_id) % {len(MESSAGES)}', MESSAGES)} AS raw FROM {{events}} WHERE event_type = 'error'"""

MODEL_IDS = ["openai/gpt-5.5", "mistralai/mistral-small-3.1", "mistralai/large", "qwen/qwen3", "unknown/thing", "no-slash", "/name", "pub/", "",
             "has space/x", " moonshotai/kimi-k2.6 ", "X-AI/grok", "deepseek-ai/v4"]
REQUESTS = f"""SELECT event_id AS id, {_case(f'event_id % {len(MODEL_IDS)}', MODEL_IDS)} AS model_id,
  {_case(f'{K} % 6', ['openrouter', 'nvidia', 'Azure', ''])} AS provider_hint FROM {{events}}"""

SCORES = f"""SELECT event_id AS case_id, 'suite_' || CAST(user_id % 3 AS STRING) AS suite, event_type <> 'error' AS passed, value AS latency_ms,
  value / 1000 AS cost_usd, CAST({K} AS DOUBLE) / 100 AS confidence, CAST({K} AS DOUBLE) / 100 AS avg_confidence, {K} % 4 AS llm_calls, {K} % 5 = 0 AS cache_hit,
  {K} % 3 AS self_corrections, CASE WHEN event_type = 'error' THEN {_case(f'{K} % 3', ['parsing_error', 'missing_section'])} END AS failure_type,
  {MODEL} AS model, {TASK} AS task, {K} % 2 = 0 AS use_vision, event_type <> 'error' AS ok FROM {{events}}"""

CHECKS = f"""SELECT 'suite_' || CAST(user_id % 3 AS STRING) AS suite, event_type AS name, {K} % 4 <> 0 AS passed FROM {{events}}"""

STEPS = f"""SELECT {USER} AS trace_id, event_id AS step_no, event_type || CASE WHEN {K} % 9 = 0 THEN '_fallback' ELSE '' END AS step_name,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN {K} % 7 = 0 THEN 'skipped' ELSE 'success' END AS status, value AS duration_ms,
  {K} % 4 AS retry_count FROM {{events}}"""

MESSAGES_IN = f"""SELECT CASE conv_id % 3 WHEN 0 THEN 'task1_cicd' WHEN 1 THEN 'task2_browser' ELSE 'task3_sec' END AS task, role AS operation,
  text AS prompt, text || text AS response FROM {{conversations}}"""

OUTPUTS = """SELECT doc_id AS id, lang, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS source, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE n_chars END AS n_chars,
  CASE WHEN doc_id % 4 = 0 THEN reverse(text) ELSE text END AS content, 10 AS range_start, CAST(length(text) AS INT) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS range_end,
  'preface: ' || chr(10) || text AS source_text FROM {documents}"""

SKILL_NAMES = ["lint-and-test", "build_and_release", "dependency-audit", "scan"]
SKILL_RESULTS = f"""SELECT event_id AS case_id, {_case('event_id % 4', SKILL_NAMES)} AS skill_name,
  CASE WHEN user_id % 9 = 0 THEN 'edge_case' ELSE 'normal' END AS difficulty, {K} % 3 <> 0 AS dry_run,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, {_case(f'{K} % 5', [*fixed.SKILLS])} AS skill,
  event_type <> 'signup' AS has_payload, {K} % 2 = 0 AS tag_created, CASE WHEN event_type = 'error' THEN 'boom' ELSE '' END AS error,
  CASE WHEN {K} % 4 = 0 THEN 'short' ELSE 'a summary of the run' END AS summary FROM {{events}}"""


def calls(spark, folder):
    return A.bind(spark, folder, CALLS)


def priced(spark, folder):
    return L.price_calls(calls(spark, folder))


def _scores(spark, folder):
    return A.bind(spark, folder, SCORES)


def _matrix(s, d, value):
    """Every model of the price list is a column: m0, m1, ... in the list's order."""
    calls = L.price_calls(A.bind(s, d, CALLS)).withColumn("case_id", F.col("trace_id")).withColumn("cost_usd", F.col("cost_usd").cast("double"))
    models = [m for m, _, _ in fixed.MODEL_RATES]
    return S.model_matrix(calls, models, value).toDF("case_id", *[f"m{i}" for i in range(len(models))])


QUERIES = {
    "priced_calls": lambda s, d: priced(s, d).select("call_id", "model", F.col("cost_usd").cast("double").alias("cost_usd")),
    "priced_calls_by_table": lambda s, d: L.price_calls(calls(s, d), L.model_rates(s)).groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").cast("double").alias("cost_usd")),
    "ledger_summary": lambda s, d: L.ledger_summary(priced(s, d)),
    "request_costs": lambda s, d: L.request_costs(priced(s, d)),
    "request_operations": lambda s, d: L.request_operations(calls(s, d)).select("trace_id", "call_id", "operation", "seq"),
    "running_costs": lambda s, d: L.running_costs(priced(s, d)).select(
        "trace_id", "call_id", F.round("running_cost", 6).cast("double").alias("running_cost")),
    "budget_breaches": lambda s, d: L.budget_breaches(priced(s, d)),
    "rate_limit_runs": lambda s, d: L.rate_limit_runs(calls(s, d)),
    "token_estimates": lambda s, d: L.estimate_tokens(A.bind(s, d, MESSAGES_IN)),
    "error_triage": lambda s, d: X.triage_errors(A.bind(s, d, ERRORS)).select(
        "id", "stage", "category", "status_code", F.coalesce("status_label", F.lit("")).alias("status_label"), "retryable", "raw_error"),
    "error_rollup": lambda s, d: X.error_rollup(X.triage_errors(A.bind(s, d, ERRORS))).fillna("", ["provider", "model", "category"]),
    "model_resolution": lambda s, d: X.resolve_models(A.bind(s, d, REQUESTS)).fillna("", ["provider", "error_category"]).select(
        "id", "provider", "error_category"),
    "output_checks": lambda s, d: S.run_checks(
        A.bind(s, d, OUTPUTS), required=["lang", "n_chars"], non_empty=["source"], extra={"long_enough": F.length("content") > 500}).select(
        "id", "name", "passed"),
    "output_coverage": lambda s, d: S.check_coverage(
        A.bind(s, d, "SELECT user_id AS id, event_type AS item_number FROM {events}"), ["click", "view", "refund", "error"]),
    "skill_scores": lambda s, d: S.skill_score_checks(
        A.bind(s, d, f"SELECT case_id, skill_name, difficulty, dry_run FROM ({SKILL_RESULTS}) x"),
        A.bind(s, d, f"SELECT case_id, status, skill, has_payload, tag_created, error, summary FROM ({SKILL_RESULTS}) x")).select("case_id", "name", "passed"),
    "eval_metrics": lambda s, d: S.eval_metrics(_scores(s, d), ["suite"]),
    "failure_distribution": lambda s, d: S.failure_distribution(_scores(s, d), ["suite"]),
    "suite_summary": lambda s, d: S.suite_summary(_scores(s, d)),
    "check_pass_rates": lambda s, d: S.check_pass_rates(A.bind(s, d, CHECKS)),
    "variant_comparison": lambda s, d: S.compare_variants(_scores(s, d)),
    "variant_deltas": lambda s, d: S.variant_deltas(_scores(s, d)),
    "model_matrix": lambda s, d: _matrix(s, d, "tokens_in"),
    "model_matrix_cost": lambda s, d: _matrix(s, d, "cost_usd"),
    "model_matrix_latency": lambda s, d: _matrix(s, d, "latency_ms"),
    "error_stages": lambda s, d: X.error_counts(X.triage_errors(A.bind(s, d, ERRORS))),
    "trace_summary": lambda s, d: X.trace_summary(A.bind(s, d, STEPS)),
    "step_failure_rates": lambda s, d: X.step_failure_rates(A.bind(s, d, STEPS)),
}

_RATES = ", ".join(f"({q(m)}, {i}::DECIMAL(15,9), {o}::DECIMAL(15,9))" for m, i, o in fixed.MODEL_RATES)
_PRICED = f"""WITH calls AS ({A.duck(CALLS)}), rates(model, i, o) AS (VALUES {_RATES}),
priced AS (SELECT c.*, c.tokens_in::DECIMAL(15,0) * (coalesce(r.i, 0.003) * 0.001)::DECIMAL(18,12)
   + c.tokens_out::DECIMAL(15,0) * (coalesce(r.o, 0.010) * 0.001)::DECIMAL(18,12) AS cost_usd FROM calls c LEFT JOIN rates r ON r.model = c.model) """
_AGG = ("count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(cost_usd), 6)::DOUBLE AS cost_usd, "
        "sum(latency_ms::DECIMAL(24,6))::DOUBLE / count(*) AS avg_latency_ms")
_SIG = " ".join(f"WHEN regexp_matches(lower(raw), {q(p)}) THEN {q(c)}" for c, p in fixed.ERROR_SIGNATURES)
_CODES = ", ".join(
    f"CASE WHEN TRY_CAST(regexp_extract(raw, {q(p)}, 1) AS INT) BETWEEN 400 AND 599 THEN TRY_CAST(regexp_extract(raw, {q(p)}, 1) AS INT) END"
    for p in fixed.STATUS_SHAPES)
_LABELS = " ".join(f"WHEN {c} THEN '{c} {t}'" for c, t in fixed.STATUS_LABELS)
_TRIAGED = f"""WITH e AS ({A.duck(ERRORS)}), c AS (SELECT *, CASE {_SIG} ELSE 'unknown' END AS category, coalesce({_CODES}) AS status_code FROM e),
triaged AS (SELECT *, coalesce(CASE status_code {_LABELS} ELSE status_code::VARCHAR END, '') AS status_label,
  category IN ({', '.join(q(c) for c in fixed.RETRYABLE_CATEGORIES)}) AS retryable FROM c) """
_SC = f"WITH s AS ({A.duck(SCORES)}) "
_DMEAN = lambda c: f"sum({c}::DECIMAL(24,6))::DOUBLE / count({c})"

_MODELS = [m for m, _, _ in fixed.MODEL_RATES]


def _matrix_sql(value: str) -> str:
    cells = ", ".join(f"max({value}{'::DOUBLE' if value == 'cost_usd' else ''}) FILTER (WHERE model = {q(m)}) AS m{i}" for i, m in enumerate(_MODELS))
    return f"SELECT trace_id AS case_id, {cells} FROM priced GROUP BY trace_id"


ORACLE = {
    "priced_calls": _PRICED + "SELECT call_id, model, cost_usd::DOUBLE AS cost_usd FROM priced",
    "priced_calls_by_table": _PRICED + "SELECT model, count(*) AS calls, sum(cost_usd)::DOUBLE AS cost_usd FROM priced GROUP BY model",
    "ledger_summary": _PRICED + f"""SELECT 'total' AS level, '' AS key, {_AGG} FROM priced
        UNION ALL SELECT 'task', task, {_AGG} FROM priced GROUP BY task UNION ALL SELECT 'model', model, {_AGG} FROM priced GROUP BY model""",
    "request_costs": _PRICED + """SELECT trace_id, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out,
        round(sum(cost_usd), 6)::DOUBLE AS cost_usd, sum(latency_ms::DECIMAL(24,6))::DOUBLE AS latency_ms,
        string_agg(DISTINCT model, ',' ORDER BY model) AS models_used FROM priced GROUP BY trace_id""",
    "request_operations": _PRICED + "SELECT trace_id, call_id, operation, row_number() OVER (PARTITION BY trace_id ORDER BY ts, call_id) AS seq FROM calls",
    "running_costs": _PRICED + "SELECT trace_id, call_id, round(sum(cost_usd) OVER (PARTITION BY trace_id ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING), 6)::DOUBLE AS running_cost FROM priced",
    "budget_breaches": _PRICED + """, r AS (SELECT *, sum(cost_usd) OVER (PARTITION BY trace_id ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING) AS run,
        (CASE task WHEN 'task1_cicd' THEN 0.30 ELSE 0.50 END)::DECIMAL(12,6) AS cap FROM priced)
      SELECT trace_id, call_id, task, cap::DOUBLE AS cap_usd, round(run, 6)::DOUBLE AS cost_usd, round(run - cap, 6)::DOUBLE AS overspend_usd
      FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts, call_id) AS rn FROM r WHERE run > cap) x WHERE rn = 1""",
    "rate_limit_runs": _PRICED + """, g AS (SELECT *, sum(CASE WHEN status < 400 THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING) AS grp FROM calls)
      SELECT trace_id, count(*) AS run_length, arg_min(call_id, (ts, call_id)) AS first_call, arg_max(call_id, (ts, call_id)) AS last_call
      FROM g WHERE status = 429 GROUP BY trace_id, grp HAVING count(*) >= 3""",
    "token_estimates": f"""SELECT task, operation, count(*) AS messages, sum(length(prompt) // 4)::BIGINT AS tokens_in, sum(length(response) // 4)::BIGINT AS tokens_out
      FROM ({A.duck(MESSAGES_IN)}) m GROUP BY task, operation""",
    "error_triage": _TRIAGED + "SELECT id, stage, category, status_code, status_label, retryable, raw AS raw_error FROM triaged",
    "error_rollup": _TRIAGED + """SELECT coalesce(provider, '') AS provider, coalesce(model, '') AS model, coalesce(category, '') AS category,
      grouping(provider, model, category) AS level, count(*) AS errors, count(*) FILTER (WHERE retryable) AS retryable, count(status_code) AS with_status,
      count(*) FILTER (WHERE retryable) / count(*) AS retryable_share FROM triaged GROUP BY ROLLUP (provider, model, category)""",
    "model_resolution": f"""WITH r AS (SELECT id, trim(model_id) AS mid, model_id, lower(trim(coalesce(provider_hint, ''))) AS hint FROM ({A.duck(REQUESTS)}) x),
      p AS (SELECT *, CASE WHEN hint <> '' THEN CASE WHEN hint IN ('openrouter', 'nvidia') THEN hint END
         WHEN mid IN ({', '.join(q(m) for m, p in fixed.MODEL_REGISTRY if p == 'openrouter')}) THEN 'openrouter'
         WHEN mid IN ({', '.join(q(m) for m, p in fixed.MODEL_REGISTRY if p == 'nvidia')}) THEN 'nvidia'
         WHEN {' OR '.join(f"starts_with(lower(mid), {q(x)})" for x in fixed.NVIDIA_PREFIXES)} THEN 'nvidia'
         WHEN {' OR '.join(f"starts_with(lower(mid), {q(x)})" for x in fixed.OPENROUTER_PREFIXES)} THEN 'openrouter' END AS prov FROM r),
      e AS (SELECT *, CASE WHEN model_id = '' THEN 'missing_model_id' WHEN NOT contains(mid, '/') OR split_part(mid, '/', 1) = '' OR regexp_matches(mid, '^[^/]*/$') OR contains(mid, ' ')
         THEN 'bad_model_id_shape' WHEN hint <> '' AND prov IS NULL THEN 'bad_provider_hint' WHEN prov IS NULL THEN 'ambiguous_provider' ELSE '' END AS error_category FROM p)
      SELECT id, CASE WHEN error_category = '' THEN prov ELSE '' END AS provider, error_category FROM e""",
    "output_checks": f"""WITH o AS (SELECT *, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS want,
        trim(regexp_replace(substr(source_text, range_start + 1, range_end - range_start), '\\s+', ' ', 'g')) AS got FROM ({A.duck(OUTPUTS)}) x)
      SELECT id, 'json_schema' AS name, lang IS NOT NULL AND n_chars IS NOT NULL AS passed FROM o
      UNION ALL SELECT id, 'non_empty_source', length(coalesce(source, '')) > 0 FROM o
      UNION ALL SELECT id, 'char_range', range_end <= length(source_text) AND range_start < range_end AND (contains(got, want) OR contains(want, got)) FROM o
      UNION ALL SELECT id, 'long_enough', length(content) > 500 FROM o""",
    "output_coverage": """SELECT id, 'coverage' AS name, missing = '' AS passed, missing FROM (SELECT user_id AS id,
        concat_ws(',', CASE WHEN bool_or(event_type = 'click') THEN NULL ELSE 'click' END, CASE WHEN bool_or(event_type = 'view') THEN NULL ELSE 'view' END,
          'refund', CASE WHEN bool_or(event_type = 'error') THEN NULL ELSE 'error' END) AS missing FROM events GROUP BY user_id) x""",
    "skill_scores": f"""WITH r AS (SELECT *, lower(replace(skill_name, '_', '-')) AS want, coalesce(skill, '') AS got FROM ({A.duck(SKILL_RESULTS)}) x),
      c AS (SELECT case_id, 'no_crash' AS name, true AS passed FROM r
        UNION ALL SELECT case_id, 'error_case_detected', status = 'failed' AND error <> '' FROM r WHERE difficulty = 'edge_case'
        UNION ALL SELECT case_id, 'has_result', status = 'success' AND has_payload FROM r WHERE difficulty <> 'edge_case'
        UNION ALL SELECT case_id, 'correct_skill', got = want OR contains(got, want) OR contains(want, got) FROM r WHERE difficulty <> 'edge_case'
        UNION ALL SELECT case_id, 'dry_run_no_tag', NOT dry_run OR NOT tag_created FROM r WHERE difficulty <> 'edge_case' AND (contains(want, 'build') OR contains(want, 'release'))
        UNION ALL SELECT case_id, 'has_summary', length(summary) > 10 FROM r WHERE difficulty <> 'edge_case')
      SELECT case_id, name, passed FROM c""",
    "eval_metrics": _SC + f""", l AS (SELECT suite, list(latency_ms ORDER BY latency_ms) AS v, count(*) AS n FROM s GROUP BY suite)
      SELECT s.suite, count(*) AS total_cases, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed,
        count(*) FILTER (WHERE passed) / count(*) AS success_rate, {_DMEAN('latency_ms')} AS avg_latency_ms,
        sum(cost_usd::DECIMAL(24,9))::DOUBLE AS total_cost_usd, {_DMEAN('confidence')} AS avg_confidence,
        any_value(v[greatest(0, floor(n * 0.5::DOUBLE)::INT - 1) + 1]) AS p50_latency_ms, any_value(v[greatest(0, floor(n * 0.95::DOUBLE)::INT - 1) + 1]) AS p95_latency_ms
      FROM s JOIN l ON l.suite = s.suite GROUP BY s.suite""",
    "failure_distribution": _SC + "SELECT suite, failure_type, count(*) AS cases FROM s WHERE NOT passed AND failure_type IS NOT NULL GROUP BY ALL",
    "suite_summary": _SC + f""", l AS (SELECT suite, list(latency_ms ORDER BY latency_ms) AS v, count(*) AS n FROM s GROUP BY suite)
      SELECT s.suite, count(*) AS cases, count(*) FILTER (WHERE passed) AS passed, round(count(*) FILTER (WHERE passed) / count(*), 3) AS success_rate,
        round(count(*) FILTER (WHERE cache_hit) / count(*), 3) AS cache_hit_rate, {_DMEAN('latency_ms')} AS avg_latency_ms, sum(cost_usd::DECIMAL(24,9))::DOUBLE AS total_cost_usd,
        sum(cost_usd::DECIMAL(24,9))::DOUBLE / count(*) AS avg_cost_usd,
        sum(avg_confidence::DECIMAL(24,6)) FILTER (WHERE avg_confidence > 0)::DOUBLE / count(*) FILTER (WHERE avg_confidence > 0) AS avg_confidence,
        count(*) FILTER (WHERE llm_calls > 0) AS model_triggered_cases, {_DMEAN('self_corrections')} AS avg_self_corrections,
        any_value(v[floor(n * 0.95::DOUBLE)::INT + 1]) AS p95_latency_ms FROM s JOIN l ON l.suite = s.suite GROUP BY s.suite""",
    "check_pass_rates": f"SELECT suite, name, count(*) AS runs, round(avg(passed::INT), 3) AS pass_rate FROM ({A.duck(CHECKS)}) c GROUP BY suite, name",
    "variant_comparison": _SC + f"""SELECT task, model, use_vision, count(*) AS cases, round(count(*) FILTER (WHERE ok) / count(*), 3) AS ok_rate,
      sum(cost_usd::DECIMAL(24,9))::DOUBLE AS total_cost_usd, {_DMEAN('latency_ms')} AS avg_latency_ms, sum(llm_calls)::BIGINT AS llm_calls FROM s GROUP BY ALL""",
    "variant_deltas": _SC + f"""SELECT task, model, count(*) FILTER (WHERE use_vision) AS cases_on, count(*) FILTER (WHERE NOT use_vision) AS cases_off,
      avg(ok::INT) FILTER (WHERE use_vision) - avg(ok::INT) FILTER (WHERE NOT use_vision) AS ok_rate_delta,
      sum(latency_ms::DECIMAL(24,6)) FILTER (WHERE use_vision)::DOUBLE / count(*) FILTER (WHERE use_vision)
       - sum(latency_ms::DECIMAL(24,6)) FILTER (WHERE NOT use_vision)::DOUBLE / count(*) FILTER (WHERE NOT use_vision) AS latency_delta_ms FROM s GROUP BY ALL""",
    "model_matrix": _PRICED + _matrix_sql("tokens_in"),
    "model_matrix_cost": _PRICED + _matrix_sql("cost_usd"),
    "model_matrix_latency": _PRICED + _matrix_sql("latency_ms"),
    "error_stages": _TRIAGED + """SELECT coalesce(stage, '') AS stage, coalesce(status_code, 0) AS status_code, count(*) AS errors, count(*) FILTER (WHERE retryable) AS retryable FROM triaged GROUP BY ALL""",
    "trace_summary": f"""SELECT trace_id, count(*) AS steps, sum(duration_ms::DECIMAL(24,6))::DOUBLE AS total_duration_ms, sum(retry_count)::BIGINT AS retries,
      bool_or(ends_with(step_name, '_fallback')) AS used_fallback, arg_max(status, step_no) AS final_status FROM ({A.duck(STEPS)}) s GROUP BY trace_id""",
    "step_failure_rates": f"""SELECT step_name, count(*) AS runs, count(*) FILTER (WHERE status = 'failed') AS failed,
      count(*) FILTER (WHERE status = 'failed') / count(*) AS failure_rate FROM ({A.duck(STEPS)}) s GROUP BY step_name""",
}
