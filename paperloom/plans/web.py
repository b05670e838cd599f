"""Registered queries over pages, tasks, recorded agent runs and model outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions.text import left, strip
from paperloom.operators import intents as I
from paperloom.operators import items as T
from paperloom.operators import ledger as L
from paperloom.operators import model_outputs as M
from paperloom.operators import page_content as P
from paperloom.operators import runs as R
from paperloom.operators import scores as S
from paperloom.plans import adapters as A
from paperloom.plans import filings_oracle as O
from paperloom.plans.corpus import HTML, ITEM8  # noqa: F401
from paperloom.plans.filings import texts
from paperloom.plans.filings_oracle import q
from paperloom.plans.ledger import CALLS, MODEL, USER, _case
from paperloom.plans.ledger import K as KEY
from paperloom.plans.ledger import _PRICED
from paperloom.session import cut_lineage, kept

NL = "chr(10)"
SITE_URLS = ["https://en.wikipedia.org/wiki/X", "https://arxiv.org/abs/1", "http://news.ycombinator.com", "https://developer.mozilla.org/en/Y", "https://pypi.org/project/z/", "https://GitHub.com/o/r",
             "https://user@www.example.com:80/p", "https://notwikipedia.org/wiki/Z", "ftp://x.pypi.org?q"]
PAGES = f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE {_case(f'page_id % {len(SITE_URLS)}', SITE_URLS)} END AS url FROM {{pages}}"
TASK_TEXT = [
    "Give me the first paragraph", "paragraph 3 of the page", "the last paragraph please", "paragraphs 4 to 2", "first 2 paragraphs", "the whole article", "summarize this", "What is the license?",
    "only the title and author", "top 5 stories", "define entropy", "the 12th paragraph", "click the button", "log in and fill the form", "authors of the paper", "lead section", "first 0 paragraphs", "paragraph 99",
    "tl;dr", "請點擊這裡", "第一段", "什麼是 Spark", "comments and points of the top story", "just the abstract", "describe it", "", "release date of the latest version", "intro paragraph", "search for cats", "paragraphs 1 - 2",
]
TASKS = f"SELECT event_id AS task_id, {_case(f'event_id % {len(TASK_TEXT)}', TASK_TEXT)} AS task, user_id AS page_id FROM {{events}}"
DOC_TASKS = f"SELECT doc_id AS task_id, doc_id AS page_id, {_case(f'doc_id % {len(TASK_TEXT)}', TASK_TEXT)} AS task FROM {{documents}}"
DIGEST = f"SELECT doc_id AS page_id, text, CASE doc_id % 4 WHEN 0 THEN 'Button ' || text WHEN 1 THEN 'searchbox' WHEN 2 THEN 'LINK x textbox' ELSE '' END AS a11y FROM {{documents}}"
VERB = "CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'navigate' WHEN 'signup' THEN 'fill' WHEN 'purchase' THEN 'extract' ELSE 'hover' END"
ERROR_TEXT = ["Timeout 3000ms waiting for locator", "net::ERR_FAILED", "HTTP 429 slow", "403 Forbidden", "SSL handshake", "frame was detached", "timeout", "strict mode violation", "resolved to 3 elements", "element is not attached",
              "element is not visible", "captcha shown", "target not found", "odd failure", "hidden by overlay", "ERR_ABORTED"]
STEPS = f"""SELECT {USER} AS trace_id, event_id AS step_number, {VERB} AS action_type, 't' || CAST({KEY} % 2 AS STRING) AS target, CAST({KEY} AS STRING) AS value,
  CASE WHEN {KEY} % 25 = 0 THEN 'about:blank' WHEN user_id % 11 = 0 AND {KEY} % 2 = 0 THEN 'https://x.org/Login?next=1' ELSE 'https://x.org/' || CAST({KEY} % 3 AS STRING) END AS url,
  'shows ' || CAST({KEY} AS STRING) || ',000 units and ' || CASE WHEN {KEY} % 10 = 0 THEN 'a cookie banner' WHEN {KEY} % 10 = 1 THEN 'a captcha' ELSE CAST(event_id AS STRING) END AS text,
  CASE WHEN {KEY} % 6 = 0 THEN 'bad thing' ELSE '' END AS page_error, CASE WHEN event_type = 'error' THEN {_case(f'event_id % {len(ERROR_TEXT)}', ERROR_TEXT)} ELSE '' END AS error,
  value AS duration_ms, event_type = 'error' AND {KEY} % 2 = 0 AS healer_activated FROM {{events}}"""
ANSWERS = ["I cannot find it", "The total is 424242 units", "It shows 17,000 units", "", "Ready after 3 tries", "找不到資料", "Prices 31,000 and 999999.5"]
RUNS = f"""SELECT DISTINCT {USER} AS trace_id, CASE user_id % 5 WHEN 0 THEN 'partial' WHEN 1 THEN 'failed' ELSE 'success' END AS status, {_case(f'user_id % {len(ANSWERS)}', ANSWERS)} AS final_answer,
  user_id % 6 = 0 AS fast_path_hit, user_id FROM {{events}}"""
# Every output carries its whole conversation text: as a JSON string (`j`, line ends escaped), in one line (`o`) or as it is.
_J, _O = f"replace(text, {NL}, chr(92) || 'n')", f"replace(text, {NL}, ' ')"
_Q = "chr(34)"
SHAPES = [
    f"""'{{{{"complete": true, "answer": "' || {_J} || '", "confidence": 0.9}}}}'""",
    f"""'```json' || {NL} || '{{{{"a": {{{{"b": "' || {_J} || '"}}}}}}}}' || {NL} || '```'""",
    f"""'Here: {{{{"steps": [{{{{"action": "goto", "target": "' || {_J} || '"}}}}]}}}} done'""",
    f"""'[{{{{"action": "press", "value": "' || {_J} || '"}}}}, {{{{"target": "w"}}}}]'""",
    "'Yes, task is complete: ' || text",
    f"""'1. Open page' || {NL} || '2) Click ' || {_O}""",
    f"""'{{{{“answer”: “' || {_J} || '”}}}}'""",
    f"""'broken {{{{"a": ' || text""",
    "'note [1, 2] end ' || text",
    f"""'{{{{"s": "brace }}}} inside ' || {_J} || '", "n": {{{{"k": [1]}}}}}}}} tail'""",
    "text",
]
_ID = "CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING)"
OUTPUTS = f"""SELECT {_ID} AS id, CASE conv_id % 3 WHEN 0 THEN 'openai/gpt-5.5' WHEN 1 THEN 'z-ai/glm-5.1' ELSE 'qwen/q' END AS model,
  CASE (conv_id + turn) % {len(SHAPES)} {' '.join(f"WHEN {i} THEN {r}" for i, r in enumerate(SHAPES))} END AS raw FROM {{conversations}}"""
PLAN_TASKS = f"SELECT {_ID} AS id, 'find ' || CAST(turn AS STRING) AS task, CASE WHEN conv_id % 2 = 0 THEN 'https://x.org/' || CAST(conv_id AS STRING) ELSE '' END AS start_url FROM {{conversations}}"
DIAGNOSES = f"""SELECT {_ID} AS id, CASE (conv_id + turn) % 7 WHEN 0 THEN '' WHEN 1 THEN 'The Selector moved. ' || text WHEN 2 THEN text || ' page not loaded' WHEN 3 THEN 'Captcha, then a popup: ' || text
  WHEN 4 THEN 'an overlay hides it ' || text WHEN 5 THEN 'Timeout; network slow ' || text ELSE text END AS diagnosis FROM {{conversations}}"""
SITES = f"""SELECT doc_id AS page_id, CASE doc_id % 7 WHEN 0 THEN 'https://en.wikipedia.org/wiki/D' WHEN 1 THEN 'https://arxiv.org/abs/' WHEN 2 THEN 'https://news.ycombinator.com/d' WHEN 3 THEN 'https://developer.mozilla.org/d'
    WHEN 4 THEN 'https://pypi.org/project/d' WHEN 5 THEN 'https://github.com/o/d' ELSE 'https://example.com/d' END || CAST(doc_id AS STRING) AS url,
  '<html><body>' || CASE doc_id % 7 WHEN 0 THEN '<div id="mw-content-text"><div class="mw-parser-output"><table class="infobox"><tr><td>Population 12345</td></tr></table><p>' WHEN 1 THEN '<h1 class="title">Title: On d</h1><div class="authors">Authors: A, B</div><blockquote class="abstract">Abstract: '
    WHEN 2 THEN '<table><tr class="athing"><td><span class="titleline"><a href="u1">First</a></span></td></tr><tr><td>17 points by x | 4 comments</td></tr><tr class="athing"><td><span class="titleline"><a href="u2">Second</a></span></td></tr><tr><td>no score</td></tr></table><p>'
    WHEN 3 THEN '<main><article class="main-page-content"><section><p>' WHEN 4 THEN '<h1 class="package-header__name">pkg 1.2.3</h1><p class="package-description__summary">A tool</p><aside><p><strong>License:</strong> MIT</p><p><strong>Author:</strong> Zed</p></aside><p>'
    WHEN 5 THEN '<article class="markdown-body"><p>' ELSE '<div class="error">Oops ' || CAST(doc_id AS STRING) || '</div><p>' END
  || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), chr(10), '</p><p>') || '</p></body></html>' AS html FROM {{documents}}"""
SITE_TASKS = f"""SELECT doc_id AS task_id, {_case(f'doc_id % {len(TASK_TEXT)}', TASK_TEXT)} AS task, CASE doc_id % 7 WHEN 0 THEN 'https://en.wikipedia.org/wiki/D' WHEN 1 THEN 'https://arxiv.org/abs/' WHEN 2 THEN 'https://news.ycombinator.com/d'
    WHEN 3 THEN 'https://developer.mozilla.org/d' WHEN 4 THEN 'https://pypi.org/project/d' WHEN 5 THEN 'https://github.com/o/d' ELSE 'https://example.com/d' END || CAST(doc_id AS STRING) AS target_url, doc_id AS page_id,
  'population ' || source AS description FROM {{documents}}"""
RUN_CASES = f"""SELECT DISTINCT {USER} AS case_id, user_id FROM {{events}}"""


def _steps(s, d):
    page = F.struct("url", F.lit("").alias("title"), "text", F.lit("").alias("a11y"),
                    F.when(F.col("page_error") != "", F.array("page_error")).otherwise(F.array().cast("array<string>")).alias("errors"))
    return A.bind(s, d, STEPS).withColumn("after", page).drop("url", "text", "page_error")


def _paired(s, d):
    return R.with_before(_steps(s, d))


def _paragraphs(s, d):
    rows = A.bind(s, d, "SELECT doc_id AS page_id, text FROM {documents}")
    return rows.select("page_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("n", "text"))


def _guarded(s, d):
    return R.guard_runs(A.bind(s, d, RUNS), _steps(s, d).withColumn("before", F.lit(None).cast(_steps(s, d).schema["after"].dataType)))


def _summary(s, d):
    steps = _steps(s, d).withColumn("before", F.lit(None).cast(_steps(s, d).schema["after"].dataType))
    return R.run_summary(steps, L.request_costs(L.price_calls(A.bind(s, d, CALLS))), A.bind(s, d, RUNS).select("trace_id", "status", "fast_path_hit"))


def _parsed(s, d):
    return M.parse_outputs(A.bind(s, d, OUTPUTS))


def _site_tasks(s, d):
    # Parsed tasks are a table of their own: the joins below would otherwise repeat every pattern.
    return cut_lineage(I.parse_intents(A.bind(s, d, SITE_TASKS)))


def _run_checks(s, d):
    cases = A.bind(s, d, RUN_CASES).select(
        "case_id", F.when(F.col("user_id") % 2 == 0, "success").alias("expected_status"),
        F.when(F.col("user_id") % 3 == 0, F.array(F.lit("success"), F.lit("not_found"))).alias("allowed_statuses"),
        F.when(F.col("user_id") % 4 == 0, F.array(F.lit("UNITS"))).alias("must_contain"), F.when(F.col("user_id") % 4 == 1, F.array(F.lit("cannot"))).alias("must_not_contain"),
        F.when(F.col("user_id") % 5 == 0, F.array(F.lit("hedged"))).alias("failure_modes_expected"), F.lit(None).cast("int").alias("min_steps"),
        F.when(F.col("user_id") % 2 == 1, 60).alias("max_steps"))
    totals = _steps(s, d).groupBy("trace_id").agg(F.count(F.lit(1)).alias("total_steps"))
    runs = _guarded(s, d).join(totals, "trace_id").select(
        F.col("trace_id").alias("case_id"), F.col("guarded_status").alias("status"), "final_answer", "total_steps", "fast_path_hit",
        F.when(F.col("guard_mode").isNotNull(), F.array("guard_mode")).alias("failure_modes"))
    return S.run_score_checks(cases, runs)


def _filing_scores(s, d):
    # Three branches read the items; a few short columns of them are enough for all. Of a content only its first character, as
    # it is tested for being empty.
    items = kept(T.extract_items(texts(s, d), validate=True).select(
        "filing_id", "item_number", "status", "ord", "range_start", "confidence", "issues", left(strip("content_text"), 1).alias("content_text")), "items")
    cases = A.bind(s, d, "SELECT doc_id AS case_id FROM {documents}").select(
        "case_id", (F.col("case_id") % 22).cast("int").alias("min_items"),
        F.when(F.col("case_id") % 3 == 0, F.array(F.lit("1"), F.lit("7"))).otherwise(F.array(F.lit("1A"))).alias("required_items"),
        F.create_map(F.lit("6"), F.lit("reserved")).alias("expected_status"), F.array(F.lit("1C"), F.lit("9C")).alias("allow_missing"))
    named = items.withColumnRenamed("filing_id", "case_id")
    reports = T.validation_report(items).select(F.col("filing_id").alias("case_id"), "overall_valid")
    return S.score_filings(cases, named, reports).fillna("", ["failure_type"])


QUERIES = {
    "routed_pages": lambda s, d: I.route_pages(A.bind(s, d, PAGES)).fillna("", ["site"]),
    "page_paragraphs": lambda s, d: P.page_paragraphs(A.table(s, d, "pages")).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("text")).alias("chars")),
    "task_intents": lambda s, d: I.parse_intents(A.bind(s, d, TASKS)).select(
        "task_id", "paragraph_index", "range_from", "range_to", "paragraphs_all", "wants_summary", "wants_definition", "strict_fields", "top_n",
        F.array_join(F.array_sort("requested_fields"), ",").alias("fields")),
    "static_tasks": lambda s, d: I.filter_static(A.bind(s, d, TASKS)).select("task_id", "task"),
    "paragraph_answers": lambda s, d: I.answer_from_paragraphs(I.parse_intents(A.bind(s, d, DOC_TASKS)), _paragraphs(s, d)).select(
        "task_id", F.md5(F.coalesce("answer", F.lit("<none>"))).alias("answer_md5")),
    "site_paragraphs": lambda s, d: P.site_paragraphs(I.route_pages(A.bind(s, d, SITES))).select("page_id", "n", F.md5("text").alias("text_md5")),
    "page_fields": lambda s, d: P.extract_fields(I.route_pages(A.bind(s, d, SITES)), I.route_pages(_site_tasks(s, d).withColumnRenamed("target_url", "url"))).select(
        "task_id", "field", F.md5("value").alias("value_md5")),
    "listing_rows": lambda s, d: P.listing_top_n(A.bind(s, d, SITES), _site_tasks(s, d)).select(
        "task_id", "n", "title", "url", F.coalesce("points", F.lit(-1)).alias("points"), F.coalesce("comments", F.lit(-1)).alias("comments")),
    "data_blocks": lambda s, d: P.extract_blocks(A.bind(s, d, SITES), A.bind(s, d, SITE_TASKS)).select("task_id", "kind", F.coalesce("text", F.lit("")).alias("text")),
    "page_errors": lambda s, d: P.error_counts(A.bind(s, d, SITES)),
    "page_digests": lambda s, d: I.digest_pages(A.bind(s, d, DIGEST)).select("page_id", F.md5("digest").alias("digest_md5"), "has_buttons", "has_inputs", "has_links"),
    "verified_steps": lambda s, d: R.verify_steps(_paired(s, d)).select(
        "trace_id", "step_number", "url_changed", "dom_changed", "success", "confidence", "reason", "low_confidence"),
    "failure_triage": lambda s, d: R.triage_failures(_paired(s, d)).select("trace_id", "step_number", "root_cause", "should_retry", "confidence"),
    "model_diagnosis": lambda s, d: R.model_diagnosis(A.bind(s, d, DIAGNOSES)).select("id", "root_cause", "should_retry", "confidence", F.md5("recovery").alias("recovery_md5")),
    "triage_counts": lambda s, d: R.triage_counts(R.triage_failures(_paired(s, d))),
    "recovery_actions": lambda s, d: R.recovery_actions(R.triage_failures(_paired(s, d)).withColumn("recovery", F.when(
        F.col("step_number") % 3 == 0, "Click [button] 'Submit'").when(F.col("step_number") % 3 == 1, "role=textbox name='Customer'").otherwise("Try again"))).fillna(
        "", ["alt_action", "alt_target", "alt_value"]).groupBy("root_cause", "alt_action", "alt_target").agg(F.count(F.lit(1)).alias("steps")),
    "stuck_loops": lambda s, d: R.stuck_loops(_steps(s, d), 2),
    "repeated_steps": lambda s, d: R.stuck_loops(_steps(s, d), 2),
    "guarded_runs": lambda s, d: _guarded(s, d).fillna("", ["guard_mode"]).select("trace_id", "status", "guarded_status", "guard_mode"),
    "parsed_outputs": lambda s, d: _parsed(s, d).select("id", "model", F.coalesce("object_json", F.lit("")).alias("object_json"), F.coalesce("array_json", F.lit("")).alias("array_json")),
    "output_verdicts": lambda s, d: M.verdicts(_parsed(s, d)).select("id", "model", "complete", "confidence", F.md5("answer").alias("answer_md5")),
    "block_outputs": lambda s, d: M.parse_blocks(A.bind(s, d, OUTPUTS).withColumn("blocks", F.array(
        F.struct(F.lit("text").alias("type"), F.substring_index("raw", " ", 1).alias("text"), F.lit(None).cast("string").alias("content")),
        F.struct(F.lit("other").alias("type"), F.lit(None).cast("string").alias("text"), F.expr("substring(raw, length(substring_index(raw, ' ', 1)) + 1)").alias("content"))).cast(M._BLOCKS))).select(
        "id", "model", F.coalesce("object_json", F.lit("")).alias("object_json"), F.coalesce("array_json", F.lit("")).alias("array_json")),
    "executable_plans": lambda s, d: M.executable_plans(A.bind(s, d, PLAN_TASKS), _parsed(s, d)).select(
        "id", "step_no", "action_type", F.md5(F.concat_ws("|", "target", "value")).alias("step_md5"), "success_criteria"),
    "single_actions": lambda s, d: M.single_actions(_parsed(s, d)).select("id", "action_type", F.md5(F.concat_ws("|", "target", "value")).alias("action_md5")),
    "unwrapped_answers": lambda s, d: M.unwrap_answers(A.bind(s, d, OUTPUTS), "raw").select("id", F.md5("answer").alias("answer_md5")),
    "planned_steps": lambda s, d: M.plan_steps(_parsed(s, d)).select("id", "step_no", "action_type", F.md5(F.concat_ws("|", "target", "value")).alias("step_md5")),
    "parse_failure_rates": lambda s, d: M.parse_failure_rates(_parsed(s, d)),
    "run_summary": lambda s, d: _summary(s, d),
    "fast_path_share": lambda s, d: R.fast_path_share(_summary(s, d)),
    "static_answers": lambda s, d: P.answer_static(_site_tasks(s, d), A.bind(s, d, SITES)).select("task_id", "site", "status", F.md5(F.coalesce("answer", F.lit(""))).alias("answer_md5")),
    "static_shares": lambda s, d: P.static_shares(P.answer_static(_site_tasks(s, d), A.bind(s, d, SITES))),
    "run_score_checks": lambda s, d: _run_checks(s, d).select("case_id", "name", "passed"),
    "run_scores": lambda s, d: S.score_from_checks(_run_checks(s, d)),
    "filing_scores": _filing_scores,
}

_SUFFIX = " ".join(f"WHEN h = {q(x)} OR ends_with(h, {q('.' + x)}) THEN {q(x)}" for x in fixed.SITE_SUFFIXES)
_rx = lambda x, p: f"regexp_matches({x}, {q(p)})"
_num = lambda p, g=1: f"TRY_CAST(regexp_extract(low, {q(p)}, {g}) AS INT)"
_ORD = r"\b(?:the\s+)?(" + "|".join(w for w, _ in fixed.ORDINALS) + r")\s+paragraph\b"
_ORDMAP = " ".join(f"WHEN {q(w)} THEN {n}" for w, n in fixed.ORDINALS)


def _syn(s: str) -> str:
    plain = " " in s or ";" in s or "/" in s
    return f"contains(low, {q(s)})" if plain else _rx("low", rf"\b{s}\b")


_FIELDS = ", ".join(f"CASE WHEN {' OR '.join(_syn(w) for w in words)} THEN {q(f)} END" for f, words in fixed.FIELD_SYNONYMS)


def _intents(source: str) -> str:
    return f"""it AS (SELECT *, lower(task) AS low FROM ({source}) t), ru AS (SELECT *, CASE WHEN {_rx('low', fixed.INTENT_ALL)} THEN 'all' WHEN {_rx('low', fixed.INTENT_LAST)} THEN 'last' WHEN {_rx('low', fixed.INTENT_RANGE)} THEN 'range'
    WHEN {_rx('low', fixed.INTENT_FIRST_N)} THEN 'first_n' WHEN {_rx('low', _ORD)} THEN 'ordinal' WHEN {_rx('low', fixed.INTENT_NUMBERED)} THEN 'numbered'
    WHEN {_rx('low', fixed.INTENT_SINGULAR)} OR {_rx('low', fixed.INTENT_LEAD)} OR {_rx('task', fixed.INTENT_CJK_FIRST)} THEN 'one' END AS rule,
    list_sort(list_filter([{_FIELDS}], lambda x: x IS NOT NULL)) AS fl FROM it),
  iv AS (SELECT *, CASE rule WHEN 'last' THEN -1 WHEN 'ordinal' THEN CASE regexp_extract(low, {q(_ORD)}, 1) {_ORDMAP} END WHEN 'numbered' THEN {_num(fixed.INTENT_NUMBERED)} WHEN 'one' THEN 1 END AS paragraph_index,
    CASE WHEN rule = 'range' THEN least({_num(fixed.INTENT_RANGE)}, {_num(fixed.INTENT_RANGE, 2)}) WHEN rule = 'first_n' AND {_num(fixed.INTENT_FIRST_N)} > 0 THEN 1 END AS range_from,
    CASE WHEN rule = 'range' THEN greatest({_num(fixed.INTENT_RANGE)}, {_num(fixed.INTENT_RANGE, 2)}) WHEN rule = 'first_n' AND {_num(fixed.INTENT_FIRST_N)} > 0 THEN {_num(fixed.INTENT_FIRST_N)} END AS range_to,
    coalesce(rule = 'all', false) AS paragraphs_all FROM ru),
  ix AS (SELECT *, len(fl) = 1 AND paragraph_index IS NULL AND range_from IS NULL AND NOT paragraphs_all AS single FROM iv),
  intents AS (SELECT *, NOT single AND ({_rx('low', fixed.INTENT_SUMMARY)} OR {_rx('task', fixed.INTENT_CJK_SUMMARY)}) AS wants_summary, NOT single AND {_rx('low', fixed.INTENT_DEFINITION)} AS wants_definition,
    single OR {_rx('low', fixed.INTENT_ONLY)} AS strict_fields, {_num(fixed.INTENT_TOP_N)} AS top_n, array_to_string(fl, ',') AS fields FROM ix)"""


_PAIRED = f"""st AS (SELECT * FROM ({A.duck(STEPS)}) x), pr AS (SELECT *, lag(url) OVER w AS burl, lag(text) OVER w AS btext, lag(page_error) OVER w AS berr FROM st WINDOW w AS (PARTITION BY trace_id ORDER BY step_number))"""
_any = lambda x, *w: "(" + " OR ".join(f"contains({x}, {q(v)})" for v in w) + ")"
_TRIAGE = f"""{_PAIRED}, tr AS (SELECT *, lower(error) AS e FROM pr WHERE error <> ''),
  tt AS (SELECT *, CASE WHEN {_any('e', '429', 'too many requests', 'rate limit', 'ratelimit')} THEN ['network_error', 'true', '0.95'] WHEN {_any('e', '403', 'forbidden', 'access denied', 'blocked')} THEN ['captcha_detected', 'false', '0.9']
    WHEN {_any('e', 'ssl', 'cert')} THEN ['network_error', 'false', '0.95'] WHEN {_any('e', 'frame was detached', 'target closed', 'execution context was destroyed')} THEN ['page_not_loaded', 'true', '0.85']
    WHEN contains(e, 'timeout') AND {_any('e', 'waiting for', 'locator')} THEN ['element_not_found', 'true', '0.8'] WHEN contains(e, 'timeout') THEN ['timeout', 'true', '0.7'] WHEN {_any('e', 'net::', 'err_')} THEN ['network_error', 'true', '0.9']
    WHEN contains(e, 'strict mode violation') OR (contains(e, 'resolved to') AND contains(e, 'elements')) THEN ['selector_ambiguous', 'true', '0.85'] WHEN {_any('e', 'element is not attached', 'element handle is detached')} THEN ['page_not_loaded', 'true', '0.85']
    WHEN {_any('e', 'not visible', 'not interactable', 'hidden')} THEN CASE WHEN page_error <> '' OR contains(lower(text), 'cookie') THEN ['unexpected_popup', 'true', '0.7'] ELSE ['element_hidden', 'true', '0.7'] END
    WHEN contains(e, 'captcha') OR contains(lower(text), 'captcha') THEN ['captcha_detected', 'false', '0.9'] WHEN url IN ('', 'about:blank') THEN ['page_not_loaded', 'true', '0.8'] WHEN contains(e, 'not found') THEN ['element_not_found', 'true', '0.6']
    ELSE ['unknown', 'true', '0.3'] END AS v FROM tr),
  triaged AS (SELECT *, v[1] AS root_cause, v[2] = 'true' AS should_retry, v[3]::DOUBLE AS confidence FROM tt)"""
_VERIFY = f"""{_PAIRED}, vf AS (SELECT *, burl <> url AS url_changed, btext <> text AS dom_changed, page_error <> '' AND page_error <> berr AS broken, action_type || ': ' || target AS it FROM pr WHERE burl IS NOT NULL AND error = ''),
  vg AS (SELECT *, url_changed OR dom_changed AS changed, {_any('it', 'navigate', 'go to')} AS mv, contains(it, 'click') AS cl, {_any('it', 'fill', 'type')} AS fi, {_any('it', 'extract', 'read')} AS ex FROM vf),
  vh AS (SELECT trace_id, step_number, url_changed, dom_changed, CASE WHEN broken THEN false WHEN mv THEN url_changed WHEN cl THEN changed WHEN fi OR ex THEN true ELSE changed END AS success,
    (CASE WHEN broken THEN 0.2 WHEN mv THEN CASE WHEN url_changed THEN 0.9 ELSE 0.3 END WHEN cl THEN CASE WHEN changed THEN 0.8 ELSE 0.4 END WHEN fi THEN 0.7 WHEN ex THEN 0.9 ELSE CASE WHEN changed THEN 0.6 ELSE 0.4 END END)::DOUBLE AS confidence,
    CASE WHEN broken THEN 'New errors detected: ' || page_error WHEN mv THEN CASE WHEN url_changed THEN 'URL changed' ELSE 'URL did not change after navigation' END WHEN cl THEN CASE WHEN changed THEN 'Page state changed after click' ELSE 'No observable change after click' END
      WHEN fi THEN 'Fill action performed' WHEN ex THEN 'Extract action — data captured from page state' ELSE 'Generic action verification' END AS reason FROM vg)"""
_MARK = " ".join(f"WHEN contains(lower(last_url), {q(m)}) THEN {q(m)}" for m in fixed.BLOCKED_URL_MARKERS)
_HEDGE = " OR ".join(f"contains(lower(trim(final_answer)), {q(p)})" for p in fixed.NO_ANSWER_PHRASES)
_GUARD = f"""st AS (SELECT * FROM ({A.duck(STEPS)}) x), rn AS (SELECT r.*, l.last_url, l.obs FROM ({A.duck(RUNS)}) r JOIN (SELECT trace_id, arg_max(url, step_number) AS last_url, string_agg(text, chr(10)) AS obs, count(*) AS total_steps FROM st GROUP BY trace_id) l ON l.trace_id = r.trace_id),
  gm AS (SELECT *, CASE WHEN status IN ('success', 'partial') THEN CASE {_MARK} END END AS marker, regexp_extract_all(final_answer, {q(fixed.NUMBER_TOKEN)}) AS nums FROM rn),
  gg AS (SELECT *, status = 'success' AND marker IS NULL AND final_answer <> '' AS op, ({_HEDGE}) AS hedge FROM gm),
  gu AS (SELECT *, op AND NOT hedge AND len(nums) > 0 AND len(list_filter(nums, lambda n: contains(obs, n) OR contains(replace(obs, ',', ''), replace(n, ',', '')))) = 0 AS ungr FROM gg),
  guarded AS (SELECT *, CASE WHEN marker IS NOT NULL OR (op AND hedge) THEN 'not_found' WHEN ungr THEN 'unverified' ELSE status END AS guarded_status,
    CASE WHEN marker IS NOT NULL THEN 'blocked_url:' || marker WHEN op AND hedge THEN 'hedged_answer' WHEN ungr THEN 'ungrounded_numbers:[''' || array_to_string(nums, ''', ''') || ''']' ELSE '' END AS guard_mode FROM gu)"""
_SUMMARY = _PRICED + f""", st AS (SELECT * FROM ({A.duck(STEPS)}) x), rc AS (SELECT trace_id, count(*) AS llm_calls, round(sum(cost_usd), 6)::DOUBLE AS cost_usd FROM priced GROUP BY trace_id),
  sm AS (SELECT r.trace_id, r.status, r.fast_path_hit, s.*, c.llm_calls, c.cost_usd FROM ({A.duck(RUNS)}) r JOIN (SELECT trace_id AS t, count(*) AS total_steps, count(*) FILTER (WHERE healer_activated) AS healer_activations, arg_max(url, step_number) AS final_url,
    sum(duration_ms::DECIMAL(24,6))::DOUBLE AS total_duration_ms, count(*) FILTER (WHERE error <> '') AS failed_steps FROM st GROUP BY trace_id) s ON s.t = r.trace_id JOIN rc c ON c.trace_id = r.trace_id) """
_RUNCHECK = f"""WITH {_GUARD}, tot AS (SELECT trace_id AS tid, count(*) AS total_steps FROM st GROUP BY trace_id), g AS (SELECT *, lower(final_answer) AS low FROM guarded JOIN tot ON tid = trace_id),
  ck AS (SELECT trace_id AS case_id, 'no_crash' AS name, guarded_status <> 'failed' AS passed FROM g UNION ALL SELECT trace_id, 'took_steps', total_steps >= CASE WHEN fast_path_hit THEN 0 ELSE 1 END FROM g
    UNION ALL SELECT trace_id, 'reasonable_steps', total_steps <= CASE WHEN user_id % 2 = 1 THEN 60 ELSE 20 END FROM g UNION ALL SELECT trace_id, 'has_answer', trim(final_answer) <> '' FROM g
    UNION ALL SELECT trace_id, 'expected_status', guarded_status = 'success' FROM g WHERE user_id % 2 = 0 UNION ALL SELECT trace_id, 'status_in_allowed', guarded_status IN ('success', 'not_found') FROM g WHERE user_id % 3 = 0
    UNION ALL SELECT trace_id, 'must_contain[UNITS]', contains(low, 'units') FROM g WHERE user_id % 4 = 0 UNION ALL SELECT trace_id, 'must_not_contain[cannot]', NOT contains(low, 'cannot') FROM g WHERE user_id % 4 = 1
    UNION ALL SELECT trace_id, 'failure_mode[hedged]', contains(guard_mode, 'hedged') FROM g WHERE user_id % 5 = 0) """

# What each output holds, stated shape by shape; the conversations themselves hold no JSON.
_JSON = f"""WITH j AS (SELECT id, model, k, text, t, o, turn, conv_id, CASE k WHEN 0 THEN '{{"complete": true, "answer": "' || t || '", "confidence": 0.9}}' WHEN 1 THEN '{{"a": {{"b": "' || t || '"}}}}'
    WHEN 2 THEN '{{"steps": [{{"action": "goto", "target": "' || t || '"}}]}}' WHEN 6 THEN '{{"answer": "' || t || '"}}' WHEN 9 THEN '{{"s": "brace }} inside ' || t || '", "n": {{"k": [1]}}}}' ELSE '' END AS object_json,
    CASE k WHEN 2 THEN '[{{"action": "goto", "target": "' || t || '"}}]' WHEN 3 THEN '[{{"action": "press", "value": "' || t || '"}}, {{"target": "w"}}]' WHEN 8 THEN '[1, 2]' WHEN 9 THEN '[1]' ELSE '' END AS array_json
  FROM (SELECT *, conv_id || '-' || turn AS id, CASE conv_id % 3 WHEN 0 THEN 'openai/gpt-5.5' WHEN 1 THEN 'z-ai/glm-5.1' ELSE 'qwen/q' END AS model, (conv_id + turn) % 11 AS k, replace(text, chr(10), chr(92) || 'n') AS t,
    replace(text, chr(10), ' ') AS o FROM conversations) c) """
_STEPS_SQL = """SELECT id, 1 AS step_no, 'navigate' AS action_type, text AS target, '' AS value, '' AS success FROM j WHERE k = 2 UNION ALL SELECT id, 1, 'key_press', '', text, '' FROM j WHERE k = 3 UNION ALL SELECT id, 2, 'click', 'w', '', '' FROM j WHERE k = 3
  UNION ALL SELECT id, 1, 'click', 'Open page', '', '' FROM j WHERE k = 5 UNION ALL SELECT id, 2, 'click', trim('Click ' || o), '', '' FROM j WHERE k = 5"""

_LINES = "lines AS (SELECT doc_id, doc_id % 7 AS k, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) AS l FROM documents)"
_TIGHT = r"trim(regexp_replace(regexp_replace(regexp_replace(x, '\s+([,.;:!?)\]])', '\1', 'g'), '([(\[])\s+', '\1', 'g'), '\s{2,}', ' ', 'g'))"

_PICK = """CASE WHEN len(p) = 0 THEN NULL WHEN paragraphs_all THEN array_to_string(p, chr(10) || chr(10)) WHEN range_from IS NOT NULL THEN CASE WHEN range_from >= 1 AND range_from <= len(p) THEN array_to_string(p[range_from:range_to], chr(10) || chr(10)) END
  WHEN paragraph_index IS NOT NULL THEN CASE WHEN paragraph_index = -1 THEN p[len(p)] WHEN paragraph_index BETWEEN 1 AND len(p) THEN p[paragraph_index] END WHEN wants_summary OR wants_definition THEN p[1] END"""
# Every task is answered by its own page; each site's rule says what it may ask and what the page gives.
_STATIC = f"""WITH {_intents(A.duck(SITE_TASKS))}, {_LINES},
  q AS (SELECT i.*, l.k, l.l, list_filter(l.l, lambda x: x <> '') AS words, paragraph_index IS NOT NULL OR range_from IS NOT NULL OR paragraphs_all OR wants_summary OR wants_definition AS ask,
    task <> '' AND NOT {_rx('task', '(?i)' + fixed.ACTION_WORDS)} AND NOT {_any('task', *fixed.ACTION_MARKERS)} AS plain, CASE WHEN top_n > 1 THEN top_n ELSE 1 END AS top FROM intents i JOIN lines l ON l.doc_id = i.page_id),
  e AS (SELECT *, plain AND CASE k WHEN 0 THEN ask AND NOT {_any('low', *fixed.INFOBOX_TERMS)} WHEN 1 THEN ask OR len(list_intersect(fl, ['title', 'author', 'abstract'])) > 0
      WHEN 2 THEN list_contains(fl, 'headline') OR top_n IS NOT NULL OR contains(low, 'story') WHEN 3 THEN ask WHEN 4 THEN wants_summary OR len(list_intersect(fl, ['title', 'version', 'author', 'license', 'description'])) > 0
      WHEN 5 THEN ask ELSE true END AS eligible, list_filter(l, lambda x: length(x) > CASE WHEN k = 0 AND len(list_filter(l, lambda y: length(y) > 80)) > 0 THEN 80 ELSE 40 END) AS raw,
    list_filter(fl, lambda x: x IN ('title', 'author', 'abstract', 'version', 'license', 'description')) AS asked, len(list_filter(fl, lambda x: x IN ('title', 'version', 'author', 'license', 'description'))) = 0 AS general FROM q),
  pr AS (SELECT *, list_transform(raw, lambda x: {_TIGHT}) AS p, array_to_string(words, ' ') AS whole,
    CASE WHEN len(asked) > 0 THEN asked WHEN k = 1 AND ask AND NOT wants_summary THEN ['abstract'] WHEN wants_summary THEN CASE k WHEN 1 THEN ['title', 'abstract'] ELSE ['title', 'version', 'description'] END ELSE [] END AS wanted FROM e),
  an AS (SELECT *, CASE WHEN NOT eligible THEN NULL WHEN k IN (0, 3) THEN {_PICK} WHEN k = 5 THEN CASE WHEN len(p) = 0 THEN CASE WHEN length(whole) > 80 THEN whole END ELSE {_PICK} END
    WHEN k = 1 THEN array_to_string(list_filter([CASE WHEN list_contains(wanted, 'title') THEN 'Title: On d' END, CASE WHEN list_contains(wanted, 'author') THEN 'Authors: A, B' END,
      CASE WHEN list_contains(wanted, 'abstract') AND trim(whole) <> '' THEN 'Abstract: ' || trim(regexp_replace(whole, '\\s{{2,}}', ' ', 'g')) END], lambda x: x IS NOT NULL), chr(10))
    WHEN k = 4 THEN array_to_string(list_filter([CASE WHEN list_contains(wanted, 'title') THEN CASE WHEN general THEN 'Package' ELSE 'Title' END || ': pkg' END, CASE WHEN list_contains(wanted, 'version') THEN 'Version: 1.2.3' END,
      CASE WHEN list_contains(wanted, 'author') THEN 'Author: Zed' END, CASE WHEN list_contains(wanted, 'license') THEN 'License: MIT' END,
      CASE WHEN list_contains(wanted, 'description') THEN CASE WHEN general THEN 'Summary' ELSE 'Description' END || ': A tool' END], lambda x: x IS NOT NULL), chr(10))
    WHEN k = 2 THEN CASE WHEN top > 1 THEN '1. ' ELSE 'Top story: ' END || 'First' || chr(10) || '   URL: u1' || CASE WHEN list_contains(fl, 'points') THEN chr(10) || '   Points: 17' ELSE '' END || CASE WHEN list_contains(fl, 'comments') THEN chr(10) || '   Comments: 4' ELSE '' END
      || CASE WHEN top > 1 THEN chr(10) || '2. Second' || chr(10) || '   URL: u2' ELSE '' END
    ELSE CASE WHEN {_any('low', *fixed.PLACEHOLDER_TERMS)} THEN {q(fixed.PLACEHOLDER_ANSWER)} WHEN length('Oops ' || page_id || CASE WHEN whole <> '' THEN ' ' || whole ELSE '' END) > 40 THEN 'Oops ' || page_id || CASE WHEN whole <> '' THEN ' ' || whole ELSE '' END END END AS answer FROM pr),
  st AS (SELECT task_id, ['wikipedia.org', 'arxiv.org', 'news.ycombinator.com', 'developer.mozilla.org', 'pypi.org', 'github.com', 'example.com'][k + 1] AS site, CASE WHEN trim(coalesce(answer, '')) <> '' THEN answer END AS answer FROM an),
  sv AS (SELECT *, CASE WHEN answer IS NULL THEN 'unanswered' WHEN starts_with(lower(trim(answer)), 'not_found:') THEN 'not_found' ELSE 'success' END AS status FROM st) """

ORACLE = {
    "static_answers": _STATIC + "SELECT task_id, site, status, md5(coalesce(answer, '')) AS answer_md5 FROM sv",
    "static_shares": _STATIC + """SELECT site, count(*) AS tasks, count(*) FILTER (WHERE status <> 'unanswered') AS hits, count(*) FILTER (WHERE status = 'not_found') AS not_found,
      count(*) FILTER (WHERE status <> 'unanswered') / count(*) AS hit_share FROM sv GROUP BY site""",
    "model_diagnosis": f"""SELECT id, CASE k WHEN 1 THEN 'selector_changed' WHEN 2 THEN 'page_not_loaded' WHEN 3 THEN 'captcha_detected' WHEN 4 THEN 'unexpected_popup' WHEN 5 THEN 'network_error' ELSE 'unknown' END AS root_cause,
      k <> 3 AS should_retry, 0.6::DOUBLE AS confidence, md5(CASE WHEN trim(diagnosis, ' ' || chr(10)) = '' THEN 'Try alternative approach' ELSE diagnosis END) AS recovery_md5
      FROM (SELECT d.*, (split_part(id, '-', 1)::BIGINT + split_part(id, '-', 2)::BIGINT) % 7 AS k FROM ({A.duck(DIAGNOSES)}) d) x""",
    "routed_pages": f"SELECT page_id, url, CASE {_SUFFIX} ELSE '' END AS site FROM (SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS h FROM ({A.duck(PAGES)}) p) x",
    "task_intents": f"WITH {_intents(A.duck(TASKS))} SELECT task_id, paragraph_index, range_from, range_to, paragraphs_all, wants_summary, wants_definition, strict_fields, top_n, fields FROM intents",
    "static_tasks": f"SELECT task_id, task FROM ({A.duck(TASKS)}) t WHERE task <> '' AND NOT {_rx('task', '(?i)' + fixed.ACTION_WORDS)} AND NOT {_any('task', *fixed.ACTION_MARKERS)}",
    "paragraph_answers": f"""WITH {_intents(A.duck(DOC_TASKS))}, ps AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS p FROM documents),
      an AS (SELECT task_id, CASE WHEN len(p) = 0 THEN NULL WHEN paragraphs_all THEN array_to_string(p, chr(10) || chr(10)) WHEN range_from IS NOT NULL THEN CASE WHEN range_from >= 1 AND range_from <= len(p) THEN array_to_string(p[range_from:range_to], chr(10) || chr(10)) END
        WHEN paragraph_index IS NOT NULL THEN CASE WHEN paragraph_index = -1 THEN p[len(p)] WHEN paragraph_index BETWEEN 1 AND len(p) THEN p[paragraph_index] END WHEN wants_summary OR wants_definition THEN p[1] END AS answer
      FROM intents JOIN ps ON doc_id = page_id) SELECT task_id, md5(coalesce(answer, '<none>')) AS answer_md5 FROM an""",
    "page_digests": f"""SELECT page_id, md5(t) AS digest_md5, contains(a, 'button') AS has_buttons,
      contains(a, 'textbox') OR contains(a, 'searchbox') AS has_inputs, contains(a, 'link') AS has_links FROM (SELECT page_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, lower(a11y) AS a FROM ({A.duck(DIGEST)}) d) x""",
    "verified_steps": f"WITH {_VERIFY} SELECT *, confidence < 0.4::DOUBLE AS low_confidence FROM vh",
    "failure_triage": f"WITH {_TRIAGE} SELECT trace_id, step_number, root_cause, should_retry, confidence FROM triaged",
    "triage_counts": f"WITH {_TRIAGE} SELECT root_cause, count(*) AS failures, count(*) FILTER (WHERE should_retry) AS retryable, count(*) FILTER (WHERE should_retry) / count(*) AS retryable_share FROM triaged GROUP BY root_cause",
    "recovery_actions": f"""WITH {_TRIAGE}, ra AS (SELECT root_cause, CASE root_cause WHEN 'unexpected_popup' THEN 'click' WHEN 'element_hidden' THEN 'scroll' WHEN 'page_not_loaded' THEN 'wait' WHEN 'element_not_found' THEN action_type ELSE '' END AS alt_action,
        CASE root_cause WHEN 'unexpected_popup' THEN 'close button or dismiss popup' WHEN 'element_hidden' THEN target WHEN 'page_not_loaded' THEN 'page to load'
          WHEN 'element_not_found' THEN CASE step_number % 3 WHEN 0 THEN 'button Submit' WHEN 1 THEN 'textbox Customer' ELSE target END ELSE '' END AS alt_target FROM triaged) SELECT *, count(*) AS steps FROM ra GROUP BY ALL""",
    "stuck_loops": f"""WITH st AS (SELECT trace_id, step_number, action_type || ': ' || target AS action, url FROM ({A.duck(STEPS)}) x),
      g AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY step_number) - row_number() OVER (PARTITION BY trace_id, action, url ORDER BY step_number) AS isl FROM st)
      SELECT trace_id, count(*) AS length, min(step_number) AS first_step, max(step_number) AS last_step, action, url FROM g GROUP BY trace_id, action, url, isl HAVING count(*) >= 2""",
    "repeated_steps": f"""WITH st AS (SELECT trace_id, step_number, action_type || ': ' || target AS action, url FROM ({A.duck(STEPS)}) x),
      g AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY step_number) - row_number() OVER (PARTITION BY trace_id, action, url ORDER BY step_number) AS isl FROM st)
      SELECT trace_id, count(*) AS length, min(step_number) AS first_step, max(step_number) AS last_step, action, url FROM g GROUP BY trace_id, action, url, isl HAVING count(*) >= 2""",
    "guarded_runs": f"WITH {_GUARD} SELECT trace_id, status, guarded_status, guard_mode FROM guarded",
    "run_summary": _SUMMARY + "SELECT trace_id, status, fast_path_hit, total_steps, healer_activations, final_url, total_duration_ms, failed_steps, llm_calls, cost_usd, healer_activations AS self_corrections FROM sm",
    "fast_path_share": _SUMMARY + """SELECT count(*) AS runs, count(*) FILTER (WHERE fast_path_hit) AS fast_path_runs, count(*) FILTER (WHERE fast_path_hit) / count(*) AS fast_path_share,
      round(avg(cost_usd) FILTER (WHERE NOT fast_path_hit) * count(*) FILTER (WHERE fast_path_hit), 6) AS cost_saved_usd FROM sm""",
    "run_score_checks": _RUNCHECK + "SELECT case_id, name, passed FROM ck",
    "run_scores": _RUNCHECK + "SELECT case_id, bool_and(passed) AS passed, count(*) AS checks, count(*) FILTER (WHERE NOT passed) AS failed_checks FROM ck GROUP BY case_id",
    "filing_scores": O.chain(*O.FULL, O.FIXED, O.ISSUES, O.REPORT, """verdict AS (SELECT c.filing_id, found > 0 AND coalesce(n_required, 0) = 0 AND coalesce(errors, 0) = 0 AS ok FROM coverage c LEFT JOIN gone g ON g.filing_id = c.filing_id LEFT JOIN tally t ON t.filing_id = c.filing_id)""",
        """per AS (SELECT filing_id, count(*) AS items_returned, count(*) FILTER (WHERE status <> 'not_found' AND (trim(content_text) <> '' OR status <> 'extracted')) AS items_extracted, count(*) FILTER (WHERE status = 'extracted') AS n_extracted,
          count(*) FILTER (WHERE status = 'incorporated_by_reference') AS n_incorporated_by_reference, count(*) FILTER (WHERE status = 'not_applicable') AS n_not_applicable, count(*) FILTER (WHERE status = 'reserved') AS n_reserved,
          count(*) FILTER (WHERE status = 'not_found') AS n_not_found, coalesce(string_agg(item_number, ',' ORDER BY item_number) FILTER (WHERE status = 'not_found' AND item_number NOT IN ('1C', '9C')), '') AS missing_items,
          round(coalesce(sum(confidence::DECIMAL(12,6)) FILTER (WHERE confidence > 0)::DOUBLE / nullif(count(*) FILTER (WHERE confidence > 0), 0), 0), 3) AS avg_confidence,
          max(CASE WHEN item_number = '6' THEN status END) AS s6, max(CASE WHEN item_number = '1' THEN status END) AS s1, max(CASE WHEN item_number = '7' THEN status END) AS s7, max(CASE WHEN item_number = '1A' THEN status END) AS s1a FROM fixed_items GROUP BY filing_id)""") + """SELECT *,
          CASE WHEN passed THEN '' WHEN items_extracted = 0 THEN 'parsing_error' WHEN missing_items <> '' THEN 'missing_section' ELSE 'parsing_error' END AS failure_type FROM (
        SELECT p.filing_id AS case_id, items_extracted >= p.filing_id % 22 AND s6 = 'reserved' AND ok AND CASE WHEN p.filing_id % 3 = 0 THEN s1 <> 'not_found' AND s7 <> 'not_found' ELSE s1a <> 'not_found' END AS passed,
          CASE WHEN p.filing_id % 3 = 0 THEN 5 ELSE 4 END AS checks, items_returned, items_extracted, n_extracted, n_incorporated_by_reference, n_not_applicable, n_reserved, n_not_found, avg_confidence, missing_items
        FROM per p JOIN verdict v ON v.filing_id = p.filing_id) z""",
    "parsed_outputs": _JSON + "SELECT id, model, object_json, array_json FROM j",
    "block_outputs": _JSON + "SELECT id, model, object_json, array_json FROM j",
    "parse_failure_rates": _JSON + "SELECT model, count(*) AS outputs, count(*) FILTER (WHERE object_json = '' AND array_json = '') AS failures, count(*) FILTER (WHERE object_json = '' AND array_json = '') / count(*) AS failure_rate FROM j GROUP BY model",
    "output_verdicts": _JSON + """SELECT id, model, CASE WHEN object_json <> '' THEN k = 0 ELSE k = 4 END AS complete, (CASE WHEN k = 0 THEN 0.9 WHEN object_json <> '' THEN 0.5 WHEN k = 4 THEN 0.7 ELSE 0.3 END)::DOUBLE AS confidence,
      md5(CASE WHEN k IN (0, 6) THEN text WHEN object_json <> '' THEN '' WHEN k = 3 THEN array_json WHEN k = 4 THEN trim('Yes, task is complete: ' || text, chr(10) || ' ') WHEN k = 5 THEN trim('1. Open page' || chr(10) || '2) Click ' || o, chr(10) || ' ')
        WHEN k = 7 THEN trim('broken {"a": ' || text, chr(10) || ' ') WHEN k = 8 THEN trim('note [1, 2] end ' || text, chr(10) || ' ') ELSE trim(text, chr(10) || ' ') END) AS answer_md5 FROM j""",
    "planned_steps": _JSON + f"SELECT id, step_no, action_type, md5(target || '|' || value) AS step_md5 FROM ({_STEPS_SQL}) x",
    "executable_plans": _JSON + f""", s AS ({_STEPS_SQL}), url AS (SELECT id, k, conv_id, CASE WHEN conv_id % 2 = 0 THEN 'https://x.org/' || conv_id END AS u, 'https://www.bing.com/search?q=find+' || turn AS web, k IN (2, 3, 5) AS has FROM j)
      SELECT s.id, (s.step_no + CASE WHEN conv_id % 2 = 0 AND k <> 2 THEN 1 ELSE 0 END)::INT AS step_no, action_type, md5(target || '|' || value) AS step_md5, '' AS success_criteria FROM s JOIN url ON url.id = s.id
      UNION ALL SELECT id, 1, 'navigate', md5('Navigate to ' || u || '|' || u), 'Page loads successfully' FROM url WHERE u IS NOT NULL AND k <> 2
      UNION ALL SELECT id, 1, 'navigate', md5('Search the web for the requested page/data|' || web), 'Search results loaded' FROM url WHERE NOT has AND u IS NULL
      UNION ALL SELECT id, 2, 'wait', md5('Search results|1200'), 'Search page is stable enough to observe' FROM url WHERE NOT has AND u IS NULL""",
    "single_actions": _JSON + """SELECT id, CASE WHEN k = 3 THEN 'key_press' ELSE 'done' END AS action_type, md5(CASE WHEN k = 3 THEN 'w|' || t WHEN object_json = '' AND (contains(lower(raw), 'done') OR contains(lower(raw), 'task complete') OR contains(lower(raw), 'finished'))
      THEN '|' || trim(raw, chr(10) || ' ') ELSE '|' END) AS action_md5 FROM (SELECT *, CASE k WHEN 4 THEN 'Yes, task is complete: ' || text WHEN 5 THEN '1. Open page' || chr(10) || '2) Click ' || o WHEN 7 THEN 'broken {"a": ' || text WHEN 8 THEN 'note [1, 2] end ' || text ELSE text END AS raw FROM j) r""",
    "unwrapped_answers": _JSON + """SELECT id, md5(CASE k WHEN 0 THEN trim(text, chr(10) || ' ') WHEN 1 THEN object_json WHEN 2 THEN 'Here: ' || object_json || ' done' WHEN 3 THEN array_json WHEN 4 THEN trim('Yes, task is complete: ' || text, chr(10) || ' ')
      WHEN 5 THEN trim('1. Open page' || chr(10) || '2) Click ' || o, chr(10) || ' ') WHEN 6 THEN '{“answer”: “' || t || '”}' WHEN 7 THEN trim('broken {"a": ' || text, chr(10) || ' ') WHEN 8 THEN trim('note [1, 2] end ' || text, chr(10) || ' ')
      WHEN 9 THEN object_json || ' tail' ELSE trim(text, chr(10) || ' ') END) AS answer_md5 FROM j""",
    # The pages' text lines in order, as a reader of the page sees them.
    "site_paragraphs": f"""WITH {_LINES}, p AS (SELECT doc_id, k, l, CASE WHEN k = 0 AND len(list_filter(l, lambda x: length(x) > 80)) > 0 THEN 80 ELSE 40 END AS least FROM lines WHERE k IN (0, 3, 5)),
      f AS (SELECT doc_id, list_filter(l, lambda x: length(x) > least) AS f, array_to_string(list_filter(l, lambda x: x <> ''), ' ') AS whole, k FROM p)
      SELECT doc_id AS page_id, unnest(range(1, len(f) + 1))::INT AS n, md5(unnest(list_transform(f, lambda x: {_TIGHT}))) AS text_md5 FROM f
      UNION ALL SELECT doc_id, 0, md5(whole) FROM f WHERE k = 5 AND len(f) = 0 AND length(whole) > 80""",
    "page_fields": f"""WITH {_intents(A.duck(SITE_TASKS))}, {_LINES}, w AS (SELECT task_id, doc_id, k, l, list_filter(fl, lambda x: x IN ('title', 'author', 'abstract', 'version', 'license', 'description')) AS asked, wants_summary,
        paragraph_index IS NOT NULL OR range_from IS NOT NULL OR paragraphs_all OR wants_summary OR wants_definition AS para FROM intents JOIN lines ON doc_id = page_id WHERE k IN (1, 4)),
      c AS (SELECT *, unnest(CASE WHEN len(asked) > 0 THEN asked WHEN k = 1 AND para AND NOT wants_summary THEN ['abstract'] WHEN wants_summary THEN CASE k WHEN 1 THEN ['title', 'abstract'] ELSE ['title', 'version', 'description'] END ELSE [] END) AS field FROM w),
      v AS (SELECT task_id, field, CASE WHEN k = 1 THEN CASE field WHEN 'title' THEN 'On d' WHEN 'author' THEN 'A, B' WHEN 'abstract' THEN trim(regexp_replace(array_to_string(list_filter(l, lambda x: x <> ''), ' '), '\\s{{2,}}', ' ', 'g')) END
        ELSE CASE field WHEN 'title' THEN 'pkg' WHEN 'version' THEN '1.2.3' WHEN 'description' THEN 'A tool' WHEN 'license' THEN 'MIT' WHEN 'author' THEN 'Zed' END END AS value FROM c)
      SELECT task_id, field, md5(value) AS value_md5 FROM v WHERE value <> ''""",
    "listing_rows": f"""WITH {_intents(A.duck(SITE_TASKS))}, t AS (SELECT task_id, CASE WHEN top_n > 1 THEN top_n ELSE 1 END AS top, list_contains(fl, 'points') AS wp, list_contains(fl, 'comments') AS wc FROM intents WHERE page_id % 7 = 2)
      SELECT task_id, n, title, url, CASE WHEN wp AND n = 1 THEN 17 ELSE -1 END AS points, CASE WHEN wc AND n = 1 THEN 4 ELSE -1 END AS comments FROM t, (VALUES (1, 'First', 'u1'), (2, 'Second', 'u2')) r(n, title, url) WHERE n <= top""",
    "data_blocks": """SELECT doc_id AS task_id, CASE WHEN doc_id % 7 = 0 THEN 'extract_infobox' ELSE 'extract_no_match' END AS kind, CASE WHEN doc_id % 7 = 0 THEN 'Population 12345' ELSE '' END AS text FROM documents""",
    "page_errors": f"""SELECT host, count(*) AS pages, count(*) FILTER (WHERE doc_id % 7 = 6) AS errors, count(*) FILTER (WHERE doc_id % 7 = 6) AS pages_with_errors
      FROM (SELECT doc_id, ['en.wikipedia.org', 'arxiv.org', 'news.ycombinator.com', 'developer.mozilla.org', 'pypi.org', 'github.com', 'example.com'][doc_id % 7 + 1] AS host FROM documents) x GROUP BY host""",
}
