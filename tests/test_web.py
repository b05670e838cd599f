"""Intents, paragraphs, fields, listings, answers, run checks, model outputs."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import filing_text as T
from paperloom.operators import intents as I
from paperloom.operators import model_outputs as M
from paperloom.operators import page_content as P
from paperloom.operators import runs as R

PAGE = "struct<url:string,title:string,text:string,a11y:string,errors:array<string>>"
STEP = f"trace_id string, step_number bigint, action_type string, target string, value string, before {PAGE}, after {PAGE}, error string, duration_ms double"


def page(url="https://x.org/a", text="", errors=()):
    return (url, "", text, "", list(errors))


INTENTS = [
    ("Give me the first paragraph", dict(paragraph_index=1)), ("paragraphs 4 to 2", dict(range_from=2, range_to=4)), ("first 3 paragraphs", dict(range_from=1, range_to=3)),
    ("the last paragraph", dict(paragraph_index=-1)), ("12th paragraph", dict(paragraph_index=12)), ("the whole article", dict(paragraphs_all=True)),
    ("What are the authors of this paper?", dict(wants_summary=False, strict_fields=True, requested_fields=["author"])), ("summarize it", dict(wants_summary=True)),
    ("top 5 stories", dict(top_n=5)), ("only title and abstract", dict(strict_fields=True, requested_fields=["title", "abstract"])), ("第一段", dict(paragraph_index=1)), ("什麼是 Spark", dict(wants_summary=True)),
]


def test_intents(spark):
    rows = I.parse_intents(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(INTENTS)], "task_id int, task string")).collect()
    for r in rows:
        for field, value in INTENTS[r["task_id"]][1].items():
            assert r[field] == value, (r["task"], field)


def test_static_filter(spark):
    tasks = ["click the button", "extract the title", "登入到該網站", "", "search for cats", "read the intro"]
    kept = I.filter_static(spark.createDataFrame([(t,) for t in tasks], "task string")).collect()
    assert [r["task"] for r in kept] == ["extract the title", "read the intro"]


def test_paragraph_choice(spark):
    paras = spark.createDataFrame([(1, 1, "one"), (1, 2, "two"), (1, 3, "three")], "page_id int, n int, text string")
    want = {"paragraphs 2-9": "two\n\nthree", "paragraph 9": None, "last paragraph": "three", "all paragraphs": "one\n\ntwo\n\nthree", "paragraphs 7 to 8": None, "describe": "one", "hello": None}
    tasks = spark.createDataFrame([(i, t, 1) for i, t in enumerate(want)], "task_id int, task string, page_id int")
    got = {r["task_id"]: r["answer"] for r in I.answer_from_paragraphs(I.parse_intents(tasks), paras).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


def test_routing(spark):
    urls = {"https://en.wikipedia.org/wiki/A": "wikipedia.org", "https://notwikipedia.org/": None, "HTTP://PyPI.org:443/x": "pypi.org", "nonsense": None}
    rows = I.route_pages(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    assert {r["url"]: r["site"] for r in rows} == urls


LONG = "A long paragraph about ( many ) things , told at length so that it is certainly over eighty characters ."


def test_paragraph_table_skips_furniture(spark):
    html = f"<body><nav><p>{LONG}</p></nav><article><p>{LONG}<p class='note'>{LONG}</p><p>short</p><div><p>{LONG}</p></div></article></body>"
    rows = P.page_paragraphs(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()
    assert [r["text"] for r in rows] == ["A long paragraph about (many) things, told at length so that it is certainly over eighty characters."]


def test_html_normalization(spark):
    html = "<html><head><title>t</title></head><body><ix:header>x</ix:header><div style='display:none'>h</div><h1>Item 1.  Business</h1><p>One <b>two</b><br>three</p><!-- c --><script>s</script></body></html>"
    text = T.normalize_html(spark.createDataFrame([("a", html)], "filing_id string, content string")).first()["text"]
    assert text == "Item 1. Business\n\n\nOne\ntwo\n\n\nthree"


def test_submission_choice(spark):
    sgml = "H" * 30_000 + "<DOCUMENT><TYPE>EX-99\n<TEXT>exhibit</TEXT></DOCUMENT>\n<DOCUMENT>\n<TYPE>10-K\n<TEXT>\nmain\n</TEXT></DOCUMENT>"
    rows = spark.createDataFrame([("a", sgml), ("b", "plain"), ("c", "<DOCUMENT><TYPE>EX-1\nonly</DOCUMENT>")], "filing_id string, content string")
    assert {r["filing_id"]: r["content"] for r in T.primary_document(rows).collect()} == {"a": "main", "b": "plain", "c": "<TYPE>EX-1\nonly"}


def test_static_answers(spark):
    wiki = f"<div id='mw-content-text'><div class='mw-parser-output'><table class='infobox'><tr><td>x</td></tr></table><p>{LONG}</p><p>{LONG[:-1]} two.</p></div></div>"
    paper = "<h1 class='title'>Title: T</h1><div class='authors'>Authors: A, B</div><blockquote class='abstract'>Abstract: Abs</blockquote>"
    news = "<table><tr class='athing'><td><span class='titleline'><a href='u1'>First</a></span></td></tr><tr><td>7 points | 2 comments</td></tr></table>"
    pack = "<h1 class='package-header__name'>req 2.1</h1><p class='package-description__summary'>S</p><aside><p>License Expression: MIT</p><p>Author: Z</p></aside>"
    pages = spark.createDataFrame([
        (1, "https://en.wikipedia.org/wiki/A", wiki), (2, "https://arxiv.org/abs/1", paper), (3, "https://news.ycombinator.com/", news),
        (4, "https://pypi.org/project/req/", pack), (5, "https://example.com/", "<p>This domain is for use in illustrative examples in documents.</p>")], "page_id int, url string, html string")
    tasks = [(1, "the second paragraph", "https://en.wikipedia.org/wiki/A"), (2, "who are the authors", "https://arxiv.org/abs/1"), (3, "top story with points", "https://news.ycombinator.com/"),
             (4, "license and version", "https://pypi.org/project/req/"), (5, "find the contact email", "https://example.com/"), (6, "read the infobox", "https://en.wikipedia.org/wiki/A"),
             (7, "click it", "https://example.com/"), (8, "describe it", "https://pypi.org/project/req/"), (9, "first paragraph", "https://nowhere.net/")]
    intents = I.parse_intents(spark.createDataFrame(tasks, "task_id int, task string, target_url string"))
    got = {r["task_id"]: (r["status"], r["answer"]) for r in P.answer_static(intents, pages).collect()}
    assert got[1][0] == "success" and got[1][1].endswith("two.")
    assert got[2] == ("success", "Authors: A, B")
    assert got[3] == ("success", "Top story: First\n   URL: u1\n   Points: 7")
    assert got[4] == ("success", "Version: 2.1\nLicense: MIT")
    assert got[5][0] == "not_found"
    assert {got[i][0] for i in (6, 7, 9)} == {"unanswered"}
    assert got[8] == ("success", "Package: req\nVersion: 2.1\nSummary: S")


def test_listing_and_blocks_and_errors(spark):
    html = "<div class='error'>Bad</div><div role='alert'>Alert</div><table><tr><td>Revenue</td><td>1234</td></tr></table><li>Population 99</li>"
    pages = spark.createDataFrame([(1, "https://a.b/c", html)], "page_id int, url string, html string")
    assert [r["message"] for r in P.page_errors(pages).orderBy("n").collect()] == ["Bad", "Alert"]
    tasks = spark.createDataFrame([(1, 1, "get revenue"), (2, 1, "population of it"), (3, 1, "weather")], "task_id int, page_id int, description string")
    got = {r["task_id"]: r["kind"] for r in P.extract_blocks(pages, tasks).collect()}
    assert got == {1: "extract_table", 2: "extract_kv", 3: "extract_no_match"}


@pytest.mark.parametrize("error,text,errors,url,cause,retry", [
    ("Timeout 30s waiting for locator", "", [], "u", "element_not_found", True), ("net::ERR_ABORTED", "", [], "u", "network_error", True), ("element is hidden", "cookie", [], "u", "unexpected_popup", True),
    ("429 Too Many Requests", "", [], "u", "network_error", True), ("403", "", [], "u", "captcha_detected", False), ("frame was detached", "", [], "u", "page_not_loaded", True),
    ("strict mode violation: resolved to 2 elements", "", [], "u", "selector_ambiguous", True), ("weird", "", [], "about:blank", "page_not_loaded", True), ("weird", "", [], "u", "unknown", True)])
def test_triage(spark, error, text, errors, url, cause, retry):
    r = R.triage_failures(spark.createDataFrame([("t", 1, "click", "b", "", page(), page(url, text, errors), error, 1.0)], STEP)).first()
    assert (r["root_cause"], r["should_retry"]) == (cause, retry)


def test_verification(spark):
    rows = [("t", 1, "navigate", "x", "", page("a"), page("b"), "", 1.0), ("t", 2, "click", "x", "", page("a"), page("a"), "", 1.0),
            ("t", 3, "fill", "x", "", page("a"), page("a", errors=["no"]), "", 1.0), ("t", 4, "fill", "x", "", page("a", errors=["no"]), page("a", errors=["no"]), "", 1.0)]
    got = {r["step_number"]: (r["success"], r["confidence"]) for r in R.verify_steps(spark.createDataFrame(rows, STEP)).collect()}
    assert got == {1: (True, 0.9), 2: (False, 0.4), 3: (False, 0.2), 4: (True, 0.7)}


RUNS = [
    ("hedge", "success", "I cannot find it", "u", "text", "not_found", "hedged_answer"), ("zh", "success", "頁面不存在", "u", "text", "not_found", "hedged_answer"),
    ("made_up", "success", "It is 22850 or 23,420", "u", "nothing like it", "unverified", "ungrounded_numbers:['22850', '23,420']"), ("grounded", "success", "It is 22,850", "u", "total 22850", "success", None),
    ("one_ok", "success", "11 and 99", "u", "99", "success", None), ("blank", "success", "It is 4242", "u", "", "success", None), ("wall", "partial", "done", "https://x/login?next", "t", "not_found", "blocked_url:/login?"),
    ("partial", "partial", "I cannot find it", "u", "t", "partial", None),
]


def test_guard(spark):
    runs = spark.createDataFrame([(t, s, a) for t, s, a, *_ in RUNS], "trace_id string, status string, final_answer string")
    steps = spark.createDataFrame([(t, 1, "read", "", "", None, page(u, x), "", 1.0) for t, _, _, u, x, *_ in RUNS], STEP)
    got = {r["trace_id"]: (r["guarded_status"], r["guard_mode"]) for r in R.guard_runs(runs, steps).collect()}
    assert got == {t: (status, mode) for t, *_, status, mode in RUNS}


def test_stuck_loops(spark):
    rows = [("a", i, "click", "b", "", None, page("u"), "", 1.0) for i in range(4)] + [("b", i, "click", "b", "", None, page(f"u{i}"), "", 1.0) for i in range(4)] + [
        ("c", i, "click", f"t{i % 2}", "", None, page("u"), "", 1.0) for i in range(6)]
    got = [(r["trace_id"], r["length"], r["first_step"], r["last_step"]) for r in R.stuck_loops(spark.createDataFrame(rows, STEP)).collect()]
    assert got == [("a", 4, 0, 3)]


@pytest.mark.parametrize("text,want", [("Click [button] 'Submit'", "button Submit"), ("use role=textbox name='Customer'", "textbox Customer"), ("the link labelled 'Next'", "link Next"),
                                       ("Click the Submit button", "Submit button"), ("", "old"), ("no idea", "old")])
def test_recovery_target(spark, text, want):
    assert spark.createDataFrame([(text, "old")], "r string, f string").select(R.recovery_target(F.col("r"), F.col("f"))).first()[0] == want


OUTPUTS = [
    ('{"a": 1}', '{"a": 1}', None), ('```json\n{"a": 1}\n```', '{"a": 1}', None), ('Here: {"a": {"b": "}"}} ok {"c": 2}', '{"a": {"b": "}"}}', None), ("{“a”: 1}", '{"a": 1}', None),
    ("garbage", None, None), ("", None, None), ("[1, 2]", None, "[1, 2]"), ("note [1] end", None, "[1]"), ('{"a": ', None, None),
]


def test_output_json(spark):
    df = spark.createDataFrame([(i, "m", raw) for i, (raw, *_) in enumerate(OUTPUTS)], "id int, model string, raw string")
    got = {r["id"]: (r["object_json"], r["array_json"]) for r in M.parse_outputs(df).collect()}
    assert got == {i: (o, a) for i, (_, o, a) in enumerate(OUTPUTS)}
    rate = M.parse_failure_rates(M.parse_outputs(df)).first()
    assert (rate["outputs"], rate["failures"]) == (9, 3)


@pytest.mark.parametrize("raw,complete,conf", [('{"complete": true, "answer": "x", "confidence": 0.8}', True, 0.8), ('{"complete": false}', False, 0.5), ("Yes, task is complete", True, 0.7),
                                               ("The task is incomplete", False, 0.3), ("completed nothing", False, 0.3)])
def test_verdicts(spark, raw, complete, conf):
    r = M.verdicts(M.parse_outputs(spark.createDataFrame([(1, raw)], "id int, raw string"))).first()
    assert (r["complete"], r["confidence"]) == (complete, conf)


def test_answers_and_plans(spark):
    raw = ['```json\n{"answer": " x "}\n```', '{"value": "v"}', "plain", '{"answer": 5, "final_answer": "f"}']
    rows = M.unwrap_answers(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "id int, final_answer string")).orderBy("id").collect()
    # A truthy answer that is no text is not unwrapped.
    assert [r["answer"] for r in rows] == ["x", "v", "plain", raw[3]]
    plans = ['[{"action": "goto", "target": "a"}, {"action": "dance"}]', '{"steps": [{"action_type": "type", "value": "v"}]}', "1. Open it\n2) Read it\nnot a step"]
    df = M.plan_steps(M.parse_outputs(spark.createDataFrame([(i, r) for i, r in enumerate(plans)], "id int, raw string")))
    got = [(r["id"], r["step_no"], r["action_type"], r["target"]) for r in df.orderBy("id", "step_no").collect()]
    assert got == [(0, 1, "navigate", "a"), (0, 2, "click", ""), (1, 1, "fill", ""), (2, 1, "click", "Open it"), (2, 2, "click", "Read it")]


def test_plans_without_a_model_answer(spark):
    from urllib.parse import quote_plus

    tasks = [("a", "open https://x.org/p?q=1). now", ""), ("b", "find ~tilde* & more ü", None), ("c", "TAIEX today", ""), ("d", "  ", ""), ("e", "t", "https://s.org"), ("f", "t", "https://s.org"), ("g", "t", "")]
    outputs = [("e", '[{"action": "click", "target": "b"}]'), ("f", '[{"action": "goto", "target": "p"}]'), ("g", "1. Click it"), ("a", "nothing"), ("b", ""), ("c", "x"), ("d", "x")]
    parsed = M.parse_outputs(spark.createDataFrame(outputs, "id string, raw string"))
    rows = M.executable_plans(spark.createDataFrame(tasks, "id string, task string, start_url string"), parsed).orderBy("id", "step_no").collect()
    got = {}
    for r in rows:
        got.setdefault(r["id"], []).append((r["action_type"], r["value"] if r["action_type"] == "navigate" else r["target"]))
    search = "https://www.bing.com/search?q="
    assert got == {"a": [("navigate", "https://x.org/p?q=1")], "b": [("navigate", search + quote_plus("find ~tilde* & more ü")), ("wait", "Search results")],
                   "c": [("navigate", "https://tw.stock.yahoo.com/quote/%5ETWII"), ("wait", "Search results")], "d": [("navigate", search + "browser+automation+task"), ("wait", "Search results")],
                   "e": [("navigate", "https://s.org"), ("click", "b")], "f": [("navigate", "")], "g": [("click", "Click it")]}


def test_single_actions(spark):
    raws = ['{"action": "type", "target": "box", "value": "x"}', 'so {"action_type": "Click", "target_description": "ok"} then', '{"action": "fill", "target": "cut of', "I am done here ", "no idea", '{"note": 1}', None]
    rows = M.single_actions(M.parse_outputs(spark.createDataFrame(list(enumerate(raws)), "id int, raw string"))).collect()
    got = {r["id"]: (r["action_type"], r["target"], r["value"]) for r in rows}
    assert got == {0: ("fill", "box", "x"), 1: ("click", "ok", ""), 2: ("fill", "", ""), 3: ("done", "", "I am done here"), 4: ("done", "", ""), 5: ("done", "", ""), 6: ("done", "", "")}


def test_the_query_gives_loops_of_two(spark, monkeypatch):
    from paperloom.plans import web

    rows = [("a", i, "click", "b", "", None, page("u"), "", 1.0) for i in range(2)] + [("b", i, "click", f"t{i}", "", None, page("u"), "", 1.0) for i in range(2)]
    monkeypatch.setattr(web, "_steps", lambda s, d: s.createDataFrame(rows, STEP))
    assert [(r["trace_id"], r["length"]) for r in web.QUERIES["stuck_loops"](spark, "").collect()] == [("a", 2)]
    assert web.ORACLE["stuck_loops"] == web.ORACLE["repeated_steps"]


def test_filing_scores_makes_the_items_once(spark, tmp_path, monkeypatch):
    """Three branches read the items; their patterns run in none of them. Null, empty and repeated documents among them."""
    from paperloom.plans import web

    docs = [(i, f"Text {i} of a filing, long enough to be cut. " * (i % 40) if i % 9 else None) for i in range(40)] + [(7, "again"), (None, "x")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = web.QUERIES["filing_scores"](spark, str(tmp_path))
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(str, found.collect()))
    # The same with whole contents that every branch makes for itself.
    monkeypatch.setattr(web, "kept", lambda df, name: df)
    monkeypatch.setattr(web, "left", lambda c, n: c)
    monkeypatch.setattr(web, "strip", F.col)
    whole = web.QUERIES["filing_scores"](spark, str(tmp_path))
    assert "ArrowEvalPython" in whole._jdf.queryExecution().executedPlan().toString()
    assert got == sorted(map(str, whole.collect())) and len(got) >= 40
