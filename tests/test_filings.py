"""Boundary detection and items on small made-up reports."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import boundaries as B
from paperloom.operators import facts as X
from paperloom.operators import filing_index as N
from paperloom.operators import html_anchors as H
from paperloom.operators import items as I
from paperloom.operators import refine as R

FILLER = "Plain prose about widgets and their makers goes on here. "
BODY = "\n".join(
    ["ANNUAL REPORT", "Table of Contents", "Item 1. Business 3", "Item 7. Management's Discussion and Analysis 9", FILLER * 12,
     "PART I", "Item 1. Business", FILLER * 20, "Item 1A.", "Risk Factors", FILLER * 20, "PART II", "ITEM 3. LEGAL PROCEEDINGS", "None.",
     "Item 6. [Reserved]", "[Reserved]", "Item 7. Management's Discussion and Analysis", FILLER * 20,
     "Item 10. Directors, Executive Officers and Corporate Governance",
     "The information is incorporated herein by reference to the Proxy Statement.", "Item 15. Exhibits", FILLER * 3])
TITLES = FILLER * 10 + "\n\nRISK FACTORS\n" + FILLER * 10 + "see\nLegal Proceedings\n" + FILLER * 10 + ".\n| Properties |\n" + FILLER * 30
COVER = "preamble " * 250 + "\n1B.\nUnresolved Staff Comments\nNot Applicable\n6.\nReserved\n9.\nChanges in Accountants\n*\n10.\nDirectors\n4\n11.\nExecutive Compensation\n12-14\n" + FILLER * 600
MASTER = ("Portions of the proxy statement are incorporated by reference into this report in response to Items 10, 11, 12, 13 and 14 of Part III. "
          + "filler " * 10_000)
INDEX = "filler text here. " * 1000 + "\nItem 1B.\nUnresolved Staff Comments\nNone\n\nItem 4.\nMine Safety Disclosures\nNone\n\nItem 6.\n[Reserved]\n"


@pytest.fixture(scope="module")
def texts(spark):
    rows = [("body", BODY), ("titles", TITLES), ("cover", COVER), ("master", MASTER), ("index", INDEX), ("empty", "nothing at all")]
    return spark.createDataFrame(rows, "filing_id string, text string")


@pytest.fixture(scope="module")
def items(texts):
    rows = I.extract_items(texts).collect()
    out = {}
    for r in rows:
        out.setdefault(r["filing_id"], {})[r["item_number"]] = r
    return out


def test_every_filing_has_all_items_in_order(items):
    for found in items.values():
        assert [r["item_number"] for r in sorted(found.values(), key=lambda r: r["ord"])] == B.ITEM_NUMBERS


def test_body_statuses(items):
    got = {n: r["status"] for n, r in items["body"].items() if r["range_end"]}
    assert got == {"1": "extracted", "1A": "extracted", "3": "not_applicable", "6": "reserved", "7": "extracted",
                   "10": "incorporated_by_reference", "15": "extracted"}


def test_body_heading_beats_contents_line(items):
    assert items["body"]["1"]["range_start"] > BODY.index("PART I") - 2
    assert items["body"]["1"]["content_text"].startswith("Plain prose")
    assert items["body"]["1"]["confidence"] == pytest.approx(1.0)


def test_positions_are_text_offsets(items):
    r = items["body"]["1A"]
    assert BODY[r["range_start"]:r["range_end"]].strip().startswith("Item 1A.\nRisk Factors")


def test_single_match_in_contents_region_is_doubted(spark):
    text = "Table of Contents\nItem 2. Properties 12\n" + FILLER * 100
    row = B.resolve_headings(B.candidates(spark.createDataFrame([("a", text)], "filing_id string, text string"))).collect()[0]
    assert (row["source"], row["confidence"]) == ("heading_regex_toc_suspect", 0.40)


def test_title_fallback(texts):
    rows = {r["item_number"]: r for r in B.detect_title_only(B.candidates(texts.filter("filing_id = 'titles'"))).collect()}
    # "see" before a title is mid-sentence, so that hit is refused.
    assert set(rows) == {"1A", "2"}
    assert rows["1A"]["confidence"] == pytest.approx(0.65) and rows["2"]["confidence"] == pytest.approx(0.60)
    assert rows["2"]["heading_text"] == "Properties"
    assert TITLES[rows["1A"]["start_pos"]:].lstrip().startswith("RISK FACTORS")


def test_cover_table(texts):
    rows = {r["item_number"]: (r["status_hint"], r["page_note"]) for r in B.cover_table(B.candidates(texts.filter("filing_id = 'cover'"))).collect()}
    assert rows == {"1B": ("not_applicable", "Not Applicable"), "6": ("reserved", ""), "9": ("incorporated_by_reference", "*"),
                    "10": ("extracted", "4"), "11": ("extracted", "12-14")}  # the bare page number 4 is no item


def test_master_declaration(items):
    assert {n for n, r in items["master"].items() if r["status"] == "incorporated_by_reference"} == {"10", "11", "12", "13", "14"}


def test_end_index(items):
    got = {n: items["index"][n]["status"] for n in ("1B", "4", "6")}
    assert got == {"1B": "not_applicable", "4": "not_applicable", "6": "reserved"}


def test_empty_filing_keeps_placeholders(items):
    got = {r["status"] for r in items["empty"].values()}
    assert got == {"not_found", "reserved", "not_applicable"}


def test_declared_status_beats_longer_anchor(spark):
    rows = [("f", 90000, "6", 4000, 4200, "x", 0.85, "cover_toc_status", "reserved", 1), ("f", 90000, "6", 50000, 80000, "y", 0.8, "html_anchor", None, 2)]
    df = spark.createDataFrame(rows, "filing_id string, total_chars int, item_number string, start_pos int, end_pos int, heading_text string, "
                                     "confidence double, source string, status_hint string, doc_order int")
    assert B.best_boundaries(df).collect()[0]["status_hint"] == "reserved"


@pytest.mark.parametrize("text,status", [
    ("[Reserved]", "reserved"), ("This item has been reserved.", "reserved"), ("None.", "not_applicable"), ("  none ", "not_applicable"),
    ("Not applicable to us.", "not_applicable"), ("Refer to the captions in the 2023 Proxy Statement", "incorporated_by_reference"),
    ("is incorporated by reference", "incorporated_by_reference"), ("The company was incorporated in Delaware. " + "Word " * 900, "extracted"),
    ("see DEF 14A", "incorporated_by_reference"), ("Ordinary text", "extracted")])
def test_status_of(spark, text, status):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(I.status_of(F.col("t"))).first()[0] == status


def test_partitioning_does_not_change_items(texts):
    view = lambda df: sorted(map(tuple, I.extract_items(df).collect()))
    assert view(texts.repartition(1)) == view(texts.orderBy(F.desc("filing_id")).repartition(7))


def test_standalone_steps_equal_the_one_pass(texts):
    sliced = I.slice_items(B.best_boundaries(B.boundaries(texts)), texts)
    filled = I.fill_missing(sliced, texts.select("filing_id"))
    one = I.extract_items(texts)
    cols = ["filing_id", "item_number", "item_title", "content_text", "range_start", "range_end", "status", "confidence"]
    assert sorted(map(tuple, filled.select(*cols).collect())) == sorted(map(tuple, one.select(*cols).collect()))
    fixed = I.fix_items(one, texts)
    checked = I.extract_items(texts, validate=True)
    cols = ["filing_id", "item_number", "status", "range_start", "range_end"]
    assert sorted(map(tuple, fixed.select(*cols).collect())) == sorted(map(tuple, checked.select(*cols).collect()))
    issues = I.item_issues(fixed, texts)
    inline = checked.select("filing_id", "item_number", F.explode("issues").alias("i")).select("filing_id", "item_number", "i.check", "i.severity")
    assert sorted(map(tuple, issues.collect())) == sorted(map(tuple, inline.collect()))
    a = I.validation_report(checked).collect()
    b = I.validation_report(fixed, issues).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_coverage_fails_on_placeholders_only(texts):
    report = {r["filing_id"]: r for r in I.validation_report(I.extract_items(texts, validate=True)).collect()}
    assert not report["empty"]["coverage_ok"] and report["empty"]["ordering_ok"] and report["empty"]["no_duplicates"]
    assert report["body"]["found"] == 8  # seven found, plus the optional item 16


def test_routing(texts):
    routes = {r["filing_id"]: r for r in I.route_filings(B.boundaries(texts)).collect()}
    assert routes["body"]["needs_model"] and routes["empty"]["needs_gap_fill"]
    assert not any(r["needs_model"] for r in I.route_filings(B.boundaries(texts), allowed=False).collect())


def test_html_anchors(spark):
    raw = "<html><body><p>intro " + FILLER * 30 + "</p><p><b>Risk Factors</b></p><p>" + FILLER * 60 + "</p><span style='font-weight:700'>Item 2. Properties</span><p>" + FILLER * 30 + "</p></body></html>"
    from paperloom.operators.filing_text import normalize_html

    df = spark.createDataFrame([("a", raw)], "filing_id string, content string")
    text = normalize_html(df)
    full = text.first()["text"]
    rows = {r["item_number"]: r["start_pos"] for r in H.html_anchors(df, text).collect()}
    assert rows == {"1A": full.index("Risk Factors"), "2": full.index("Item 2. Properties")}


def test_lookup_by_accession_never_falls_back(spark):
    index = spark.createDataFrame(
        [("0000000001", 0, "10-K", "2024-02-01", "0000000001-24-000009", "a.htm", ""), ("0000000001", 1, "10-K", "2023-02-01", "0000000001-23-000005", "", "")],
        "cik string, ord int, form string, filing_date string, accession_number string, primary_document string, description string")
    wants = spark.createDataFrame([(1, "0000000001", "000000000123000005", None), (2, "0000000001", "9", None), (3, "0000000001", None, 2023), (4, "0000000001", None, None)],
                                  "request_id int, cik string, accession_number string, year int")
    got = {r["request_id"]: r["filing_url"] for r in N.find_filings(wants, index).collect()}
    base = "https://www.sec.gov/Archives/edgar/data/1/"
    assert got == {1: base + "000000000123000005/0000000001-23-000005.txt", 2: None, 3: base + "000000000123000005/0000000001-23-000005.txt",
                   4: base + "000000000124000009/a.htm"}


def test_value_renderings(spark):
    df = spark.createDataFrame([(12345678.0, "total 12,346 thousand", True), (2.5e6, "about 2 million", True), (6.13, "no such number", False), (6.13, "EPS of 6", True)],
                               "v double, t string, want boolean")
    assert all(r[0] == r[1] for r in df.select(X.value_in_text(F.col("v"), F.col("t")), "want").collect())
    strict = df.select(X.value_in_text(F.col("v"), F.col("t"), strict=True)).collect()
    assert [r[0] for r in strict] == [True, True, False, True]


def test_excerpt_positions_map_back(spark):
    gap = "a" * 30_000 + "b" * 15_000 + "c" * 15_000 + "d" * 15_000 + "HEADING" + "e" * 7_993
    df = spark.createDataFrame([(gap,)], "g string").withColumn("x", R.excerpt(F.col("g"), R.SMALL_WINDOW))
    row = df.withColumn("at", F.instr("x", "HEADING") - 1).withColumn("pos", R.excerpt_to_text(F.col("x"), F.col("at"), F.lit(100))).first()
    assert "chars omitted" in row["x"]
    # Only the brackets are skipped: the four line ends around each of the two markers count as text.
    assert row["pos"] - 100 - gap.index("HEADING") == 8


def test_refinement_keeps_its_item(texts, spark):
    bounds = B.boundaries(texts.filter("filing_id = 'body'"))
    start = bounds.filter("item_number = '3'").first()["start_pos"]
    results = spark.createDataFrame(
        [("body", "refine", None, "3", True, True, 205, None, "Legal", 0.9, "not_applicable"), ("body", "full", None, "2", True, False, None, 5, "PART II", None, "")],
        "filing_id string, kind string, gap_id string, item_number string, found boolean, is_item_heading boolean, offset int, start_pos int, heading_text string, confidence double, status string")
    rows = {r["item_number"]: r for r in R.apply_refinements(bounds, results, texts).collect()}
    assert (rows["3"]["start_pos"], rows["3"]["source"], rows["3"]["status_hint"]) == (start + 5, "llm_refined", "not_applicable")
    assert rows["2"]["start_pos"] == BODY.index("PART II") and rows["2"]["source"] == "llm_full_doc_extract"


def test_spans_and_their_context(spark):
    """Matches, offsets and context against plain Python, also for texts that hold the marks themselves."""
    import re

    from paperloom.functions.text import find_spans

    texts = ["", "no match", "a1b22c", "1", "11 22", "x" * 30 + "7" + "y" * 3 + "8" + "z" * 30, "a﷐1b﷑2c", "é\U0001f6003中4"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").withColumn("s", find_spans(F.col("t"), r"\d+", 10, 5))
    for r in df.collect():
        at, want = 0, []
        for i, m in enumerate(re.finditer(r"\d+", r["t"])):
            want.append((i, m.start() - at, m[0], r["t"][max(m.start() - 10, 0) : m.start()], r["t"][m.end() : m.end() + 5]))
            at = m.end()
        assert [tuple(x) for x in r["s"]] == want, r["t"]


def text_exchanges(df):
    """Exchanges of a plan whose rows hold the text."""
    import re

    found, plan = [], df._jdf.queryExecution().executedPlan()
    stack = [plan]
    while stack:
        node = stack.pop()
        if re.match("Exchange|ReusedExchange", node.nodeName()) and "text#" in node.output().mkString(","):
            found.append(node.simpleString(50))
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return found


@pytest.mark.parametrize("shuffle", ["3", "16"])
def test_stored_corpus_moves_no_text(spark, texts, tmp_path, shuffle):
    from paperloom.sources.corpus_store import read_corpus, write_corpus

    write_corpus(texts, str(tmp_path / "c"), buckets=5)
    kept = read_corpus(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, texts.collect()))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": shuffle}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        bounds = lambda t: B.boundaries(t)
        sliced = lambda t: I.slice_items(B.best_boundaries(bounds(t)), t)
        made = {
            "items": lambda t: I.extract_items(t), "slices": sliced, "fixed": lambda t: I.fix_items(sliced(t), t),
            "report": lambda t: I.validation_report(I.extract_items(t, validate=True)), "issues": lambda t: I.item_issues(sliced(t), t),
            "queue": lambda t: R.refine_queue(bounds(t), t, 0.99), "missing": lambda t: R.missing_item_gaps(bounds(t), t, 50), "gaps": lambda t: R.gap_excerpts(bounds(t), t)}
        for name, fn in made.items():
            assert text_exchanges(fn(kept)) == [], name
        assert text_exchanges(I.extract_items(texts.repartition(2)))  # a plain table does move it
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name in ("items", "gaps"):
        rows = lambda t: sorted(map(str, made[name](t).collect()))
        assert rows(kept) == rows(texts), name


def test_bucket_count_follows_the_size(spark):
    from paperloom.sources.corpus_store import bucket_count

    df = spark.range(100).selectExpr("id AS filing_id", "repeat('x', 1000) AS text")
    assert bucket_count(df, ["text"], bucket_bytes=1000) == 100 and bucket_count(df.limit(0), ["text"]) == spark.sparkContext.defaultParallelism


def test_index_notes_whole(spark):
    text = "filler text here. " * 1000 + "\nItem 1B.\nUnresolved " + "Staff Comments " * 12 + "\n" + "Pages 3 and many more words " * 6 + "\n"
    df = spark.createDataFrame([(1, text)], "filing_id long, text string")
    rows = lambda **o: B.end_index(B.candidates(df, ["end_index"], **o)).first()
    assert len(rows()["heading_text"]) == 120 and len(rows()["page_note"]) == 120
    assert rows(note_chars=None)["heading_text"].endswith("Comments") and len(rows(note_chars=None)["page_note"]) > 160


def test_large_submissions_are_read_in_many_tasks(spark, tmp_path):
    import random

    from paperloom.operators import filing_text as T
    from paperloom.sources.submissions import numbered, read_submission_blocks, stream_submission_blocks
    from paperloom.streaming.running import run_available

    rng = random.Random(3)

    def block(i):
        first, last = rng.choice([("<DOCUMENT>", "</DOCUMENT>"), ("<document>", "</DOCUMENT>"), ("<DOCUMENT>", "</document>"), ("<Document>", "</Document>")])
        inside = rng.choice(["<TEXT>{}</TEXT>", "{}", "<text> é {} </text> tail"]).format(f"body {i} " + "x\n" * rng.randrange(400))
        return first + f"\n<TYPE>ex-{i}\n" + inside + last + rng.choice(["", "\n", " between "])

    files = {"big.txt": "HEADER\n" + "".join(block(i) for i in range(300)) + "</DOCUMENT>\n</SEC-DOCUMENT>\n", "ends.txt": "<DOCUMENT><TYPE>a\nb</DOCUMENT>", "none.txt": "no block", "stray.txt": "</DOCUMENT>x",
             "open.txt": "<DOCUMENT>one</DOCUMENT><document>two</document><DOCUMENT>never ended", "empty.txt": "", "other.dat": "<DOCUMENT>no</DOCUMENT>"}
    (tmp_path / "in/sub").mkdir(parents=True)
    for name, content in files.items():
        (tmp_path / "in" / ("sub/" if name == "open.txt" else "") / name).write_text(content, encoding="utf-8")
    whole = spark.createDataFrame([(n, c) for n, c in files.items() if n.endswith("txt")], "filing_id string, content string")
    want = sorted((r["filing_id"], r["pos"], r["doc_type"], r["body"]) for r in T.split_submissions(whole).collect())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        blocks = read_submission_blocks(spark, str(tmp_path / "in"), "*.txt")
        got = sorted((r["filing_id"].rsplit("/", 1)[-1], r["pos"], r["doc_type"], r["body"]) for r in numbered(blocks).collect())
        assert got == want and len(want) > 300
        assert blocks.filter("filing_id LIKE '%big.txt'").select("split").distinct().count() > 5 and blocks.rdd.getNumPartitions() > 5
        small = read_submission_blocks(spark, str(tmp_path / "in"), "*.txt", max_bytes=1000)
        assert {r["filing_id"].rsplit("/", 1)[-1] for r in small.select("filing_id").collect()} == {"ends.txt", "open.txt"}
        closed = [w for w in want if w[0] in ("big.txt", "ends.txt")]
        stream = stream_submission_blocks(spark, str(tmp_path / "in"), "[be][in][gd]*.txt")
        assert sorted((r["doc_type"], r["body"]) for r in run_available(stream).collect()) == sorted(w[2:] for w in closed)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_tasks_of_a_text_table_follow_its_size(spark, tmp_path, monkeypatch):
    """One row group, as one file: the texts are dealt by their size, and a key's rows lie together."""
    import os

    from paperloom import session
    from paperloom.plans import adapters as A

    rows = [(i % 40, f"{i} " * 200, "en", "s", 9) for i in range(80)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    size = sum(os.path.getsize(tmp_path / "documents.parquet" / f) for f in os.listdir(tmp_path / "documents.parquet") if f.endswith(".parquet") and not f.startswith("."))
    monkeypatch.setattr(session, "TEXT_TASK_BYTES", -(-size // 30))
    docs = A.table(spark, str(tmp_path), "documents")
    assert docs.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, 30)
    placed = docs.withColumn("p", F.spark_partition_id()).groupBy("doc_id").agg(F.countDistinct("p").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert len(placed) == 40 and {(r["n"], r["rows"]) for r in placed} == {(1, 2)}


AWKWARD_LINES = [None, "", "Item 1. Foo\n\n\n Item 2\n\nItem 3. Bar |\n| Business |\n|\n\nRISK FACTORS\n", "Item 1.\nItem 2. Foo\x85\nItem 3 Bar﷐ x",
                 "Item  9A— Controls \U0001f600 a\n  |Properties| |\n|Business", "ITEM 7: A, B & C\n\t\n\x0bItem 8\n \nFinancial Data   \n\nsee Item 5. Nothing", "xItem 1. Foo\nItem 1. " + "F" * 200]


def test_line_spans_are_those_of_a_plain_scan(spark):
    from paperloom.functions.text import LINES, find_spans
    from paperloom.session import ship_package

    ship_package(spark)
    df = spark.createDataFrame(list(enumerate(AWKWARD_LINES)), "filing_id long, text string")
    scans = [find_spans(F.col("text"), LINES + p, before=40, after=200, shape=B._of_kind(f"heading{n}", F.lit(0))) for n, p in enumerate(B.fixed.HEADING_PATTERNS)]
    plain = F.concat(*scans, find_spans(F.col("text"), LINES + B.title_pattern(), before=80, shape=B._of_kind("title", F.lit(0))))
    rows = df.select("filing_id", plain.alias("plain"), B._line_rows(True, True)(F.col("text")).alias("found")).collect()
    assert [r.found for r in rows] == [r.plain for r in rows]
    assert sum(len(r.found or []) for r in rows) > 10 and rows[0].found == []


def test_candidates_leave_the_text_and_lie_as_the_texts_do(spark):
    texts = spark.createDataFrame([(i, "Item 1. Business\nwords\n") for i in range(20)], "filing_id long, text string").repartition(7, "filing_id")
    rows = B.candidates(texts)
    nothing = texts.select("filing_id", F.lit(None).cast("string").alias("text"))
    assert [r.kind for r in B.candidates(nothing).collect()] == ["doc"] * 20  # a filing without a text is still one
    plan = rows._jdf.queryExecution().optimizedPlan()
    made = [n for n in _nodes(plan) if n.nodeName() == "Generate"]
    # Behind the explode the text would be copied, and its size counted, for each candidate.
    assert made and all("text#" not in n.output().mkString(",") for n in made)
    from paperloom.session import partitions

    assert partitions(rows) == 7


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def test_headings_and_titles_are_read_where_they_are_matched(spark):
    from paperloom.session import ship_package

    ship_package(spark)
    text = "Item 1. Business .... 12\n\nItem 9A — Odd Title\n\nword\nRISK FACTORS |\n|\nProperties\n"
    df = spark.createDataFrame([(1, text)], "filing_id long, text string")
    found = df.select(F.explode(B._line_rows(True, True, read=True)(F.col("text"))).alias("c")).select("c.*").collect()
    assert all(r[c] is None for r in found for c in ("hit", "pre", "post"))  # neither the match nor what is around it leaves the row
    heads = {(r.item_number, r.heading_text): (r.toc_like, r.score) for r in found if r.kind == "heading0"}
    assert heads == {("1", "Business .... 12"): (True, 0.95), ("9A", "Odd Title"): (False, 0.5)}
    titles = [(r.item_number, r.heading_text, r.case_rank, r.mid_sentence) for r in found if r.kind == "title"]
    assert titles == [("1A", "RISK FACTORS", 0, True), ("2", "Properties", 1, False)]
    rows = {(r.kind, r.item_number): r.start_pos for r in B.candidates(df, ["heading", "title"]).collect()}
    assert rows["heading0", "1"] == 0 and text[rows["title", "2"]:].lstrip("\n|").startswith("Properties")
