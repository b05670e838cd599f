"""Items of annual reports: slicing, status, placeholders, fixes, roll-ups, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions.text import contains_any, left, let, literal_map, rlike, slice_text, strip, text_array
from paperloom.operators import boundaries as B

ITEM_COUNT = len(fixed.ITEMS)


def _standard() -> Column:
    """The standard items as an array, in report order."""
    return F.array(*[
        F.struct(F.lit(p).alias("part"), F.lit(n).alias("item_number"), F.lit(t).alias("item_title"),
                 F.lit(i).alias("ord")) for i, (p, n, t) in enumerate(fixed.ITEMS)])


def _part_of(item: Column) -> Column:
    number = F.regexp_extract(item, r"^(\d+)", 1).cast("int")
    by_range = F.when(number <= 4, "I").when(number <= 9, "II").when(number <= 14, "III").when(number > 14, "IV")
    return F.coalesce(literal_map([(n, p) for p, n, _ in fixed.ITEMS])[item], by_range, F.lit("I"))


def status_of(content: Column) -> Column:
    """Status of an item from its own words; the order of the tests matters."""
    return let(strip(content), _status_of_stripped)


def _status_of_stripped(body: Column) -> Column:
    return let(F.struct(body.alias("body"), F.lower(left(body, 3000)).alias("low")), lambda x: _status_of_words(x["body"], x["low"]))


def _status_of_words(body: Column, low: Column) -> Column:
    """`low`: the head in lower case. A pattern runs only where the words that each of its matches holds occur."""
    head, short, named = left(body, 3000), F.length(body) < 200, lambda word: F.contains(low, F.lit(word))
    proxy, incorporated = named("proxy") | named("14a"), named("incorporat")
    loose = F.lit(False)
    for pattern in fixed.STATUS_PROXY_LOOSE:
        loose = loose | rlike(left(body, 500), "(?i)" + pattern)
    return (
        F.when((left(body, 1).isin("[", "r", "R") & rlike(body, "(?i)" + fixed.STATUS_RESERVED_WHOLE))
               | (short & rlike(body, "(?i)" + fixed.STATUS_RESERVED_SHORT)), "reserved")
        .when((proxy & named("refer") & rlike(head, "(?is)" + fixed.STATUS_REFER_TO_PROXY))
              | (incorporated & rlike(head, "(?i)" + fixed.STATUS_BY_REFERENCE))
              | ((proxy | incorporated) & loose), "incorporated_by_reference")
        .when(short & (rlike(body, "(?i)" + fixed.STATUS_NOT_APPLICABLE)
                       | rlike(body, "(?i)" + fixed.STATUS_NONE_WHOLE)), "not_applicable")
        .otherwise("extracted")
    )


def classify_status(items: DataFrame) -> DataFrame:
    """Set `status` from `content_text`, overridden by a `status_hint` unless that would weaken it."""
    found, hint = status_of(F.col("content_text")), F.col("status_hint")
    usable = hint.isin(fixed.STATUSES) & ((found == "extracted") | (hint != "extracted"))
    return items.withColumn("status", F.when(F.coalesce(usable, F.lit(False)), hint).otherwise(found))


def _body_of(text: Column, start: Column, end: Column) -> Column:
    """The slice without its heading line (the first line, if there is more than one)."""
    def drop_first(whole: Column) -> Column:
        cut = F.locate("\n", whole)
        return F.when(cut > 0, strip(F.substring(whole, cut + 1, F.length(whole)))).otherwise(whole)

    return let(strip(slice_text(text, start, end)), drop_first)


_METHOD = lambda source: F.when(source.isin("llm_refined", "llm_missing_detect"), "llm_refined").otherwise("rule_based")


def slice_items(best: DataFrame, texts: DataFrame) -> DataFrame:
    """Cut every boundary's content out of the text. The only step that moves the text itself.

    Boundaries are packed to one short row per filing first, so the join has one row per filing on
    both sides; with texts bucketed by filing_id the text side needs no shuffle.
    """
    packed = (
        best.filter(F.col("source").isNotNull()).groupBy("filing_id")
        .agg(F.collect_list(F.struct("item_number", "start_pos", "end_pos", "heading_text", "confidence", "source",
                                     "status_hint")).alias("found")))
    cut = lambda b: F.struct(b.alias("b"), _body_of(F.col("text"), b["start_pos"], b["end_pos"]).alias("body"))
    rows = texts.select("filing_id", "text").join(packed, "filing_id").select("filing_id", F.explode(F.transform("found", cut)).alias("x")).select("filing_id", "x.*")
    title = literal_map([(n, t) for _, n, t in fixed.ITEMS])
    out = rows.select(
        "filing_id", _part_of(F.col("b.item_number")).alias("part"), F.col("b.item_number").alias("item_number"),
        F.when(F.coalesce(F.col("b.heading_text"), F.lit("")) != "", F.col("b.heading_text"))
        .otherwise(title[F.col("b.item_number")]).alias("item_title"),
        F.col("body").alias("content_text"),
        F.col("b.start_pos").alias("range_start"), F.col("b.end_pos").alias("range_end"),
        F.col("b.confidence").alias("confidence"), _METHOD(F.col("b.source")).alias("extraction_method"),
        F.col("b.status_hint").alias("status_hint"))
    return classify_status(out).drop("status_hint")


_PLACEHOLDER = lambda d: [
    d["part"].alias("part"), d["item_number"].alias("item_number"), d["item_title"].alias("item_title"),
    F.coalesce(literal_map([(n, note) for n, (_, note) in fixed.ABSENT_DEFAULTS.items()])[d["item_number"]],
               F.lit("")).alias("content_text"),
    F.lit(0).alias("range_start"), F.lit(0).alias("range_end"),
    F.when(d["item_number"].isin(list(fixed.ABSENT_DEFAULTS)), 0.70).otherwise(0.0).alias("confidence"),
    F.lit("rule_based").alias("extraction_method"),
    F.coalesce(literal_map([(n, s) for n, (s, _) in fixed.ABSENT_DEFAULTS.items()])[d["item_number"]],
               F.lit("not_found")).alias("status"),
]


def placeholders(found: DataFrame) -> DataFrame:
    """found(filing_id, item_number; null item = filing with nothing) -> rows for the absent items."""
    have = found.groupBy("filing_id").agg(F.collect_set("item_number").alias("have"))
    missing = have.select("filing_id", F.explode(
        F.filter(_standard(), lambda d: ~F.array_contains(F.col("have"), d["item_number"]))).alias("d"))
    return missing.select("filing_id", *_PLACEHOLDER(F.col("d")))


def fill_missing(items: DataFrame, filings: DataFrame | None = None) -> DataFrame:
    """All 23 items for every filing; `filings` adds filings that have no item row at all."""
    have = items.select("filing_id", "item_number")
    if filings is not None:
        have = have.unionByName(filings.select("filing_id", F.lit(None).cast("string").alias("item_number")))
    cols = ["filing_id", "part", "item_number", "item_title", "content_text", "range_start", "range_end",
            "confidence", "extraction_method", "status"]
    order = literal_map([(n, i) for i, (_, n, _) in enumerate(fixed.ITEMS)])
    return items.select(*cols).unionByName(placeholders(have).select(*cols)).withColumn(
        "ord", F.coalesce(order[F.col("item_number")], F.lit(99)))


def _first_words(content: Column) -> Column:
    return left(strip(left(content, 100)), 50)


def _refit(text: Column, r: Column) -> Column:
    """An item struct with its status tested again and its range where its first words occur."""
    def place(n: Column) -> Column:
        at = F.when((n["status"] == "extracted") & (n["words"] != ""), F.instr(text, n["words"]))
        return let(at, lambda p: F.struct(
            n["status"].alias("status"), F.when(p > 0, p - 1).otherwise(r["range_start"]).cast("int").alias("range_start"),
            F.when(p > 0, p - 1 + F.length(r["content_text"])).otherwise(r["range_end"]).cast("int").alias("range_end")))

    status = F.when((r["status"] == "extracted") & (F.length(r["content_text"]) > 0), status_of(r["content_text"])).otherwise(r["status"])
    return let(F.struct(status.alias("status"), _first_words(r["content_text"]).alias("words")), place)


def _issues(text: Column, size: Column, r: Column) -> Column:
    """Problems of one item, as an array of (check, severity); nothing for placeholders."""
    content, status = F.coalesce(r["content_text"], F.lit("")), r["status"]
    extracted = status == "extracted"
    lo, hi = r["range_start"], r["range_end"]
    broken = (lo < 0) | (hi > size) | (lo >= hi)
    excused = r["item_number"].isin([*fixed.OPTIONAL_ITEMS, "1B"])

    def tests(v: Column) -> Column:
        found = [
            ("char_range_bounds", "error", broken),
            ("char_range_content_mismatch", "warning", ~broken & extracted & (content != "") & (v["words"] != "")
             & ~F.contains(strip(slice_text(text, lo, F.least(hi, lo + 150))), v["words"])),
            ("empty_content", "error", extracted & (v["size"] < 10) & ~excused),
            ("very_short_content", "warning", extracted & (v["size"] >= 10) & (v["size"] < 50)),
            ("html_artifacts", "warning", extracted & rlike(left(content, 500), r"<(?:div|span|table|tr|td|ix:)")),
            ("status_consistency", "warning", (status == "incorporated_by_reference")
             & ~contains_any(F.lower(content), ["incorporat", "proxy", "def 14a", "reference"])),
        ]
        return F.array_compact(F.array(*[
            F.when(test, F.struct(F.lit(name).alias("check"), F.lit(sev).alias("severity"))) for name, sev, test in found]))

    facts = F.struct(_first_words(content).alias("words"), F.length(strip(content)).alias("size"))
    return F.when(status != "not_found", let(facts, tests)).otherwise(F.array().cast("array<struct<check:string,severity:string>>"))


def extract_items(texts: DataFrame, html_anchors: DataFrame | None = None, bounds: DataFrame | None = None,
                  validate: bool = False) -> DataFrame:
    """Texts to the 23 items per filing, in one pass: the best boundaries of a filing and the
    placeholders for the rest come from the same packed row, so the text is joined once.

    `validate` also refits status and range and adds `issues`, while the text is at hand. `bounds`
    takes boundaries that were already computed.
    """
    best = B.best_boundaries(B.boundaries(texts, html_anchors) if bounds is None else bounds)
    packed = best.groupBy("filing_id").agg(F.collect_list(F.when(F.col("source").isNotNull(), F.struct(
        "item_number", "start_pos", "end_pos", "heading_text", "confidence", "source", "status_hint"))).alias("found"))
    rows = texts.select("filing_id", "text").join(packed, "filing_id").select("filing_id", "text", F.length("text").alias("size"), "found")
    text = F.col("text")
    names = ["part", "item_number", "item_title", "content_text", "range_start", "range_end", "confidence", "extraction_method", "status"]

    def item(d: Column, b: Column, body: Column) -> Column:
        def judged(found: Column) -> Column:
            hint = b["status_hint"]
            usable = F.coalesce(hint.isin(fixed.STATUSES) & ((found == "extracted") | (hint != "extracted")), F.lit(False))
            return F.when(usable, hint).otherwise(found)

        present = F.struct(
            d["part"].alias("part"), d["item_number"].alias("item_number"),
            F.when(F.coalesce(b["heading_text"], F.lit("")) != "", b["heading_text"]).otherwise(d["item_title"]).alias("item_title"),
            body.alias("content_text"), b["start_pos"].alias("range_start"), b["end_pos"].alias("range_end"),
            b["confidence"].alias("confidence"), _METHOD(b["source"]).alias("extraction_method"), let(status_of(body), judged).alias("status"))
        return F.when(b.isNotNull(), present).otherwise(F.struct(*_PLACEHOLDER(d)))

    def checked(r: Column) -> Column:
        def merged(n: Column) -> Column:
            new = F.struct(*[(n[c] if c in ("status", "range_start", "range_end") else r[c]).alias(c) for c in names])
            return let(new, lambda x: F.struct(*[x[c].alias(c) for c in names], _issues(text, F.col("size"), x).alias("issues")))

        return let(_refit(text, r), merged)

    def one(d: Column) -> Column:
        best_of = F.get(F.filter("found", lambda b: b["item_number"] == d["item_number"]), F.lit(0))
        made = let(best_of, lambda b: let(F.when(b.isNotNull(), _body_of(text, b["start_pos"], b["end_pos"])), lambda body: item(d, b, body)))
        return F.struct((let(made, checked) if validate else made).alias("r"), d["ord"].alias("ord"))

    # All items are cut inside the filing's own row; only the cut pieces leave it.
    return rows.select("filing_id", F.explode(F.transform(_standard(), one)).alias("x")).select("filing_id", "x.r.*", "x.ord")


def _beside_text(items: DataFrame, texts: DataFrame, made) -> DataFrame:
    """What `made` makes of every item beside its filing's text. Items are packed per filing first, so the text
    meets one row per filing, and only the results leave it."""
    cols = [c for c in items.columns if c != "filing_id"]
    packed = items.groupBy("filing_id").agg(F.collect_list(F.struct(*cols)).alias("rows"))
    rows = packed.join(texts.select("filing_id", "text"), "filing_id").withColumn("size", F.length("text"))
    return rows.select("filing_id", F.explode(F.transform("rows", made)).alias("x")).select("filing_id", "x.*")


def fix_items(items: DataFrame, texts: DataFrame) -> DataFrame:
    """Re-test the status of extracted items and set the range to where their first words occur."""
    rows = _beside_text(items, texts, lambda r: F.struct(r.alias("r"), _refit(F.col("text"), r).alias("n")))
    keep = [F.col(f"r.{c}").alias(c) for c in items.columns if c not in ("filing_id", "status", "range_start", "range_end")]
    return rows.select("filing_id", *keep, "n.status", "n.range_start", "n.range_end")


def extraction_summary(items: DataFrame, bounds: DataFrame) -> DataFrame:
    """Per filing: items by status and method, completeness, mean boundary confidence, row counts."""
    by_status = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in fixed.STATUSES]
    found = F.count_if(F.col("status") != "not_found")
    left_side = items.groupBy("filing_id").agg(
        *by_status, found.alias("extracted_count"),
        F.count_if(F.col("extraction_method") == "rule_based").alias("rule_only_items"),
        F.count_if(F.col("extraction_method") != "rule_based").alias("refined_items"))
    right_side = bounds.groupBy("filing_id").agg(
        F.count("source").alias("items_found"), F.max("total_chars").alias("filing_chars"),
        # Exact decimals: the mean does not depend on the order of the rows.
        (F.coalesce(F.sum(F.when(F.col("source").isNotNull(), F.col("confidence").cast("decimal(12,6)"))), F.lit(0))
         .cast("double") / F.greatest(F.count("source"), F.lit(1))).alias("confidence_avg"))
    return (
        left_side.join(right_side, "filing_id")
        .withColumn("expected_count", F.lit(ITEM_COUNT))
        .withColumn("extraction_completeness",
                    F.round(F.least(F.lit(1.0), F.col("extracted_count") / F.lit(ITEM_COUNT)), 3))
    )


def route_filings(bounds: DataFrame, force: bool = False, allowed: bool = True) -> DataFrame:
    """Which filings need a second look by a model, and which need gap filling."""
    conf = F.col("confidence_avg")
    per = bounds.groupBy("filing_id").agg(
        F.count("source").alias("items_found"),
        (F.coalesce(F.sum(F.when(F.col("source").isNotNull(), F.col("confidence").cast("decimal(12,6)"))), F.lit(0))
         .cast("double") / F.greatest(F.count("source"), F.lit(1))).alias("confidence_avg"),
        F.collect_set("item_number").alias("have"))
    lacking = F.size(F.array_except(text_array(fixed.REQUIRED_FOR_CONFIDENCE), F.col("have"))) > 0
    unsure = (F.col("items_found") < 10) | (conf < 0.55) | ((conf < 0.75) & lacking)
    return per.select(
        "filing_id", "items_found", "confidence_avg", (~lacking).alias("has_required"),
        (F.lit(force) | (F.lit(allowed) & unsure)).alias("needs_model"),
        (F.lit(force) | (F.lit(allowed) & (F.col("items_found") < 18))).alias("needs_gap_fill"))


# --- validation ----------------------------------------------------------------------------------------

def item_issues(items: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per problem of an item: range, content, markup, status (placeholders are skipped)."""
    cols = ["filing_id", "item_number", "content_text", "range_start", "range_end", "status"]
    rows = _beside_text(items.filter(F.col("status") != "not_found").select(*cols), texts, lambda r: F.struct(
        r["item_number"].alias("item_number"), _issues(F.col("text"), F.col("size"), r).alias("issues")))
    return rows.select("filing_id", "item_number", F.explode("issues").alias("i")).select("filing_id", "item_number", "i.check", "i.severity")


def validation_report(items: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Per filing: coverage, ordering, duplicates and the overall verdict.

    Items that carry their `issues` need one aggregation; otherwise an issue table is joined.
    """
    numbers = B.ITEM_NUMBERS
    order = Window.partitionBy("filing_id").orderBy("ord", "item_number")
    position = literal_map([(n, i) for i, n in enumerate(numbers)])
    inline = issues is None
    problems = F.col("issues") if inline else F.array().cast("array<struct<check:string,severity:string>>")
    walked = items.select("filing_id", "item_number", "status", "ord", problems.alias("issues")).withColumn(
        "at", position[F.col("item_number")]).withColumn("next_at", F.lead("at").over(order))
    severity = lambda s: F.sum(F.size(F.filter("issues", lambda i: i["severity"] == s)))
    per = walked.groupBy("filing_id").agg(
        F.collect_set(F.when(F.col("status") != "not_found", F.col("item_number"))).alias("real"),
        F.count_if(F.col("status") == "not_found").alias("placeholder_not_found"),
        F.count_if(F.col("at") >= F.col("next_at")).alias("out_of_order_pairs"),
        (F.count(F.lit(1)) - F.count_distinct("item_number")).alias("duplicates"),
        severity("error").alias("errors"), severity("warning").alias("warnings"))
    if not inline:
        counts = issues.groupBy("filing_id").agg(
            F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
        per = per.drop("errors", "warnings").join(counts, "filing_id", "left").fillna(0, ["errors", "warnings"])
    missing = F.array_except(text_array(numbers), F.col("real"))
    required = F.array_except(missing, text_array(fixed.OPTIONAL_ITEMS))
    return per.select(
        "filing_id", F.size("real").alias("found"), "placeholder_not_found", F.size(missing).alias("missing"),
        F.array_join(F.array_sort(required), ",").alias("missing_required"),
        ((F.size("real") > 0) & (F.size(required) == 0)).alias("coverage_ok"),
        (F.col("out_of_order_pairs") == 0).alias("ordering_ok"), (F.col("duplicates") == 0).alias("no_duplicates"), "errors", "warnings",
        ((F.size("real") > 0) & (F.size(required) == 0) & (F.col("errors") == 0)).alias("overall_valid"))
