"""Tasks and pages: intents, static-task filter, routing, paragraph selection, digests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions.text import collapse, contains_any, extract, left, let, literal_map, rlike


def site_of(url: Column) -> Column:
    """The routed site suffix of a URL: the host itself or a sub-domain of it; the first listed wins."""
    host = F.lower(extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return let(host, lambda h: F.coalesce(*[
        F.when((h == s) | F.endswith(h, F.lit("." + s)), F.lit(s)) for s in fixed.SITE_SUFFIXES]))


def route_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("site", site_of(F.col("url")))


def parse_intents(tasks: DataFrame) -> DataFrame:
    """(task_id, task) -> paragraph request, summary flags, fields, strictness, top n."""
    task = F.coalesce("task", F.lit(""))
    low = F.lower(task)
    hit = lambda p: rlike(low, p)
    num = lambda p, g=1: extract(low, p, g).try_cast("int")
    ordinal = r"\b(?:the\s+)?(" + "|".join(w for w, _ in fixed.ORDINALS) + r")\s+paragraph\b"
    everything = hit(fixed.INTENT_ALL)
    first_n = num(fixed.INTENT_FIRST_N)
    # The first rule that matches decides; a "first 0 paragraphs" request matches but asks for nothing.
    rule = (
        F.when(everything, "all").when(hit(fixed.INTENT_LAST), "last").when(hit(fixed.INTENT_RANGE), "range")
        .when(hit(fixed.INTENT_FIRST_N), "first_n").when(hit(ordinal), "ordinal").when(hit(fixed.INTENT_NUMBERED), "numbered")
        .when(hit(fixed.INTENT_SINGULAR) | hit(fixed.INTENT_LEAD) | rlike(task, fixed.INTENT_CJK_FIRST), "one")
    )
    a, b = num(fixed.INTENT_RANGE, 1), num(fixed.INTENT_RANGE, 2)

    def named(words: list[str]) -> Column:
        """One pattern per field: single words stand alone, phrases anywhere."""
        phrases = [w for w in words if " " in w or ";" in w or "/" in w]
        single = [w for w in words if w not in phrases]
        return rlike(low, "|".join(([rf"\b(?:{'|'.join(single)})\b"] if single else []) + [re.escape(p) for p in phrases]))

    fields = F.array_compact(F.array(*[F.when(named(words), F.lit(f)) for f, words in fixed.FIELD_SYNONYMS]))
    rows = tasks.withColumn("_rule", rule).withColumn("requested_fields", fields)
    r = F.col("_rule")
    index = F.when(r == "last", -1).when(r == "ordinal", literal_map(fixed.ORDINALS)[extract(low, ordinal, 1)]) \
        .when(r == "numbered", num(fixed.INTENT_NUMBERED)).when(r == "one", 1)
    lo = F.when(r == "range", F.least(a, b)).when((r == "first_n") & (first_n > 0), 1)
    hi = F.when(r == "range", F.greatest(a, b)).when((r == "first_n") & (first_n > 0), first_n)
    rows = rows.withColumn("paragraph_index", index.cast("int")).withColumn("range_from", lo.cast("int")).withColumn("range_to", hi.cast("int")) \
        .withColumn("paragraphs_all", F.coalesce(r == "all", F.lit(False)))
    # A request names a paragraph exactly when one of these rules matched, except for "first 0".
    placed = r.isNotNull() & ~((r == "first_n") & (first_n <= 0))
    single = (F.size("requested_fields") == 1) & ~F.coalesce(placed, F.lit(False))
    return rows.withColumn("_single", single).withColumn(
        "wants_summary", ~F.col("_single") & (hit(fixed.INTENT_SUMMARY) | rlike(task, fixed.INTENT_CJK_SUMMARY))) \
        .withColumn("wants_definition", ~F.col("_single") & hit(fixed.INTENT_DEFINITION)) \
        .withColumn("strict_fields", F.col("_single") | hit(fixed.INTENT_ONLY)).withColumn("top_n", num(fixed.INTENT_TOP_N)) \
        .drop("_rule", "_single")


def any_paragraph_request() -> Column:
    return (F.col("paragraph_index").isNotNull() | F.col("range_from").isNotNull() | F.col("paragraphs_all")
            | F.col("wants_summary") | F.col("wants_definition"))


def is_static(task: Column) -> Column:
    text = F.coalesce(task, F.lit(""))
    return (text != "") & ~rlike(text, "(?i)" + fixed.ACTION_WORDS) & ~contains_any(text, fixed.ACTION_MARKERS)


def filter_static(tasks: DataFrame) -> DataFrame:
    """Tasks a plain page read can serve: no action verbs in any of the known languages."""
    return tasks.filter(is_static(F.col("task")))


def selected(paras: Column) -> Column:
    """The paragraphs an intent asks for, joined by blank lines; null when the page cannot serve it.
    `paras` is one page's ordered paragraph array (bounded by the page)."""
    def choose(p: Column) -> Column:
        n = F.size(p)
        lo, hi, i = F.col("range_from"), F.col("range_to"), F.col("paragraph_index")
        # A range from 0 means Python's slice [-1:hi], which only yields text on one-paragraph pages.
        start = F.when(lo == 0, n).otherwise(lo)
        part = F.when((start <= F.least(hi, n)) & (start >= 1), F.slice(p, F.greatest(start, F.lit(1)), F.greatest(F.least(hi, n) - start + 1, F.lit(0))))
        return (
            F.when(n == 0, None).when(F.col("paragraphs_all"), F.array_join(p, "\n\n"))
            .when(lo.isNotNull(), F.array_join(part, "\n\n"))
            .when(i.isNotNull(), F.when(i == -1, F.get(p, n - 1)).when((i >= 1) & (i <= n), F.get(p, i - 1)))
            .when(F.col("wants_summary") | F.col("wants_definition"), F.get(p, F.lit(0)))
        )

    return let(paras, choose)


def answer_from_paragraphs(tasks: DataFrame, paragraphs: DataFrame, key: str = "page_id") -> DataFrame:
    """tasks(task_id, page_id, intent columns) x paragraphs(page_id, n, text) -> answer per task.

    A page's paragraphs are packed once (a page is one stored document), so many tasks on one page do
    not multiply its paragraphs.
    """
    packed = paragraphs.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("_p"))
    return tasks.join(packed, key, "left").withColumn("answer", selected(F.coalesce("_p", F.array().cast("array<string>")))).select(
        "task_id", key, "answer")


def digest_text(text: Column, limit: int | None = None) -> Column:
    """Whitespace collapsed. With a limit, longer texts keep their head and tail."""
    if limit is None:
        return collapse(text)
    return let(collapse(text), lambda t: F.when(F.length(t) <= limit, t).otherwise(
        F.concat(left(t, limit // 2), F.lit("\n...\n"), F.right(t, F.lit(limit // 4)))))


def digest_pages(pages: DataFrame, limit: int | None = None, a11y_limit: int | None = None) -> DataFrame:
    """(page_id, text, a11y) -> digest and what the page offers."""
    tree = F.lower(F.coalesce("a11y", F.lit("")))
    return pages.select(
        "page_id", digest_text(F.coalesce("text", F.lit("")), limit).alias("digest"),
        (F.col("a11y") if a11y_limit is None else left("a11y", a11y_limit)).alias("accessibility_tree"),
        F.contains(tree, F.lit("button")).alias("has_buttons"), contains_any(tree, ["textbox", "searchbox"]).alias("has_inputs"),
        F.contains(tree, F.lit("link")).alias("has_links"))
