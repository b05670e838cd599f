"""Reported financial facts: key metrics and the check against an item's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions.text import literal_map


def key_metrics(facts: DataFrame, year: Column | int | None = None) -> DataFrame:
    """Seven metrics per company: first tag, then first unit that has a value; its last entry.

    With a year: entries of that fiscal year or whose end date names it. Without: annual-report entries.
    One aggregation with partial results before the shuffle; no window.
    """
    tags = [(tag, metric, i) for metric, names in fixed.FACT_METRICS for i, tag in enumerate(names)]
    metric = literal_map([(t, m) for t, m, _ in tags])[F.col("tag")]
    tag_rank = literal_map([(t, i) for t, _, i in tags])[F.col("tag")]
    unit_rank = literal_map([(u, i) for i, u in enumerate(fixed.FACT_UNITS)])[F.col("unit")]
    if year is None:
        wanted = F.col("form") == "10-K"
    else:
        y = F.lit(year) if isinstance(year, int) else year
        wanted = (F.col("fy") == y) | F.contains(F.coalesce("end", F.lit("")), y.cast("string"))
    rows = facts.filter(metric.isNotNull() & unit_rank.isNotNull() & wanted)
    best = F.min_by(F.struct("val", "unit", "end", "form", "tag"), F.struct(tag_rank, unit_rank, -F.col("idx")))
    return rows.groupBy("cik", metric.alias("metric")).agg(best.alias("b")).select(
        "cik", "metric", F.col("b.val").alias("value"), "b.unit", F.col("b.end").alias("period_end"), "b.form", "b.tag")


def renderings(value: Column) -> Column:
    """A number the ways a report may print it: plain, with commas, in millions, in thousands."""
    whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("decimal(38,0)").cast("string")
    return F.array(whole, F.format_number(F.bround(value, 0), 0), F.format_number(F.bround(value / 1_000_000, 0), 0),
                   F.format_number(F.bround(value / 1_000, 0), 0))


def value_in_text(value: Column, text: Column, strict: bool = False) -> Column:
    """Whether any rendering occurs in the text. Lenient by default (6.13 is found as "6"); `strict`
    asks for the number to stand alone."""
    if strict:
        hit = lambda r: F.regexp_like(text, F.concat(F.lit(r"(?<![\d.,])"), r, F.lit(r"(?![\d]|[.,]\d)")))
    else:
        hit = lambda r: F.contains(text, r)
    return F.coalesce(F.exists(renderings(value), hit), F.lit(False))


def cross_check(items: DataFrame, metrics: DataFrame, strict: bool = False) -> DataFrame:
    """items(filing_id, cik, item_number, content_text) x metrics -> found flag per metric in item 8.

    A company's metrics are packed into one row of at most seven before the join, so the long text is
    not repeated per metric.
    """
    packed = metrics.groupBy("cik").agg(F.collect_list(F.struct("metric", "value", "period_end")).alias("m"))
    rows = items.filter((F.col("item_number") == "8") & (F.length("content_text") > 0)).join(packed, "cik")
    checked = F.transform("m", lambda x: F.struct(
        x["metric"].alias("metric"), x["value"].alias("value"), x["period_end"].alias("period_end"),
        value_in_text(x["value"], F.col("content_text"), strict).alias("found_in_text")))
    return rows.select("filing_id", "cik", F.explode(checked).alias("c")).select(
        "filing_id", "cik", "c.metric", "c.value", "c.period_end", "c.found_in_text")


def found_rates(checks: DataFrame) -> DataFrame:
    return checks.groupBy("filing_id").agg(
        F.count(F.lit(1)).alias("metrics"), F.count_if("found_in_text").alias("found"),
        (F.count_if("found_in_text") / F.count(F.lit(1))).alias("found_rate"))
