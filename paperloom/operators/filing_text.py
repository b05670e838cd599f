"""Filing text: format census, submission split, normalization, line table, contents lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions.text import LINES_NOCASE, extract, find_spans, left, let, rlike, slice_text, strip
from paperloom.session import ship_package


def format_of(content: Column) -> Column:
    head = F.lower(content)
    return let(head, lambda h: F.when(F.contains(h, F.lit("ix:nonnumeric")) | F.contains(h, F.lit("ix:nonfraction")), "xbrl_html")
               .when(F.contains(h, F.lit("<html")) | F.contains(h, F.lit("<body")), "html").otherwise("text"))


def detect_format(df: DataFrame) -> DataFrame:
    """Adds `format` from the whole of `content`."""
    return df.withColumn("format", format_of(F.col("content")))


def format_census(df: DataFrame) -> DataFrame:
    return detect_format(df.select("content")).groupBy("format").agg(
        F.count(F.lit(1)).alias("filings"), F.sum(F.length("content").cast("bigint")).alias("chars"))


def document_blocks(content: Column) -> Column:
    """The insides of all document blocks of a submission, null without one."""
    wrapped = F.contains(F.upper(content), F.lit("<DOCUMENT>"))
    return F.when(wrapped, F.regexp_extract_all(content, F.lit(r"(?is)<DOCUMENT>(.*?)</DOCUMENT>"), 1))


def block_fields(block: str = "block") -> list[Column]:
    """Type and body of a document block."""
    body = F.when(rlike(F.col(block), r"(?is)<TEXT>.*?</TEXT>"), extract(block, r"(?is)<TEXT>(.*?)</TEXT>", 1)).otherwise(F.col(block))
    return [F.upper(strip(extract(block, r"(?i)<TYPE>\s*([^\n\r<]+)", 1))).alias("doc_type"), strip(body).alias("body")]


def split_submissions(df: DataFrame) -> DataFrame:
    """(filing_id, content) -> one row per document block: position, type and body."""
    return df.select("filing_id", F.posexplode(document_blocks(F.col("content"))).alias("pos", "block")).select("filing_id", "pos", *block_fields())


def primary_document(df: DataFrame) -> DataFrame:
    """(filing_id, content) -> the annual report's own text: first block of that type, else first
    block, else the content itself. A filing's blocks stay in its row, so nothing is shuffled."""
    content = F.col("content")
    wrapped = F.contains(F.upper(content), F.lit("<DOCUMENT>"))
    blocks = F.when(wrapped, F.regexp_extract_all(content, F.lit(r"(?is)<DOCUMENT>(.*?)</DOCUMENT>"), 1)).otherwise(
        F.array().cast("array<string>"))

    def kind(b: Column) -> Column:
        return F.upper(strip(F.regexp_extract(b, r"(?i)<TYPE>\s*([^\n\r<]+)", 1)))

    def choose(found: Column) -> Column:
        annual = F.filter(found, lambda b: kind(b).isin("10-K", "10-K/A"))
        block = F.coalesce(F.get(annual, F.lit(0)), F.get(found, F.lit(0)))
        return let(block, lambda b: F.when(F.size(annual) > 0, F.struct(kind(b).alias("doc_type"), b.alias("b")))
                   .when(b.isNotNull(), F.struct(kind(b).alias("doc_type"), b.alias("b"))))

    picked = let(blocks, choose)
    rows = df.select("filing_id", "content", picked.alias("p"))
    body = F.when(rlike(F.col("p.b"), r"(?is)<TEXT>.*?</TEXT>"), extract("p.b", r"(?is)<TEXT>(.*?)</TEXT>", 1)).otherwise(
        F.col("p.b"))
    cut = strip(body)
    return rows.select(
        "filing_id", F.coalesce("p.doc_type", F.lit("")).alias("doc_type"),
        F.when(F.coalesce(cut, F.lit("")) != "", cut).otherwise(F.col("content")).alias("content"))


def plain_text(content: Column) -> Column:
    t = F.regexp_replace(content, "\f", "\n\n")
    t = F.regexp_replace(t, r"(?md)^-{20,}$", "\n")
    t = F.regexp_replace(t, r"[ \t]{3,}", "  ")
    return strip(F.regexp_replace(t, r"\n{4,}", "\n\n\n"))


def normalize_text(df: DataFrame) -> DataFrame:
    """Plain-text filings: page breaks, separator lines, wide gaps and blank runs."""
    return df.select("filing_id", plain_text(F.col("content")).alias("text"))


def normalize_html(df: DataFrame) -> DataFrame:
    """Markup filings: visible text, one line per text node, block elements set apart.

    The document tree needs Python; batches of rows are parsed in Arrow-backed tasks.
    """
    ship_package(df.sparkSession)

    def parse(batches):
        from paperloom.functions.markup import visible_lines

        for pdf in batches:
            yield pd.DataFrame({"filing_id": pdf["filing_id"],
                                "text": ["\n".join(visible_lines(c or "")) for c in pdf["content"]]})

    schema = df.select("filing_id").schema
    rows = df.select("filing_id", "content").mapInPandas(
        parse, f"filing_id {schema[0].dataType.simpleString()}, text string")
    t = F.regexp_replace("text", "\u00a0", " ")
    t = F.regexp_replace(t, r"\n{4,}", "\n\n\n")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    t = F.regexp_replace(F.regexp_replace(t, r" +\n", "\n"), r"\n +", "\n")
    return rows.select("filing_id", strip(t).alias("text"))


def normalize_filings(df: DataFrame) -> DataFrame:
    """(filing_id, content) -> (filing_id, text, format): primary document, then by format."""
    main = detect_format(primary_document(df))
    marked = main.filter("format <> 'text'")
    plain = main.filter("format = 'text'")
    return (
        normalize_html(marked).withColumn("format", F.lit("html"))
        .unionByName(normalize_text(plain).withColumn("format", F.lit("text")))
    )


def starts_of(sizes: Column, block: int = 512) -> Column:
    """Running sum of an array before each element: blocks are summed first, then each block is walked
    from its start, so the work grows with the array's length times the block."""
    zero = F.lit(0).cast("bigint")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")), lambda k: F.slice(sizes, k * block + 1, F.lit(block)))
    total = lambda a: F.aggregate(a, zero, lambda s, x: s + x)
    # Each walk carries the next start and the starts so far.
    walk = lambda a, first: F.aggregate(a, F.struct(first.alias("next"), F.array().cast("array<bigint>").alias("at")), lambda s, x: F.struct(
        (s["next"] + x).alias("next"), F.concat(s["at"], F.array(s["next"])).alias("at")), lambda s: s["at"])
    return let(blocks, lambda b: F.flatten(F.zip_with(b, walk(F.transform(b, total), zero), walk)))


def to_lines(texts: DataFrame) -> DataFrame:
    """(filing_id, text) -> line table with 0-based character offsets, found inside the filing's row."""
    lines = texts.select("filing_id", F.split("text", "\n", -1).alias("lines")).withColumn("sizes", F.transform("lines", lambda x: F.length(x).cast("bigint") + 1))
    rows = lines.select("filing_id", F.posexplode(F.arrays_zip("lines", starts_of(F.col("sizes")).alias("starts"))).alias("line_no", "x"))
    return rows.select("filing_id", "line_no", F.col("x")["lines"].alias("line"), F.col("x")["starts"].alias("start_pos"))


def extract_toc(texts: DataFrame) -> DataFrame:
    """Contents lines of the first fifth of the text: item, title, position, page."""
    flagged = LINES_NOCASE + fixed.TOC_LINE_PATTERN
    region = slice_text(F.col("text"), F.lit(0), F.floor(F.length("text") / 5).cast("int"))
    rows = texts.select("filing_id", F.explode(find_spans(region, flagged)).alias("s")).select("filing_id", "s.*")
    run = Window.partitionBy("filing_id").orderBy("idx")
    pos = F.sum("gap").over(run) + F.coalesce(
        F.sum(F.length("hit")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select(
        "filing_id", F.upper(extract("hit", flagged, 2)).alias("item_number"),
        F.regexp_replace(strip(extract("hit", flagged, 3)), r"\.+$", "").alias("title"),
        extract("hit", flagged, 4).alias("page"), pos.cast("int").alias("position_hint"))
