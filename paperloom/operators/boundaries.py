"""Item boundaries of annual reports: detection, merging, ends, best boundary per item.

One scan of the text yields a narrow row per candidate (heading, stand-alone title, cover-table
row, end-index row, by-reference declaration). The candidates are shuffled once by filing, dealt as the texts
are, and every later step is a window on filing-prefixed keys, so it reuses that exchange; the text itself is
never shuffled here.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions.headings import line_spans
from paperloom.functions.text import LINES, LINES_NOCASE, extract, find_spans, left, let, literal_map, rlike, slice_text, strip, text_array
from paperloom.session import dealt_by, partitions, ship_package

ITEM_NUMBERS = [n for _, n, _ in fixed.ITEMS]


def _title_rows() -> list[tuple[str, str, int, int]]:
    return [
        (shape, item, rank, case)
        for item, variants in fixed.TITLE_ONLY
        for rank, v in enumerate(variants)
        for case, shape in enumerate((v.upper(), v.title(), v))
    ]


def title_pattern() -> str:
    """One pattern for every stand-alone title in its three letter cases, with table-cell noise."""
    import re

    quoted = [re.sub(r"([\[\].])", r"\\\1", shape) for shape, *_ in _title_rows()]
    # Grouped by first letter, so a line costs a few comparisons and not one per title.
    first = {}
    for shape in quoted:
        head = shape[:2] if shape[0] == "\\" else shape[:1]
        first.setdefault(head, []).append(shape[len(head):])
    shapes = "|".join(f"{head}(?:{'|'.join(rest)})" for head, rest in first.items())
    return r"(?:^|\n)\s*(?:\|\s*)*(?:" + shapes + r")(?:\s*\|\s*)*\s*$"


# --- candidates ---------------------------------------------------------------------------------

_LAYOUT = [("kind", "string"), ("idx", "int"), ("gap", "int"), ("hit", "string"), ("pre", "string"), ("post", "string"),
           ("base", "int"), ("item_number", "string"), ("heading_text", "string"), ("rank", "int"), ("status_hint", "string"),
           ("page_note", "string"), ("end_pos", "int"), ("case_rank", "int"), ("toc_like", "boolean"), ("toc_near", "boolean"), ("mid_sentence", "boolean"), ("score", "double"), ("len", "int")]


def _row(**fields: Column) -> Column:
    """A raw candidate with the common layout; missing fields are null."""
    return F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in _LAYOUT])


def _of_kind(kind: str, base: Column):
    return lambda **c: _row(kind=F.lit(kind), base=base, **c)


def _line_rows(heading: bool, title: bool, read: bool = False):
    """Candidates of headings and stand-alone titles: the lines that can match are found before a pattern runs. `read`
    gives what they tell and where they stand, else they are matches as of a plain scan."""
    layout, pattern, titles = _LAYOUT, title_pattern() if title else None, {shape: place for shape, *place in _title_rows()}

    @F.arrow_udf(f"array<struct<{', '.join(f'{n}:{t}' for n, t in _LAYOUT)}>>")
    def rows(texts: pa.Array) -> pa.Array:
        return line_spans(texts, layout, heading, pattern, titles, read)

    return rows


def _part_rows(text: Column, size: Column) -> Column:
    return find_spans(text, LINES_NOCASE + fixed.PART_PATTERN, shape=_of_kind("part", F.lit(0)))


def _end_index_rows(text: Column, size: Column) -> Column:
    base = F.floor(size * F.lit(0.95)).cast("int")
    return find_spans(slice_text(text, base, size), LINES_NOCASE + fixed.END_INDEX_PATTERN, shape=_of_kind("end_index", base))


def _describe(rows: DataFrame, note_chars: int | None = fixed.INDEX_NOTE_CHARS) -> DataFrame:
    """Read the fields of the candidates that carry their match off it (those of headings and titles come with them).
    Plain columns after the explode, so they are compiled; each pattern runs only on rows of its own kind."""
    kind, hit = F.col("kind"), F.col("hit")
    part, index = kind == "part", kind == "end_index"
    end = LINES_NOCASE + fixed.END_INDEX_PATTERN
    roman = literal_map([("1", "I"), ("2", "II"), ("3", "III"), ("4", "IV")])
    rows = (
        rows.withColumn("_raw", F.when(index, F.upper(extract(hit, end, 1))).when(part, F.upper(extract(hit, LINES_NOCASE + fixed.PART_PATTERN, 1))))
        .withColumn("_name", F.when(index, strip(extract(hit, end, 2))))
        .withColumn("_third", F.when(index, strip(extract(hit, end, 3))))
    )
    name, third = F.col("_name"), F.col("_third")
    nil, gone = "(?i)" + fixed.INDEX_NOT_APPLICABLE, "(?i)" + fixed.INDEX_RESERVED
    low = F.lower(third)
    listed = (
        F.when(rlike(name, gone), "reserved").when(rlike(name, nil) | rlike(third, nil), "not_applicable").when(rlike(third, gone), "reserved")
        .when(rlike(third, "(?i)" + fixed.INDEX_PAGES) | F.contains(third, F.lit("Pages")) | rlike(third, r"^\d"), "extracted")
        .when(F.contains(low, F.lit("incorporat")) | F.contains(low, F.lit("proxy")), "incorporated_by_reference").otherwise("extracted")
    )
    short = lambda c: c if note_chars is None else left(c, note_chars)
    return rows.select(
        "filing_id", "total_chars", "kind", "idx", "gap", F.coalesce("len", F.length(hit), F.lit(0)).alias("len"), "base",
        F.when(index, F.col("_raw")).otherwise(F.col("item_number")).alias("item_number"),
        F.when(part, F.coalesce(roman[F.col("_raw")], F.col("_raw")))
        .when(index, F.when(rlike(name, gone), "Reserved").otherwise(short(name))).otherwise(F.col("heading_text")).alias("heading_text"),
        "score", "toc_like", "toc_near", "mid_sentence", "rank", "case_rank",
        F.when(index, listed).otherwise(F.col("status_hint")).alias("status_hint"),
        F.when(index, short(third)).otherwise(F.col("page_note")).alias("page_note"), "end_pos")


def _reference_rows(text: Column, size: Column) -> Column:
    """Items of the cover-page declaration; one candidate per declared item, in list order."""
    flagged = "(?is)" + fixed.MASTER_REFERENCE_PATTERN
    zone = F.when(size > 1000, F.floor(size * F.lit(0.15)).cast("int")).otherwise(size)

    def one(s: Column) -> Column:
        numbers = F.filter(
            F.transform(F.regexp_extract_all(extract(s["hit"], flagged, 1), F.lit(r"\d+[A-C]?"), 0), F.upper),
            lambda n: F.array_contains(text_array(ITEM_NUMBERS), n))
        return F.struct(s["idx"].alias("idx"), s["gap"].alias("gap"), F.length(s["hit"]).alias("len"),
                        numbers.alias("numbers"))

    def offsets(hits: Column) -> Column:
        """The first declaration with a valid item, with its offset (few declarations per cover page)."""
        first = let(F.filter(hits, lambda h: F.size(h["numbers"]) > 0), lambda ok: F.get(ok, F.lit(0)))
        return let(first, lambda d: F.struct(
            d["numbers"].alias("numbers"), d["len"].alias("len"),
            F.aggregate(F.filter(hits, lambda h: h["idx"] <= d["idx"]), F.lit(0),
                        lambda acc, h: acc + h["gap"] + F.when(h["idx"] < d["idx"], h["len"]).otherwise(0)).alias("pos")))

    def rows(d: Column) -> Column:
        return F.transform(F.coalesce(d["numbers"], F.array().cast("array<string>")), lambda n, i: _row(
            kind=F.lit("reference"), idx=i, base=d["pos"] + i, item_number=n,
            rank=F.array_position(d["numbers"], n) - 1,
            status_hint=F.lit("incorporated_by_reference"),
            heading_text=F.concat(F.lit("Item "), n, F.lit(" (incorporated by reference from Proxy Statement)")),
            end_pos=F.least(d["pos"] + d["len"] + 200, zone)))

    found = find_spans(slice_text(text, F.lit(0), zone), flagged)
    return let(F.transform(found, one), lambda hits: let(offsets(hits), rows))


def _cover_rows(text: Column, size: Column) -> Column:
    """Walk the cover table: an item line, its title, its page or status note; consumed lines are skipped.

    The region is at most 10 000 characters, so the walk is a fold over a short array in the row.
    """
    start = F.when(size > 5000, 2000).otherwise(0)
    stop = F.least(start + 10_000, F.when(size > 10_000, F.floor(size * F.lit(0.15)).cast("int")).otherwise(size))
    region = slice_text(text, start, stop)
    # No item line, nothing to walk: most cover pages stop here.
    raw = F.when(rlike(region, LINES + r"^\s*\d{1,2}[A-C]?\.?\s*$"), F.split(region, "\n", -1)).otherwise(
        F.array().cast("array<string>"))
    # Offsets: fold of the line lengths; a short region keeps the quadratic append small.
    placed = F.aggregate(
        raw, F.struct(start.cast("int").alias("pos"),
                      F.array().cast("array<struct<pos:int,line:string>>").alias("rows")),
        lambda acc, ln: F.struct(
            (acc["pos"] + F.length(ln) + 1).alias("pos"),
            F.when(strip(ln) != "", F.concat(acc["rows"], F.array(F.struct(acc["pos"].alias("pos"), strip(ln).alias("line")))))
            .otherwise(acc["rows"]).alias("rows")))["rows"]
    item_line = fixed.COVER_ITEM_LINE
    nil, gone = "(?i)" + fixed.COVER_NOT_APPLICABLE, "(?i)" + fixed.COVER_RESERVED
    entry = "array<struct<item:string,pos:int,title:string,status:string,note:string>>"

    def step(acc: Column, x: Column) -> Column:
        item, nxt, third = x["item"], F.coalesce(x["nxt"], F.lit("")), F.coalesce(x["third"], F.lit(""))
        is_anchor = (
            (x["i"] >= acc["skip"]) & (item != "") & F.array_contains(text_array(ITEM_NUMBERS), item)
            & ~F.exists(acc["rows"], lambda r: r["item"] == item)
        )
        titled = (nxt != "") & ~rlike(nxt, gone) & ~rlike(nxt, item_line)
        kind = F.when(~titled | (third == ""), "none").when(rlike(third, nil), "not_applicable") \
            .when(rlike(third, gone), "reserved").when(rlike(third, fixed.COVER_FOOTNOTE), "incorporated_by_reference") \
            .when(rlike(third, fixed.COVER_PAGES), "pages").when(rlike(third, item_line), "none") \
            .when((F.length(third) < 80) & ~F.startswith(F.lower(third), F.lit("part ")), "note").otherwise("none")

        def taken(kind: Column) -> Column:
            status = F.when(rlike(nxt, gone), "reserved") \
                .when(kind.isin("not_applicable", "reserved", "incorporated_by_reference"), kind).otherwise("extracted")
            consumed = F.when(kind != "none", 3).when((nxt != "") & ~rlike(nxt, item_line), 2).otherwise(1)
            row = F.struct(
                item.alias("item"), x["pos"].alias("pos"),
                F.when(rlike(nxt, gone), "Reserved").when(titled, nxt).otherwise("").alias("title"),
                status.alias("status"), F.when(kind != "none", third).otherwise("").alias("note"))
            return F.struct((x["i"] + consumed).cast("int").alias("skip"), F.concat(acc["rows"], F.array(row).cast(entry)).alias("rows"))

        return F.when(is_anchor, let(kind, taken)).otherwise(acc)

    def walk(lines: Column) -> Column:
        ahead = F.transform(lines, lambda r, i: F.struct(
            i.alias("i"), r["pos"].alias("pos"), F.upper(extract(r["line"], item_line, 1)).alias("item"),
            F.get(lines, i + 1)["line"].alias("nxt"), F.get(lines, i + 2)["line"].alias("third")))
        zero = F.struct(F.lit(0).alias("skip"), F.array().cast(entry).alias("rows"))
        # Only item lines change the walk, so the others are left out of it.
        items = F.filter(ahead, lambda x: x["item"] != "")
        return F.transform(F.aggregate(items, zero, step)["rows"], lambda r, i: _row(
            kind=F.lit("cover"), idx=i, base=r["pos"], item_number=r["item"],
            heading_text=F.when(r["title"] != "", r["title"]).otherwise(F.concat(F.lit("Item "), r["item"])),
            status_hint=r["status"], page_note=r["note"]))

    return let(placed, walk)


_LINE_DETECTORS = ["heading", "title"]  # these two read the text together
_DETECTORS = {"part": _part_rows, "end_index": _end_index_rows, "cover": _cover_rows, "reference": _reference_rows}


def candidates(texts: DataFrame, only: list[str] | None = None, note_chars: int | None = fixed.INDEX_NOTE_CHARS) -> DataFrame:
    """texts(filing_id, text) -> one narrow row per candidate, plus one `doc` row per filing. Titles and notes of an
    end index keep `note_chars` characters (None: all)."""
    t = F.col("text")
    found = [F.array(_row(kind=F.lit("doc")))]
    lines = [name in only if only is not None else True for name in _LINE_DETECTORS]
    # The size is taken before the candidates leave the text's row: behind them it would be counted for each.
    read = texts.select("filing_id", "text", F.length(t).alias("total_chars"))
    if any(lines):
        ship_package(texts.sparkSession)
        read = read.withColumn("_lines", _line_rows(*lines, read=True)(t))
        found.append(F.col("_lines"))
    found += [fn(t, F.col("total_chars")) for name, fn in _DETECTORS.items() if only is None or name in only]
    raw = read.select("filing_id", "total_chars", F.explode(F.concat(*found)).alias("c")).select("filing_id", "total_chars", "c.*")
    # One exchange by filing for every later step; none where the rows lie by filing already. They are dealt as the
    # texts are, so that they meet them where they lie, and a task's share does not grow with the table.
    # The heading goes by another name on the way, so that a plan tells it from a text that is moved.
    rows = _describe(raw, note_chars)
    if not dealt_by(rows, "filing_id"):
        deal = [partitions(texts)] if dealt_by(texts, "filing_id") else []
        rows = rows.withColumnRenamed("heading_text", "_heading").repartition(*deal, "filing_id").withColumnRenamed("_heading", "heading_text")
    run = Window.partitionBy("filing_id", "kind").orderBy("idx")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    pos = (
        F.col("base") + F.coalesce(F.sum("gap").over(run.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
        + F.coalesce(F.sum("len").over(before), F.lit(0))
    )
    return rows.withColumn("start_pos", F.when(F.col("kind") != "doc", pos).cast("int")).drop("gap", "base")


# --- single detectors ----------------------------------------------------------------------------

_IS_HEAD = lambda: F.startswith(F.col("kind"), F.lit("heading"))
_OUT = ["filing_id", "total_chars", "item_number", "start_pos", "end_pos", "heading_text", "confidence", "source",
        "status_hint"]


def _score_headings(rows: DataFrame) -> DataFrame:
    in_front = F.col("start_pos") <= F.col("total_chars") * F.lit(0.20)
    score = F.when(F.col("toc_like") & in_front, F.least("score", F.lit(0.45))).otherwise(F.col("score"))
    return rows.withColumn("confidence", F.when(_IS_HEAD(), score)).withColumn(
        "source", F.when(_IS_HEAD(), F.lit("heading_regex")))


def detect_headings(cands: DataFrame) -> DataFrame:
    """Every match of the four heading patterns for a standard item (a heading may appear twice)."""
    rows = cands.filter(_IS_HEAD() & F.col("item_number").isin(ITEM_NUMBERS))
    return _score_headings(rows).withColumn("pattern", F.substring("kind", 8, 1).cast("int")).select(
        *_OUT, "pattern", "toc_near")


def _mark_resolved(rows: DataFrame) -> DataFrame:
    """Flag the match to keep per item, and adjust its confidence and source."""
    item = Window.partitionBy("filing_id", _IS_HEAD(), "item_number")
    body = F.col("start_pos") > F.col("total_chars") * F.lit(0.10)
    order = item.orderBy(
        F.when(body, 0).otherwise(1), F.when(body, F.col("start_pos")), F.when(body, F.col("kind")),
        F.col("start_pos").desc(), F.col("kind").desc())
    single = F.col("_n") == 1
    near = F.col("toc_near") & (F.col("start_pos") <= F.col("total_chars") * F.lit(0.20))
    suspect = single & ((F.col("start_pos") / F.greatest("total_chars", F.lit(1)) < 0.10) | near)
    return (
        rows.withColumn("_n", F.count(F.lit(1)).over(item)).withColumn("_rn", F.row_number().over(order))
        .withColumn("_sus", suspect)
        .withColumn("source", F.when(_IS_HEAD() & F.col("_sus"), "heading_regex_toc_suspect").otherwise(F.col("source")))
        .withColumn("confidence", F.when(
            _IS_HEAD(),
            F.when(F.col("_sus"), F.least("confidence", F.lit(0.40)))
            .when(~single & body, F.least(F.col("confidence") + 0.05, F.lit(1.0)))
            .otherwise(F.col("confidence"))).otherwise(F.col("confidence")))
        .withColumn("_keep", ~_IS_HEAD() | (F.col("_rn") == 1))
        .drop("_n", "_rn", "_sus")
    )


def resolve_headings(cands: DataFrame) -> DataFrame:
    """One heading per (filing, item): the first in the body, or a doubted single match."""
    rows = cands.filter(_IS_HEAD() & F.col("item_number").isin(ITEM_NUMBERS))
    return _mark_resolved(_score_headings(rows)).filter("_keep").select(*_OUT)


def _title_ok(floor_pct: float = 0.10, ceil_pct: float = 0.90) -> Column:
    size = F.col("total_chars")
    # A title's line may start after the whitespace run it owns, so the floor applies to the line.
    return (
        (F.col("kind") == "title") & ~F.col("mid_sentence") & (F.col("start_pos") >= F.floor(size * F.lit(floor_pct)))
        & (F.col("start_pos") <= F.floor(size * F.lit(ceil_pct)))
    )


def _mark_titles(rows: DataFrame) -> DataFrame:
    ok = _title_ok()
    best = Window.partitionBy("filing_id", ok, "item_number").orderBy("rank", "case_rank", "start_pos")
    bonus = F.when(F.col("case_rank") == 0, 0.10).when(F.col("case_rank") == 1, 0.05).otherwise(0.0)
    return (
        rows.withColumn("_trn", F.row_number().over(best))
        .withColumn("_title", ok & (F.col("_trn") == 1)).drop("_trn")
        .withColumn("confidence", F.when(F.col("_title"), F.least(F.lit(0.55) + bonus, F.lit(0.70)))
                    .otherwise(F.col("confidence")))
        .withColumn("source", F.when(F.col("_title"), "title_only_fallback").otherwise(F.col("source")))
    )


def detect_title_only(cands: DataFrame) -> DataFrame:
    """Stand-alone titles in the body: the most specific variant and letter case, earliest hit."""
    rows = cands.filter(F.col("kind") == "title").withColumn("confidence", F.lit(None).cast("double")) \
        .withColumn("source", F.lit(None).cast("string"))
    return _mark_titles(rows).filter("_title").select(*_OUT)


def detect_parts(cands: DataFrame) -> DataFrame:
    """Last occurrence of every PART heading."""
    return (cands.filter("kind = 'part'").groupBy("filing_id", F.col("heading_text").alias("part"))
            .agg(F.max("start_pos").alias("start_pos")))


_FIXED_SOURCES = {  # kind: (source, confidence, preset length, append order)
    "end_index": ("end_cross_reference", 0.80, 300, 1),
    "cover": ("cover_toc_status", 0.85, 200, 2),
    "reference": ("master_ibr_declaration", 0.85, None, 3),
    "html": ("html_anchor", 0.80, None, 4),
}


def _mark_listed(rows: DataFrame) -> DataFrame:
    """First row per item of each listing (end index, cover table, declaration) with its source."""
    first = Window.partitionBy("filing_id", "kind", "item_number").orderBy("idx")
    source, conf, end = F.col("source"), F.col("confidence"), F.col("end_pos")
    for kind, (name, c, length, _) in _FIXED_SOURCES.items():
        here = F.col("kind") == kind
        source = F.when(here, name).otherwise(source)
        conf = F.when(here, F.lit(c)).otherwise(conf)
        if length:
            end = F.when(here, F.col("start_pos") + length).otherwise(end)
    return (
        rows.withColumn("_first", F.row_number().over(first) == 1)
        .withColumn("source", source).withColumn("confidence", conf).withColumn("end_pos", end.cast("int"))
    )


def _listed(cands: DataFrame, kind: str) -> DataFrame:
    rows = cands.filter((F.col("kind") == kind) & F.col("item_number").isin(ITEM_NUMBERS)) \
        .withColumn("confidence", F.lit(None).cast("double")).withColumn("source", F.lit(None).cast("string"))
    return _mark_listed(rows).filter("_first").select(*_OUT, "page_note")


def cover_table(cands: DataFrame) -> DataFrame:
    """Status hints from the contents table on the cover page."""
    return _listed(cands, "cover")


def end_index(cands: DataFrame) -> DataFrame:
    """Status hints from the cross-reference index at the end of the document."""
    return _listed(cands, "end_index")


def reference_declaration(cands: DataFrame) -> DataFrame:
    """Items the cover page declares to be incorporated by reference."""
    return _listed(cands, "reference")


# --- merge, ends, best ------------------------------------------------------------------------------

def merge_boundaries(cands: DataFrame, html_anchors: DataFrame | None = None) -> DataFrame:
    """All detectors combined, in document order, still possibly several rows per item.

    Stand-alone titles are used only where the heading patterns found nothing usable: no heading, all
    in the last 5 %, or all doubtful. A `doc` row per filing stays, so empty filings are not lost.
    """
    known = (F.col("kind") == "doc") | ((F.col("kind") != "part") & F.col("item_number").isin(ITEM_NUMBERS))
    rows = cands.filter(known)
    if html_anchors is not None:
        rows = rows.unionByName(
            html_anchors.select("filing_id", "total_chars", F.lit("html").alias("kind"), "item_number", "start_pos",
                                "heading_text", F.lit(0).alias("idx")), allowMissingColumns=True)
    rows = _mark_resolved(_score_headings(rows)).filter("_keep").drop("_keep")
    rows = _mark_listed(_mark_titles(rows))
    filing = Window.partitionBy("filing_id")
    late = F.col("start_pos") > F.col("total_chars") * F.lit(0.95)
    suspect = F.col("source") == "heading_regex_toc_suspect"
    head = _IS_HEAD()
    rows = (
        rows.withColumn("_heads", F.count(F.when(head, 1)).over(filing))
        .withColumn("_usable_pos", F.count(F.when(head & ~late, 1)).over(filing))
        .withColumn("_usable_src", F.count(F.when(head & ~suspect, 1)).over(filing))
        .withColumn("_titles", F.count(F.when(F.col("_title"), 1)).over(filing))
        .withColumn("_item_titled", F.max(F.col("_title").cast("int")).over(
            Window.partitionBy("filing_id", "item_number")) == 1)
    )
    fallback = ((F.col("_usable_pos") == 0) | (F.col("_usable_src") == 0)) & (F.col("_titles") > 0)
    keep = (
        F.when(head, ~F.col("_fallback") | (~suspect & ~late & ~F.col("_item_titled")))
        .when(F.col("kind") == "title", F.col("_fallback") & F.col("_title"))
        .when(F.col("kind") == "doc", True)
        .otherwise(F.col("_first"))
    )
    rank = F.when(F.col("kind") == "doc", 9).when(head | (F.col("kind") == "title"), 0)
    for kind, (*_, order) in _FIXED_SOURCES.items():
        rank = rank.when(F.col("kind") == kind, order)
    return (
        rows.withColumn("_fallback", fallback).filter(keep).withColumn("append_rank", rank)
        .withColumn("title_fallback", F.col("_fallback"))
        .select(*_OUT, "append_rank", "title_fallback")
    )


def assign_ends(merged: DataFrame) -> DataFrame:
    """Each boundary ends where the next body boundary begins; cover-page snippets keep their end."""
    order = Window.partitionBy("filing_id").orderBy(F.col("start_pos").asc_nulls_last(), "append_rank", "item_number")
    cover = F.col("source").isin(fixed.COVER_SOURCES)
    following = order.rowsBetween(1, Window.unboundedFollowing)
    next_start, next_cover = F.lead("start_pos").over(order), F.lead(cover.cast("int")).over(order)
    next_body = F.first(F.when(~cover, F.col("start_pos")), ignorenulls=True).over(following)
    end = (
        F.when(cover & (F.col("end_pos") > 0), F.col("end_pos"))
        .when(next_start.isNull(), F.col("total_chars"))
        .when(next_cover == 1, F.coalesce(next_body, F.col("total_chars")))
        .otherwise(next_start)
    )
    return merged.withColumn("end_pos", F.when(F.col("source").isNotNull(), end).cast("int")).withColumn(
        "doc_order", F.row_number().over(order))


def best_boundaries(ended: DataFrame) -> DataFrame:
    """One boundary per (filing, item): declared status first, then length, then source, then order."""
    size = F.greatest(F.when(F.col("end_pos") > 0, F.col("end_pos")).otherwise(F.col("total_chars"))
                      - F.col("start_pos"), F.lit(0))
    declared = F.coalesce(F.col("status_hint").isin(fixed.AUTHORITATIVE_HINTS), F.lit(False)).cast("int")
    priority = F.coalesce(literal_map(list(fixed.SOURCE_PRIORITY.items()))[F.col("source")], F.lit(0))
    order = Window.partitionBy("filing_id", "item_number").orderBy(
        declared.desc(), size.desc(), priority.desc(), "doc_order")
    return ended.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def boundaries(texts: DataFrame, html_anchors: DataFrame | None = None) -> DataFrame:
    """The full rule pass: texts -> merged boundaries with ends (`doc` rows have a null source)."""
    needed = [*_LINE_DETECTORS, *[d for d in _DETECTORS if d != "part"]]
    return assign_ends(merge_boundaries(candidates(texts, needed), html_anchors))
