"""Hand-over to and from an external model run: queue, gaps, excerpts, applied results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions.text import left, let, slice_text, text_array
from paperloom.operators.boundaries import ITEM_NUMBERS

_ROW = ["item_number", "start_pos", "heading_text", "confidence", "source"]


def _packed(bounds: DataFrame) -> DataFrame:
    """One short row per filing: its size and its anchors in document order."""
    anchor = F.struct("start_pos", "doc_order", "item_number", "heading_text", "confidence", "source", "status_hint")
    return bounds.groupBy("filing_id").agg(
        F.max("total_chars").alias("total_chars"), F.array_sort(F.collect_list(F.when(F.col("source").isNotNull(), anchor))).alias("anchors"))


def _pieces(packed: DataFrame, texts: DataFrame, found: Column, cut) -> DataFrame:
    """What `cut` makes of every entry of `found`, beside its text: one join per filing, and only the pieces leave the
    filing's row. Over a stored corpus the text is not moved for it."""
    rows = texts.select("filing_id", "text").join(packed.select("filing_id", found.alias("_found")), "filing_id")
    return rows.select("filing_id", F.explode(F.transform("_found", cut)).alias("p")).select("filing_id", "p.*")


def refine_queue(bounds: DataFrame, texts: DataFrame, threshold: float = 0.5, forced: int | None = None) -> DataFrame:
    """Doubtful boundaries with the text around them. `forced`: the k least certain of every filing."""
    if forced is None:
        doubtful = F.filter("anchors", lambda a: a["confidence"] < threshold)
    else:
        least_first = F.array_sort(F.transform("anchors", lambda a: F.struct(a["confidence"].alias("c"), a["start_pos"].alias("s"), a["item_number"].alias("i"), a.alias("a"))))
        doubtful = F.transform(F.slice(least_first, 1, max(1, forced)), lambda x: x["a"])

    def cut(a: Column) -> Column:
        start = F.greatest(a["start_pos"] - 200, F.lit(0))
        context = slice_text(F.col("text"), start, F.least(F.length("text"), a["start_pos"] + 800))
        return F.struct(*[a[c].alias(c) for c in _ROW], start.alias("ctx_start"), context.alias("context"))

    return _pieces(_packed(bounds), texts, doubtful, cut).withColumn("est_tokens", F.floor(F.length("context") / 4))


def missing_item_gaps(bounds: DataFrame, texts: DataFrame, sample_chars: int | None = None) -> DataFrame:
    """Long stretches (over 2000 characters) between neighbours, where items are missing, with their text
    (its first `sample_chars`, if given)."""
    lacking = F.size(F.array_except(text_array(ITEM_NUMBERS), F.transform("anchors", lambda a: a["item_number"]))) > 0

    def pair(a: Column, i: Column) -> Column:
        after = F.get(F.col("anchors"), i + 1)
        return F.struct(a["item_number"].alias("prev_item"), after["item_number"].alias("next_item"), a["start_pos"].alias("start_pos"), after["start_pos"].alias("next_pos"))

    gaps = F.filter(F.transform("anchors", pair), lambda g: lacking & (g["next_pos"] - g["start_pos"] > 2000))

    def cut(g: Column) -> Column:
        end = g["next_pos"] if sample_chars is None else F.least(g["next_pos"], g["start_pos"] + sample_chars)
        return F.struct(*[g[c].alias(c) for c in ("prev_item", "next_item", "start_pos", "next_pos")], slice_text(F.col("text"), g["start_pos"], end).alias("sample"))

    return _pieces(_packed(bounds), texts, gaps, cut).withColumn("est_tokens", F.floor(F.length("sample") / 4))


_GAP = ["gap_id", "prev_item", "next_item", "gap_start", "gap_end"]


def _gaps() -> Column:
    """The stretches between the anchors of a packed row, before the first and after the last one."""
    size, anchors = F.col("total_chars"), F.col("anchors")
    pct = lambda p: F.floor(size * F.lit(p)).cast("int")
    gap = lambda *values: F.struct(*[v.alias(c) for c, v in zip(_GAP, values)])

    def beside(a: Column, i: Column) -> Column:
        after = F.get(anchors, i + 1)
        last = after.isNull()
        lead_in = F.when((i == 0) & (a["start_pos"] > 200) & (a["start_pos"] > pct(0.05)),
                         gap(F.lit("gap_0"), F.lit("START"), a["item_number"], pct(0.05), a["start_pos"]))
        end = F.when(last, pct(0.92)).otherwise(after["start_pos"])
        room = end - (a["start_pos"] + 100)
        body = F.when(F.when(last, room > 500).otherwise(room >= 500), gap(
            F.concat(F.lit("gap_"), (i + 1).cast("string")), a["item_number"], F.coalesce(after["item_number"], F.lit("END")), a["start_pos"] + 100, end))
        return F.array_compact(F.array(lead_in, body))

    bare = F.array(gap(F.lit("gap_0"), F.lit("START"), F.lit("END"), pct(0.05), pct(0.95)))
    return F.when(F.size(anchors) == 0, bare).otherwise(F.flatten(F.transform(anchors, beside)))


def gap_ranges(bounds: DataFrame) -> DataFrame:
    """Stretches between anchors, before the first and after the last (narrow; filings without anchors have one)."""
    return _packed(bounds).select("filing_id", F.explode(_gaps()).alias("g")).select("filing_id", "g.*")


#: Head, middle and tail of an excerpt for a model with a small window.
SMALL_WINDOW = (fixed.GAP_HEAD, fixed.GAP_MID, fixed.GAP_TAIL)


def excerpt(gap: Column, window: tuple[int, int, int] | None = None) -> Column:
    """The whole gap; with a window, head, middle and tail of longer ones, with markers that tell how much
    was left out."""
    if window is None:
        return gap
    head, middle, tail = window

    def cut(g: Column) -> Column:
        size = F.length(g)
        mid = F.floor((size - middle) / 2).cast("int")
        note = lambda n: F.concat(F.lit("\n\n[..."), n.cast("string"), F.lit(" chars omitted...]\n\n"))
        return F.when(size <= head + middle + tail, g).otherwise(F.concat(
            left(g, head), note(mid - head), slice_text(g, mid, mid + middle), note(size - mid - middle - tail), F.right(g, F.lit(tail))))

    return let(gap, cut)


def gap_excerpts(bounds: DataFrame, texts: DataFrame, window: tuple[int, int, int] | None = None, full_doc_chars: int = fixed.FULL_DOC_CHARS) -> DataFrame:
    """Every gap with its text (`window`: see `excerpt`), and whether the document fits a model whole."""
    def cut(g: Column) -> Column:
        return F.struct(*[g[c].alias(c) for c in _GAP], excerpt(slice_text(F.col("text"), g["gap_start"], g["gap_end"]), window).alias("excerpt"),
                        (F.length("text") <= full_doc_chars).alias("full_doc_mode"))

    return _pieces(_packed(bounds), texts, _gaps(), cut)


def excerpt_to_text(ex: Column, at: Column, gap_start: Column) -> Column:
    """A position inside an excerpt as a position in the text: omitted characters count, markers do not."""
    marker = r"\[\.\.\.(\d+)\s+chars\s+omitted\.\.\.\]"
    notes = F.regexp_extract_all(ex, F.lit(marker), 0)
    skipped = F.regexp_extract_all(ex, F.lit(marker), 1)
    where = lambda x: F.instr(ex, x["note"]) - 1
    pairs = F.zip_with(notes, skipped, lambda n, s: F.struct(n.alias("note"), s.alias("skip")))
    # A position inside a marker maps to the end of what the marker stands for.
    in_marker = F.aggregate(pairs, F.lit(0), lambda acc, x: acc + F.when(
        (where(x) < at) & (at < where(x) + F.length(x["note"])), where(x) + F.length(x["note"]) - at).otherwise(0))
    base = F.aggregate(pairs, F.lit(0), lambda acc, x: acc + F.when(
        where(x) < at, x["skip"].cast("int") - F.length(x["note"])).otherwise(0))
    return (gap_start + at + base + in_marker).cast("int")


def _hint(status: Column) -> Column:
    s = F.trim(F.coalesce(status, F.lit("")))
    return F.when(~s.isin("", "not_found"), s)


def apply_refinements(bounds: DataFrame, results: DataFrame, texts: DataFrame, window: tuple[int, int, int] | None = None) -> DataFrame:
    """Merge a model run's rows into the boundaries and set the ends anew.

    results(filing_id, kind, gap_id, item_number, found, is_item_heading, offset, start_pos,
    heading_text, confidence, status). `refine` rows move the boundary of their own item; `gap` rows
    add an item that is missing, found in a known gap; `full` rows are located by heading text. `window`
    must be the one the excerpts were made with. Boundaries and results are packed to one short row per filing
    each and meet the text there, so all of it is two joins on the filing.
    """
    given = results.groupBy("filing_id").agg(F.collect_list(F.struct(
        "kind", "gap_id", "item_number", "found", "is_item_heading", "offset", "start_pos", "heading_text", "confidence", "status")).alias("results"))
    packed = _packed(bounds)
    rows = packed.withColumn("gaps", _gaps()).join(given, "filing_id", "left").join(texts.select("filing_id", "text"), "filing_id", "left") \
        .withColumn("results", F.coalesce("results", F.expr("array()").cast(given.schema["results"].dataType)))
    made = _moved(), _from_gaps(window), _from_whole()
    order = Window.partitionBy("filing_id").orderBy("start_pos", "item_number")
    return rows.select("filing_id", "total_chars", F.explode(F.concat(*made)).alias("b")).select("filing_id", "total_chars", "b.*").withColumn(
        "end_pos", F.coalesce(F.lead("start_pos").over(order), F.col("total_chars")).cast("int")).withColumn(
        "doc_order", F.row_number().over(order))


def _bound(item: Column, start: Column, heading: Column, confidence: Column, source: str | Column, hint: Column) -> Column:
    return F.struct(item.alias("item_number"), start.cast("int").alias("start_pos"), heading.alias("heading_text"), confidence.cast("double").alias("confidence"),
                    (F.lit(source) if isinstance(source, str) else source).alias("source"), hint.alias("status_hint"))


def _moved() -> Column:
    """The anchors of a packed row, each as its own `refine` results move it."""
    def one(a: Column) -> Column:
        hits = F.filter("results", lambda r: (r["kind"] == "refine") & r["is_item_heading"] & (F.upper(r["item_number"]) == a["item_number"]))
        origin = F.greatest(a["start_pos"] - 200, F.lit(0))

        def moved(r: Column) -> Column:
            status = F.trim(F.coalesce(r["status"], F.lit("")))
            return _bound(a["item_number"], F.coalesce(origin + r["offset"], a["start_pos"]), F.coalesce(r["heading_text"], a["heading_text"]),
                          F.coalesce(r["confidence"], F.lit(0.8)), "llm_refined", F.when(status != "", status))

        kept = _bound(a["item_number"], a["start_pos"], a["heading_text"], a["confidence"], a["source"], a["status_hint"])
        return let(hits, lambda h: F.when(F.size(h) == 0, F.array(kept)).otherwise(F.transform(h, moved)))

    return F.flatten(F.transform("anchors", one))


def _absent(kind: str) -> Column:
    """The results of a kind that name an item no anchor has."""
    item = lambda r: F.upper(F.trim(r["item_number"]))
    return F.filter("results", lambda r: (r["kind"] == kind) & r["found"] & F.array_contains(text_array(ITEM_NUMBERS), item(r))
                    & ~F.exists("anchors", lambda a: a["item_number"] == item(r)))


def _from_gaps(window: tuple[int, int, int] | None) -> Column:
    """Boundaries that results place inside an excerpt of a known gap."""
    def place(r: Column) -> Column:
        def inside(g: Column) -> Column:
            def at(ex: Column) -> Column:
                heading = F.coalesce(r["heading_text"], F.lit(""))
                named = F.when(heading != "", F.instr(ex, heading) - 1)
                pos = let(F.when(named >= 0, named).otherwise(r["offset"].cast("int")), lambda x: excerpt_to_text(ex, x, g["gap_start"]))
                fits = (r["offset"] >= 0) & (r["offset"] < F.length(ex))
                return let(pos, lambda p: F.when(fits & (p >= g["gap_start"]) & (p < g["gap_end"]), _bound(
                    F.upper(F.trim(r["item_number"])), p, heading, F.coalesce(r["confidence"], F.lit(0.7)), "llm_anchor_gap_fill", _hint(r["status"]))))

            return let(excerpt(slice_text(F.col("text"), g["gap_start"], g["gap_end"]), window), at)

        return F.transform(F.filter("gaps", lambda g: g["gap_id"] == r["gap_id"]), inside)

    return F.array_compact(F.flatten(F.transform(_absent("gap"), place)))


def _from_whole() -> Column:
    """Boundaries that results name by heading text, or by position, in the whole document."""
    text = F.col("text")

    def place(r: Column) -> Column:
        def at(head: Column) -> Column:
            exact, loose = F.instr(text, head) - 1, F.instr(F.lower(text), F.lower(head)) - 1
            long = F.length(head) >= 4
            pos = F.when(long & (exact >= 0), exact).when(long & (loose >= 0), loose).otherwise(r["start_pos"])
            item = F.upper(F.trim(r["item_number"]))
            return let(pos, lambda p: F.when((p >= 0) & (p < F.length(text)), _bound(
                item, p, F.when(head != "", head).otherwise(item), F.coalesce(r["confidence"], F.lit(0.7)), "llm_full_doc_extract", _hint(r["status"]))))

        return let(F.trim(F.coalesce(r["heading_text"], F.lit(""))), at)

    return F.array_compact(F.transform(_absent("full"), place))
