"""Item anchors from markup: heading-like elements matched to items and located in the text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions.text import let, literal_map
from paperloom.session import ship_package


def title_index() -> list[tuple[str, str]]:
    """(title, item), each title once, longest first; equal lengths keep their order."""
    pairs = [(t.lower(), n) for _, n, t in fixed.ITEMS]
    pairs += [(v, n) for n, words in fixed.TITLE_VARIANTS.items() for v in words] + fixed.HTML_TITLE_EXTRAS
    return sorted({t: n for t, n in reversed(pairs)}.items(), key=lambda p: (-len(p[0]), [t for t, _ in pairs].index(p[0])))


def match_title(heading: Column) -> Column:
    """struct(item_number, variant): exact title, else prefix (30 spare characters), else a contained
    title of 12 and more (50 spare); null when nothing fits."""
    index = title_index()
    dim = F.array(*[F.struct(F.lit(t).alias("variant"), F.lit(n).alias("item_number"), F.lit(len(t)).alias("size")) for t, n in index])
    flat = F.trim(F.regexp_replace(F.lower(heading), r"(?U)\s+", " "))
    bare = F.regexp_replace(F.btrim(flat, F.lit(" .:;,—-")), r"^item\s+\d+[a-c]?\s*[.:—-]*\s*", "")

    def pick(norm: Column) -> Column:
        first = lambda test: F.get(F.filter(dim, test), F.lit(0))
        exact = literal_map(index)[norm]
        prefix = first(lambda d: F.startswith(norm, d["variant"]) & (F.length(norm) <= d["size"] + 30))
        inside = first(lambda d: (F.length(norm) <= d["size"] + 50) & (d["size"] >= 12) & F.contains(norm, d["variant"]))
        row = lambda n, v: F.struct(n.alias("item_number"), v.alias("variant"))
        return F.when((norm == "") | (F.length(norm) > 200), None).when(exact.isNotNull(), row(exact, norm)) \
            .when(prefix.isNotNull(), row(prefix["item_number"], prefix["variant"])) \
            .when(inside.isNotNull(), row(inside["item_number"], inside["variant"]))

    return let(F.trim(bare), pick)


def heading_candidates(raw: DataFrame) -> DataFrame:
    """(filing_id, content) -> heading-like elements in document order."""
    ship_package(raw.sparkSession)

    def parse(batches):
        from paperloom.functions.markup import heading_candidates as find

        for pdf in batches:
            rows = [(f, i, text, tag) for f, c in zip(pdf["filing_id"], pdf["content"]) for i, (text, tag) in enumerate(find(c or ""))]
            yield pd.DataFrame(rows, columns=["filing_id", "ord", "heading_text", "tag"])

    kind = raw.schema["filing_id"].dataType.simpleString()
    return raw.select("filing_id", "content").mapInPandas(parse, f"filing_id {kind}, ord int, heading_text string, tag string")


def locate_anchors(matched: DataFrame, texts: DataFrame, floor: float = 0.05, ceil: float = 0.95) -> DataFrame:
    """matched(filing_id, ord, heading_text, item_number, variant) -> earliest anchor per item.

    A heading counts at its first occurrence past 12 % of the text, else at its first one in the body.
    Equal headings are packed once per filing, and the text is joined once.
    """
    packed = matched.groupBy("filing_id", "item_number", "heading_text", "variant").agg(F.min("ord").alias("ord")) \
        .groupBy("filing_id").agg(F.collect_list(F.struct("ord", "item_number", "heading_text", "variant")).alias("c"))
    rows = texts.select("filing_id", "text").join(packed, "filing_id")

    def find(low: Column) -> Column:
        size = F.length(low)
        lo, hi, front = (F.floor(size * F.lit(p)).cast("int") for p in (floor, ceil, 0.12))

        def first(needle: Column, start: Column) -> Column:
            at = F.call_function("locate", needle, low, start + 1) - 1
            return F.when((at >= 0) & (at < hi), at)

        def place(c: Column) -> Column:
            head = F.lower(c["heading_text"])
            pos = F.coalesce(first(head, F.greatest(lo, front)), first(head, lo),
                             first(c["variant"], F.greatest(lo, front)), first(c["variant"], lo))
            return F.struct(c["ord"].alias("ord"), c["item_number"].alias("item_number"), c["heading_text"].alias("heading_text"), pos.alias("pos"))

        return F.transform("c", place)

    placed = rows.select("filing_id", F.length("text").alias("total_chars"), F.explode(let(F.lower("text"), find)).alias("p")) \
        .select("filing_id", "total_chars", "p.*").filter(F.col("pos").isNotNull())
    best = Window.partitionBy("filing_id", "item_number").orderBy("pos", "ord")
    return placed.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").select(
        "filing_id", "total_chars", "item_number", F.col("pos").cast("int").alias("start_pos"), "heading_text")


def html_anchors(raw: DataFrame, texts: DataFrame) -> DataFrame:
    matched = heading_candidates(raw).withColumn("m", match_title(F.col("heading_text"))).filter("m is not null").select(
        "filing_id", "ord", "heading_text", "m.item_number", "m.variant")
    return locate_anchors(matched, texts)
