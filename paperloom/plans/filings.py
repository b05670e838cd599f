"""Registered queries over report filings, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import boundaries as B
from paperloom.operators import filing_text as T
from paperloom.operators import items as I
from paperloom.operators import refine as R
from paperloom.plans import adapters as A
from paperloom.plans import filings_oracle as O
from paperloom.session import cut_lineage, work_folder
from paperloom.sources.corpus_store import read_corpus, write_corpus


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return A.bind(spark, folder, A.FILINGS)


def _digest(df: DataFrame) -> DataFrame:
    """Long texts travel as a hash in the compared result."""
    return df.withColumn("content_md5", F.md5("content_text")).drop("content_text")


def filing_items(spark, folder):
    return _digest(I.extract_items(texts(spark, folder))).select(
        "filing_id", "part", "item_number", "item_title", "range_start", "range_end", F.round("confidence", 4).alias("confidence"),
        "extraction_method", "status", "content_md5")


def item_headings(spark, folder):
    return B.detect_headings(B.candidates(texts(spark, folder), ["heading"])).select(
        "filing_id", "item_number", "start_pos", "pattern", "heading_text", F.round("confidence", 4).alias("confidence"))


def resolved_headings(spark, folder):
    return B.resolve_headings(B.candidates(texts(spark, folder), ["heading"])).select(
        "filing_id", "item_number", "start_pos", "heading_text", F.round("confidence", 4).alias("confidence"), "source")


def title_headings(spark, folder):
    return B.detect_title_only(B.candidates(texts(spark, folder), ["title"])).select(
        "filing_id", "item_number", "start_pos", "heading_text", F.round("confidence", 4).alias("confidence"))


def part_positions(spark, folder):
    return B.detect_parts(B.candidates(texts(spark, folder), ["part"]))


def _listing(fn, kind):
    def run(spark, folder):
        return fn(B.candidates(texts(spark, folder), [kind])).select(
            "filing_id", "item_number", "start_pos", "end_pos", "heading_text", "status_hint")
    return run


def merged_boundaries(spark, folder):
    return B.boundaries(texts(spark, folder)).filter("source is not null").select(
        "filing_id", "item_number", "start_pos", "end_pos", "heading_text", F.round("confidence", 4).alias("confidence"),
        "source", F.coalesce("status_hint", F.lit("")).alias("status_hint"))


def best_boundaries(spark, folder):
    return B.best_boundaries(B.boundaries(texts(spark, folder))).filter("source is not null").select(
        "filing_id", "item_number", "start_pos", "end_pos", "source")


def item_slices(spark, folder):
    t = texts(spark, folder)
    return _digest(I.slice_items(B.best_boundaries(B.boundaries(t)), t)).select(
        "filing_id", "part", "item_number", "item_title", "range_start", "range_end", "status", "content_md5")


def item_status_counts(spark, folder):
    return I.extract_items(texts(spark, folder)).groupBy("item_number", "status").agg(F.count(F.lit(1)).alias("filings"))


def filled_items(spark, folder):
    t = texts(spark, folder)
    sliced = I.slice_items(B.best_boundaries(B.boundaries(t)), t)
    return I.fill_missing(sliced, t.select("filing_id")).select(
        "filing_id", "item_number", "status", F.round("confidence", 4).alias("confidence"), "range_start", "range_end", "ord")


def fixed_items(spark, folder):
    t = texts(spark, folder)
    return _digest(I.extract_items(t, validate=True)).select(
        "filing_id", "item_number", "status", "range_start", "range_end", "content_md5")


def item_issues(spark, folder):
    t = texts(spark, folder)
    return I.extract_items(t, validate=True).select("filing_id", "item_number", F.explode("issues").alias("i")).select(
        "filing_id", "item_number", "i.check", "i.severity")


def validation_report(spark, folder):
    t = texts(spark, folder)
    return I.validation_report(I.extract_items(t, validate=True))


def extraction_summary(spark, folder):
    t = texts(spark, folder)
    bounds = cut_lineage(B.boundaries(t))  # narrow, and used twice
    return I.extraction_summary(I.extract_items(t, bounds=bounds), bounds)


def filing_routes(spark, folder):
    return I.route_filings(B.boundaries(texts(spark, folder)))


def line_offsets(spark, folder):
    return T.to_lines(texts(spark, folder)).groupBy("filing_id").agg(
        F.count(F.lit(1)).alias("lines"), F.max("start_pos").alias("last_start"),
        F.sum(F.col("start_pos") * F.col("line_no")).alias("checksum"))


def toc_lines(spark, folder):
    return T.extract_toc(texts(spark, folder))


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The filings as a stored corpus, read by its folder as another application would."""
    at = work_folder(spark, "corpus")
    write_corpus(texts(spark, folder), at)
    return read_corpus(spark, at)


def stored_items(spark, folder):
    return _digest(I.extract_items(stored(spark, folder))).select(
        "filing_id", "part", "item_number", "item_title", "range_start", "range_end", F.round("confidence", 4).alias("confidence"),
        "extraction_method", "status", "content_md5")


def stored_validation(spark, folder):
    return I.validation_report(I.extract_items(stored(spark, folder), validate=True))


def stored_gap_excerpts(spark, folder):
    t = stored(spark, folder)
    return R.gap_excerpts(B.boundaries(t), t).select(
        "filing_id", "gap_id", "prev_item", "next_item", "gap_start", "gap_end", F.md5("excerpt").alias("excerpt_md5"), "full_doc_mode")


QUERIES = {
    "stored_items": stored_items,
    "stored_validation": stored_validation,
    "stored_gap_excerpts": stored_gap_excerpts,
    "filing_items": filing_items,
    "item_headings": item_headings,
    "resolved_headings": resolved_headings,
    "title_headings": title_headings,
    "part_positions": part_positions,
    "cover_toc_status": _listing(B.cover_table, "cover"),
    "end_index_status": _listing(B.end_index, "end_index"),
    "reference_declarations": _listing(B.reference_declaration, "reference"),
    "merged_boundaries": merged_boundaries,
    "best_boundaries": best_boundaries,
    "item_slices": item_slices,
    "item_status_counts": item_status_counts,
    "filled_items": filled_items,
    "fixed_items": fixed_items,
    "item_issues": item_issues,
    "validation_report": validation_report,
    "extraction_summary": extraction_summary,
    "filing_routes": filing_routes,
    "line_offsets": line_offsets,
    "toc_lines": toc_lines,
}

_LISTED = "SELECT filing_id, item_number, start_pos, end_pos, heading_text, status_hint FROM "
_SUM = """SELECT filing_id, count(*) AS items_found, max(total_chars) AS filing_chars,
  sum(confidence::DECIMAL(12,6))::DOUBLE / greatest(count(*), 1) AS confidence_avg FROM ended GROUP BY filing_id"""

ORACLE = {
    "filing_items": O.chain(*O.FULL) + """SELECT filing_id, part, item_number, item_title, range_start, range_end, round(confidence, 4) AS confidence,
      extraction_method, status, md5(content_text) AS content_md5 FROM items""",
    "item_headings": O.chain(O.F, O.heads()) + "SELECT filing_id, item_number, start_pos, pattern, heading_text, round(confidence, 4) AS confidence FROM headings",
    "resolved_headings": O.chain(O.F, O.heads(), O.RESOLVED) + "SELECT filing_id, item_number, start_pos, heading_text, round(confidence, 4) AS confidence, source FROM resolved",
    "title_headings": O.chain(O.F, O.titles()) + "SELECT filing_id, item_number, start_pos, heading_text, round(confidence, 4) AS confidence FROM titles",
    "part_positions": O.chain(O.F, O.PARTS) + "SELECT * FROM parts",
    "cover_toc_status": O.chain(O.F, O.cover()) + _LISTED + "cover_toc",
    "end_index_status": O.chain(O.F, O.end_index()) + _LISTED + "end_index",
    "reference_declarations": O.chain(O.F, O.declared()) + _LISTED + "declared",
    "merged_boundaries": O.chain(*O.DETECT) + "SELECT filing_id, item_number, start_pos, end_pos, heading_text, round(confidence, 4) AS confidence, source, coalesce(status_hint, '') AS status_hint FROM ended",
    "best_boundaries": O.chain(*O.DETECT) + "SELECT filing_id, item_number, start_pos, end_pos, source FROM best",
    "item_slices": O.chain(*O.DETECT, O.DIM, O.SLICED) + "SELECT filing_id, part, item_number, item_title, range_start, range_end, status, md5(content_text) AS content_md5 FROM sliced",
    "item_status_counts": O.chain(*O.FULL) + "SELECT item_number, status, count(*) AS filings FROM items GROUP BY ALL",
    "filled_items": O.chain(*O.FULL) + "SELECT filing_id, item_number, status, round(confidence, 4) AS confidence, range_start, range_end, ord FROM items",
    "fixed_items": O.chain(*O.FULL, O.FIXED) + "SELECT filing_id, item_number, status, range_start, range_end, md5(content_text) AS content_md5 FROM fixed_items",
    "item_issues": O.chain(*O.FULL, O.FIXED, O.ISSUES) + 'SELECT filing_id, item_number, "check", severity FROM issues',
    "validation_report": O.chain(*O.FULL, O.FIXED, O.ISSUES, O.REPORT) + """SELECT c.filing_id, found, placeholder_not_found, coalesce(missing, 0) AS missing, coalesce(missing_required, '') AS missing_required,
      found > 0 AND coalesce(n_required, 0) = 0 AS coverage_ok, true AS ordering_ok, dupes = 0 AS no_duplicates,
      coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings,
      found > 0 AND coalesce(n_required, 0) = 0 AND coalesce(errors, 0) = 0 AS overall_valid
      FROM coverage c LEFT JOIN gone g ON g.filing_id = c.filing_id LEFT JOIN tally t ON t.filing_id = c.filing_id""",
    "extraction_summary": O.chain(*O.FULL, f"sums AS ({_SUM})") + """SELECT i.filing_id,
      count(*) FILTER (WHERE status = 'extracted') AS n_extracted, count(*) FILTER (WHERE status = 'incorporated_by_reference') AS n_incorporated_by_reference,
      count(*) FILTER (WHERE status = 'not_applicable') AS n_not_applicable, count(*) FILTER (WHERE status = 'reserved') AS n_reserved,
      count(*) FILTER (WHERE status = 'not_found') AS n_not_found, count(*) FILTER (WHERE status <> 'not_found') AS extracted_count,
      count(*) AS rule_only_items, 0 AS refined_items, coalesce(any_value(items_found), 0) AS items_found,
      any_value(f.total_chars) AS filing_chars, coalesce(any_value(confidence_avg), 0) AS confidence_avg, 23 AS expected_count,
      round(least(1.0::DOUBLE, count(*) FILTER (WHERE status <> 'not_found') / 23), 3) AS extraction_completeness
      FROM items i JOIN f ON f.filing_id = i.filing_id LEFT JOIN sums s ON s.filing_id = i.filing_id GROUP BY i.filing_id""",
    "filing_routes": O.chain(*O.DETECT, f"sums AS ({_SUM})", """req AS (SELECT filing_id, count(DISTINCT item_number) = 6 AS ok FROM ended
      WHERE item_number IN ('1', '1A', '7', '7A', '8', '15') GROUP BY filing_id)""") + """SELECT filing_id, items_found, confidence_avg, has_required,
      items_found < 10 OR confidence_avg < 0.55::DOUBLE OR (confidence_avg < 0.75::DOUBLE AND NOT has_required) AS needs_model, items_found < 18 AS needs_gap_fill
      FROM (SELECT f.filing_id, coalesce(items_found, 0) AS items_found, coalesce(confidence_avg, 0) AS confidence_avg, coalesce(ok, false) AS has_required
            FROM f LEFT JOIN sums s ON s.filing_id = f.filing_id LEFT JOIN req r ON r.filing_id = f.filing_id) x""",
    "line_offsets": O.chain(O.F) + """SELECT filing_id, count(*) AS lines, max(start_pos) AS last_start, sum(start_pos * (i - 1))::BIGINT AS checksum FROM (
      SELECT filing_id, i, coalesce(sum(length(line) + 1) OVER (PARTITION BY filing_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_pos
      FROM (SELECT filing_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM f) a) b GROUP BY filing_id""",
    "toc_lines": O.chain(O.F, O.spans("c0", "f", "substr(text, 1, CAST(floor(total_chars / 5) AS INT))", "0", "(?mi)" + O.fixed.TOC_LINE_PATTERN)) + f"""SELECT filing_id,
      upper(regexp_extract(hit, {O.q('(?mi)' + O.fixed.TOC_LINE_PATTERN)}, 2)) AS item_number,
      rtrim({O.strip(f"regexp_extract(hit, {O.q('(?mi)' + O.fixed.TOC_LINE_PATTERN)}, 3)")}, '.') AS title,
      coalesce(regexp_extract(hit, {O.q('(?mi)' + O.fixed.TOC_LINE_PATTERN)}, 4), '') AS page, start_pos AS position_hint FROM c0""",
}

# A stored corpus gives what the plain table gives.
ORACLE |= {"stored_items": ORACLE["filing_items"], "stored_validation": ORACLE["validation_report"]}
