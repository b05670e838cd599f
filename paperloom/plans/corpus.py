"""Registered queries over filing sources, the filing index, facts, markup and the refinement hand-over."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.operators import boundaries as B
from paperloom.operators import facts as X
from paperloom.operators import filing_index as N
from paperloom.operators import filing_text as T
from paperloom.operators import html_anchors as H
from paperloom.operators import refine as R
from paperloom.plans import adapters as A
from paperloom.plans import filings_oracle as O
from paperloom.plans.filings import texts
from paperloom.plans.filings_oracle import q, strip
from paperloom.session import cut_lineage, work_folder
from paperloom.sources import filings as S
from paperloom.sources.submissions import read_submission_blocks

NL = "chr(10)"
CIK = "lpad(CAST(o_custkey AS STRING), 10, '0')"
DATE = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
ACC = f"{CIK} || '-' || substr({DATE}, 3, 2) || '-' || lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0')"
INDEX = f"""SELECT {CIK} AS cik, o_orderkey AS ord, CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '10-K/A'
  WHEN '3-MEDIUM' THEN 'DEF 14A' WHEN '5-LOW' THEN '20-F' ELSE '8-K' END AS form, {DATE} AS filing_date, {ACC} AS accession_number,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'doc' || CAST(o_orderkey AS STRING) || '.htm' END AS primary_document, o_orderstatus AS description FROM {{orders}}"""
LOOKUPS = f"""SELECT o_orderkey AS request_id, {CIK} AS cik, CASE WHEN o_orderkey % 3 = 0 THEN replace({ACC}, '-', '') END AS accession_number,
  CASE WHEN o_orderkey % 3 = 1 THEN CAST(1993 + o_orderkey % 8 AS INT) END AS year FROM {{orders}}"""
BY_REFERENCE = f"""SELECT o_orderkey AS filing_id, '10' AS item_number, {CIK} AS cik, {DATE} AS filing_date,
  CASE WHEN o_orderstatus = 'F' THEN 'incorporated_by_reference' ELSE 'extracted' END AS status FROM {{orders}}"""
LISTING = """SELECT CAST(l_orderkey AS STRING) AS accession_number, CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey AS ord, CASE l_partkey % 7 WHEN 0 THEN 'ex10.htm'
  WHEN 1 THEN 'main' || CAST(l_partkey AS STRING) || '.htm' WHEN 2 THEN 'idx-index.html' WHEN 3 THEN CAST(l_orderkey AS STRING) || '.txt' WHEN 4 THEN 'd12dex3.htm'
  WHEN 5 THEN 'Report.HTML' ELSE 'chart.xml' END AS name FROM {lineitem}"""
URLS = """SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'https://www.sec.gov/Archives/edgar/data/' || CAST(page_id AS STRING) || '/' || lpad(CAST(page_id AS STRING), 18, '0') || '/a.htm?x=1'
  WHEN 2 THEN 'https://www.sec.gov/archives/edgar/data/0' || CAST(page_id AS STRING) || '/12/0000320193-23-000106.txt' ELSE '/Archives/edgar/data/77/123/b.htm' END AS url FROM {pages}"""
SUBMISSION = f"""SELECT doc_id AS filing_id, CASE doc_id % 4 WHEN 0 THEN text
  WHEN 1 THEN 'HEADER' || {NL} || '<DOCUMENT>' || {NL} || '<TYPE>EX-99' || {NL} || '<TEXT> exhibit </TEXT></DOCUMENT><document><type> 10-k ' || {NL} || '<TEXT>' || text || '</TEXT></DOCUMENT>'
  WHEN 2 THEN '<DOCUMENT><TYPE>10-Q' || {NL} || text || '</DOCUMENT><DOCUMENT><TYPE>EX-1' || {NL} || 'x</DOCUMENT>'
  ELSE '<DOCUMENT><TYPE>10-K/A' || {NL} || '<TEXT>' || {NL} || text || {NL} || '</TEXT></DOCUMENT>' END AS content FROM {{documents}}"""
PLAIN = f"""SELECT doc_id AS filing_id, 'Page 1' || chr(12) || text || {NL} || repeat('-', 20 + CAST(doc_id % 3 AS INT)) || {NL} || 'a' || repeat(' ', CAST(doc_id % 6 AS INT)) || 'b'
  || repeat({NL}, 2 + CAST(doc_id % 5 AS INT)) || text || '   ' AS content FROM {{documents}}"""
CENSUS = """SELECT html AS content FROM {pages} UNION ALL SELECT CASE WHEN doc_id % 5 = 0 THEN '<IX:nonNumeric>' || text ELSE text END FROM {documents}"""
FACT_JSON = """SELECT CAST(l_orderkey * 100 + l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS cik, '{{"facts": {{"us-gaap": {{"' || CASE l_linenumber % 3 WHEN 0 THEN 'Revenues' WHEN 1 THEN 'Assets' ELSE 'Liabilities' END
  || '": {{"units": {{"USD": [{{"val": ' || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) || ', "fy": 2001, "end": "' || CAST(CAST(l_shipdate AS DATE) AS STRING)
  || '", "form": "10-K"}}, {{"val": ' || CAST(l_linenumber AS STRING) || ', "fy": 2002, "end": "", "form": "8-K"}}]}}}}}}}}}}' AS payload FROM {lineitem}"""
FACTS = """SELECT CAST(l_suppkey AS STRING) AS cik, CASE l_linenumber WHEN 1 THEN 'Revenues' WHEN 2 THEN 'SalesRevenueNet' WHEN 3 THEN 'NetIncomeLoss' WHEN 4 THEN 'ProfitLoss'
  WHEN 5 THEN 'Assets' WHEN 6 THEN 'EarningsPerShareBasic' ELSE 'Liabilities' END AS tag, CASE l_partkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'shares' WHEN 2 THEN 'EUR' ELSE 'pure' END AS unit,
  l_orderkey * 1000000 + l_partkey AS idx, floor(l_extendedprice * 10) / 10 AS val, CAST(substr(CAST(l_shipdate AS STRING), 1, 4) AS INT) AS fy, CAST(CAST(l_shipdate AS DATE) AS STRING) AS end,
  CASE WHEN l_linestatus = 'F' THEN '10-K' ELSE '10-Q' END AS form FROM {lineitem}"""
ITEM8 = """SELECT doc_id AS filing_id, CAST(doc_id % 50 AS STRING) AS cik, '8' AS item_number, text || ' ' || CAST(n_chars AS STRING) AS content_text FROM {documents}"""


def _html_parts() -> list[tuple[str, str]]:
    """Per item: (heading markup, chunk expression) of the markup version of the documents."""
    n = len(fixed.ITEMS)
    marks = ["<h2>{}</h2>", "<p><b>{}</b></p>", "<div><span style=\"font-weight: bold\">{}</span></div>", "<p>{}</p>"]
    out = []
    for i, (_, _, title) in enumerate(fixed.ITEMS):
        lo, hi = f"CAST(floor(length(text) * {i} / {n}) AS INT)", f"CAST(floor(length(text) * {i + 1} / {n}) AS INT)"
        out.append((marks[i % 4].format(title.upper() if i % 4 == 3 else title), f"substr(text, {lo} + 1, {hi} - {lo})"))
    return out


_ESC = "replace(replace({}, '&', '&amp;'), '<', '&lt;')"
HTML = ("SELECT doc_id AS filing_id, '<html><head><title>t</title><style>p {{ margin: 0 }}</style></head><body><div style=\"display: none\">hidden</div>' || "
        + " || ".join(f"{A._q(m)} || '<p>' || {_ESC.format(c)} || '</p>'" for m, c in _html_parts()) + " || '</body></html>' AS content FROM {documents}")


def submissions(spark, folder):
    """The index back in its source form: parallel arrays per company, one of them too short."""
    row = F.struct("ord", "form", "filing_date", "accession_number", "primary_document", "description")
    packed = A.bind(spark, folder, INDEX).groupBy("cik").agg(F.sort_array(F.collect_list(row)).alias("r"))
    pick = lambda c: F.transform("r", lambda x: x[c])
    docs = pick("primary_document")
    return packed.select("cik", F.struct(F.struct(
        pick("form").alias("form"), pick("filing_date").alias("filingDate"), pick("accession_number").alias("accessionNumber"),
        F.slice(docs, F.lit(1), F.size(docs) - 1).alias("primaryDocument"), pick("description").alias("primaryDocDescription")).alias("recent")).alias("filings"))


def _metrics(spark, folder, year=None):
    return X.key_metrics(A.bind(spark, folder, FACTS), year)


def refined(spark, folder):
    """Results of a pretended model run: every doubtful boundary moved by ten characters, item 1C found in the
    middle of every gap, item 16 located by the words that open the second half of the text."""
    t = texts(spark, folder)
    bounds = cut_lineage(B.boundaries(t))  # narrow, and used several times
    row = lambda **c: [c.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in (
        ("filing_id", "bigint"), ("kind", "string"), ("gap_id", "string"), ("item_number", "string"), ("found", "boolean"), ("is_item_heading", "boolean"),
        ("offset", "int"), ("start_pos", "int"), ("heading_text", "string"), ("confidence", "double"), ("status", "string"))]
    yes, key = F.lit(True), F.col("filing_id")
    moved = bounds.filter("source is not null and confidence < 0.5").select(*row(
        filing_id=key, kind=F.lit("refine"), item_number=F.col("item_number"), found=yes, is_item_heading=yes, offset=F.lit(210), heading_text=F.col("heading_text"),
        confidence=F.lit(0.9), status=F.lit(""))).dropDuplicates(["filing_id", "item_number"])
    gaps = R.gap_ranges(bounds).groupBy("filing_id").agg(F.min("gap_id").alias("gap_id"))
    placed = R.gap_ranges(bounds).join(gaps, ["filing_id", "gap_id"]).select(*row(
        filing_id=key, kind=F.lit("gap"), gap_id=F.col("gap_id"), item_number=F.lit("1c "), found=yes, offset=F.floor((F.col("gap_end") - F.col("gap_start")) / 2),
        heading_text=F.lit(""), status=F.lit("reserved")))
    named = t.select(*row(filing_id=key, kind=F.lit("full"), item_number=F.lit("16"), found=yes, start_pos=F.lit(5),
                          heading_text=F.substring("text", (F.floor(F.length("text") / 2) + 1).cast("int"), F.lit(40)), confidence=F.lit(0.6), status=F.lit("not_found")))
    results = moved.unionByName(placed).unionByName(named)
    return R.apply_refinements(bounds, results, t).select("filing_id", "item_number", "start_pos", "end_pos", "source", "confidence")


def submission_files(spark, folder):
    """All submissions as files of many documents each, read block by block."""
    at = work_folder(spark, "submissions")
    A.bind(spark, folder, SUBMISSION).select("content").repartition(8).write.text(at)
    return read_submission_blocks(spark, at, "*.txt").select("doc_type", F.md5("body").alias("body_md5"))


QUERIES = {
    "submission_files": submission_files,
    "url_metadata": lambda s, d: S.url_metadata(A.bind(s, d, URLS)).fillna("", ["cik", "accession_number", "primary_document"]).select(
        "page_id", "cik", "accession_number", "primary_document"),
    "submission_blocks": lambda s, d: T.split_submissions(A.bind(s, d, SUBMISSION)).select("filing_id", "pos", "doc_type", F.md5("body").alias("body_md5")),
    "primary_documents": lambda s, d: T.primary_document(A.bind(s, d, SUBMISSION)).select("filing_id", "doc_type", F.md5("content").alias("content_md5")),
    "submission_index": lambda s, d: S.flatten_submissions(submissions(s, d)),
    "fact_rows": lambda s, d: S.flatten_facts(A.bind(s, d, FACT_JSON)),
    "format_census": lambda s, d: T.format_census(A.bind(s, d, CENSUS)),
    "normalized_text": lambda s, d: T.normalize_text(A.bind(s, d, PLAIN)).select("filing_id", F.md5("text").alias("text_md5"), F.length("text").alias("chars")),
    "normalized_html": lambda s, d: T.normalize_html(A.bind(s, d, HTML)).select("filing_id", F.md5("text").alias("text_md5"), F.length("text").alias("chars")),
    "normalized_pages": lambda s, d: T.normalize_html(A.table(s, d, "pages").select(F.col("page_id").alias("filing_id"), F.col("html").alias("content"))).select(
        "filing_id", F.length("text").alias("chars"), F.md5("text").alias("text_md5")),
    "html_anchors": lambda s, d: H.html_anchors(A.bind(s, d, HTML), T.normalize_html(A.bind(s, d, HTML))),
    "filing_lookup": lambda s, d: N.find_filings(A.bind(s, d, LOOKUPS), A.bind(s, d, INDEX)),
    "filing_listing": lambda s, d: N.list_filings(A.bind(s, d, INDEX), "10-K", 3).select("cik", "ord", "form", "filing_date", "accession_number"),
    "primary_choice": lambda s, d: N.choose_primary(A.bind(s, d, LISTING)),
    "proxy_references": lambda s, d: N.resolve_proxy(A.bind(s, d, BY_REFERENCE), A.bind(s, d, INDEX)).fillna("", ["reference_document", "reference_url"]).select(
        "filing_id", "item_number", "reference_document", "reference_url"),
    "key_metrics": lambda s, d: _metrics(s, d).select("cik", "metric", "value", "unit", "period_end", "form"),
    "key_metrics_by_year": lambda s, d: _metrics(s, d, 1998).select("cik", "metric", "value", "unit", "period_end", "form"),
    "fact_check": lambda s, d: X.cross_check(A.bind(s, d, ITEM8), _metrics(s, d)).select("filing_id", "metric", "found_in_text"),
    "fact_found_rates": lambda s, d: X.found_rates(X.cross_check(A.bind(s, d, ITEM8), _metrics(s, d))),
    "refine_queue": lambda s, d: R.refine_queue(B.boundaries(texts(s, d)), texts(s, d)).select(
        "filing_id", "item_number", "start_pos", "source", "ctx_start", F.md5("context").alias("context_md5"), "est_tokens"),
    "forced_queue": lambda s, d: R.refine_queue(B.boundaries(texts(s, d)), texts(s, d), forced=3).select("filing_id", "item_number", "start_pos"),
    "missing_item_gaps": lambda s, d: R.missing_item_gaps(cut_lineage(B.boundaries(texts(s, d))), texts(s, d)).select(
        "filing_id", "prev_item", "next_item", "start_pos", "next_pos", F.md5("sample").alias("sample_md5"), "est_tokens"),
    "gap_excerpts": lambda s, d: R.gap_excerpts(cut_lineage(B.boundaries(texts(s, d))), texts(s, d)).select(
        "filing_id", "gap_id", "prev_item", "next_item", "gap_start", "gap_end", F.md5("excerpt").alias("excerpt_md5"), "full_doc_mode"),
    "applied_refinements": refined,
}

_IDX = f"WITH idx AS ({A.duck(INDEX)}) "
_URL = "'https://www.sec.gov/Archives/edgar/data/' || regexp_replace({c}.cik, '^0+(.)', '\\1') || '/' || replace({a}, '-', '') || '/' || "
_FORMS = ", ".join(q(f) for f in fixed.ANNUAL_FORMS)
_METRIC_DIM = ", ".join(f"({q(m)}, {q(t)}, {i})" for m, tags in fixed.FACT_METRICS for i, t in enumerate(tags))


def _metrics_sql(where: str) -> str:
    return f"""facts AS ({A.duck(FACTS)}), dim(metric, tag, tr) AS (VALUES {_METRIC_DIM}), units(unit, ur) AS (VALUES ('USD', 0), ('USD/shares', 1), ('shares', 2), ('pure', 3)),
      metrics AS (SELECT cik, metric, val AS value, f.unit, f."end" AS period_end, form FROM facts f JOIN dim d ON d.tag = f.tag JOIN units u ON u.unit = f.unit WHERE {where}
        QUALIFY row_number() OVER (PARTITION BY cik, metric ORDER BY tr, ur, idx DESC) = 1)"""


_CHECKED = f"""WITH {_metrics_sql("form = '10-K'")}, checked AS (
      SELECT filing_id, metric, contains(content_text, trunc(value)::BIGINT::VARCHAR) OR contains(content_text, format('{{:,}}', round_even(value, 0)::BIGINT))
        OR contains(content_text, format('{{:,}}', round_even(value / 1000000, 0)::BIGINT)) OR contains(content_text, format('{{:,}}', round_even(value / 1000, 0)::BIGINT)) AS found_in_text
      FROM ({A.duck(ITEM8)}) i JOIN metrics m ON m.cik = i.cik) """


def _clean(x: str) -> str:
    steps = [("\\n{4,}", "chr(10) || chr(10) || chr(10)"), ("[ \\t]{2,}", "' '"), (" +\\n", "chr(10)"), ("\\n +", "chr(10)")]
    for p, r in steps:
        x = f"regexp_replace({x}, '{p}', {r}, 'g')"
    return strip(x)


_HTML_LINES = ", ".join(
    f"['', {O.q(m.split('>')[1 + (1 if '<b>' in m or '<span' in m else 0)].split('<')[0])}, '']"
    f", CASE WHEN {strip(c)} = '' THEN ['', ''] ELSE ['', {strip(c)}, ''] END" for m, c in _html_parts())

_ANCHORS = f"""a AS (SELECT *, row_number() OVER w AS n, lead(item_number) OVER w AS next_item, lead(start_pos) OVER w AS next_pos FROM ended
   WINDOW w AS (PARTITION BY filing_id ORDER BY start_pos, doc_order))"""

_GAPS = """g AS (
      SELECT filing_id, 'gap_0' AS gap_id, 'START' AS prev_item, item_number AS next_item, floor(total_chars * 0.05::DOUBLE)::INT AS gap_start, start_pos AS gap_end FROM a
        WHERE n = 1 AND start_pos > 200 AND start_pos > floor(total_chars * 0.05::DOUBLE)::INT
      UNION ALL SELECT filing_id, 'gap_' || n, item_number, next_item, start_pos + 100, next_pos FROM a WHERE next_pos IS NOT NULL AND next_pos - start_pos - 100 >= 500
      UNION ALL SELECT filing_id, 'gap_' || n, item_number, 'END', start_pos + 100, floor(total_chars * 0.92::DOUBLE)::INT FROM a WHERE next_pos IS NULL AND floor(total_chars * 0.92::DOUBLE)::INT - start_pos - 100 > 500
      UNION ALL SELECT filing_id, 'gap_0', 'START', 'END', floor(total_chars * 0.05::DOUBLE)::INT, floor(total_chars * 0.95::DOUBLE)::INT FROM f WHERE NOT EXISTS (SELECT 1 FROM ended e WHERE e.filing_id = f.filing_id))"""

ORACLE = {
    "url_metadata": f"""SELECT page_id, CASE WHEN c = '' THEN '' ELSE lpad(c, greatest(10, length(c))::INT, '0') END AS cik, CASE WHEN c = '' THEN '' WHEN regexp_extract(f, '(\\d{{10}}-\\d{{2}}-\\d{{6}})', 1) <> '' THEN regexp_extract(f, '(\\d{{10}}-\\d{{2}}-\\d{{6}})', 1)
        WHEN length(a) = 18 THEN substr(a, 1, 10) || '-' || substr(a, 11, 2) || '-' || substr(a, 13, 6) ELSE '' END AS accession_number, f AS primary_document
      FROM (SELECT page_id, regexp_extract(url, p, 1) AS c, regexp_extract(url, p, 2) AS a, regexp_extract(url, p, 3) AS f
            FROM (SELECT *, '(?i)/Archives/edgar/data/(\\d+)/(\\d+)/([^/?#]+)' AS p FROM ({A.duck(URLS)}) u) v) w""".replace("url, p,", "url, '(?i)/Archives/edgar/data/(\\d+)/(\\d+)/([^/?#]+)',"),
    "submission_blocks": f"""SELECT filing_id, i - 1 AS pos, upper({strip("regexp_extract(b, '(?i)<TYPE>\\s*([^\\n\\r<]+)', 1)")}) AS doc_type,
        md5({strip("CASE WHEN regexp_matches(b, '(?is)<TEXT>.*?</TEXT>') THEN regexp_extract(b, '(?is)<TEXT>(.*?)</TEXT>', 1) ELSE b END")}) AS body_md5
      FROM (SELECT filing_id, unnest(bs) AS b, generate_subscripts(bs, 1) AS i FROM (SELECT filing_id, regexp_extract_all(content, '(?is)<DOCUMENT>(.*?)</DOCUMENT>', 1) AS bs
            FROM ({A.duck(SUBMISSION)}) s WHERE contains(upper(content), '<DOCUMENT>')) x) y""",
    # The files' names and the places in them are Spark's; types and bodies are those of the submissions.
    "submission_files": f"""SELECT upper({strip("regexp_extract(b, '(?i)<TYPE>\\s*([^\\n\\r<]+)', 1)")}) AS doc_type,
        md5({strip("CASE WHEN regexp_matches(b, '(?is)<TEXT>.*?</TEXT>') THEN regexp_extract(b, '(?is)<TEXT>(.*?)</TEXT>', 1) ELSE b END")}) AS body_md5
      FROM (SELECT unnest(regexp_extract_all(content, '(?is)<DOCUMENT>(.*?)</DOCUMENT>', 1)) AS b FROM ({A.duck(SUBMISSION)}) s) x""",
    "primary_documents": f"""WITH s AS ({A.duck(SUBMISSION)}), b AS (SELECT filing_id, unnest(bs) AS b, generate_subscripts(bs, 1) AS i FROM (
        SELECT filing_id, regexp_extract_all(content, '(?is)<DOCUMENT>(.*?)</DOCUMENT>', 1) AS bs FROM s WHERE contains(upper(content), '<DOCUMENT>')) x),
      t AS (SELECT filing_id, i, upper({strip("regexp_extract(b, '(?i)<TYPE>\\s*([^\\n\\r<]+)', 1)")}) AS doc_type,
        {strip("CASE WHEN regexp_matches(b, '(?is)<TEXT>.*?</TEXT>') THEN regexp_extract(b, '(?is)<TEXT>(.*?)</TEXT>', 1) ELSE b END")} AS body FROM b),
      p AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY filing_id ORDER BY CASE WHEN doc_type IN ('10-K', '10-K/A') THEN 0 ELSE 1 END, i) = 1)
      SELECT s.filing_id, coalesce(doc_type, '') AS doc_type, md5(CASE WHEN coalesce(body, '') <> '' THEN body ELSE content END) AS content_md5 FROM s LEFT JOIN p ON p.filing_id = s.filing_id""",
    "submission_index": _IDX + """SELECT cik, n - 1 AS ord, form, filing_date, accession_number, CASE WHEN n = c THEN '' ELSE primary_document END AS primary_document, description
      FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY ord) AS n, count(*) OVER (PARTITION BY cik) AS c FROM idx) x""",
    "fact_rows": """SELECT l_orderkey * 100 + l_linenumber || '-' || l_partkey AS cik, CASE l_linenumber % 3 WHEN 0 THEN 'Revenues' WHEN 1 THEN 'Assets' ELSE 'Liabilities' END AS tag, 'USD' AS unit, i AS idx,
        CASE i WHEN 0 THEN floor(l_extendedprice) ELSE l_linenumber END::DOUBLE AS val, 2001 + i AS fy, CASE i WHEN 0 THEN l_shipdate::DATE::VARCHAR ELSE '' END AS "end", CASE i WHEN 0 THEN '10-K' ELSE '8-K' END AS form
      FROM lineitem, (VALUES (0), (1)) v(i)""",
    "format_census": f"""SELECT CASE WHEN contains(h, 'ix:nonnumeric') OR contains(h, 'ix:nonfraction') THEN 'xbrl_html' WHEN contains(h, '<html') OR contains(h, '<body') THEN 'html' ELSE 'text' END AS format,
        count(*) AS filings, sum(length(content))::BIGINT AS chars FROM (SELECT content, lower(content) AS h FROM ({A.duck(CENSUS)}) c) x GROUP BY 1""",
    "normalized_text": f"""SELECT filing_id, md5(t) AS text_md5, length(t) AS chars FROM (SELECT filing_id, {strip("regexp_replace(regexp_replace(regexp_replace(replace(content, chr(12), chr(10) || chr(10)), '(?m)^-{20,}$', chr(10), 'g'), '[ \\t]{3,}', '  ', 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g')")} AS t
      FROM ({A.duck(PLAIN)}) p) x""",
    "normalized_html": f"""SELECT filing_id, md5(t) AS text_md5, length(t) AS chars FROM (SELECT doc_id AS filing_id, {_clean("array_to_string(flatten([" + _HTML_LINES + "]), chr(10))")} AS t FROM documents) x""",
    "filing_lookup": _IDX + f""", req AS ({A.duck(LOOKUPS)}), ann AS (SELECT * FROM idx WHERE form IN ({_FORMS})),
      hits AS (SELECT r.request_id, r.cik, a.form, a.filing_date, a.accession_number, a.primary_document,
          row_number() OVER (PARTITION BY r.request_id ORDER BY CASE WHEN r.year IS NOT NULL AND substr(a.filing_date, 1, 4) <> r.year::VARCHAR THEN 1 ELSE 0 END, a.ord) AS rn
        FROM req r LEFT JOIN ann a ON a.cik = r.cik AND (r.accession_number IS NULL OR replace(a.accession_number, '-', '') = r.accession_number))
      SELECT request_id, cik, accession_number, filing_date, form AS form_type, CASE WHEN primary_document <> '' THEN primary_document ELSE accession_number || '.txt' END AS primary_document,
        {_URL.format(c='hits', a='accession_number')} CASE WHEN primary_document <> '' THEN primary_document ELSE accession_number || '.txt' END AS filing_url FROM hits WHERE rn = 1""",
    "filing_listing": _IDX + "SELECT cik, ord, form, filing_date, accession_number FROM idx WHERE form IN ('10-K', '10-K/A') QUALIFY row_number() OVER (PARTITION BY cik ORDER BY ord) <= 3",
    "primary_choice": f"""WITH l AS (SELECT *, lower(name) AS low FROM ({A.duck(LISTING)}) x),
      g AS (SELECT *, regexp_matches(low, '\\.html?$') AND NOT contains(low, 'index') AND NOT (starts_with(low, 'ex') OR contains(low, 'exhibit') OR regexp_matches(low, 'd\\d+dex') OR regexp_matches(low, '\\.(xml|xsd|jpg|jpeg|gif|png)$')) AS page FROM l)
      SELECT accession_number, coalesce(arg_min(name, ord) FILTER (WHERE page), max(name) FILTER (WHERE name = accession_number || '.txt'), '') AS primary_document FROM g GROUP BY accession_number""",
    "proxy_references": _IDX + f""", it AS (SELECT *, CASE WHEN substr(filing_date, 6, 2)::INT <= 3 THEN substr(filing_date, 1, 4)::INT - 1 ELSE substr(filing_date, 1, 4)::INT END AS fy FROM ({A.duck(BY_REFERENCE)}) b),
      j AS (SELECT it.filing_id, it.item_number, it.cik, p.accession_number, p.primary_document, row_number() OVER (PARTITION BY it.filing_id ORDER BY p.ord) AS rn FROM it
        LEFT JOIN idx p ON p.cik = it.cik AND p.form IN ('DEF 14A', 'DEFA14A') AND it.status = 'incorporated_by_reference' AND (starts_with(p.filing_date, it.fy::VARCHAR) OR starts_with(p.filing_date, (it.fy + 1)::VARCHAR)))
      SELECT filing_id, item_number, CASE WHEN accession_number IS NULL THEN '' ELSE 'DEF 14A' END AS reference_document, coalesce({_URL.format(c='j', a='accession_number')} primary_document, '') AS reference_url FROM j WHERE rn = 1""",
    "key_metrics": "WITH " + _metrics_sql("form = '10-K'") + " SELECT * FROM metrics",
    "key_metrics_by_year": "WITH " + _metrics_sql("fy = 1998 OR contains(f.\"end\", '1998')") + " SELECT * FROM metrics",
    "fact_check": _CHECKED + "SELECT * FROM checked",
    "fact_found_rates": _CHECKED + "SELECT filing_id, count(*) AS metrics, count(*) FILTER (WHERE found_in_text) AS found, count(*) FILTER (WHERE found_in_text) / count(*) AS found_rate FROM checked GROUP BY filing_id",
    "refine_queue": O.chain(*O.DETECT) + """SELECT filing_id, item_number, start_pos, source, cs AS ctx_start, md5(c) AS context_md5, length(c) // 4 AS est_tokens FROM (
      SELECT e.*, greatest(start_pos - 200, 0) AS cs, substr(f.text, greatest(start_pos - 200, 0) + 1, start_pos + 800 - greatest(start_pos - 200, 0)) AS c
      FROM ended e JOIN f ON f.filing_id = e.filing_id WHERE confidence < 0.5) x""",
    "forced_queue": O.chain(*O.DETECT) + "SELECT filing_id, item_number, start_pos FROM ended QUALIFY row_number() OVER (PARTITION BY filing_id ORDER BY confidence, start_pos, item_number) <= 3",
    "missing_item_gaps": O.chain(*O.DETECT, _ANCHORS) + """SELECT filing_id, prev_item, next_item, start_pos, next_pos, md5(s) AS sample_md5, length(s) // 4 AS est_tokens FROM (
      SELECT a.filing_id, a.item_number AS prev_item, next_item, start_pos, next_pos, substr(f.text, start_pos + 1, next_pos - start_pos) AS s
      FROM a JOIN f ON f.filing_id = a.filing_id WHERE next_pos - start_pos > 2000 AND (SELECT count(DISTINCT item_number) FROM ended e WHERE e.filing_id = a.filing_id) < 23) x""",
    "gap_excerpts": O.chain(*O.DETECT, _ANCHORS, _GAPS,
        """cut AS (SELECT g.*, substr(f.text, gap_start + 1, gap_end - gap_start) AS t, f.total_chars FROM g JOIN f ON f.filing_id = g.filing_id)""") + """SELECT filing_id, gap_id, prev_item, next_item, gap_start, gap_end,
      md5(t) AS excerpt_md5,
      total_chars <= 1400000 AS full_doc_mode FROM cut""",
    "applied_refinements": O.chain(*O.DETECT, _ANCHORS, _GAPS, """mv AS (
        SELECT e.filing_id, e.item_number, e.total_chars, CASE WHEN d THEN greatest(start_pos - 200, 0) + 210 ELSE start_pos END AS start_pos, CASE WHEN d THEN 'llm_refined' ELSE source END AS source, CASE WHEN d THEN 0.9::DOUBLE ELSE confidence END AS confidence
        FROM (SELECT *, min(confidence) OVER (PARTITION BY filing_id, item_number) < 0.5 AS d FROM ended) e)""",
        """gp AS (SELECT g.filing_id, '1C' AS item_number, f.total_chars, (gap_start + (gap_end - gap_start) // 2)::INT AS start_pos, 'llm_anchor_gap_fill' AS source, 0.7::DOUBLE AS confidence
        FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY filing_id ORDER BY gap_id) = 1) g JOIN f ON f.filing_id = g.filing_id WHERE gap_end > gap_start
          AND NOT EXISTS (SELECT 1 FROM ended e WHERE e.filing_id = g.filing_id AND e.item_number = '1C'))""",
        """hd AS (SELECT filing_id, total_chars, text, trim(substr(text, (length(text) // 2 + 1)::INT, 40), ' ') AS h FROM f),
        fu AS (SELECT filing_id, '16' AS item_number, total_chars, CASE WHEN length(h) >= 4 THEN instr(text, h) - 1 ELSE 5 END AS start_pos, 'llm_full_doc_extract' AS source, 0.6::DOUBLE AS confidence FROM hd
          WHERE NOT EXISTS (SELECT 1 FROM ended e WHERE e.filing_id = hd.filing_id AND e.item_number = '16'))""") + """SELECT filing_id, item_number, start_pos::INT AS start_pos,
        coalesce(lead(start_pos) OVER (PARTITION BY filing_id ORDER BY start_pos, item_number), total_chars)::INT AS end_pos, source, confidence
      FROM (SELECT * FROM mv UNION ALL SELECT * FROM gp UNION ALL SELECT * FROM fu) x""",
    "html_anchors": f"""WITH n AS (SELECT filing_id, lower(t) AS t, length(t) AS total_chars FROM (SELECT doc_id AS filing_id, {_clean("array_to_string(flatten([" + _HTML_LINES + "]), chr(10))")} AS t FROM documents) x),
      {O.DIM}, c AS (SELECT filing_id, total_chars, item_number, ord, CASE WHEN ord % 4 = 3 THEN upper(item_title) ELSE item_title END AS heading_text, t, floor(total_chars * 0.05::DOUBLE)::INT AS lo, floor(total_chars * 0.95::DOUBLE)::INT AS hi,
        greatest(floor(total_chars * 0.05::DOUBLE), floor(total_chars * 0.12::DOUBLE))::INT AS fr FROM n, dim),
      l AS (SELECT *, instr(substr(t, fr + 1), lower(heading_text)) AS a, instr(substr(t, lo + 1), lower(heading_text)) AS b FROM c)
      SELECT filing_id, total_chars, item_number, CASE WHEN a > 0 AND fr + a - 1 < hi THEN fr + a - 1 ELSE lo + b - 1 END AS start_pos, heading_text FROM l WHERE (a > 0 AND fr + a - 1 < hi) OR (b > 0 AND lo + b - 1 < hi)""",
}
