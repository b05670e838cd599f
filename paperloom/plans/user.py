"""Registered queries of user functions: checks, a site handler, and the checks as a table function."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators.filing_text import to_lines
from paperloom.operators.user_functions import Checks, Sites, line_function
from paperloom.plans import adapters as A

CHECKS, SITES = Checks(), Sites()


@CHECKS.register("ends_well", "text")
def ends_well(text):
    text = text or ""
    return text.rstrip(" \t\r\n\x0b\x0c")[-1:] in (".", "!", "?"), f"{len(text)} characters"


@CHECKS.register("not_shouting", "text")
def not_shouting(text):
    # Division by zero where a text has no character: the check fails and says so.
    share = sum("A" <= c <= "Z" for c in text or "") / len(text or "")
    return share < 0.05, "few capitals" if share < 0.05 else "many capitals"


@SITES.register("example.org")
def organisations(url, html):
    return url.partition("://")[2].partition("/")[0] + f" has {html.count('<')} marks"


@SITES.register("blog.tionsh.example.net")
def one_blog(url, html):
    return str(html.index("<html>"))


def user_checks(spark, folder):
    return CHECKS.run(A.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"))


def site_answers(spark, folder):
    found = SITES.answers(A.table(spark, folder, "pages").select("page_id", "url", "html"), "url", "html")
    return found.select("page_id", "site", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("error", F.lit("")).alias("error"))


def checked_lines(spark, folder):
    line_function(spark, "checked_lines", CHECKS)
    texts = A.table(spark, folder, "documents").select(F.col("doc_id").alias("filing_id"), F.coalesce("text", F.lit("")).alias("text"))
    to_lines(texts).select("filing_id", "line_no", F.col("line").alias("text")).createOrReplaceTempView("lines_to_check")
    return spark.sql("SELECT filing_id, line_no, ends_well_passed, ends_well_message FROM checked_lines(TABLE(lines_to_check), 'ends_well')")


QUERIES = {"user_checks": user_checks, "site_answers": site_answers, "checked_lines": checked_lines}

_BLANKS = "' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11)"
_CAPITALS = "length(regexp_replace(text, '[^A-Z]', '', 'g')) / length(text)"
ORACLE = {
    "user_checks": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
      SELECT doc_id AS id, 'ends_well' AS name, right(rtrim(text, {_BLANKS}), 1) IN ('.', '!', '?') AS passed, length(text) || ' characters' AS message FROM d
      UNION ALL SELECT doc_id, 'not_shouting', CASE WHEN text = '' THEN false ELSE {_CAPITALS} < 0.05 END, CASE WHEN text = '' THEN 'ZeroDivisionError: division by zero' WHEN {_CAPITALS} < 0.05 THEN 'few capitals' ELSE 'many capitals' END FROM d""",
    "site_answers": r"""WITH p AS (SELECT *, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '://([^/]*)', 1) AS shown FROM pages)
      SELECT page_id, CASE WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 'example.org' ELSE 'blog.tionsh.example.net' END AS site,
        CASE WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN shown || ' has ' || (length(html) - length(replace(html, '<', ''))) || ' marks' WHEN contains(html, '<html>') THEN CAST(strpos(html, '<html>') - 1 AS VARCHAR) ELSE '' END AS answer,
        CASE WHEN host = 'example.org' OR ends_with(host, '.example.org') OR contains(html, '<html>') THEN '' ELSE 'ValueError: substring not found' END AS error
      FROM p WHERE host = 'example.org' OR ends_with(host, '.example.org') OR host = 'blog.tionsh.example.net' OR ends_with(host, '.blog.tionsh.example.net')""",
    "checked_lines": f"""SELECT doc_id AS filing_id, i - 1 AS line_no, right(rtrim(line, {_BLANKS}), 1) IN ('.', '!', '?') AS ends_well_passed, length(line) || ' characters' AS ends_well_message
      FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) x""",
}
