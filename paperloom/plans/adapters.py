"""Bindings of the driver tables to operator inputs.

The tables hold no filings, ledgers or repositories, so each input is a deterministic projection of
whole tables, written in SQL that both Spark and DuckDB run as is. Table names are bare; on Spark
they are registered as temporary views by `bind`.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from paperloom.functions import fixed
from paperloom.session import text_partitions

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
    if name in TEXT_KEYS:
        # Text work is CPU bound, and a file may have few row groups. Dealt by the key, rows that belong together are in
        # one task for whatever follows per key.
        df = df.repartition(text_partitions(spark, df.inputFiles()), TEXT_KEYS[name])
    return df


def bind(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Run an adapter on Spark over the named tables."""
    frames = {t: table(spark, folder, t) for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **frames)


def duck(sql: str) -> str:
    """The same adapter for DuckDB: bare table names."""
    for t in TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    return sql.replace("{{", "{").replace("}}", "}")


def literal_braces(sql: str) -> str:
    """Keep braces of JSON texts apart from the braces of table names."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in TABLES:
        sql = sql.replace(f"{{{{{t}}}}}", f"{{{t}}}")
    return sql


def _q(s: str) -> str:
    # chr(39) rather than a doubled quote: the two engines escape quotes differently.
    return "'" + s.replace("'", "' || chr(39) || '") + "'"


NL = "chr(10)"


def _filings_sql() -> str:
    """Documents dressed as annual reports.

    style = doc_id % 6: 0 mixed-case headings after a contents list, 1 upper-case headings, 2 number
    and title on separate lines, 3 titles alone (no numbers), 4 cover table and declaration, 5 titles
    alone plus an index at the end. The whole text is split over the 23 items, so all of it is used:
    where an item's own wording must stay short, its part of the text stands before its heading and so
    belongs to the item before it. An item's wording is chosen by (doc_id + 3 * ordinal) % 9.
    """
    style, pick = "(doc_id % 6)", "((doc_id + 3 * {i}) % 9)"
    n = len(fixed.ITEMS)
    cover = []
    contents = []
    for i, (_, num, title) in enumerate(fixed.ITEMS):
        contents.append(f"'Item {num}. ' || {_q(title[:40])} || ' ..... {i * 3 + 2}' || {NL}")
        cover.append(
            f"'{num}.' || {NL} || {_q(title)} || {NL} || CASE {pick.format(i=i)} WHEN 2 THEN 'Not Applicable' "
            f"WHEN 1 THEN 'Reserved' WHEN 4 THEN '*' ELSE '{i + 4}-{i + 9}' END || {NL}")
    body = []
    for i, (_, num, title) in enumerate(fixed.ITEMS):
        p = pick.format(i=i)
        chunk = f"substr(t, CAST(floor(n * {i} / {n}) AS INT) + 1, CAST(floor(n * {i + 1} / {n}) AS INT) - CAST(floor(n * {i} / {n}) AS INT))"
        head = (f"CASE {style} WHEN 0 THEN 'Item {num}. ' || {_q(title)} WHEN 1 THEN upper('Item {num}. ' || {_q(title)}) "
                f"WHEN 2 THEN 'Item {num}.' || {NL} || {_q(title)} WHEN 4 THEN 'Item {num} ' || {_q(title)} "
                f"ELSE {'upper(' + _q(title) + ')' if i % 2 else _q(title)} END")
        body.append(
            f"CASE WHEN {p} IN (1, 2, 5) THEN {chunk} || {NL} ELSE '' END"
            f" || CASE WHEN {p} = 0 THEN '' ELSE {head} || {NL} END"
            f" || CASE {p} WHEN 1 THEN '[Reserved]' WHEN 2 THEN 'None.' WHEN 5 THEN 'Not applicable.' WHEN 4 THEN "
            f"'The information required by this item is incorporated herein by reference to the Proxy Statement.' ELSE '' END"
            f" || {NL} || CASE WHEN {p} IN (1, 2, 5) THEN '' ELSE {chunk} || {NL} END")
    index = []
    for i, (_, num, title) in enumerate(fixed.ITEMS):
        index.append(f"'Item {num}.' || {NL} || {_q(title)} || {NL} || CASE {pick.format(i=i)} WHEN 2 THEN 'None' "
                     f"WHEN 1 THEN '[Reserved]' ELSE 'Pages {i + 2}-{i + 5}' END || {NL} || {NL}")
    parts = " || ".join
    declaration = ("'Portions of the definitive proxy statement are incorporated by reference into this report in "
                   "response to Items 10, 11, 12, 13 and 14 of Part III.' || " + NL + " || " + NL)
    return f"""
SELECT filing_id, text FROM (
  SELECT doc_id AS filing_id,
    'ANNUAL REPORT' || {NL} || 'PART I' || {NL}
    || CASE WHEN {style} = 0 THEN 'Table of Contents' || {NL} || {parts(contents)} ELSE '' END
    || CASE WHEN {style} = 4 THEN {parts(cover)} || {declaration} ELSE '' END
    || {parts(body[:7])} || 'PART II' || {NL} || {parts(body[7:16])} || 'PART III.' || {NL}
    || {parts(body[16:21])} || 'PART IV' || {NL} || {parts(body[21:])}
    || CASE WHEN {style} = 5 THEN {parts(index)} ELSE '' END
    || 'SIGNATURES' AS text
  FROM (SELECT doc_id, trim(text) AS t, length(trim(text)) AS n FROM {{documents}}) src
) built
"""


FILINGS = _filings_sql()
