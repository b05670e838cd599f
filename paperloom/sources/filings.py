"""Readers for filing corpora: raw files, URL metadata, submission indexes, company facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import extract, rlike

_ARCHIVE = r"(?i)/Archives/edgar/data/(\d+)/(\d+)/([^/?#]+)"


def pad_cik(cik: Column) -> Column:
    digits = F.regexp_replace(cik, r"\D", "")
    return F.when(F.length(digits) < 10, F.lpad(digits, 10, "0")).otherwise(digits)


def dashed_accession(acc: Column) -> Column:
    """18 digits become 10-2-6; any other shape stays as it is."""
    s = F.trim(acc)
    return F.when(rlike(s, r"^\d{18}$"), F.concat_ws("-", F.substring(s, 1, 10), F.substring(s, 11, 2), F.substring(s, 13, 6))).otherwise(s)


def url_metadata(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds cik, accession_number and primary_document from an archive path; nulls where it is none."""
    folder, name = extract(url, _ARCHIVE, 2), extract(url, _ARCHIVE, 3)
    is_archive = rlike(F.col(url), _ARCHIVE)
    in_name = extract(name, r"(\d{10}-\d{2}-\d{6})", 1)
    accession = F.when(in_name != "", in_name).when(F.length(folder) == 18, dashed_accession(folder)).otherwise("")
    return (
        df.withColumn("cik", F.when(is_archive, pad_cik(extract(url, _ARCHIVE, 1))))
        .withColumn("accession_number", F.when(is_archive, accession))
        .withColumn("primary_document", F.when(is_archive, name))
    )


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """One row per file below `path`, with the metadata its archive path carries."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("content"))
    return url_metadata(raw).select(F.col("url").alias("filing_id"), "cik", F.col("accession_number").alias("accession"),
                                    "primary_document", "url", "content")


def flatten_submissions(df: DataFrame) -> DataFrame:
    """(cik, filings struct of parallel arrays) -> one row per filing; a short array yields ''."""
    names = ["form", "filingDate", "accessionNumber", "primaryDocument", "primaryDocDescription"]
    out = ["form", "filing_date", "accession_number", "primary_document", "description"]
    zipped = F.arrays_zip(*[F.col(f"filings.recent.{n}").alias(n) for n in names])
    rows = df.select("cik", F.posexplode(zipped).alias("ord", "z"))
    return rows.filter(F.col("z.form").isNotNull()).select(
        "cik", "ord", *[F.coalesce(F.col(f"z.{n}"), F.lit("")).alias(o) for n, o in zip(names, out)])


SUBMISSIONS_JSON = ("cik string, filings struct<recent: struct<form: array<string>, filingDate: array<string>, "
                    "accessionNumber: array<string>, primaryDocument: array<string>, primaryDocDescription: array<string>>>")


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    return flatten_submissions(spark.read.schema(SUBMISSIONS_JSON).option("multiLine", "true").json(path))


FACTS_TYPE = ("struct<facts: struct<`us-gaap`: map<string, struct<units: map<string, array<struct<"
              "val: double, fy: int, end: string, form: string>>>>>>>")


def flatten_facts(df: DataFrame) -> DataFrame:
    """(cik, payload JSON) -> long fact table, one row per tag, unit and entry."""
    facts = df.select("cik", F.from_json("payload", FACTS_TYPE).alias("p"))
    tags = facts.select("cik", F.explode(F.col("p.facts").getField("us-gaap")).alias("tag", "t"))
    units = tags.select("cik", "tag", F.explode("t.units").alias("unit", "entries"))
    return units.select("cik", "tag", "unit", F.posexplode("entries").alias("idx", "e")).select(
        "cik", "tag", "unit", "idx", "e.val", "e.fy", F.col("e.end").alias("end"), "e.form")
