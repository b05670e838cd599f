"""Filing index: lookup, listing, primary document, proxy statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions.text import rlike


def bare(accession: Column) -> Column:
    return F.regexp_replace(accession, "-", "")


def archive_url(cik: Column, accession: Column, document: Column) -> Column:
    short = F.regexp_replace(cik, "^0+(?=.)", "")
    return F.concat(F.lit(fixed.ARCHIVE_URL), short, F.lit("/"), bare(accession), F.lit("/"), document)


def find_filings(requests: DataFrame, index: DataFrame) -> DataFrame:
    """requests(request_id, cik, accession_number?, year?) -> the annual filing each one means.

    By accession (dashes ignored; never falls back to the latest), else first of the year, else the
    most recent. Index rows of a company are pre-aggregated to one row per (cik, year), so the join's
    size follows the requests and no company's history is gathered into one row.
    """
    annual = index.filter(F.col("form").isin(fixed.ANNUAL_FORMS)).select(
        "cik", "ord", "form", "filing_date", "accession_number", "primary_document")
    row = F.struct("form", "filing_date", "accession_number", "primary_document")
    wants = requests.withColumn("_by", F.when(F.coalesce("accession_number", F.lit("")) != "", "accession")
                                .when(F.col("year").isNotNull(), "year").otherwise("latest"))
    # The first index row wins when an accession is listed twice.
    by_acc = annual.groupBy("cik", bare(F.col("accession_number")).alias("_acc")).agg(F.min_by(row, "ord").alias("hit"))
    by_year = annual.groupBy("cik", F.substring("filing_date", 1, 4).alias("_year")).agg(F.min_by(row, "ord").alias("hit"))
    latest = annual.groupBy("cik").agg(F.min_by(row, "ord").alias("last"))
    acc = wants.filter("_by = 'accession'").withColumn("_acc", bare(F.col("accession_number"))).join(by_acc, ["cik", "_acc"], "left")
    rest = wants.filter("_by <> 'accession'").withColumn("_year", F.col("year").cast("string")) \
        .join(by_year, ["cik", "_year"], "left").join(latest, "cik", "left").withColumn("hit", F.coalesce("hit", "last"))
    found = acc.select("request_id", "cik", "hit").unionByName(rest.select("request_id", "cik", "hit"))
    document = F.when(F.col("hit.primary_document") != "", F.col("hit.primary_document")).otherwise(
        F.concat(F.col("hit.accession_number"), F.lit(".txt")))
    return found.select(
        "request_id", "cik", F.col("hit.accession_number").alias("accession_number"), F.col("hit.filing_date").alias("filing_date"),
        F.col("hit.form").alias("form_type"), document.alias("primary_document"),
        archive_url(F.col("cik"), F.col("hit.accession_number"), document).alias("filing_url"))


def list_filings(index: DataFrame, form: str = "10-K", limit: int = 10) -> DataFrame:
    """The first `limit` filings of a form per company, in index order (10-K also takes its amendments)."""
    forms = [form, "10-K/A"] if form == "10-K" else [form]
    order = Window.partitionBy("cik").orderBy("ord")
    return index.filter(F.col("form").isin(forms)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def looks_like_exhibit(name: Column) -> Column:
    low = F.lower(name)
    return (F.startswith(low, F.lit("ex")) | F.contains(low, F.lit("exhibit")) | rlike(low, r"d\d+dex")
            | rlike(low, r"\.(xml|xsd|jpg|jpeg|gif|png)$"))


def choose_primary(listing: DataFrame) -> DataFrame:
    """(accession_number, ord, name) -> the main document of each directory, '' if none."""
    low = F.lower("name")
    page = rlike(low, r"\.html?$") & ~F.contains(low, F.lit("index")) & ~looks_like_exhibit(F.col("name"))
    text = F.col("name") == F.concat("accession_number", F.lit(".txt"))
    return listing.groupBy("accession_number").agg(
        F.coalesce(F.min_by("name", F.when(page, F.col("ord"))), F.max(F.when(text, F.col("name"))), F.lit("")).alias("primary_document"))


def fiscal_year(filing_date: Column) -> Column:
    year, month = F.substring(filing_date, 1, 4).try_cast("int"), F.substring(filing_date, 6, 2).try_cast("int")
    return F.when(F.coalesce(month, F.lit(1)) <= 3, year - 1).otherwise(year)


def resolve_proxy(items: DataFrame, index: DataFrame) -> DataFrame:
    """items(filing_id, item_number, cik, filing_date, status): by-reference items get the company's
    proxy statement of the fiscal year or the next one (first in index order)."""
    row = F.struct("accession_number", "filing_date", "primary_document")
    year = F.substring("filing_date", 1, 4).try_cast("int")
    proxies = index.filter(F.col("form").isin(fixed.PROXY_FORMS)).groupBy("cik", year.alias("_fiscal")).agg(
        F.min(F.struct("ord", row.alias("p"))).alias("first"))
    # A proxy of year y answers fiscal years y and y - 1: a small equi-join instead of a range join.
    answers = proxies.select("cik", F.explode(F.array("_fiscal", F.col("_fiscal") - 1)).alias("_fiscal"), "first") \
        .groupBy("cik", "_fiscal").agg(F.min("first").alias("first"))
    rows = items.withColumn("_fiscal", fiscal_year(F.col("filing_date"))).join(answers, ["cik", "_fiscal"], "left")
    hit = (F.col("status") == "incorporated_by_reference") & F.col("first").isNotNull()
    p = F.col("first.p")
    return rows.withColumn("reference_document", F.when(hit, "DEF 14A")).withColumn(
        "reference_url", F.when(hit, archive_url(F.col("cik"), p["accession_number"], p["primary_document"]))).drop("_fiscal", "first")
