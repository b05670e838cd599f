"""Resolve not-modified revisits to the full response they stand for.

A revisit (record type `revisit`, a 304 exchange) of a URL is joined as of its time to the latest strictly
earlier full response of the same canonical URL (equal times: the greatest record id). The validators
decide: ETags are compared weakly; without an ETag on both sides, Last-Modified must be equal; with
neither on both sides the revisit stays unresolved. Headers of a 304 update those of the stored response,
except for the ones that describe the stored body or a single connection.

No task owns a URL: records are range-partitioned by (URL, time), each partition is searched alone, and
one carried response per (partition, URL) crosses partitions.

Records with a null URL or time are unresolved (`no_url`, `no_time`); null headers count as none. Header
names are compared in lower case; of repeated names the last one counts. Other record types are passed
over. Repeated rows are resolved alike, empty tables give empty results. Columns beyond the named ones are
ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import lower_ascii, shuffle_partitions
from paperloom.session import cut_lineage

#: Query parameters that do not choose the content.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid")
#: Headers of a 304 that never replace those of the stored response: they belong to the body or the hop.
KEPT_HEADERS = ("content-length", "content-encoding", "content-type", "content-range", "content-md5", "transfer-encoding",
                "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "upgrade")
RECORD = ["record_id", "url", "captured_at", "record_type", "headers"]


def canonical_url(url: Column) -> Column:
    """Scheme and fragment dropped, host in lower case without a default port, tracking parameters
    dropped and the others sorted, one closing slash of the path dropped. Null without `://`."""
    whole = F.regexp_replace(url, "#[\\s\\S]*$", "")
    scheme = lower_ascii(F.regexp_extract(whole, "^([^:/?#]*)://", 1))
    rest = F.regexp_extract(whole, "^[^:/?#]*://([\\s\\S]*)$", 1)
    host = lower_ascii(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/$", "")
    query = F.regexp_extract(rest, "^[^?]*[?]([\\s\\S]*)$", 1)
    held = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    query = F.array_join(F.sort_array(held), "&")
    return F.when(url.rlike("^[^:/?#]*://"), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def _plain_headers(headers: Column) -> Column:
    """Names in lower case; the last of equal names."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(
        F.map_filter(m, lambda k, _: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])))


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored response's headers after the 304: permitted names of the update replace, all others stay."""
    allowed = F.map_filter(update, lambda k, _: ~k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(allowed, k)), allowed)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: `record_id`, `canonical_url`, `outcome` (resolved, mismatch, no_validator,
    no_response, no_url, no_time), `response_id` of the response found, merged `headers` where resolved."""
    spark = records.sparkSession
    rows = records.filter(F.col("record_type").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("url"), F.col("captured_at").alias("at"),
        (F.col("record_type") == "response").cast("int").alias("full"), _plain_headers(F.col("headers")).alias("headers"))
    dated = cut_lineage(rows.filter("url is not null and at is not null")
                        .repartitionByRange(shuffle_partitions(spark), "url", "at", "full", "record_id")
                        .withColumn("part", F.spark_partition_id()))
    response = F.struct("at", "record_id", "headers")
    # Revisits sort before responses of the same time, so only strictly earlier responses precede them.
    here = Window.partitionBy("part", "url").orderBy("at", "full", F.col("record_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    near = dated.withColumn("found", F.last(F.when(F.col("full") == 1, response), ignorenulls=True).over(here)).filter("full = 0")
    order = Window.partitionBy("part", "url").orderBy(F.col("at").desc(), F.col("record_id").desc_nulls_last())
    tails = dated.filter("full = 1").withColumn("n", F.row_number().over(order)).filter("n = 1").select("url", "part", response.alias("tail"))
    reached = dated.select("url", "part").distinct().join(tails, ["url", "part"], "left")
    before = Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = reached.select("url", "part", F.last("tail", ignorenulls=True).over(before).alias("carried")).filter("carried is not null")
    joined = near.join(carried, ["url", "part"], "left").select("record_id", "url", "headers", F.coalesce("found", "carried").alias("r"))
    tag, old = F.col("headers")["etag"], F.col("r.headers")["etag"]
    date, old_date = F.col("headers")["last-modified"], F.col("r.headers")["last-modified"]
    same = F.coalesce(_weak(tag) == _weak(old), date == old_date)
    outcome = F.when(F.col("r").isNull(), "no_response").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("mismatch")
    found = joined.select("record_id", F.col("url").alias("canonical_url"), outcome.alias("outcome"), F.col("r.record_id").alias("response_id"),
                          F.when(same, merged_headers(F.col("r.headers"), F.col("headers"))).alias("headers"))
    lost = rows.filter("full = 0 and (url is null or at is null)").select(
        "record_id", F.col("url").alias("canonical_url"), F.when(F.col("url").isNull(), "no_url").otherwise("no_time").alias("outcome"),
        F.lit(None).cast(rows.schema["record_id"].dataType).alias("response_id"), F.lit(None).cast("map<string,string>").alias("headers"))
    return found.unionByName(lost)


def header_text(headers: Column) -> Column:
    """Sorted `name: value` lines."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")
