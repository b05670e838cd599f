"""The queries of the operators, over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import collocations, langid, lm_scoring, mixing, nbsvm, packing, resampling, rules, search, secret_layers, simhash, url_filters, warc
from paperloom.llm.common import read, remainder
from paperloom.session import cut_lineage

HOST_RULES = [url_filters.host_rule("net/", "block"), url_filters.host_rule("example.net/en/", "allow"),
              url_filters.host_rule("example.com/de/", "block"), url_filters.host_rule("org/fr/", "allow")]


def lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    good = read(spark, folder, "labels").filter("quality = 1").select("doc_id")
    found = lm_scoring.score(docs, *lm_scoring.fit(docs, good))
    return found.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def whole_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    good = read(spark, folder, "labels").filter("quality = 1").select("doc_id")
    found = lm_scoring.score_whole(read(spark, folder, "documents"), good)
    return found.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def searches(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return search.search(docs, docs.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"))


def languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    held_out = remainder(F.col("doc_id"), 3) == 1
    learned = langid.prototypes(docs.filter(~held_out))
    return langid.identify(docs, learned).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def quality_model(docs: DataFrame, labels: DataFrame):
    """Learned from every labelled row outside the held-out fold."""
    return nbsvm.train(docs, labels.filter(remainder(F.col("doc_id"), 5) != 0))


def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = nbsvm.scored(docs, quality_model(docs, read(spark, folder, "labels")))
    return found.select("row.doc_id", (remainder(F.col("row.doc_id"), 5) == 0).alias("held_out"), "score",
                        (F.col("score") >= nbsvm.THRESHOLD).cast("int").alias("predicted"))


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    # The measures are narrow; written once, they serve the pattern counts and the verdicts.
    docs = read(spark, folder, "documents").select("doc_id", "text")
    table = cut_lineage(rules.measured(docs).withColumn("row", F.struct("row.doc_id")))
    return rules.judge(docs, table=table).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.round("posterior", 6).alias("posterior"), "kept")


def url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages").select("page_id", "url")
    return url_filters.judge(pages, [*HOST_RULES, *url_filters.DEFAULT_PATTERNS]).select("page_id", "host", "path", "rule", "verdict")


CAPTURES = """
SELECT 3 * page_id AS record_id, url, page_id * 60 AS captured_at, 'response' AS record_type,
  {map}(['content-type', 'content-length', 'etag', 'last-modified', 'cache-control'], ['text/html', CAST(length(html) AS {text}), '"' || md5(html) || '"',
    'day ' || CAST(page_id % 28 AS {text}), 'max-age=60']) AS headers FROM {pages}
UNION ALL
SELECT 3 * page_id + 1, replace(url, 'http://', 'https://'), page_id * 60 + 7, 'revisit',
  {map}(['ETag', 'Date', 'Cache-Control', 'Content-Length', 'Connection'], [CASE page_id % 3 WHEN 0 THEN '"' || md5(html) || '"' WHEN 1 THEN 'W/"' || md5(html) || '"'
    ELSE '"' || md5('old' || html) || '"' END, 'day ' || CAST(page_id % 28 AS {text}), 'max-age=' || CAST(page_id % 9 AS {text}), '0', 'close']) FROM {pages}
UNION ALL
SELECT 3 * page_id + 2, url || '#again', page_id * 60 - CASE WHEN page_id % 2 = 0 THEN 3 ELSE -600000 END, 'revisit',
  {map}([CASE WHEN page_id % 5 = 0 THEN 'X-Cache' ELSE 'Last-Modified' END, 'Date'], ['day ' || CAST(page_id % 28 AS {text}), 'later']) FROM {pages}
"""


def revisits(spark: SparkSession, folder: str) -> DataFrame:
    sql = CAPTURES.replace("[", "array(").replace("]", ")").format(map="map_from_arrays", text="STRING", pages="{pages}")
    records = spark.sql(sql, pages=read(spark, folder, "pages"))
    return warc.resolve(records).select("record_id", "canonical_url", "outcome", "response_id", warc.header_text(F.col("headers")).alias("headers"))


def mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("row.doc_id", "size", F.get("source_sizes", F.lit(0)).alias("source_size"), F.get("targets", F.lit(0)).alias("target"), "taken")


def packed_windows(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"))


def collocated_phrases(spark: SparkSession, folder: str) -> DataFrame:
    found = collocations.mine(read(spark, folder, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def resampled(spark: SparkSession, folder: str) -> DataFrame:
    found = resampling.resample(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def layered_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_layers.scan(read(spark, folder, "documents").select("doc_id", "text"))
    shown = secret_layers.base(F.col("found"))
    return found.select("row.doc_id", *[secret_layers.count_of(shown, k).alias(f"n_{k}") for k in secret_layers.KINDS],
                        F.sha2(secret_layers.listed(shown), 256).alias("base_sha256"), secret_layers.listed(F.col("found")).alias("spans"))


QUERIES = {
    "op1_lm_scoring": lm_scores,
    "op1_lm_scoring_whole": whole_lm_scores,
    "op2_simhash_near_duplicates": near_duplicates,
    "op3_exact_search": searches,
    "op4_revisit_resolution": revisits,
    "op5_language_id": languages,
    "op6_quality_classifier": quality_scores,
    "op7_quality_rules": quality_rules,
    "op8_url_filters": url_verdicts,
    "op9_packing": packed_windows,
    "op10_source_mixing": mixed_sources,
    "op11_collocations": collocated_phrases,
    "op12_importance_resampling": resampled,
    "op13_layered_secrets": layered_secrets,
}
