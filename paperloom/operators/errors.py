"""Provider errors and model identifiers: categories, status codes, provider resolution, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions.text import contains_any, extract, left, literal_map, rlike, strip


def category_of(raw: Column) -> Column:
    low = F.lower(raw)
    return F.coalesce(*[F.when(rlike(low, p), F.lit(c)) for c, p in fixed.ERROR_SIGNATURES], F.lit("unknown"))


def http_status_of(raw: Column) -> Column:
    """The first status shape that yields a code from 400 to 599."""
    codes = [extract(raw, p, 1).try_cast("int") for p in fixed.STATUS_SHAPES]
    return F.coalesce(*[F.when(c.between(400, 599), c) for c in codes])


def triage_errors(df: DataFrame, keep: int | None = None) -> DataFrame:
    """(id, stage, provider, model, raw) -> category, retryable flag, status code and label. `keep`: how
    many characters of the error stay (all by default)."""
    raw = F.col("raw")
    label = literal_map(fixed.STATUS_LABELS)[F.col("status_code")]
    return (
        df.withColumn("category", category_of(raw)).withColumn("raw_error", raw if keep is None else left(raw, keep))
        .withColumn("status_code", http_status_of(raw))
        .withColumn("status_label", F.when(F.col("status_code").isNotNull(),
                                           F.concat_ws(" ", F.col("status_code").cast("string"), label)))
        .withColumn("retryable", F.col("category").isin(fixed.RETRYABLE_CATEGORIES)).drop("raw")
    )


def error_rollup(triaged: DataFrame) -> DataFrame:
    """Counts and retryable share by provider, model and category, with sub-totals."""
    return triaged.rollup("provider", "model", "category").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("errors"), F.count_if("retryable").alias("retryable"),
        F.count("status_code").alias("with_status")).withColumn("retryable_share", F.col("retryable") / F.col("errors"))


def error_counts(triaged: DataFrame) -> DataFrame:
    """Errors by stage and status code (0 where the text holds none)."""
    return triaged.groupBy(F.coalesce("stage", F.lit("")).alias("stage"), F.coalesce("status_code", F.lit(0)).alias("status_code")).agg(
        F.count(F.lit(1)).alias("errors"), F.count_if("retryable").alias("retryable"))


def resolve_models(df: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """(id, model_id, provider_hint) -> provider or the reason there is none.

    Hint first, then the registry, then the ordered prefixes.
    """
    mid, hint = strip(F.coalesce("model_id", F.lit(""))), strip(F.lower(F.col("provider_hint")))
    publisher, name = F.substring_index(mid, "/", 1), extract(mid, r"(?s)^[^/]*/(.*)$", 1)
    missing = F.coalesce(F.col("model_id"), F.lit("")) == ""
    misshapen = (mid == "") | ~F.contains(mid, F.lit("/")) | (strip(publisher) == "") | (strip(name) == "") | rlike(mid, r"(?U)\s")
    low = F.lower(mid)
    prefix = F.coalesce(
        *[F.when(F.startswith(low, F.lit(p)), F.lit("nvidia")) for p in fixed.NVIDIA_PREFIXES],
        *[F.when(F.startswith(low, F.lit(p)), F.lit("openrouter")) for p in fixed.OPENROUTER_PREFIXES])
    if registry is None:
        known = literal_map(fixed.MODEL_REGISTRY)[mid]
    else:
        df = df.withColumn("_mid", mid).join(
            registry.select(F.col("model").alias("_mid"), F.col("provider").alias("_known")), "_mid", "left")
        known = F.col("_known")
    hinted = F.coalesce(hint, F.lit("")) != ""
    provider = F.when(hinted, F.when(hint.isin("openrouter", "nvidia"), hint)).otherwise(F.coalesce(known, prefix))
    return df.withColumn("_p", provider).withColumn(
        "error_category", F.when(missing, "missing_model_id").when(misshapen, "bad_model_id_shape")
        .when(hinted & F.col("_p").isNull(), "bad_provider_hint").when(F.col("_p").isNull(), "ambiguous_provider")) \
        .withColumn("provider", F.when(F.col("error_category").isNull(), F.col("_p"))) \
        .select("id", "model_id", "provider_hint", "provider", "error_category")


def trace_summary(steps: DataFrame) -> DataFrame:
    """Per trace: duration, retries, whether a fallback served it, final status."""
    fallback = F.endswith(F.col("step_name"), F.lit("_fallback"))
    return steps.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("steps"), F.sum(F.col("duration_ms").cast("decimal(24,6)")).cast("double").alias("total_duration_ms"),
        F.sum("retry_count").alias("retries"), F.max(fallback).alias("used_fallback"),
        F.max_by("status", "step_no").alias("final_status"))


def step_failure_rates(steps: DataFrame) -> DataFrame:
    return steps.groupBy("step_name").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"),
        (F.count_if(F.col("status") == "failed") / F.count(F.lit(1))).alias("failure_rate"))
