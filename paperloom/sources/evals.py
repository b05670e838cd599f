"""Evaluation files: case sets and scores in, summaries and report lines out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORE = ("case_id string, passed boolean, status string, latency_ms double, cost_usd double, llm_calls int, avg_confidence double, "
         "failure_type string, cache_hit boolean, checks array<struct<name:string,passed:boolean,expected:string,actual:string>>")


def read_scores(spark: SparkSession, path: str, suite: str) -> DataFrame:
    """Score rows of one suite's result files (`{"scores": [...]}`)."""
    raw = spark.read.schema(f"scores array<struct<{SCORE.replace(' string', ':string').replace(' boolean', ':boolean').replace(' double', ':double').replace(' int', ':int').replace(' array', ':array')}>>") \
        .option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return raw.select(F.explode("scores").alias("s")).select(F.lit(suite).alias("suite"), "s.*")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Case files: an array of cases, `input_data` kept as JSON text."""
    raw = spark.read.option("multiLine", "true").text(path, wholetext=True)
    cases = F.from_json("value", "array<struct<case_id:string,task:string,input_data:string,expected_behavior:string,difficulty:string,tags:array<string>>>")
    return raw.select(F.explode(cases).alias("c")).select("c.*")


def flatten_cases(df: DataFrame) -> DataFrame:
    """case -> inputs and outputs, with the defaults of a plain case."""
    return df.select(
        "case_id", F.col("input_data").alias("inputs"),
        F.struct(F.coalesce("expected_behavior", F.lit("")).alias("expected_behavior"), F.coalesce("difficulty", F.lit("normal")).alias("difficulty"),
                 F.coalesce("tags", F.array().cast("array<string>")).alias("tags")).alias("outputs"))


def report_lines(scores: DataFrame) -> DataFrame:
    """One Markdown line per case."""
    line = F.concat(F.lit("- "), F.when(F.col("passed"), "PASS").otherwise("FAIL"), F.lit(" `"), F.col("case_id").cast("string"), F.lit("`: conf="),
                    F.col("avg_confidence").cast("string"), F.lit(", latency_ms="), F.col("latency_ms").cast("string"),
                    F.when(F.col("llm_calls") > 0, F.concat(F.lit(", llm_calls="), F.col("llm_calls").cast("string"))).otherwise(""),
                    F.lit(", failure="), F.coalesce("failure_type", F.lit("None")))
    return scores.select("suite", "case_id", line.alias("line"))


def write_report(summary: DataFrame, scores: DataFrame, folder: str) -> None:
    """Summary as JSON, report lines as text, below `folder`; both written by the executors."""
    summary.write.mode("overwrite").json(folder.rstrip("/") + "/summary")
    report_lines(scores).select("suite", "line").write.mode("overwrite").partitionBy("suite").text(folder.rstrip("/") + "/report")
