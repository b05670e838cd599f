"""Registered queries over evaluation files: scores, cases and reports, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.plans import adapters as A
from paperloom.plans.ledger import SCORES, K
from paperloom.session import work_folder
from paperloom.sources import evals as E

FILES = 16


def _files(rows: DataFrame, value, folder: str) -> str:
    """Rows as JSON files of their own format, one per `part`."""
    rows.groupBy("part").agg(value.alias("value")).write.partitionBy("part").text(folder)
    return folder


def _score_files(spark: SparkSession, folder: str) -> str:
    checks = F.array(F.struct(F.lit("ok").alias("name"), F.col("passed"), F.lit("e").alias("expected"), F.col("model").alias("actual")))
    rows = A.bind(spark, folder, SCORES).select((F.col("case_id") % FILES).alias("part"), F.struct(
        F.concat(F.lit("c"), F.col("case_id").cast("string")).alias("case_id"), "passed", F.lit("done").alias("status"), (F.col("case_id") % 50 / 2).alias("latency_ms"), "llm_calls",
        (F.col("llm_calls") / 4).alias("avg_confidence"), "failure_type", "cache_hit", checks.alias("checks")).alias("s"))
    return _files(rows, F.to_json(F.struct(F.collect_list("s").alias("scores"))), work_folder(spark, "scores"))


def score_files(spark: SparkSession, folder: str) -> DataFrame:
    found = E.read_scores(spark, _score_files(spark, folder), "suite")
    return found.select("suite", "case_id", "passed", "status", "latency_ms", "llm_calls", F.coalesce("failure_type", F.lit("")).alias("failure_type"), "cache_hit",
                        F.get("checks", F.lit(0))["passed"].alias("check_passed"), F.get("checks", F.lit(0))["actual"].alias("check_actual"))


def report_files(spark: SparkSession, folder: str) -> DataFrame:
    """The report of a suite as its files hold it, next to the summary's row."""
    scores = E.read_scores(spark, _score_files(spark, folder), "suite").withColumn("suite", F.when(F.col("passed"), "good").otherwise("bad"))
    home = work_folder(spark, "report")
    E.write_report(scores.groupBy("suite").agg(F.count(F.lit(1)).alias("cases"), F.sum("llm_calls").alias("calls")), scores, home)
    summary = spark.read.schema("suite string, cases long, calls long").json(home + "/summary")
    return spark.read.text(home + "/report").join(summary, "suite").select("suite", F.col("value").alias("line"), "cases", "calls")


CASES = f"""SELECT event_id AS id, {K} AS k, user_id, event_type FROM {{events}}"""


def case_files(spark: SparkSession, folder: str) -> DataFrame:
    case = F.struct(F.concat(F.lit("k"), F.col("id").cast("string")).alias("case_id"), F.lit("task").alias("task"), F.struct(F.col("k").alias("n"), F.col("event_type").alias("kind")).alias("input_data"),
                    F.when(F.col("k") % 2 == 0, "must hold").alias("expected_behavior"), F.when(F.col("k") % 3 == 0, "hard").alias("difficulty"),
                    F.when(F.col("k") % 5 == 0, F.array(F.lit("a"), F.col("event_type"))).alias("tags"))
    rows = A.bind(spark, folder, CASES).select((F.col("id") % FILES).alias("part"), case.alias("c"))
    cases = E.read_cases(spark, _files(rows, F.to_json(F.collect_list("c")), work_folder(spark, "cases")))
    return E.flatten_cases(cases).select("case_id", "inputs", "outputs.expected_behavior", "outputs.difficulty", F.array_join("outputs.tags", ",").alias("tags"))


QUERIES = {"score_files": score_files, "report_files": report_files, "case_files": case_files}

_SCORED = f"""WITH s AS (SELECT 'c' || case_id AS case_id, passed, case_id % 50 / 2.0::DOUBLE AS latency_ms, llm_calls, llm_calls / 4.0::DOUBLE AS conf, failure_type, cache_hit, model FROM ({A.duck(SCORES)}) x)"""
ORACLE = {
    "score_files": _SCORED + """ SELECT 'suite' AS suite, case_id, passed, 'done' AS status, latency_ms, llm_calls, coalesce(failure_type, '') AS failure_type, cache_hit, passed AS check_passed, model AS check_actual FROM s""",
    "report_files": _SCORED + """, t AS (SELECT passed, count(*) AS cases, sum(llm_calls)::BIGINT AS calls FROM s GROUP BY passed)
      SELECT CASE WHEN s.passed THEN 'good' ELSE 'bad' END AS suite, '- ' || CASE WHEN s.passed THEN 'PASS' ELSE 'FAIL' END || ' `' || case_id || '`: conf=' || conf || ', latency_ms=' || latency_ms ||
        CASE WHEN llm_calls > 0 THEN ', llm_calls=' || llm_calls ELSE '' END || ', failure=' || coalesce(failure_type, 'None') AS line, cases, calls FROM s JOIN t ON t.passed = s.passed""",
    "case_files": f"""SELECT 'k' || id AS case_id, '{{"n":' || k || ',"kind":"' || event_type || '"}}' AS inputs, CASE WHEN k % 2 = 0 THEN 'must hold' ELSE '' END AS expected_behavior,
      CASE WHEN k % 3 = 0 THEN 'hard' ELSE 'normal' END AS difficulty, CASE WHEN k % 5 = 0 THEN 'a,' || event_type ELSE '' END AS tags FROM ({A.duck(CASES)}) x""",
}
