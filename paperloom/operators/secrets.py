"""Secret scan over files or documents, and its roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions.text import contains_any, extract, left, rlike

_LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


#: What a text must hold, in small letters, for a rule to match at all: one of these.
_NEEDED = {
    "AWS Access Key ID": ["akia"], "AWS Secret Access Key": ["aws"], "GitHub Personal Access Token (classic)": ["ghp_"], "GitHub Fine-Grained PAT": ["github_pat_"],
    "OpenAI API Key": ["sk-"], "Slack API Token": ["xox"], "Private Key": ["-----begin "], "Generic API Key / Token": ["api", "access"],
    "Hardcoded Password": ["password"], "Database Password": ["db_pass", "database_password"], "Hex Token": ["token"],
}


def _matches(text: Column, low: Column, rule: tuple[str, str, str, str]) -> Column:
    """Whether a rule matches; its pattern runs only where a literal of it occurs."""
    pattern, _, kind, _ = rule
    found = rlike(text, pattern)
    if kind not in _NEEDED:
        return found
    return F.when(contains_any(low, _NEEDED[kind]), found).otherwise(False)


def _rules(extra: bool) -> list[tuple[str, str, str, str]]:
    return fixed.SECRET_RULES + ([fixed.EXTRA_SECRET_RULE] if extra else [])


def scan_secrets(files: DataFrame, extra: bool = False) -> DataFrame:
    """(repo, path, content) -> one finding per line: the first rule that matches, never the secret.

    Whole files are tested first, so only files with a hit are split into lines. Both times plain searches for the
    rules' literals decide which patterns run.
    """
    rules = _rules(extra)
    files = files.withColumn("_low", F.lower("content"))
    suspicious = F.lit(False)
    for one in rules:
        suspicious = suspicious | _matches(F.col("content"), F.col("_low"), one)
    lines = files.filter(suspicious).select(
        "repo", "path", F.posexplode(F.split("content", _LINE_END, -1)).alias("_n", "_line")).withColumn("_low", F.lower("_line"))
    rule = F.coalesce(*[F.when(_matches(F.col("_line"), F.col("_low"), one), F.lit(i)) for i, one in enumerate(rules)])
    hits = lines.withColumn("rule", rule).filter(F.col("rule").isNotNull())

    def by_rule(values: list[Column]) -> Column:
        return F.coalesce(*[F.when(F.col("rule") == i, v) for i, v in enumerate(values)])

    found = by_rule([extract("_line", p, 0) for p, *_ in rules])
    return hits.select(
        "repo", "path", (F.col("_n") + 1).alias("line"), F.lit("secret").alias("finding_type"),
        by_rule([F.lit(s) for _, s, _, _ in rules]).alias("severity"), by_rule([F.lit(k) for _, _, k, _ in rules]).alias("description"),
        by_rule([F.lit(r) for *_, r in rules]).alias("recommendation"),
        F.when(F.length(found) > 4, F.concat(left(found, 4), F.lit("***"))).otherwise("***").alias("match_preview"),
        F.lit("regex").alias("tool"))


def scan_summary(findings: DataFrame, files: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """Per repository: findings by severity, files scanned, status, scan types (repos without findings too)."""
    counts = findings.groupBy("repo").agg(*[
        F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("critical", "high", "medium", "low")],
        F.count(F.lit(1)).alias("findings"))
    out = files.groupBy("repo").agg(F.count(F.lit(1)).alias("files_scanned")).join(counts, "repo", "left").fillna(0)
    out = out.withColumn("status", F.when(F.col("findings") > 0, "findings").otherwise("clean"))
    if languages is None:
        return out.withColumn("scan_types", F.lit("secret_detection"))
    return out.join(languages.select("repo", "language"), "repo", "left").withColumn(
        "scan_types", F.when(F.col("language") == "python", "secret_detection,sast_bandit").otherwise("secret_detection")).drop("language")
