"""Skill requests, plans, run signals, result reuse, language and quality roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions.ordered import previous_rows, running_sums, time_chunk
from paperloom.functions.text import contains_any, let, literal_map, strip, text_array
from paperloom.session import cut_lineage


def repo_language(files: DataFrame) -> DataFrame:
    """Language and marker flags per repository, from the files at its root."""
    has = lambda n: F.coalesce(F.bool_or(F.col("path") == n), F.lit(False))
    flags = files.groupBy("repo").agg(
        has("pyproject.toml").alias("has_pyproject"), has("requirements.txt").alias("has_requirements_txt"), has("setup.py").alias("_setup"),
        has("package.json").alias("has_package_json"), has("package-lock.json").alias("has_package_lock"), has("Makefile").alias("has_makefile"))
    python = F.col("has_pyproject") | F.col("has_requirements_txt") | F.col("_setup")
    return flags.withColumn("language", F.when(python, "python").when(F.col("has_package_json"), "javascript").otherwise("unknown")).drop("_setup")


def quality_summary(languages: DataFrame, findings: DataFrame, tests: DataFrame) -> DataFrame:
    """Lint and test verdict per repository."""
    lint = findings.filter(F.col("tool").isin("ruff", "eslint")).groupBy("repo").agg(
        F.count_if(F.col("tool") == "ruff").alias("ruff_issues"), F.count_if(F.col("tool") == "eslint").alias("eslint_issues"),
        F.count_if((F.col("tool") == "eslint") & (F.col("severity") == "error")).alias("eslint_errors"))
    ran = tests.groupBy("repo").agg(F.sum("failed").alias("test_failed"), F.sum("errors").alias("test_errors"), F.sum("total").alias("test_total"))
    rows = languages.select("repo", "language").join(lint, "repo", "left").join(ran, "repo", "left").fillna(0)
    py, js = F.col("language") == "python", F.col("language") == "javascript"
    lint_ok = F.when(py, F.col("ruff_issues") == 0).when(js, F.col("eslint_errors") == 0).otherwise(True)
    test_ok = F.when(py, (F.col("test_failed") == 0) & (F.col("test_errors") == 0)).when(js, F.col("test_failed") == 0).otherwise(True)
    rows = rows.withColumn("lint_passed", lint_ok).withColumn("test_passed", test_ok)
    both, any_ = F.col("lint_passed") & F.col("test_passed"), F.col("lint_passed") | F.col("test_passed")
    return rows.select(
        "repo", "language", "lint_passed",
        F.when(py, F.col("ruff_issues")).when(js, F.col("eslint_issues")).otherwise(0).alias("lint_issue_count"), "test_passed", "test_total", "test_failed",
        F.when(py, F.when(both, "success").when(any_, "partial").otherwise("failed"))
        .when(js, F.when(both, "success").otherwise("partial")).otherwise("partial").alias("status"))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"[\s\-_]+"), lambda t: t != ""))


def match_requests(df: DataFrame) -> DataFrame:
    """(id, raw) -> skill and confidence: alias, else best token overlap with the trigger phrases."""
    text = strip(F.lower("raw"))

    def score(words: Column, norm: Column, phrases: list[str]) -> Column:
        def one(p: str) -> Column:
            parts = list(dict.fromkeys(x for x in p.replace("-", " ").replace("_", " ").split() if x))
            share = F.size(F.array_intersect(words, text_array(parts))) / F.lit(float(len(parts)))
            return F.when(F.contains(norm, F.lit(p)), F.greatest(share, F.lit(0.8))).otherwise(share)

        return F.array_max(F.array(*[one(p) for p in phrases]))

    def best(norm: Column) -> Column:
        def choose(words: Column) -> Column:
            scored = F.array(*[F.struct(F.lit(s).alias("skill"), score(words, norm, fixed.SKILL_PHRASES[s]).alias("score")) for s in fixed.SKILLS])
            start = F.struct(F.lit("").alias("skill"), F.lit(0.0).alias("score"))
            return F.aggregate(scored, start, lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))

        alias = literal_map(list(fixed.SKILL_ALIASES.items()))[norm]
        return F.when(alias.isNotNull(), F.struct(alias.alias("skill"), F.lit(1.0).alias("score"))).otherwise(
            let(let(_tokens(norm), choose), lambda m: F.when(m["score"] >= 0.35, F.struct(
                m["skill"].alias("skill"), F.least(m["score"], F.lit(0.9)).alias("score")))))

    return df.withColumn("_m", let(text, best)).select("id", "raw", F.col("_m.skill").alias("skill"), F.col("_m.score").alias("confidence"))


def _release_intent(query: Column, include: Column) -> Column:
    return F.array_contains(include, "build-and-release") | contains_any(F.lower(query), fixed.RELEASE_TRIGGERS)


def sanitise_plans(df: DataFrame) -> DataFrame:
    """(id, query, plan, include_hint, exclude_hint, max_skills) -> valid, ordered, gated plan.

    Without a query the include hints are the plan; without hints the default pair is.
    """
    empty = F.array().cast("array<string>")
    clean = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, empty), lambda x: strip(F.lower(x))), lambda x: x.isin(fixed.SKILLS)))
    include, exclude = clean(F.col("include_hint")), clean(F.col("exclude_hint"))
    query = F.coalesce("query", F.lit(""))
    most = F.col("max_skills").cast("int")

    def pick(h: Column) -> Column:
        allowed = _release_intent(query, h["inc"])
        usable = lambda c: F.slice(F.filter(c, lambda s: ~F.array_contains(h["exc"], s) & (allowed | ~s.isin(fixed.WRITE_SKILLS))), 1, F.greatest(most, F.lit(1)))
        default = F.slice(F.array_except(text_array(fixed.DEFAULT_PLAN), h["exc"]), 1, F.greatest(F.lit(1), most))
        survivor = F.slice(F.filter(text_array(["lint-and-test", "build-and-release"]),
                                    lambda s: ~F.array_contains(h["exc"], s) & (allowed | ~s.isin(fixed.WRITE_SKILLS))), 1, 1)
        proposed, hinted = usable(h["plan"]), usable(h["inc"])
        with_query = F.when(F.size(proposed) > 0, proposed).otherwise(default)
        without = F.when(F.size(hinted) > 0, hinted).when(F.size(default) > 0, default).otherwise(survivor)
        return F.when(strip(query) == "", without).otherwise(with_query)

    bundle = F.struct(clean(F.col("plan")).alias("plan"), include.alias("inc"), exclude.alias("exc"))
    return df.select("id", let(bundle, pick).alias("plan"))


_RAW = ("lint_issue_count int, lint_issues array<string>, test_failed_count int, vulnerabilities array<string>, outdated array<string>, "
        "findings array<struct<finding_type: string>>, total_dependencies int, critical_count int, high_count int, files_scanned int, "
        "lint_passed boolean, test_passed boolean, test_total int, current_version string, next_version string, version_bump string, "
        "commits_since_tag int, tag_created boolean")


def step_fields(steps: DataFrame) -> DataFrame:
    """(trace_id, iteration, skill, raw_result JSON) -> the few fields of each skill result that matter."""
    rows = steps.withColumn("r", F.from_json("raw_result", _RAW))
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    lint, audit, scan, release = (F.col("skill") == s for s in ("lint-and-test", "dependency-audit", "security-scan", "build-and-release"))
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(F.col(c))).otherwise(0)
    secrets = F.when(F.col("r.findings").isNotNull(), F.size(F.filter("r.findings", lambda f: F.lower(f["finding_type"]) == "secret"))).otherwise(0)
    return rows.select(
        "trace_id", "iteration", "skill",
        F.when(lint, F.when(F.coalesce("r.lint_issue_count", F.lit(0)) != 0, F.col("r.lint_issue_count")).otherwise(n("r.lint_issues"))).otherwise(0).alias("lint_issues"),
        F.when(lint, F.coalesce("r.test_failed_count", F.lit(0))).otherwise(0).alias("test_failures"),
        F.when(audit, n("r.vulnerabilities")).otherwise(0).alias("cves"), F.when(audit, n("r.outdated")).otherwise(0).alias("outdated"),
        F.when(scan, secrets).otherwise(0).alias("secrets"), F.when(scan, n("r.findings") - secrets).otherwise(0).alias("sast"),
        F.when(release, F.col("r.next_version")).alias("next_version"))


def run_signals(steps: DataFrame) -> DataFrame:
    """Headline numbers per run, over all its skill results."""
    return step_fields(steps).groupBy("trace_id").agg(*[
        F.sum(c).alias(f"total_{c}") for c in ("lint_issues", "test_failures", "cves", "outdated", "secrets", "sast")])


def reuse_key(df: DataFrame) -> DataFrame:
    return df.withColumn("cache_key", F.concat_ws(
        ":", F.lit("cicd:v1"), "repo", "branch", "skill", F.substring("sha", 1, 12), F.col("dry_run").cast("string")))


def reuse_results(requests: DataFrame, ttl_seconds: int = fixed.REUSE_TTL_SECONDS) -> DataFrame:
    """Flag the requests served from a kept result: the key's last *executed* request is less than the
    TTL before. Hits do not refresh the clock.

    A request at least one TTL after its predecessor always executes, so a key's history is cut there
    and the stretches are independent. Within a stretch an execution leads to the next one, the first
    time at least one TTL later; so every time has one successor, at most one execution falls in a
    slot of one TTL, and what executes is what the stretch's first time leads to. The successors are found
    by running counts, then composed with themselves until none is left: after n rounds a step
    spans 2^n executions. No key, and no stretch, is worked on in one task.
    """
    rows = reuse_key(requests).withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    ttl = ttl_seconds * 1_000_000
    slot, fine = F.floor(F.col("_at") / ttl), F.floor(F.col("_at") * 64 / ttl)
    # Requests at the very same time: the first in id order executes, the rest are served.
    times = rows.groupBy("cache_key", "_us").agg(F.min("id").alias("_first"))
    # Numbers of the times, and how many times lie less than one TTL after each, in one running count.
    marks = times.select("cache_key", "_us", F.explode(F.array(
        F.struct(F.col("_us").alias("_at"), F.lit(1).alias("_own")), F.struct((F.col("_us") + ttl).alias("_at"), F.lit(0).alias("_own")))).alias("m")).select("cache_key", "_us", "m.*")
    counted = running_sums(marks, ["cache_key"], ["_at", "_own"], slot, {"_n": F.col("_own")}, fine)
    placed = cut_lineage(counted.groupBy("cache_key", "_us").agg(
        F.max(F.when(F.col("_own") == 1, F.col("_n"))).alias("_n"), (F.max(F.when(F.col("_own") == 0, F.col("_n"))) + 1).alias("_next")))
    # A time starts a stretch where the one before it leads straight to it, or nothing is before it.
    before = placed.select("cache_key", (F.col("_n") + 1).alias("_n"), (F.col("_next") == F.col("_n") + 1).alias("_gap"))
    nodes = placed.join(before, ["cache_key", "_n"], "left").withColumn("_new", F.coalesce("_gap", F.lit(True))).drop("_gap")
    ran = nodes.filter("_new").select("cache_key", "_n")
    inside = nodes.filter("NOT _new").select("cache_key", F.col("_n").alias("_next"))
    step = cut_lineage(nodes.select("cache_key", "_n", "_next").join(inside, ["cache_key", "_next"]))
    while not step.isEmpty():
        reached = step.join(ran, ["cache_key", "_n"]).select("cache_key", F.col("_next").alias("_n"))
        ran = cut_lineage(ran.union(reached).distinct())
        further = step.select("cache_key", F.col("_n").alias("_next"), F.col("_next").alias("_far"))
        step = cut_lineage(step.join(further, ["cache_key", "_next"]).select("cache_key", "_n", F.col("_far").alias("_next")))
    executed = placed.join(ran, ["cache_key", "_n"]).select("cache_key", "_us", F.lit(True).alias("_ran"))
    decided = times.join(executed, ["cache_key", "_us"], "left")
    out = rows.join(decided, ["cache_key", "_us"])
    return out.withColumn("cache_hit", ~(F.col("_ran").isNotNull() & (F.col("id") == F.col("_first")))).drop("_us", "_ran", "_first")


def breaker_timeline(events: DataFrame, threshold: int = fixed.BREAKER_FAILURES, cooldown: float = fixed.BREAKER_COOLDOWN_SECONDS,
                     chunk_seconds: int = 3600) -> DataFrame:
    """(service, ts, event_id, ok) -> breaker state before and after every call.

    Open from the n-th failure in a row; half open once the cooldown since the last failure is over; a
    success closes it. The state depends only on the failures since the last success and on the
    previous call, so no sequential pass is needed.
    """
    order = ["ts", "event_id"]
    rows = running_sums(events, ["service"], order, time_chunk("ts", chunk_seconds), {"_wins": F.col("ok").cast("int")}, time_chunk("ts", 1))
    rows = running_sums(rows, ["service", "_wins"], order, time_chunk("ts", chunk_seconds), {"failures": (~F.col("ok")).cast("int")}, time_chunk("ts", 1))
    rows = rows.withColumn("state_after", F.when(F.col("failures") >= threshold, "open").otherwise("closed"))
    rows = previous_rows(rows, ["service"], order, time_chunk("ts", chunk_seconds), ["ts", "state_after"], 1, time_chunk("ts", 1))
    before = F.get("previous", F.lit(0))
    waited = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before["ts"].cast("timestamp"))) / 1e6
    return rows.withColumn("state_before", F.when(before.isNull() | (before["state_after"] == "closed"), "closed")
                           .when(waited > cooldown, "half_open").otherwise("open")).drop("previous", "_wins")
