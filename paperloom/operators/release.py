"""Commits since the last tag, version step, changelog; repository keys and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions.ordered import running_sums
from paperloom.functions.text import extract, left, let, rlike, strip


def latest_tags(tags: DataFrame) -> DataFrame:
    """The first tag, in list order, that looks like a version."""
    return tags.filter(rlike(F.col("name"), fixed.SEMVER_TAG)).groupBy("repo").agg(
        F.min_by(F.struct("name", "sha"), "ord").alias("t")).select("repo", F.col("t.name").alias("tag"), F.col("t.sha").alias("tag_sha"))


def commits_since_tag(commits: DataFrame, tags: DataFrame, max_commits: int | None = None) -> DataFrame:
    """Commits newer than the tagged one (all, if it is not among them), newest first.

    `max_commits` limits the notes to the newest commits; None, the default, takes them all. The
    cut is an aggregate joined back, not a window over a repository's whole history.
    """
    latest = latest_tags(tags)
    rows = commits.withColumn("message", F.substring_index("message", "\n", 1))
    if max_commits is not None:
        order = Window.partitionBy("repo").orderBy("ord")
        rows = rows.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= max_commits).drop("_k")
    same = F.startswith("sha", left("tag_sha", 12)) | F.startswith("tag_sha", left("sha", 12))
    cut = rows.join(latest, "repo").filter((F.col("tag_sha") != "") & same).groupBy("repo").agg(F.min("ord").alias("_cut"))
    return rows.join(cut, "repo", "left").filter(F.col("_cut").isNull() | (F.col("ord") < F.col("_cut"))).drop("_cut")


def next_version(tag: Column, bump: Column) -> Column:
    part = lambda i: extract(tag, r"^v*(\d+)\.(\d+)\.(\d+)", i)
    v = lambda *parts: F.concat(F.lit("v"), F.concat_ws(".", *parts))
    text = lambda n: n.cast("bigint").cast("string")
    fresh = F.when(bump == "major", "v1.0.0").when(bump == "minor", "v0.1.0").otherwise("v0.0.1")
    plus = lambda i: (part(i).cast("bigint") + 1).cast("string")
    stepped = F.when(bump == "major", v(plus(1), F.lit("0"), F.lit("0"))) \
        .when(bump == "minor", v(text(part(1)), plus(2), F.lit("0"))).otherwise(v(text(part(1)), text(part(2)), plus(3)))
    return F.when(F.coalesce(tag, F.lit("")) == "", fresh).when(part(1) == "", "v0.1.0").otherwise(stepped)


def changelog_lines(commits: DataFrame) -> DataFrame:
    """One line per commit with its section (1 features, 2 fixes, 3 other), in commit order."""
    msg = strip("message")
    section = F.when(rlike(msg, "(?i)" + fixed.FEATURE_COMMIT), 1).when(rlike(msg, "(?i)" + fixed.FIX_COMMIT), 2).otherwise(3)
    line = F.concat(F.lit("- "), msg, F.lit(" ("), left("sha", 7), F.lit(") @"), F.coalesce("author", F.lit("")))
    return commits.select("repo", "ord", section.alias("section"), line.alias("line"))


def changelog_parts(commits: DataFrame, tags: DataFrame, part_chars: int = fixed.CHANGELOG_PART_CHARS, max_commits: int | None = None) -> DataFrame:
    """The changelog's sections as ordered parts of about `part_chars` characters: repo, section, part, text, for histories
    that no single row should hold. The text of a section is its parts in order, one per line.

    Lines are numbered by their running length, chunk by chunk of commits, and joined within their part, so neither
    a repository nor a section is one task or one row.
    """
    lines = changelog_lines(commits_since_tag(commits, tags, max_commits)).withColumn("_size", F.length("line") + 1)
    chunk = F.floor(F.col("ord") / 1000)
    placed = running_sums(lines, ["repo", "section"], ["ord"], chunk, {"_upto": F.col("_size")})
    part = F.floor((F.col("_upto") - F.col("_size")) / part_chars).cast("long")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
    return placed.groupBy("repo", "section", part.alias("part")).agg(joined.alias("text"))


def release_notes(commits: DataFrame, tags: DataFrame, max_commits: int | None = None) -> DataFrame:
    """Per repository: current tag, version step, next version, changelog text of all commits since the
    tag (at most `max_commits`, if given). `changelog_parts` gives the same lines in parts of bounded size.
    """
    since = commits_since_tag(commits, tags, max_commits)
    msg = F.col("message")
    facts = since.groupBy("repo").agg(
        F.count(F.lit(1)).alias("commits_since_tag"), F.bool_or(rlike(msg, "(?i)" + fixed.BREAKING_COMMIT)).alias("breaking"),
        F.bool_or(rlike(msg, "(?i)" + fixed.FEATURE_COMMIT)).alias("feature"))
    entries = changelog_lines(since).groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("section", "ord", "line"))).alias("lines"))
    repos = commits.select("repo").unionByName(tags.select("repo")).distinct()
    rows = repos.join(latest_tags(tags), "repo", "left").join(facts, "repo", "left").join(entries, "repo", "left") \
        .fillna(0, ["commits_since_tag"])
    bump = F.when(F.col("breaking"), "major").when(F.col("feature"), "minor").otherwise("patch")
    skipped = (F.col("commits_since_tag") == 0) & F.col("tag").isNotNull()
    titles = ["### ✨ Features", "### 🐛 Bug Fixes", "### 🔧 Other Changes"]

    def section(i: int) -> Column:
        mine = F.transform(F.filter("lines", lambda x: x["section"] == i + 1), lambda x: x["line"])
        return F.when(F.size(mine) > 0, F.concat(F.lit(titles[i] + "\n"), F.array_join(mine, "\n"), F.lit("\n")))

    since_label = F.when(F.col("tag").isNotNull(), F.concat(F.lit("since "), F.col("tag"))).otherwise("initial release")
    upcoming = next_version(F.col("tag"), bump)
    head = F.concat(F.lit("## "), upcoming, F.lit(" — What's Changed ("), since_label, F.lit(")\n"))
    none = F.when(F.col("commits_since_tag") == 0, "_No changes detected._")
    notes = F.concat_ws("\n", head, section(0), section(1), section(2), none)
    return rows.select(
        "repo", F.col("tag").alias("current_version"), "commits_since_tag",
        F.when(skipped, "skipped").otherwise("preview").alias("status"),
        F.when(skipped, "none").otherwise(bump).alias("version_bump"),
        F.when(skipped, F.col("tag")).otherwise(upcoming).alias("next_version"),
        F.when(skipped, "No new commits since last release.").otherwise(notes).alias("changelog"))


def repo_key(df: DataFrame, url: str = "repo_url") -> DataFrame:
    """Adds owner and repo_name from https, ssh and bare forms; nulls where the URL is not a repository."""
    pattern = "(?i)" + fixed.REPO_URL
    u = strip(url)
    ok = rlike(u, pattern)
    return df.withColumn("owner", F.when(ok, extract(u, pattern, 1))).withColumn("repo_name", F.when(ok, extract(u, pattern, 2)))


def redact(df: DataFrame, column: str) -> DataFrame:
    """Tokens embedded in clone URLs are masked."""
    return df.withColumn(column, F.regexp_replace(column, r"https://[^@]+@github\.com", "https://***@github.com"))
