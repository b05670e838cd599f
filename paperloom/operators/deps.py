"""Dependencies: merge of manifests, advisories, outdated versions, audit roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.ordered import running_sums
from paperloom.functions.text import extract

_DEP = ["ecosystem", "name", "version"]


def version_key(version: Column) -> Column:
    """A version as numbers that order it (arrays compare part by part).

    All numeric parts count, closing zeros do not (1.0 = 1.0.0). Behind the parts stands what the version
    is: development, alpha, beta, candidate or other pre-release, release, post-release, with its number.
    Parts are shifted by ten, so a further part is above all of these. Build tags after + are left out.
    """
    low = F.regexp_replace(F.lower(version), "^v+", "")
    base = extract(low, r"^(\d+(?:\.\d+)*)", 1)
    parts = F.filter(F.transform(F.split(F.regexp_replace(base, r"(\.0+)+$", ""), r"\."), lambda p: p.try_cast("bigint") + 10), lambda p: p.isNotNull())
    rest = F.substring_index(F.substring(low, F.length(base) + 1, F.length(low)), "+", 1)
    word = extract(rest, r"([a-z]+)", 1)
    kind = F.when(word == "dev", 1).when(word.isin("a", "alpha"), 2).when(word.isin("b", "beta"), 3).when(word.isin("c", "rc", "pre", "preview"), 4) \
        .when(word.isin("post", "rev"), 6).when(F.startswith(rest, F.lit("-")), 1).otherwise(5)
    number = F.coalesce(extract(rest, r"(\d+)\D*$", 1).try_cast("bigint"), F.lit(0))
    return F.concat(parts, F.array(kind.cast("bigint"), F.when(kind == 5, 0).otherwise(number)))


def merge_deps(deps: DataFrame) -> DataFrame:
    """(repo, ecosystem, name, version, source, pos): requirement rows all stay; project-file rows add
    names not present yet, first wins; lock-file packages are appended.

    The names already present are found with one aggregation per (repo, lower name).
    """
    low = F.lower("name")
    project = deps.filter("source = 'pyproject'")
    first = project.groupBy("repo", low.alias("_low")).agg(
        F.min(F.struct("pos", "ecosystem", "name", "version")).alias("d"))
    present = deps.filter("source = 'requirements'").select("repo", low.alias("_low")).distinct()
    added = first.join(present, ["repo", "_low"], "left_anti").select(
        "repo", "d.ecosystem", "d.name", "d.version", F.lit("pyproject").alias("source"), "d.pos")
    cols = ["repo", "ecosystem", "name", "version", "source", "pos"]
    return deps.filter("source <> 'pyproject'").select(*cols).unionByName(added.select(*cols))


def advisory_severity(database_severity: Column, affected: Column) -> Column:
    scores = F.filter(F.transform(F.flatten(F.transform(affected, lambda a: F.coalesce(a["scores"], F.array().cast("array<string>")))),
                                  lambda s: s.try_cast("double")), lambda d: d.isNotNull())
    top = F.get(scores, F.lit(0))
    by_score = F.when(top >= 9.0, "critical").when(top >= 7.0, "high").when(top >= 4.0, "medium").when(top.isNotNull(), "low")
    return F.coalesce(F.when(F.coalesce(database_severity, F.lit("")) != "", F.lower(database_severity)), by_score, F.lit("unknown"))


_PACKAGE = ["ecosystem", "name"]


#: A block of version numbers is 2^BLOCK_LEVEL of them at most, so no key has more versions to pair with ranges.
BLOCK_LEVEL = 8


def _blocks(first: Column, end: Column) -> Column:
    """The numbers [first, end) as blocks (level, block) of 2^level numbers: two per level at most, and of the largest as many
    as it takes."""
    block = lambda level, at: F.struct(F.lit(level).alias("level"), at.alias("block"))
    at = lambda level: (F.shiftright(first.cast("bigint") + ((1 << level) - 1), level), F.shiftright(end.cast("bigint"), level))
    small = []
    for level in range(BLOCK_LEVEL):
        lo, hi = at(level)
        small += [F.when((lo < hi) & (lo % 2 == 1), block(level, lo)), F.when((lo < hi) & (hi % 2 == 1), block(level, hi - 1))]
    lo, hi = at(BLOCK_LEVEL)
    large = F.when(lo < hi, F.transform(F.sequence(lo, hi - 1), lambda b: block(BLOCK_LEVEL, b)))
    return F.concat(F.array_compact(F.array(*small)), F.coalesce(large, F.array().cast("array<struct<level:int,block:bigint>>")))


def versions_in_ranges(pairs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ecosystem, name, version) and (ecosystem, name, introduced, fixed, id) -> the versions inside [introduced, fixed)
    with the range's id, each once. No `introduced`: from the first version on; no `fixed`: no end."""
    ends = ranges.select(*_PACKAGE, "id", _lower().alias("_lo"), F.when(F.col("fixed").isNotNull(), version_key(F.col("fixed"))).otherwise(_NO_END()).alias("_hi"))
    return _in_ranges(pairs, ends, ["version"], ["id"]).distinct()


def _lower() -> Column:
    return version_key(F.coalesce("introduced", F.lit("0")))


# The end of a range that has none: no version has an empty key.
_NO_END = lambda: F.array().cast("array<bigint>")


def _in_ranges(versions: DataFrame, ranges: DataFrame, own: list[str], told: list[str]) -> DataFrame:
    """Versions (package, `own` with `version`) and ranges (package, `_lo`, `_hi`, `told`) -> package, `own` and `told` of a version
    and a range that holds it, as often as ranges do.

    A package's versions are numbered in their order, and one sweep over versions and ends of ranges
    turns ranges into ranges of these numbers. A range of numbers is a few blocks of 2^n numbers, a version is
    in one block per n: the two meet by equality, so no version is compared with a range it is not in, and
    a package with most of the rows is many keys. What `own` and `told` hold travels with the version and the blocks, which are
    few beside the pairs: these leave the join as they are and are never shuffled.
    """
    # No key is null. Told so, Spark tests none in the joins, and reads versions and ranges once for all of them.
    sure = lambda c: F.coalesce(c, _NO_END())
    versions = versions.withColumn("_key", sure(version_key(F.col("version"))))
    ranges = ranges.withColumns({c: sure(F.col(c)) for c in ("_lo", "_hi")})
    spans = ranges.select(*_PACKAGE, "_lo", "_hi").distinct()
    # Only packages that both sides know are swept.
    keys = versions.select(*_PACKAGE, "_key").distinct().join(spans.select(*_PACKAGE).distinct(), _PACKAGE, "left_semi")
    cuts = spans.select(*_PACKAGE, F.explode(F.array("_lo", "_hi")).alias("_key")).filter(F.size("_key") > 0).distinct()
    points = keys.withColumn("_own", F.lit(1)).unionByName(cuts.withColumn("_own", F.lit(0)))
    swept = running_sums(points, _PACKAGE, ["_key", "_own"], F.slice("_key", 1, 1), {"_upto": F.col("_own")}, F.slice("_key", 1, 3))
    numbered = swept.filter("_own = 1").select(*_PACKAGE, "_key", (F.col("_upto") - 1).alias("_n"))
    below = swept.filter("_own = 0").select(*_PACKAGE, "_key", F.col("_upto").alias("_below"))
    total = keys.groupBy(*_PACKAGE).agg(F.count(F.lit(1)).alias("_total"))
    spans = spans.join(below.withColumnsRenamed({"_key": "_lo", "_below": "_from"}), [*_PACKAGE, "_lo"]) \
        .join(below.withColumnsRenamed({"_key": "_hi", "_below": "_to"}), [*_PACKAGE, "_hi"], "left").join(total, _PACKAGE) \
        .select(*_PACKAGE, "_lo", "_hi", "_from", F.coalesce("_to", "_total").alias("_to")).filter("_from < _to")
    blocks = ranges.join(spans, [*_PACKAGE, "_lo", "_hi"]).select(*_PACKAGE, *told, F.explode(_blocks(F.col("_from"), F.col("_to"))).alias("b")).select(*_PACKAGE, *told, "b.*")
    placed = versions.join(numbered, [*_PACKAGE, "_key"]).select(*_PACKAGE, *own, "_n", F.explode(F.sequence(F.lit(0), F.lit(BLOCK_LEVEL))).alias("level")) \
        .select(*_PACKAGE, *own, "level", F.expr("shiftright(_n, level)").alias("block"))
    # Dealt to many tasks by number, as the adaptive planner sees the small input and not the pairs. A key has the few versions
    # of a block, and any number of ranges: the right side is the one a join holds.
    spark, at = versions.sparkSession, [*_PACKAGE, "level", "block"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return blocks.repartition(tasks, *at).join(placed.repartition(tasks, *at), at).select(*_PACKAGE, *own, *told)


def _pinned(deps: DataFrame) -> DataFrame:
    return deps.filter(F.coalesce("version", F.lit("")) != "")


def _affected(advisories: DataFrame, *cols: str) -> tuple[DataFrame, DataFrame]:
    """What advisories name, with `cols` of theirs: single versions, and ranges of versions."""
    entries = advisories.select(*cols, F.explode("affected").alias("a")).select(*cols, F.col("a")["ecosystem"].alias("ecosystem"), F.col("a")["name"].alias("name"), "a")
    listed = entries.select(*_PACKAGE, *cols, F.explode(F.col("a")["versions"]).alias("version"))
    ranges = entries.select(*_PACKAGE, *cols, F.explode(F.col("a")["ranges"]).alias("r")).select(*_PACKAGE, *cols, "r.introduced", "r.fixed")
    return listed, ranges


def _pieces(advisories: DataFrame, *cols: str) -> DataFrame:
    """What advisories (`id`, `affected`, `cols`) name, per package and advisory each version once: disjoint ranges (package, `id`,
    `cols`, `_lo`, `_hi`; an empty `_hi` is no end), and the listed versions outside of them (with `version`).

    One window per package and advisory cuts the advisory's ranges into disjoint ones and drops the listed versions inside.
    """
    known = F.col("ecosystem").isNotNull() & F.col("name").isNotNull()
    listed, ranges = _affected(advisories, "id", *cols)
    # The end of a range: whether there is none, else the first version behind it.
    end = F.struct(F.col("fixed").isNull().alias("open"), version_key(F.coalesce("fixed", F.lit("0"))).alias("key"))
    spans = ranges.filter(known).select(*_PACKAGE, "id", *cols, _lower().alias("_lo"), end.alias("_hi"))
    named = listed.filter(known & F.col("version").isNotNull()).withColumn("_lo", version_key(F.col("version")))
    order = Window.partitionBy(*_PACKAGE, "id").orderBy("_lo", F.col("version").isNotNull(), "version")
    placed = spans.unionByName(named, allowMissingColumns=True).select(
        "*", F.max("_hi").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_reach"), F.lag("version").over(order).alias("_last"))
    lo, hi, reach, version = F.col("_lo"), F.col("_hi"), F.col("_reach"), F.col("version")
    start, inside = F.greatest(lo, reach["key"]), F.coalesce(reach["open"], F.lit(False))
    new = F.when(version.isNotNull(), (start == lo) & ~version.eqNullSafe(F.col("_last"))).otherwise(hi["open"] | (start < hi["key"]))
    return placed.filter(~inside & new).select(*_PACKAGE, "id", *cols, "version", start.alias("_lo"), F.when(hi["open"], _NO_END()).otherwise(hi["key"]).alias("_hi"))


_TOLD = ["advisory_id", "cve_id", "severity", "summary", "fixed_version", "reference_url"]


def _used(deps: DataFrame) -> DataFrame:
    """Distinct versioned packages with the number of their rows (`uses`)."""
    named = F.col("ecosystem").isNotNull() & F.col("name").isNotNull() & F.col("version").isNotNull()
    # The test of the count keeps it in every branch that reads this, so Spark counts once for all of them.
    return _pinned(deps).filter(named).groupBy(*_DEP).agg(F.count(F.lit(1)).alias("uses")).filter("uses > 0")


def _findings(used: DataFrame, advisories: DataFrame) -> DataFrame:
    """`package_findings` with `uses`. A version meets each advisory in one place (`_pieces`), so the findings, versions times
    advisories, come out of their join once, with all they tell, and are not gathered again."""
    no_ranges = F.array().cast("array<struct<introduced:string,fixed:string>>")
    told = advisories.select(
        "id", F.get(F.filter("aliases", lambda x: F.startswith(x, F.lit("CVE-"))), F.lit(0)).alias("cve_id"), F.coalesce("summary", F.lit("")).alias("summary"),
        F.get(F.filter("refs", lambda r: r["type"] == "WEB"), F.lit(0))["url"].alias("reference_url"), advisory_severity(F.col("severity"), F.col("affected")).alias("severity"),
        F.transform("affected", lambda x: F.struct(F.lower(x["name"]).alias("name"), F.get(F.filter(F.transform(
            F.coalesce(x["ranges"], no_ranges), lambda r: r["fixed"]), lambda f: f.isNotNull()), F.lit(0)).alias("fixed"))).alias("_fixes")).dropDuplicates(["id"])
    fixed_version = F.get(F.filter("_fixes", lambda x: (x["name"] == F.lower("name")) & x["fixed"].isNotNull()), F.lit(0))["fixed"]
    # What the finding tells goes with the advisory's entry.
    pieces = _pieces(advisories.select("id", "affected").join(told, "id"), *[c for c in told.columns if c != "id"]).select(
        *_DEP, "_lo", "_hi", F.col("id").alias("advisory_id"), F.coalesce("cve_id", F.lit("")).alias("cve_id"), "severity", "summary", fixed_version.alias("fixed_version"),
        F.coalesce("reference_url", F.lit("")).alias("reference_url"))
    listed = used.join(pieces.filter("version is not null").select(*_DEP, *_TOLD), _DEP)
    ranges = pieces.filter("version is null").drop("version")
    ranged = _in_ranges(used, ranges, ["version", "uses"], _TOLD)
    return listed.select(*_DEP, "uses", *_TOLD).unionByName(ranged.select(*_DEP, "uses", *_TOLD))


def package_findings(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Findings per distinct versioned package: listed by an advisory, or inside one of its [introduced, fixed). Listed
    versions meet by equality, ranges as numbered versions (`_in_ranges`)."""
    return _findings(_used(deps), advisories).drop("uses")


def audit_deps(deps: DataFrame, advisories: DataFrame, counted: bool = False) -> DataFrame:
    """Versioned dependencies that an advisory names, with what it tells. Only distinct (package, version) pairs
    meet the advisories, so a package that a third of all repositories use costs one row; the findings
    then join back to the dependency rows. `counted` gives a finding once, with the number of its dependency rows
    (`uses`): they are counted per package before they meet the advisories.
    """
    if counted:
        return _findings(_used(deps), advisories)
    return _pinned(deps).select("repo", *_DEP).join(package_findings(deps, advisories), _DEP)


def _major(version: Column) -> Column:
    return F.regexp_replace(F.substring_index(version, ".", 1), "^v+", "").try_cast("int")


def outdated(deps: DataFrame, latest: DataFrame, first_n: int | None = None) -> DataFrame:
    """Pinned packages whose newest version differs, with a flag for a major step."""
    pinned = deps.filter((F.coalesce("version", F.lit("")) != "") & (F.col("ecosystem") == "PyPI"))
    if first_n is not None:
        pinned = pinned.filter(F.col("pos") < first_n)
    newest = latest.select("ecosystem", "name", F.col("version").alias("latest_version"))
    rows = pinned.join(newest, ["ecosystem", "name"]).filter(
        (F.col("latest_version") != "") & (F.col("latest_version") != F.col("version")))
    return rows.select("repo", F.col("name").alias("package"), F.col("version").alias("current_version"), "latest_version",
                       F.coalesce(_major(F.col("latest_version")) > _major(F.col("version")), F.lit(False)).alias("is_major_bump"))


_SEVERITIES = ("critical", "high", "medium")
_COUNTS = ["vulnerabilities", *[f"{s}_count" for s in _SEVERITIES]]


def package_counts(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """How many `package_findings` a distinct versioned package has, in all and by severity; packages without any are left
    out. The findings, versions times advisories, are counted and never made.

    An advisory names a version once (`_pieces`). A range then adds one where it begins and takes one where it ends, and running
    sums over a package's versions and these places are the counts of its versions; a listed version outside adds to itself alone.
    """
    known = F.col("ecosystem").isNotNull() & F.col("name").isNotNull()
    severity = advisories.select("id", advisory_severity(F.col("severity"), F.col("affected")).alias("_severity")).dropDuplicates(["id"])
    pieces = _pieces(advisories.select("id", "affected").join(severity, "id"), "_severity")
    lo, hi, version = F.col("_lo"), F.col("_hi"), F.col("version")
    step = lambda at, by: F.struct(at.alias("_key"), version.alias("version"), F.lit(by).cast("bigint").alias("_by"))
    steps = F.when(version.isNotNull() | (F.size(hi) == 0), F.array(step(lo, 1))).otherwise(F.array(step(lo, 1), step(hi, -1)))
    told = pieces.select(*_PACKAGE, "_severity", F.explode(steps).alias("s")).select(
        *_PACKAGE, "s._key", "s.version", F.col("s.version").isNotNull().cast("int").alias("_kind"), F.col("s._by").alias("vulnerabilities"),
        *[F.when(F.col("_severity") == s, F.col("s._by")).otherwise(0).alias(f"{s}_count") for s in _SEVERITIES])

    # Kinds: 0 a place where ranges begin or end, 1 a version that is only listed, 2 one that a dependency has.
    own = _pinned(deps).filter(known).select(*_DEP).distinct().select(
        *_PACKAGE, version_key(version).alias("_key"), "version", F.lit(2).alias("_kind"), *[F.lit(0).cast("bigint").alias(c) for c in _COUNTS])
    points = told.unionByName(own).groupBy(*_PACKAGE, "_key", "version").agg(F.max("_kind").alias("_kind"), *[F.sum(c).alias(c) for c in _COUNTS])
    # No key is null. Told so, Spark tests none in the joins of the running sums, and makes the points once for all of them.
    points = points.withColumn("_key", F.coalesce("_key", F.array().cast("array<bigint>")))
    # A place stands before the versions of its key, as it has none.
    swept = running_sums(points, _PACKAGE, ["_key", "version"], F.slice("_key", 1, 1), {f"_in_{c}": F.when(F.col("_kind") == 0, F.col(c)).otherwise(0) for c in _COUNTS}, F.slice("_key", 1, 3))
    return swept.filter("_kind = 2").select(*_DEP, *[(F.col(c) + F.col(f"_in_{c}")).alias(c) for c in _COUNTS]).filter("vulnerabilities > 0")


def audit(deps: DataFrame, advisories: DataFrame, latest: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """`audit_summary` in one pass over the dependencies: findings and newest versions are facts of a package, so they are
    counted per package (`package_counts`) and joined to the dependencies once, and one roll-up gives all counts. `repos`
    adds repositories without packages."""
    facts = package_counts(deps, advisories)
    newest = latest.filter("version <> ''").groupBy(*_PACKAGE).agg(F.collect_list("version").alias("_newest"))
    rows = deps.select("repo", *_DEP).join(facts, _DEP, "left").join(newest, _PACKAGE, "left")
    old = F.when((F.coalesce("version", F.lit("")) != "") & (F.col("ecosystem") == "PyPI") & F.col("_newest").isNotNull(), F.size(F.filter("_newest", lambda v: v != F.col("version")))).otherwise(0)
    rows = rows.withColumn("_old", old)
    if repos is not None:
        rows = rows.withColumn("_is", F.lit(1)).unionByName(repos.select("repo").distinct(), allowMissingColumns=True)
    total = F.count("_is") if repos is not None else F.count(F.lit(1))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in [*zip(_COUNTS, _COUNTS), ("_old", "outdated")]]
    return _verdict(rows.groupBy("repo").agg(
        total.alias("total_dependencies"), F.array_join(F.array_sort(F.collect_set("ecosystem")), ",").alias("ecosystems"), *sums))


def audit_summary(deps: DataFrame, findings: DataFrame, old: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Per repository: counts by severity, outdated packages, verdict. `repos` adds those without packages."""
    total = deps.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_dependencies"), F.array_join(F.array_sort(F.collect_set("ecosystem")), ",").alias("ecosystems"))
    if repos is not None:
        total = repos.select("repo").distinct().join(total, "repo", "left")
    bad = findings.groupBy("repo").agg(
        F.count(F.lit(1)).alias("vulnerabilities"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in _SEVERITIES])
    stale = old.groupBy("repo").agg(F.count(F.lit(1)).alias("outdated"))
    return _verdict(total.join(bad, "repo", "left").join(stale, "repo", "left").fillna(0).fillna("", ["ecosystems"]))


def _verdict(counts: DataFrame) -> DataFrame:
    return counts.withColumn("status", F.when(F.col("critical_count") + F.col("high_count") > 0, "vulnerabilities_found")
                          .when((F.col("medium_count") > 0) | (F.col("outdated") > 0), "warnings").otherwise("clean")) \
        .withColumn("note", F.when(F.col("total_dependencies") == 0,
                                   "No lockfiles found (requirements.txt, pyproject.toml, package-lock.json)").otherwise(""))
