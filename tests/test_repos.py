"""Secrets, manifests, reports, dependencies, releases, skills, reuse and breaker."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.operators import deps as D
from paperloom.operators import release as R
from paperloom.operators import secrets as X
from paperloom.operators import skills as K
from paperloom.sources import filings as SF
from paperloom.sources import repos as S

T0 = dt.datetime(2024, 1, 1)


def test_first_rule_wins_and_nothing_leaks(spark):
    content = "ok\n" + "id AKIA" + "A" * 16 + " password='" + "p" * 9 + "'\r\n" + "ghp_" + "b" * 36 + "\nclean"
    files = spark.createDataFrame([("r", "a.py", content), ("r", "b.py", "fine"), ("q", "c.py", "fine")], "repo string, path string, content string")
    found = X.scan_secrets(files)
    rows = found.orderBy("line").collect()
    assert [(r["line"], r["description"], r["match_preview"]) for r in rows] == [(2, "AWS Access Key ID", "AKIA***"), (3, "GitHub Personal Access Token (classic)", "ghp_***")]
    summary = {r["repo"]: (r["status"], r["n_critical"], r["n_high"], r["files_scanned"]) for r in X.scan_summary(found, files).collect()}
    assert summary == {"r": ("findings", 1, 1, 2), "q": ("clean", 0, 0, 1)}


def test_repo_file_scan(spark, tmp_path):
    root = tmp_path / "clones"
    for path, data in {"one/src/a.py": b"x = 1\n", "one/.git/config": b"secret", "one/img.PNG": b"x", "one/bin.dat": b"a\x00b", "two/bad.txt": b"caf\xe9", "two/build": b"a file named build"}.items():
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)
    got = {(r["repo"], r["path"]): r["content"] for r in S.scan_repo_files(spark, str(root)).collect()}
    assert got == {("one", "src/a.py"): "x = 1\n", ("two", "bad.txt"): "caf�", ("two", "build"): "a file named build"}


def test_manifests(spark):
    rows = [("r", "requirements.txt", "requests==2.28.0\n# c\n-r x\nflask[async]>=2.0,<3  # web\nnumpy\n"),
            ("r", "pyproject.toml", "[project]\ndependencies = ['Flask>=1', 'rich']\n[tool.poetry.dependencies]\npython='^3'\nattrs={version='^23.1'}\n"), ("r", "package-lock.json",
             '{"packages": {"": {"version": "1"}, "node_modules/left": {"version": "1.0.0"}, "node_modules/a/node_modules/b": {"version": "2"}, "node_modules/@s/c": {"version": "3"}}}'), ("s", "pyproject.toml", "not [ toml")]
    deps = S.ingest_manifests(spark.createDataFrame(rows, "repo string, path string, content string"))
    got = {(r["source"], r["name"], r["version"]) for r in deps.collect()}
    assert got == {("requirements", "requests", "2.28.0"), ("requirements", "flask", "2.0"), ("requirements", "numpy", None),
                   ("pyproject", "Flask", "1"), ("pyproject", "rich", None), ("pyproject", "attrs", "23.1"), ("package-lock", "left", "1.0.0")}
    merged = {(r["name"], r["source"]) for r in D.merge_deps(deps).collect()}
    assert ("Flask", "pyproject") not in merged and ("rich", "pyproject") in merged and len(merged) == 6


def test_tool_reports(spark):
    rows = [("r", "ruff", '[{"filename": "a.py", "location": {"row": 3, "column": 1}, "code": "E1", "message": "m", "fix": null}]'), ("r", "ruff", "broken ["), ("r", "ruff", '[{"filename": "x", "code": "E2"}] and a crash'), ("r", "ruff", ""),
            ("r", "pytest", "FAILED tests/t.py::x - AssertionError: boom\n5 passed, 1 failed, 2 skipped in 1s"), ("q", "pytest", "no tests ran in 0.1s"),
            ("r", "bandit", '{"results": [{"issue_severity": "LOW", "issue_confidence": "LOW"}, {"issue_severity": "MEDIUM", "filename": "/c/x.py", "test_id": "B101", "issue_text": "assert"}]}')]
    findings, counts = S.ingest_reports(spark.createDataFrame(rows, "repo string, tool string, payload string"), "/c")
    assert {(r["tool"], r["file"], r["code"], r["severity"]) for r in findings.collect()} == {
        ("ruff", "a.py", "E1", "error"), ("pytest", "tests/t.py", "tests/t.py::x", "failed"), ("bandit", "x.py", "B101", "medium")}
    assert {(r["repo"], r["total"], r["failed"]) for r in counts.collect()} == {("r", 8, 1), ("q", 0, 0)}


def test_project_file_shapes(spark):
    text = """# c
[build-system]
requires = ["a"]
[project]  # main
name = "x"
dependencies = [
  "Flask[async]>=1,<2",  # web ] bracket
  'rich',
  "httpx ~= 1",
]
[project.optional-dependencies]
dev = ["pytest"]
[tool.poetry.dependencies]
python = "^3.11"
"attrs" = { version = "^23.1", extras = ["x"] }
rich = "^9"
local = { path = "../x" }
numpy = '>=1.2'
[tool.poetry.dependencies.pandas]
version = "2.0"
[tool.poetry.group.dev.dependencies]
black = "1"
"""
    files = spark.createDataFrame([("r", text), ("n", None), ("e", ""), ("o", "[project]\ndependencies = ['a', 'b'")], "repo string, content string")
    got = [(r["repo"], r["name"], r["version"], r["pos"]) for r in S.project_deps(files).orderBy("pos").collect()]
    assert got == [("r", "Flask", "1,<2", 0), ("r", "rich", None, 1), ("r", "httpx", None, 2), ("r", "attrs", "23.1", 3), ("r", "local", None, 4), ("r", "numpy", "1.2", 5), ("r", "pandas", "2.0", 6)]


def test_version_order(spark):
    order = ["1.0.dev1", "1.0a1", "1.0.0b2", "1.0rc1", "1.0rc2", "1", "1.0.post1", "1.0.1", "1.2.3.4.5", "1.2.3.4.6", "1.10", "2-beta", "v2.0.0", "10.0"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(order)], "i int, v string").withColumn("k", D.version_key(F.col("v"))).orderBy("k", "i").collect()
    assert [r["v"] for r in rows] == order
    same = spark.createDataFrame([("1.0.0",), ("v1",), ("1.0+build5",)], "v string").select(D.version_key(F.col("v")).alias("k")).distinct().count()
    assert same == 1


def test_version_ranges(spark):
    deps = spark.createDataFrame([("a", "PyPI", "x", v) for v in ("1.9", "1.10", "2.0", "2.1.5")], "repo string, ecosystem string, name string, version string")
    adv = spark.sql("""SELECT 'A' AS id, array('GHSA', 'CVE-1') AS aliases, 's' AS summary, '' AS severity,
      array(named_struct('ecosystem', 'PyPI', 'name', 'x', 'versions', array('2.1.5'), 'ranges', array(named_struct('introduced', '1.10', 'fixed', '2.0')), 'scores', array('CVSS:3', '7.1'))) AS affected,
      array(named_struct('type', 'WEB', 'url', 'u')) AS refs""")
    rows = D.audit_deps(deps, adv).collect()
    assert {r["version"] for r in rows} == {"1.10", "2.1.5"}  # 1.10 is newer than 1.9
    assert {(r["severity"], r["cve_id"], r["fixed_version"], r["reference_url"]) for r in rows} == {("high", "CVE-1", "2.0", "u")}


@pytest.mark.parametrize("messages,tag,want", [
    (["fix: a"], "v1.2.3", ("patch", "v1.2.4")), (["feat(x): a", "fix: b"], "1.2.3", ("minor", "v1.3.0")), (["chore: a", "feat!: b"], "v1.2.3", ("major", "v2.0.0")),
    (["docs: BREAKING CHANGE"], None, ("major", "v1.0.0")), (["feat: a"], None, ("minor", "v0.1.0")), (["x"], None, ("patch", "v0.0.1"))])
def test_version_bump(spark, messages, tag, want):
    commits = spark.createDataFrame([("r", i, f"{i:040d}", m, "me", "") for i, m in enumerate(messages)], "repo string, ord int, sha string, message string, author string, date string")
    tags = spark.createDataFrame([("r", 0, tag, "f" * 40)] if tag else [("r", 0, "nightly", "f" * 40)], "repo string, ord int, name string, sha string")
    r = R.release_notes(commits, tags).first()
    assert (r["version_bump"], r["next_version"]) == want


def test_release_skipped_when_head_is_tagged(spark):
    commits = spark.createDataFrame([("r", 0, "a" * 40, "feat: x", "me", "")], "repo string, ord int, sha string, message string, author string, date string")
    tags = spark.createDataFrame([("r", 0, "v1.0.0", "a" * 40)], "repo string, ord int, name string, sha string")
    r = R.release_notes(commits, tags).first()
    assert (r["status"], r["next_version"], r["commits_since_tag"]) == ("skipped", "v1.0.0", 0)


@pytest.mark.parametrize("raw,skill,conf", [("lint", "lint-and-test", 1.0), (" Security_Scan ", "security-scan", 1.0), ("please ship it", "build-and-release", 0.9),
                                            ("npm audit my app", "dependency-audit", 0.9), ("bake a cake", "build-and-release", None), ("zzz", None, None)])
def test_skill_match(spark, raw, skill, conf):
    r = K.match_requests(spark.createDataFrame([(1, raw)], "id int, raw string")).first()
    if raw == "bake a cake":  # one shared word is below the bar
        assert r["skill"] is None
    else:
        assert (r["skill"], r["confidence"]) == (skill, conf)


@pytest.mark.parametrize("query,plan,inc,exc,most,want", [
    ("check", ["Lint-and-Test ", "build-and-release", "lint-and-test"], [], [], 4, ["lint-and-test"]), ("cut a release", ["build-and-release"], [], [], 4, ["build-and-release"]),
    ("check", ["nope"], [], ["dependency-audit"], 4, ["security-scan"]), ("", [], ["build-and-release", "security-scan"], [], 1, ["build-and-release"]),
    ("", [], [], ["dependency-audit", "security-scan"], 3, ["lint-and-test"])])
def test_plan_sanitiser(spark, query, plan, inc, exc, most, want):
    df = spark.createDataFrame([(1, query, plan, inc, exc, most)], "id int, query string, plan array<string>, include_hint array<string>, exclude_hint array<string>, max_skills int")
    assert K.sanitise_plans(df).first()["plan"] == want


def test_reuse_matches_a_sequential_fold(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.4 else f"r{rng.randrange(4)}", "main", "scan", "s" * 20, False, T0 + dt.timedelta(seconds=rng.randrange(60_000))) for i in range(800)]
    df = spark.createDataFrame(rows, "id int, repo string, branch string, skill string, sha string, dry_run boolean, ts timestamp")
    got = {r["id"]: r["cache_hit"] for r in K.reuse_results(df).collect()}
    last, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[6], r[0])):
        k = r[1]
        want[r[0]] = k in last and (r[6] - last[k]).total_seconds() < 3600
        if not want[r[0]]:
            last[k] = r[6]
    assert got == want


def test_reuse_of_one_busy_key(spark):
    """A key that never pauses for one TTL: one stretch of hundreds of executions, in microseconds, with ties on the border."""
    rng = random.Random(4)
    at, rows = 0, []
    for i in range(3000):
        at += rng.choice([0, 1, 250_000, 999_999, 1_000_000])
        rows.append((i, "hot", "main", "scan", "s", False, T0 + dt.timedelta(microseconds=at)))
    rows += [(3000 + i, f"k{i % 40}", "main", "scan", "s", True, T0 + dt.timedelta(seconds=i % 7)) for i in range(200)] + [(9000, None, "main", "scan", "s", None, None)]
    df = spark.createDataFrame(rows, "id int, repo string, branch string, skill string, sha string, dry_run boolean, ts timestamp")
    got = {r["id"]: r["cache_hit"] for r in K.reuse_results(df, 2).filter("ts IS NOT NULL").collect()}
    last, want = {}, {}
    for r in sorted(rows[:-1], key=lambda r: (r[6], r[0])):
        k = (r[1], r[5])
        want[r[0]] = k in last and r[6] - last[k] < dt.timedelta(seconds=2)
        if not want[r[0]]:
            last[k] = r[6]
    assert got == want and sum(not v for v in want.values()) > 300


def test_reuse_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "r", "main", "scan", "s", False, T0)], "id int, repo string, branch string, skill string, sha string, dry_run boolean, ts timestamp")
    assert not re.search("Python|Pandas|Arrow", K.reuse_results(df)._jdf.queryExecution().executedPlan().toString())


def test_version_intervals_against_every_comparison(spark):
    rng = random.Random(6)
    version = lambda: ".".join(str(rng.randrange(4)) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", "", "rc1", ".post2", "-beta"])
    packages = ["a", "b", "hot", "hot", "hot"]
    pairs = {("PyPI", rng.choice(packages), version()) for _ in range(300)}
    ranges = [("PyPI", rng.choice([*packages, "none"]), rng.choice([None, "0", version()]), rng.choice([None, version(), version()]), f"A{i % 90}") for i in range(120)]
    p = spark.createDataFrame(sorted(pairs), "ecosystem string, name string, version string")
    r = spark.createDataFrame(ranges, "ecosystem string, name string, introduced string, fixed string, id string")
    key = lambda c: D.version_key(F.col(c))
    plain = p.join(r, ["ecosystem", "name"]).withColumn("introduced", F.coalesce("introduced", F.lit("0"))).filter(
        (key("version") >= key("introduced")) & (F.col("fixed").isNull() | (key("version") < key("fixed"))))
    rows = lambda df: sorted(tuple(x) for x in df.select("ecosystem", "name", "version", "id").distinct().collect())
    got = D.versions_in_ranges(p, r)
    want = rows(plain)
    assert sorted(tuple(x) for x in got.select("ecosystem", "name", "version", "id").collect()) == want and len(want) > 500
    assert rows(D.versions_in_ranges(p, r.limit(0))) == [] and rows(D.versions_in_ranges(p.limit(0), r)) == []


def test_versions_of_one_busy_package(spark):
    """10^5 versions and 10^4 narrow ranges of one package: the join sees the hits and the blocks, not all pairs."""
    p = spark.range(100_000).selectExpr("'PyPI' AS ecosystem", "'hot' AS name", "concat(id div 100, '.', id % 100) AS version")
    r = spark.range(10_000).selectExpr("'PyPI' AS ecosystem", "'hot' AS name", "concat(id % 1000, '.', id div 1000) AS introduced", "concat(id % 1000, '.', id div 1000 + 5) AS fixed", "CAST(id AS STRING) AS id")
    assert D.versions_in_ranges(p, r).count() == 50_000


def test_breaker_matches_a_sequential_walk(spark):
    rng = random.Random(5)
    rows, t = [], T0
    for i in range(600):
        t += dt.timedelta(seconds=rng.choice([1, 20, 70]))
        rows.append(("hot" if rng.random() < 0.5 else "cold", i, t, rng.random() < 0.2))
    df = spark.createDataFrame(rows, "service string, event_id int, ts timestamp, ok boolean")
    got = {r["event_id"]: (r["state_before"], r["state_after"]) for r in K.breaker_timeline(df, chunk_seconds=300).collect()}
    state, want = {}, {}
    for s, i, ts, ok in rows:
        n, last = state.get(s, (0, None))
        before = "closed" if n < 5 else "half_open" if (ts - last).total_seconds() > 60 else "open"
        n, last = (0, last) if ok else (n + 1, ts)
        state[s] = (n, last)
        want[i] = (before, "open" if n >= 5 else "closed")
    assert got == want


@pytest.mark.parametrize("url,want", [("https://github.com/o/r.git", ("o", "r")), ("git@github.com:o/r", ("o", "r")), ("github.com/o/r/tree/main", ("o", "r")), ("https://gitlab.com/o/r", (None, None))])
def test_repo_key(spark, url, want):
    r = R.repo_key(spark.createDataFrame([(url,)], "repo_url string")).first()
    assert (r["owner"], r["repo_name"]) == want


def test_filing_urls(spark):
    base = "https://www.sec.gov/Archives/edgar/data/320193/"
    rows = [(base + "000032019323000106/aapl.htm",), (base + "12/0000320193-23-000106.txt?x",), ("https://x.org/a",)]
    got = [(r["cik"], r["accession_number"], r["primary_document"]) for r in SF.url_metadata(spark.createDataFrame(rows, "url string")).collect()]
    assert got == [("0000320193", "0000320193-23-000106", "aapl.htm"), ("0000320193", "0000320193-23-000106", "0000320193-23-000106.txt"), (None, None, None)]


def test_readers_of_files(spark, tmp_path):
    """Filings, submission indexes, score and case files, read from a folder; the report written to one."""
    import json

    from paperloom.sources import evals as E
    from paperloom.operators import filing_text as T

    at = tmp_path / "Archives/edgar/data/320193/000032019323000106"
    at.mkdir(parents=True)
    (at / "a.txt").write_text("Item 1. Business\n\n\n\n\n\nwide   gap\n", encoding="utf-8")
    (at / "b.htm").write_text("<html><body><p>Item 1.</p><p>Business</p></body></html>", encoding="utf-8")
    filings = SF.read_filings(spark, str(tmp_path / "Archives"))
    rows = {r["primary_document"]: (r["cik"], r["accession"], r["content"][:6]) for r in filings.collect()}
    assert rows == {"a.txt": ("0000320193", "0000320193-23-000106", "Item 1"), "b.htm": ("0000320193", "0000320193-23-000106", "<html>")}
    texts = {r["format"]: r["text"] for r in T.normalize_filings(filings.select("filing_id", "content")).collect()}
    assert texts["html"].split() == ["Item", "1.", "Business"] and texts["text"].startswith("Item 1. Business") and "\n\n\n\n" not in texts["text"]

    index = {"cik": "1", "filings": {"recent": {"form": ["10-K", "8-K"], "filingDate": ["2020-01-01", "2020-02-01"], "accessionNumber": ["a", "b"], "primaryDocument": ["x.htm"], "primaryDocDescription": []}}}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/1.json").write_text(json.dumps(index, indent=1))
    got = [(r["ord"], r["form"], r["primary_document"]) for r in SF.read_submissions(spark, str(tmp_path / "sub")).orderBy("ord").collect()]
    assert got == [(0, "10-K", "x.htm"), (1, "8-K", "")]

    (tmp_path / "scores").mkdir()
    score = {"case_id": "c1", "passed": True, "latency_ms": 2.5, "llm_calls": 1, "avg_confidence": 0.5, "checks": [{"name": "n", "passed": True, "expected": "e", "actual": "a"}]}
    (tmp_path / "scores/run.json").write_text(json.dumps({"scores": [score, {"case_id": "c2", "passed": False, "failure_type": "parsing_error"}]}, indent=1))
    scores = E.read_scores(spark, str(tmp_path / "scores"), "s")
    assert {(r["case_id"], r["passed"], r["suite"]) for r in scores.collect()} == {("c1", True, "s"), ("c2", False, "s")}
    E.write_report(scores.groupBy("suite").count(), scores, str(tmp_path / "report"))
    lines = {r["value"] for r in spark.read.text(str(tmp_path / "report/report")).collect()}
    assert any("PASS `c1`" in x for x in lines) and spark.read.json(str(tmp_path / "report/summary")).first()["count"] == 2

    (tmp_path / "cases").mkdir()
    (tmp_path / "cases/c.json").write_text(json.dumps([{"case_id": "k", "task": "t", "input_data": {"a": 1}}, {"case_id": "l", "difficulty": "hard", "tags": ["x"]}]))
    flat = {r["case_id"]: (r["inputs"], r["outputs"]["difficulty"], r["outputs"]["tags"]) for r in E.flatten_cases(E.read_cases(spark, str(tmp_path / "cases"))).collect()}
    assert flat == {"k": ('{"a":1}', "normal", []), "l": (None, "hard", ["x"])}


@pytest.mark.parametrize("root", ["repos/repos", "c++", "a b/100%"])
def test_repository_names_under_odd_roots(spark, tmp_path, root):
    base = tmp_path / root
    for path in ("x/a.py", "x/src/b.py", "repos/repos/c.py", "top.py"):
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text("pass")
    rows = {(r["repo"], r["path"], r["content"]) for r in S.scan_repo_files(spark, str(base) + "/").collect()}
    assert rows == {("x", "a.py", "pass"), ("x", "src/b.py", "pass"), ("repos", "repos/c.py", "pass")}


def test_one_pass_audit_equals_the_joined_one(spark):
    deps = spark.createDataFrame([(f"r{i % 4}", "PyPI" if i % 3 else "npm", f"p{i % 5}", [None, "", "1.0", "1.5", "2.0"][i % 5 if i % 7 else 2], i) for i in range(60)], "repo string, ecosystem string, name string, version string, pos int")
    adv = spark.sql("""SELECT concat('A', id) AS id, array('CVE-1') AS aliases, 's' AS summary, element_at(array('HIGH', 'critical', 'medium', 'low'), CAST(id % 4 AS INT) + 1) AS severity,
      array(named_struct('ecosystem', if(id % 2 = 0, 'PyPI', 'npm'), 'name', concat('p', id % 5), 'versions', array('2.0'), 'ranges', array(named_struct('introduced', '1.2', 'fixed', if(id % 3 = 0, '1.9', NULL))), 'scores', array('7.1'))) AS affected,
      array(named_struct('type', 'WEB', 'url', 'u')) AS refs FROM range(30)""")
    latest = spark.createDataFrame([("PyPI", "p2", "2.0"), ("PyPI", "p3", ""), ("PyPI", "p4", "9"), ("npm", "p2", "3")], "ecosystem string, name string, version string")
    repos = spark.createDataFrame([("r0",), ("r1",), ("r2",), ("r3",), ("bare",)], "repo string")
    for extra in (None, repos):
        plain = D.audit_summary(deps, D.audit_deps(deps, adv), D.outdated(deps, latest), extra)
        got = D.audit(deps, adv, latest, extra)
        cols = plain.columns
        assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, plain.collect())) and plain.filter("vulnerabilities > 0 and outdated > 0").count()
    assert {r["note"] != "" for r in D.audit(deps, adv, latest, repos).filter("repo = 'bare'").collect()} == {True}


ADVISORY = "id string, severity string, aliases array<string>, summary string, refs array<struct<type:string,url:string>>, affected array<struct<ecosystem:string,name:string,versions:array<string>,ranges:array<struct<introduced:string,fixed:string>>,scores:array<string>>>"


def test_package_counts_are_the_findings_counted(spark):
    """Ranges that overlap, touch, repeat, are empty or have no end, listed versions inside and outside of them, in
    several entries and rows of one advisory; equal versions in other words; nulls."""
    rng = random.Random(7)
    versions = ["1", "1.0", "1.0.0", "1.5", "1.5rc1", "1.5.post1", "2.0a1", "2", "v2.0", "2.1", "3", "10.0", "x", "0", "0.9", "", None]
    some = lambda: rng.choice(versions)
    entry = lambda: (rng.choice(["PyPI", "PyPI", "npm", None]), rng.choice(["a", "b", None]), rng.choice([None, [], ["1.0", "1.0"], [some(), some()]]),
                     rng.choice([None, [], [(None, None)], [(some(), some()) for _ in range(rng.randrange(1, 5))]]), [rng.choice(["9.8", "7.1", "4", "1", "?"])])
    rows = [(f"A{i}" if i % 11 else None, rng.choice(["", None, "HIGH", "critical", "medium"]), [], "s", [], [entry() for _ in range(rng.randrange(4))] if i % 13 else None) for i in range(120)]
    # An advisory that comes twice, with one severity and other ranges.
    rows += [("A1", rows[1][1], [], "s", [], rows[1][5]), ("T", "HIGH", [], "s", [], [("PyPI", "a", ["3"], [("1", "2")], [])]), ("T", "HIGH", [], "s", [], [("PyPI", "a", ["3", "1.5"], [("1.5", "2.1")], [])])]
    adv = spark.createDataFrame(rows, ADVISORY)
    deps = spark.createDataFrame([(f"r{i % 7}", e, n, v) for i, (e, n, v) in enumerate((e, n, v) for e in ("PyPI", "npm", None) for n in ("a", "b", "c", None) for v in versions * 2)],
                                 "repo string, ecosystem string, name string, version string")
    want = D.package_findings(deps, adv).groupBy("ecosystem", "name", "version").agg(
        F.count(F.lit(1)), *[F.count_if(F.col("severity") == s) for s in ("critical", "high", "medium")]).collect()
    got = D.package_counts(deps, adv).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 30


def _most_rows(plan) -> int:
    """The most rows that any step of an executed plan gave."""
    for inner in ("executedPlan", "plan"):
        if plan.getClass().getSimpleName().endswith({"executedPlan": "AdaptiveSparkPlanExec", "plan": "QueryStageExec"}[inner]):
            return _most_rows(getattr(plan, inner)())
    own = plan.metrics().apply("numOutputRows").value() if plan.metrics().contains("numOutputRows") else 0
    return max([own, *[_most_rows(plan.children().apply(i)) for i in range(plan.children().size())]])


def test_audit_counts_findings_without_making_them(spark):
    """1,500 versions of one package in up to 1,500 ranges each: over a million findings, no step of which has many rows."""
    n = 1500
    deps = spark.range(n).selectExpr("concat('r', id % 10) AS repo", "'PyPI' AS ecosystem", "'hot' AS name", "concat(id div 100, '.', id % 100) AS version")
    adv = spark.range(n).selectExpr("concat('A', id) AS id", "'HIGH' AS severity", "array('CVE-1') AS aliases", "'s' AS summary", "array(named_struct('type', 'WEB', 'url', 'u')) AS refs", """array(named_struct(
      'ecosystem', 'PyPI', 'name', 'hot', 'versions', array('0.0'), 'ranges', array(named_struct('introduced', concat(id div 100, '.', id % 100), 'fixed', cast(null AS string))), 'scores', array('1'))) AS affected""")
    latest = spark.createDataFrame([], "ecosystem string, name string, version string")
    got = D.audit(deps, adv, latest)
    # Version i is in the ranges 0 to i; version 0.0 is listed by all.
    assert sum(r["vulnerabilities"] for r in got.collect()) == n * (n + 1) // 2 + n - 1
    assert _most_rows(got._jdf.queryExecution().executedPlan()) <= 10 * n


def test_changelog_parts_make_up_the_changelog(spark):
    commits = spark.createDataFrame([("r" if i % 9 else "s", i, f"{i:040x}", ("feat: " if i % 3 else "fix: ") + "x" * (i % 90), "me", "") for i in range(500)],
                                    "repo string, ord int, sha string, message string, author string, date string")
    tags = spark.createDataFrame([], "repo string, ord int, name string, sha string")
    parts = R.changelog_parts(commits, tags, 300).collect()
    whole = {}
    for r in R.changelog_lines(commits).orderBy("ord").collect():
        whole.setdefault((r["repo"], r["section"]), []).append(r["line"])
    got = {}
    for r in sorted(parts, key=lambda r: r["part"]):
        got.setdefault((r["repo"], r["section"]), []).append(r["text"])
    assert {k: "\n".join(v) for k, v in got.items()} == {k: "\n".join(v) for k, v in whole.items()}
    assert max(len(r["text"]) for r in parts) <= 300 + 150 and len(parts) > 50


def test_counted_audit_is_the_audit_counted(spark):
    deps = spark.createDataFrame([("r", "PyPI", "a", "1.0"), ("r", "PyPI", "a", "1.0"), ("s", "PyPI", "a", "1.0"), ("s", "PyPI", "a", "1.1"), ("s", "PyPI", "a", None), ("s", "npm", "b", "2")],
                                 "repo string, ecosystem string, name string, version string")
    adv = spark.sql("""SELECT id, array(concat('CVE-', id)) AS aliases, 'x' AS summary, 'HIGH' AS severity, array(named_struct('ecosystem', 'PyPI', 'name', 'a', 'versions', array('1.0'),
      'ranges', array(named_struct('introduced', '1', 'fixed', '2'), named_struct('introduced', '0', 'fixed', cast(null AS string))), 'scores', array('9.8'))) AS affected,
      array(named_struct('type', 'WEB', 'url', 'u')) AS refs FROM VALUES ('A1'), ('A2') t(id)""")
    plain = D.audit_deps(deps, adv).groupBy("name", "version", "advisory_id", "severity").count().collect()
    got = D.audit_deps(deps, adv, counted=True).select("name", "version", "advisory_id", "severity", "uses").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain)) and sorted(r["uses"] for r in got) == [1, 1, 3, 3]


def test_findings_against_every_comparison(spark):
    """Each version beside each range and each listed version; overlapping, empty and open ranges, repeated identifiers, nulls."""
    rng = random.Random(11)
    versions = ["1", "1.0", "1.5", "1.5rc1", "1.5.post1", "2", "v2.0", "2.1", "3", "10.0", "x", "0.9", "", None, *[f"4.{i}" for i in range(40)]]
    some = lambda: rng.choice(versions)
    entry = lambda: (rng.choice(["PyPI", "npm", None]), rng.choice(["a", "B", None]), rng.choice([None, [], [some(), some(), "4.7"]]),
                     rng.choice([None, [(None, None)], [(some(), some()) for _ in range(rng.randrange(1, 5))]]), ["7.1"])
    rows = [(f"A{i % 55}" if i % 11 else None, "HIGH", ["CVE-1"], None, [("WEB", "u")], [entry() for _ in range(rng.randrange(4))] if i % 13 else None) for i in range(80)]
    adv = spark.createDataFrame(rows, ADVISORY)
    deps = spark.createDataFrame([(f"r{i % 7}", e, n, v) for i, (e, n, v) in enumerate((e, n, v) for e in ("PyPI", "npm", None) for n in ("a", "B", "c", None) for v in versions * 2)],
                                 "repo string, ecosystem string, name string, version string")
    pairs = deps.filter("version <> ''").select("ecosystem", "name", "version").distinct()
    named = adv.select("id", F.explode("affected").alias("a")).select("id", F.col("a.ecosystem").alias("ecosystem"), F.col("a.name").alias("name"), "a").join(pairs, ["ecosystem", "name"]).filter("id is not null")
    key = D.version_key
    ranges = named.select("*", F.explode("a.ranges").alias("r")).filter((key(F.col("version")) >= key(F.coalesce("r.introduced", F.lit("0")))) & (F.col("r.fixed").isNull() | (key(F.col("version")) < key(F.col("r.fixed")))))
    cols = ["ecosystem", "name", "version", "id"]
    want = ranges.select(cols).union(named.filter(F.array_contains("a.versions", F.col("version"))).select(cols)).distinct().collect()
    found = D.audit_deps(deps, adv, counted=True).collect()
    assert sorted((r["ecosystem"], r["name"], r["version"], r["advisory_id"]) for r in found) == sorted(map(tuple, want)) and len(want) > 1000
    assert {(r["uses"], r["severity"], r["cve_id"], r["summary"], r["reference_url"]) for r in found} == {(2, "high", "CVE-1", "", "u")}


def _most_shuffled(plan) -> int:
    """The most rows that an exchange of an executed plan wrote."""
    for inner, of in (("executedPlan", "AdaptiveSparkPlanExec"), ("plan", "QueryStageExec")):
        if plan.getClass().getSimpleName().endswith(of):
            return _most_shuffled(getattr(plan, inner)())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.metrics().contains("shuffleRecordsWritten") else 0
    return max([own, *[_most_shuffled(plan.children().apply(i)) for i in range(plan.children().size())]])


def test_findings_are_not_shuffled(spark):
    """1,000 versions of one package in up to 1,000 ranges each: half a million findings, and no exchange has many rows."""
    n = 1000
    deps = spark.range(2 * n).selectExpr("concat('r', id % 10) AS repo", "'PyPI' AS ecosystem", "'hot' AS name", "concat(id % 1000 div 100, '.', id % 100) AS version")
    adv = spark.range(n).selectExpr("concat('A', id) AS id", "'HIGH' AS severity", "array('CVE-1') AS aliases", "'s' AS summary", "array(named_struct('type', 'WEB', 'url', 'u')) AS refs", """array(named_struct(
      'ecosystem', 'PyPI', 'name', 'hot', 'versions', array('0.0'), 'ranges', array(named_struct('introduced', concat(id div 100, '.', id % 100), 'fixed', cast(null AS string))), 'scores', array('1'))) AS affected""")
    found = D.audit_deps(deps, adv, counted=True)
    counts = found.groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.sum("uses").alias("uses"))
    rows = {r["version"]: (r["n"], r["uses"]) for r in counts.collect()}
    # Version i is in the ranges 0 to i; version 0.0 is listed by all.
    assert rows.pop("0.0") == (n, 2 * n) and rows == {f"{i // 100}.{i % 100}": (i + 1, 2 * i + 2) for i in range(1, n)}
    assert _most_shuffled(counts._jdf.queryExecution().executedPlan()) <= 20 * n
