"""Registered queries over repository snapshots, dependencies, commits and skill requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.operators import deps as D
from paperloom.operators import release as R
from paperloom.operators import secrets as X
from paperloom.operators import skills as K
from paperloom.plans import adapters as A
from paperloom.plans.filings_oracle import q, strip
from paperloom.plans.ledger import K as KEY
from paperloom.plans.ledger import USER, _case
from paperloom.sources import repos as S

NL = "chr(10)"
# Planted lines, one per rule; built with repeat() so that no secret-like literal is stored.
PLANTED = [
    "'id = AKIA' || repeat('A', 16)", "'AWS my SECRET ' || chr(39) || repeat('a', 40) || chr(39)", "'t ghp_' || repeat('b', 36)", "'github_pat_' || repeat('c', 82)",
    "'sk-' || repeat('d', 48)", "'xoxb-' || repeat('1', 10) || '-' || repeat('2', 12) || '-' || repeat('z', 24)", "'-----BEGIN ' || 'RSA PRIVATE KEY-----'",
    "'API_KEY = \"' || repeat('k', 20) || '\"'", "'password: \"' || repeat('p', 8) || '\"'", "'db_pass=' || chr(39) || repeat('s', 6) || chr(39)", "'nothing here'",
    "'token = \"' || repeat('0', 40) || '\"'",
]
FILES = f"""SELECT source AS repo, 'doc_' || CAST(doc_id AS STRING) || '.py' AS path, n_chars AS size, text || {NL} || CASE doc_id % {len(PLANTED)} {' '.join(f'WHEN {i} THEN {p}' for i, p in enumerate(PLANTED))} END AS content,
  doc_id FROM {{documents}}"""
ROOT_FILES = f"""SELECT 'repo_' || CAST(doc_id % 211 AS STRING) AS repo, {_case('doc_id % 10', ['pyproject.toml', 'package.json', 'Makefile', 'src/setup.py', 'README.md', 'requirements.txt', 'package-lock.json', 'setup.py', 'a.txt', 'b.txt'])} AS path FROM {{documents}}"""
TREE = f"""SELECT source AS repo, {_case('doc_id % 9', ['src/a.py', '.git/config', 'x/node_modules/y/z.js', 'img/logo.PNG', 'poetry.lock', 'build', 'lib/build/out.txt', 'env.py', 'docs/.hidden'])} AS path,
  CASE WHEN doc_id % 11 = 0 THEN 1000001 ELSE n_chars END AS size, text AS content, doc_id FROM {{documents}}"""
MANIFEST = f"""SELECT 'repo_' || CAST(doc_id AS STRING) AS repo, CASE doc_id % 3 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'package-lock.json' ELSE 'pyproject.toml' END AS path,
  CASE doc_id % 3 WHEN 0 THEN 'requests==2.' || CAST(doc_id % 30 AS STRING) || '.0' || {NL} || '# note' || {NL} || '  flask[async]>=1.' || CAST(doc_id % 7 AS STRING) || ',<3  # web' || {NL} || '-r other.txt' || {NL}
      || 'git+https://x/y' || {NL} || 'numpy' || {NL} || {NL} || 'pkg_' || CAST(doc_id % 50 AS STRING) || '~=' || CAST(n_chars AS STRING)
    WHEN 1 THEN '{{"name": "x", "packages": {{"": {{"version": "0.0.1"}}, "node_modules/left": {{"version": "1.2.' || CAST(doc_id % 9 AS STRING) || '"}}, "node_modules/@s/p": {{"version": "3"}}, "node_modules/a/node_modules/b": {{"version": "4"}}, "node_modules/bare": {{}}, "node_modules/p' || CAST(doc_id AS STRING) || '": {{"version": "9.9"}}}}}}'
    ELSE '[project]' || {NL} || 'dependencies = ["httpx>=0.' || CAST(doc_id % 9 AS STRING) || '", "rich"]' || {NL} || '[tool.poetry.dependencies]' || {NL} || 'python = "^3.11"' || {NL} || 'Rich = "^1.0"' || {NL} || 'attrs = "^23.' || CAST(doc_id % 4 AS STRING) || '"' END AS content
  FROM {{documents}}"""
DEPS = """SELECT 'r' || CAST(l_orderkey AS STRING) AS repo, CASE WHEN l_partkey % 2 = 0 THEN 'PyPI' ELSE 'npm' END AS ecosystem,
  CASE WHEN l_suppkey % 2 = 0 THEN 'pkg' ELSE 'Pkg' END || CAST(l_partkey % 300 AS STRING) AS name, CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(l_linenumber AS STRING) || '.' || CAST(CAST(l_quantity AS INT) AS STRING) || '.' || CAST(l_suppkey % 5 AS STRING) END AS version,
  CASE l_suppkey % 3 WHEN 0 THEN 'requirements' WHEN 1 THEN 'pyproject' ELSE 'package-lock' END AS source, l_linenumber AS pos FROM {lineitem}"""
ADVISORIES = """SELECT 'ADV-' || CAST(p_partkey AS STRING) AS id, CASE WHEN p_size % 2 = 0 THEN 'PyPI' ELSE 'npm' END AS ecosystem, CASE WHEN p_size % 3 = 0 THEN 'Pkg' ELSE 'pkg' END || CAST(p_partkey % 300 AS STRING) AS name,
  CAST(p_size % 5 AS STRING) || '.' || CAST(p_size AS STRING) AS introduced, CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size % 5 + p_size % 3 AS STRING) || '.5' END AS fixed, '1.' || CAST(p_size AS STRING) || '.0' AS listed,
  CASE WHEN p_size % 6 = 0 THEN 'HIGH' ELSE '' END AS severity, CASE p_size % 5 WHEN 0 THEN '9.8' WHEN 1 THEN 'CVSS:3.1/AV:N' WHEN 2 THEN '7.0' WHEN 3 THEN '4.5' ELSE '1' END AS score, 'CVE-2024-' || CAST(p_partkey AS STRING) AS cve, p_name AS summary,
  p_size % 2 = 0 AS has_web FROM {part}"""
LATEST = """SELECT 'PyPI' AS ecosystem, pre || 'kg' || CAST(k AS STRING) AS name, CASE WHEN k % 7 = 0 THEN 'v' ELSE '' END || CAST(k % 9 AS STRING) || CASE WHEN k % 11 = 0 THEN 'x' ELSE '' END || '.1.0' AS version
  FROM (SELECT DISTINCT p_partkey % 300 AS k, CASE WHEN p_size % 2 = 0 THEN 'p' ELSE 'P' END AS pre FROM {part}) d"""
COMMIT_TEXT = ["feat: ", "fix(core): ", "chore: ", "refactor!: ", "FEAT(ui)!: ", "wip ", "docs: "]
COMMITS = f"""SELECT {USER} AS repo, 1000000000 - event_id AS ord, md5(CAST(event_id AS STRING)) AS sha, CASE WHEN {KEY} = 13 THEN 'BREAKING CHANGE ' ELSE '' END || {_case(f'{KEY} % 7', COMMIT_TEXT)} || event_type || {NL} || 'body' AS message,
  'dev' || CAST({KEY} % 5 AS STRING) AS author, CAST(ts AS STRING) AS date FROM {{events}}"""
TAGS = f"""SELECT {USER} AS repo, 1000000000 - event_id AS ord, CASE {KEY} % 4 WHEN 0 THEN 'nightly' WHEN 1 THEN 'v' ELSE '' END || CASE WHEN {KEY} % 4 = 0 THEN '' ELSE CAST({KEY} % 3 AS STRING) || '.' || CAST({KEY} AS STRING) || '.7' END AS name,
  CASE WHEN event_id % 5 = 0 THEN 'ffffffffffffffff' ELSE md5(CAST(event_id AS STRING)) END AS sha FROM {{events}} WHERE event_type = 'purchase'"""
RAW_REQUESTS = ["lint", "Run tests please", "ship it now", "check vulnerabilities in packages", "find leaked keys", "audit", "completely unrelated", " Security_Scan ", "make a new version", "outdated-packages",
                "code quality", "run", "tag", "detect hardcoded passwords and secrets"]
REQUESTS = f"SELECT event_id AS id, {_case(f'event_id % {len(RAW_REQUESTS)}', RAW_REQUESTS)} AS raw FROM {{events}}"
PLAN_TEXT = ["", "lint-and-test,build-and-release", " Security-Scan ,security-scan,unknown", "build-and-release", "dependency-audit,lint-and-test,security-scan", "nope"]
QUERY_TEXT = ["", "please release it", "check my code", "   "]
HINTS = ["", "build-and-release,lint-and-test", "security-scan", "dependency-audit,security-scan", "dependency-audit,security-scan,lint-and-test"]
PLANS = f"""SELECT event_id AS id, {_case('event_id % 4', QUERY_TEXT)} AS query, {_case(f'{KEY} % 6', PLAN_TEXT)} AS plan, {_case('user_id % 5', HINTS)} AS include_hint,
  {_case(f'({KEY} + user_id) % 5', HINTS)} AS exclude_hint, event_id % 4 AS max_skills FROM {{events}}"""
STEP_JSON = """CASE event_type WHEN 'click' THEN '{{"lint_issue_count": ' || CAST(user_id % 5 AS STRING) || ', "lint_issues": ["a", "b"], "test_failed_count": 2}}'
  WHEN 'view' THEN '{{"vulnerabilities": ["x", "y", "z"], "outdated": ["q"]}}' WHEN 'signup' THEN '{{"findings": [{{"finding_type": "Secret"}}, {{"finding_type": "sast"}}, {{}}]}}'
  WHEN 'purchase' THEN '{{"next_version": "v1.0.0", "findings": [{{}}]}}' ELSE 'not json' END"""
SKILL_STEPS = f"""SELECT {USER} AS trace_id, event_id AS iteration, CASE event_type WHEN 'click' THEN 'lint-and-test' WHEN 'view' THEN 'dependency-audit' WHEN 'signup' THEN 'security-scan'
  WHEN 'purchase' THEN 'build-and-release' ELSE 'security-scan' END AS skill, {STEP_JSON} AS raw_result FROM {{events}}"""
REPO_URLS = ["https://github.com/o/r", "git@github.com:Own/Rep.git", "github.com/a/b/tree/main/x", "https://github.com/a/b/", "https://tok3n@github.com/a/b.git", "https://gitlab.com/a/b", "http://GitHub.com/a/b/blob/x.md",
             "https://github.com/a", "nonsense", "https://github.com/a/b/unknown/z"]
URLS = f"SELECT event_id AS id, {_case(f'event_id % {len(REPO_URLS)}', REPO_URLS)} AS repo_url FROM {{events}}"
REUSE = f"""SELECT event_id AS id, {USER} AS repo, 'main' AS branch, CASE WHEN event_type = 'click' THEN 'lint' ELSE 'scan' END AS skill, md5(CAST(user_id % 3 AS STRING)) AS sha, {KEY} % 2 = 0 AS dry_run, ts FROM {{events}}"""
BREAKER = f"SELECT 's' || CAST(user_id % 7 AS STRING) AS service, event_id, ts, {KEY} % 3 = 0 AS ok FROM {{events}}"
REPORTS = f"""SELECT {USER} AS repo, CASE event_id % 5 WHEN 0 THEN 'ruff' WHEN 1 THEN 'eslint' WHEN 2 THEN 'bandit' WHEN 3 THEN 'jest' ELSE 'pytest' END AS tool, CASE event_id % 5
  WHEN 0 THEN '[{{"filename": "a.py", "location": {{"row": 1, "column": 2}}, "code": "E501", "message": "long", "fix": null}}, {{"filename": "b.py", "location": {{"row": ' || CAST({KEY} AS STRING) || '}}, "code": "F401", "message": "m", "fix": {{"a": 1}}}}]'
  WHEN 1 THEN '[{{"filePath": "x.js", "messages": [{{"severity": 2, "line": 3, "column": 4, "ruleId": "semi", "message": "no"}}, {{"severity": 1, "line": ' || CAST({KEY} AS STRING) || '}}]}}]'
  WHEN 2 THEN '{{"results": [{{"issue_severity": "LOW", "issue_confidence": "LOW"}}, {{"issue_severity": "HIGH", "issue_confidence": "LOW", "filename": "/tmp/c/a.py", "test_id": "B1", "issue_text": "bad", "line_number": ' || CAST({KEY} AS STRING) || ', "code": " x "}}]}}'
  WHEN 3 THEN '{{"numTotalTests": 3, "numPassedTests": 2, "numFailedTests": 1, "numPendingTests": 0, "testResults": [{{"testFilePath": "t.js", "testResults": [{{"status": "failed", "fullName": "f", "failureMessages": ["p", "q"]}}, {{"status": "passed"}}]}}]}}'
  ELSE 'FAILED tests/t.py::a - AssertionError: x' || {NL} || CAST({KEY} AS STRING) || ' passed, 1 failed, 2 skipped in 1.2s' END AS payload FROM {{events}}"""


MANIFEST, REPORTS = A.literal_braces(MANIFEST), A.literal_braces(REPORTS)


def _advisories(s, d):
    a = F.col
    return A.bind(s, d, ADVISORIES).select(
        "id", F.array(F.lit("GHSA-x"), a("cve")).alias("aliases"), "summary", "severity",
        F.array(F.struct(a("ecosystem"), a("name"), F.array("listed").alias("versions"), F.array(F.struct("introduced", "fixed")).alias("ranges"),
                         F.array("score").alias("scores"))).alias("affected"),
        F.array(F.struct(F.lit("ADVISORY").alias("type"), F.lit("u0").alias("url")),
                F.struct(F.when(a("has_web"), "WEB").otherwise("FIX").alias("type"), F.concat(F.lit("https://x/"), "id").alias("url"))).alias("refs"))


def _words(c):
    return F.filter(F.split(c, ","), lambda x: x != "")


def _plans(s, d):
    p = A.bind(s, d, PLANS)
    return K.sanitise_plans(p.select("id", "query", _words("plan").alias("plan"), _words("include_hint").alias("include_hint"),
                                     _words("exclude_hint").alias("exclude_hint"), "max_skills")).select("id", F.array_join("plan", ",").alias("plan"))


def _findings(s, d):
    return X.scan_secrets(A.bind(s, d, FILES), extra=True)


def _quality(s, d):
    findings, tests = S.ingest_reports(A.bind(s, d, REPORTS))
    langs = A.bind(s, d, f"SELECT DISTINCT {USER} AS repo, CASE user_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' ELSE 'unknown' END AS language FROM {{events}}")
    return K.quality_summary(langs, findings, tests)


def _audit(s, d):
    merged = D.merge_deps(A.bind(s, d, DEPS))
    return D.audit(merged, _advisories(s, d), A.bind(s, d, LATEST))


QUERIES = {
    "secret_findings": lambda s, d: _findings(s, d).select("repo", "path", "line", "severity", "description", "match_preview"),
    "secret_summary": lambda s, d: X.scan_summary(_findings(s, d), A.bind(s, d, FILES)),
    "scannable_files": lambda s, d: S.keep_scannable(A.bind(s, d, TREE)).select("repo", "path", "doc_id"),
    "repo_language": lambda s, d: K.repo_language(A.bind(s, d, ROOT_FILES)),
    "tool_findings": lambda s, d: S.ingest_reports(A.bind(s, d, REPORTS), "/tmp/c")[0].groupBy("repo", "tool", "severity").agg(
        F.count(F.lit(1)).alias("findings"), F.sum("line").alias("lines")),
    "tool_test_counts": lambda s, d: S.ingest_reports(A.bind(s, d, REPORTS))[1],
    "quality_summary": _quality,
    "manifest_deps": lambda s, d: S.ingest_manifests(A.bind(s, d, MANIFEST)).fillna("", ["version"]).select("repo", "ecosystem", "name", "version", "source"),
    "manifest_deps_all": lambda s, d: S.ingest_manifests(A.bind(s, d, MANIFEST)).filter("source = 'pyproject'").fillna("", ["version"]),
    "merged_deps": lambda s, d: D.merge_deps(A.bind(s, d, DEPS)).fillna("", ["version"]),
    "dependency_audit": lambda s, d: D.audit_deps(A.bind(s, d, DEPS), _advisories(s, d), counted=True).fillna("", ["fixed_version"]).select(
        "ecosystem", "name", "version", "advisory_id", "cve_id", "severity", "summary", "fixed_version", "reference_url", "uses"),
    "outdated_deps": lambda s, d: D.outdated(A.bind(s, d, DEPS), A.bind(s, d, LATEST)),
    "audit_summary": _audit,
    "commits_since_tag": lambda s, d: R.commits_since_tag(A.bind(s, d, COMMITS), A.bind(s, d, TAGS)).select("repo", "ord", "sha", "message"),
    "all_commits_since_tag": lambda s, d: R.commits_since_tag(A.bind(s, d, COMMITS), A.bind(s, d, TAGS), None).groupBy("repo").agg(F.count(F.lit(1)).alias("commits")),
    "release_notes": lambda s, d: R.release_notes(A.bind(s, d, COMMITS), A.bind(s, d, TAGS)).fillna("", ["current_version"]),
    "changelog_lines": lambda s, d: R.changelog_lines(R.commits_since_tag(A.bind(s, d, COMMITS), A.bind(s, d, TAGS))),
    # Small parts, so that the tables' histories have several.
    "changelog_parts": lambda s, d: R.changelog_parts(A.bind(s, d, COMMITS), A.bind(s, d, TAGS), 200),
    "skill_matches": lambda s, d: K.match_requests(A.bind(s, d, REQUESTS)).fillna("", ["skill"]).fillna(0.0, ["confidence"]).select(
        "id", "skill", F.round("confidence", 6).alias("confidence")),
    "sanitised_plans": _plans,
    "run_signals": lambda s, d: K.run_signals(A.bind(s, d, SKILL_STEPS)),
    "repo_keys": lambda s, d: R.redact(R.repo_key(A.bind(s, d, URLS)), "repo_url").fillna("", ["owner", "repo_name"]),
    "result_reuse": lambda s, d: K.reuse_results(A.bind(s, d, REUSE), 43200).select("id", "cache_key", "cache_hit"),
    "breaker_timeline": lambda s, d: K.breaker_timeline(A.bind(s, d, BREAKER)).select("service", "event_id", "state_before", "state_after", "failures"),
}

_RULES = [*fixed.SECRET_RULES, fixed.EXTRA_SECRET_RULE]
_m = lambda p: f"regexp_matches(line, {q(p)})"
_pick = lambda values: "CASE rule " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
_FINDINGS = f"""fl AS ({A.duck(FILES)}), ln AS (SELECT repo, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM fl),
  hit AS (SELECT *, CASE {' '.join(f'WHEN {_m(p)} THEN {i}' for i, (p, *_) in enumerate(_RULES))} END AS rule FROM ln),
  found AS (SELECT repo, path, n AS line, {_pick([q(s) for _, s, _, _ in _RULES])} AS severity, {_pick([q(k) for _, _, k, _ in _RULES])} AS description,
    substr({_pick([f'regexp_extract(line, {q(p)}, 0)' for p, *_ in _RULES])}, 1, 4) || '***' AS match_preview FROM hit WHERE rule IS NOT NULL)"""
# The tables hold plain releases; pre-releases are tested by hand.
_KEYV = "list_append(list_transform(string_split(regexp_replace({v}, '(\\.0+)+$', ''), '.'), lambda p: CAST(p AS BIGINT) + 10), 5)"
_SEV = """CASE WHEN severity <> '' THEN lower(severity) WHEN TRY_CAST(score AS DOUBLE) >= 9 THEN 'critical' WHEN TRY_CAST(score AS DOUBLE) >= 7 THEN 'high'
  WHEN TRY_CAST(score AS DOUBLE) >= 4 THEN 'medium' WHEN TRY_CAST(score AS DOUBLE) IS NOT NULL THEN 'low' ELSE 'unknown' END"""


def _audited(source: str) -> str:
    return f"""adv AS ({A.duck(ADVISORIES)}), audited AS (
  SELECT d.repo, d.ecosystem, d.name, d.version, a.id AS advisory_id, a.cve AS cve_id, {_SEV} AS severity, a.summary AS summary, coalesce(a.fixed, '') AS fixed_version,
    CASE WHEN has_web THEN 'https://x/' || a.id ELSE '' END AS reference_url FROM {source} d JOIN adv a ON a.ecosystem = d.ecosystem AND a.name = d.name
  WHERE d.version IS NOT NULL AND (a.listed = d.version OR ({_KEYV.format(v='d.version')} >= {_KEYV.format(v='a.introduced')} AND (a.fixed IS NULL OR {_KEYV.format(v='d.version')} < {_KEYV.format(v='a.fixed')}))))"""


_DEPS = f"deps AS ({A.duck(DEPS)})"
_MERGED = f"""{_DEPS}, merged AS (SELECT * FROM deps WHERE source <> 'pyproject' UNION ALL
  SELECT repo, ecosystem, name, version, source, pos FROM (SELECT *, row_number() OVER (PARTITION BY repo, lower(name) ORDER BY pos, ecosystem, name, version NULLS FIRST) AS rn FROM deps d WHERE source = 'pyproject'
    AND NOT EXISTS (SELECT 1 FROM deps r WHERE r.source = 'requirements' AND r.repo = d.repo AND lower(r.name) = lower(d.name))) x WHERE rn = 1)"""
_MAJ = "TRY_CAST(regexp_replace(split_part({v}, '.', 1), '^v+', '') AS INT)"


def _old(source: str) -> str:
    return f"""latest AS ({A.duck(LATEST)}), old AS (SELECT d.repo, d.name AS package, d.version AS current_version, l.version AS latest_version,
      coalesce({_MAJ.format(v='l.version')} > {_MAJ.format(v='d.version')}, false) AS is_major_bump FROM {source} d JOIN latest l ON l.ecosystem = d.ecosystem AND l.name = d.name
      WHERE d.version IS NOT NULL AND d.ecosystem = 'PyPI' AND l.version <> d.version)"""


_SINCE = lambda cap: f"""c AS (SELECT *, split_part(message, chr(10), 1) AS msg, row_number() OVER (PARTITION BY repo ORDER BY ord) AS rn FROM ({A.duck(COMMITS)}) x),
  tg AS (SELECT * FROM ({A.duck(TAGS)}) x WHERE regexp_matches(name, {q(fixed.SEMVER_TAG)}) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY ord) = 1),
  page AS (SELECT * FROM c {cap}), cut AS (SELECT p.repo, min(p.ord) AS cut FROM page p JOIN tg ON tg.repo = p.repo AND (starts_with(p.sha, substr(tg.sha, 1, 12)) OR starts_with(tg.sha, substr(p.sha, 1, 12))) GROUP BY p.repo),
  since AS (SELECT p.* FROM page p LEFT JOIN cut ON cut.repo = p.repo WHERE cut IS NULL OR p.ord < cut.cut)"""
_PHRASES = ", ".join(f"({q(s)}, {i}, {q(p)})" for i, s in enumerate(fixed.SKILLS) for p in fixed.SKILL_PHRASES[s])
_TOK = "list_distinct(list_filter(regexp_split_to_array({x}, '[\\s\\-_]+'), lambda t: t <> ''))"
_ALIAS = " ".join(f"WHEN {q(a)} THEN {q(s)}" for a, s in fixed.SKILL_ALIASES.items())
_VALID = ", ".join(q(s) for s in fixed.SKILLS)
_CLEAN = lambda c: f"list_filter(list_transform(string_split({c}, ','), lambda x: lower(trim(x))), lambda x: x IN ({_VALID}))"
_UNIQ = lambda c: f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"
_SEC = lambda n, title: f"CASE WHEN count(*) FILTER (WHERE sec = {n}) > 0 THEN '{title}' || chr(10) || string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE sec = {n}) || chr(10) END"

_LINES = f"""WITH {_SINCE('')}, ls AS (SELECT repo, ord, CASE WHEN regexp_matches(msg, {q('(?i)' + fixed.FEATURE_COMMIT)}) THEN 1 WHEN regexp_matches(msg, {q('(?i)' + fixed.FIX_COMMIT)}) THEN 2 ELSE 3 END AS section,
  '- ' || msg || ' (' || substr(sha, 1, 7) || ') @' || author AS line FROM since)"""

ORACLE = {
    "secret_findings": f"WITH {_FINDINGS} SELECT * FROM found",
    "secret_summary": f"""WITH {_FINDINGS} SELECT f.repo, count(DISTINCT f.path) AS files_scanned, coalesce(any_value(c.n_critical), 0) AS n_critical, coalesce(any_value(c.n_high), 0) AS n_high, coalesce(any_value(c.n_medium), 0) AS n_medium, 0 AS n_low,
      coalesce(any_value(c.findings), 0) AS findings, CASE WHEN coalesce(any_value(c.findings), 0) > 0 THEN 'findings' ELSE 'clean' END AS status, 'secret_detection' AS scan_types FROM fl f LEFT JOIN (
        SELECT repo, count(*) AS findings, count(*) FILTER (WHERE severity = 'critical') AS n_critical, count(*) FILTER (WHERE severity = 'high') AS n_high, count(*) FILTER (WHERE severity = 'medium') AS n_medium FROM found GROUP BY repo) c ON c.repo = f.repo GROUP BY f.repo""",
    "scannable_files": f"""SELECT repo, path, doc_id FROM ({A.duck(TREE)}) t WHERE size <= 1000000 AND path NOT IN ('.git/config', 'x/node_modules/y/z.js', 'img/logo.PNG', 'poetry.lock', 'lib/build/out.txt')""",
    "repo_language": f"""SELECT repo, bool_or(path = 'pyproject.toml') AS has_pyproject, bool_or(path = 'requirements.txt') AS has_requirements_txt, bool_or(path = 'package.json') AS has_package_json, bool_or(path = 'package-lock.json') AS has_package_lock,
      bool_or(path = 'Makefile') AS has_makefile, CASE WHEN bool_or(path IN ('pyproject.toml', 'requirements.txt', 'setup.py')) THEN 'python' WHEN bool_or(path = 'package.json') THEN 'javascript' ELSE 'unknown' END AS language FROM ({A.duck(ROOT_FILES)}) f GROUP BY repo""",
    "manifest_deps": f"""WITH m AS ({A.duck(MANIFEST)}), l AS (SELECT repo, trim(unnest(string_split(content, chr(10)))) AS line FROM m WHERE path = 'requirements.txt'),
      c AS (SELECT repo, trim(split_part(line, '#', 1)) AS line FROM l WHERE line <> '' AND NOT regexp_matches(line, '^(#|-|git\\+)'))
      SELECT repo, 'PyPI' AS ecosystem, CASE WHEN regexp_matches(line, {q(fixed.REQUIREMENT)}) THEN regexp_extract(line, {q(fixed.REQUIREMENT)}, 1) ELSE regexp_extract(line, {q(fixed.BARE_REQUIREMENT)}, 1) END AS name,
        CASE WHEN regexp_matches(line, {q(fixed.REQUIREMENT)}) THEN split_part(regexp_extract(line, {q(fixed.REQUIREMENT)}, 2), ',', 1) ELSE '' END AS version, 'requirements' AS source FROM c
      UNION ALL SELECT repo, 'npm', substr(k, 14), json_extract_string(content, '$.packages."' || k || '".version'), 'package-lock' FROM (SELECT repo, content, unnest(json_keys(content, '$.packages')) AS k FROM m WHERE path = 'package-lock.json') x
        WHERE regexp_matches(k, '^node_modules/[^/]+$') AND json_extract_string(content, '$.packages."' || k || '".version') IS NOT NULL
      UNION ALL SELECT 'repo_' || doc_id, 'PyPI', n, v, 'pyproject' FROM (SELECT doc_id, unnest(['httpx', 'rich', 'attrs']) AS n, unnest(['0.' || (doc_id % 9), '', '23.' || (doc_id % 4)]) AS v FROM documents WHERE doc_id % 3 = 2) p""",
    "manifest_deps_all": """SELECT 'repo_' || doc_id AS repo, 'PyPI' AS ecosystem, n AS name, v AS version, 'pyproject' AS source, pos
      FROM (SELECT doc_id, unnest(['httpx', 'rich', 'attrs']) AS n, unnest(['0.' || (doc_id % 9), '', '23.' || (doc_id % 4)]) AS v, unnest([0, 1, 2]) AS pos FROM documents WHERE doc_id % 3 = 2) p""",
    "merged_deps": f"WITH {_MERGED} SELECT repo, ecosystem, name, coalesce(version, '') AS version, source, pos FROM merged",
    "dependency_audit": f"WITH {_DEPS}, {_audited('deps')} SELECT ecosystem, name, version, advisory_id, cve_id, severity, summary, fixed_version, reference_url, count(*) AS uses FROM audited GROUP BY ALL",
    "outdated_deps": f"WITH {_DEPS}, {_old('deps')} SELECT * FROM old",
    "audit_summary": f"""WITH {_MERGED}, {_audited('merged')}, {_old('merged')} SELECT t.*, coalesce(vulnerabilities, 0) AS vulnerabilities, coalesce(critical_count, 0) AS critical_count, coalesce(high_count, 0) AS high_count, coalesce(medium_count, 0) AS medium_count,
        coalesce(outdated, 0) AS outdated, CASE WHEN coalesce(critical_count, 0) + coalesce(high_count, 0) > 0 THEN 'vulnerabilities_found' WHEN coalesce(medium_count, 0) > 0 OR coalesce(outdated, 0) > 0 THEN 'warnings' ELSE 'clean' END AS status, '' AS note
      FROM (SELECT repo, count(*) AS total_dependencies, string_agg(DISTINCT ecosystem, ',' ORDER BY ecosystem) AS ecosystems FROM merged GROUP BY repo) t
      LEFT JOIN (SELECT repo, count(*) AS vulnerabilities, count(*) FILTER (WHERE severity = 'critical') AS critical_count, count(*) FILTER (WHERE severity = 'high') AS high_count, count(*) FILTER (WHERE severity = 'medium') AS medium_count FROM audited GROUP BY repo) v ON v.repo = t.repo
      LEFT JOIN (SELECT repo, count(*) AS outdated FROM old GROUP BY repo) o ON o.repo = t.repo""".replace("SELECT t.*,", "SELECT t.repo, t.total_dependencies, t.ecosystems,"),
    "commits_since_tag": f"WITH {_SINCE('')} SELECT repo, ord, sha, msg AS message FROM since",
    "all_commits_since_tag": f"WITH {_SINCE('')} SELECT repo, count(*) AS commits FROM since GROUP BY repo",
    "release_notes": f"""WITH {_SINCE('')}, ls AS (SELECT repo, ord, msg, CASE WHEN regexp_matches(msg, {q('(?i)' + fixed.FEATURE_COMMIT)}) THEN 1 WHEN regexp_matches(msg, {q('(?i)' + fixed.FIX_COMMIT)}) THEN 2 ELSE 3 END AS sec,
        '- ' || msg || ' (' || substr(sha, 1, 7) || ') @' || author AS line FROM since),
      ag AS (SELECT repo, count(*) AS n, CASE WHEN bool_or(regexp_matches(msg, {q('(?i)' + fixed.BREAKING_COMMIT)})) THEN 'major' WHEN bool_or(sec = 1) THEN 'minor' ELSE 'patch' END AS bump,
        concat_ws(chr(10), {_SEC(1, '### ✨ Features')}, {_SEC(2, '### 🐛 Bug Fixes')}, {_SEC(3, '### 🔧 Other Changes')}) AS secs FROM ls GROUP BY repo),
      r AS (SELECT DISTINCT repo FROM c), j AS (SELECT r.repo, tg.name AS tag, coalesce(n, 0) AS n, coalesce(bump, 'patch') AS bump, secs, string_split(regexp_replace(coalesce(tg.name, ''), '^v', ''), '.') AS p FROM r LEFT JOIN tg ON tg.repo = r.repo LEFT JOIN ag ON ag.repo = r.repo),
      k AS (SELECT *, CASE WHEN tag IS NULL THEN CASE bump WHEN 'major' THEN 'v1.0.0' WHEN 'minor' THEN 'v0.1.0' ELSE 'v0.0.1' END WHEN bump = 'major' THEN 'v' || (p[1]::INT + 1) || '.0.0'
        WHEN bump = 'minor' THEN 'v' || p[1] || '.' || (p[2]::INT + 1) || '.0' ELSE 'v' || p[1] || '.' || p[2] || '.' || (p[3]::INT + 1) END AS nxt FROM j)
      SELECT repo, coalesce(tag, '') AS current_version, n AS commits_since_tag, CASE WHEN n = 0 AND tag IS NOT NULL THEN 'skipped' ELSE 'preview' END AS status, CASE WHEN n = 0 AND tag IS NOT NULL THEN 'none' ELSE bump END AS version_bump,
        CASE WHEN n = 0 AND tag IS NOT NULL THEN tag ELSE nxt END AS next_version, CASE WHEN n = 0 AND tag IS NOT NULL THEN 'No new commits since last release.'
          ELSE concat_ws(chr(10), '## ' || nxt || ' — What''s Changed (' || CASE WHEN tag IS NULL THEN 'initial release' ELSE 'since ' || tag END || ')' || chr(10), secs, CASE WHEN n = 0 THEN '_No changes detected._' END) END AS changelog FROM k""",
    "changelog_lines": _LINES + " SELECT repo, ord, section, line FROM ls",
    "changelog_parts": _LINES + """, p AS (SELECT *, (sum(length(line) + 1) OVER (PARTITION BY repo, section ORDER BY ord) - length(line) - 1)::BIGINT // 200 AS part FROM ls)
      SELECT repo, section, part, string_agg(line, chr(10) ORDER BY ord) AS text FROM p GROUP BY repo, section, part""",
    "skill_matches": f"""WITH r AS (SELECT id, lower(trim(raw)) AS t FROM ({A.duck(REQUESTS)}) x), ph(skill, so, phrase) AS (VALUES {_PHRASES}),
      u AS (SELECT DISTINCT t FROM r), s AS (SELECT t, skill, so, max(greatest(len(list_intersect({_TOK.format(x='t')}, {_TOK.format(x='phrase')})) / len({_TOK.format(x='phrase')}), CASE WHEN contains(t, phrase) THEN 0.8::DOUBLE ELSE 0 END)) AS score FROM u, ph GROUP BY t, skill, so),
      b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY t ORDER BY score DESC, so) = 1)
      SELECT r.id, CASE WHEN al <> '' THEN al WHEN score >= 0.35 THEN skill ELSE '' END AS skill, round(CASE WHEN al <> '' THEN 1.0::DOUBLE WHEN score >= 0.35 THEN least(score, 0.9::DOUBLE) ELSE 0 END, 6) AS confidence
      FROM (SELECT *, CASE t {_ALIAS} ELSE '' END AS al FROM r) r JOIN b ON b.t = r.t""",
    "sanitised_plans": f"""WITH p AS (SELECT id, trim(query) AS qq, {_CLEAN('plan')} AS pl, {_CLEAN('include_hint')} AS inc, {_CLEAN('exclude_hint')} AS exc, greatest(max_skills, 1) AS mx FROM ({A.duck(PLANS)}) x),
      g AS (SELECT *, list_contains(inc, 'build-and-release') OR {' OR '.join(f"contains(lower(qq), {q(t)})" for t in fixed.RELEASE_TRIGGERS)} AS rel FROM p),
      h AS (SELECT *, list_filter({_UNIQ('pl')}, lambda x: NOT list_contains(exc, x) AND (rel OR x <> 'build-and-release'))[1:mx] AS prop, list_filter({_UNIQ('inc')}, lambda x: NOT list_contains(exc, x) AND (rel OR x <> 'build-and-release'))[1:mx] AS hint,
        list_filter(['dependency-audit', 'security-scan'], lambda x: NOT list_contains(exc, x))[1:mx] AS def, list_filter(['lint-and-test', 'build-and-release'], lambda x: NOT list_contains(exc, x) AND (rel OR x <> 'build-and-release'))[1:1] AS surv FROM g)
      SELECT id, array_to_string(CASE WHEN qq = '' THEN CASE WHEN len(hint) > 0 THEN hint WHEN len(def) > 0 THEN def ELSE surv END ELSE CASE WHEN len(prop) > 0 THEN prop ELSE def END END, ',') AS plan FROM h""",
    "run_signals": f"""SELECT 'u' || user_id AS trace_id, (sum(CASE WHEN event_type = 'click' THEN CASE WHEN user_id % 5 = 0 THEN 2 ELSE user_id % 5 END ELSE 0 END))::BIGINT AS total_lint_issues, 2 * count(*) FILTER (WHERE event_type = 'click') AS total_test_failures,
      3 * count(*) FILTER (WHERE event_type = 'view') AS total_cves, count(*) FILTER (WHERE event_type = 'view') AS total_outdated, count(*) FILTER (WHERE event_type = 'signup') AS total_secrets, 2 * count(*) FILTER (WHERE event_type = 'signup') AS total_sast FROM events GROUP BY user_id""",
    "repo_keys": f"""SELECT id, regexp_replace(repo_url, 'https://[^@]+@github\\.com', 'https://***@github.com') AS repo_url, regexp_extract(repo_url, {q('(?i)' + fixed.REPO_URL)}, 1) AS owner, regexp_extract(repo_url, {q('(?i)' + fixed.REPO_URL)}, 2) AS repo_name FROM ({A.duck(URLS)}) u""",
    "result_reuse": f"""WITH RECURSIVE r AS (SELECT *, 'cicd:v1:' || repo || ':main:' || skill || ':' || substr(sha, 1, 12) || ':' || dry_run AS k FROM ({A.duck(REUSE)}) x),
      ex(k, ts) AS (SELECT k, min(ts) FROM r GROUP BY k UNION ALL SELECT e.k, n.ts FROM ex e JOIN LATERAL (SELECT min(r.ts) AS ts FROM r WHERE r.k = e.k AND r.ts >= e.ts + INTERVAL 43200 SECOND) n ON n.ts IS NOT NULL),
      f AS (SELECT r.k, r.ts, min(id) AS id FROM r JOIN ex ON ex.k = r.k AND ex.ts = r.ts GROUP BY r.k, r.ts)
      SELECT r.id, r.k AS cache_key, f.id IS NULL AS cache_hit FROM r LEFT JOIN f ON f.id = r.id""",
    "breaker_timeline": f"""WITH e AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w AS wins, lag(ts) OVER w AS pts FROM ({A.duck(BREAKER)}) b WINDOW w AS (PARTITION BY service ORDER BY ts, event_id)),
      f AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY service, wins ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM e),
      g AS (SELECT *, CASE WHEN failures >= 5 THEN 'open' ELSE 'closed' END AS state_after FROM f), h AS (SELECT *, lag(state_after) OVER (PARTITION BY service ORDER BY ts, event_id) AS prev FROM g)
      SELECT service, event_id, CASE WHEN prev IS NULL OR prev = 'closed' THEN 'closed' WHEN epoch_us(ts) - epoch_us(pts) > 60000000 THEN 'half_open' ELSE 'open' END AS state_before, state_after, failures::BIGINT AS failures FROM h""",
    "tool_findings": f"""WITH r AS (SELECT 'u' || user_id AS repo, event_id % 5 AS t, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
      f AS (SELECT repo, 'ruff' AS tool, 'error' AS severity, 1 AS line FROM r WHERE t = 0 UNION ALL SELECT repo, 'ruff', 'warning', k FROM r WHERE t = 0 UNION ALL SELECT repo, 'eslint', 'error', 3 FROM r WHERE t = 1
        UNION ALL SELECT repo, 'eslint', 'warning', k FROM r WHERE t = 1 UNION ALL SELECT repo, 'bandit', 'high', k FROM r WHERE t = 2 UNION ALL SELECT repo, 'jest', 'failed', 0 FROM r WHERE t = 3 UNION ALL SELECT repo, 'pytest', 'failed', 0 FROM r WHERE t = 4)
      SELECT repo, tool, severity, count(*) AS findings, sum(line)::BIGINT AS lines FROM f GROUP BY ALL""",
    "tool_test_counts": f"""SELECT 'u' || user_id AS repo, CASE event_id % 5 WHEN 3 THEN 'jest' ELSE 'pytest' END AS tool, CASE event_id % 5 WHEN 3 THEN 2 ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) END AS passed, 1 AS failed,
      CASE event_id % 5 WHEN 3 THEN 0 ELSE 2 END AS skipped, 0 AS errors, CASE event_id % 5 WHEN 3 THEN 3 ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) + 3 END AS total FROM events WHERE event_id % 5 >= 3""",
    "quality_summary": f"""WITH l AS (SELECT DISTINCT 'u' || user_id AS repo, user_id % 3 AS lang FROM events), r AS (SELECT 'u' || user_id AS repo, event_id % 5 AS t, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
      a AS (SELECT repo, 2 * count(*) FILTER (WHERE t = 0) AS ruff, 2 * count(*) FILTER (WHERE t = 1) AS es, count(*) FILTER (WHERE t = 1) AS es_err, count(*) FILTER (WHERE t >= 3) AS failed,
        coalesce(sum(CASE WHEN t = 3 THEN 3 WHEN t = 4 THEN k + 3 END), 0)::BIGINT AS total FROM r GROUP BY repo),
      b AS (SELECT a.*, lang, CASE lang WHEN 0 THEN ruff = 0 WHEN 1 THEN es_err = 0 ELSE true END AS lp, CASE WHEN lang < 2 THEN failed = 0 ELSE true END AS tp FROM a JOIN l ON l.repo = a.repo)
      SELECT repo, CASE lang WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' ELSE 'unknown' END AS language, lp AS lint_passed, CASE lang WHEN 0 THEN ruff WHEN 1 THEN es ELSE 0 END AS lint_issue_count, tp AS test_passed, total AS test_total, failed AS test_failed,
        CASE WHEN lang = 2 THEN 'partial' WHEN lp AND tp THEN 'success' WHEN lang = 1 OR lp OR tp THEN 'partial' ELSE 'failed' END AS status FROM b""",
}
