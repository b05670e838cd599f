"""SQL of the operators' queries for DuckDB."""

from __future__ import annotations

from paperloom.llm import collocations, lm_scoring, mixing, resampling, rules, search, url_filters, warc
from paperloom.llm.queries import CAPTURES, HOST_RULES


def _revisits() -> str:
    captures = CAPTURES.format(map="map", text="VARCHAR", pages="pages")
    tracking = "|".join(warc.TRACKING)
    kept = ", ".join(f"'{h}'" for h in warc.KEPT_HEADERS)
    return f"""
WITH captures AS ({captures}),
split AS (SELECT *, lower(regexp_extract(url, '^([^:/?#]*)://', 1)) AS scheme, regexp_extract(regexp_replace(url, '#.*$', '', 's'), '^[^:/?#]*://(.*)$', 1, 's') AS rest,
  list_transform(map_entries(headers), lambda e: {{'k': lower(e.key), 'v': e.value}}) AS hs FROM captures),
clean AS (SELECT *, CASE scheme WHEN 'http' THEN regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':80$', '') ELSE
    regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':443$', '') END || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/$', '') AS base,
  list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*[?](.*)$', 1, 's'), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^({tracking})(=|$)'))) AS q FROM split),
rec AS (SELECT record_id, captured_at, record_type, hs, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM clean),
ranked AS (SELECT v.record_id, v.url, v.hs AS uh, r.record_id AS response_id, r.hs AS sh, row_number() OVER (PARTITION BY v.record_id ORDER BY r.captured_at DESC NULLS LAST, r.record_id DESC) AS k
  FROM rec v LEFT JOIN rec r ON r.record_type = 'response' AND r.url = v.url AND r.captured_at < v.captured_at WHERE v.record_type = 'revisit'),
near AS (SELECT *, list_filter(uh, lambda x: x.k = 'etag')[1].v AS et, list_filter(sh, lambda x: x.k = 'etag')[1].v AS set_, list_filter(uh, lambda x: x.k = 'last-modified')[1].v AS lm,
  list_filter(sh, lambda x: x.k = 'last-modified')[1].v AS slm FROM ranked WHERE k = 1),
judged AS (SELECT *, coalesce(regexp_replace(et, '^W/', '') = regexp_replace(set_, '^W/', ''), lm = slm) AS same, list_filter(uh, lambda x: x.k NOT IN ({kept})) AS allowed FROM near)
SELECT record_id, url AS canonical_url, CASE WHEN response_id IS NULL THEN 'no_response' WHEN same IS NULL THEN 'no_validator' WHEN same THEN 'resolved' ELSE 'mismatch' END AS outcome, response_id,
  CASE WHEN same THEN array_to_string(list_sort(list_transform(list_concat(list_filter(sh, lambda x: NOT list_contains(list_transform(allowed, lambda y: y.k), x.k)), allowed), lambda x: x.k || ': ' || x.v)), chr(10)) END AS headers
FROM judged
"""


def _url_filters() -> str:
    """Every rule against every URL, by its written meaning rather than an index."""
    rules_ = []
    for r in HOST_RULES:
        host, _, path = r.name.partition("/")
        rules_.append(f"('{r.name}', '{host}', '/{path}', '{r.action}')")
    return f"""
WITH parts AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(.*)$', 1, 's') AS tail FROM parts),
rules(rule, h, p, action) AS (VALUES {', '.join(rules_)}),
hits AS (SELECT n, rule, action, row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC) AS k FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT * FROM hits WHERE k = 1)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN regexp_matches(host || path || tail, '^([^/?#]*[.])?docs[.]') THEN 'allow'
  WHEN regexp_matches(host || path || tail, '/(login|cart|checkout|feed)([^A-Za-z0-9_.%-]|$)|^([^/?#]*[.])?(ads|track)[.]|phpsessid=') THEN 'block' ELSE 'allow' END) AS verdict
FROM split LEFT JOIN best USING (n)
"""


def _mixing(rounds: int = 30) -> str:
    """Targets by one sharing round after the other; selection by a running sum per source."""
    weights = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS)) + " END"
    steps = [f"t0 AS MATERIALIZED (SELECT source, size, {weights} AS w, CAST(NULL AS DOUBLE) AS fixed FROM sums)"]
    for i in range(rounds):
        share = (f"(SELECT {mixing.SHARE} * sum(size) - coalesce(sum(fixed), 0) FROM t{i}) * w / (SELECT sum(w) FROM t{i} WHERE fixed IS NULL)")
        steps.append(f"t{i + 1} AS MATERIALIZED (SELECT source, size, w, CASE WHEN fixed IS NULL AND {share} > {mixing.REPEATS} * size THEN {mixing.REPEATS}.0 * size ELSE fixed END AS fixed FROM t{i})")
    share = f"(SELECT {mixing.SHARE} * sum(size) - coalesce(sum(fixed), 0) FROM t{rounds}) * w / (SELECT sum(w) FROM t{rounds} WHERE fixed IS NULL)"
    return f"""
WITH src AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+')) AS BIGINT) AS size,
  substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 15) AS place FROM documents),
sums AS (SELECT source, sum(size) AS size FROM src GROUP BY source),
{', '.join(steps)},
goals AS (SELECT source, CAST(size AS BIGINT) AS source_size, CAST(coalesce(fixed, {share}) AS DOUBLE) AS target FROM t{rounds}),
placed AS (SELECT src.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS whole,
  CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) % source_size ELSE 0 END AS rest,
  sum(size) OVER (PARTITION BY src.source ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upper FROM src JOIN goals ON src.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, size, source_size, target, CAST(size * least(whole + CASE WHEN upper - size / 2.0 <= rest THEN 1 ELSE 0 END, {mixing.REPEATS}) AS BIGINT) AS taken FROM placed
"""


ORACLE = {
    "op1_lm_scoring": lm_scoring.oracle(),
    "op1_lm_scoring_whole": lm_scoring.oracle(0.0, 0.0),
    "op3_exact_search": search.oracle(),
    "op4_revisit_resolution": _revisits(),
    "op7_quality_rules": rules.oracle(),
    "op8_url_filters": _url_filters(),
    "op10_source_mixing": _mixing(),
    "op11_collocations": collocations.oracle(),
    "op12_importance_resampling": resampling.oracle(),
}
