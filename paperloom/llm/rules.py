"""Quality rules by weak supervision, in DataFrame expressions only.

Rules vote for good (+1), for bad (-1), or abstain (0) on a document's measures. Expectation-maximisation
over the table of vote patterns estimates the accuracy of every rule and the share of good documents;
the posterior probability of good replaces the demand that all rules pass. The pattern table has at most
3 ** len(RULES) rows, whatever the corpus, so it is folded in one row and joined back as a broadcast.

Model (two accuracies per rule): where rule j votes, it votes good on a good document with probability
g_j and bad on a bad one with probability b_j, independent of the others given the quality. An abstention
says nothing. E-step: log odds = logit(prior) + sum over good votes of log(g_j / (1 - b_j)) + sum over bad
votes of log((1 - g_j) / b_j). M-step: the posterior-weighted shares, smoothed by SMOOTH pseudo-votes at
the starting accuracies and kept within limits that forbid reading a rule against its sense (a rule sees
one kind of junk, so b_j may be small, but a good document seldom draws a bad vote).

Null and empty texts have no words and all measures 0; they fail the base test. Very long texts are
measured whole. Repeated rows are judged alike; empty tables give empty results. The input row is carried
as one struct, so its column names are free.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import SPACE, words

MIN_WORDS = 50
REPEAT_PERCENT = 50
KEEP_FROM = 0.5
ROUNDS = 12
PRIOR, START_GOOD, START_BAD, SMOOTH = 0.8, 0.995, 0.3, 10.0
GOOD_LIMITS, BAD_LIMITS, PRIOR_LIMITS = (0.9, 0.9999), (0.02, 0.98), (0.01, 0.99)

#: name, measure as an exact fraction (numerator, denominator), good up to, bad from (in thousandths).
RULES = (
    ("symbols", "n_symbols", "n_words", 20, 100),
    ("symbols per character", "n_symbols", "word_chars", 5, 40),
    ("repeated lines", "n_dup_lines", "n_lines", 100, 550),
    ("repeated words", "n_repeat_words", "n_words", 100, 300),
    ("capitals", "n_capitals", "word_chars", 200, 400),
    ("outcries", "n_outcries", "n_words", 30, 200),
    ("bars", "n_bars", "n_words", 30, 200),
    ("long words", "word_chars", "n_words", 10_000, 14_000),
)
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_outcries", "n_bars"]


def _covered(pairs: Column) -> Column:
    """Words in 3-word windows found at least twice, each word once. `pairs`: (64-bit digest, position) of
    every window, sorted, so that equal digests are neighbours."""

    def twice(p: Column, k: Column) -> Column:
        return (F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"])

    hit = F.filter(pairs, lambda p, k: F.coalesce(twice(p, k), F.lit(False)))
    at = F.transform(hit, lambda p: p["i"])
    return F.size(F.array_distinct(F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2)))).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`row` (the input row) and the measures, all long."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), whole.alias("t"))
    split = rows.withColumn("w", words(F.col("t"))).withColumn(
        "lines", F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    spans = F.when(F.size("w") < 3, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size("w") - 3))
    split = split.withColumn("h", F.transform(spans, lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    # Most texts repeat no window; only the others are sorted.
    split = split.withColumn("pairs", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(
        F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    long = lambda c: c.cast("long")
    # The measures leave through a generator of one row: a filter on them, moved below it, would be worked
    # out from the text again, word by word.
    measures = F.struct(
        long(F.size("w")).alias("n_words"), long(F.length(F.regexp_replace("t", SPACE, ""))).alias("word_chars"),
        long(F.regexp_count("t", F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), _covered(F.col("pairs")).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"), long(F.regexp_count("t", F.lit("[A-ZÀ-ÖØ-Þ]"))).alias("n_capitals"),
        long(F.regexp_count("t", F.lit("!!"))).alias("n_outcries"), long(F.regexp_count("t", F.lit("[|]"))).alias("n_bars"))
    return split.select("row", F.explode(F.array(measures)).alias("m")).select("row", "m.*")


def base_failed(min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def _vote(top: str, bottom: str, good: int, bad: int) -> str:
    """In whole numbers, so that engines agree."""
    return (f"CASE WHEN {bottom} = 0 THEN 0 WHEN 1000 * {top} >= {bad} * {bottom} THEN -1 "
            f"WHEN 1000 * {top} <= {good} * {bottom} THEN 1 ELSE 0 END")


def votes() -> Column:
    return F.array(*[F.expr(_vote(*rule[1:])) for rule in RULES])


def pattern_code() -> str:
    """The votes as one number in base 3."""
    return " + ".join(f"{3 ** j} * (1 + {_vote(*rule[1:])})" for j, rule in enumerate(RULES))


def _within(x: Column, limits: tuple[float, float]) -> Column:
    return F.greatest(F.lit(limits[0]), F.least(F.lit(limits[1]), x))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """`code`, `posterior` per pattern. `patterns` has code, votes, n; at most 3 ** len(RULES) rows.

    All rounds are one fold over the collected pattern table."""
    m = len(RULES)
    table = patterns.groupBy().agg(F.array_sort(F.collect_list(F.struct("code", "votes", F.col("n").cast("double").alias("n")))).alias("p"))

    def posterior(state: Column, v: Column) -> Column:
        # `say` holds, per rule, what a good and what a bad vote add to the log odds.
        odds = F.aggregate(F.zip_with(v, state["say"], lambda x, s: F.when(x > 0, s["good"]).when(x < 0, s["bad"]).otherwise(0.0)),
                           F.log(state["prior"] / (1 - state["prior"])), lambda a, x: a + x)
        return 1 / (1 + F.exp(-odds))

    def said(good: Column, bad: Column) -> Column:
        return F.struct(F.log(good / (1 - bad)).alias("good"), F.log((1 - good) / bad).alias("bad"))

    def again(state: Column, _: Column) -> Column:
        weighed = F.transform(F.col("p"), lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), (x["n"] * posterior(state, x["votes"])).alias("g")))
        zero = F.struct(F.array(*[F.struct(*[F.lit(0.0).alias(c) for c in "abcd"])] * m).alias("rules"), F.lit(0.0).alias("g"), F.lit(0.0).alias("n"))
        # Per rule: a good votes and b all votes on good documents, c bad votes and d all votes on bad ones.
        sums = F.aggregate(weighed, zero, lambda s, x: F.struct(
            F.zip_with(s["rules"], x["votes"], lambda r, v: F.struct(
                (r["a"] + F.when(v > 0, x["g"]).otherwise(0.0)).alias("a"), (r["b"] + F.when(v != 0, x["g"]).otherwise(0.0)).alias("b"),
                (r["c"] + F.when(v < 0, x["n"] - x["g"]).otherwise(0.0)).alias("c"), (r["d"] + F.when(v != 0, x["n"] - x["g"]).otherwise(0.0)).alias("d"))).alias("rules"),
            (s["g"] + x["g"]).alias("g"), (s["n"] + x["n"]).alias("n")), lambda s: F.struct(
            _within((s["g"] + SMOOTH * PRIOR) / (s["n"] + SMOOTH), PRIOR_LIMITS).alias("prior"),
            F.transform(s["rules"], lambda r: said(_within((r["a"] + SMOOTH * START_GOOD) / (r["b"] + SMOOTH), GOOD_LIMITS),
                                                   _within((r["c"] + SMOOTH * START_BAD) / (r["d"] + SMOOTH), BAD_LIMITS))).alias("say")))
        return sums

    start = F.struct(F.lit(PRIOR).alias("prior"), F.array(*[said(F.lit(START_GOOD), F.lit(START_BAD))] * m).alias("say"))
    fitted = table.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, again))
    return fitted.select(F.explode("p").alias("x"), "state").select("x.code", posterior(F.col("state"), F.col("x.votes")).alias("posterior"))


def judge(docs: DataFrame, text: str = "text", keep_from: float = KEEP_FROM, rounds: int = ROUNDS, table: DataFrame | None = None) -> DataFrame:
    """Per document `row`, the measures, `base_failed`, `posterior` and `kept`.

    `table`: the measures, where the caller has them already."""
    rows = (measured(docs, text) if table is None else table).withColumn("code", F.expr(pattern_code())).withColumn("votes", votes())
    patterns = rows.groupBy("code", "votes").agg(F.count(F.lit(1)).alias("n"))
    posterior = F.broadcast(estimate(patterns, rounds))  # at most 3 ** len(RULES) rows
    return rows.join(posterior, "code").withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.round("posterior", 9) >= keep_from)).drop("code", "votes")


def oracle(keep_from: float = KEEP_FROM, rounds: int = ROUNDS) -> str:
    """The same for DuckDB: windows compared as texts, the rounds written out one after the other."""
    w = "[^ \\x09-\\x0D]"
    m = range(len(RULES))
    lo = lambda s: f"ln({s}.prior / (1 - {s}.prior))" + "".join(
        f" + CASE WHEN v{j} > 0 THEN ln({s}.g{j} / (1 - {s}.b{j})) WHEN v{j} < 0 THEN ln((1 - {s}.g{j}) / {s}.b{j}) ELSE 0 END" for j in m)
    share = lambda top, bottom, start, limits: f"greatest({limits[0]}, least({limits[1]}, (sum({top}) + {SMOOTH * start}) / (sum({bottom}) + {SMOOTH})))"
    v = ", ".join(f"{_vote(*rule[1:])} AS v{j}" for j, rule in enumerate(RULES))
    steps = [f"s0 AS MATERIALIZED (SELECT CAST({PRIOR} AS DOUBLE) AS prior, " + ", ".join(
        f"CAST({START_GOOD} AS DOUBLE) AS g{j}, CAST({START_BAD} AS DOUBLE) AS b{j}" for j in m) + ")"]
    for i in range(rounds):
        acc = ", ".join(share(f"CASE WHEN v{j} > 0 THEN g ELSE 0 END", f"CASE WHEN v{j} <> 0 THEN g ELSE 0 END", START_GOOD, GOOD_LIMITS) + f" AS g{j}, "
                        + share(f"CASE WHEN v{j} < 0 THEN n - g ELSE 0 END", f"CASE WHEN v{j} <> 0 THEN n - g ELSE 0 END", START_BAD, BAD_LIMITS) + f" AS b{j}" for j in m)
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT {share('g', 'n', PRIOR, PRIOR_LIMITS)} AS prior, {acc} "
                     f"FROM (SELECT pat.*, n / (1 + exp(-({lo(f's{i}')}))) AS g FROM pat, s{i}))")
    return f"""
WITH src AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
toks AS (SELECT r, regexp_extract_all(t, '{w}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{w}')) AS l FROM src),
wins AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM toks)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM wins) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (SELECT src.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[ \\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(regexp_extract_all(t, '[A-ZÀ-ÖØ-Þ]')) AS BIGINT) AS n_capitals, CAST(len(regexp_extract_all(t, '!!')) AS BIGINT) AS n_outcries,
  CAST(len(regexp_extract_all(t, '[|]')) AS BIGINT) AS n_bars
  FROM src JOIN toks USING (r) LEFT JOIN covered USING (r)),
voted AS (SELECT *, {v} FROM m),
pat AS MATERIALIZED (SELECT {', '.join(f'v{j}' for j in range(len(RULES)))}, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY ALL),
{', '.join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(posterior, 6) AS posterior,
  NOT base_failed AND round(posterior, 9) >= {keep_from} AS kept
FROM (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AS base_failed,
  1 / (1 + exp(-({lo(f's{rounds}')}))) AS posterior FROM voted, s{rounds})
"""
