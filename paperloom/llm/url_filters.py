"""Pattern rules over URLs, found through their rarest literal token.

A rule is a pattern of plain text with `*` (anything), `^` (a separator or the end), a leading `||` (the
start of a host label) and `|` at either end (the start or end of the URL). Its tokens are the runs of
letters and digits that the pattern delimits on both sides, so a URL that fits must hold each of them as
a whole token. Every rule is filed under the one of its tokens that fewest URLs hold. A URL's tokens
fetch the candidate rules; only candidates run their regular expression. Rules without a token are
candidates of every URL.

Tiers: rules of tier 0 decide first, the longest pattern wins (ties: the greater text). Where none fits,
tier 1 decides: `allow` if an allowing rule fits, else `block` if a blocking rule fits, else `allow`.

Null URLs and URLs without `://` have an empty host and path, fit no rule and are allowed. Repeated rows
are judged alike, empty tables give empty results, further columns are kept out of the way: the result
holds the input's columns and the added ones, and an input column named like an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import lower_ascii

TOKEN = "[A-Za-z0-9]+"
#: Above this many rules the index is shuffled instead of broadcast.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    action: str
    tier: int = 1


def host_rule(prefix: str, action: str) -> Rule:
    """A host (and its subdomains) with a path prefix, written together: `example.net/en/`."""
    return Rule(prefix, f"||{prefix}", action, 0)


#: Pages that carry no text of their own. Tier 1: they decide only where no host rule does.
DEFAULT_PATTERNS = (
    Rule("login pages", "/login^", "block"),
    Rule("carts", "/cart^", "block"),
    Rule("checkout", "/checkout^", "block"),
    Rule("advertising hosts", "||ads.", "block"),
    Rule("tracking hosts", "||track.", "block"),
    Rule("feeds", "/feed^", "block"),
    Rule("session links", "phpsessid=", "block"),
    Rule("documentation", "||docs.", "allow"),
)

_REGEX_SIGNS = r"([\\.\[\]{}()+?$&~#/%=,:;!<>@\"' -])"


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and the rest from `?` or `#`; all empty without `://`."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(rest, r"^[^?#]*([\s\S]*)$", 1)
    return host, path, tail


def _regex(pattern: Column) -> Column:
    body = F.regexp_replace(pattern, r"^\|\|?|\|$", "")
    body = F.regexp_replace(body, _REGEX_SIGNS, r"\\$1")
    body = F.regexp_replace(body, r"\^", r"(?:[^A-Za-z0-9_.%-]|\$)")
    body = F.regexp_replace(body, r"\*", r"[\\s\\S]*")
    head = F.when(pattern.startswith("||"), F.lit(r"^(?:[^/?#]*\.)?")).when(pattern.startswith("|"), F.lit("^")).otherwise(F.lit(""))
    tail = F.when(pattern.rlike(r".\|$"), F.lit("$")).otherwise(F.lit(""))
    return F.concat(head, body, tail)


def _tokens(pattern: Column) -> Column:
    """Runs of letters and digits with a delimiter on both sides. An open end counts as `*`."""
    shut = F.concat(F.when(pattern.startswith("|"), F.lit("")).otherwise(F.lit("*")), pattern,
                    F.when(pattern.endswith("|"), F.lit("")).otherwise(F.lit("*")))
    return F.array_distinct(F.regexp_extract_all(shut, F.lit("(?<![A-Za-z0-9*])[A-Za-z0-9]+(?![A-Za-z0-9*])"), F.lit(0)))


def rule_frame(spark, rules: Sequence[Rule]) -> DataFrame:
    rows = [(r.name, r.pattern, r.action, r.tier) for r in rules]
    df = spark.createDataFrame(rows, "rule string, pattern string, action string, tier int")
    return df.select("rule", "action", "tier", F.length("pattern").alias("size"), _regex(F.col("pattern")).alias("regex"),
                     _tokens(F.col("pattern")).alias("tokens"))


def _small(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return F.broadcast(df) if len(rules) <= BROADCAST_RULES else df


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """The rows of `pages` with `host`, `path`, `rule` (of tier 0, else null) and `verdict`."""
    spark = pages.sparkSession
    host, path, tail = split_url(F.col("u"))
    urls = pages.select(F.col(url).alias("u")).filter("u is not null").distinct().select("u", F.concat(host, path, tail).alias("subject"))
    found = urls.select("u", "subject", F.explode(F.array_distinct(F.regexp_extract_all("subject", F.lit(TOKEN), F.lit(0)))).alias("token"))
    table = rule_frame(spark, rules)
    listed = table.select("*", F.explode("tokens").alias("token")).drop("tokens")
    held = found.join(_small(listed.select("token").distinct(), rules), "token").groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    rarest = listed.join(held, "token", "left").groupBy("rule", "action", "tier", "size", "regex").agg(
        F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), F.col("token"))).alias("least"))
    index = rarest.select("rule", "action", "tier", "size", "regex", F.col("least.token").alias("token"))
    without = table.filter(F.size("tokens") == 0).drop("tokens")
    always = without.agg(F.collect_list(F.struct("rule", "action", "tier", "size", "regex")).alias("r"))
    columns = ["u", "subject", "rule", "action", "tier", "size", "regex"]
    candidates = found.join(_small(index, rules), "token").select(*columns)
    if any(not _has_token(r.pattern) for r in rules):
        everywhere = urls.select("u", "subject", F.explode(always.scalar()).alias("x"))
        candidates = candidates.unionByName(everywhere.select("u", "subject", "x.*"))
    fits = candidates.filter(F.expr("subject rlike regex"))
    best = fits.groupBy("u").agg(
        F.max(F.when(F.col("tier") == 0, F.struct("size", "rule", "action"))).alias("first"),
        F.max((F.col("tier") > 0) & (F.col("action") == "allow")).alias("lets"),
        F.max((F.col("tier") > 0) & (F.col("action") == "block")).alias("stops"))
    verdict = F.coalesce(F.col("first.action"), F.when(F.col("lets"), "allow"), F.when(F.col("stops"), "block"), F.lit("allow"))
    added = ["host", "path", "rule", "verdict"]
    kept = [F.col(f"p.`{c}`") for c in pages.columns if c not in added]
    host, path, _ = split_url(F.col(f"p.`{url}`"))
    return pages.alias("p").join(best.alias("b"), F.col(f"p.`{url}`") == F.col("b.u"), "left").select(
        *kept, host.alias("host"), path.alias("path"), F.col("b.first.rule").alias("rule"), verdict.alias("verdict"))


def _has_token(pattern: str) -> bool:
    import re

    shut = ("" if pattern.startswith("|") else "*") + pattern + ("" if pattern.endswith("|") else "*")
    return bool(re.search("(?<![A-Za-z0-9*])[A-Za-z0-9]+(?![A-Za-z0-9*])", shut))
