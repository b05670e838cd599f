"""Mix documents of overlapping sources to target weights by minimum-cost flow.

Documents are first summed by membership pattern (the set of sources a document belongs to). Words flow
from a pattern to its sources' quotas; the k-th copy of a pattern's words costs k - 1, so repetition is
spread as evenly as the quotas allow. The flow fixes how many words each pattern gives. Within a pattern
every document is taken the whole number of times the flow covers the pattern; one more copy goes to the
documents first in a seeded order, up to the document that crosses the rest (taken if at least half of
it fits). Only pattern sums and one threshold per pattern leave the rows, so nothing is sorted per source
and the text is never shuffled, but for rows that share the threshold's place and size.

Targets: sources in code point order, null last, weigh `weights` in turn and share `share` times all
words; a target stops at `repeats` times its source's size and the excess goes to the others by weight.

Null text counts 0 words. A null or missing source is a source of its own. Documents of size 0 are taken
as often as their place in the order says and add nothing. Documents without an identifier are ordered by
a digest of their text. Equal identifiers share their place; of those, smaller documents come first, and of rows
that are equal in both any are taken, as many as the rest holds. Empty tables give empty results. The
input row is carried as one struct, so its column names are free.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import n_words
from paperloom.session import cut_lineage, ship_package

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
SEED = "mix"
#: More patterns than this are an error where sources overlap, as the flow is solved in one task. Where every document has
#: one source there is no flow to solve, and no limit.
MAX_PATTERNS = 20_000
_BITS, _BUCKET_BITS = 60, 14


def targets(sizes: dict, weights: Sequence[float], share: float, repeats: int, total: float | None = None) -> dict:
    """Target words per source. `sizes`: source (or None) -> words; `total`: words of all documents, which
    is less than the sum of the sizes where sources overlap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = share * (sum(sizes.values()) if total is None else total), {}, list(order)
    while open_:
        every = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / every > repeats * sizes[s]]
        if not above:
            out.update({s: left * weight[s] / every for s in open_})
            break
        for s in above:
            out[s] = float(repeats * sizes[s])
        left -= sum(out[s] for s in above)
        open_ = [s for s in open_ if s not in out]
    return out


def min_cost_flow(capacity: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], repeats: int) -> list[dict[int, int]]:
    """Words from each pattern to each of its sources: as much of the quotas as can be met, at the least
    sum of repetition costs (0 for first copies, 1 for second ones, ...).

    Costs depend on the copy alone, so the copies are opened level by level and each level is filled with
    augmenting paths through the residual graph pattern -> source -> pattern.
    """
    flow: list[dict[int, int]] = [dict.fromkeys(m, 0) for m in members]
    into: list[set[int]] = [set() for _ in quotas]
    room = list(quotas)
    for _ in range(repeats):
        spare = list(capacity)
        for start in range(len(members)):
            while spare[start] > 0:
                came: dict[tuple[str, int], tuple[str, int] | None] = {("p", start): None}
                queue, end = [("p", start)], None
                for kind, at in queue:
                    if kind == "p":
                        for s in members[at]:
                            if ("s", s) not in came:
                                came["s", s] = (kind, at)
                                if room[s] > 0:
                                    end = ("s", s)
                                    break
                                queue.append(("s", s))
                    else:
                        for p in into[at]:
                            if flow[p][at] > 0 and ("p", p) not in came:
                                came["p", p] = (kind, at)
                                queue.append(("p", p))
                    if end:
                        break
                if not end:
                    break
                path = [end]
                while came[path[-1]]:
                    path.append(came[path[-1]])
                path.reverse()
                back = [flow[path[i + 1][1]][path[i][1]] for i in range(1, len(path) - 1, 2)]
                words = min(spare[start], room[end[1]], *back)
                for i in range(0, len(path) - 1):
                    (kind, at), (_, to) = path[i], path[i + 1]
                    if kind == "p":
                        flow[at][to] += words
                        into[to].add(at)
                    else:
                        flow[to][at] -= words
                spare[start] -= words
                room[end[1]] -= words
    return flow


def _key(sources: Column) -> Column:
    """The membership pattern as text; null sources stay apart from any name."""
    return F.to_json(F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string"))))))


def place(doc_id: Column, text: Column, seed: str) -> Column:
    """The seeded place of a document, a number below 2^60."""
    own = F.coalesce(doc_id.cast("string"), F.md5(text.cast("binary")), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary")), 1, _BITS // 4), 16, 10).cast("long")


def _nearest(words: float) -> int:
    """The nearest whole number, halves up."""
    return math.floor(words + 0.5)


def plan(sized: DataFrame, weights: Sequence[float], share: float, repeats: int) -> DataFrame:
    """Per pattern (`key`): `quota` words, whole `copies`, words of the further copy (`rest`), and per
    source its size and target. `sized` has key, sources, size."""
    ship_package(sized.sparkSession)
    sums = sized.groupBy("key").agg(F.sum("size").alias("size"), F.first("sources").alias("sources"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        capacity = [int(x) for x in rows["size"]]
        sets = [[None if s is None else str(s) for s in x] for x in rows["sources"]]
        apart = all(len(own) == 1 for own in sets)
        if len(rows) > MAX_PATTERNS and not apart:
            raise ValueError(f"{len(rows)} membership patterns of overlapping sources; {MAX_PATTERNS} at most")
        sizes: dict = {}
        for n, own in zip(capacity, sets):
            for s in own:
                sizes[s] = sizes.get(s, 0) + n
        goal = targets(sizes, weights, share, repeats, sum(capacity))
        number = {s: i for i, s in enumerate(goal)}
        if apart:
            flow = [{0: min(_nearest(goal[own[0]]), repeats * n)} for n, own in zip(capacity, sets)]
        else:
            flow = min_cost_flow(capacity, [[number[s] for s in own] for own in sets], [_nearest(goal[s]) for s in goal], repeats)
        out = []
        for key, n, own, f in zip(rows["key"], capacity, sets, flow):
            words = sum(f.values())
            copies = words // n if n else 0
            out.append((key, words, copies, words - copies * n, [sizes[s] for s in own], [goal[s] for s in own]))
        return pd.DataFrame(out, columns=["key", "quota", "copies", "rest", "source_sizes", "targets"])

    return sums.groupBy().applyInPandas(
        solve, "key string, quota long, copies long, rest long, source_sizes array<long>, targets array<double>")


def thresholds(sized: DataFrame, planned: DataFrame, small) -> DataFrame:
    """Per pattern the last (place, size), `upto`, that gets one more copy for all its rows, and the one after it, `split`, of whose
    rows only `some` get one. `sized` has key, size, place; `small` marks tables of one row per pattern."""
    bucket = F.shiftright("place", _BITS - _BUCKET_BITS)
    sums = sized.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
    running = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cuts = sums.withColumn("upper", F.sum("size").over(running)).join(small(planned), "key") \
        .filter((F.col("upper") >= F.col("rest")) & (F.col("upper") - F.col("size") < F.col("rest"))) \
        .select("key", "bucket", (F.col("upper") - F.col("size")).alias("before"), "rest")
    inside = sized.select("key", "size", "place", bucket.alias("bucket")).join(small(cuts), ["key", "bucket"]) \
        .groupBy("key", "bucket", "before", "rest", "place", "size").agg(F.count("*").alias("n"))
    order = Window.partitionBy("key").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(order), F.lit(0))
    # A row is taken if at least half of it fits behind those before it.
    fits = F.when(left < 0, 0).when(F.col("size") == 0, F.col("n")).otherwise(F.least(F.col("n"), F.floor((2 * left + F.col("size")) / (2 * F.col("size")))))
    placed, whole = F.struct("place", "size"), F.col("fits") == F.col("n")
    ends = inside.withColumn("fits", fits).groupBy("key").agg(
        F.max(F.when(whole, placed)).alias("last"), F.max(F.when(~whole & (F.col("fits") > 0), F.struct(placed.alias("at"), "fits"))).alias("split"))
    # Without a row in the bucket itself, everything before it.
    none = F.struct((F.shiftleft("bucket", _BITS - _BUCKET_BITS) - 1).alias("place"), F.lit(2**62).alias("size"))
    return planned.join(small(cuts.select("key", "bucket")), "key", "left").join(small(ends), "key", "left").select(
        planned["*"], F.coalesce("last", F.when(F.col("bucket").isNotNull(), none), F.struct(F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("size"))).alias("upto"),
        F.col("split.at").alias("split"), F.col("split.fits").cast("long").alias("some"))


def mix(docs: DataFrame, sources: Column | None = None, text: str = "text", doc_id: str = "doc_id", weights: Sequence[float] = WEIGHTS,
        share: float = SHARE, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """Per document its `row` (a struct of all input columns, so no name can clash), `size`, `source_sizes` and `targets` (arrays in the order of the sorted
    sources), `copies` and `taken` (copies times size). `sources`: an array column, by default the single
    column `source`."""
    own = sources if sources is not None else F.array(F.col("source").cast("string"))
    # Sizes and places are narrow: written once, they serve the sums and the thresholds.
    sized = cut_lineage(docs.select(_key(own).alias("key"), n_words(F.col(text)).alias("size"), place(F.col(doc_id), F.col(text), seed).alias("place"),
                                    F.array_sort(F.array_distinct(F.coalesce(own, F.array(F.lit(None).cast("string"))))).alias("sources")))
    planned = cut_lineage(plan(sized, weights, share, repeats))
    small = F.broadcast if planned.count() <= MAX_PATTERNS else lambda df: df
    ends = cut_lineage(thresholds(sized, planned, small))
    decided = ends.select(F.col("key").alias("_key"), "source_sizes", "targets", F.col("copies").alias("_whole"), F.col("upto").alias("_upto"), F.col("split").alias("_split"), F.col("some").alias("_some"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), n_words(F.col(text)).alias("size"),
                       place(F.col(doc_id), F.col(text), seed).alias("_place"), _key(own).alias("_key"))
    at = F.struct(F.col("_place").alias("place"), F.col("size").alias("size"))
    rows = rows.join(small(decided), "_key").withColumn("_more", (at <= F.col("_upto")).cast("long")).withColumn("_cut", F.coalesce(at == F.col("_split"), F.lit(False)))
    if not ends.filter("some > 0").isEmpty():
        rows = rows.filter("NOT _cut").unionByName(_split(rows.filter("_cut")))
    copies = F.least(F.col("_whole") + F.col("_more"), F.lit(repeats))
    return rows.withColumn("copies", copies).select("row", "size", "source_sizes", "targets", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _split(rows: DataFrame, parts: int = 64) -> DataFrame:
    """Rows of equal place and size, of which the first `_some` get one more copy. They are dealt to parts, numbered there and after
    the parts before; written first, so that every reading deals them alike."""
    dealt = cut_lineage(rows.withColumn("_part", F.monotonically_increasing_id() % parts))
    counts = dealt.groupBy("_key", "_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_key").orderBy("_part")) - F.col("_n")).drop("_n")
    number = F.row_number().over(Window.partitionBy("_key", "_part").orderBy("_place")) + F.col("_before")
    return dealt.join(before, ["_key", "_part"]).withColumn("_more", (number <= F.col("_some")).cast("long")).drop("_part", "_before")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of `docs`."""
    rows = mix(docs, **options).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
