"""Ordered computations per key that stay parallel when one key holds a large share of the rows.

A plain window puts a key's whole history into one task. Here the history is cut into chunks that
respect the order (an hour of time, a range of values); each chunk is worked on alone and only one
small summary row per (key, chunk) crosses chunks. The chunk must be non-decreasing in the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_chunk(ts: str, seconds: int = 3600) -> Column:
    """The time slot of a timestamp column, as an integer."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))


def _sums_before(totals: DataFrame, keys: list[str], by: str, names: list[str], out: str) -> DataFrame:
    """Per row of `totals` the sums of the key's earlier rows (`_t_x` -> `out` + x)."""
    earlier = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, by, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"{out}{n}") for n in names])


def running_sums(df: DataFrame, keys: list[str], order: list[str], chunk: Column, sums: dict[str, Column], fine: Column | None = None) -> DataFrame:
    """Adds, per output name, the sum of the column over the key's rows up to and including this one.

    `fine` is a second, finer chunk within `chunk` (a second within an hour): rows are then ordered per
    (key, chunk, fine) only, and the sums of finer chunks are carried within their chunk, those of chunks
    within their key. So a key with most of its rows in one chunk is still many tasks.
    """
    names = list(sums)
    df = df.withColumn("_chunk", chunk).withColumn("_fine", fine if fine is not None else F.lit(0))
    for name, value in sums.items():
        df = df.withColumn(f"_v_{name}", value)
    coarse, at = keys + ["_chunk"], keys + ["_chunk", "_fine"]
    totals = df.groupBy(*at).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    offsets = _sums_before(totals.groupBy(*coarse).agg(*[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in names]), keys, "_chunk", names, "_o_")
    inner = _sums_before(totals, coarse, "_fine", names, "_i_")
    offsets = inner.join(offsets, coarse).select(*at, *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(f"_o_{n}") for n in names])
    inside = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in names]).join(offsets, at)
    keep = [c for c in df.columns if c not in ("_chunk", "_fine") and not c.startswith("_v_")]
    return rows.select(*keep, *[
        (F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_o_{n}", F.lit(0))).alias(n) for n in names])


def previous_rows(df: DataFrame, keys: list[str], order: list[str], chunk: Column, cols: list[str], n: int, fine: Column | None = None) -> DataFrame:
    """Adds `previous`: up to n structs of `cols`, the key's rows right before this one, oldest first.
    `fine`: as in `running_sums`."""
    df = df.withColumn("_chunk", chunk).withColumn("_fine", fine if fine is not None else F.lit(0))
    coarse, at = keys + ["_chunk"], keys + ["_chunk", "_fine"]
    inside = Window.partitionBy(*at).orderBy(*order)
    here = F.collect_list(F.struct(*cols)).over(inside.rowsBetween(-n, -1))
    from_end = Window.partitionBy(*at).orderBy(*[F.col(c).desc() for c in order])
    tails = (
        df.withColumn("_back", F.row_number().over(from_end)).filter(F.col("_back") <= n).groupBy(*at)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("k"), F.struct(*cols).alias("v")))),
                         lambda x: x["v"]).alias("_tail")))
    last = lambda c: F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), F.lit(n))
    # The last n rows before a finer chunk: of the finer chunks before it, then of the chunks before its own.
    near = tails.select(*at, F.flatten(F.collect_list("_tail").over(Window.partitionBy(*coarse).orderBy("_fine").rowsBetween(-n, -1))).alias("_near"))
    ranked = tails.withColumn("_back", F.row_number().over(Window.partitionBy(*coarse).orderBy(F.col("_fine").desc()))).filter(F.col("_back") <= n)
    ends = ranked.groupBy(*coarse).agg(last(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_fine", "_tail"))), lambda x: x["_tail"]))).alias("_tail"))
    far = ends.select(*coarse, F.flatten(F.collect_list("_tail").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(-n, -1))).alias("_far"))
    carried = near.join(far, coarse).select(*at, F.concat("_far", "_near").alias("_carry"))
    rows = df.withColumn("_here", here).join(carried, at)
    both = F.concat(F.col("_carry"), F.col("_here"))
    return rows.withColumn("previous", last(both)).drop("_chunk", "_fine", "_here", "_carry")


def value_chunk(value: Column) -> Column:
    """A monotone, scale-free slot of a non-negative number: about 0.02 % wide."""
    return F.floor(F.log1p(value) * 4096)


def pick_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Exact order statistics per key. `ranks`: output name -> 0-based rank in terms of column `n`.

    Counts per distinct value, then per value slot; only the slots that hold a wanted rank are ranked.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")) \
        .withColumn("_slot", value_chunk(F.col(value)))
    slots = counts.groupBy(*keys, "_slot").agg(F.sum("_c").alias("_sc"))
    by_slot = Window.partitionBy(*keys).orderBy("_slot")
    placed = slots.select(
        *keys, "_slot", F.coalesce(F.sum("_sc").over(by_slot.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"),
        "_sc", F.sum("_sc").over(Window.partitionBy(*keys)).alias("n"))
    wanted = placed.select(*keys, "_slot", "_from", "_sc", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()])).alias("w")) \
        .filter((F.col("w.rank") >= F.col("_from")) & (F.col("w.rank") < F.col("_from") + F.col("_sc")))
    inside = Window.partitionBy(*keys, "_slot", "w.name").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    hit = counts.join(wanted, keys + ["_slot"]).withColumn("_upto", F.col("_from") + F.sum("_c").over(inside)) \
        .filter((F.col("w.rank") < F.col("_upto")) & (F.col("w.rank") >= F.col("_upto") - F.col("_c")))
    return hit.groupBy(*keys).agg(*[
        F.max(F.when(F.col("w.name") == name, F.col(value))).alias(name) for name in ranks])
