"""Mergeable summaries: sums, extremes, quantile and distinct-count sketches per time slot and key.

A slot is summarised once; everything above it (days, all keys of a task, the whole history) is merged from the
stored slots, without the rows. Sums and extremes are exact. Quantiles come from KLL sketches, distinct counts from
HyperLogLog sketches; both merge without losing their bounds, which `rank_error` and `distinct_error` state.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a quantile sketch (a rank is off by 0.55 % at most, see `rank_error`) and 2-logarithm of a distinct sketch's registers.
QUANTILE_K, DISTINCT_LOG = 1000, 14


def rank_error(k: int = QUANTILE_K) -> float:
    """By how much the rank of a quantile may be off, as a share of the rows: twice the sketch's error at 99 %."""
    return 2 * 2.296 / k**0.9723


def distinct_error(log: int = DISTINCT_LOG) -> float:
    """By how much a distinct count may be off, as a share of it: four standard errors."""
    return 4 * 1.04 / math.sqrt(2**log)


def _make(kind: str, value: Column, k: int, log: int) -> Column:
    made = {"sum": F.sum, "max": F.max, "min": F.min, "count": lambda c: F.count(c)}
    if kind == "quantiles":
        return F.kll_sketch_agg_double(value.cast("double"), k)
    return F.hll_sketch_agg(value, F.lit(log)) if kind == "distinct" else made[kind](value)


def _merge(kind: str, name: str) -> Column:
    made = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "quantiles": F.kll_merge_agg_double, "distinct": F.hll_union_agg}
    return made[kind](F.col(name))


def summarise(rows: DataFrame, keys: list, measures: dict[str, tuple[str, Column]], k: int = QUANTILE_K, log: int = DISTINCT_LOG) -> DataFrame:
    """One row per key. `measures`: name -> (kind, column); a kind is sum, count, max, min, quantiles or distinct. Null values are
    not in a sketch; a key without any value has a null one. Partial summaries are made before the shuffle."""
    return rows.groupBy(*keys).agg(*[_make(kind, value, k, log).alias(name) for name, (kind, value) in measures.items()])


def merged(summaries: DataFrame, keys: list, kinds: dict[str, str]) -> DataFrame:
    """Summaries of finer keys or slots merged to `keys`. `kinds`: name -> kind, as they were made."""
    return summaries.groupBy(*keys).agg(*[_merge(kind, name).alias(name) for name, kind in kinds.items()])


def time_slot(ts: str, seconds: int = 3600) -> Column:
    """Start of the slot of a time, as a timestamp."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds) * seconds)


def quantile(sketch: Column, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(q))


def distinct(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)
