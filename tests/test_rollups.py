"""Kept tables and mergeable sketches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import sketches as Q
from paperloom.session import finished_parts
from paperloom.streaming.rollups import KeptRollup

T0 = dt.datetime(2024, 1, 1)
KINDS = {"calls": "count", "tokens": "sum", "slowest": "max", "first": "min"}


def summarise(rows):
    of = {"calls": F.col("id"), "tokens": F.col("tokens"), "slowest": F.col("ms"), "first": F.col("ts")}
    return Q.summarise(rows.withColumn("hour", Q.time_slot("ts")), ["hour", "model"], {n: (k, of[n]) for n, k in KINDS.items()})


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    made = [(i, "hot" if i % 3 else f"m{i % 5}", rng.randrange(1000) if i % 11 else None, rng.random() * 100, T0 + dt.timedelta(minutes=i)) for i in range(600)]
    return spark.createDataFrame(made, "id int, model string, tokens int, ms double, ts timestamp").cache()


def table_of(kept):
    return sorted(map(str, kept.read().collect()))


def test_batches_replays_and_compaction(spark, rows, tmp_path):
    kept = KeptRollup(spark, str(tmp_path / "k"), summarise, ["hour", "model"], KINDS, compact_after=3)
    assert kept.read() is None
    for n in range(8):
        part = rows.filter(f"id % 8 = {n}")
        kept.add(part, n)
        before = table_of(kept)
        kept.add(part, n)  # at once again
        if n >= 2:
            kept.add(rows.filter("id % 8 = 1"), 1)  # long in the base: nothing is written
        assert table_of(kept) == before
        held = finished_parts(spark, str(tmp_path / "k/deltas"), "batch"), finished_parts(spark, str(tmp_path / "k/base"), "upto")
        assert len(held[0]) < 3 and len(held[1]) <= 1
    assert table_of(kept) == sorted(map(str, summarise(rows).select("hour", "model", *KINDS).collect()))
    kept.compact()
    kept.compact()
    assert finished_parts(spark, str(tmp_path / "k/base"), "upto") == [7] and table_of(kept) == before


def test_a_crash_leaves_a_readable_table(spark, rows, tmp_path):
    home = tmp_path / "k"
    kept = KeptRollup(spark, str(home), summarise, ["hour", "model"], KINDS, compact_after=100)
    for n in range(3):
        kept.add(rows.filter(f"id % 3 = {n}"), n)
    want = table_of(kept)
    # A base that was not completed, and a delta that was not.
    (home / "base/upto=9").mkdir(parents=True)
    (home / "deltas/batch=3").mkdir()
    assert table_of(kept) == want
    # A complete base whose deltas could not be removed any more.
    kept.read().write.parquet(f"{home}/base/upto=2")
    assert table_of(kept) == want
    kept.add(rows.limit(0), 3)
    kept.compact()
    assert table_of(kept) == want and finished_parts(spark, f"{home}/deltas", "batch") == []


def test_a_stream_in_batches(spark, rows, tmp_path):
    for n in range(5):
        rows.filter(f"id % 5 = {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kept = KeptRollup(spark, str(tmp_path / "k"), summarise, ["hour", "model"], KINDS, compact_after=2)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second start has nothing new
        kept.writer(stream, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        assert table_of(kept) == sorted(map(str, summarise(rows).select("hour", "model", *KINDS).collect()))


def test_sketches_merge_within_their_bounds(spark):
    df = spark.range(60_000).selectExpr("id", "id % 24 AS hour", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'hot' END AS k", "CASE WHEN id % 7 = 0 THEN NULL ELSE pow(hash(id) / 1e9, 3) END AS v", "hash(id % 9000) AS who")
    hourly = Q.summarise(df, ["hour", "k"], {"v": ("quantiles", F.col("v")), "who": ("distinct", F.col("who")), "n": ("count", F.col("v"))})
    for keys in (["k"], []):
        for r in Q.merged(hourly, keys, {"v": "quantiles", "who": "distinct", "n": "count"}).select(
                *keys, "n", Q.distinct(F.col("who")).alias("who"), *[Q.quantile(F.col("v"), q).alias(f"q{int(q * 100)}") for q in (0.01, 0.5, 0.95)]).collect():
            mine = df.filter(F.col("k") == r["k"]) if keys else df
            exact = mine.select(F.countDistinct("who").alias("who"), F.count("v").alias("n"), *[F.avg((F.col("v") <= r[c]).cast("double")).alias(c) for c in ("q1", "q50", "q95")]).first()
            assert r["n"] == exact["n"] and abs(r["who"] - exact["who"]) <= Q.distinct_error() * exact["who"]
            assert all(abs(exact[c] - q) <= Q.rank_error() for c, q in (("q1", 0.01), ("q50", 0.5), ("q95", 0.95)))
    none = Q.summarise(df.filter("v IS NULL"), ["k"], {"v": ("quantiles", F.col("v")), "n": ("count", F.col("v"))})
    assert Q.merged(none, ["k"], {"v": "quantiles", "n": "count"}).filter("n = 0").count() == 2
