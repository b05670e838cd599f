"""Streams give the rows of their batch twins."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from paperloom.operators import ledger as L
from paperloom.operators import skills as K
from paperloom.streaming import live
from paperloom.streaming.running import run_available

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 5}", "task1_cicd", "openai/gpt-5.5", 5000, 100, 1.5, T0 + dt.timedelta(seconds=30 * i), rng.random() < 0.3) for i in range(300)]
    df = spark.createDataFrame(rows, "call_id bigint, trace_id string, task string, model string, tokens_in bigint, tokens_out bigint, latency_ms double, ts timestamp, ok boolean")
    path = str(tmp_path_factory.mktemp("stream"))
    df.write.parquet(path + "/calls.parquet")
    return path


def stream_of(spark, folder):
    batch = spark.read.parquet(folder + "/calls.parquet")
    return batch, spark.readStream.schema(batch.schema).parquet(folder + "/calls.parquet")


def test_live_ledger(spark, folder):
    batch, stream = stream_of(spark, folder)
    out = run_available(live.live_ledger(L.price_calls(stream)), "update", ["window_start", "window_end", "task", "model"])
    want = L.price_calls(batch).groupBy(F.window("ts", "1 minute").start.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("cost_usd").alias("c"))
    assert sorted((r["window_start"], r["calls"], r["cost_usd"]) for r in out.collect()) == sorted((r["w"], r["n"], r["c"]) for r in want.collect())


def batches_of(spark, tmp_path, df, order="ts"):
    """The rows as a stream of four files, one per batch: within reach of the watermark the files are out of
    order, and the last one holds a row far behind it. Returns (stream, the rows that are not late)."""
    rows = sorted(df.collect(), key=lambda r: r[order])
    n = len(rows) // 4
    late, rest = rows[:1], rows[1:]  # the first row comes last, far behind the watermark
    # Neighbouring rows are swapped between files; the watermark waits long enough for them.
    files = [rest[: n] + rest[2 * n : 2 * n + 20], rest[n : 2 * n], rest[2 * n + 20 : 3 * n] + rest[3 * n + 10 :], rest[3 * n : 3 * n + 10] + late]
    for part in files:
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
        time.sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    return stream, spark.createDataFrame(rest, df.schema), rows[-1][order]


def known(rows, column, end, slack):
    """What a stream can know: rows up to the last watermark."""
    return rows.filter(F.col(column) <= F.lit(end - slack))


def shaped(spark, folder):
    return spark.read.parquet(folder + "/calls.parquet").withColumn("ts", F.timestamp_micros(F.unix_micros("ts")))


def test_live_budget_over_shuffled_batches(spark, folder, tmp_path):
    calls = L.price_calls(shaped(spark, folder))
    stream, batch, end = batches_of(spark, tmp_path, calls)
    out = run_available(live.live_budget_guard(stream, "60 minutes"), closing=True)
    want = L.budget_breaches(known(batch, "ts", end, dt.timedelta(minutes=60)))
    cols = ["trace_id", "call_id", "task", "cap_usd", "cost_usd"]
    assert sorted(map(tuple, out.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect())) and out.count() > 0


def test_live_breaker_over_shuffled_batches(spark, folder, tmp_path):
    calls = shaped(spark, folder).select(F.col("trace_id").alias("service"), F.col("call_id").alias("event_id"), "ts", "ok")
    stream, batch, end = batches_of(spark, tmp_path, calls)
    out = run_available(live.live_breaker(stream, late="60 minutes"), closing=True)
    want = K.breaker_timeline(known(batch, "ts", end, dt.timedelta(minutes=60)))
    cols = ["service", "event_id", "state_before", "state_after", "failures"]
    assert sorted(map(tuple, out.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect())) and out.count() > 0


def test_live_reuse_over_shuffled_batches(spark, folder, tmp_path):
    asked = shaped(spark, folder).select(F.col("call_id").alias("id"), F.col("trace_id").alias("repo"), F.lit("m").alias("branch"), F.lit("s").alias("skill"),
                                         F.lit("abc").alias("sha"), F.lit(False).alias("dry_run"), "ts")
    stream, batch, end = batches_of(spark, tmp_path, asked)
    out = run_available(live.live_reuse(stream, 600, "60 minutes"), closing=True)
    want = K.reuse_results(known(batch, "ts", end, dt.timedelta(minutes=60)), 600)
    cols = ["id", "cache_key", "cache_hit"]
    assert sorted(map(tuple, out.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect())) and out.count() > 0


def test_live_stages_over_shuffled_batches(spark, folder, tmp_path):
    name = F.when(F.col("ok"), "parse_start").otherwise(F.when(F.col("call_id") % 2 == 0, "parse_done").otherwise("parse_failed"))
    events = shaped(spark, folder).select("trace_id", name.alias("event"), "ts")
    stream, batch, end = batches_of(spark, tmp_path, events)
    out = run_available(live.live_stage_durations(stream, "2 minutes", "60 minutes"), closing=True)
    mark = end - dt.timedelta(minutes=60)
    want = live.stage_durations(known(batch, "ts", end, dt.timedelta(minutes=60)), "2 minutes")
    cols = ["trace_id", "stage", "started", "ended", "outcome", "duration_ms", "timed_out"]
    got = sorted(map(str, map(tuple, out.select(*cols).collect())))
    # A start whose timeout the watermark has not passed may still be open.
    sure = sorted(str(tuple(r)) for r in want.select(*cols).collect() if not r["timed_out"] or r["started"] < mark - dt.timedelta(minutes=2) or str(tuple(r)) in got)
    assert got == sure and any("True" in x for x in got) and any("False" in x for x in got)


def test_live_stuck_loops_over_shuffled_batches(spark, tmp_path):
    rows = [("t", i, "click", "b" if i % 7 < 4 else "c", f"u{i // 40}", T0 + dt.timedelta(seconds=30 * i)) for i in range(400)]
    steps = spark.createDataFrame(rows, "trace_id string, step_number bigint, action_type string, target string, url string, ts timestamp").withColumn("after", F.struct("url"))
    stream, batch, end = batches_of(spark, tmp_path, steps)
    out = run_available(live.live_stuck_loops(stream, "80 minutes"), closing=True)
    kept = sorted((r for r in batch.collect() if r["ts"] <= end - dt.timedelta(minutes=80)), key=lambda r: r["ts"])
    same = [(r["target"], r["url"]) for r in kept]
    assert sorted(r["step_number"] for r in out.collect()) == [kept[i]["step_number"] for i in range(2, len(kept)) if same[i] == same[i - 1] == same[i - 2]]


def test_stage_pairs(spark):
    at = lambda **k: T0 + dt.timedelta(**k)
    rows = [("t", "parse_start", T0), ("t", "parse_done", at(seconds=5)), ("t", "refine_start", T0), ("t", "refine_failed", at(hours=2)),
            ("u", "parse_start", T0), ("u", "parse_start", at(seconds=9)), ("u", "parse_done", at(seconds=9)), ("u", "parse_done", at(seconds=20)), ("v", "parse_done", T0)]
    df = spark.createDataFrame(rows, "trace_id string, event string, ts timestamp")
    got = {(r["trace_id"], r["stage"], r["started"]): (r["duration_ms"], r["timed_out"]) for r in live.stage_durations(df, "30 minutes").collect()}
    assert got == {("t", "parse", T0): (5000.0, False), ("t", "refine", T0): (None, True), ("u", "parse", T0): (None, True), ("u", "parse", at(seconds=9)): (0.0, False)}
    spans = {r["stage"]: r["duration_ms"] for r in live.stage_spans(df.filter("trace_id = 't'")).collect()}
    assert spans == {"parse": 5000.0, "refine": 7_200_000.0}


def test_live_stage_join_over_shuffled_batches(spark, folder, tmp_path):
    name = F.when(F.col("ok"), "parse_start").otherwise(F.when(F.col("call_id") % 2 == 0, "parse_done").otherwise("parse_failed"))
    events = shaped(spark, folder).select("trace_id", name.alias("event"), "ts")
    stream, batch, end = batches_of(spark, tmp_path, events)
    out = run_available(live.live_stage_join(stream, "2 minutes", "60 minutes"), closing=True)
    cols = ["trace_id", "stage", "started", "ended", "outcome", "duration_ms", "timed_out"]
    want = live.stage_durations(batch, "2 minutes").filter(F.col("started") < F.lit(end - dt.timedelta(minutes=62)))
    got = sorted(map(str, map(tuple, out.select(*cols).collect())))
    assert got == sorted(map(str, map(tuple, want.select(*cols).collect()))) and any("True" in x for x in got) and any("False" in x for x in got)


def test_live_reuse_cheap_over_shuffled_batches(spark, folder, tmp_path):
    asked = shaped(spark, folder).select(F.col("call_id").alias("id"), F.col("trace_id").alias("repo"), F.lit("m").alias("branch"), F.lit("s").alias("skill"),
                                         F.lit("abc").alias("sha"), F.lit(False).alias("dry_run"), "ts")
    stream, batch, _ = batches_of(spark, tmp_path, asked)
    rows = run_available(live.live_reuse_cheap(stream, "40 days")).collect()
    assert sorted(r["cache_key"] for r in rows) == sorted(r["cache_key"] for r in K.reuse_key(asked).select("cache_key").distinct().collect())


class _State:
    """The state of one key in memory, counting the rows that are read."""

    def __init__(self):
        import pickle

        self.map, self.value, self.timers, self.read, self.pickle = {}, None, set(), 0, pickle

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        outer = self

        class Value:
            exists = staticmethod(lambda: outer.value is not None)
            get = staticmethod(lambda: outer.value)

            @staticmethod
            def update(v):
                outer.value = v

            @staticmethod
            def clear():
                outer.value = None

        return Value()

    def containsKey(self, key):
        return key in self.map

    def getValue(self, key):
        self.read += len(self.pickle.loads(self.map[key][1]))
        return self.map[key]

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


def test_a_firing_reads_the_rows_that_are_due():
    """A service with very many held rows: what a batch reads grows with the rows due in it, not with those held."""
    import types

    import pandas as pd

    state, guard = _State(), live._Breaker(5, 60, None)
    guard.init(state)
    rng = random.Random(8)
    rows = [(1_000_000 * s + rng.randrange(1_000_000), s * 10 + k, rng.random() < 0.5) for s in range(2000) for k in range(5)]
    rng.shuffle(rows)
    for at in range(0, len(rows), 2500):
        list(guard.handleInputRows(("s",), iter([pd.DataFrame(rows[at : at + 2500], columns=["us", "event_id", "ok"])]), None))
    out, reads = [], []
    for mark in (100_000, 100_500, 700_000, 700_000, 10**7):
        state.read, due = 0, 0
        for at in sorted(t for t in state.timers if t < mark):
            state.timers.discard(at)
            for part in guard.handleExpiredTimer(("s",), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), types.SimpleNamespace(getExpiryTimeInMs=lambda: at)):
                out += part.itertuples(index=False, name=None)
        reads.append(state.read)
    n = [sum(us // 1000 <= m for us, *_ in rows) for m in (100_000, 100_500, 700_000, 10**7)]
    assert [len(out), n[3]] == [10_000, 10_000] and [x[1] for x in out] == [e for _, e, _ in sorted(rows)]
    assert reads[0] <= n[0] + 5 and reads[1] <= n[1] - n[0] + 10 and reads[2] <= n[2] - n[1] + 10 and reads[3] <= 5 and not state.map


def test_state_calls_follow_entries_not_rows():
    """A key's few rows are one entry and one timer, those of many keys in a bucket too; a key with many rows has an entry
    per slot. What comes out is the same."""
    import types

    import pandas as pd

    class Counted(_State):
        calls = 0

        def updateValue(self, key, value):
            self.calls += 1
            super().updateValue(key, value)

        def registerTimer(self, ms):
            self.calls += 1
            super().registerTimer(ms)

    def run(processor, rows, columns, marks):
        state, out = Counted(), []
        processor.init(state)
        list(processor.handleInputRows(("k",), iter([pd.DataFrame(rows, columns=columns)]), None))
        first = state.calls
        for mark in marks:
            for at in sorted(t for t in state.timers if t < mark):
                state.timers.discard(at)
                for part in processor.handleExpiredTimer(("k",), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), types.SimpleNamespace(getExpiryTimeInMs=lambda: at)):
                    out += part.itertuples(index=False, name=None)
        return out, first, state

    second, end = 1_000_000, 10**9
    few = [(s * second, s, s % 3 == 0) for s in range(500)]
    out, calls, state = run(live._Breaker(5, 60, None), few, ["us", "event_id", "ok"], (100_000, end))
    assert calls == 2 and [x[1] for x in out] == list(range(500)) and not state.map
    many = [(s * second, s, s % 3 == 0) for s in range(20_000)]
    out, calls, state = run(live._Breaker(5, 60, None, 3600 * second), many, ["us", "event_id", "ok"], (5_000_000, end))
    assert calls <= 2 * 6 + 1 and [x[1] for x in out] == list(range(20_000)) and not state.map
    starts = [(s * second, f"t{s}", "parse", 0, "") for s in range(300)] + [(s * second + 7, f"t{s}", "parse", 1, "done") for s in range(0, 300, 2)]
    out, calls, state = run(live._Stages(60 * second, None), starts, ["us", "trace_id", "stage", "closing", "outcome"], (100_000, 360_000))
    # The start at second 299 is a minute behind the mark of 360 seconds; all others too.
    assert calls == 2 and sorted((x[0], x[6]) for x in out) == sorted((f"t{s}", s % 2 == 1) for s in range(300)) and not state.map and state.value is None
