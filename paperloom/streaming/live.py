"""Streaming operators: each has a batch twin that gives the same rows.

Rows behind the watermark are dropped. Keyed operators hold their rows in state until the watermark has
passed them and only then work on them, in event-time order, so results depend neither on the borders of
the batches nor on the order of arrival. A key's state stays until it is used up; `ttl` gives it a life
in processing time instead, after which the key starts anew. `slot` is the time whose held rows lie together
where a key has many: as long as the watermark's usual step, or longer where a backlog is worked off.
"""

from __future__ import annotations

import pickle
import sys

import pandas as pd
from pyspark.cloudpickle import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paperloom.functions import fixed
from paperloom.functions.ordered import previous_rows, time_chunk
from paperloom.operators import secrets
from paperloom.operators.ledger import cap_of, exact
from paperloom.operators.skills import reuse_key

# State processors travel with their code: the process that prepares a stateful stream does not get
# the shipped package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_MONEY_UNIT = 10 ** 12  # state keeps money as whole millionths of a millionth of a dollar


def live_ledger(priced: DataFrame, window: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Calls, tokens, cost and latency per window, task and model (update mode). Partial sums are made
    before the shuffle, so a busy model costs one row per task and batch."""
    slot = F.window("ts", window, slide) if slide else F.window("ts", window)
    return priced.withWatermark("ts", late).groupBy(slot.alias("w"), "task", "model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.sum("cost_usd").alias("cost_usd"), F.sum(exact("latency_ms")).alias("latency_ms")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "task", "model", "calls", "tokens_in", "tokens_out",
        "cost_usd", "latency_ms")


def _ms(us: int) -> int:
    return us // 1000


#: Held rows up to which a key's are one entry, and new rows that are gathered before they are spread over slots.
_FEW, _HOLD = 1024, 100_000
#: The entry of rows that lie together; where rows are spread it is empty and counts the slots.
_TOGETHER = (-(1 << 62), 0)


class _InOrder(StatefulProcessor):
    """Holds rows (tuples that start with their time in microseconds) until the watermark has passed them.

    Up to FEW rows of a key are one entry of a map. A key that holds more is spread over slots of time: the rows a
    batch brings for a slot are an entry of their own, so nothing held is rewritten for them, and a timer reads the
    rows that are due (and at most their slot's rest), however many a key holds. Timers fire in the order of
    time, so rows are worked on in that order. `slot_us` is the width of a slot: short where the watermark
    advances in small steps, long where much is released at once. Subclasses say what a row holds (`fields`), what is
    carried (`memory`), work on released rows, and may hold further rows that mark a time (`marks`).
    """

    fields, memory, columns = "", "", []

    def __init__(self, ttl_ms: int | None = None, slot_us: int = 1_000_000) -> None:
        self.ttl_ms, self.slot_us = ttl_ms, slot_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "slot bigint, part int", "first bigint, rows binary")
        self.state = handle.getValueState("memory", self.memory, self.ttl_ms)
        self.passed = None

    def _entry(self, at: tuple[int, int]) -> tuple[int, list[tuple]] | None:
        if not self.held.containsKey(at):
            return None
        first, rows = self.held.getValue(at)
        return int(first), pickle.loads(bytes(rows))

    def _put(self, at: tuple[int, int], first: int, rows: list[tuple]) -> None:
        self.held.updateValue(at, (first, pickle.dumps(rows)))

    def _kept(self) -> tuple[list[tuple], int]:
        """The rows of a key that lie together, and the number of slots its rows are spread over instead."""
        first, rows = self._entry(_TOGETHER) or (0, [])
        return rows, 0 if rows else first

    def _spread(self, slots: int) -> None:
        self._put(_TOGETHER, slots, []) if slots else self.held.removeKey(_TOGETHER)

    def _parts(self, slot: int) -> int:
        """The number of entries of a slot: they are numbered from 0 on, without gaps."""
        none, some = 0, -1  # `some` is there, `none` is to be tested
        while self.held.containsKey((slot, none)):
            some, none = none, 2 * none + 1
        while none - some > 1:
            middle = (some + none) // 2
            some, none = (middle, none) if self.held.containsKey((slot, middle)) else (some, middle)
        return none

    def _wake(self, first: int) -> None:
        self.handle.registerTimer(_ms(first) - 1)

    def _add(self, rows: list[tuple], parts: dict[int, int]) -> int:
        """Spread rows over their slots, each as the next part; the number of slots that had none."""
        opened, by_slot = 0, {}
        for r in rows:
            by_slot.setdefault(r[0] // self.slot_us, []).append(r)
        for slot, here in by_slot.items():
            part = parts[slot] if slot in parts else self._parts(slot)
            opened += part == 0
            self._put((slot, part), 0, here)
            parts[slot] = part + 1
            self._wake(min(r[0] for r in here))
        return opened

    def handleInputRows(self, key, rows, timerValues):
        names = [f.strip().split(" ")[0] for f in self.fields.split(",")]
        kept, slots = self._kept()
        new, parts = [], {}
        for pdf in rows:  # one Arrow batch at a time
            pdf = pdf[pdf["us"].notna()]
            given = list(zip(pdf["us"].astype("int64").tolist(), *[pdf[n].tolist() for n in names]))
            new += given + self.marks(given)
            if len(new) > _HOLD:
                slots += self._add(kept + new, parts)
                kept, new = [], []
        if slots or len(kept) + len(new) > _FEW:
            self._spread(slots + self._add(kept + new, parts))
        elif new:
            first = min(r[0] for r in new)
            before = min((r[0] for r in kept), default=None)
            if before is None or first < before:
                self._wake(first)
            self._put(_TOGETHER, first if before is None else min(first, before), kept + new)
        yield from ()

    def _release(self, slot: int, mark: int) -> list[tuple]:
        """The rows that are due: of all rows that lie together, else of the slot. The rest stays, with a timer."""
        kept, slots = self._kept()
        parts = self._parts(slot) if slots else 0
        if slots:
            kept = [r for n in range(parts) for r in self._entry((slot, n))[1]]
        due, rest = sorted(r for r in kept if _ms(r[0]) <= mark), [r for r in kept if _ms(r[0]) > mark]
        if due:
            for n in range(1 if rest else 0, parts):
                self.held.removeKey((slot, n))
            if rest:
                first = min(r[0] for r in rest)
                self._put((slot, 0) if slots else _TOGETHER, first, rest)
                self._wake(first)
            else:
                self._spread(slots - 1 if slots else 0)
        return due

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark, at = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        # The row that asked for the timer is of the next millisecond.
        slot = (at + 1) * 1000 // self.slot_us
        # A slot is read once for a watermark, however many timers it has.
        if self.passed == (key, slot, mark):
            return
        self.passed = (key, slot, mark)
        due = self._release(slot, mark)
        if not due:
            return
        if self.ttl_ms:
            self.clock = timerValues.getCurrentProcessingTimeInMs()
        memory = tuple(self.state.get()) if self.state.exists() else None
        out, changed = self.work(key, due, memory)
        if changed != memory:
            self.state.update(changed) if changed is not None else self.state.clear()
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def marks(self, rows: list[tuple]) -> list[tuple]:
        """Rows to be held besides these."""
        return []

    def work(self, key, rows: list[tuple], memory: tuple | None) -> tuple[list[tuple], tuple | None]:
        """Rows to put out and what to carry."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class _ManyKeys(_InOrder):
    """Keys with few rows each, dealt to buckets: a bucket holds the rows and carries the memory of all its keys, and
    calls upon the store are made per bucket. For memory that wears out, so that what a bucket carries stays short."""

    memory, clock = "kept binary", 0

    def work(self, key, rows, memory):
        kept = pickle.loads(bytes(memory[0])) if memory else {}
        if self.ttl_ms:
            kept = {k: v for k, v in kept.items() if self.clock - v[1] < self.ttl_ms}
        out = []
        for row in rows:
            self.step(row, kept, out)
        kept = {k: v for k, v in kept.items() if self.lasts(v[0], rows[-1][0])}
        return out, (pickle.dumps(kept),) if kept else None

    def step(self, row: tuple, kept: dict, out: list[tuple]) -> None:
        """Work on one row. `kept`: key -> (what is carried, when it was written)."""
        raise NotImplementedError

    def lasts(self, value, now_us: int) -> bool:
        """Whether what is carried can still tell for a row at or after `now_us`."""
        return True


#: Buckets of keys with few rows.
_BUCKETS = 4096


def _bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(_BUCKETS)).alias("bucket")


def _keyed(rows: DataFrame, keys: list[str], processor: _InOrder, schema: str) -> DataFrame:
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def _clocked(df: DataFrame, late: str, keys: list[Column | str], *columns: Column | str) -> DataFrame:
    """Keys, time in microseconds, further columns; the event time itself stays, or no row would be late."""
    return df.withWatermark("ts", late).select(*keys, F.unix_micros("ts").alias("us"), *columns, "ts")


class _BudgetGuard(_InOrder):
    fields, memory = "call_id bigint, task string, units bigint, cap bigint", "units bigint, alerted boolean"
    columns = ["trace_id", "call_id", "task", "cap_usd", "cost_usd"]

    def work(self, key, rows, memory):
        spent, alerted = memory or (0, False)
        out = []
        for _, call, task, units, cap in rows:
            spent += units
            if not alerted and 0 < cap < spent:
                alerted = True
                out.append((key[0], call, task, round(cap / _MONEY_UNIT, 6), round(spent / _MONEY_UNIT, 6)))
        return out, (spent, alerted)


def live_budget_guard(priced: DataFrame, late: str = "10 minutes", ttl_ms: int | None = None, slot: str = "1 second") -> DataFrame:
    """One alert per trace, at the call whose running cost first passes the cap."""
    units = lambda c: (c * F.lit(_MONEY_UNIT)).cast("bigint")
    rows = _clocked(priced, late, ["trace_id"], "call_id", "task", units(F.col("cost_usd")).alias("units"),
                    units(cap_of(F.col("task")).cast("decimal(12,6)")).alias("cap"))
    return _keyed(rows, ["trace_id"], _BudgetGuard(ttl_ms, _interval_us(slot)), "trace_id string, call_id bigint, task string, cap_usd double, cost_usd double")


class _StuckLoop(_InOrder):
    fields, memory = "step_number bigint, action string, url string", "a1 string, u1 string, a2 string, u2 string"
    columns = ["trace_id", "step_number", "action", "url"]

    def work(self, key, rows, memory):
        a1, u1, a2, u2 = memory or (None, None, None, None)  # the step before, and the one before that
        out = []
        for _, step, action, url in rows:
            if (action, url) == (a1, u1) == (a2, u2):
                out.append((key[0], step, action, url))
            a1, u1, a2, u2 = action, url, a1, u1
        return out, (a1, u1, a2, u2)


def live_stuck_loops(steps: DataFrame, late: str = "10 minutes", ttl_ms: int | None = None, slot: str = "1 second") -> DataFrame:
    """A row for every step (trace_id, ts, step_number, ...) that repeats the action and URL of the two
    steps before it."""
    rows = _clocked(steps, late, ["trace_id"], F.col("step_number").cast("bigint").alias("step_number"),
                    F.concat_ws(": ", "action_type", F.coalesce("target", F.lit(""))).alias("action"), F.coalesce(F.col("after.url"), F.lit("")).alias("url"))
    return _keyed(rows, ["trace_id"], _StuckLoop(ttl_ms, _interval_us(slot)), "trace_id string, step_number bigint, action string, url string")


class _Breaker(_InOrder):
    fields, memory = "event_id bigint, ok boolean", "failures bigint, last_us bigint"
    columns = ["service", "event_id", "state_before", "state_after", "failures"]

    def __init__(self, threshold: int, cooldown_seconds: float, ttl_ms: int | None, slot_us: int = 1_000_000) -> None:
        super().__init__(ttl_ms, slot_us)
        self.threshold, self.cooldown = threshold, cooldown_seconds * 1_000_000

    def work(self, key, rows, memory):
        failures, last = memory or (0, 0)
        out = []
        for us, event, ok in rows:
            before = "closed" if failures < self.threshold else "half_open" if us - last > self.cooldown else "open"
            failures, last = (0, last) if ok else (failures + 1, us)
            out.append((key[0], event, before, "open" if failures >= self.threshold else "closed", failures))
        return out, (failures, last)


def live_breaker(events: DataFrame, threshold: int = fixed.BREAKER_FAILURES, cooldown: float = fixed.BREAKER_COOLDOWN_SECONDS,
                 late: str = "10 minutes", ttl_ms: int | None = None, slot: str = "1 second") -> DataFrame:
    """(service, event_id, ts, ok) -> breaker state before and after every call."""
    rows = _clocked(events, late, ["service"], F.col("event_id").cast("bigint").alias("event_id"), "ok")
    return _keyed(rows, ["service"], _Breaker(threshold, cooldown, ttl_ms, _interval_us(slot)),
                  "service string, event_id bigint, state_before string, state_after string, failures bigint")


class _Reuse(_ManyKeys):
    fields, columns = "cache_key string, id bigint", ["id", "cache_key", "cache_hit"]

    def __init__(self, keep_seconds: int, ttl_ms: int | None, slot_us: int = 1_000_000) -> None:
        super().__init__(ttl_ms, slot_us)
        self.keep = keep_seconds * 1_000_000

    def step(self, row, kept, out):
        us, key, request = row
        last = kept.get(key)
        hit = last is not None and self.lasts(last[0], us)
        out.append((request, key, hit))
        if not hit:
            kept[key] = (us, self.clock)

    def lasts(self, value, now_us):
        return now_us - value < self.keep


def live_reuse(requests: DataFrame, ttl_seconds: int = fixed.REUSE_TTL_SECONDS, late: str = "10 minutes", ttl_ms: int | None = None, slot: str = "1 second") -> DataFrame:
    """Requests served from a kept result, by the exact rule (hits do not refresh the clock)."""
    rows = _clocked(reuse_key(requests), late, [_bucket("cache_key")], "cache_key", F.col("id").cast("bigint").alias("id"))
    return _keyed(rows, ["bucket"], _Reuse(ttl_seconds, ttl_ms, _interval_us(slot)), "id bigint, cache_key string, cache_hit boolean")


def live_reuse_cheap(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """The approximation: one executed request per key inside the watermark, no custom state."""
    return reuse_key(requests).withWatermark("ts", late).dropDuplicatesWithinWatermark(["cache_key"])


def _stage(event: Column) -> Column:
    return F.regexp_replace(event, "_(start|done|failed|skipped)$", "")


class _Stages(_ManyKeys):
    # `closing`: 0 a start, 1 an end, 2 the time at which a start is given up.
    fields = "trace_id string, stage string, closing int, outcome string"
    columns = ["trace_id", "stage", "started", "ended", "outcome", "duration_ms", "timed_out"]

    def __init__(self, timeout_us: int, ttl_ms: int | None, slot_us: int = 1_000_000) -> None:
        super().__init__(ttl_ms, slot_us)
        self.timeout = timeout_us

    def marks(self, rows):
        return [((_ms(us + self.timeout) + 1) * 1000, trace, stage, 2, "") for us, trace, stage, closing, _ in rows if not closing]

    def step(self, row, kept, out):
        us, trace, stage, closing, outcome = row
        opened = kept.get((trace, stage))
        if closing == 2 and (opened is None or _ms(opened[0] + self.timeout) >= _ms(us)):
            return  # that start is paired, or another one is open
        if opened is not None:
            start = opened[0]
            in_time = closing == 1 and us - start <= self.timeout
            out.append((trace, stage, pd.Timestamp(start, unit="us"), pd.Timestamp(us, unit="us") if in_time else pd.NaT, outcome if in_time else None,
                        (us - start) / 1000 if in_time else None, not in_time))
        if closing:
            kept.pop((trace, stage), None)
        else:
            kept[trace, stage] = (us, self.clock)


def _marked(events: DataFrame) -> DataFrame:
    """Starts and ends of stages; at equal times a start comes before an end."""
    end = F.regexp_extract("event", "_(done|failed|skipped)$", 1)
    return events.withColumn("stage", _stage(F.col("event"))).withColumn("outcome", end).withColumn("closing", (end != "").cast("int")).filter(
        (F.col("closing") == 1) | F.endswith(F.col("event"), F.lit("_start")))


def _interval_us(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1_000_000)


def live_stage_durations(events: DataFrame, timeout: str = "30 minutes", late: str = "10 minutes", ttl_ms: int | None = None, slot: str = "1 second") -> DataFrame:
    """`stage_durations` on a stream: a pair comes out once the watermark has passed its end, a start that
    stays open once it has passed the timeout."""
    rows = _clocked(_marked(events), late, [_bucket("trace_id", "stage")], "trace_id", "stage", "closing", "outcome")
    return _keyed(rows, ["bucket"], _Stages(_interval_us(timeout), ttl_ms, _interval_us(slot)),
                  "trace_id string, stage string, started timestamp, ended timestamp, outcome string, duration_ms double, timed_out boolean")


def live_stage_join(events: DataFrame, timeout: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """`stage_durations` without state of its own: starts joined to what follows within the timeout, by a left outer
    interval join of two streams, and of that the nearest. If that is an end, the stage is paired; another
    start, or nothing, leaves it timed out. A start comes out once the watermark is a timeout behind it.

    A start meets all events of its stage within the timeout, so this suits traces that run a stage a few times;
    `live_stage_durations` holds for any. Starts of a stage at the very same time are one.
    """
    marked = _marked(events).withWatermark("ts", late)
    starts = marked.filter("closing = 0").select("trace_id", "stage", F.col("ts").alias("started"))
    after = marked.select(F.col("trace_id").alias("_trace"), F.col("stage").alias("_stage"), F.col("ts").alias("next"), "closing", "outcome")
    near = (F.col("_trace") == F.col("trace_id")) & (F.col("_stage") == F.col("stage")) & (F.col("next") >= F.col("started")) \
        & (F.col("next") <= F.col("started") + F.expr(f"INTERVAL {timeout}")) & ((F.col("next") > F.col("started")) | (F.col("closing") == 1))
    nearest = starts.join(after, near, "leftOuter").groupBy("trace_id", "stage", "started").agg(
        F.min(F.when(F.col("next").isNotNull(), F.struct("next", "closing", "outcome"))).alias("n"))
    paired = F.coalesce(F.col("n.closing") == 1, F.lit(False))
    return nearest.select(
        "trace_id", "stage", "started", F.when(paired, F.col("n.next")).alias("ended"), F.when(paired, F.col("n.outcome")).alias("outcome"),
        F.when(paired, (F.unix_micros("n.next") - F.unix_micros("started")) / 1000).alias("duration_ms"), (~paired).alias("timed_out"))


def stage_durations(events: DataFrame, timeout: str = "30 minutes", chunk_seconds: int = 3600) -> DataFrame:
    """One row per start: paired with the first end at or after it and before the next start, if that is
    within the timeout; else timed out.

    The row after a start decides about it, so every row looks back at the one before; a key's last start
    is found by an aggregate. Histories are cut into chunks of time, so no key is one task.
    """
    if events.isStreaming:
        return live_stage_durations(events, timeout)
    keys = ["trace_id", "stage"]
    rows = _marked(events).select(*keys, "ts", "closing", "outcome")
    look = previous_rows(rows, keys, ["ts", "closing"], time_chunk("ts", chunk_seconds), ["ts", "closing"], 1, time_chunk("ts", 1)).withColumn("before", F.get("previous", F.lit(0)))
    after = look.filter("before.closing = 0").select(*keys, F.col("before.ts").alias("started"), "closing", F.col("ts").alias("next"), "outcome")
    last = rows.groupBy(*keys).agg(F.max(F.struct("ts", "closing")).alias("l")).filter("l.closing = 0").select(
        *keys, F.col("l.ts").alias("started"), F.lit(0).alias("closing"), F.lit(None).cast("timestamp").alias("next"), F.lit("").alias("outcome"))
    span = F.unix_micros("next") - F.unix_micros("started")
    paired = F.coalesce((F.col("closing") == 1) & (span <= _interval_us(timeout)), F.lit(False))
    return after.unionByName(last).select(
        *keys, "started", F.when(paired, F.col("next")).alias("ended"), F.when(paired, F.col("outcome")).alias("outcome"),
        F.when(paired, span / 1000).alias("duration_ms"), (~paired).alias("timed_out"))


def stage_spans(events: DataFrame) -> DataFrame:
    """Batch twin where a stage runs once per trace: first start, last end."""
    opened = F.endswith(F.col("event"), F.lit("_start"))
    per = events.groupBy("trace_id", _stage(F.col("event")).alias("stage")).agg(
        F.min(F.when(opened, F.col("ts"))).alias("started"), F.max(F.when(~opened, F.col("ts"))).alias("ended"))
    return per.filter("started is not null").withColumn(
        "duration_ms", (F.unix_micros("ended") - F.unix_micros("started")) / 1000).withColumn("timed_out", F.col("ended").isNull())


def live_secret_scan(files: DataFrame, extra: bool = False) -> DataFrame:
    """The batch scan as it is: it needs no state, so it runs unchanged on a stream of files."""
    return secrets.scan_secrets(files, extra)


def guard_finished_runs(runs: DataFrame, steps_of, sink: str, checkpoint: str):
    """Guard runs as they finish: every batch of finished runs is judged with the batch operator.

    `steps_of(batch)` returns the recorded steps of the batch's runs; results go to `sink/batch=n`.
    """
    from paperloom.operators.runs import guard_runs

    def judge(batch: DataFrame, n: int) -> None:
        guard_runs(batch, steps_of(batch)).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return runs.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint)
