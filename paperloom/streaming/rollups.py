"""Aggregate tables kept up to date by a stream, batch by batch.

The table is a base, which holds all batches up to the one in its name, and a delta for every batch after it. A batch
writes its own delta over whatever an earlier attempt left, and a batch the base already holds writes nothing: a
replayed batch changes nothing. Every so many deltas a new base is written; only when it is complete are the old
base and its deltas removed, so a crash at any time leaves a readable table. What is stored is a row per key in the
base and in at most `compact_after` deltas, however many batches there were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.operators import sketches
from paperloom.session import discard, finished_parts


class KeptRollup:
    """`summarise` makes a batch's summary of its rows; `keys` and `kinds` say how summaries merge (`sketches.merged`)."""

    def __init__(self, spark: SparkSession, home: str, summarise: Callable[[DataFrame], DataFrame], keys: list[str], kinds: dict[str, str], compact_after: int = 16) -> None:
        self.spark, self.home, self.summarise = spark, home.rstrip("/"), summarise
        self.keys, self.kinds, self.compact_after = keys, kinds, compact_after

    def _state(self) -> tuple[int, list[int]]:
        """The last batch of the base (-1: none) and the batches after it that have a delta."""
        upto = max(finished_parts(self.spark, f"{self.home}/base", "upto"), default=-1)
        return upto, sorted(n for n in finished_parts(self.spark, f"{self.home}/deltas", "batch") if n > upto)

    def add(self, rows: DataFrame, batch: int) -> None:
        """Take in a batch of rows; the same batch again changes nothing."""
        if batch <= self._state()[0]:
            return
        self.summarise(rows).write.mode("overwrite").parquet(f"{self.home}/deltas/batch={batch}")
        if len(self._state()[1]) >= self.compact_after:
            self.compact()

    def _parts(self) -> list[str]:
        upto, deltas = self._state()
        return [f"{self.home}/base/upto={upto}"] * (upto >= 0) + [f"{self.home}/deltas/batch={n}" for n in deltas]

    def read(self) -> DataFrame | None:
        """The table: one row per key. None before the first batch."""
        parts = self._parts()
        return sketches.merged(self.spark.read.parquet(*parts), self.keys, self.kinds).select(*self.keys, *self.kinds) if parts else None

    def compact(self) -> None:
        """Write a new base of all there is, then remove what it was made of."""
        upto, deltas = self._state()
        if not deltas:
            return
        old = self._parts()
        self.read().write.mode("overwrite").parquet(f"{self.home}/base/upto={deltas[-1]}")
        # Also what an earlier compaction could not remove any more.
        left = [f"{self.home}/deltas/batch={n}" for n in finished_parts(self.spark, f"{self.home}/deltas", "batch") if n <= deltas[-1]]
        discard(self.spark, *{*old, *left})

    def writer(self, stream: DataFrame, checkpoint: str):
        """The stream's writer, to be started with a trigger of one's own."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
