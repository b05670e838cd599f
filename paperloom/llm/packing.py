"""Pack token sequences into windows with best-fit decreasing.

A document's tokens, closed by an end token, are cut into full windows; what is left is one piece shorter
than a window. Pieces are packed longest first, each into the open window with the least room that still
takes it; a segment tree over the room values finds that window. Pieces are dealt round-robin into shards
of about SHARD pieces and each shard is packed on its own, so no task sees more than a shard and no more
than one sparsely filled window per shard is lost.

Null texts count as empty; an empty text is the end token alone. Repeated rows are packed once each. Empty
tables give no pieces. Very long texts are cut like any other. Columns beyond the identifier and the text
are ignored, whatever they are called.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut_lineage, ship_package

WINDOW = 1024
END = 0
#: Pieces a shard holds about.
SHARD = 100_000
_SPECIAL = "<|endoftext|>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class RoomTree:
    """Open windows by the room they have left. The tree holds, per range of rooms, whether any window is
    open there; `tightest(n)` descends to the smallest room of at least n."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.any = [False] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        node = room + self.size
        while node and not self.any[node]:
            self.any[node] = True
            node >>= 1

    def take(self, room: int) -> int:
        window = self.open[room].pop()
        if not self.open[room]:
            node = room + self.size
            self.any[node] = False
            node >>= 1
            while node:
                self.any[node] = self.any[2 * node] or self.any[2 * node + 1]
                if self.any[node]:
                    break
                node >>= 1
        return window

    def tightest(self, length: int) -> int | None:
        node = length + self.size
        if self.any[node]:
            return length
        while node > 1:  # climb until a range to the right holds a window
            if not node & 1 and self.any[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.size:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.size


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece. Equal lengths are packed in the order given."""
    numbers, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = RoomTree(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = tree.tightest(n)
        if room is None:
            numbers[i], room, used = used, window, used + 1
        else:
            numbers[i] = tree.take(room)
        offsets[i] = window - room
        if room > n:
            tree.add(room - n, int(numbers[i]))
    return numbers, offsets


class Encoder:
    """Token ids of the byte-level vocabulary. The rank file holds the same vocabulary and gives the same
    ids several times faster; texts that spell a special token go through the JSON file's own rules."""

    def __init__(self, json_path: str, rank_path: str, pattern: str) -> None:
        import tiktoken

        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.exact = json_path, None

    def __call__(self, text: str) -> np.ndarray:
        if _SPECIAL in text:
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.json_path)
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), "<u4")


def default_encoder() -> Encoder:
    import public_tokenizers as P

    return Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def cut(ids: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray]]:
    for start in range(0, len(ids), window):
        yield start, ids[start : start + window]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, make_encoder=default_encoder) -> DataFrame:
    """One row per piece with the checksum of its ids: full windows and what is left of each document."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for batch in batches:
            names, starts, lengths, sums, totals = [], [], [], [], []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(value.as_py() or ""), np.array([end], "<u4")).astype("<u4", copy=False)
                for start, part in cut(ids, window):
                    names.append(name)
                    starts.append(start)
                    lengths.append(len(part))
                    sums.append(zlib.crc32(part.tobytes()))
                    totals.append(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (names, starts, lengths, sums, totals)],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, window: int = WINDOW, shard: int = SHARD, **options) -> DataFrame:
    """The pieces with `sequence_id` and `offset`."""
    made = cut_lineage(pieces(docs, window=window, **options))
    shards = max(1, -(-made.count() // shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            rows = pa.Table.from_batches(got).combine_chunks()
            numbers, offsets = best_fit_decreasing(rows["length"].to_numpy(), window)
            first = TaskContext.get().partitionId() << 40
            rows = rows.append_column("sequence_id", pa.array(numbers + first)).append_column("offset", pa.array(offsets))
            yield from rows.to_batches(max_chunksize=50_000)

    return made.repartition(shards).mapInArrow(run, f"{PIECES}, sequence_id long, offset long")
