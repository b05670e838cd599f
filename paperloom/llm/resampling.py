"""Importance resampling of documents towards a target distribution.

Features are all runs of 1 to `size` consecutive words (A-Z lower-cased; digits, letters and everything above ASCII),
joined by a space; a feature's bucket is the CRC-32 of its bytes modulo `buckets`. Bucket counts of all documents
(s of S) and of all target texts (t of T) give one array of gains,

    floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets))))

which is all that is sent to the tasks (`buckets` numbers). A document's weight is the sum of its features' gains, its
score the weight plus seeded Gumbel noise, so that the highest scores are a draw without replacement in proportion
to exp(weight / 1000).

The narrow scores are written once. The cut-off is found by bisection: jobs that count the rows at or above a score,
exactly, until one score is left; each job counts at `PIVOTS` points at once and so settles several halvings. Rows tied
at that score are cut by identifier in the same way. Only drawn rows are shuffled: range-partitioned in the order of
the draw, counted per partition, and ranked by place within the partition plus the rows before it. Texts never move.

Null and empty texts have no word, weight 0 and no part in the draw; a null identifier is the text `null` in the
noise and comes last in ties. Texts of any length are read whole. Repeated rows are rows of their own: where the
draw ends among equal identifiers, the one with fewer features goes first, and of identical rows any. Empty tables are
fine: without documents there are no rows, without target texts its counts are 0. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import shuffle_partitions
from paperloom.session import ship_package, work_folder

BUCKETS = 10_000
SIZE = 1
SEED = 2024
PERCENT = 10
LEAST = 20
#: Scores at which one job counts: 2^n - 1 settle n halvings.
PIVOTS = 15
#: Bytes of a word that are hashed for all words of a batch together; what is longer goes word by word.
_LONG = 48
#: Texts worked on at a time.
_TEXTS = 500

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _remainders() -> np.ndarray:
    """CRC-32 of every byte, by its polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_OF_BYTE = _remainders()


def crc32_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Unsigned CRC-32 of runs of bytes, each continuing the CRC-32 `before` it."""
    crc = np.zeros(len(starts), np.uint32) if before is None else before.astype(np.uint32)
    far = np.flatnonzero(lengths > _LONG)
    order = np.argsort((_LONG + 1 - np.where(lengths > _LONG, 0, lengths)).astype(np.uint16), kind="stable")  # longest first
    at, state = starts[order], ~crc[order]
    more = len(order) - np.bincount(np.where(lengths > _LONG, 0, lengths), minlength=_LONG + 1).cumsum()  # runs longer than k
    for k in range(_LONG):
        n = int(more[k])
        if not n:
            break
        state[:n] = _OF_BYTE[(state[:n] ^ data[at[:n] + k]) & 255] ^ (state[:n] >> 8)
    out = np.empty_like(crc)
    out[order] = ~state
    for i in far.tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]].tobytes(), int(crc[i]))
    return out


def features(texts: pa.Array, size: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every feature (by text), and the number of words per text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = _LOWER[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw is not None else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    inside = np.r_[False, _INSIDE[data], False]
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]  # a word ends with its text
    opens[edges], closes[edges - 1] = inside[1:-1][edges], inside[1:-1][edges - 1]
    starts = np.flatnonzero(opens)
    lengths = np.flatnonzero(closes) - starts + 1
    text = np.searchsorted(bounds, starts, side="right") - 1
    first, crc = np.arange(len(text)), crc32_of(data, starts, lengths)  # runs of n words: their first one, and hash
    made, owner = [crc], [text]
    space = np.frombuffer(b" ", np.uint8)
    for n in range(1, size):
        on = first + n < len(text)
        on[on] = text[first[on] + n] == text[first[on]]
        first, crc = first[on], crc[on]
        crc = crc32_of(space, np.zeros(len(first), np.int64), np.ones(len(first), np.int64), crc)
        crc = crc32_of(data, starts[first + n], lengths[first + n], crc)
        made.append(crc)
        owner.append(text[first])
    found, owner = np.concatenate(made) % buckets, np.concatenate(owner)
    if size > 1:
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
    return found, owner, np.bincount(text, minlength=len(texts))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _TEXTS):
            yield batch.slice(at, _TEXTS)


def bucket_counts(texts: DataFrame, text: str = "text", size: int = SIZE, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket of the whole table; a task hands on one sum per bucket."""
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for piece in _pieces(batches):
            sums += np.bincount(features(piece.column(0), size, buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(sums)), pa.array(sums[sums > 0])], names=["bucket", "n"])

    parts = texts.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain, from the counts of all documents and of the target texts."""
    buckets, every, wanted = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = [float(t + 1) * (every + buckets) / (float(s + 1) * (wanted + buckets)) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Seeded Gumbel noise of a document, in thousandths."""
    name = "null" if doc_id is None else str(doc_id)
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORES = "doc_id long, n_words long, n_features long, weight long, score long, nth long"


def _scorer(gain: np.ndarray, size: int, seed: int) -> Callable[[pa.RecordBatch], tuple[np.ndarray, ...]]:
    """From rows of (identifier, text) to n_words, n_features, weight and score."""

    def of(piece: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        found, owner, words = features(piece.column(1), size, len(gain))
        ends = np.r_[0, gain[found].cumsum()]
        bounds = np.searchsorted(owner, np.arange(piece.num_rows + 1))
        weight = ends[bounds[1:]] - ends[bounds[:-1]]
        return words, np.diff(bounds), weight, weight + np.array([noise(i, seed) for i in piece.column(0).to_pylist()], np.int64)

    return of


def scores(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, seed: int = SEED) -> DataFrame:
    """Per document `doc_id`, `n_words`, `n_features`, `weight`, `score`, `nth` (its place in its task)."""
    ship_package(docs.sparkSession)
    of = _scorer(gain, size, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for piece in _pieces(batches):
            made = [*of(piece), np.arange(n, n + piece.num_rows)]
            n += piece.num_rows
            yield pa.RecordBatch.from_arrays([piece.column(0), *[pa.array(m.astype(np.int64)) for m in made]], names=[f.split()[0] for f in _SCORES.split(", ")])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, _SCORES)


def bisect(rows: DataFrame, value: Column, wanted: int, low: int, high: int, pivots: int = PIVOTS) -> int:
    """The least number up to `high` that `wanted` or more rows' values do not exceed. Exact counts; every job counts at `pivots`
    points of the interval left."""
    while low < high:
        steps = sorted({low + (high - low) * i // (pivots + 1) for i in range(1, pivots + 1)} | {low})
        found = rows.agg(*[F.count(F.when(value <= F.lit(p), 1)) for p in steps]).first()
        enough = [p for p, n in zip(steps, found) if n >= wanted]
        short = [p for p, n in zip(steps, found) if n < wanted]
        low, high = max(short, default=low - 1) + 1, min(enough, default=high)
    return low


#: Where a null identifier stands in ties.
_LAST = (1 << 63) - 1


class Cut:
    """Where the draw ends: `drawn` rows, down to `score`, at that score up to identifier `last`; None if nothing is drawn."""

    def __init__(self, drawn: int, score: int, last: int) -> None:
        self.drawn, self.score, self.last = drawn, score, last

    def inside(self) -> Column:
        """Rows of the draw, and all further rows with the last one's score and identifier."""
        return (F.col("score") > self.score) | ((F.col("score") == self.score) & (_key() <= self.last))


def _key() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(_LAST))


def cut(scored: DataFrame, percent: int = PERCENT, least: int = LEAST) -> Cut | None:
    """The end of the draw of floor(percent * N / 100) of the N rows with `least` words."""
    rows = scored.filter(F.col("n_words") >= least)
    n, low, high = rows.agg(F.count("*"), F.min("score"), F.max("score")).first()
    wanted = percent * n // 100
    if not wanted:
        return None
    score = -bisect(rows, -F.col("score"), wanted, -high, -low)
    tied = rows.filter(F.col("score") == score)
    above, first, last = rows.agg(F.count(F.when(F.col("score") > score, 1)), F.min(F.when(F.col("score") == score, _key())), F.max(F.when(F.col("score") == score, _key()))).first()
    return Cut(wanted, score, bisect(tied, _key(), wanted - above, first, last))


def ranked(scored: DataFrame, end: Cut | None, least: int = LEAST) -> DataFrame:
    """The scores with `rank` (from 1 in the order of the draw, null if not drawn). `scored` is a written table."""
    spark, none = scored.sparkSession, F.lit(None).cast("long")
    if end is None:
        return scored.withColumn("rank", none)
    drawn = (F.col("n_words") >= least) & end.inside()
    order = [F.col("score").desc(), _key().asc(), F.col("n_features").asc(), F.col("nth").asc()]
    home = work_folder(spark, "draw")
    scored.filter(drawn).repartitionByRange(shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id()).write.parquet(home)
    parts = spark.read.parquet(home)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    counts = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    found = parts.join(F.broadcast(counts), "part").withColumn("rank", rank.cast("long")).withColumn("rank", F.when(F.col("rank") <= end.drawn, F.col("rank")))
    return found.select(*scored.columns, "rank").union(scored.filter(~drawn).withColumn("rank", none))


def _scored(docs: DataFrame, target: DataFrame, doc_id: str, text: str, size: int, buckets: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    gain = gains(bucket_counts(docs, text, size, buckets), bucket_counts(target, text, size, buckets))
    home = work_folder(docs.sparkSession, "scores")
    scores(docs, gain, doc_id, text, size, seed).write.parquet(home)
    return docs.sparkSession.read.parquet(home), gain


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, buckets: int = BUCKETS, seed: int = SEED,
             percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score, rank (null if not drawn). `target` has a column of the same
    name as `text`."""
    scored, _ = _scored(docs, target, doc_id, text, size, buckets, seed)
    return ranked(scored, cut(scored, percent, least), least).drop("nth")


def drawn(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, buckets: int = BUCKETS, seed: int = SEED,
          percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """The drawn documents themselves, with all their columns and in no order. They are scored again and filtered by the cut, so
    no text is shuffled, but for the rows that share the last one's score and identifier."""
    scored, gain = _scored(docs, target, doc_id, text, size, buckets, seed)
    end = cut(scored, percent, least)
    if end is None:
        return docs.limit(0)
    of = _scorer(gain, size, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            words, found, _, score = of(piece)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(words.astype(np.int64)), pa.array(found.astype(np.int64)), pa.array(score)], names=[*piece.schema.names, "n_words", "n_features", "score"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    rows = rows.mapInArrow(run, f"doc_id long, t string, row {kind}, n_words long, n_features long, score long").filter(F.col("n_words") >= least)
    at_end = (F.col("score") == end.score) & (_key() == end.last)
    surely = scored.filter((F.col("n_words") >= least) & end.inside() & ~at_end).count()
    return rows.filter(end.inside() & ~at_end).select("row.*").union(rows.filter(at_end).orderBy("n_features").limit(end.drawn - surely).select("row.*"))


def oracle() -> str:
    """The definitions in SQL, CRC-32 bit by bit over the distinct words."""
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = "(strpos('0123456789ABCDEF', substr(h, 2 * j + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, 2 * j + 2, 1)) - 1"
    found = lambda table: (
        "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM " + table)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {found('documents')}),
wanted AS (SELECT {found('benchmark')}),
d AS (SELECT r, unnest(ws) AS w FROM docs),
b AS (SELECT unnest(ws) AS w FROM wanted),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM d UNION SELECT w FROM b)),
bytes AS (SELECT w, list_transform(range(length(h) // 2), lambda j: {byte}) AS bs FROM hexed),
v AS MATERIALIZED (SELECT w, xor(list_reduce(bs, lambda a, x: list_reduce(range(8), lambda c, k: {bit}, xor(a, x)), 4294967295), 4294967295) % {BUCKETS} AS bucket FROM bytes),
s AS (SELECT bucket, count(*) AS s FROM d JOIN v USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS}) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})))) AS gain
  FROM s FULL JOIN t USING (bucket)),
weighed AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM d JOIN v USING (w) JOIN g USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((
  CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM docs LEFT JOIN weighed USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, {PERCENT} * count(*) OVER () // 100 AS drawn FROM scored WHERE n_features >= {LEAST})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM scored LEFT JOIN placed USING (r)
"""
