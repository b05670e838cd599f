"""Quality classifier: support vectors over naive Bayes features.

Features are n-gram indicators hashed into BUCKETS: words and word pairs, and runs of one to three word
shapes. A shape keeps the kinds of characters of a word (capital, small letter, digit, each other sign;
runs shortened) and whether the word repeats the one before it. An indicator is scaled by the log ratio
of its smoothed counts in good and bad training documents, and a row by the root of its number of
features. A linear hinge-loss model is fitted by dual coordinate descent, and its margin is turned into a
probability by a logistic curve fitted on training rows kept aside and weighed by the true class sizes.

Training rows: the first PER_CLASS rows of each class in a seeded order of identifiers. This bound keeps
the sample within one task; scoring covers every row. Labels of an identifier that disagree are left out,
null labels and identifiers too. With one class only the score is that class; without labels it is 0.5.

Null texts count as empty: they have no feature and get the score of the bias. Texts of any length are
read whole. Repeated rows get equal scores, empty tables give empty results. The input row is carried as
one struct, so its column names are free.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import ship_package

BUCKET_BITS = 18
PER_CLASS = 8_000
EPOCHS = 12
COST = 1.0
SMOOTH = 1.0
SEED = 5
THRESHOLD = 0.3
#: Words whose features a worker remembers at a time.
_REMEMBER = 300_000


def _kind(c: str) -> str:
    return "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c


def shape(word: str) -> str:
    """`Hello!!!` -> `Aa+!+`: kinds of characters, a run of more than one marked by +."""
    out: list[str] = []
    for c in word:
        k = _kind(c)
        if out and out[-1] == k:
            out.append("+")
        elif not (len(out) > 1 and out[-1] == "+" and out[-2] == k):
            out.append(k)
    return "".join(out)


class Features:
    """Indices of a text's features. Words met before are looked up."""

    def __init__(self, bits: int = BUCKET_BITS) -> None:
        self.bits = bits
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.word, self.shape = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)

    def _learn(self, words: list[bytes]) -> None:
        if len(self.number) > _REMEMBER:
            self._forget()
        for w in set(words):
            if w not in self.number:
                i = self.number[w] = len(self.number)
                if i == len(self.word):
                    self.word, self.shape = np.resize(self.word, 2 * i), np.resize(self.shape, 2 * i)
                text = w.decode("utf-8", "surrogatepass")
                self.word[i] = zlib.crc32(text.lower().encode("utf-8", "surrogatepass"))
                self.shape[i] = zlib.crc32(shape(text).encode("utf-8", "surrogatepass"))

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if not words:
            return np.zeros(0, np.int32)
        try:
            at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        except KeyError:
            self._learn(words)
            at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        w, s = self.word[at], self.shape[at]
        s = s * np.uint64(2)
        s[1:] += (w[1:] == w[:-1]).astype(np.uint64)
        p = np.uint64(0x9E3779B97F4A7C15)
        pair, pairs = w[:-1] * p + w[1:], s[:-1] * p + s[1:]
        kinds = [w, pair, s, pairs, pairs[:-1] * p + s[2:]]
        mixed = np.concatenate([(k + np.uint64(i + 1)) * p ^ ((k + np.uint64(i + 1)) * p >> np.uint64(29)) for i, k in enumerate(kinds)]) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique((mixed >> np.uint64(64 - self.bits)).astype(np.int32))


def descend(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, size: int, cost: float = COST, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model by dual coordinate descent. Labels are +1 and -1; each row
    has its own cost so that both classes weigh alike. The bias is a constant feature."""
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for v in values])
    share = {1: max((labels > 0).mean(), 1e-9), -1: max((labels < 0).mean(), 1e-9)}
    upper = np.array([cost * 0.5 / share[int(y)] for y in labels])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)).tolist():
            x, v, y = rows[i], values[i], labels[i]
            gradient = y * (w[x] @ v + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), upper[i])
            step = (new - alpha[i]) * y
            if step:
                alpha[i] = new
                w[x] += step * v
                bias += step
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def logistic(margins: np.ndarray, good: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of the probability of good, by damped Newton steps on smoothed targets."""
    n1, n0 = weight[good].sum(), weight[~good].sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        ga, gb = g @ margins + 1e-3 * (a - 1), g.sum()
        haa, hab, hbb = h @ margins**2 + 1e-3, h @ margins, h.sum()
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - scale * da, b - scale * db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)


def fit(rows: list[np.ndarray], good: np.ndarray, sizes: tuple[int, int], bits: int = BUCKET_BITS) -> tuple[np.ndarray, float]:
    """Weight per feature and offset, slope included: the score is the logistic of their sum over the root
    of the number of features. `sizes`: bad and good rows in all."""
    size = 1 << bits
    aside = np.arange(len(rows)) % 5 == 4
    if len(set(good[aside])) < 2 or len(set(good[~aside])) < 2:
        aside[:] = False
    train = np.flatnonzero(~aside)
    counts = np.full((2, size), SMOOTH)
    for i in train:
        counts[int(good[i]), rows[i]] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    values = [ratio[x] / max(len(x), 1) ** 0.5 for x in rows]
    w, bias = descend([rows[i] for i in train], [values[i] for i in train], np.where(good[train], 1.0, -1.0), size)
    check = np.flatnonzero(aside) if aside.any() else train
    margins = np.array([w[rows[i]] @ values[i] + bias for i in check])
    weight = np.where(good[check], sizes[1] / max(good[check].sum(), 1), sizes[0] / max((~good[check]).sum(), 1))
    slope, offset = logistic(margins, good[check], weight * len(check) / weight.sum())
    return (w * ratio * slope).astype(np.float32), slope * bias + offset


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS,
          bits: int = BUCKET_BITS) -> tuple[np.ndarray, float]:
    """The model from the labelled rows given (callers leave the held-out ones away)."""
    ship_package(docs.sparkSession)
    agreed = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("good")).filter("id is not null and good in (0, 1)") \
        .groupBy("id").agg(F.min("good").alias("good"), F.max("good").alias("most")).filter("good = most").drop("most")
    sizes = {r["good"]: r["n"] for r in agreed.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        only = {0: -30.0, 1: 30.0}.get(next(iter(sizes), None), 0.0)
        return np.zeros(1 << bits, np.float32), only
    place = F.xxhash64(F.lit(SEED), "id")
    picked = [agreed.filter(F.col("good") == g).orderBy(place, "id").limit(per_class) for g in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * per_class rows of 12 bytes
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).join(sample, "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(bits)
        for batch in batches:
            found = [make(t.as_py()).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["place", "good", "x"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        # Repeated identifiers would break the bound of the sample: one row of each stays.
        pdf = pdf.sort_values(["place", "x"]).drop_duplicates("place")
        found = [np.frombuffer(x, np.int32) for x in pdf["x"]]
        if pdf["good"].nunique() < 2:
            w, b = np.zeros(1 << bits, np.float32), 0.0
        else:
            w, b = fit(found, pdf["good"].to_numpy() == 1, (sizes[0], sizes[1]), bits)
        return pd.DataFrame({"w": [w.tobytes()], "b": [float(b)]})

    made = rows.select(place.alias("place"), "good", "t").mapInArrow(features, "place long, good int, x binary")
    once = made.groupBy("place").agg(F.first("good").alias("good"), F.min("x").alias("x"))
    got = once.groupBy().applyInPandas(learn, "w binary, b double").collect()
    if not got:
        return np.zeros(1 << bits, np.float32), 0.0
    return np.frombuffer(got[0]["w"], np.float32), got[0]["b"]


def scorer(docs: DataFrame, model: tuple[np.ndarray, float], bits: int = BUCKET_BITS):
    """A column function: text -> probability of good quality."""
    ship_package(docs.sparkSession)
    weights = docs.sparkSession.sparkContext.broadcast(model[0])
    offset = float(model[1])

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        make, w = Features(bits), weights.value
        for texts in batches:
            found = (make(t) for t in texts)
            sums = np.array([w[x].sum(dtype=np.float64) / max(len(x), 1) ** 0.5 for x in found] or [], np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums + offset, -30, 30))))

    return score


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """`row` (the input row) and its `score`."""
    score: Column = scorer(docs, model)(F.col(f"`{text}`").cast("string"))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), score.alias("score"))
