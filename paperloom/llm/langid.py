"""Language identification with hyperdimensional profiles.

Every letter has a seeded random vector of +1 and -1. An n-gram is bound by multiplying its letters'
vectors, each permuted (rotated) by its place; a text is bundled by adding the vectors of its n-grams; a
language's prototype is the bundle of its training texts. A text gets the language whose prototype has
the greatest cosine with its own bundle (ties: the first language by code point). All sums are whole
numbers, so results do not depend on the partitioning.

Letters are lower-cased; every run of other characters is one blank, which is a letter of its own, also
at both ends. Null texts and texts without a letter get `und` and score 0; so does every text if nothing
was learned. Texts of any length are read whole. Repeated rows count as often as they occur. Only the
named columns are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import ship_package

DIMENSIONS = 2048
GRAM = 3
SEED = 11
UNDECIDED = "und"
#: N-grams whose vectors a worker holds at a time.
_BATCH = 4096
#: Prototypes are sent to the workers; more languages than this are an error.
MAX_LANGUAGES = 2000


class Space:
    """Letter vectors and the bundles of texts."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = SEED) -> None:
        self.dimensions, self.gram, self.seed = dimensions, gram, seed
        self.known: dict[int, int] = {}
        self.letters = np.zeros((0, dimensions), np.int8)
        self.kind = np.full(0x110000, -1, np.int32)  # -1 unseen, 0 blank, else the lower-case letter

    def _codes(self, text: str) -> np.ndarray:
        """Code points of the letters in lower case, blanks (0) between and around them."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[points]
        if (kind < 0).any():
            for p in np.unique(points[kind < 0]).tolist():
                c = chr(p)
                self.kind[p] = ord(c.lower()[0]) if c.isalpha() else 0
            kind = self.kind[points]
        padded = np.concatenate([np.zeros(1, np.int32), kind, np.zeros(1, np.int32)])
        return padded[np.r_[True, (padded[1:] != 0) | (padded[:-1] != 0)]]

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams, as rows of code points packed in one number, and their counts."""
        codes = self._codes(text) if text else np.zeros(1, np.int32)
        if not codes.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes = codes.astype(np.int64)
        size = len(codes) - self.gram + 1
        packed = np.zeros(max(size, 1), np.int64)
        for i in range(self.gram):  # 21 bits hold a code point; three letters fit 63
            packed = (packed << 21) | codes[i : i + size]
        return np.unique(packed, return_counts=True)

    def vectors(self, packed: np.ndarray) -> np.ndarray:
        """One row of +1 and -1 per n-gram."""
        out = None
        for i in range(self.gram):
            codes = (packed >> (21 * (self.gram - 1 - i))) & 0x1FFFFF
            rows = np.roll(self._letters(codes), self.gram - 1 - i, axis=1)
            out = rows if out is None else out * rows
        return out

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        distinct, where = np.unique(codes, return_inverse=True)
        fresh = [c for c in distinct.tolist() if c not in self.known]
        if fresh:
            made = [np.random.default_rng([self.seed, c]).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1 for c in fresh]
            self.known.update({c: len(self.letters) + i for i, c in enumerate(fresh)})
            self.letters = np.concatenate([self.letters, np.stack(made).astype(np.int8)])
        return self.letters[[self.known[c] for c in distinct.tolist()]][where]

    def bundles(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """One bundle per text, from its n-grams and counts. The n-grams of all texts are bound once."""
        out = np.zeros((len(texts), self.dimensions), np.float64)
        sizes = [len(p) for p, _ in texts]
        if not sum(sizes):
            return out
        every, where = np.unique(np.concatenate([p for p, _ in texts]), return_inverse=True)
        row = np.repeat(np.arange(len(texts)), sizes)
        count = np.concatenate([c for _, c in texts])
        for at in range(0, len(every), _BATCH):
            part = every[at : at + _BATCH]
            held = (where >= at) & (where < at + len(part))
            # Sums of whole numbers far below 2^24 per text and n-gram block are exact in single precision.
            table = np.zeros((len(texts), len(part)), np.float32)
            table[row[held], where[held] - at] = count[held]
            out += table @ self.vectors(part).astype(np.float32)
        return out


def _in_groups(space: Space, texts: pa.Array, most: int = 256) -> Iterator[tuple[int, list]]:
    for at in range(0, len(texts), most):
        yield at, [space.grams(t.as_py()) for t in texts[at : at + most]]


def prototypes(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = SEED) -> dict[str, list[int]]:
    """Prototype per language, learned from all rows with a text and a language.

    Every task adds up its rows first; one row per task, language and block of dimensions is shuffled. The
    result has a fixed size per language."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(dimensions, gram, seed), {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for at, made in _in_groups(space, batch.column(0)):
                for name in set(langs[at : at + len(made)].tolist()):
                    own = [g for g, l in zip(made, langs[at : at + len(made)]) if l == name]
                    grams = np.concatenate([p for p, _ in own])
                    if not len(grams):
                        continue
                    # One pseudo-text per language: bundles are sums, so adding counts first is the same.
                    every, where = np.unique(grams, return_inverse=True)
                    counts = np.bincount(where, weights=np.concatenate([c for _, c in own])).astype(np.int64)
                    sums[name] = sums.get(name, 0) + _exact_bundle(space, every, counts)
        for name, vector in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(vector)], names=["lang", "i", "v"])

    rows = docs.select(F.col(text).cast("string"), F.col(lang).cast("string")).filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    summed = rows.mapInArrow(run, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    whole = summed.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("v"))
    found = whole.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {r["lang"]: r["v"] for r in found if any(r["v"])}


def _exact_bundle(space: Space, every: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(space.dimensions, np.int64)
    for at in range(0, len(every), _BATCH):
        out += (counts[at : at + _BATCH].astype(np.float64) @ space.vectors(every[at : at + _BATCH]).astype(np.float64)).astype(np.int64)
    return out


def identify(docs: DataFrame, learned: dict[str, list[int]], doc_id: str = "doc_id", text: str = "text", dimensions: int = DIMENSIONS, gram: int = GRAM,
             seed: int = SEED) -> DataFrame:
    """`doc_id`, `lang_pred`, `score` (the cosine, at least 0)."""
    ship_package(docs.sparkSession)
    names = sorted(learned)
    matrix = np.array([learned[n] for n in names], np.float64).reshape(len(names), dimensions)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(dimensions, gram, seed)
        for batch in batches:
            langs, scores = [], []
            for _, made in _in_groups(space, batch.column(1)):
                bundles = space.bundles(made)
                size = np.linalg.norm(bundles, axis=1)
                for (grams, _), vector, length in zip(made, bundles, size):
                    near = np.round(matrix @ vector / length, 9) if len(grams) and names and length else None
                    best = None if near is None else int(np.argmax(near))
                    langs.append(UNDECIDED if best is None else names[best])
                    scores.append(0.0 if best is None else float(min(max(near[best], 0.0), 1.0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, lang_pred string, score double")


