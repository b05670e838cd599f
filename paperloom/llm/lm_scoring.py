"""Cross-entropy difference of a target and a background language model.

Tokens are words (runs of non-blanks) with A-Z lower-cased. Vocabulary: the words that make up at least
WORD_SHARE of all tokens of the corpus, hence at most 1 / WORD_SHARE of them; every other word is one
unknown token. Both models use this vocabulary and the same word pairs: those that make up at least
PAIR_SHARE of all pairs of the corpus (at most 1 / PAIR_SHARE of them). The first token of a document
follows a start token. The background is the whole corpus, the target a subset of its documents; the
background's counts are scaled to the target's number of tokens, so the smoothing weighs alike in both.

    p1(w)   = (c(w) + ADD) / (N + ADD * (vocabulary + 1))
    p(w|h)  = (c(h, w) + PRIOR * p1(w)) / (c(h) + PRIOR),   c(h) the sum of the kept pairs after h

A document's score is the mean over its tokens of log p(background) - log p(target): negative where it is
more like the target. Counts cover all documents; every task adds up its own first. The models have a
fixed largest size and are sent to the scoring tasks, which read each text once and shuffle nothing.

`score_whole` has no shares: every word and every pair of the corpus is in the models, which grow with it.
They are written tables, and a document's distinct pairs are joined to them; nothing is brought to the driver
but three sums.

Null and empty texts have no token and null scores. Texts of any length are read whole. Repeated rows
count as often as they occur; a document is in the target if its identifier is. An empty target or
corpus gives equal models and scores of 0. Further columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import n_words
from paperloom.session import cut_lineage, shared_folder, ship_package

WORD_SHARE = 2.0**-16
PAIR_SHARE = 2.0**-19
ADD = 0.5
PRIOR = 8.0
#: Distinct entries a task holds before it hands on its sums.
_HOLD = 1 << 18


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """`word` (bytes), `n`."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words, counts = pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())
            held.clear()
            for at in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([words[at : at + 50_000], counts[at : at + 50_000]], names=["word", "n"])

        for batch in batches:
            for value in batch.column(0):
                held.update(tokens(value.as_py()))
                if len(held) > _HOLD:
                    yield from out()
        yield from out()

    return docs.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, "word binary, n long") \
        .groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, share: float) -> list[bytes]:
    """The kept words by falling count, then by bytes."""
    total = counts.agg(F.sum("n").alias("all"))
    kept = counts.filter(F.col("n") >= share * total.scalar())
    rows = kept.collect()  # at most 1 / share rows
    return [bytes(r["word"]) for r in sorted(rows, key=lambda r: (-r["n"], bytes(r["word"])))]


def _kind(unknown: int) -> np.dtype:
    return np.dtype("<u2") if unknown < 1 << 16 else np.dtype("<u4")


def encode(docs: DataFrame, words: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`id`, `codes`: a document's token numbers packed two bytes each (four for very large vocabularies)."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    unknown, kind = len(words), _kind(len(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = sent.value
        for batch in batches:
            packed = [np.array([numbers.get(w, unknown) for w in tokens(t.as_py())], kind).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["id", "codes"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, "id long, codes binary")


def _line(packed: list[np.ndarray], unknown: int) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of the documents one after the other, each preceded by the start token; the lengths."""
    start = np.array([unknown + 1], np.int64)
    lengths = np.array([len(p) for p in packed], np.int64)
    return np.concatenate([x for p in packed for x in (start, p)] or [start[:0]]).astype(np.int64), lengths


def pair_counts(encoded: DataFrame, unknown: int) -> DataFrame:
    """`pair` (history * (vocabulary + 2) + word), `n` in all rows, `t` in rows of the target. `encoded`:
    codes, target. Every task adds up its own pairs before they are shuffled."""
    ship_package(encoded.sparkSession)
    base, kind = unknown + 2, _kind(unknown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            # A pair and the flag of the target in one number, so one sort adds up both.
            every, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            pairs, first = np.unique(every >> 1, return_index=True)
            n = np.add.reduceat(counts, first) if len(first) else counts
            t = np.add.reduceat(np.where(every & 1, counts, 0), first) if len(first) else counts
            for at in range(0, len(pairs), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]) for x in (pairs, n, t)], names=["pair", "n", "t"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                codes, lengths = _line([np.frombuffer(x.as_buffer(), kind) for x in part.column(0)], unknown)
                flags = np.repeat(np.array(part.column(1).to_pylist(), np.int64), lengths + 1)
                where = np.flatnonzero(codes != unknown + 1)
                held.append(((codes[where - 1] * base + codes[where]) << 1) | flags[where])
                size += len(where)
                if size > 8 * _HOLD:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    rows = encoded.select("codes", F.col("target").cast("int").alias("f"))
    return rows.mapInArrow(run, "pair long, n long, t long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


class Model:
    """Log probabilities of both models: of kept pairs, of words, and of falling back after a history."""

    def __init__(self, size: int, pairs: np.ndarray, n: np.ndarray, t: np.ndarray, word_n: np.ndarray, word_t: np.ndarray) -> None:
        self.base = size + 2
        order = np.argsort(pairs)
        self.pairs = pairs[order]
        history, word = self.pairs // self.base, self.pairs % self.base
        total_n, total_t = word_n.sum(), word_t.sum()
        scale = total_t / total_n if total_n and total_t else 1.0
        self.word, self.back, self.pair = [], [], []
        for counts, words, factor in ((t[order], word_t, 1.0), (n[order], word_n, scale)) if total_t else ((n[order], word_n, 1.0),) * 2:
            single = (words * factor + ADD) / (words.sum() * factor + ADD * (size + 1))
            after = np.bincount(history, weights=counts * factor, minlength=self.base)
            self.word.append(np.log(single))
            self.back.append(np.log(PRIOR / (after + PRIOR)))
            self.pair.append(np.log((counts * factor + PRIOR * single[word]) / (after[history] + PRIOR)))

    def losses(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per position after the first: minus the log probability in the target and in the background."""
        history, word = codes[:-1], codes[1:]
        wanted = history * self.base + word
        at = np.searchsorted(self.pairs, wanted)
        at[at == len(self.pairs)] = 0
        hit = self.pairs[at] == wanted if len(self.pairs) else np.zeros(len(wanted), bool)
        out = []
        safe = np.minimum(word, self.base - 2)  # the start token is never predicted; callers leave it out
        for single, back, pair in zip(self.word, self.back, self.pair):
            value = single[safe] + back[history]
            value[hit] = pair[at[hit]]
            out.append(-value)
        return out[0], out[1]


def fit(docs: DataFrame, target_ids: DataFrame, doc_id: str = "doc_id", text: str = "text", word_share: float = WORD_SHARE,
        pair_share: float = PAIR_SHARE) -> tuple[list[bytes], Model]:
    """Vocabulary and models. `target_ids`: one column of identifiers of the target's documents."""
    words = vocabulary(word_counts(docs, text), word_share)
    ids = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("target_id")).filter("target_id is not null").distinct()
    # Neither side has a bound, so the join is a merge at every size; token numbers travel instead of texts.
    marked = encode(docs, words, doc_id, text).join(ids.hint("merge"), F.col("id") == F.col("target_id"), "left")
    pairs = cut_lineage(pair_counts(marked.select("codes", F.col("target_id").isNotNull().alias("target")), len(words)))
    base = len(words) + 2
    # The words' own counts follow from the pairs; at most one row per word.
    singles = pairs.groupBy((F.col("pair") % base).alias("w")).agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toPandas()
    word_n, word_t = np.zeros(base - 1), np.zeros(base - 1)
    word_n[singles["w"]], word_t[singles["w"]] = singles["n"], singles["t"]
    kept = pairs.filter(F.col("n") >= F.lit(pair_share * word_n.sum())).toPandas()  # at most 1 / pair_share rows
    return words, Model(len(words), kept["pair"].to_numpy(np.int64), kept["n"].to_numpy(np.float64), kept["t"].to_numpy(np.float64), word_n, word_t)


def score(docs: DataFrame, words: list[bytes], model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `n_tokens`, `target_loss`, `background_loss` (means per token) and their difference `score`."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(words)}, model))
    unknown = len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, fitted = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                codes, lengths = _line([np.array([numbers.get(w, unknown) for w in tokens(t.as_py())], np.int64) for t in part.column(1)], unknown)
                inside = np.flatnonzero(codes[1:] != unknown + 1)
                owner = np.repeat(np.arange(len(lengths)), lengths)
                target, background = (np.bincount(owner, weights=x[inside], minlength=len(lengths)) for x in fitted.losses(codes))
                none = lengths == 0
                mean = [np.divide(x, lengths, out=np.zeros(len(lengths)), where=~none) for x in (target, background)]
                columns = [pa.array(x, pa.float64(), mask=none) for x in (*mean, mean[0] - mean[1])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths), *columns], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def whole_counts(texts: DataFrame) -> DataFrame:
    """`h`, `w` (bytes; no history is empty: the start), `n` in all rows, `t` in rows of the target. `texts`: t,
    target. Every task adds up its own pairs before they are shuffled."""
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter = Counter()
        inside: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            held = [([h for h, _ in every], [w for _, w in every], list(every.values()), [inside[p] for p in every])] if every else []
            every.clear()
            inside.clear()
            for columns in held:
                for at in range(0, len(columns[0]), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000], k) for c, k in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=["h", "w", "n", "t"])

        for batch in batches:
            for text, target in zip(batch.column(0), batch.column(1)):
                found = tokens(text.as_py())
                every.update(zip([b"", *found], found))
                if target.as_py():
                    inside.update(zip([b"", *found], found))
                if len(every) > _HOLD:
                    yield from out()
        yield from out()

    return texts.select("t", "target").mapInArrow(run, "h binary, w binary, n long, t long").groupBy("h", "w").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def whole_losses(counts: DataFrame) -> DataFrame:
    """`h`, `w`, `target_loss`, `background_loss`: of every pair of `counts`. As no pair is left out, none falls back."""
    words = counts.groupBy("w").agg(F.sum("n").alias("wn"), F.sum("t").alias("wt"))
    after = counts.groupBy("h").agg(F.sum("n").alias("hn"), F.sum("t").alias("ht"))
    size, all_n, all_t = words.agg(F.count("w"), F.coalesce(F.sum("wn"), F.lit(0)), F.coalesce(F.sum("wt"), F.lit(0))).first()
    scale = all_t / all_n if all_t else 1.0

    def loss(n: str, w: str, h: str, total: int, factor: float) -> Column:
        single = (F.col(w) * factor + ADD) / (total * factor + ADD * (size + 1))
        return F.log(F.col(h) * factor + PRIOR) - F.log(F.col(n) * factor + PRIOR * single)

    background = loss("n", "wn", "hn", all_n, scale)
    target = loss("t", "wt", "ht", all_t, 1.0) if all_t else background
    return counts.join(words, "w").join(after, "h").select("h", "w", target.alias("target_loss"), background.alias("background_loss"))


def score_whole(docs: DataFrame, target_ids: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of `score`, by models of all words and all pairs of the corpus."""
    spark = docs.sparkSession
    ship_package(spark)
    body = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.xxhash64(body).alias("digest"), body.alias("t"))
    ids = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("target_id")).filter("target_id is not null").distinct()
    marked = rows.join(ids, F.col("id") == F.col("target_id"), "left").select("t", F.col("target_id").isNotNull().alias("target"))
    at = f"{shared_folder(spark)}/lm-{uuid.uuid4().hex}"
    whole_counts(marked).write.option("compression", "zstd").parquet(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"id": pa.int64(), "digest": pa.int64(), "h": pa.binary(), "w": pa.binary(), "m": pa.int64()}
        held: list[list] = [[] for _ in kinds]

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds.values())], names=list(kinds))
            for c in held:
                c.clear()
            return made

        for batch in batches:
            for own, digest, value in zip(*(batch.column(i) for i in range(3))):
                found = tokens(value.as_py())
                # A long text leaves in parts; their sums are added up with the others.
                for start in range(0, len(found), 1 << 16):
                    words = found[start : start + (1 << 16)]
                    pairs = Counter(zip([found[start - 1] if start else b"", *words], words))
                    for c, more in zip(held, ([own.as_py()] * len(pairs), [digest.as_py()] * len(pairs), [h for h, _ in pairs], [w for _, w in pairs], pairs.values())):
                        c.extend(more)
                    if len(held[0]) > 20_000:
                        yield out()
        if held[0]:
            yield out()

    met = rows.mapInArrow(run, "id long, digest long, h binary, w binary, m long").join(whole_losses(spark.read.parquet(at)), ["h", "w"])
    # Rows of one identifier and one text add up to the same means, however many they are.
    sums = met.groupBy("id", "digest").agg(F.sum("m").alias("m"), *[F.sum(F.col(c) * F.col("m")).alias(c) for c in ("target_loss", "background_loss")])
    means = sums.select(F.col("id").alias("id_"), F.col("digest").alias("digest_"), *[(F.col(c) / F.col("m")).alias(c) for c in ("target_loss", "background_loss")])
    given = rows.select("id", "digest", n_words(F.col("t")).alias("n_tokens"))
    return given.join(means, F.col("id").eqNullSafe(F.col("id_")) & (F.col("digest") == F.col("digest_")), "left").select(
        F.col("id").alias("doc_id"), "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))


def oracle(word_share: float = WORD_SHARE, pair_share: float = PAIR_SHARE) -> str:
    """The same scores for DuckDB, with documents labelled 1 for quality as the target."""
    return f"""
WITH src AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t,
  doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS tgt FROM documents),
lists AS (SELECT r, tgt, regexp_extract_all(t, '[^ \\x09-\\x0D]+') AS w FROM src),
raw AS (SELECT r, tgt, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM lists),
vocab AS MATERIALIZED (SELECT w FROM raw GROUP BY w HAVING count(*) >= {word_share!r} * (SELECT count(*) FROM raw)),
tok AS MATERIALIZED (SELECT r, coalesce(tgt, false) AS tgt, i, coalesce(v.w, ' unknown') AS w FROM raw LEFT JOIN vocab v USING (w)),
seq AS MATERIALIZED (SELECT r, tgt, w, coalesce(lag(w) OVER (PARTITION BY r ORDER BY i), ' start') AS h FROM tok),
single AS MATERIALIZED (SELECT w, count(*) AS n, sum(CASE WHEN tgt THEN 1 ELSE 0 END) AS t FROM seq GROUP BY w),
tot AS MATERIALIZED (SELECT sum(n) AS n, CASE WHEN sum(t) > 0 THEN sum(t) ELSE sum(n) END AS t, sum(t) AS real_t, (SELECT count(*) FROM vocab) AS v FROM single),
pairs AS MATERIALIZED (SELECT h, w, count(*) AS n, sum(CASE WHEN tgt THEN 1 ELSE 0 END) AS t FROM seq GROUP BY h, w HAVING count(*) >= {pair_share!r} * (SELECT n FROM tot)),
after AS MATERIALIZED (SELECT h, sum(n) AS n, sum(t) AS t FROM pairs GROUP BY h),
p1 AS MATERIALIZED (SELECT w, (single.t + {ADD}) / (tot.t + {ADD} * (v + 1)) AS pt, (single.n * (tot.t / tot.n) + {ADD}) / (tot.t + {ADD} * (v + 1)) AS pb FROM single, tot),
scored AS (SELECT seq.r, -ln((coalesce(pairs.t, 0) + {PRIOR} * pt) / (coalesce(after.t, 0) + {PRIOR})) AS lt,
  -ln((coalesce(pairs.n, 0) * (tot.t / tot.n) + {PRIOR} * pb) / (coalesce(after.n, 0) * (tot.t / tot.n) + {PRIOR})) AS lb
  FROM seq JOIN p1 USING (w) LEFT JOIN pairs ON pairs.h = seq.h AND pairs.w = seq.w LEFT JOIN after ON after.h = seq.h, tot)
SELECT doc_id, CAST(count(lt) AS BIGINT) AS n_tokens, round(avg(lt), 6) AS target_loss, round(avg(lb), 6) AS background_loss, round(avg(lt) - avg(lb), 6) AS score
FROM src LEFT JOIN scored USING (r) GROUP BY r, doc_id
"""
