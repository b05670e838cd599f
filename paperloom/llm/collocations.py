"""Phrases that occur together more than their parts do, from FM-indexes over word ids.

Text is lower-cased (A-Z), cut into pieces and words; a phrase is a run of 2 to 4 words inside a piece. All
counts are per language (null: `und`). The corpus is dealt into shards of about SHARD words, and every shard
is indexed by itself:

* `TwoWay` is a bidirectional FM-index, depth-limited: the Burrows-Wheeler transforms of the shard's word ids and
  of their reverse, each sorted by as many words as a phrase may have. A phrase is an interval in both. One
  step extends every phrase of a length by all its left words at once, another by all its right words; a longer
  phrase is kept if both of its shorter parts reach it, so each longer phrase comes with its prefix and suffix.
* Counts of a phrase are the sums of its interval sizes over the shards. As no phrase is more frequent than its
  parts, the shards go on with the phrases that reached `least` in the whole corpus: first frequent words (all
  others become cuts), then frequent pairs (all other pairs become cuts), then triples and quadruples at once.
  Nothing else is left out, so all counts are exact.

A word's number outside its shard (`gid`) is the first shard that has it and its number there, never a hash. Words
and pairs meet once, in a window over all shards that tells each its sum; every shard gets back only its own
surviving ones, and no dictionary is sent to all tasks. Memory of a task grows with a shard (SHARD words and the
document that fills it), not with the corpus; a word or pair has one row per shard at most, and the window spills.

For a phrase with count a cut after k words, l and r count its parts: score floor(2000000 a / (l + r)), the least
over the cuts. A phrase goes if some longer candidate contains it and has at least `share` percent of its count.
(It is enough to look one word further: what lies between has at least the longer one's count.)

Null and empty texts have no words. Texts of any length are read whole. Repeated rows count as often as they occur;
their phrases are within the counts like all others. Ties in score and count are broken by the phrase. An empty
table gives no rows. Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import shuffle_partitions
from paperloom.session import discard, ship_package, work_folder

LEAST = 30
SHARE = 80
TOP = 2000
#: Words of a shard; it ends after the documents that fill it.
SHARD = 1 << 21
#: Bits of a word's number inside its shard, and of a shard's number inside its task.
_CODE, _NUMBER = 31, 10
#: Documents read at a time while a shard fills.
_DOCS = 500
#: Parts into which a language's candidates are dealt before its first ones are chosen.
_DEALT = 64
NO_LANGUAGE = "und"

# What a byte of a text is: 0 part of a word, 1 blank, 2 end of a piece. UTF-8 bytes above 127 are parts of words.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _sorted_order(keys: np.ndarray, top: int) -> np.ndarray:
    """Positions in the order of their keys (below `top`), equal keys by position."""
    n = len(keys)
    if top * max(n, 1) < 1 << 62:  # key and position in one number sort without an index
        return np.sort(keys * n + np.arange(n)) % max(n, 1)
    return np.argsort(keys, kind="stable")


class _OneWay:
    """Transform, first positions and ranks of one direction."""

    def __init__(self, codes: np.ndarray, size: int, depth: int) -> None:
        n = len(codes)
        rank, top, reach = codes.astype(np.int64), size, 1
        while reach < depth:  # the order by 2, then 4 words
            after = np.zeros(n, np.int64)
            after[:-reach] = rank[reach:] + 1
            keys = rank * (top + 1) + after
            if 2 * reach >= depth:
                break
            order = _sorted_order(keys, top * (top + 1))
            new = np.r_[False, np.diff(keys[order]) != 0].cumsum()
            rank[order], top, reach = new, int(new[-1]) + 1 if n else 1, 2 * reach
        order = _sorted_order(keys, top * (top + 1)) if depth > 1 else _sorted_order(rank, top)
        self.first = np.r_[0, np.bincount(codes, minlength=size).cumsum()]
        self.last = codes[order - 1].astype(np.int64)  # the word before each sorted position
        # Occurrences by word, then by place: the rank of a word before a place is a search in them.
        self.n = max(n, 1)
        self.places = np.sort(self.last * self.n + np.arange(n))

    def start(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Backward step: where the interval of word + phrase starts, of phrases whose interval starts `at`."""
        return self.first[words] + np.searchsorted(self.places, words * self.n + at) - self.first[words]


class Phrases:
    """Intervals of phrases of one length: start in the forward and in the reverse order, and size."""

    def __init__(self, lo: np.ndarray, back: np.ndarray, size: np.ndarray) -> None:
        self.lo, self.back, self.size = lo, back, size


class TwoWay:
    """The bidirectional index of a shard. `codes`: word numbers from 1, 0 between pieces; phrases hold no 0."""

    def __init__(self, codes: np.ndarray, size: int, depth: int) -> None:
        self.size = size
        codes = np.append(codes, codes.dtype.type(0))  # what comes before the first word is a cut
        self.forward = _OneWay(codes, size, depth)
        self.reverse = _OneWay(codes[::-1], size, depth)

    def words(self) -> Phrases:
        """All single words, in the order of their numbers."""
        first = self.forward.first
        present = np.flatnonzero(np.diff(first)[1:]) + 1
        return Phrases(first[present], first[present], np.diff(first)[present])

    def _extended(self, side: _OneWay, lo: np.ndarray, back: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """All one-word extensions through the transform of a side: parent, start on that side, start on the other, size."""
        ends = size.cumsum()
        at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size - lo, size)
        keys = np.sort(np.repeat(np.arange(len(lo)), size) * self.size + side.last[at])
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        count = np.diff(np.r_[new, len(keys)])
        parent, word = keys[new] // self.size, keys[new] % self.size
        smaller = new - (ends - size)[parent]  # occurrences of the parent before words with lower numbers
        keep = word > 0
        parent, word, count, smaller = parent[keep], word[keep], count[keep], smaller[keep]
        return parent, side.start(word, lo[parent]), back[parent] + smaller, count

    def left(self, of: Phrases) -> tuple[np.ndarray, Phrases]:
        parent, lo, back, size = self._extended(self.forward, of.lo, of.back, of.size)
        return parent, Phrases(lo, back, size)

    def right(self, of: Phrases) -> tuple[np.ndarray, Phrases]:
        parent, back, lo, size = self._extended(self.reverse, of.back, of.lo, of.size)
        return parent, Phrases(lo, back, size)

    def longer(self, of: Phrases) -> tuple[np.ndarray, np.ndarray, Phrases]:
        """The phrases one word longer that the given ones reach from both ends: positions of the prefix and of the
        suffix among the given ones, and the intervals."""
        suffix, grown = self.left(of)
        prefix, other = self.right(of)
        _, i, j = np.intersect1d(grown.lo, other.lo, assume_unique=True, return_indices=True)
        return prefix[j], suffix[i], Phrases(grown.lo[i], grown.back[i], grown.size[i])


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts in order (bytes), whether a word opens a piece, and its text's number."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0] if len(offsets) else offsets
    kind = _KIND[data]
    inside = kind == 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    opens[edges] = inside[edges]  # a word ends with its text
    starts = np.flatnonzero(opens)
    at = np.r_[inside.cumsum()[starts] - 1, np.count_nonzero(inside)] if len(starts) else np.zeros(1, np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(_LOWER[data[inside]])])
    text = np.searchsorted(bounds, starts, side="right") - 1
    cuts = (kind == 2).cumsum()[starts]
    new = np.r_[True, (np.diff(cuts) > 0) | (np.diff(text) > 0)][: len(starts)]
    return words, new, text


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers as compressed bytes, their low bytes together, then the next ones, and so on."""
    planes = numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T
    return zstandard.compress(planes.tobytes(), 3)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _shard(parts: list[tuple]) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """One shard of (words with a dictionary, opens, languages) parts: codes from 1 with 0 before every piece; per code its
    word, the number of its language, and its count."""
    words = pa.chunked_array([p[0] for p in parts]).unify_dictionaries()
    tongues = 1 + max(int(p[2].max()) for p in parts)
    key = np.concatenate([c.indices.to_numpy().astype(np.int64) for c in words.chunks])
    key *= tongues
    key += np.concatenate([p[2] for p in parts])
    if tongues <= 64:  # few languages: one count per possible pair
        counts = np.bincount(key)
        kinds = np.flatnonzero(counts)
        counts, number = counts[kinds], np.zeros(len(counts), np.int32)
        number[kinds] = np.arange(1, len(kinds) + 1)
        codes = number[key]
    else:
        kinds, codes, counts = np.unique(key, return_inverse=True, return_counts=True)
        codes = (codes + 1).astype(np.int32)
    opens = np.concatenate([p[1] for p in parts])
    out = np.zeros(len(codes) + int(opens.sum()), np.int32)
    out[np.arange(len(codes)) + opens.cumsum()] = codes
    return out, words.chunk(0).dictionary.take(pa.array(kinds // tongues)), kinds % tongues, counts


_SHARDS = "shard long, codes binary, code int, lang string, word string, n long"


def shards(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = SHARD) -> DataFrame:
    """Per shard one row with its `codes`, and one row per distinct (language, word) of the shard: its `code`, `lang`, `word`, `n`."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << _NUMBER
        number, parts, held = first, [], 0
        known: dict[str, int] = {}

        def close() -> Iterator[pa.RecordBatch]:
            codes, words, tongues, counts = _shard(parts)
            parts.clear()
            names = list(known)
            yield _rows(_SHARDS, shard=[number], codes=[_packed(codes)])
            for at in range(0, len(words), 100_000):
                part = slice(at, at + 100_000)
                yield _rows(_SHARDS, shard=np.full(len(counts[part]), number), code=np.arange(at, at + len(counts[part]), dtype=np.int32) + 1,
                            lang=[names[i] for i in tongues[part].tolist()], word=words[part].cast(pa.large_string()).cast(pa.string()), n=counts[part])

        for batch in batches:
            for at in range(0, batch.num_rows, _DOCS):
                piece = batch.slice(at, _DOCS)
                words, opens, which = split_words(piece.column(0))
                if not len(words):
                    continue
                langs = np.array([known.setdefault(x, len(known)) for x in piece.column(1).to_pylist()], np.int32)
                parts.append((words.dictionary_encode(), opens, langs[which]))
                held += len(words)
                if held >= size:
                    yield from close()
                    pa.default_memory_pool().release_unused()
                    number, held = number + 1, 0
                    if number - first == 1 << _NUMBER:
                        raise ValueError(f"a task reads more than {1 << _NUMBER} shards; split its input or raise `size`")
        if parts:
            yield from close()

    return docs.select(F.col(f"`{text}`").cast("string").alias("t"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANGUAGE)).alias("l")).mapInArrow(run, _SHARDS)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _rows(schema: str, **columns) -> pa.RecordBatch:
    """A batch of the given columns; the others are null."""
    n = len(next(iter(columns.values())))
    fields = [f.split() for f in schema.split(", ")]
    made = [pa.nulls(n, _TYPES[t]) if c not in columns else columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], _TYPES[t]) for c, t in fields]
    return pa.RecordBatch.from_arrays(made, names=[c for c, _ in fields])


def _without_runs_of_cuts(codes: np.ndarray) -> np.ndarray:
    """One 0 where there were several, none around words that are alone in their piece."""
    word = np.r_[False, codes != 0, False]
    word[1:-1] &= word[:-2] | word[2:]
    keep = word[1:-1] | word[:-2]
    return np.where(word[1:-1], codes, 0)[keep]


_PAIRS = "shard long, codes binary, gids binary, p long, s long, n long"


def _pairs_of_shard(left: pa.Table, right: pa.Table) -> pa.Table:
    """A shard's codes with only the frequent words, and its pairs of them (`p`, `s`: numbers of the words, `n`)."""
    if not left.num_rows or not right.num_rows:
        return pa.Table.from_batches([_rows(_PAIRS, shard=[])])
    shard = left["shard"][0].as_py()
    codes = _unpacked(left["codes"][0].as_py(), np.int32)
    gid, code = right["gid"].to_numpy(), right["code"].to_numpy()
    gids = np.sort(gid)
    number = np.zeros(max(int(codes.max()), int(code.max())) + 1, np.int32)
    number[code] = np.searchsorted(gids, gid) + 1
    codes = _without_runs_of_cuts(number[codes])
    index = TwoWay(codes, len(gids) + 1, 2)
    words = index.words()
    present = gids[codes_present(index) - 1]
    prefix, suffix, found = index.longer(words)
    return pa.Table.from_batches([
        _rows(_PAIRS, shard=[shard], codes=[_packed(codes)], gids=[_packed(gids)]),
        _rows(_PAIRS, shard=np.full(len(prefix), shard), p=present[prefix], s=present[suffix], n=found.size)])


def codes_present(index: TwoWay) -> np.ndarray:
    """The numbers of the words of `index.words()`."""
    return np.flatnonzero(np.diff(index.forward.first)[1:]) + 1


_LONGER = "a long, b long, c long, d long, n long"


def _longer_of_shard(depth: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Triples (`a`, `b`, `c`) and quadruples (`d` too) of words whose pairs are all frequent."""
        none = pa.Table.from_batches([_rows(_LONGER, n=[])])
        if not left.num_rows or not right.num_rows:
            return none
        codes, gids = _unpacked(left["codes"][0].as_py(), np.int32), _unpacked(left["gids"][0].as_py(), np.int64)
        base = len(gids) + 1
        key = np.sort((np.searchsorted(gids, right["p"].to_numpy()) + 1) * base + np.searchsorted(gids, right["s"].to_numpy()) + 1)
        here = codes[:-1].astype(np.int64) * base + codes[1:]
        joined = np.r_[False, key[np.minimum(np.searchsorted(key, here), len(key) - 1)] == here, False]  # between words i - 1 and i
        lone = joined.copy()
        lone[1:-1] &= ~joined[:-2] & ~joined[2:]
        joined &= ~lone
        word = joined[:-1] | joined[1:]
        # Every kept word, and a cut after the last one of a run.
        last = word & ~joined[1:]
        out = np.zeros(int(word.sum() + last.sum()), np.int32)
        kept = np.flatnonzero(word)
        if not len(kept):
            return none
        out[np.arange(len(kept)) + np.r_[0, last[kept].cumsum()[:-1]]] = codes[kept]
        index = TwoWay(out, base, depth)
        number = gids[codes_present(index) - 1]
        p2, s2, pairs = index.longer(index.words())
        p3, s3, triples = index.longer(pairs)
        a, b, c = number[p2[p3]], number[s2[p3]], number[s2[s3]]
        made = [_rows(_LONGER, a=a, b=b, c=c, n=triples.size)]
        if depth > 3:
            p4, s4, quads = index.longer(triples)
            made.append(_rows(_LONGER, a=a[p4], b=b[p4], c=c[p4], d=c[s4], n=quads.size))
        return pa.Table.from_batches(made)

    return run


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, depth: int = 4, size: int = SHARD) -> dict[str, DataFrame]:
    """Exact counts over all shards: `sums` (lang, n), `words` (gid, lang, word, n), `pairs` (a, b, n), `longer`
    (a, b, c, d, n; d is null for triples); from `words` on, those with a count of `least` or more. Written tables."""
    if not 2 <= depth <= 4:
        raise ValueError("phrases have 2 to 4 words")
    spark = docs.sparkSession
    home = work_folder(spark, "phrases")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{home}/{name}")
        return spark.read.parquet(f"{home}/{name}")

    dealt = written(shards(docs, text, lang, size), "shards")
    each = dealt.filter("code IS NOT NULL").select("shard", "code", "lang", "word", "n")
    sums = written(each.groupBy("lang").agg(F.sum("n").alias("n")), "sums")
    same, place = Window.partitionBy("lang", "word"), F.shiftleft("shard", _CODE) + F.col("code")
    told = each.withColumn("gid", F.min(place).over(same)).withColumn("total", F.sum("n").over(same))
    told = written(told.filter(F.col("total") >= least).drop("n"), "words")
    words = told.filter(place == F.col("gid")).select("gid", "lang", "word", F.col("total").alias("n"))
    texts = dealt.filter("codes IS NOT NULL").select("shard", "codes")
    back = told.select(F.col("shard").alias("of"), "code", "gid")
    found = written(texts.groupBy("shard").cogroup(back.groupBy("of")).applyInArrow(_pairs_of_shard, _PAIRS), "found")
    discard(spark, f"{home}/shards")
    same = Window.partitionBy("p", "s")
    told = found.filter("p IS NOT NULL").select("shard", "p", "s", "n").withColumn("first", F.min("shard").over(same)).withColumn("total", F.sum("n").over(same))
    told = written(told.filter(F.col("total") >= least).drop("n"), "pairs")
    pairs = told.filter("shard = first").select(F.col("p").alias("a"), F.col("s").alias("b"), F.col("total").alias("n"))
    longer = spark.createDataFrame([], _LONGER)
    if depth > 2:
        back = told.select(F.col("shard").alias("of"), "p", "s")
        texts = found.filter("codes IS NOT NULL").select("shard", "codes", "gids")
        grown = texts.groupBy("shard").cogroup(back.groupBy("of")).applyInArrow(_longer_of_shard(depth), _LONGER)
        longer = written(grown.groupBy("a", "b", "c", "d").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "longer")
    discard(spark, f"{home}/found")
    return {"sums": sums, "words": words, "pairs": pairs, "longer": longer}


def _cut(at: int, left: Column, right: Column) -> Column:
    """struct(score, k, l, r) of the cut after `at` words; exact beyond 64 bits."""
    count = F.lit(2_000_000).cast("decimal(7,0)") * F.col("n").cast("decimal(19,0)")
    parts = left.cast("decimal(19,0)") + right.cast("decimal(19,0)")
    return F.struct(F.call_function("div", count, parts).alias("score"), F.lit(at).alias("k"), left.alias("l"), right.alias("r"))


def candidates(counts: dict[str, DataFrame], share: int = SHARE) -> DataFrame:
    """Every phrase of `counted`, as numbers of its words: lang, a, b, c, d (null beyond the phrase), n_words, n, cut
    (score, k, l, r of the lowest-scoring cut, of equal scores the first), contained (some longer candidate has `share`
    percent of its count). Texts come later, to the few that need them (`with_phrases`)."""
    words, triples = counts["words"], counts["longer"].filter("d IS NULL").select("a", "b", "c", "n")
    quads = counts["longer"].filter("d IS NOT NULL")
    first = words.select(F.col("gid").alias("a"), "lang", F.col("n").alias("n1"))
    second = words.select(F.col("gid").alias("b"), F.col("n").alias("n2"))
    pairs = counts["pairs"].join(first, "a").join(second, "b")
    none = F.lit(None).cast("long")

    def head(one: str, two: str) -> DataFrame:
        return pairs.select(F.col("a").alias(one), F.col("b").alias(two), "lang", F.col("n1").alias("head1"), F.col("n").alias("head2"))

    def tail(one: str, two: str) -> DataFrame:
        return pairs.select(F.col("a").alias(one), F.col("b").alias(two), F.col("n2").alias("tail1"), F.col("n").alias("tail2"))

    def above(parts: list[list[str]], of: DataFrame) -> DataFrame:
        """The greatest count of a phrase one word longer, per phrase."""
        names = ["a", "b", "c"][: len(parts[0])]
        each = F.explode(F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(part, names)]) for part in parts]))
        return of.select(each.alias("t"), "n").select("t.*", "n").groupBy(*names).agg(F.max("n").alias("above"))

    two = pairs.join(above([["a", "b"], ["b", "c"]], triples), ["a", "b"], "left").select(
        "lang", "a", "b", none.alias("c"), none.alias("d"), F.lit(2).alias("n_words"), "n", _cut(1, F.col("n1"), F.col("n2")).alias("cut"), "above")
    three = triples.join(above([["a", "b", "c"], ["b", "c", "d"]], quads), ["a", "b", "c"], "left") \
        .join(head("a", "b"), ["a", "b"]).join(tail("b", "c"), ["b", "c"]).select(
            "lang", "a", "b", "c", none.alias("d"), F.lit(3).alias("n_words"), "n",
            F.least(_cut(1, F.col("head1"), F.col("tail2")), _cut(2, F.col("head2"), F.col("tail1"))).alias("cut"), "above")
    four = quads.join(triples.withColumnRenamed("n", "head3"), ["a", "b", "c"]) \
        .join(triples.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("c").alias("d"), F.col("n").alias("tail3")), ["b", "c", "d"]) \
        .join(head("a", "b"), ["a", "b"]).join(tail("c", "d"), ["c", "d"]).select(
            "lang", "a", "b", "c", "d", F.lit(4).alias("n_words"), "n",
            F.least(_cut(1, F.col("head1"), F.col("tail3")), _cut(2, F.col("head2"), F.col("tail2")), _cut(3, F.col("head3"), F.col("tail1"))).alias("cut"), none.alias("above"))
    most = F.col("above").cast("decimal(19,0)") * 100 >= F.col("n").cast("decimal(19,0)") * share
    return two.union(three).union(four).withColumn("contained", F.coalesce(most, F.lit(False))).drop("above")


def with_phrases(rows: DataFrame, words: DataFrame) -> DataFrame:
    """The rows with `phrase`, the words behind a, b, c and d."""
    for c in "abcd":
        rows = rows.join(words.select(F.col("gid").alias(c), F.col("word").alias(f"_{c}")), c, "left")
    return rows.withColumn("phrase", F.concat_ws(" ", *[f"_{c}" for c in "abcd"])).drop(*[f"_{c}" for c in "abcd"])


def first_of(phrases: DataFrame, words: DataFrame, top: int = TOP) -> DataFrame:
    """`rank`ed first phrases of each language by score, count and phrase. Those that score and count leave in the running, ties
    and all, get their texts; a language's phrases are first dealt into parts, of which only as many each go on."""
    order = (F.col("cut.score").desc(), F.col("n").desc())
    parts = max(_DEALT, shuffle_partitions(phrases.sparkSession))
    near = phrases.withColumn("part", F.pmod(F.hash(*"abcd"), F.lit(parts)))
    for keys in (["lang", "part"], ["lang"]):
        near = near.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    return with_phrases(near.drop("part", "rank"), words).withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, share: int = SHARE, top: int = TOP, depth: int = 4, size: int = SHARD) -> DataFrame:
    """The first `top` phrases of each language that no longer candidate stands for: lang, rank, phrase, n_words, its
    count `a`, the counts `l` and `r` of the parts of its weakest cut (after `cut_after` words), the language's
    number of words `n`, and score."""
    counts = counted(docs, text, lang, least, depth, size)
    best = first_of(candidates(counts, share).filter("NOT contained"), counts["words"], top).drop("a").withColumnRenamed("n", "a")
    return best.join(counts["sums"], "lang").select(
        "lang", "rank", "phrase", "n_words", "a", "cut.l", "cut.r", F.col("cut.k").alias("cut_after"), "n", "cut.score")


def oracle() -> str:
    """The definitions themselves: all phrases of 1 to 4 words of all pieces, counted; every cut; every containment."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH pieces AS (SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang, unnest(string_split_regex({lower}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^ \\x09]+') AS ws FROM pieces),
w AS (SELECT lang, p, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM lists),
runs AS (SELECT lang, w1, lead(w1) OVER near AS w2, lead(w1, 2) OVER near AS w3, lead(w1, 3) OVER near AS w4 FROM w WINDOW near AS (PARTITION BY p ORDER BY i)),
f AS MATERIALIZED (
  SELECT lang, [w1] AS phrase, count(*) AS a FROM runs GROUP BY lang, w1 HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, [w1, w2], count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM runs WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= {LEAST}),
sums AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
cuts AS (SELECT f.lang, f.phrase, f.a, x.a AS l, y.a AS r, k, CAST(2000000 AS HUGEINT) * f.a // (x.a + y.a) AS score
  FROM (SELECT f.*, unnest(range(1, len(phrase))) AS k FROM f) AS f
  JOIN f x ON x.lang = f.lang AND x.phrase = f.phrase[1 : k] JOIN f y ON y.lang = f.lang AND y.phrase = f.phrase[k + 1 :]),
weakest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts) WHERE place = 1),
inside AS (SELECT lang, a, unnest([s for s in [phrase[1 : 2], phrase[2 : 3], phrase[3 : 4], phrase[1 : 3], phrase[2 : 4]] if len(s) >= 2 AND len(s) < len(phrase)]) AS part FROM f),
gone AS (SELECT DISTINCT s.lang, s.phrase FROM f s JOIN inside o ON o.lang = s.lang AND o.part = s.phrase AND CAST(100 AS HUGEINT) * o.a >= CAST({SHARE} AS HUGEINT) * s.a),
ranked AS (SELECT lang, array_to_string(phrase, ' ') AS text, a, l, r, score,
  row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank FROM weakest ANTI JOIN gone USING (lang, phrase))
SELECT lang, rank, text AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN sums USING (lang) WHERE rank <= {TOP}
"""
