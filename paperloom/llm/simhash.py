"""Near-duplicates by 64-bit SimHash fingerprints and a binary trie joined with itself.

Fingerprint: A-Z are lower-cased, words are runs of non-blanks, every 3-word shingle (repeats included;
the whole sequence of a shorter text) is hashed with XXH64, seed 42; a bit is set if more than half of
the hashes have it. A text without words, or null, has fingerprint zero and is linked like any other.

Links: distinct fingerprints that differ in at most `budget` bits. Of four rotations of the fingerprint
(by 0, 16, 32 and 48 bits) one has its first 16 bits free of errors if at most 3 bits differ, so each
rotation's trie is cut below its error-free top: fingerprints with equal leading blocks form a subtree,
and a subtree is joined with itself by walking pairs of nodes together, bit by bit, adding the bits in
which they differ and leaving a pair once the budget is spent. Subtrees above HOT fingerprints are cut
once more in the same way (four rotations of the remaining 48 bits, 12 of them error-free). The walk
starts with budget 0 and raises it, and leaves pairs of nodes whose fingerprints are all in one component
already, so a dense cluster costs no pair list. It holds at most FRONT node pairs at a time.

Components over all subtrees are found by label passing with pointer jumping on the star edges of the
subtrees; every pass is written to the shared folder.

Documents with equal fingerprints are one node. The component id is the smallest non-null doc_id that is
reachable (null if all are null). Null and repeated identifiers, empty tables and clashing names of further
columns are fine: only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import shuffle_partitions
from paperloom.session import cut_lineage, ship_package

BUDGET = 3
SHINGLE = 3
SEED = 42
#: Fingerprints of one subtree above which it is cut again.
HOT = 20_000
#: Node pairs held at a time.
FRONT = 1 << 18
_CHUNK = 1 << 15


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text as an unsigned number. Shingles are summed in bounded chunks."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and split know ASCII only
    if not words:
        return 0
    count = max(1, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, _CHUNK):
        part = words[at : at + _CHUNK + size - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > count).tolist())


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """`doc_id`, `fp` (the fingerprint as a signed long), and the text's `digest` if asked for."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])

    more = [F.xxhash64(F.col(f"`{text}`")).alias("digest")] if digest else []
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *more) \
        .mapInArrow(run, "doc_id long, fp long" + ", digest long" * digest)


class _Union:
    """Components of the sorted fingerprints of a task."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            apart = low < high
            if not apart.any():
                return
            np.minimum.at(self.root, high[apart], low[apart])
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up
            a, b = a[apart], b[apart]


def trie_components(keys: np.ndarray, tops: np.ndarray, bits: int, budget: int = BUDGET, front: int = FRONT) -> np.ndarray:
    """For each key the position of the first key of its component.

    `keys`: distinct (top, key) pairs sorted by top and key; `bits` low bits of a key matter; `tops`: number of
    the subtree a key belongs to. A node is a range of the sorted keys that share a top and a prefix.
    """
    n = len(keys)
    union = _Union(n)
    edges = np.flatnonzero(np.r_[True, tops[1:] != tops[:-1]])
    starts, ends = edges, np.r_[edges[1:], n]
    roots = np.stack([starts, ends], 1)[ends - starts > 1]
    for allowed in range(1, budget + 1):
        # Component changes along the sorted keys tell in one subtraction whether a node is of one component.
        turns = np.r_[0, np.cumsum(union.root[1:] != union.root[:-1])]
        stack = [(bits, roots[:, 0], roots[:, 1], roots[:, 0], roots[:, 1], np.zeros(len(roots), np.int8))]
        while stack:
            depth, a0, a1, b0, b1, errors = stack.pop()
            one = (turns[a1 - 1] == turns[a0]) & (turns[b1 - 1] == turns[b0]) & (union.root[a0] == union.root[b0])
            keep = ~one
            a0, a1, b0, b1, errors = a0[keep], a1[keep], b0[keep], b1[keep], errors[keep]
            if not len(a0):
                continue
            if len(a0) > front:
                for at in range(0, len(a0), front):
                    stack.append((depth, a0[at : at + front], a1[at : at + front], b0[at : at + front], b1[at : at + front], errors[at : at + front]))
                continue
            lone = (a1 - a0 == 1) & (b1 - b0 == 1)
            if lone.any():  # two leaves: what is left of the walk is one count of bits
                mask = np.uint64((1 << depth) - 1)
                more = np.bitwise_count((keys[a0[lone]] ^ keys[b0[lone]]) & mask)
                near = errors[lone] + more <= allowed
                union.join(a0[lone][near], b0[lone][near])
                a0, a1, b0, b1, errors = (x[~lone] for x in (a0, a1, b0, b1, errors))
            if not depth or not len(a0):
                continue
            am, bm = _middle(keys, a0, a1, depth), _middle(keys, b0, b1, depth)
            same = (a0 == b0) & (a1 == b1)
            left, right, apart = [], [], []
            for (p0, p1), (q0, q1), cost, ok in (((a0, am), (b0, bm), 0, None), ((am, a1), (bm, b1), 0, None), ((a0, am), (bm, b1), 1, None), ((am, a1), (b0, bm), 1, ~same)):
                there = (p1 > p0) & (q1 > q0) & (errors + cost <= allowed)
                if cost == 0:  # a lone leaf has no partner in itself
                    there &= ~(same & (p1 - p0 == 1))
                if ok is not None:
                    there &= ok
                left.append(np.stack([p0[there], p1[there]]))
                right.append(np.stack([q0[there], q1[there]]))
                apart.append(errors[there] + np.int8(cost))
            p, q = np.concatenate(left, 1), np.concatenate(right, 1)
            stack.append((depth - 1, p[0], p[1], q[0], q[1], np.concatenate(apart)))
    return union.root


def _middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Per range the first key whose bit `depth - 1` is set (ranges are sorted and share the bits above)."""
    bit = np.uint64(1 << (depth - 1))
    lo, hi = lo.copy(), hi.copy()
    while True:
        live = lo < hi
        if not live.any():
            return lo
        mid = (lo + hi) >> 1
        up = live & ((keys[np.minimum(mid, len(keys) - 1)] & bit) == 0)
        lo = np.where(up, mid + 1, lo)
        hi = np.where(live & ~up, mid, hi)


def _rotated(fp: Column, by: int, bits: int) -> Column:
    """The low `bits` bits of `fp` rotated left by `by`."""
    if not by:
        return fp
    if bits == 64:
        return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))
    mask = (1 << bits) - 1
    return F.shiftleft(fp, by).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftright(fp, bits - by))


def star_edges(distinct: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """`a`, `b`: edges between distinct fingerprints (column fp) that span the components of every subtree."""
    if not 0 <= budget <= BUDGET:
        raise ValueError("four rotations leave one of them error-free for at most 3 differing bits")
    spark = distinct.sparkSession
    ship_package(spark)
    turned = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(r).alias("r"), _rotated(F.col("fp"), 16 * r, 64).alias("k")) for r in range(4)])).alias("x")) \
        .select("fp", F.concat_ws("/", "x.r", F.shiftrightunsigned("x.k", 48)).alias("top"), F.col("x.k").bitwiseAND(F.lit((1 << 48) - 1)).alias("rest"))
    counts = turned.groupBy("top").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = turned.join(counts, "top")
    whole = held.filter(F.col("n") <= hot).select("fp", "top", F.col("rest").alias("k"))
    again = held.filter(F.col("n") > hot).select("fp", "top", F.explode(F.array(*[
        F.struct(F.lit(r).alias("r"), _rotated(F.col("rest"), 12 * r, 48).alias("k")) for r in range(4)])).alias("x")) \
        .select("fp", F.concat_ws("/", "top", "x.r", F.shiftright("x.k", 36)).alias("top"), F.col("x.k").bitwiseAND(F.lit((1 << 36) - 1)).alias("k"))
    parts = max(shuffle_partitions(spark), 1)
    trees = whole.unionByName(again).repartition(parts, "top").sortWithinPartitions("top", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        fp, k = table["fp"].to_numpy(), table["k"].to_numpy().astype(np.uint64)
        tops = pd.factorize(table["top"].to_pandas())[0]
        root = trie_components(k, tops, 48, budget)
        link = root != np.arange(len(root))
        yield from pa.table({"a": fp[link], "b": fp[root[link]]}).to_batches(max_chunksize=100_000)

    return trees.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """`fp`, `label`: the least fingerprint of its component, for fingerprints with an edge.

    Each round gives every node the least label among itself and its neighbours, then the label of that
    label; the rounds needed grow with the logarithm of the longest chain. Sums per node are combined
    before the shuffle, so a node with very many neighbours is no hot task; joins on a label are split by
    the adaptive planner."""
    both = edges.filter("a <> b").distinct()
    both = cut_lineage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("m")).select("fp", F.least("fp", "m").alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("fp", "b"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("label").alias("m"))
        lowered = labels.join(near, "fp").select("fp", "label", F.least("label", "m").alias("low"))
        # A label is itself a node, so the jump reads the label's own new label.
        jump = lowered.select(F.col("fp").alias("low"), F.col("low").alias("further"))
        step = cut_lineage(lowered.join(jump, "low").select("fp", F.least("low", "further").alias("new"), "label"))
        changed = step.filter("new <> label").limit(1).count()
        labels = step.select("fp", F.col("new").alias("label"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def classes(marked: DataFrame, budget: int = BUDGET) -> DataFrame:
    """`fp`, `label` (the least fingerprint of the component), `component_id`. `marked`: doc_id, fp."""
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = components(star_edges(nodes.select("fp"), budget))
    rooted = nodes.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = rooted.groupBy("label").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "label").select("fp", "label", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """Per document `doc_id`, `fp` and `component_id`."""
    marked = cut_lineage(fingerprints(docs, doc_id, text))
    return marked.join(classes(marked, budget).drop("label"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """`docs` with one row of every component: of its rows with the smallest identifier (the rows without any,
    if none has one) the one with the least digest of the text. An identifier that several components share
    stays once in each where it is the smallest."""
    key, digest = F.col(f"`{doc_id}`").cast("long"), F.xxhash64(F.col(f"`{text}`"))
    marked = cut_lineage(fingerprints(docs, doc_id, text, digest=True))
    # One row per fingerprint before the join, so exact copies are no hot key.
    least = marked.groupBy("fp").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit(0)).alias("key"), "digest")).alias("x"))
    stay = least.join(classes(marked, budget), "fp").groupBy("label").agg(F.min("x").alias("x")).select("x.nameless", "x.key", "x.digest")
    # One shuffle serves both the join and the choice among rows of one identifier and text.
    same = ["nameless", "key", "digest"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.isNull().alias("nameless"), F.coalesce(key, F.lit(0)).alias("key"), digest.alias("digest"))
    order = Window.partitionBy(*same).orderBy("digest")
    return rows.join(stay, same).withColumn("n", F.row_number().over(order)).filter("n = 1").select("row.*")
