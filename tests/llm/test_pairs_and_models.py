"""Near-duplicates, search, languages, classifier: against brute force and on held-out rows."""

import numpy as np
import pytest
import xxhash

from paperloom.llm import langid, lm_scoring, nbsvm, queries, search, simhash
from tests.llm.helpers import FOLDER, HERE, awkward, marks, prose

needs_tables = pytest.mark.skipif(not HERE, reason="driver tables not present")


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(root(i), []).append(d)
    least = {r: min((d for d in g if d is not None), default=None) for r, g in groups.items()}
    return [least[root(i)] for i in range(len(ids))]


def check_near_duplicates(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    want = sorted(zip([r["doc_id"] or 0 for r in rows], prints, [c or 0 for c in plain_components([r["doc_id"] for r in rows], prints)]))
    got = sorted((r["doc_id"] or 0, r["fp"] % 2**64, r["component_id"] or 0) for r in simhash.near_duplicates(docs).collect())
    assert got == want


@needs_tables
def test_near_duplicates_against_all_pairs(spark):
    check_near_duplicates(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_near_duplicates_awkward_and_chains(spark):
    check_near_duplicates(awkward(spark))
    text = prose(400, 9).split()
    chain = []
    for i in range(40):  # every text differs a little from the one before
        text[(7 * i) % 400] = f"changed{i}"
        chain.append((1000 - i, " ".join(text)))
    check_near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"))


@pytest.mark.parametrize("front", [1 << 18, 50])
def test_trie_against_all_pairs(front):
    rng = np.random.default_rng(front)
    base = rng.integers(0, 1 << 48, 60, dtype=np.uint64)
    keys = base[rng.integers(0, 60, 700)]
    for _ in range(3):
        keys = np.where(rng.random(700) < 0.5, keys ^ (np.uint64(1) << rng.integers(0, 48, 700, dtype=np.uint64)), keys)
    both = np.unique(np.stack([rng.integers(0, 3, 700).astype(np.uint64), keys], 1), axis=0)
    tops, keys = both[:, 0], both[:, 1]
    near = (np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 3) & (tops[:, None] == tops[None, :])
    label = np.arange(len(keys))
    while True:
        new = np.array([label[row].min() for row in near])
        new = new[new]
        if (new == label).all():
            break
        label = new
    assert (simhash.trie_components(keys, tops, 48, 3, front) == label).all()


def test_hot_subtrees_are_cut_again(spark):
    rng = np.random.default_rng(3)
    fps = np.unique((np.int64(0x1234) << 48) | rng.integers(0, 1 << 48, 300) | 0)
    fps = np.unique(np.r_[fps, fps[:100] ^ 5, fps[:50] ^ (1 << 40), fps[50:90] ^ 0x7000])
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    want = {(r["fp"], r["label"]) for r in simhash.components(simhash.star_edges(df)).collect()}
    got = {(r["fp"], r["label"]) for r in simhash.components(simhash.star_edges(df, hot=20)).collect()}
    assert got == want and len(got) >= 100


def test_one_of_each_keeps_one_row(spark):
    docs = awkward(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    found = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == sorted({c for c in found.values() if c is not None})
    assert len([r for r in rows if r["doc_id"] is None]) == len({fp for (d, fp), c in found.items() if c is None})


def test_one_of_each_without_identifiers(spark):
    docs = spark.createDataFrame([(None, prose(90)), (None, prose(90)), (None, "other text"), (None, None)], "doc_id long, text string")
    assert simhash.one_of_each(docs).count() == 3


def test_one_of_each_by_component_where_identifiers_repeat(spark):
    def kept(*rows):
        return sorted(map(tuple, simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()))

    for a, b in ((prose(90, 1), prose(90, 2)), (prose(90, 2), prose(90, 1))):
        assert kept((1, a), (5, a), (5, b)) == sorted([(1, a), (5, b)])
        assert kept((5, a), (5, b), (5, a)) == sorted([(5, a), (5, b)])
        assert kept((None, a), (5, a), (0, b), (0, b)) == sorted([(5, a), (0, b)])


def plain_bm25(docs, query, n, mean, df):
    import math

    out = []
    for d, text in docs:
        tf, length, _ = {}, 0, 0
        for w in (text or "").split():
            tf[w] = tf.get(w, 0) + 1
            length += 1
        s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * length / mean)) for w in set(query.split()) if w in tf)
        if s:
            out.append((-round(s, 6), d))
    return [(d, -s) for s, d in sorted(out)[:10]]


def test_shard_pruning_is_exact():
    docs = [(i, prose(20 + i % 90, i + 1)) for i in range(900)]
    mean = sum(len(t.split()) for _, t in docs) / len(docs)
    df: dict = {}
    for _, t in docs:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    shard = search.Shard([d for d, _ in docs], [t for _, t in docs], mean)
    for q in range(0, 900, 60):
        query = docs[q][1]
        want = plain_bm25(docs, query, len(docs), mean, df)
        for least in (0.0, want[-1][1], 0.9 * want[-1][1]):
            digests = search.terms(query)[0]
            number = np.searchsorted(shard.terms, digests)
            words = {int(search.terms(w)[0][0]): w for w in set(query.split())}
            weight = np.array([np.log(1 + (900 - df[words[int(x)]] + 0.5) / (df[words[int(x)]] + 0.5)) for x in digests])
            order = np.argsort(weight)
            found, scores = shard.answer(number[order], weight[order], least, 10)
            got = sorted((-round(float(s), 6), int(d)) for d, s in zip(found, scores))[:10]
            assert [(d, -s) for s, d in got] == want


def test_search_in_blocks_and_ties(spark):
    docs = spark.createDataFrame([(i, "alpha beta" if i % 2 else "alpha gamma") for i in range(40)] + [(None, "alpha beta"), (77, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "ALPHA beta"), (2, "gamma"), (3, None), (None, "beta"), (4, "nowhere")], "query_id long, text string")
    one = sorted(search.search(docs, asked).collect())
    many = sorted(search.search(docs, asked, query_block=1).collect())
    assert one == many
    assert [r["doc_id"] for r in one if r["query_id"] == 1] == list(range(1, 20, 2)) and {r["query_id"] for r in one} == {1, 2}


def test_search_reads_the_documents_once_for_several_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i if i % 50 else None, prose(5 + i % 40, i)) for i in range(300)] + [(3, prose(8, 3)), (301, None)], "doc_id long, text string")
    asked = docs.filter("doc_id % 40 = 1").withColumnRenamed("doc_id", "query_id")
    passes = lambda found: found._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    one = search.search(docs, asked)
    many = search.search(docs, asked, query_block=1)  # seven blocks, none of them empty of work for all tasks
    assert passes(one) == passes(many) == 1 and sorted(many.collect()) == sorted(one.collect()) and one.count() > 50
    monkeypatch.setattr(search, "BLOCKS", 3)
    parted = search.search(docs, asked, query_block=1)
    assert passes(parted) == 3 and sorted(parted.collect()) == sorted(one.collect())


def test_bundles_are_sums_of_bound_vectors():
    space = langid.Space(64)
    packed, counts = space.grams("Ab, b!")
    assert int(counts.sum()) == len(" ab b ") - 2
    by_hand = np.zeros(64)
    for a, b, c in zip(" ab b ", "ab b ", "b b "):
        letters = [space._letters(np.array([0 if x == " " else ord(x)]))[0] for x in (a, b, c)]
        by_hand += np.roll(letters[0], 2) * np.roll(letters[1], 1) * letters[2]
    assert (space.bundles([(packed, counts)])[0] == by_hand).all()
    assert (langid._exact_bundle(space, packed, counts) == by_hand).all()


def test_language_edges(spark):
    docs = awkward(spark)
    learned = langid.prototypes(docs)
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(docs, learned).collect()}
    assert {(4, "und"), (5, "und"), (6, "und"), (13, "und"), (1, "en")} <= got
    assert {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"}


@needs_tables
def test_language_held_out(spark):
    folder = FOLDER.replace("0.001", "0.01")
    found = queries.languages(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98 and all(0 <= r["score"] <= 1 for r in held)


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    y = np.where(x @ np.array([1, -2, 0.5, 0, 1]) + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    cols = np.arange(5)
    w, b = nbsvm.descend([cols] * 60, list(x), y, 5, epochs=400)
    c = {v: 0.5 / (y == v).mean() for v in (1.0, -1.0)}

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + sum(c[t] * max(0.0, 1 - t * (r @ w + b)) for r, t in zip(x, y))

    best = loss(w, b)
    for _ in range(400):
        assert loss(w + 0.02 * rng.normal(size=5), b + 0.02 * rng.normal()) >= best - 1e-3


def test_shapes():
    assert nbsvm.shape("Hello!!!") == "Aa+!+" and nbsvm.shape("A") == "A" and nbsvm.shape("x9#") == "a0#"
    make = nbsvm.Features()
    assert len(make(None)) == len(make(" \n")) == 0
    assert set(make("same same")) != set(make("same other"))


def test_classifier_edges(spark):
    docs = awkward(spark)
    for labels in (marks(spark), marks(spark).filter("quality = 1"), marks(spark, True)):
        rows = nbsvm.scored(docs, nbsvm.train(docs, labels)).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert rows[0]["score"] == 0.5 and nbsvm.scored(awkward(spark, True), (np.zeros(1 << 18, np.float32), 0.0)).count() == 0


@needs_tables
def test_classifier_held_out(spark):
    folder = FOLDER.replace("0.001", "0.01")
    found = queries.quality_scores(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in found]) > 0.95


def test_lm_prefers_the_target(spark):
    rows = [(i, "plain words of the river and the mill " * 5) for i in range(30)] + [(100 + i, "buy cheap now click here win " * 5) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(15)], "doc_id long")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs, *lm_scoring.fit(docs, ids)).collect()}
    assert max(got[i] for i in range(30)) < 0 < min(got[100 + i] for i in range(30))
    none = lm_scoring.score(docs, *lm_scoring.fit(docs, ids.limit(0))).collect()
    assert all(r["score"] == 0 for r in none)


def test_whole_lm_knows_every_pair(spark):
    # 70 000 words that occur once each: no share of all tokens may leave any of them out.
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(700)) + " the end") for i in range(100)] + [(None, None), (7, "the end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    n, t = ({}, {}), ({}, {})
    for d, text in rows:
        w = (text or "").split()
        for into in (n, t) if d in range(50) else (n,):
            for h, x in zip(["", *w], w):
                into[0][h, x] = into[0].get((h, x), 0) + 1
    words = {x for _, x in n[0]}
    assert len(words) > 1 << 16
    single, after = [{}, {}], [{}, {}]
    for k, into in enumerate((t, n)):
        for (h, x), c in into[0].items():
            single[k][x], after[k][h] = single[k].get(x, 0) + c, after[k].get(h, 0) + c
    totals = [sum(s.values()) for s in single]
    factor = [1.0, totals[0] / totals[1]]

    def loss(k, h, x):
        p = (single[k].get(x, 0) * factor[k] + lm_scoring.ADD) / (totals[0] + lm_scoring.ADD * (len(words) + 1))
        return -np.log(((t, n)[k][0].get((h, x), 0) * factor[k] + lm_scoring.PRIOR * p) / (after[k].get(h, 0) * factor[k] + lm_scoring.PRIOR))

    want = []
    for d, text in rows:
        w = (text or "").split()
        a, b = (np.mean([loss(k, h, x) for h, x in zip(["", *w], w)]) if w else 0 for k in (0, 1))
        want.append((d or 0, len(w), round(float(a), 6), round(float(b), 6)))
    got = [(r["doc_id"] or 0, r["n_tokens"], round(r["target_loss"] or 0, 6), round(r["background_loss"] or 0, 6)) for r in lm_scoring.score_whole(docs, ids).collect()]
    assert sorted(got) == sorted(want)
    none = lm_scoring.score_whole(docs, ids.limit(0)).collect()
    assert len(none) == len(rows) and all(not r["score"] for r in none)
