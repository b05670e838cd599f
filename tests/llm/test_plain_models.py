"""Language identification and the quality classifier against plain dictionary versions."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import langid, nbsvm
from tests.llm.helpers import awkward, prose

# --- language identification: letters, n-grams, sums and cosines one by one --------------------------------------


def letter(c, dimensions):
    return np.random.default_rng([langid.SEED, 0 if c == " " else ord(c)]).integers(0, 2, dimensions, dtype=np.int8).astype(int) * 2 - 1


def plain_bundle(text, dimensions, letters):
    line = " "
    for c in text or "":
        c = c.lower()[0] if c.isalpha() else " "
        line += c if c != " " or line[-1] != " " else ""
    line += "" if line[-1] == " " else " "
    total = np.zeros(dimensions, int)
    for i in range(len(line) - 2 if line.strip() else 0):
        bound = np.ones(dimensions, int)
        for place, c in enumerate(line[i : i + 3]):
            if (c, place) not in letters:
                letters[c, place] = np.roll(letter(c, dimensions), 2 - place)
            bound = bound * letters[c, place]
        total += bound
    return total


def test_languages_against_plain_bundles(spark):
    dimensions, letters = 128, {}
    rows = [(r["doc_id"], (r["text"] or "")[:400] if r["text"] is not None else None, r["lang"]) for r in awkward(spark).collect()]
    rows += [(100 + i, " ".join(words.split()[i % 3 :]), lang) for i in range(6) for lang, words in (("de", "Der Fluß fließt überall Äpfel"), ("fr", "où l'été est déjà fini à Noël"), ("ru", "река течёт МЕДЛЕННО"), (None, "which of these"))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, i int").repartition(3)
    known = {}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            known[lang] = known.get(lang, 0) + plain_bundle(text, dimensions, letters)
    known = {k: v for k, v in known.items() if v.any()}
    learned = langid.prototypes(docs, dimensions=dimensions)
    assert {k: list(v) for k, v in learned.items()} == {k: v.tolist() for k, v in known.items()}
    want = []
    for doc_id, text, _ in rows:
        own = plain_bundle(text, dimensions, letters)
        near = [(round(float(own @ known[k]) / (math.sqrt(float(own @ own)) * math.sqrt(float(known[k] @ known[k]))), 9), k) for k in sorted(known)] if own.any() else []
        best = max(near, key=lambda x: x[0]) if near else (0.0, "und")  # the first of equal ones
        want.append((doc_id or -1, best[1], round(min(max(best[0], 0.0), 1.0), 6)))
    got = [(r["doc_id"] or -1, r["lang_pred"], round(r["score"], 6)) for r in langid.identify(docs, learned, dimensions=dimensions).collect()]
    assert sorted(got) == sorted(want) and len({g[1] for g in got}) >= 4


# --- quality classifier: features as numbers, counts, descent and the curve in plain loops -------------------------

MASK = (1 << 64) - 1


def plain_features(text, bits):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    hashed = lambda s: zlib.crc32(s.encode("utf-8", "surrogatepass"))

    def shape(word):
        kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word]
        out, i = "", 0
        while i < len(kinds):
            j = i
            while j < len(kinds) and kinds[j] == kinds[i]:
                j += 1
            out += kinds[i] + "+" * (j - i > 1)
            i = j
        return out

    own = [hashed(w.lower()) for w in words]
    form = [2 * hashed(shape(w)) + (i > 0 and own[i] == own[i - 1]) for i, w in enumerate(words)]
    p = 0x9E3779B97F4A7C15
    two = lambda x: [(a * p + b) & MASK for a, b in zip(x, x[1:])]
    pairs = two(form)
    kinds = [own, two(own), form, pairs, [(a * p + b) & MASK for a, b in zip(pairs, form[2:])]]
    out = set()
    for i, values in enumerate(kinds):
        for k in values:
            m = ((k + i + 1) * p) & MASK
            out.add((((m ^ (m >> 29)) * 0xBF58476D1CE4E5B9) & MASK) >> (64 - bits))
    return sorted(out)


def plain_model(sample, bits):
    """`sample`: (features, good) in the order of the draw."""
    aside = [i for i in range(len(sample)) if i % 5 == 4]
    kept = [i for i in range(len(sample)) if i % 5 != 4]
    if len({sample[i][1] for i in aside}) < 2 or len({sample[i][1] for i in kept}) < 2:
        aside, kept = [], list(range(len(sample)))
    counts = {0: {}, 1: {}}
    for i in kept:
        for f in sample[i][0]:
            counts[sample[i][1]][f] = counts[sample[i][1]].get(f, 0) + 1
    total = {g: (1 << bits) * nbsvm.SMOOTH + sum(counts[g].values()) for g in (0, 1)}
    ratio = lambda f: math.log((counts[1].get(f, 0) + nbsvm.SMOOTH) / total[1]) - math.log((counts[0].get(f, 0) + nbsvm.SMOOTH) / total[0])
    values = [{f: ratio(f) / math.sqrt(len(x)) for f in x} for x, _ in sample]
    share = {g: sum(sample[i][1] == g for i in kept) / len(kept) for g in (0, 1)}
    w, bias, alpha, order = {}, 0.0, [0.0] * len(kept), np.random.default_rng(nbsvm.SEED)
    for _ in range(nbsvm.EPOCHS):
        most = 0.0
        for at in order.permutation(len(kept)).tolist():
            x, good = values[kept[at]], sample[kept[at]][1]
            y = 1 if good else -1
            gradient = y * (sum(w.get(f, 0.0) * v for f, v in x.items()) + bias) - 1
            new = min(max(alpha[at] - gradient / (sum(v * v for v in x.values()) + 1), 0.0), nbsvm.COST * 0.5 / share[good])
            step = (new - alpha[at]) * y
            alpha[at] = new
            for f, v in x.items():
                w[f] = w.get(f, 0.0) + step * v
            bias += step
            most = max(most, abs(step))
        if most < 1e-3:
            break
    check = aside or kept
    margin = lambda x: sum(w.get(f, 0.0) * ratio(f) / math.sqrt(len(x)) for f in x) + bias
    return margin, [(margin(sample[i][0]), sample[i][1]) for i in check]


def test_classifier_against_plain_loops(spark):
    bits = 12
    rows = [(r["doc_id"], r["text"][:2000] if r["text"] is not None else None) for r in awkward(spark).collect()]
    rows += [(200 + i, prose(20 + i, i) if i % 2 else f"BUY now!!! {prose(6, i).upper()} click click click http://x{i} $$$ 99%") for i in range(60)]
    labels = [(200 + i, i % 2) for i in range(60)] + [(1, 1), (2, 1), (3, 0), (5, 0), (3, 1), (None, 1), (8, None), (999, 1)]
    docs = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, word string").repartition(3)
    marked = spark.createDataFrame(labels, "doc_id long, quality int")
    agreed = {}
    for i, g in labels:
        if i is not None and g is not None:
            agreed.setdefault(i, set()).add(g)
    agreed = {i: min(g) for i, g in agreed.items() if len(g) == 1}
    place = {r["id"]: r["p"] for r in spark.createDataFrame([(i,) for i in agreed], "id long").withColumn("p", F.xxhash64(F.lit(nbsvm.SEED), "id")).collect()}
    text = {i: t for i, t in rows if i is not None}
    sample = [(plain_features(text[i], bits), agreed[i]) for i in sorted((i for i in agreed if i in text), key=place.get)]
    margin, seen = plain_model(sample, bits)
    # The true class sizes weigh the rows kept aside; the curve itself is one small convex problem, checked at its minimum.
    sizes = {g: sum(v == g for v in agreed.values()) for g in (0, 1)}
    weight = np.array([sizes[g] / sum(h == g for _, h in seen) for _, g in seen])
    margins, good = np.array([m for m, _ in seen]), np.array([g == 1 for _, g in seen])
    slope, offset = nbsvm.logistic(margins, good, weight * len(seen) / weight.sum())
    model = nbsvm.train(docs, marked, bits=bits)
    score = nbsvm.scorer(docs, model, bits)(F.col("text"))
    got = sorted((r["doc_id"] or -1, round(r["s"], 3)) for r in docs.select("doc_id", score.alias("s")).collect())
    want = sorted((i or -1, round(1 / (1 + math.exp(-(slope * margin(plain_features(t, bits)) + offset))), 3)) for i, t in rows)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert max(abs(a - b) for (_, a), (_, b) in zip(got, want)) <= 0.0011 and len({s for _, s in got}) > 10

    def loss(a, b):
        n1, n0 = (weight * len(seen) / weight.sum())[good].sum(), (weight * len(seen) / weight.sum())[~good].sum()
        target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        z = a * margins + b
        return float((weight * len(seen) / weight.sum()) @ (np.logaddexp(0, z) - target * z) + 0.5e-3 * (a - 1) ** 2)

    assert all(loss(slope + da, offset + db) >= loss(slope, offset) - 1e-6 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))
