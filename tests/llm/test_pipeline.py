"""Every stage of the pipeline against a plain version on its own input, and the run as a whole."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from paperloom.llm import mixing, nbsvm, oracle, queries, rules
from tests.llm.helpers import FOLDER, HERE, awkward, duck, marks
from tests.llm.test_pairs_and_models import plain_components, plain_fingerprint
from tests.llm.test_rows import plain_measures

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
needs_tables = pytest.mark.skipif(not HERE, reason="driver tables not present")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    home, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{home}/{i}")
        made = spark.read.parquet(f"{home}/{i}")
        out.append((docs, made))
        docs = made
    return out


def plain(rows):
    return sorted(tuple(r[c] for c in COLUMNS) for r in rows)


@needs_tables
def test_stages_are_named_and_keep_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "simhash near-duplicates", "source mixing", "packing"]
    assert all(made.columns == COLUMNS for _, made in stages[:-1])
    assert all(made.count() > 0 for _, made in stages)


@needs_tables
def test_classifier_stage(spark, stages):
    given, made = stages[0]
    weights, offset = queries.quality_model(given, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    make = nbsvm.Features()

    def score(text):
        x = make(text)
        return 1 / (1 + np.exp(-(weights[x].sum(dtype=np.float64) / max(len(x), 1) ** 0.5 + offset)))

    assert plain(made.collect()) == plain(r for r in given.collect() if score(r["text"]) >= 0.3)


@needs_tables
def test_rules_stage(stages):
    given, made = stages[1]
    kept = duck({"documents": given.toArrow()}).sql(f"SELECT doc_id FROM ({rules.oracle()}) x WHERE kept").fetchall()
    assert plain(made.collect()) == plain(r for r in given.collect() if (r["doc_id"],) in set(kept))
    assert all(plain_measures(r["text"])[0] >= 50 for r in made.collect())


@needs_tables
def test_near_duplicate_stage(stages):
    given, made = stages[2]
    rows = given.collect()
    found = plain_components([r["doc_id"] for r in rows], [plain_fingerprint(r["text"]) for r in rows])
    assert plain(made.collect()) == plain(r for r, c in zip(rows, found) if r["doc_id"] == c)


@needs_tables
def test_mixing_stage(stages):
    given, made = stages[3]
    taken = duck({"documents": given.toArrow()}).sql(oracle.ORACLE["op10_source_mixing"]).fetchall()
    names = ["doc_id", "size", "source_size", "target", "taken"]
    times = {dict(zip(names, r))["doc_id"]: (dict(zip(names, r))["taken"] // max(dict(zip(names, r))["size"], 1)) for r in taken}
    want = [r for r in given.collect() for _ in range(times[r["doc_id"]])]
    assert plain(made.collect()) == plain(want)


@needs_tables
def test_packing_stage(stages):
    from tokenizers import Tokenizer

    import public_tokenizers as P

    given, made = stages[4]
    exact = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for r in given.collect():
        ids = np.array([*exact.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        want += [(r["doc_id"], s, zlib.crc32(ids[s : s + 1024].tobytes())) for s in range(0, len(ids), 1024)]
    rows = made.collect()
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in rows) == sorted(want)
    used = sum(r["length"] for r in rows) / 1024
    assert len({r["sequence_id"] for r in rows}) <= 1.02 * used + 1  # best fit leaves little; few pieces fit exactly


@needs_tables
def test_run_equals_its_stages(spark, stages):
    whole = corpus_pipeline.run(spark, FOLDER).select("doc_id", "start", "ids_crc32").collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, stages[-1][1].select("doc_id", "start", "ids_crc32").collect()))


@pytest.mark.parametrize("empty", [True, False])
def test_stages_on_awkward_rows(spark, tmp_path, empty):
    marks(spark, empty).write.parquet(f"{tmp_path}/labels.parquet")
    docs = awkward(spark, empty)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(tmp_path))
        made.write.parquet(f"{tmp_path}/{i}")
        made = spark.read.parquet(f"{tmp_path}/{i}")
        assert i == 4 or made.columns == docs.columns
        assert not empty or made.count() == 0
        # Every stage gets the awkward rows, whatever the one before it kept.
        if i == 3 and not empty:
            assert {r["doc_id"] for r in made.collect()} <= {r["doc_id"] for r in docs.collect()}
    assert mixing.REPEATS == 2
