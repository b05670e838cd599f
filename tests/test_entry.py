"""The driver contract: names, SQL counterparts, and a few queries compared on the smallest tables."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


def test_every_statement_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@needs_tables
def test_flagship(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 23 * spark.read.parquet(f"{FOLDER}/documents.parquet").count()


@needs_tables
@pytest.mark.parametrize("name", ["ledger_summary", "part_positions", "toc_lines", "secret_findings", "repeated_steps", "sanitised_plans", "key_metrics"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry
    from paperloom.plans.adapters import TABLES
    from tools.compare import plain

    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    rel = duck.sql(entry.oracle_sql()[name])
    order = [rel.columns.index(c) for c in cols]
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*cols).collect())
    want = sorted(repr(tuple(plain(r[i]) for i in order)) for r in rel.fetchall())
    assert got == want and got


@needs_tables
def test_whole_texts_reach_the_operators(spark):
    from paperloom.plans import adapters as A
    from paperloom.plans import web

    # Every report holds its document's whole text besides its own wording.
    bare = A.FILINGS.replace("{documents}", "(SELECT doc_id, '' AS text FROM {documents})")
    lengths = lambda sql: {r["filing_id"]: r["n"] for r in A.bind(spark, FOLDER, sql).selectExpr("filing_id", "length(text) AS n").collect()}
    sizes = {r["doc_id"]: r["n"] for r in A.table(spark, FOLDER, "documents").selectExpr("doc_id", "length(trim(text)) AS n").collect()}
    full, empty = lengths(A.FILINGS), lengths(bare)
    assert {k: full[k] - empty[k] for k in full} == sizes
    # Every output holds its conversation's words.
    texts = A.bind(spark, FOLDER, f"SELECT {web._ID} AS id, text FROM {{conversations}}")
    got = A.bind(spark, FOLDER, web.OUTPUTS).join(texts, "id").selectExpr("replace(raw, '\\\\n', ' ') AS raw", "replace(text, chr(10), ' ') AS text")
    assert got.filter("NOT contains(replace(raw, chr(10), ' '), text)").count() == 0


def test_no_folder_is_an_error_on_a_cluster():
    from types import SimpleNamespace

    from paperloom.session import shared_folder

    conf = SimpleNamespace(get=lambda *a: None)
    fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_folder(fake)


def test_entry_without_the_training_data_operators(tmp_path):
    """Deleting the subpackage and the pipeline leaves every other query in place."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "paperloom"), tmp_path / "paperloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert len(names) > 100 and 'pipeline' not in names and not any(n.startswith('op1') for n in names); assert set(e.oracle_sql()) <= names"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
