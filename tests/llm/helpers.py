"""Tables of awkward rows, and the SQL side of a comparison."""

from __future__ import annotations

import os

FOLDER = "/root/testdata/sf0.001"
HERE = os.path.isdir(FOLDER)
PROSE = "the old river runs slowly past the quiet mill and the keeper counts every boat that comes before the light goes"


def prose(n: int, seed: int = 1) -> str:
    words, out, x = PROSE.split(), [], seed
    for _ in range(n):
        x = (1103515245 * x + 12345) % 2147483648
        out.append(words[x % len(words)] + ("" if x % 7 else str(x % 97)))
    return " ".join(out)


def awkward(spark, empty: bool = False):
    """documents with null, empty, blank, very long, repeated and odd rows, and columns whose names clash
    with those the operators use inside."""
    long = prose(30_000, 5)
    rows = [
        (1, prose(80, 1), "en", "a"), (2, prose(80, 2), "en", "b"), (3, prose(80, 1), "en", "b"), (4, None, None, None), (5, "", "en", "a"),
        (6, " \t\n\x0b\x0c\r ", "fr", "c"), (7, long, "en", "a"), (8, long + " end", "en", "c"), (None, prose(60, 3), "fr", "a"),
        (None, None, None, None), (9, prose(70, 4), None, None), (9, prose(70, 4), None, None), (10, "one", "de", ""),
        (11, "\U0001f600 Übergröße 中文 <|endoftext|> x", "de", "b"), (-12, "two words", "en", "a"), (13, "!!! ### 123", "en", "a"), (50, prose(40, 8), "en", "b"),
    ]
    clash = "row string, key string, score double, size long, n long, w string, t string, fp long, word string, label string, taken long, verdict string, part int"
    more = ("r", "k", 0.5, 7, 1, "w", "t", 3, "x", "l", 9, "v", 2)
    schema = f"doc_id long, text string, lang string, source string, {clash}"
    return spark.createDataFrame([] if empty else [(*r, *more) for r in rows], schema)


def marks(spark, empty: bool = False):
    rows = [(i, i % 2, 0) for i in (1, 2, 3, 5, 7, 8, 10, 13)] + [(1, 1, 0), (2, 1, 0), (None, 1, 1), (3, None, None), (99, 1, 0)]
    return spark.createDataFrame([] if empty else rows, "doc_id long, quality int, toxic int")


def duck(tables: dict | None = None, folder: str = FOLDER):
    """A DuckDB connection over the folder's tables, or over pandas frames."""
    import duckdb

    c = duckdb.connect()
    names = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
    for name in names:
        if tables is not None and name in tables:
            c.register(name, tables[name])
        elif tables is None:
            c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return c


def same(df, connection, sql: str) -> int:
    """Compare a Spark result with a DuckDB one as sorted rows; the number of rows."""
    from tools.compare import plain

    cols = sorted(df.columns)
    rel = connection.sql(sql)
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*cols).collect())
    want = sorted(repr(tuple(plain(r[i]) for i in order)) for r in rel.fetchall())
    assert got == want
    return len(got)
