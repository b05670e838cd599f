"""Texts kept so that work on one filing never moves its text.

A corpus is a table of texts, bucketed and sorted by its key. Whatever an operator computes per key from a
stored corpus is already where the text is: windows and aggregates over the key need no exchange (rows that a
Python function makes of the texts, as boundary candidates, are dealt like the buckets once more), and results
are joined to the text by merging two sorted sides. The buckets are chosen from the measured size of the
texts, as one bucket is one task.

The folder holds the table (`texts`) and its layout (`layout`, one row), so another application can read it without a
catalog of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in one bucket, about.
BUCKET_BYTES = 32 << 20


def bucket_count(texts: DataFrame, columns: list[str], bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for the texts' measured size, and one per core at least."""
    size = texts.agg(*[F.sum(F.octet_length(F.col(c))).alias(c) for c in columns]).first()
    return max(texts.sparkSession.sparkContext.defaultParallelism, -(-sum(n or 0 for n in size) // bucket_bytes))


def write_corpus(texts: DataFrame, folder: str, key: str = "filing_id", buckets: int | None = None) -> DataFrame:
    """Store the texts under `folder` and return them as read back. Rows with a null key are kept."""
    spark, folder = texts.sparkSession, folder.rstrip("/")
    strings = [c for c, t in texts.dtypes if t in ("string", "binary") and c != key]
    buckets = buckets or bucket_count(texts, strings)
    name = f"corpus_{uuid.uuid4().hex}"
    # Dealt by the buckets' own hash first: every bucket is one file, written by one task.
    texts.repartition(buckets, F.col(key)).write.mode("error").option("path", f"{folder}/texts").bucketBy(buckets, key).sortBy(key) \
        .format("parquet").saveAsTable(name)
    layout = spark.createDataFrame([(key, buckets, ", ".join(f"`{c}` {t}" for c, t in texts.dtypes))], "key string, buckets int, columns string")
    layout.coalesce(1).write.json(f"{folder}/layout")
    return spark.table(name)


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """A stored corpus, registered with this session's catalog under a name of its own."""
    folder = folder.rstrip("/")
    layout = spark.read.schema("key string, buckets int, columns string").json(f"{folder}/layout").first()
    name = f"corpus_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({layout['columns']}) USING parquet CLUSTERED BY (`{layout['key']}`) SORTED BY (`{layout['key']}`) "
              f"INTO {layout['buckets']} BUCKETS LOCATION '{folder}/texts'")
    return spark.table(name)
