"""Submission files read block by block.

A submission can be larger than any row should be. The end of a document block is the separator of a text source
here, so Spark cuts a file into splits as it cuts lines: a large file is many tasks, and a row is what stands before
one end. Name patterns and a limit of size are tested on the file listing, before anything is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.ordered import running_sums
from paperloom.operators.filing_text import block_fields, document_blocks

END = "</DOCUMENT>"


def _pieces(reader, path: str, name: str | None, max_bytes: int | None) -> DataFrame:
    reader = reader.option("recursiveFileLookup", "true").option("lineSep", END)
    rows = (reader.option("pathGlobFilter", name) if name else reader).text(path)
    rows = rows.select("value", F.col("_metadata.file_path").alias("filing_id"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_block_start").alias("split"))
    return rows if max_bytes is None else rows.filter(F.col("bytes") <= max_bytes)


def _blocks(pieces: DataFrame, *order: str) -> DataFrame:
    """Blocks of the pieces; ends in small letters are found inside a piece."""
    found = document_blocks(F.concat("value", F.lit(END)))
    return pieces.select("filing_id", *order, F.posexplode(found).alias("part", "block")).select("filing_id", *order, "part", *block_fields())


def read_submission_blocks(spark: SparkSession, path: str, name: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """The document blocks of all files below `path`: filing_id (the file), split, row and part (their order in the file: where
    their split starts, and their place in it), doc_type, body. `name`: a pattern of file names.

    A block that a file opens and never ends is none, as in `split_submissions`; a first pass over the sizes of the pieces
    finds such files. No text is shuffled, but where there are some.
    """
    pieces = _pieces(spark.read, path, name, max_bytes).withColumn("row", F.monotonically_increasing_id())
    # Only a file's last piece can lack an end: then the pieces and their ends are longer than the file.
    size = F.sum(F.octet_length("value") + len(END))
    ends = pieces.groupBy("filing_id").agg(
        F.max(F.struct("split", "row", F.contains(F.upper("value"), F.lit("<DOCUMENT>")).alias("opens"))).alias("last"), (size > F.max("bytes")).alias("unended"))
    left_open = ends.filter("unended AND last.opens").select("filing_id", "last.split", "last.row")
    if left_open.isEmpty():
        return _blocks(pieces, "split", "row")
    # Ends in small letters before it still count.
    before = F.regexp_extract("value", r"(?is)^(.*</DOCUMENT>)", 1)
    kept = pieces.join(left_open.withColumn("open", F.lit(True)), ["filing_id", "split", "row"], "left").withColumn("value", F.when(F.col("open"), before).otherwise(F.col("value")))
    return _blocks(kept, "split", "row")


def stream_submission_blocks(spark: SparkSession, path: str, name: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """The same blocks of files as they arrive, without their order: filing_id, split, part, doc_type, body. Files are taken to end their
    last block."""
    return _blocks(_pieces(spark.readStream, path, name, max_bytes), "split")


def numbered(blocks: DataFrame) -> DataFrame:
    """The blocks with `pos`, their number in the file from 0. Select the columns you need first: they are shuffled."""
    rows = running_sums(blocks, ["filing_id"], ["split", "row", "part"], F.col("split"), {"_n": F.lit(1)})
    return rows.withColumn("pos", (F.col("_n") - 1).cast("int")).drop("_n", "split", "row", "part")
