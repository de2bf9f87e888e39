"""Digests of files of any size, from split files.

A small file has its SHA-256. A larger one is never held by a task: its lines are digested
where they are read, numbered through the file by adding up the lines of the splits before,
and joined ``FAN`` neighbours at a time, level by level, until one digest is left. That
depends on the bytes and on nothing else, however the file is split. A line ends with a line
feed and keeps everything else, so the root over lines and the file's length stand for its
bytes. Packed files are digested as unpacked, without their stored length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import counted, written

# Up to here a file is read as a whole.
SMALL = 64 << 20

# Digests joined into one.
FAN = 1024


def _numbered(lines: DataFrame) -> DataFrame:
    """file, no (from 0 through the whole file) and digest of every line."""
    in_split = Window.partitionBy("file", "split").orderBy("at")
    placed = written(lines.withColumn("_no", (F.row_number().over(in_split) - 1).cast("long")), "digests-of-lines")
    splits = placed.groupBy("file", "split").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    first = splits.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    return placed.join(counted(first, "digests-of-splits"), ["file", "split"]).select(
        "file", (F.col("_first") + F.col("_no")).alias("no"), "digest", "bytes")


def tree_of_lines(lines: DataFrame, fan: int = FAN) -> DataFrame:
    """file, lines, bytes (of the lines, without line ends) and the root of its tree.

    ``lines`` has file, split, at (an order within the split), digest (binary) and bytes.
    """
    level = written(_numbered(lines), "digests-level")
    most = level.groupBy("file").agg(F.count("*").alias("lines"), F.sum("bytes").alias("bytes"))
    most = written(most, "digests-sizes")
    width = most.agg(F.max("lines")).first()[0] or 0
    while width > 1:
        # ``fan`` neighbours at most, in their order.
        joined = F.sort_array(F.collect_list(F.struct("no", "digest")))["digest"]
        level = level.groupBy("file", F.expr(f"no div {fan}").alias("no")).agg(joined.alias("_all")).select(
            "file", "no", F.unhex(F.sha2(F.array_join(F.transform("_all", F.hex), "").cast("binary"), 256)).alias("digest"))
        level = written(level, "digests-level")
        width = -(-width // fan)
    return level.select("file", "digest").join(most, "file").select("file", "lines", "bytes", F.lower(F.hex("digest")).alias("root"))


def lines_of(spark: SparkSession, paths: str | list[str], wanted: Column | None = None, **options: str) -> DataFrame:
    """Digest of every line of the files that meet ``wanted``, a condition on file metadata."""
    read = spark.read.options(lineSep="\n", **options).text(paths)
    rows = read if wanted is None else read.where(wanted)
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), F.unhex(F.sha2(F.col("value").cast("binary"), 256)).alias("digest"),
        F.octet_length("value").cast("long").alias("bytes"))


def file_digests(spark: SparkSession, root: str, glob: str = "*", small: int = SMALL, fan: int = FAN) -> DataFrame:
    """path, length and digest of each stored file: a SHA-256 in hex, or for files larger than
    ``small`` bytes ``tree:`` and the SHA-256 over root, lines and length."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    # The reader leaves files alone that the condition on their length excludes.
    whole = reader.load(root).where(F.col("length") <= small).select("path", "length", F.sha2("content", 256).alias("digest"))
    large = reader.load(root).where(F.col("length") > small).select("path", "length")
    if large.isEmpty():
        return whole
    size = F.col("_metadata.file_size")
    tree = tree_of_lines(lines_of(spark, root, size > small, recursiveFileLookup="true", pathGlobFilter=glob), fan)
    name = lambda c: F.regexp_replace(c, "^file:/+", "/")
    described = F.concat_ws("|", "root", "lines", "length")
    deep = large.join(tree, name(F.col("path")) == name(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))), "left")
    return whole.unionByName(deep.select("path", "length", F.concat(F.lit("tree:"), F.sha2(described, 256)).alias("digest")))
