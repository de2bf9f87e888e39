"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import tune

# Words are runs of anything but the ASCII blanks 20 and 09 to 0D.
BLANKS = r"[\x20\x09-\x0D]+"

# Rows and bytes in one Arrow batch, whichever comes first, and bytes in a row group of a
# written table: what a Python worker or a writer beside a full heap can hold, several at once.
ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20
ROW_GROUP_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings of this package: those of ``tune``, small Arrow batches and row groups."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("parquet.block.size", str(ROW_GROUP_BYTES))
    return spark


def words_of(text: Column) -> Column:
    """The words of a text (null: none) as an array, without a lambda per word."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def byte_words(text: str | None) -> list[bytes]:
    """Words of the text as UTF-8, A-Z in lower case; no other letter changes."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def packed(docs: DataFrame, name: str = "_row") -> DataFrame:
    """The whole row as one struct, so that own columns cannot clash with the given."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name))
