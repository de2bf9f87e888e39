"""Documents to packed training sequences, one written table per stage.

Each stage reads all rows that the one before it kept. Quality rules drop documents;
near-dedup keeps one of each group; the secret scan masks what it finds; mixing puts the
rest in the order of its schedule, files in name order and rows in file order; packing
takes ``SECTION_ROWS`` rows of that order at a time, so the mixture reaches the sequences,
and orders documents along the curve inside each such section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, near_copies, packing, quality, secrets
from tidemark.llm.common import prepared, table
from tidemark.session import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    prepared(spark)
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: five-word
    shingles with a Jaccard similarity of 0.8 or more."""
    prepared(spark)
    return near_copies.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    prepared(spark)
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the schedule."""
    prepared(spark)
    return mixing.interleave(docs)


# Rows of the mixed table that packing may put in an order of its own.
SECTION_ROWS = 128


def _section() -> Column:
    """File and place of a row in the mixed table, ``SECTION_ROWS`` rows together."""
    number = F.expr(f"_metadata.row_index div {SECTION_ROWS}").cast("string")
    return F.concat(F.col("_metadata.file_path"), F.lit("#"), F.lpad(number, 12, "0"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, sections in the order of the mixed table.

    ``docs`` is a table read from files, as every stage's is here; rows of anything else
    are written first.
    """
    prepared(spark)
    if not docs.inputFiles():
        docs = written(docs, "pipeline-mixed")
    return packing.pack(docs.withColumn("_section", _section()), section="_section")


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("secret scan", secret_scan),
    ("mix", mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = written(docs, "pipeline-" + name.replace(" ", "-"))
    return docs


# The near-duplicate groups and the learned formats cannot be stated in SQL; the tests
# hold every stage against a brute-force version instead.
ORACLE_SQL = None
