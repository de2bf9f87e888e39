"""Documents built from narrow rows: how they are spread over tasks, and how often parsed."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import catalog
from catalog import documents
from catalog.tables import table
from tools.check_oracles import TABLES, canonical

SMALL = "/root/testdata/sf0.001"

# The findings' queries: the work on each table's documents was one task however large it was.
SPREAD = ["upcoming_stubs", "live_panel", "next_period", "audit_report"]


@pytest.mark.parametrize("name", SPREAD)
def test_documents_are_built_in_many_tasks(spark, monkeypatch, name):
    seen, plain = [], documents._parsed

    def watched(bodies, schema):
        if schema == documents.captures.BOOTSTRAP:
            seen.append(bodies.rdd.getNumPartitions())
        return plain(bodies, schema)

    monkeypatch.setattr(documents, "_parsed", watched)
    monkeypatch.setattr(documents, "BOOTSTRAPS_PER_TASK", 15, raising=False)
    monkeypatch.setattr(documents, "DOCUMENTS_PER_TASK", 15, raising=False)
    ours = catalog.QUERIES[name](spark, SMALL).toPandas()
    rows = table(spark, SMALL, "customer").count()
    assert seen and min(seen) == -(-rows // 15) > 4
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    theirs = db.execute(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_yearly_records_are_built_in_many_tasks(spark, monkeypatch):
    """They took the session's partitions, merged to one for each core, however many they were."""
    seen, plain = [], documents._parsed

    def watched(bodies, schema):
        if schema == documents.captures.SUMMARY:
            seen.append(bodies.rdd.getNumPartitions())
        return plain(bodies, schema)

    monkeypatch.setattr(documents, "_parsed", watched)
    monkeypatch.setattr(documents, "DOCUMENTS_PER_TASK", 50)
    ours = catalog.QUERIES["official_totals"](spark, SMALL).toPandas()
    orders = table(spark, SMALL, "orders").count()
    assert seen == [-(-orders // 50)] and seen[0] > 16
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    theirs = db.execute(catalog.ORACLES["official_totals"]).df()
    assert canonical(ours) == canonical(theirs)


# Queries that read entities, stubs and periods of the same documents.
PARSED_ONCE = ["forecast_next_period", "forecast_from_state"]


@pytest.mark.parametrize("name", PARSED_ONCE)
def test_documents_are_parsed_once(spark, monkeypatch, name):
    met, plain = spark.sparkContext.accumulator(0), documents.bootstrap_documents

    @F.udf("string")
    def counting(run):
        met.add(1)
        return run

    monkeypatch.setattr(
        documents, "bootstrap_documents",
        lambda *given: plain(*given).withColumn("run", counting.asNondeterministic()("run")))
    assert catalog.QUERIES[name](spark, SMALL).count()
    assert met.value == table(spark, SMALL, "customer").count()


@pytest.mark.parametrize("name", ["live_panel", "live_context"])
def test_documents_are_parsed_once_for_all_columns(spark, monkeypatch, name):
    """Collected, as a count leaves out the columns that one of the readers needs."""
    met, plain = spark.sparkContext.accumulator(0), documents.bootstrap_documents

    @F.udf("string")
    def counting(run):
        met.add(1)
        return run

    monkeypatch.setattr(
        documents, "bootstrap_documents",
        lambda *given: plain(*given).withColumn("run", counting.asNondeterministic()("run")))
    assert catalog.QUERIES[name](spark, SMALL).collect()
    assert met.value == table(spark, SMALL, "customer").count()
