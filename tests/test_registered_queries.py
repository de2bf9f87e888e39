from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
import catalog
from tools.check_oracles import TABLES, canonical

SMALL = "/root/testdata/sf0.001"
SAMPLE = [
    "demo_panel", "feature_set", "average_rank", "leaderboard", "column_coverage", "code_bridge",
    "folded_names", "period_context", "audit_report",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, db, name):
    ours = contract.queries()[name](spark, SMALL).toPandas()
    theirs = db.execute(contract.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_every_query_has_its_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
    assert set(contract.oracle_sql()) <= set(contract.queries())
