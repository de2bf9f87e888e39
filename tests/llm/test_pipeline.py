"""Every stage on its own input, and the registered queries against their SQL."""

from __future__ import annotations

from collections import Counter, defaultdict

import duckdb
import pytest
from test_quality import plain_counts
from test_secrets import plain as plain_secrets
from test_near_copies import plain_groups

import __spark_entry__ as contract
import corpus_pipeline
from tidemark.llm import mixing, queries, secrets
from tidemark.llm import stages as stages_module
from tools.check_oracles import TABLES, canonical

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of the documents and of every stage, each written and read again."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, tables[-1], SMALL).write.parquet(path)
        tables.append(spark.read.parquet(path))
    return tables


def test_columns(stages):
    for table in stages[1:-1]:
        assert table.columns == stages[0].columns


def test_quality_drops_what_fails_and_nothing_new_appears(stages):
    given, kept = ({r.doc_id: r for r in t.collect()} for t in stages[:2])
    assert kept.items() <= given.items()
    for key, row in given.items():
        words, _, _, _, repeated = plain_counts(row.text)
        if words < 20 or 100 * repeated > 30 * words:
            assert key not in kept
    assert len(kept) > 0.7 * len(given)


def test_one_of_each_group(stages):
    given = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert Counter(r.doc_id for r in stages[2].collect()) == plain_groups(given)


def test_secrets_are_masked(stages):
    given, masked = ({r.doc_id: r for r in t.collect()} for t in stages[2:4])
    assert given.keys() == masked.keys()
    for key, row in given.items():
        found = plain_secrets(row.text)
        assert not plain_secrets(masked[key].text)
        assert masked[key].n_chars == (row.n_chars if masked[key].text == row.text else len(masked[key].text))
        if found:
            assert secrets.MASK in masked[key].text


def test_mixing_keeps_all_rows(stages):
    given, mixed = (Counter(tuple(r) for r in t.collect()) for t in stages[3:5])
    assert given == mixed


def test_packing_covers_every_document(stages):
    pieces = defaultdict(list)
    for p in stages[5].collect():
        pieces[p.doc_id].append((p.start, p.length, p.doc_tokens))
    assert pieces.keys() == {r.doc_id for r in stages[4].collect()}
    for parts in pieces.values():
        at = 0
        for start, length, total in sorted(parts):
            assert start == at
            at += length
        assert at == total


def packed_order(rows):
    return [p.doc_id for p in sorted((p for p in rows if p.start == 0), key=lambda p: (p.sequence_id, p.offset))]


def test_the_mixture_reaches_the_sequences(spark, stages):
    """Rows of one section of the mixed table stay together in the stream, in its order."""
    place = {r.doc_id: (r.f, r.i // stages_module.SECTION_ROWS) for r in stages[4].selectExpr(
        "doc_id", "_metadata.file_path f", "_metadata.row_index i").collect()}
    seen = [place[key] for key in packed_order(stages[5].collect())]
    assert seen == sorted(seen)
    assert mixing.schedule(stages[3]).count() == len(seen)


def test_the_mixture_of_one_file_reaches_the_sequences(spark, tmp_path, monkeypatch):
    """Two sources take turns in one file: in the stream neither is ever a section ahead."""
    monkeypatch.setattr(stages_module, "SECTION_ROWS", 8)
    body = {0: "sea and sky and sea ", 1: "stone of the old hill "}
    rows = [(i, body[i % 2] * (3 + i % 5) + str(i), "en", "ab"[i % 2], 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    assert len(mixed.inputFiles()) == 1
    order = packed_order(corpus_pipeline.STAGES[-1][1](spark, mixed, SMALL).collect())
    assert sorted(order) == list(range(400)) and order != sorted(order)
    ahead = 0
    for key in order:
        ahead += 1 if key % 2 else -1
        assert abs(ahead) <= 8
    assert [key // 8 for key in order] == sorted(key // 8 for key in order)
    # Rows that were never in a file are written first.
    assert len(corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()) >= 400


def test_run_is_the_composition(spark, stages):
    keys = lambda t: Counter((r.doc_id, r.start_0) for r in t.selectExpr("doc_id", "doc_tokens start_0").distinct().collect())
    assert keys(corpus_pipeline.run(spark, SMALL)) == keys(stages[5])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    ours = queries.QUERIES[name](spark, SMALL).toPandas()
    theirs = db.execute(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_all_queries_are_registered():
    names = contract.queries().keys()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
