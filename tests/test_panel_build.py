from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.classes import UnknownColumnError
from tidemark.operators import combine
from tidemark.plans import panel_build
from tidemark.sources import digests, seasons

HEAD = "name,element,round,value,minutes,total_points"


def season(root, label, body, encoding="utf-8", bridge=None):
    folder = root / label
    (folder / "gws").mkdir(parents=True)
    (folder / "gws" / "merged_gw.csv").write_bytes(body.encode(encoding))
    if bridge is not None:
        (folder / "players_raw.csv").write_text(bridge)


def test_two_encodings_and_drifting_columns(spark, tmp_path):
    season(tmp_path, "2016-17", f"{HEAD}\nÁnna Própria,1,1,55,90,6\n", "latin-1")
    season(tmp_path, "2024-25", f"{HEAD}, expected_goals \nÁnna Própria,1,1,55,90,6,0.4\n")
    built = panel_build.build(spark, str(tmp_path), ["2016-17", "2017-18", "2024-25"])
    rows = {r.season: r for r in built.rows.collect()}
    assert {r.name for r in rows.values()} == {"Ánna Própria"}
    assert (rows["2016-17"].expected_goals, rows["2024-25"].expected_goals) == (None, "0.4")
    assert rows["2016-17"].code is None and rows["2016-17"].provenance == "backfill"

    about = {r.season: r for r in built.seasons.collect()}
    assert (about["2016-17"].encoding, about["2024-25"].encoding) == ("latin-1", "utf-8")
    assert (about["2016-17"].columns, about["2024-25"].columns) == (6, 7)
    assert about["2017-18"].status == "not vendored" and about["2017-18"].rows == 0

    summary = built.summary.first()
    assert summary.rows == 2 and not summary.point_in_time
    covered = {c.column: c.seasons for c in summary.coverage}
    assert covered["expected_goals"] == ["2024-25"] and covered["code"] == []
    assert summary.column_classes.pre_deadline == ["value"]


def test_guards(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        panel_build.build(spark, str(tmp_path / "absent"), ["2024-25"])
    with pytest.raises(FileNotFoundError):
        panel_build.build(spark, str(tmp_path), ["2024-25"])
    season(tmp_path, "2024-25", f"{HEAD},mystery\nA,1,1,55,90,6,3\n")
    with pytest.raises(UnknownColumnError, match="mystery"):
        panel_build.build(spark, str(tmp_path), ["2024-25"])
    with pytest.raises(ValueError, match="provenance"):
        combine.align([spark.range(1).toDF("code")])
    with pytest.raises(FileNotFoundError):
        combine.align([])


def test_ragged_and_quoted_lines(spark, tmp_path):
    season(tmp_path, "2024-25", f'{HEAD}\nA,1,1,55,90,6,extra\n"B, ""b""",2,1\n')
    rows = {r.element: r for r in panel_build.build(spark, str(tmp_path), ["2024-25"]).rows.collect()}
    assert rows["1"].total_points == "6"
    assert rows["2"].name == 'B, "b"' and rows["2"].total_points is None


def test_line_breaks_inside_quotes(spark, tmp_path):
    """One season has them, the other keeps its split reading; the ids file has one too."""
    season(tmp_path, "2023-24", f'{HEAD}\n"A\nB",1,1,55,90,6\n"C ""\n""D",2,1,45,80,3\n',
           bridge='id,code,first_name\n1,71,"x\ny"\n2,72,z\n')
    season(tmp_path, "2024-25", f"{HEAD}\nE,3,1,55,90,6\n")
    found = seasons.detect_formats(spark, str(tmp_path), ["2023-24", "2024-25"], "gws/merged_gw.csv")
    assert {r.season: r.multi_line for r in found.collect()} == {"2023-24": True, "2024-25": False}
    built = panel_build.build(spark, str(tmp_path), ["2023-24", "2024-25"])
    assert {(r.name, r.code, r.total_points) for r in built.rows.collect()} == {
        ("A\nB", "71", "6"), ('C "\n"D', "72", "3"), ("E", None, "6")}


def test_bridge_follows_a_player_over_reassigned_ids(spark, tmp_path):
    head = "id,code,first_name,second_name\n"
    season(tmp_path, "2019-20", f"{HEAD}\nEdwin Q,31,1,45,90,6\nX,12,1,45,90,6\n",
           bridge=head + "31,1,old,entry\n,5,no,id\n31,700123,Edwin,Q\n")
    season(tmp_path, "2025-26", f"{HEAD}\nEd Q,88,1,55,90,8\n",
           bridge=head + "88,700123,Ed,Q\n")
    season(tmp_path, "2026-27", f"{HEAD}\nEd Q,7,1,55,90,8\n", bridge="id,first_name\n7,Ed\n")
    built = panel_build.build(spark, str(tmp_path), ["2019-20", "2025-26", "2026-27"])
    codes = {(r.season, r.element): r.code for r in built.rows.collect()}
    # Of two rows for one id the later counts; an id without a row has no code.
    assert codes == {
        ("2019-20", "31"): "700123", ("2019-20", "12"): None,
        ("2025-26", "88"): "700123", ("2026-27", "7"): None,
    }


def test_written_panel_reads_back_by_season(spark, tmp_path):
    source, dest = tmp_path / "in", tmp_path / "out"
    season(source, "2019-20", f"{HEAD}\nA,1,1,45,90,6\n")
    season(source, "2024-25", f"{HEAD}\nB,1,1,45,90,6\nB,1,2,45,90,6\n")
    built = panel_build.build(spark, str(source), ["2019-20", "2024-25"])
    panel_build.write(built.rows, built.summary, str(dest))
    one = panel_build.read(spark, str(dest)).where("season = '2024-25'")
    assert one.count() == 2
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan
    assert list((dest / "panel" / "season=2024-25").glob("*.zstd.parquet"))
    part = next((dest / "panel_summary").glob("*.json"))
    assert json.loads(part.read_text())["rows"] == 3


def test_inventory_and_digests(spark, tmp_path):
    season(tmp_path, "2019-20", f"{HEAD}\n", bridge="id,code\n")
    found = seasons.source_inventory(spark, str(tmp_path), ["2019-20", "2024-25"]).persist()
    counts = seasons.inventory_counts(found).first()
    assert (counts.ok, counts.missing) == (2, 6)
    assert found.where("file = 'players_raw.csv' and season = '2019-20'").first().bytes == 8
    found = digests.file_digests(spark, str(tmp_path), "players_raw.csv").collect()
    assert [len(d.digest) for d in found] == [64]
    notes = seasons.season_notes(spark)
    assert notes.where(F.col("season") == "2019-20").first().note.startswith("COVID")


def test_files_follow_the_bytes(spark, tmp_path):
    """Forty tasks with rows of every season; one season has most of them."""
    rows = spark.range(120_000, numPartitions=40).select(
        F.when(F.col("id") % 10 < 7, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 10)).alias("season"),
        F.sha2(F.col("id").cast("string"), 256).alias("name"), (F.col("id") % 90).alias("minutes"))
    about = spark.range(1)
    panel_build.write(rows, about, str(tmp_path / "few"))
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "few" / "panel").glob("season=*")}
    assert files == {"season=big": 1, "season=s7": 1, "season=s8": 1, "season=s9": 1}
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    panel_build.write(rows, about, str(tmp_path / "many"), file_bytes=600_000)
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "many" / "panel").glob("season=*")}
    assert files["season=big"] >= 8 and sum(files.values()) <= 40
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before
    assert panel_build.read(spark, str(tmp_path / "many")).groupBy("season").count().count() == 4
    assert panel_build.read(spark, str(tmp_path / "many")).count() == 120_000
