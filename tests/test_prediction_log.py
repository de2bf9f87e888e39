from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidemark.plans import commits
from tidemark.plans import prediction_log as log

FUTURE, PAST = "2099-01-01T00:00:00Z", "2000-01-01T00:00:00Z"


def frame(spark, top=5.0):
    return spark.createDataFrame(
        [("1", "A", "MID", top), ("2", "B", "DEF", top / 2), ("3", "C", "DEF", top / 2),
         ("4", "D", "GK", None)],
        "code string, name string, position string, prediction double",
    )


def write(spark, root, model="m1", deadline=FUTURE, **more):
    args = {"season": "2026-27", "gameweek": 3, "capture": "cap", **more}
    return log.write(spark, root, deadline=deadline, predictions={model: frame(spark)}, **args)


def test_rows_are_ranked_and_described(spark, tmp_path):
    root = str(tmp_path)
    assert log.list_logged(spark, root).count() == 0
    write(spark, root, context={"why": "test"})
    rows = log.read_predictions(spark, root)
    assert {r.code: r["rank"] for r in rows.collect()} == {"1": 1, "2": 2, "3": 3, "4": 4}
    entry = log.read_manifest(spark, root).first()
    assert (entry.rows, entry.capture, entry.gameweek, entry.context) == (
        4, "cap", "gw03", '{"why": "test"}')
    assert entry.made_at < entry.deadline and len(entry.digest) == 64
    stored = rows.drop("season", "gameweek", "model")
    assert log.content_digest(stored).first().digest == entry.digest
    assert log.content_digest(stored.where("code <> '4'")).first().digest != entry.digest


def test_models_may_be_added_but_never_rewritten(spark, tmp_path):
    root = str(tmp_path)
    write(spark, root)
    write(spark, root, "m2", deadline=None)
    with pytest.raises(FileExistsError, match="m1"):
        write(spark, root)
    entries = log.read_manifest(spark, root).collect()
    assert {e.model for e in entries} == {"m1", "m2"}
    assert len({e.first_written_at for e in entries}) == 1
    write(spark, root, gameweek=12)
    assert [r.gameweek for r in log.list_logged(spark, root).collect()] == ["gw03", "gw12"]


def test_late_writes_leave_nothing_behind(spark, tmp_path):
    with pytest.raises(ValueError, match="has passed"):
        write(spark, str(tmp_path), deadline=PAST)
    assert list(tmp_path.iterdir()) == []


def test_a_broken_off_write_leaves_the_model_free(spark, tmp_path, monkeypatch):
    """Rows are there, their manifest row is not: nothing is read, and writing works."""
    root = str(tmp_path)

    def broken(rows, by=()):
        raise RuntimeError("lost between rows and manifest")

    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        patch.setattr(log, "content_digest", broken)
        write(spark, root)
    assert list((tmp_path / "predictions").rglob("*.parquet"))
    assert log.read_predictions(spark, root).count() == 0
    write(spark, root)
    assert log.read_predictions(spark, root).count() == 4
    assert log.list_logged(spark, root).count() == 1


def test_names_that_look_like_numbers_stay_text(spark, tmp_path):
    assert log.read_predictions(spark, str(tmp_path)).count() == 0
    write(spark, str(tmp_path), "2024")
    assert {r.model for r in log.read_predictions(spark, str(tmp_path)).collect()} == {"2024"}


def racing(spark, root, models, monkeypatch, gameweeks=None):
    """Writers that have all passed their first check before any of them commits."""
    together = threading.Barrier(len(models), timeout=120)
    plain = log.commits.commit

    def waiting(*args):
        together.wait()
        return plain(*args)

    monkeypatch.setattr(log.commits, "commit", waiting)
    with ThreadPoolExecutor(len(models)) as pool:
        tries = [pool.submit(write, spark, root, m) for m in models]
        return [t.exception() for t in tries]


def test_of_two_racing_writers_of_one_model_one_is_refused(spark, tmp_path, monkeypatch):
    failures = racing(spark, str(tmp_path), ["m1", "m1"], monkeypatch)
    assert sorted(type(f).__name__ for f in failures) == ["FileExistsError", "NoneType"]
    assert log.read_manifest(spark, str(tmp_path)).count() == 1
    assert log.read_predictions(spark, str(tmp_path)).count() == 4
    assert log.snapshot(spark, str(tmp_path)) == 1


def test_racing_writers_of_different_models_both_land(spark, tmp_path, monkeypatch):
    assert racing(spark, str(tmp_path), ["m1", "m2", "m3"], monkeypatch) == [None] * 3
    assert commits.versions(spark, str(tmp_path / "manifest")) == [1, 2, 3]
    assert {r.model for r in log.read_predictions(spark, str(tmp_path)).collect()} == {"m1", "m2", "m3"}


def test_a_snapshot_does_not_change(spark, tmp_path):
    root = str(tmp_path)
    write(spark, root)
    then = log.snapshot(spark, root)
    write(spark, root, "m2")
    write(spark, root, gameweek=4)
    assert log.read_manifest(spark, root, then).count() == 1
    assert {r.model for r in log.read_predictions(spark, root, then).collect()} == {"m1"}
    assert log.list_logged(spark, root, then).count() == 1
    assert log.read_predictions(spark, root).count() == 12


def test_many_periods_in_one_commit(spark, tmp_path):
    root = str(tmp_path)
    rows = frame(spark).withColumns({
        "season": F.lit("2026-27"), "model": F.explode(F.array(F.lit("m1"), F.lit("m2"))),
    }).withColumn("gameweek", F.explode(F.sequence(F.lit(1), F.lit(12))))
    assert log.write_all(spark, root, rows, capture="cap", deadlines={("2026-27", 3): FUTURE}) == 1
    assert log.read_manifest(spark, root).count() == 24
    assert log.read_manifest(spark, root).where("deadline is not null").count() == 2
    assert log.read_predictions(spark, root).groupBy("gameweek", "model").agg(F.max("rank").alias("r")).where("r <> 4").count() == 0
    with pytest.raises(FileExistsError, match="gw05 holds m1"):
        write(spark, root, gameweek=5)
    with pytest.raises(ValueError, match="has passed"):
        log.write_all(spark, root, rows.withColumn("season", F.lit("x")), capture="c", deadlines={("x", 1): PAST})
    # One file a period and model, however many tasks made them.
    assert len(list((tmp_path / "predictions").rglob("*.parquet"))) == 24


@pytest.mark.parametrize("scheme", ["", "file:"])
def test_a_taken_name_is_left_alone(spark, tmp_path, scheme):
    path = f"{scheme}{tmp_path}/0000000001.json"
    assert commits.put_if_absent(spark, path, "first")
    assert not commits.put_if_absent(spark, path, "second")
    assert (tmp_path / "0000000001.json").read_text() == "first"
    assert [p.name for p in tmp_path.iterdir() if "draft" in p.name] == []


def test_no_number_is_given_twice(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda i: commits.commit(spark, str(tmp_path), [{"i": i}], lambda seen: None), range(24)))
    assert sorted(numbers) == list(range(1, 25))
    assert {r.i for r in commits.entries(spark, str(tmp_path), "i int").collect()} == set(range(24))
