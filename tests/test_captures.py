from __future__ import annotations

import gzip
import hashlib
import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import audit, baselines, live
from tidemark.plans import forecast, prediction_log
from tidemark.sources import captures

URL = "https://example.com/bootstrap"


def event(i, current=False, following=False):
    return {"id": i, "is_current": current, "is_next": following,
            "deadline_time": f"2098-{7 + i:02d}-15T17:30:00Z"}


def element(i, **more):
    return {"id": i, "code": 900 + i, "first_name": f"Añ{i}", "second_name": f"Bé{i}",
            "element_type": 1 + i % 2, "team": 3, "selected_by_percent": "12.5", "now_cost": 50 + i,
            "transfers_in_event": 10 * i, "transfers_out_event": None, "ep_next": f"{i}.5",
            "status": "a", "chance_of_playing_next_round": None, "news": "", **more}


def bootstrap(events, elements):
    return {"events": events, "elements": elements, "total_players": 1001,
            "element_types": [{"id": 1, "singular_name_short": "GKP"},
                              {"id": 2, "singular_name_short": "MID"}],
            "teams": [{"id": 3, "name": "Reds"}]}


def history(i, rounds):
    return {"history": [{"round": r, "minutes": 90, "total_points": i + r, "value": 50,
                         "was_home": r % 2 == 0, "saves": None} for r in rounds],
            "history_past": [{"season_name": "2021/22", "total_points": 100 + i}]}


def put(root, run, name, document):
    path = root / run / f"{name}.gz"
    path.parent.mkdir(parents=True, exist_ok=True)
    body = document if isinstance(document, bytes) else json.dumps(document).encode()
    path.write_bytes(gzip.compress(body))


@pytest.fixture
def archive(tmp_path):
    root = tmp_path / "raw"
    events = [event(1), event(2, current=True), event(3, following=True)]
    for run in ("2098-08-31T14-03-22Z.2", "2098-08-31T14-03-22Z.10"):
        put(root, run, "bootstrap-static.json", bootstrap(events, [element(1), element(2), element(3)]))
        for i in (1, 2):
            put(root, run, f"element-summary/{i}.json", history(i, [1, 2]))
        (root / run / "manifest.json").write_text(json.dumps(
            {"gameweek": {"current_event": 2}, "counts": {"ok": 4, "failed": 1},
             "entries": [{"url": "z", "path": "z.gz"}, {"url": URL, "path": "b.gz"},
                         {"url": "a", "path": None, "status": 503, "error": "gone"}]}, indent=1))
    # A later light run: over, without per-entity documents, with a broken manifest.
    put(root, "2098-09-01T00-00-00Z", "bootstrap-static.json", bootstrap([event(3)], [element(1)]))
    (root / "2098-09-01T00-00-00Z" / "manifest.json").write_text("{broken")
    return str(root)


FULL = "2098-08-31T14-03-22Z.10"


def test_runs_in_order_and_newest_full_run(spark, archive):
    runs = captures.list_runs(spark, archive)
    assert [r.run[-4:] for r in runs.collect()] == ["2Z.2", "Z.10", "-00Z"]
    newest = captures.newest_full_run(captures.read_summaries(spark, archive))
    assert newest.first().run == FULL
    none = captures.read_summaries(spark, archive).where("false")
    assert captures.newest_full_run(none).count() == 0
    log = {r.run: r for r in captures.capture_log(runs, captures.read_manifests(spark, archive)).collect()}
    assert (log[FULL].current_event, log[FULL].ok, log[FULL].failed) == (2, 4, 1)
    assert not log["2098-09-01T00-00-00Z"].readable
    named = spark.sql("select timestamp'2098-08-31 14:03:22' as t").select(
        scalars.run_name(F.col("t")).alias("n")).first().n
    assert named == "2098-08-31T14-03-22Z"


def test_manifest_functions(spark, archive):
    manifests = captures.read_manifests(spark, archive)
    usable = {r.run: r.usable for r in captures.usable(manifests, URL).collect()}
    assert usable[FULL] and not usable["2098-09-01T00-00-00Z"]
    lost = {r.run: r.usable for r in captures.usable(manifests, "a").collect()}
    assert not lost[FULL]
    document = captures.manifest_document(captures.manifest_entries(manifests)).where(
        F.col("run") == FULL).first()
    assert (document.ok, document.failed) == (2, 1)
    assert [e.url for e in document.entries] == sorted(e.url for e in document.entries)


def test_payload_digests_are_of_the_bytes_as_received(spark, archive, tmp_path):
    body = b'{"a" : [ 1,2 ],\n  "b":"S\\u00e1",\r\n "c": "\xc3\xa9" }\n'
    put(tmp_path / "raw", FULL, "odd.json", body)
    rows = captures.payload_digests(spark, archive).where(F.col("run") == FULL).collect()
    got = {r.path: (r.bytes, r.sha256) for r in rows}
    assert got["odd.json.gz"] == (len(body), hashlib.sha256(body).hexdigest())
    assert set(got) == {"odd.json.gz", "bootstrap-static.json.gz",
                        "element-summary/1.json.gz", "element-summary/2.json.gz"}


def test_documents_of_all_runs(spark, archive):
    boot = captures.read_bootstrap(spark, archive)
    context = {r.run: r for r in captures.period_context(boot).collect()}
    assert tuple(context[FULL])[1:] == (2, 3, "2098-10-15T17:30:00Z")
    assert tuple(context["2098-09-01T00-00-00Z"])[1:] == (None, None, None)
    assert {r.season for r in captures.season_label(boot).collect()} == {"2098-99"}
    assert captures.next_period(boot).count() == 2
    assert captures.listed_entities(boot).count() == 7
    first = captures.entity_dimension(boot).where("element = '1'").first()
    assert (first.code, first.name, first.position, first.team) == ("901", "Añ1 Bé1", "MID", "Reds")


def test_a_damaged_document_is_counted_not_fatal(spark, archive, tmp_path):
    put(tmp_path / "raw", FULL, "element-summary/3.json", b"{not json")
    summaries = captures.read_summaries(spark, archive).persist()
    counts = {r.run: r.unreadable for r in captures.unreadable(summaries).collect()}
    assert counts[FULL] == 1
    boot = captures.read_bootstrap(spark, archive)
    assert live.completed_history(boot, summaries).where(F.col("run") == FULL).count() == 4


def test_season_without_deadlines(spark):
    boot = spark.createDataFrame([("r", [{"deadline_time": ""}])],
                                 "run string, events array<struct<deadline_time:string>>")
    assert captures.season_label(boot).first().season is None
    with pytest.raises(Exception, match="no deadline"):
        captures.season_label(boot, strict=True).collect()


def test_live_rows(spark, archive):
    boot, summaries = captures.read_bootstrap(spark, archive), captures.read_summaries(spark, archive)
    rows = live.build(boot, summaries).where(F.col("run") == FULL).persist()
    done = rows.where("element = '2' and round = '2'").first()
    assert (done.total_points, done.was_home, done.saves, done.provenance) == ("4", "true", None, "capture")
    stub = rows.where("element = '2' and round = '3'").first()
    assert (stub.value, stub.selected, stub.transfers_balance, stub.xP) == ("52", "125", "20", "2.5")
    assert (stub.minutes, stub.news, stub.transfers_out) == (None, None, "0")
    about = {r.run: r for r in live.context(boot, summaries).collect()}
    assert (about[FULL].completed_rows, about[FULL].upcoming_rows) == (4, 3)
    assert about["2098-09-01T00-00-00Z"].upcoming_rows == 0


def test_forecast_from_newest_full_run_to_log(spark, archive, tmp_path):
    log = str(tmp_path / "log")
    about = forecast.forecast(spark, archive, log, code_version="abc")
    assert (about["run"], about["season"], about["next_gameweek"]) == (FULL, "2098-99", 3)
    rows = prediction_log.read_predictions(spark, log).where("model = 'rolling_mean5'")
    got = {r.code: (r.prediction, r.rank) for r in rows.collect()}
    # Player 3 has no history and so counts as nothing, not as missing.
    assert got == {"902": (3.5, 1), "901": (2.5, 2), "903": (0.0, 3)}
    entries = prediction_log.read_manifest(spark, log).collect()
    assert {e.model for e in entries} == set(baselines.RULES)
    assert {(e.capture, e.code_version, e.rows) for e in entries} == {(FULL, "abc", 3)}
    assert json.loads(entries[0].context)["upcoming_rows"] == 3
    with pytest.raises(FileExistsError):
        forecast.forecast(spark, archive, log)
    with pytest.raises(ValueError, match="has passed"):
        forecast.forecast(spark, archive, str(tmp_path / "late"), now=datetime(2099, 1, 1, tzinfo=UTC))
    with pytest.raises(ValueError, match="no per-entity history"):
        forecast.forecast(spark, archive, log, capture="2098-09-01T00-00-00Z")


def test_audit_by_code_and_by_name(spark, archive):
    boot, summaries = captures.read_bootstrap(spark, archive), captures.read_summaries(spark, archive)
    official = audit.official_totals(boot, summaries).where(F.col("run") == FULL).persist()
    assert {(r.code, r.name_n, r.season, r.official_points) for r in official.collect()} == {
        ("901", "an1 be1", "2021-22", 101), ("902", "an2 be2", "2021-22", 102)}
    panel = spark.createDataFrame(
        [("2021-22", "901", "Añ1_Bé1", "100"), ("2021-22", "901", "Añ1 Be1", "1"),
         ("2021-22", "902", "An2 Be2 77", "90"), ("2021-22", "902", "An2 Be2 77", "7.5"),
         ("2021-22", None, "An2 Be2", "5"), ("2021-22", "903", "x", None)],
        "season string, code string, name string, total_points string")
    matched = audit.matched_totals(official, panel).persist()
    assert tuple(audit.agreement(matched).first()) == (2, 1, 0.5, None)
    assert [tuple(r) for r in audit.disagreements(matched).collect()] == [("902", "2021-22", 102, 90)]
    uncoded = panel.withColumn("code", F.lit(None).cast("string"))
    by_name = {r.name_n: r for r in audit.matched_totals(official, uncoded).collect()}
    # Two spellings fold to one name and are summed before they are compared.
    assert (by_name["an1 be1"].backfill_points, by_name["an1 be1"].spellings) == (101, 2)
    assert by_name["an2 be2"].backfill_points == 95
    empty = audit.agreement(audit.matched_totals(official.where("false"), panel)).first()
    assert (empty.matched, empty.agreement_rate, empty.note) == (0, None, "nothing matched")
