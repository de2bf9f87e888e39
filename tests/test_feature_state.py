from __future__ import annotations

import gzip
import json
import math
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features
from tidemark.plans import feature_state, forecast, prediction_log
from tidemark.plans.feature_state import FeatureState
from tidemark.spec import PanelSpec

SPEC = PanelSpec()
SCHEMA = "season string, code string, round double, kickoff_time string, fixture string, total_points double, minutes double, position string"


def made(seed=2, periods=14, entities=12):
    """Two seasons, double fixtures, missing values, one entity with many rows."""
    rng = random.Random(seed)
    rows = []
    for season in ("a", "b"):
        for e in range(entities):
            for p in range(1, periods + 1):
                for fixture in range(6 if e == 0 else rng.choice([0, 1, 1, 1, 2])):
                    points = None if rng.random() < 0.1 else float(rng.randrange(15))
                    minutes = None if rng.random() < 0.1 else float(rng.choice([0, 30, 90]))
                    rows.append((season, f"e{e}", float(p), f"t{p:02d}{fixture}", None, points, minutes, "x"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def plain(state):
    """States by key; the digest tells all rows."""
    return {(r.season, r.code): tuple(r) for r in state.collect()}


def same(left, right):
    assert left.keys() == right.keys()
    for key in left:
        for a, b in zip(left[key], right[key]):
            assert a == b or (isinstance(a, float) and math.isclose(a, b)), (key, a, b)


def test_after_many_captures_it_equals_a_rebuild(spark):
    rows, how = made(), FeatureState()
    state = feature_state.written(how.fold(frame(spark, [r for r in rows if r[2] <= 3])), "t")
    for upto in (4, 7, 7, 11, 14):
        history = frame(spark, [r for r in rows if r[2] <= upto])
        state = feature_state.written(how.advance(state, history), "t")
        same(plain(state), plain(how.fold(history)))


def test_history_changed_in_hindsight_is_folded_again(spark):
    rows, how = made(), FeatureState()
    state = feature_state.written(how.fold(frame(spark, [r for r in rows if r[2] <= 8])), "t")
    changed = []
    for r in rows:
        if r[1] == "e3" and r[2] == 2:
            r = (*r[:5], 99.0, *r[6:])  # a corrected value
        if r[1] == "e4" and r[2] == 1:
            continue  # a row that was taken back
        if r[1] != "e5":  # an entity that left
            changed.append(r)
    changed.append(("b", "new", 3.0, "t030", None, 1.0, 90.0, "x"))
    changed.append(("b", "e6", 2.0, "t0000", None, 7.0, 90.0, "x"))  # a row that came late
    history = frame(spark, changed)
    same(plain(how.advance(state, history)), plain(how.fold(history)))


def test_only_new_rows_are_folded(spark, monkeypatch):
    rows, how = made(), FeatureState()
    state = feature_state.written(how.fold(frame(spark, [r for r in rows if r[2] <= 13])), "t")
    folded = []
    plain_fold = FeatureState._fold
    monkeypatch.setattr(FeatureState, "_fold", lambda self, rows: (folded.append(rows.count()), plain_fold(self, rows))[1])
    how.advance(state, frame(spark, rows)).collect()
    assert folded == [sum(r[2] == 14 for r in rows)]


def test_features_equal_those_of_the_whole_history(spark):
    rows, how = made(), FeatureState()
    history = [r for r in rows if r[2] <= 10]
    targets = [("a", f"e{i}", 11.0, None, None, None, None, "x") for i in range(12)] + [("b", "nobody", 11.0, None, None, None, None, "x")]
    names = [f.name for f in features.standard_features(SPEC)] + ["points_per90_todate"]
    whole = features.build(frame(spark, history + targets)).where("round = 11").select("season", "code", *names)
    ours = how.attach(frame(spark, targets), how.fold(frame(spark, history))).select("season", "code", *names)
    same(plain(ours), plain(whole))


def test_nothing_to_fold(spark):
    how = FeatureState()
    nothing = frame(spark, [])
    assert how.fold(nothing).count() == 0
    state = feature_state.written(how.fold(frame(spark, made()[:20])), "t")
    assert how.advance(state, nothing).count() == 0
    same(plain(how.advance(feature_state.written(how.fold(nothing), "t"), frame(spark, made()))), plain(how.fold(frame(spark, made()))))


def put(root, run, name, document):
    path = root / run / f"{name}.gz"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(json.dumps(document).encode()))


def capture(root, run, upto, seed=1):
    """A full capture with periods up to one, the next one still to come."""
    rng = random.Random(seed)
    events = [{"id": p, "is_current": p == upto, "is_next": p == upto + 1, "deadline_time": f"2098-{p:02d}-15T17:30:00Z"} for p in range(1, 13)]
    elements = [{"id": i, "code": 900 + i, "first_name": f"A{i}", "second_name": "B", "element_type": 1, "team": 3,
                 "selected_by_percent": "12.5", "now_cost": 50 + i, "transfers_in_event": 10 * i, "ep_next": "1.5", "status": "a"} for i in range(1, 6)]
    put(root, run, "bootstrap-static.json", {"events": events, "elements": elements, "total_players": 1000,
                                              "element_types": [{"id": 1, "singular_name_short": "MID"}], "teams": [{"id": 3, "name": "Reds"}]})
    for i in range(1, 6):
        values = [(rng.randrange(12), rng.choice([0, 60, 90])) for _ in range(12)]
        put(root, run, f"element-summary/{i}.json", {"history": [
            {"round": p, "minutes": values[p - 1][1], "total_points": values[p - 1][0], "value": 50} for p in range(1, upto + 1)], "history_past": []})


def logged(spark, log):
    return {(r.gameweek, r.model, r.code): (r.prediction, r["rank"]) for r in prediction_log.read_predictions(spark, log).collect()}


def test_forecasts_from_a_kept_state_equal_those_without(spark, tmp_path):
    raw, states = tmp_path / "raw", str(tmp_path / "states")
    now = datetime(2098, 1, 1, tzinfo=UTC)
    for upto in (3, 4, 6):
        capture(raw, f"2098-0{upto}-01T00-00-00Z", upto)
        about = forecast.forecast(spark, str(raw), str(tmp_path / "kept"), now=now, state_root=states)
        forecast.forecast(spark, str(raw), str(tmp_path / "plain"), now=now)
        assert about["next_gameweek"] == upto + 1
        assert feature_state.load(spark, states)[0] == about["run"]
    kept, plain_ = logged(spark, str(tmp_path / "kept")), logged(spark, str(tmp_path / "plain"))
    assert len(kept) == 3 * 4 * 5 and kept.keys() == plain_.keys()
    for key in kept:
        assert kept[key] == (pytest.approx(plain_[key][0]), plain_[key][1])
    # An earlier run asked for by name uses no later state and leaves it where it is.
    forecast.forecast(spark, str(raw), str(tmp_path / "again"), capture="2098-03-01T00-00-00Z", now=now, state_root=states)
    assert feature_state.load(spark, states)[0] == "2098-06-01T00-00-00Z"
    again = logged(spark, str(tmp_path / "again"))
    assert again == {k: v for k, v in plain_.items() if k[0] == "gw04"}
    assert feature_state.load(spark, states)[1].agg(F.max("rows")).first()[0] == 6
