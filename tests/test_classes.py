from __future__ import annotations

import pytest

from tidemark.classes import FOOTBALL, ColumnClasses, UnknownColumnError


def test_one_column_of_each_class():
    got = {c: FOOTBALL.classify(c) for c in ("kickoff_time", "transfers_in", "bps", "xP")}
    assert got == {
        "kickoff_time": "identity", "transfers_in": "pre_deadline", "bps": "outcome",
        "xP": "pre_deadline",
    }


def test_unknown_columns_are_all_named_in_order():
    with pytest.raises(UnknownColumnError, match="aa, zz"):
        FOOTBALL.check(["zz", "round", "aa"])
    with pytest.raises(UnknownColumnError):
        FOOTBALL.classify("zz")
    FOOTBALL.check(["GW", "season", "status", "mng_win"])


def test_every_column_is_either_safe_or_lagged():
    columns = ["starts", "xP", "GW", "bps", "news", "mng_win", "tackles"]
    safe, lagged = FOOTBALL.safe(columns), FOOTBALL.must_lag(columns)
    assert safe == ["GW", "news", "xP"]
    assert lagged == ["bps", "mng_win", "starts", "tackles"]
    assert sorted(safe + lagged) == sorted(columns)


def test_classes_are_disjoint():
    assert (len(FOOTBALL.identity), len(FOOTBALL.pre_deadline), len(FOOTBALL.outcome)) == (16, 11, 52)
    with pytest.raises(ValueError):
        ColumnClasses(frozenset("a"), frozenset("a"), frozenset())
