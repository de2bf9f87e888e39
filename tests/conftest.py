from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tools.local_session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4")
    yield session
    session.stop()


@pytest.fixture
def small_groups(monkeypatch):
    """Make the split plans cut groups of a few rows, as they would cut billions."""
    from tidemark.operators import ordered

    monkeypatch.setattr(ordered, "WINDOW_GROUP_ROWS", 1)
    monkeypatch.setattr(ordered, "BUCKETS_PER_GROUP", 16)
    monkeypatch.setattr(ordered, "HOT_VALUE_ROWS", 20)
