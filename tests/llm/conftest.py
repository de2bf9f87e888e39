from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from edge_data import CLASHING, COLUMNS, edge_rows  # noqa: E402


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame([r + (1, 2, "r", "t", 3, "s", 0.5) for r in edge_rows()], f"{COLUMNS}, {CLASHING}")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], f"{COLUMNS}, {CLASHING}")
