"""Point-in-time panel analytics as Spark DataFrame operators."""

from tidemark.classes import ColumnClasses, UnknownColumnError
from tidemark.spec import PanelSpec

__all__ = ["ColumnClasses", "PanelSpec", "UnknownColumnError"]
