"""When each column's value became knowable."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from tidemark import fixed_values


class UnknownColumnError(ValueError):
    """A table carries a column that belongs to no class."""


@dataclass(frozen=True)
class ColumnClasses:
    """A closed registry: three disjoint sets of column names.

    Works on ``df.columns`` only, so no check here ever starts a Spark job.
    """

    identity: frozenset[str]
    pre_deadline: frozenset[str]
    outcome: frozenset[str]

    def __post_init__(self) -> None:
        total = len(self.identity) + len(self.pre_deadline) + len(self.outcome)
        if total != len(self.identity | self.pre_deadline | self.outcome):
            raise ValueError("a column may belong to one class only")

    def _by_class(self) -> dict[str, frozenset[str]]:
        return {
            "identity": self.identity,
            "pre_deadline": self.pre_deadline,
            "outcome": self.outcome,
        }

    def classify(self, column: str) -> str:
        for label, members in self._by_class().items():
            if column in members:
                return label
        raise UnknownColumnError(f"unclassified column: {column}")

    def check(self, columns: Iterable[str]) -> None:
        """Raise with every unclassified name, sorted. Called on each ingest."""
        strangers = sorted(set(columns).difference(*self._by_class().values()))
        if strangers:
            raise UnknownColumnError("unclassified columns: " + ", ".join(strangers))

    def safe(self, columns: Iterable[str]) -> list[str]:
        """Columns that may be used for the period they sit on."""
        return sorted(set(columns) & (self.identity | self.pre_deadline))

    def must_lag(self, columns: Iterable[str]) -> list[str]:
        """Columns that may only be used from earlier periods."""
        return sorted(set(columns) & self.outcome)

    def report(self, columns: Iterable[str]) -> dict[str, list[str]]:
        present = set(columns)
        return {label: sorted(present & names) for label, names in self._by_class().items()}


FOOTBALL = ColumnClasses(
    identity=frozenset(fixed_values.IDENTITY),
    pre_deadline=frozenset(fixed_values.PRE_DEADLINE),
    outcome=frozenset(fixed_values.OUTCOME),
)
