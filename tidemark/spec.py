"""Which column plays which part in a panel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class PanelSpec:
    """Column roles. The defaults are the football panel's names."""

    season: str = "season"
    entity: str = "code"
    period: str = "round"
    name: str = "name"
    group: str = "position"
    outcome: str = "total_points"
    exposure: str = "minutes"
    price: str = "value"
    ownership: str = "selected"
    momentum: str = "transfers_balance"
    forecast: str = "xP"
    tiebreak: tuple[str, ...] = ("kickoff_time", "fixture")

    @property
    def entity_keys(self) -> list[str]:
        """Windows run inside one entity's season and never cross it."""
        return [self.season, self.entity]

    @property
    def period_keys(self) -> list[str]:
        return [self.season, self.period]

    def time_order(self, df: DataFrame) -> list[str]:
        """Period first, then whichever tie-break columns the table has.

        Two rows of one entity in one period (a double fixture) need a
        tie-break, otherwise their order would differ from run to run.
        """
        return [self.period, *(c for c in self.tiebreak if c in df.columns)]
