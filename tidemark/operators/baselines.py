"""Four scoring rules any model has to beat, and a registry for more.

A rule is a function from (frame, spec) to a frame with one more column, so that
all rules can be attached to one frame and scored in one job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values
from tidemark.operators import ordered, ranks
from tidemark.spec import PanelSpec

Attach = Callable[..., DataFrame]


@dataclass(frozen=True)
class Rule:
    """``on_scale`` says whether predictions are in units of the outcome.

    ``attach`` takes (frame, spec, out), and ``group_rows``, a bound on the rows of a
    period, if the rule ``ranks`` inside periods.
    """

    name: str
    on_scale: bool
    description: str
    attach: Attach
    ranks: bool = False

    def apply(
        self, df: DataFrame, spec: PanelSpec, out: str, group_rows: int | None = None
    ) -> DataFrame:
        if self.ranks:
            return self.attach(df, spec, out, group_rows=group_rows)
        return self.attach(df, spec, out)


RULES: dict[str, Rule] = {}


def register(rule: Rule) -> Rule:
    RULES[rule.name] = rule
    return rule


def column_rule(
    name: str, description: str, build: Callable[[PanelSpec], Column], *, on_scale: bool = True
) -> Rule:
    """A rule that is a plain expression over the feature frame."""

    def attach(df: DataFrame, spec: PanelSpec, out: str) -> DataFrame:
        return df.withColumn(out, build(spec))

    return register(Rule(name, on_scale, description, attach))


def _rate_times_exposure(spec: PanelSpec) -> Column:
    rate, expected = F.col("points_per90_todate"), F.col(f"{spec.exposure}_mean5")
    # A product with a null factor is null, which then counts as nothing.
    return F.coalesce(rate * expected / F.lit(fixed_values.FULL_EXPOSURE), F.lit(0.0))


column_rule(
    "rate_x_exposure",
    "Outcome rate of the season so far times the exposure of the last five rows.",
    _rate_times_exposure,
)
column_rule(
    "rolling_mean5",
    "Mean outcome of the last five rows.",
    lambda spec: F.coalesce(F.col(f"{spec.outcome}_mean5"), F.lit(0.0)),
)
column_rule(
    "published_forecast",
    "The forecast published before the deadline.",
    lambda spec: F.coalesce(F.col(spec.forecast), F.lit(0.0)),
)


def attach_crowd(
    df: DataFrame, spec: PanelSpec, out: str, *, group_rows: int | None = None
) -> DataFrame:
    """Rank by ownership plus half the rank by net movement, inside each period.

    A ranking signal only: its unit is places, not outcome.
    """
    keys = spec.period_keys
    rows = ordered.resolve_group_rows(df, keys, group_rows)
    filled = df.withColumns(
        {
            "_owned": F.coalesce(F.col(spec.ownership), F.lit(0.0)),
            "_moved": F.coalesce(F.col(spec.momentum), F.lit(0.0)),
        }
    )
    owned = ranks.average_rank(filled, keys, "_owned", "_owned_rank", group_rows=rows)
    moved = ranks.average_rank(owned, keys, "_moved", "_moved_rank", group_rows=rows)
    total = F.col("_owned_rank") + F.col("_moved_rank") * F.lit(0.5)
    return moved.withColumn(out, total).drop("_owned", "_moved", "_owned_rank", "_moved_rank")


register(
    Rule(
        "crowd",
        False,
        "Ownership plus this period's net movement: what the crowd thinks.",
        attach_crowd,
        ranks=True,
    )
)


def predict(
    df: DataFrame,
    name: str,
    spec: PanelSpec | None = None,
    out: str = "prediction",
    *,
    group_rows: int | None = None,
) -> DataFrame:
    """Attach one rule's prediction; a ranking rule takes the bound on a period's rows."""
    if name not in RULES:
        raise KeyError(f"no rule named {name}; known: {', '.join(sorted(RULES))}")
    return RULES[name].apply(df, spec or PanelSpec(), out, group_rows)


def attach_all(
    df: DataFrame,
    spec: PanelSpec | None = None,
    rules: list[str] | None = None,
    *,
    group_rows: int | None = None,
) -> DataFrame:
    """One column per rule, named ``_by_<rule>``, beside the input's columns."""
    spec = spec or PanelSpec()
    wide = df
    for name in rules or RULES:
        wide = RULES[name].apply(wide, spec, f"_by_{name}", group_rows)
    return wide


def in_rows(wide: DataFrame) -> DataFrame:
    """The rules' columns as rows: ``baseline``, ``prediction``, ``on_scale``.

    An explode needs no shuffle and reads the wide table once.
    """
    names = [c.removeprefix("_by_") for c in wide.columns if c.startswith("_by_")]
    scored = F.array(
        *[
            F.struct(
                F.lit(name).alias("baseline"),
                F.col(f"_by_{name}").cast("double").alias("prediction"),
                F.lit(RULES[name].on_scale).alias("on_scale"),
            )
            for name in names
        ]
    )
    kept = [c for c in wide.columns if not c.startswith("_by_")]
    return wide.select(*kept, F.inline(scored))


def predict_all(
    df: DataFrame,
    spec: PanelSpec | None = None,
    rules: list[str] | None = None,
    *,
    group_rows: int | None = None,
) -> DataFrame:
    """One row per input row and rule."""
    return in_rows(attach_all(df, spec, rules, group_rows=group_rows))
