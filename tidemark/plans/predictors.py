"""Predictors that learn from a history, evaluated at every cutoff in one run.

A predictor here never holds a history. It folds rows into a state, states merge, and a
prediction is made from the state of all periods before the target's. States are formed in
the tasks that read the rows, merged in a tree, laid out in dyadic blocks of periods, and
each cutoff merges the few blocks before it: rows are not copied per cutoff, and no task
holds a season or all rows of an entity.

``MergeablePredictor`` is for Python, ``AggregatePredictor`` for built-in functions, and
``HistoryFunction`` turns a plain function of (history, target) into the first, for seasons
that are known to fit a task.

A row without a period is neither history nor target; a null season is a season. The first
period of a season is predicted from the state of no rows. Targets never show a predictor
the outcome or the exposure of their own period.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import blocks
from tidemark.operators.blocks import AT, SEASON
from tidemark.operators.ordered import largest_group, matched
from tidemark.session import counted, written
from tidemark.spec import PanelSpec

# States merged by one call, and states a task holds before it hands them on.
FAN_IN = 64
HELD_STATES = 4096

# Rows predicted by one call.
TARGET_ROWS = 200_000


class MergeablePredictor:
    """What a predictor in Python has to provide.

    ``history`` and ``target`` name the columns it reads of either. A state is anything
    that can be pickled; its size is the predictor's to bound. ``add`` gets rows of one
    season and period and may change and return the state given; ``merge`` likewise, and
    must not depend on how rows were divided.
    """

    history: Sequence[str] = ()
    target: Sequence[str] = ()

    def zero(self) -> Any:
        raise NotImplementedError

    def add(self, state: Any, rows: pd.DataFrame) -> Any:
        raise NotImplementedError

    def merge(self, left: Any, right: Any) -> Any:
        raise NotImplementedError

    def predict(self, state: Any, target: pd.DataFrame) -> Sequence[float]:
        raise NotImplementedError


@dataclass(frozen=True)
class HistoryFunction(MergeablePredictor):
    """A function of (history, target) frames, one prediction for each target row.

    The state is the history itself, in the columns asked for, so it stops with an error
    beyond ``max_rows`` rows instead of filling a task.
    """

    function: Callable[[pd.DataFrame, pd.DataFrame], Sequence[float]]
    history: Sequence[str]
    target: Sequence[str]
    max_rows: int = 1_000_000

    def zero(self) -> pd.DataFrame:
        return pd.DataFrame(columns=list(self.history))

    def add(self, state: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return self.merge(state, rows)

    def merge(self, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) + len(right) > self.max_rows:
            raise ValueError(f"a history of more than {self.max_rows} rows; give a predictor that merges states")
        return right if left.empty else left if right.empty else pd.concat([left, right], ignore_index=True)

    def predict(self, state: pd.DataFrame, target: pd.DataFrame) -> Sequence[float]:
        return self.function(state, target)


@dataclass(frozen=True)
class AggregatePredictor:
    """A predictor made of aggregates.

    ``partial`` are aggregates over rows, ``merge`` aggregates of the same names over
    partial ones, ``prediction`` an expression over those, null where there is no history.
    ``keys`` are columns within which it learns, besides the season.
    """

    keys: Sequence[str]
    partial: Mapping[str, Column]
    merge: Mapping[str, Column]
    prediction: Column

    def __post_init__(self):
        if set(self.partial) != set(self.merge):
            raise ValueError("partial and merge must name the same aggregates")


def _check(columns: Sequence[str], frame: DataFrame, spec: PanelSpec, hidden: Sequence[str] = ()) -> list[str]:
    absent = [c for c in columns if c not in frame.columns]
    if absent:
        raise ValueError(f"no columns {', '.join(absent)} in the frame")
    seen = [c for c in columns if c in hidden]
    if seen:
        raise ValueError(f"{', '.join(seen)} of a target is not known before its period")
    return list(columns)


def _cutoffs(frame: DataFrame, periods: DataFrame, spec: PanelSpec, first_period: int) -> DataFrame:
    return periods.where(F.col(spec.period) >= first_period).select(SEASON, AT)


# --- built-in functions ---------------------------------------------------------------------


def block_states(frame: DataFrame, predictor: AggregatePredictor, spec: PanelSpec, periods: DataFrame) -> DataFrame:
    """Aggregates per key and block. Rows are aggregated per period first, so only those
    are copied, once for each level."""
    keys = list(predictor.keys)
    rows = blocks.with_numbers(frame, periods, spec)
    per_period = rows.groupBy(SEASON, AT, *keys).agg(*[c.alias(n) for n, c in predictor.partial.items()])
    return blocks.in_blocks(per_period, blocks.levels_of(periods)).groupBy(SEASON, "_level", "_block", *keys).agg(
        *[c.alias(n) for n, c in predictor.merge.items()])


def predict_aggregates(frame: DataFrame, predictor: AggregatePredictor, spec: PanelSpec, first_period: int) -> DataFrame:
    """Target rows with ``prediction``."""
    keys = _check(predictor.keys, frame, spec)
    periods = blocks.numbered_periods(frame, spec)
    states = block_states(frame, predictor, spec, periods)
    wanted = blocks.blocks_before(_cutoffs(frame, periods, spec, first_period), blocks.levels_of(periods))
    at_cutoff = states.join(counted(wanted, "cutoff-blocks"), [SEASON, "_level", "_block"]).groupBy(SEASON, AT, *keys).agg(
        *[c.alias(n) for n, c in predictor.merge.items()])
    at_cutoff = at_cutoff.select(SEASON, AT, *keys, predictor.prediction.cast("double").alias("prediction"))
    asked = frame.drop("prediction").where(F.col(spec.period) >= first_period)
    target = blocks.with_numbers(asked, periods, spec)
    return matched(target, counted(at_cutoff, "cutoff-states"), [SEASON, AT, *keys], "left").drop(SEASON, AT)


# --- Python ---------------------------------------------------------------------------------


def _folded(predictor: MergeablePredictor, columns: list[str]):
    """Rows of a task to one state for each season and period it meets."""

    def handed(held: dict) -> pa.RecordBatch:
        part, keys = TaskContext.get().partitionId(), sorted(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
             pa.array([part] * len(keys), pa.int64()), pa.array([pickle.dumps(held[k]) for k in keys], pa.binary())],
            names=[SEASON, AT, "_part", "state"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], Any] = {}
        for batch in batches:
            rows = batch.to_pandas()
            for key, own in rows.groupby([SEASON, AT], sort=False):
                state = held[key] if key in held else predictor.zero()
                held[key] = predictor.add(state, own[columns].reset_index(drop=True))
            if len(held) >= HELD_STATES:
                yield handed(held)
                held = {}
        if held:
            yield handed(held)

    return fold


def _merged(states: DataFrame, keys: list[str], predictor: MergeablePredictor, order: str) -> DataFrame:
    """One state for each value of ``keys``, merged in the order of a column."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        state = None
        for blob in table.column("state"):
            next_ = pickle.loads(blob.as_py())
            state = next_ if state is None else predictor.merge(state, next_)
        first = {k: table.column(k).slice(0, 1) for k in keys}
        return pa.table({**first, "state": pa.array([pickle.dumps(state)], pa.binary())})

    return states.groupBy(*keys).applyInArrow(merge, ", ".join([*(f"{k} long" for k in keys), "state binary"]))


def period_states(frame: DataFrame, predictor: MergeablePredictor, spec: PanelSpec, periods: DataFrame) -> DataFrame:
    """One state per season and period, from those of the tasks, ``FAN_IN`` at a time."""
    columns = _check(predictor.history, frame, spec)
    rows = blocks.with_numbers(frame.select(*dict.fromkeys([*spec.period_keys, *columns])), periods, spec)
    folded = rows.select(SEASON, AT, *columns).mapInArrow(
        _folded(predictor, columns), f"{SEASON} long, {AT} long, _part long, state binary")
    states = written(folded, "states-of-tasks")
    most = states.agg(F.max("_part")).first()[0] or 0
    while most >= FAN_IN:
        grouped = states.withColumns({"_next": F.expr(f"_part div {FAN_IN}")})
        merged = _merged(grouped, [SEASON, AT, "_next"], predictor, "_part")
        states = written(merged.withColumnRenamed("_next", "_part"), "states-of-tasks")
        most //= FAN_IN
    return written(_merged(states, [SEASON, AT], predictor, "_part"), "states-of-periods")


def cutoff_states(states: DataFrame, cutoffs: DataFrame, levels: int, predictor: MergeablePredictor) -> DataFrame:
    """For each cutoff the state of all periods before it; none where there are none."""
    whole = blocks.in_blocks(states, levels).withColumn("_level", F.col("_level").cast("long"))
    in_block = written(_merged(whole, [SEASON, "_level", "_block"], predictor, AT), "states-of-blocks")
    wanted = blocks.blocks_before(cutoffs, levels).withColumn("_level", F.col("_level").cast("long"))
    return _merged(in_block.join(wanted, [SEASON, "_level", "_block"]), [SEASON, AT], predictor, "_block")


def _predicted(predictor: MergeablePredictor, columns: list[str], shape: list[str]):
    def predict(target: pa.Table, states: pa.Table) -> pa.Table:
        if not target.num_rows:
            return target.select(shape).append_column("prediction", pa.array([], pa.float64()))
        state = pickle.loads(states.column("state")[0].as_py()) if states.num_rows else predictor.zero()
        said = list(predictor.predict(state, target.select(columns).to_pandas()))
        if len(said) != target.num_rows:
            raise ValueError(f"{len(said)} predictions for {target.num_rows} rows")
        values = pa.array([None if v is None or v != v else float(v) for v in said], pa.float64())
        return target.select(shape).append_column("prediction", values)

    return predict


def predict_mergeable(frame: DataFrame, predictor: MergeablePredictor, spec: PanelSpec, first_period: int,
                      keep: Sequence[str]) -> DataFrame:
    """Target rows in the columns of ``keep`` with ``prediction``.

    Targets of a period are dealt to as many groups as its rows ask for, each of which
    meets the state of its cutoff.
    """
    columns = _check(predictor.target, frame, spec, [spec.outcome, spec.exposure])
    periods = blocks.numbered_periods(frame, spec)
    states = period_states(frame, predictor, spec, periods)
    cutoffs = _cutoffs(frame, periods, spec, first_period)
    at_cutoff = cutoff_states(states, cutoffs, blocks.levels_of(periods), predictor)

    needed = list(dict.fromkeys([*keep, *columns]))
    given = frame.where(F.col(spec.period) >= first_period).select(*dict.fromkeys([*spec.period_keys, *needed]))
    target = written(blocks.with_numbers(given, periods, spec).select(SEASON, AT, *needed), "targets")
    slots = max(1, -(-largest_group(target, [SEASON, AT]) // TARGET_ROWS))
    # Equal rows share a slot; a place in the written table keeps them apart.
    spread = F.pmod(F.xxhash64("_metadata.file_path", "_metadata.row_index"), F.lit(slots)).cast("long")
    dealt = target.select("*", spread.alias("_slot"))
    at_slot = at_cutoff.withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    keys = [SEASON, AT, "_slot"]
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
    shape = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "prediction double"])
    return dealt.groupBy(*keys).cogroup(at_slot.groupBy(*keys)).applyInArrow(
        _predicted(predictor, columns, list(keep)), shape)
