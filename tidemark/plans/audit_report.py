"""The panel's season totals against the newest full capture."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import audit
from tidemark.sources import captures


@dataclass(frozen=True)
class Audit:
    report: DataFrame
    disagreements: DataFrame


NO_RECORDS = "no past-season records in this capture"


def compare(
    panel: DataFrame,
    bootstrap: DataFrame,
    summaries: DataFrame,
    *,
    run: str | None = None,
    by: str | None = None,
    merge_spellings: bool = True,
) -> Audit:
    """Agreement with one run: the one named, or the newest with entity documents.

    The report has one row also if nothing matched, or if the run has no past season at
    all; its note says which.
    """
    if run is None:
        newest = captures.newest_full_run(summaries).first()
        run = newest.run if newest else None
    own = F.col("run").eqNullSafe(F.lit(run))
    official = audit.official_totals(bootstrap.where(own), summaries.where(own))
    by = by or ("code" if audit.has_codes(panel) else "name")
    matched = audit.matched_totals(official, panel, by, merge_spellings=merge_spellings)
    report = audit.agreement(matched).withColumn("run", F.lit(run).cast("string"))
    if official.isEmpty():
        report = report.withColumn("note", F.lit(NO_RECORDS))
    key = "code" if by == "code" else "name_n"
    return Audit(report, audit.disagreements(matched, key))
