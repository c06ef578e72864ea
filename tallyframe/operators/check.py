"""Evaluating identities over filings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.identities import IDENTITIES, ends, judge
from .facts import PERIOD, slots


def check_slots(rows: DataFrame, truth: bool, gate: bool = True, only: tuple[str, ...] | None = None) -> DataFrame:
    """A result per identity and period. ``gate``: only periods of the target's type.

    Rows are split by period type first, so that each half carries the expressions it needs alone.
    """
    out = None
    wanted = [t for t in IDENTITIES if only is None or t.id in only]
    groups = [([t for t in wanted if t.period_type == p], F.col("period_type") == p) for p in ("instant", "duration")] if gate else [(wanted, F.lit(True))]
    for templates, rule in groups:
        if templates:
            part = rows.filter(rule).selectExpr(*PERIOD, f"inline(array({', '.join(map(ends, templates))}))")
            out = part if out is None else out.unionByName(part)
    return judge(out, truth, PERIOD)


def check(facts: DataFrame, source: str | None = None, truth: bool | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """Results over prepared facts, of one source if given; trusted data is held to the tight tolerance."""
    rows = facts if source is None else facts.filter(F.col("source") == source)
    return check_slots(slots(rows), source == "xbrl" if truth is None else truth, only=only)
