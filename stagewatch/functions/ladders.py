"""Score and rate bands."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stagewatch import schema as S


def risk_label(score: Column) -> Column:
    """Low below 0.25, Medium below 0.5, High below 0.75, else Critical."""
    label = None
    for bound, name in S.RISK_BOUNDS:
        test = score >= F.lit(bound)
        label = F.when(test, name) if label is None else label.when(test, name)
    return label.otherwise("Low")


def compliance_band(rate: Column, high: float = 0.85, low: float = 0.65) -> Column:
    """Display band of a compliance rate in [0, 1]; the second screen uses 0.90 and 0.70."""
    return F.when(rate >= F.lit(high), "good").when(rate >= F.lit(low), "ok").otherwise("bad")


def stage_index(stage: Column) -> Column:
    """Zero-based place of a stage on the progress strip, -1 when it is not on it."""
    places = F.array(*[F.lit(s) for s in S.PROGRESS_STAGES])
    return F.array_position(places, stage) - F.lit(1)
