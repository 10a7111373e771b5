"""Period volumes of a request stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stagewatch.operators.analytics import PERIOD_UNITS
from stagewatch.operators.sla import rate

# Tumbling windows count from the epoch, a Thursday; four days later they start on Mondays.
WINDOWS = {"Daily": ("1 day", "0 days"), "Weekly": ("7 days", "4 days")}


def period_volumes(requests: DataFrame, kind: str, lateness: str = "1 day") -> DataFrame:
    """Requests and compliance per period of creation.

    Days and weeks are closed by the watermark and can be appended. Months and quarters have no
    fixed length: they group by the truncated time and are written in update mode.
    """
    marked = requests.withWatermark("created_at", lateness)
    total, breached = F.count(F.lit(1)), F.count_if("sla_breached")
    if kind in WINDOWS:
        length, offset = WINDOWS[kind]
        period = F.window("created_at", length, startTime=offset)
        start = F.col("period.start")
    else:
        period = F.date_trunc(PERIOD_UNITS[kind], "created_at")
        start = F.col("period")
    counted = marked.groupBy(period.alias("period")).agg(total.alias("requests"), breached.alias("breached"))
    return counted.select(
        F.lit(kind).alias("snapshot_type"), start.alias("period_start"), "requests", "breached",
        rate(F.col("requests"), F.col("breached")).alias("sla_compliance_rate"),
    )
