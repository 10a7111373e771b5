"""KPIs, trends, department figures and period snapshots."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from stagewatch import schema as S
from stagewatch.functions.numbers import half_up
from stagewatch.functions.times import hours_between, instant, minus_days
from stagewatch.operators.sla import rate

WINDOW_DAYS = 30


def kpis(requests: DataFrame, as_of) -> DataFrame:
    """Request KPIs as one row, from one pass over the requests."""
    now = instant(as_of)
    completed = F.col("current_stage") == "Completed"
    recent = F.col("created_at") >= minus_days(now, WINDOW_DAYS)
    hours = hours_between(F.col("created_at"), F.col("updated_at"))
    total, done = F.count(F.lit(1)), F.count_if(completed)
    days = F.lit(float(WINDOW_DAYS))
    return requests.agg(
        F.coalesce(F.avg(F.when(completed, hours)), F.lit(0.0)).alias("avg_completion_time"),
        rate(total, F.count_if("sla_breached")).alias("sla_compliance_rate"),
        (F.count_if(recent) / days).alias("request_throughput"),
        (F.count_if(recent & F.col("sla_breached")) / days).alias("delay_frequency"),
        F.when(total > 0, done / total).otherwise(F.lit(0.0)).alias("completion_rate"),
    )


def dept_processing_time(events: DataFrame) -> DataFrame:
    """Mean hours between consecutive events of a department; 0 with fewer than two events.

    The gaps add up to last minus first, so no ordering is needed.
    """
    stats = events.where(F.col("department").isNotNull()).groupBy("department").agg(
        F.min("occurred_at").alias("first"), F.max("occurred_at").alias("last"), F.count(F.lit(1)).alias("n")
    )
    hours = F.when(F.col("n") >= 2, hours_between(F.col("first"), F.col("last")) / (F.col("n") - 1))
    return stats.select("department", F.coalesce(hours, F.lit(0.0)).alias("avg_hours"), F.col("n").alias("event_count"))


def dashboard_overview(requests: DataFrame, events: DataFrame, as_of) -> DataFrame:
    """KPI row with the department times as a map, the time of computation and the stale flag.

    The department rows enter as a scalar subquery: one aggregated map, one entry per department.
    """
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("department", "avg_hours"))))
    per_department = dept_processing_time(events).agg(entries.alias("m"))
    return kpis(requests, as_of).withColumns(
        {
            "avg_department_processing_time": per_department.scalar(),
            "is_stale": F.lit(False),
            "computed_at": instant(as_of),
        }
    )


def compliance_today(requests: DataFrame) -> DataFrame:
    """Totals and the compliance rate as percent, 100.0 when there are no requests."""
    total, breached = F.count(F.lit(1)), F.count_if("sla_breached")
    return requests.agg(
        total.alias("total"),
        breached.alias("breached"),
        half_up(rate(total, breached) * 100, 1).alias("compliance_percent"),
    )


def breaches_by_department(requests: DataFrame) -> DataFrame:
    """Breached requests per department, most first."""
    return (
        requests.where(F.col("sla_breached") & F.col("assigned_department").isNotNull())
        .groupBy(F.col("assigned_department").alias("department"))
        .agg(F.count(F.lit(1)).alias("breached_count"))
        .orderBy(F.desc("breached_count"), "department")
    )


def check_trend_range(start: datetime, end: datetime) -> None:
    days = math.ceil((end - start).total_seconds() / 86_400)
    if not 1 <= days <= 366:
        raise ValueError(f"trend range must be between 1 and 366 days, received {days} days")


def trends(requests: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Requests and compliance per day of creation; days without requests are absent."""
    check_trend_range(start, end)
    return (
        requests.where(F.col("created_at").between(instant(start), instant(end)))
        .groupBy(F.date_trunc("DAY", "created_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("volume"), F.count_if("sla_breached").alias("breached"))
        .withColumn("compliance_rate", rate(F.col("volume"), F.col("breached")))
    )


def volume_trend(requests: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return trends(requests, start, end).select("day", "volume").orderBy("day")


def sla_trend(requests: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return trends(requests, start, end).select("day", "breached", "compliance_rate").orderBy("day")


def trend_chart(requests: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Chart points: volume and compliance percent with one decimal, by day."""
    percent = half_up(F.col("compliance_rate") * 100, 1)
    return trends(requests, start, end).select("day", "volume", percent.alias("sla_percent")).orderBy("day")


def department_efficiency(events: DataFrame, requests: DataFrame, rules: DataFrame, as_of, period=None) -> DataFrame:
    """Per department: mean hours, number of stage thresholds they exceed, global compliance.

    Thresholds (one per stage) and the global rate are scalar subqueries, so nothing is crossed.
    ``period`` restricts events and requests to (start, end); none means all.
    """
    if period:
        start, end = (instant(p) for p in period)
        events = events.where(F.col("occurred_at").between(start, end))
        requests = requests.where(F.col("created_at").between(start, end))
    limits = rules.agg(F.collect_list(F.col("threshold_hours").cast("double")).alias("t")).scalar()
    overall = kpis(requests, as_of).select("sla_compliance_rate").scalar()
    return (
        dept_processing_time(events)
        .withColumn("_limits", limits)
        .select(
            "department",
            F.col("avg_hours").alias("avg_processing_time_hours"),
            F.size(F.filter("_limits", lambda t: F.col("avg_hours") > t)).cast("bigint").alias("bottleneck_frequency"),
            overall.alias("sla_compliance_rate"),
        )
    )


KPI_KEYS = ["avg_completion_time", "sla_compliance_rate", "request_throughput", "delay_frequency", "completion_rate"]


def snapshot_rows(requests: DataFrame, events: DataFrame, kind: str, start: datetime, end: datetime, as_of) -> DataFrame:
    """Snapshot of a period: one row per global KPI and one per department, four decimals.

    Computed on the requests created and the events occurred in [start, end].
    """
    first, last = instant(start), instant(end)
    reqs = requests.where(F.col("created_at").between(first, last))
    evs = events.where(F.col("occurred_at").between(first, last))
    whole = kpis(reqs, as_of).unpivot([], KPI_KEYS, "kpi_key", "kpi_value").withColumn("department", F.lit(None).cast("string"))
    parts = dept_processing_time(evs).select(
        F.lit("avg_dept_processing_time").alias("kpi_key"), F.col("avg_hours").alias("kpi_value"), "department"
    )
    return whole.unionByName(parts).select(
        F.lit(kind).alias("snapshot_type"),
        first.alias("period_start"),
        last.alias("period_end"),
        "department",
        F.lit(None).cast("string").alias("journey_stage"),
        "kpi_key",
        half_up(F.col("kpi_value"), 4).cast("decimal(12,4)").alias("kpi_value"),
    )


PERIOD_UNITS = {"Daily": "DAY", "Weekly": "WEEK", "Monthly": "MONTH", "Quarterly": "QUARTER"}


def period_bounds(kind: str, moment: datetime) -> tuple[datetime, datetime]:
    """First and last millisecond of the UTC period around a moment; weeks start on Monday."""
    day = moment.replace(hour=0, minute=0, second=0, microsecond=0)
    if kind == "Daily":
        start, after = day, day + timedelta(days=1)
    elif kind == "Weekly":
        start = day - timedelta(days=day.weekday())
        after = start + timedelta(days=7)
    elif kind == "Monthly":
        start = day.replace(day=1)
        after = (start + timedelta(days=32)).replace(day=1)
    else:
        start = day.replace(month=3 * ((day.month - 1) // 3) + 1, day=1)
        after = (start + timedelta(days=95)).replace(day=1)
    return start, after - timedelta(milliseconds=1)


def snapshot_periods(requests: DataFrame, kind: str) -> DataFrame:
    """Request KPIs of every period of one kind, by the period of creation."""
    unit = PERIOD_UNITS[kind]
    completed = F.col("current_stage") == "Completed"
    total, breached = F.count(F.lit(1)), F.count_if("sla_breached")
    hours = hours_between(F.col("created_at"), F.col("updated_at"))
    return requests.groupBy(F.date_trunc(unit, "created_at").alias("period_start")).agg(
        F.lit(kind).alias("snapshot_type"),
        total.alias("requests"),
        breached.alias("breached"),
        rate(total, breached).alias("sla_compliance_rate"),
        F.coalesce(F.avg(F.when(completed, hours)), F.lit(0.0)).alias("avg_completion_time"),
        (F.count_if(completed) / total).alias("completion_rate"),
    )


def snapshot_all_periods(requests: DataFrame) -> DataFrame:
    """``snapshot_periods`` of all kinds in one pass: requests are summed up by day, and the days by period."""
    completed = F.col("current_stage") == "Completed"
    hours = hours_between(F.col("created_at"), F.col("updated_at"))
    days = requests.groupBy(F.date_trunc("DAY", "created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("sla_breached").alias("late"),
        F.count_if(completed).alias("done"),
        F.count(F.when(completed, hours)).alias("timed"),
        F.sum(F.when(completed, hours)).alias("hours"),
    )
    kinds = [
        F.struct(F.lit(kind).alias("snapshot_type"), F.date_trunc(unit, "day").alias("period_start"))
        for kind, unit in PERIOD_UNITS.items()
    ]
    periods = days.select("*", F.inline(F.array(*kinds))).groupBy("period_start", "snapshot_type")
    total, breached = F.sum("n"), F.sum("late")
    return periods.agg(
        total.alias("requests"),
        breached.alias("breached"),
        rate(total, breached).alias("sla_compliance_rate"),
        F.coalesce(F.try_divide(F.sum("hours"), F.sum("timed")), F.lit(0.0)).alias("avg_completion_time"),
        (F.sum("done") / total).alias("completion_rate"),
    )


def snapshot_series(requests: DataFrame, kind: str) -> DataFrame:
    """The period KPIs in snapshot form (long, four decimals)."""
    wide = snapshot_periods(requests, kind)
    keys = ["sla_compliance_rate", "avg_completion_time", "completion_rate"]
    long = wide.unpivot(["snapshot_type", "period_start"], keys, "kpi_key", "kpi_value")
    return long.withColumn("kpi_value", half_up(F.col("kpi_value"), 4).cast("decimal(12,4)"))


def list_reports(snapshots: DataFrame, kind: str | None = None, start=None, end=None) -> DataFrame:
    """Snapshot rows, optionally of one type and a range of period starts."""
    if kind:
        snapshots = snapshots.where(F.col("snapshot_type") == kind)
    if start is not None:
        snapshots = snapshots.where(F.col("period_start") >= instant(start))
    if end is not None:
        snapshots = snapshots.where(F.col("period_start") <= instant(end))
    return snapshots
