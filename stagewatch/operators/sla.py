"""SLA evaluation, its alerts and compliance figures."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from stagewatch import schema as S
from stagewatch.functions.numbers import fixed_text, plain_text
from stagewatch.functions.times import hours_between, instant, plus_hours
from stagewatch.plans.sequence import Sequence, sequence


def stage_dwell(events: DataFrame, as_of, hot: dict | None = None, **cut) -> DataFrame:
    """Time each request spent in each stage it entered.

    A stage lasts until the next transition of the request, or until ``as_of`` while it is open.
    Events that already carry ``next_at`` are not sequenced again.
    """
    if "next_at" not in events.columns:
        want = Sequence(lead={"next_at": "occurred_at"})
        events = sequence(events.where(F.col("new_state").isNotNull()), "request_id", "occurred_at", "id", want, hot, **cut)
    return events.withColumns(
        {
            "journey_stage": F.col("new_state"),
            "entered_at": F.col("occurred_at"),
            "is_open": F.col("next_at").isNull(),
            "elapsed_hours": hours_between(F.col("occurred_at"), F.coalesce("next_at", instant(as_of))),
        }
    )


def sla_evaluate(dwell: DataFrame, rules: DataFrame, keep_terminal: bool = False) -> DataFrame:
    """Elapsed time against the stage's threshold: percent used and breach.

    A stage without a rule has threshold 0 and no score. Terminal and unknown stages are not
    evaluated; ``keep_terminal`` keeps their rows with null figures. Rules are keyed by the stage
    enumeration, nine rows at most, hence the broadcast.
    """
    active = F.col("journey_stage").isin(S.ACTIVE_STAGES)
    if not keep_terminal:
        dwell = dwell.where(active)
    limits = rules.where(F.col("journey_stage").isin(S.STAGES)).select(
        "journey_stage", F.col("threshold_hours").cast("double").alias("_limit")
    )
    joined = dwell.join(F.broadcast(limits), "journey_stage", "left")
    limit, elapsed = F.col("_limit"), F.col("elapsed_hours")
    used = F.when(limit > 0, elapsed / limit).otherwise(F.lit(0.0))
    return (
        joined.withColumns(
            {
                "has_rule": limit.isNotNull(),
                "threshold_hours": F.when(active, F.coalesce(limit, F.lit(0.0))),
                "percent_used": F.when(active, used),
            }
        )
        .withColumn("breached", F.col("percent_used") >= S.BREACH_SHARE)
        .drop("_limit")
    )


def sla_alert_candidates(evaluated: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Alerts an evaluation calls for: breach, warning, or a note that the stage has no rule."""
    used, has_rule = F.col("percent_used"), F.col("has_rule")
    severity = (
        F.when(~has_rule, "Info").when(used >= S.BREACH_SHARE, "Critical").when(used >= S.WARNING_SHARE, "Warning")
    )
    elapsed, limit = fixed_text(F.col("elapsed_hours"), 2), plain_text(F.col("threshold_hours"))
    stage, rid = F.col("journey_stage"), F.col("request_id")
    breach = F.format_string(
        'SLA breached for request %s at stage "%s". Elapsed: %sh / Threshold: %sh.', rid, stage, elapsed, limit
    )
    warning = F.format_string(
        'SLA warning for request %s at stage "%s". %s%% of threshold used (%sh / %sh).',
        rid, stage, fixed_text(used * 100, 1), elapsed, limit,
    )
    note = F.format_string('No SLA rule defined for journey stage "%s" on request %s.', stage, rid)
    facts = F.struct(
        stage.alias("journeyStage"),
        F.col("elapsed_hours").alias("elapsedHours"),
        F.col("threshold_hours").alias("thresholdHours"),
        used.alias("percentUsed"),
    )
    no_rule_facts = F.struct(stage.alias("journeyStage"), rid.alias("requestId"))
    return (
        evaluated.withColumn("severity", severity)
        .where(F.col("severity").isNotNull())
        .select(
            F.concat_ws("|", rid, stage, F.col("severity")).alias("id"),
            "request_id",
            F.when(has_rule, S.SLA_BREACH).otherwise(S.OPERATIONAL).alias("alert_type"),
            "severity",
            F.lit("Created").alias("lifecycle_state"),
            F.when(~has_rule, note).when(used >= S.BREACH_SHARE, breach).otherwise(warning).alias("message"),
            F.when(has_rule, F.to_json(facts)).otherwise(F.to_json(no_rule_facts)).alias("metadata"),
            "journey_stage",
            *(carry or []),
        )
    )


ALERT_KEY = ["request_id", "journey_stage", "severity"]


def dedup_alerts(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates without a non-archived alert of the same request, stage and severity.

    Within the batch one candidate per key is kept: the one with the smallest id. ``existing`` holds all alerts in
    their present state, archived ones too: an alert that is raised again gets the number of the raise at the end
    of its id, so that it has a life of its own. A replayed batch counts the same alerts and gives the same id.
    """
    rest = [c for c in candidates.columns if c not in ALERT_KEY]
    one = F.min_by(F.struct(*rest), F.struct("id", "message")).alias("_row")
    # Many copies of one alert become one row before they are shuffled.
    raised = existing.select(
        "request_id", F.get_json_object("metadata", "$.journeyStage").alias("journey_stage"), "severity",
        (F.col("lifecycle_state") != "Archived").alias("_is_open"),
    ).groupBy(*ALERT_KEY).agg(F.bool_or("_is_open").alias("_open"), F.count(F.lit(1)).alias("_raised"))
    again = F.concat_ws("|", "id", (F.col("_raised") + 1).cast("string"))
    return (
        candidates.groupBy(*ALERT_KEY).agg(one).select(*ALERT_KEY, "_row.*")
        .join(raised, ALERT_KEY, "left")
        .where(~F.coalesce("_open", F.lit(False)))
        .withColumn("id", F.when(F.col("_raised").isNull(), F.col("id")).otherwise(again))
        .select(*candidates.columns)
    )


def apply_breach(requests: DataFrame, evaluated: DataFrame, at=None) -> DataFrame:
    """Set the breach flag of requests with a breached stage; once set it stays.

    With ``at``, the time of the evaluation, it becomes the ``updated_at`` of every request with a breach.
    """
    hits = evaluated.groupBy("request_id").agg(F.bool_or("breached").alias("_hit"))
    flagged = requests.join(hits, requests["id"] == hits["request_id"], "left").drop(hits["request_id"])
    if at is not None:
        flagged = flagged.withColumn("updated_at", F.when(F.col("_hit"), instant(at)).otherwise(F.col("updated_at")))
    return flagged.withColumn(
        "sla_breached", F.coalesce("sla_breached", F.lit(False)) | F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def request_states(events: DataFrame, rules: DataFrame, as_of, hot: dict | None = None, **cut) -> DataFrame:
    """Present state of every request from its events: stage, origin, last change, and whether a stay became a breach.

    ``updated_at`` is the time of the last event, or of the last breach if that came later. Events without a state
    count for the times only.
    """
    evaluated = sla_evaluate(stage_dwell(events, as_of, hot, **cut), rules, keep_terminal=True)
    due = F.when(F.col("breached"), plus_hours(F.col("entered_at"), F.col("threshold_hours")))
    order = F.struct("entered_at", "id")
    stays = evaluated.groupBy("request_id").agg(
        F.max_by("journey_stage", order).alias("current_stage"), F.max("entered_at").alias("entered_at"),
        F.min(due).alias("breached_at"), F.max(due).alias("_last_breach"),
    )
    times = events.groupBy("request_id").agg(
        F.min_by("department", F.struct("occurred_at", "id")).alias("assigned_department"),
        F.min("occurred_at").alias("created_at"), F.max("occurred_at").alias("_last"),
    )
    return times.join(stays, "request_id", "left").select(
        "request_id", "current_stage", "entered_at", "assigned_department", "created_at",
        F.greatest("_last", "_last_breach").alias("updated_at"), F.col("breached_at").isNotNull().alias("sla_breached"), "breached_at",
    )


def seed_rules(existing: DataFrame) -> DataFrame:
    """Existing rules plus the default rule of every stage that has none."""
    spark = existing.sparkSession
    seed = spark.createDataFrame(S.SLA_SEED, "journey_stage string, threshold_hours string, description string")
    seed = seed.withColumn("threshold_hours", F.col("threshold_hours").cast("decimal(8,2)"))
    missing = seed.join(existing.select("journey_stage"), "journey_stage", "left_anti")
    return existing.unionByName(missing, allowMissingColumns=True)


def upsert_rules(rules: DataFrame, changes: DataFrame, at=None) -> DataFrame:
    """Rules after changed thresholds; changes out of range or for stages without rules are ignored.

    Of several changes to a stage the latest by ``changed_at`` counts, or the greatest threshold where there is
    no such column or a tie. Both sides are keyed by the stage enumeration. A new threshold counts from the next
    evaluation. ``updated_at`` of a changed rule is its ``changed_at``, or ``at`` where changes carry no time; other rules
    keep theirs.
    """
    limit = F.col("threshold_hours")
    if "changed_at" in changes.columns and isinstance(changes.schema["changed_at"].dataType, T.TimestampType):
        when = F.col("changed_at")
    else:
        when = F.lit(None).cast("timestamp") if at is None else instant(at)
    held = F.col("updated_at") if "updated_at" in rules.columns else F.lit(None).cast("timestamp")
    good = changes.where(F.col("journey_stage").isin(S.ACTIVE_STAGES) & (limit > 0) & (limit <= S.MAX_THRESHOLD_HOURS))
    order = [F.col(c) for c in ("changed_at", "threshold_hours", "description") if c in good.columns]
    latest = F.max(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in good.columns])).alias("last")
    good = good.groupBy("journey_stage").agg(latest).select(*[F.col(f"last._{c}").alias(c) for c in good.columns])
    new = good.select(
        "journey_stage",
        limit.alias("_new"),
        (F.col("description") if "description" in good.columns else F.lit(None).cast("string")).alias("_text"),
        when.alias("_when"),
    )
    return rules.join(new, "journey_stage", "full_outer").select(
        "journey_stage",
        F.coalesce(F.col("_new"), F.col("threshold_hours")).cast("decimal(8,2)").alias("threshold_hours"),
        F.coalesce("_text", "description").alias("description"),
        F.col("_new").isNotNull().alias("changed"),
        F.when(F.col("_new").isNotNull(), F.col("_when")).otherwise(held).alias("updated_at"),
    )


def active_requests(requests: DataFrame) -> DataFrame:
    """Requests that are neither completed nor cancelled."""
    return requests.where(~F.col("current_stage").isin(S.TERMINAL_STAGES))


def active_by_stage(requests: DataFrame) -> DataFrame:
    """Number of active requests on each stage."""
    return active_requests(requests).groupBy("current_stage").agg(F.count(F.lit(1)).alias("active_count"))


def list_rules(rules: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Rules by stage name, with the number of active requests each one applies to."""
    if requests is None:
        return rules.orderBy("journey_stage")
    counts = active_by_stage(requests)
    return (
        rules.join(counts, rules["journey_stage"] == counts["current_stage"], "left")
        .select(*rules.columns, F.coalesce("active_count", F.lit(0)).alias("active_count"))
        .orderBy("journey_stage")
    )


# --- compliance -----------------------------------------------------------------------------


def check_range(start: datetime, end: datetime, most_days: int) -> None:
    """A compliance period must run forward and span 1 to ``most_days`` days."""
    if start >= end:
        raise ValueError("from must be before to")
    days = (end - start).total_seconds() / 86_400
    if days < 1:
        raise ValueError("period must be at least 1 calendar day")
    if days > most_days:
        raise ValueError(f"period must not exceed {most_days} calendar days")


def rate(total: Column, breached: Column) -> Column:
    """Share without breach; 1 when there is nothing to judge."""
    return F.when(total > 0, (total - breached) / total).otherwise(F.lit(1.0))


def compliance(requests: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Compliance per department and per stage of the requests created in the period.

    One pass with grouping sets; ``kind`` tells which of the two a row belongs to. Requests without
    a department count as Unassigned.
    """
    check_range(start, end, 365)
    rows = requests.where(F.col("created_at").between(instant(start), instant(end))).select(
        F.coalesce("assigned_department", F.lit("Unassigned")).alias("department"),
        F.col("current_stage").alias("stage"),
        F.col("sla_breached").cast("int").alias("hit"),
    )
    grouped = rows.groupingSets([["department"], ["stage"]], "department", "stage").agg(
        F.grouping("department").alias("_by_stage"),
        F.count(F.lit(1)).alias("total"),
        F.sum("hit").alias("breached"),
    )
    by_stage = F.col("_by_stage") == 1
    return grouped.select(
        F.when(by_stage, "stage").otherwise("department").alias("kind"),
        F.when(by_stage, F.col("stage")).otherwise(F.col("department")).alias("label"),
        "total",
        "breached",
        rate(F.col("total"), F.col("breached")).alias("compliance_rate"),
    )


def compliance_overall(requests: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Overall rate: the plain mean over departments, and the one weighted by requests.

    ``departments`` is the record count of the plain form, ``records`` that of the weighted one.
    Without requests both rates are 1.
    """
    departments = compliance(requests, start, end).where(F.col("kind") == "department")
    return departments.agg(
        F.coalesce(F.avg("compliance_rate"), F.lit(1.0)).alias("overall_rate"),
        F.count(F.lit(1)).alias("departments"),
        F.coalesce(rate(F.sum("total"), F.sum("breached")), F.lit(1.0)).alias("weighted_rate"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("records"),
    )


# --- bottlenecks ----------------------------------------------------------------------------


def rank_top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in the given order, numbered from 1.

    For aggregated rows only; the limit comes first, so the numbering sees ``n`` rows.
    """
    from pyspark.sql import Window

    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def bottlenecks_heuristic(events: DataFrame, rules: DataFrame, n: int) -> DataFrame:
    """Stages by a fifth of their threshold, with the events that entered them.

    The department is that of the first such event. Events without a department do not count.
    """
    entered = events.where(F.col("department").isNotNull() & F.col("new_state").isin(S.STAGES))
    stats = entered.groupBy(F.col("new_state").alias("journey_stage")).agg(
        F.count(F.lit(1)).alias("occurrence_count"),
        F.min(F.struct("occurred_at", "id", "department"))["department"].alias("department"),
    )
    excess = F.col("threshold_hours").cast("double") * F.lit(0.2)
    scored = stats.join(rules.select("journey_stage", "threshold_hours"), "journey_stage").select(
        "journey_stage", "department", excess.alias("avg_excess_hours"), "occurrence_count"
    )
    order = [F.desc("avg_excess_hours"), F.asc("journey_stage")]
    return rank_top(scored.where(F.col("avg_excess_hours") > 0), order, n)


def bottlenecks_measured(evaluated: DataFrame, n: int) -> DataFrame:
    """Stage and department pairs by mean hours over the threshold, from breached stage entries."""
    over = F.greatest(F.col("elapsed_hours") - F.col("threshold_hours"), F.lit(0.0))
    scored = (
        evaluated.where(F.col("breached") & F.col("department").isNotNull())
        .groupBy("journey_stage", "department")
        .agg(F.avg(over).alias("avg_excess_hours"), F.count(F.lit(1)).alias("occurrence_count"))
    )
    order = [F.desc("avg_excess_hours"), F.asc("journey_stage"), F.asc("department")]
    return rank_top(scored, order, n)
