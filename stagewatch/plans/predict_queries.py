"""Queries over delay-risk features, scores and the prediction log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from stagewatch.functions.ladders import risk_label as label_of
from stagewatch.functions.numbers import half_up
from stagewatch.operators import lifecycle, predict
from stagewatch.operators.sla import sla_evaluate
from stagewatch.plans.catalog import AS_OF_SQL, fixed, hours, query, r6, rn
from stagewatch.sources import bulk

EARLIER = datetime(2024, 1, 30, 6)


def _features(spark, d):
    return predict.prediction_features(bulk.requests(spark, d), bulk.AS_OF, bulk.alerts(spark, d))


def _early(spark, d):
    """The refresh of the day before; it failed for requests without a department."""
    requests = bulk.requests(spark, d)
    rows = predict.refresh_predictions(requests, EARLIER)
    failed = requests.where(F.col("assigned_department").isNull()).select(F.col("id").alias("request_id"))
    return lifecycle.mark_stale(rows, failed)


def _log(spark, d):
    """Prediction log: the earlier refresh of all, and a later one of breached requests."""
    late = predict.refresh_predictions(bulk.requests(spark, d).where("sla_breached"), bulk.AS_OF)
    return _early(spark, d).unionByName(late)


_ACTIVE = "SELECT * FROM reqs WHERE current_stage NOT IN ('Completed', 'Cancelled')"
_FEATURES = f"""(SELECT a.id AS request_id, a.current_stage, a.assigned_department, {hours('a.created_at', AS_OF_SQL)} AS elapsed_hours,
    (SELECT avg({hours('created_at', 'updated_at')}) FROM reqs WHERE current_stage = 'Completed') AS historical_avg_hours,
    CAST(coalesce(b.n, 0) AS BIGINT) AS dept_backlog, CAST(coalesce(w.n, 0) AS BIGINT) AS prior_sla_warnings,
    CAST(dayofweek({AS_OF_SQL}) AS BIGINT) AS day_of_week, CAST(hour({AS_OF_SQL}) AS BIGINT) AS hour_of_day
    FROM ({_ACTIVE}) a LEFT JOIN (SELECT assigned_department AS dep, count(*) AS n FROM ({_ACTIVE}) GROUP BY 1) b ON b.dep = a.assigned_department
    LEFT JOIN (SELECT request_id, count(*) AS n FROM alerts WHERE severity = 'Warning' GROUP BY 1) w ON w.request_id = a.id)"""


def _label(score: str) -> str:
    return f"CASE WHEN {score} >= 0.75 THEN 'Critical' WHEN {score} >= 0.5 THEN 'High' WHEN {score} >= 0.25 THEN 'Medium' ELSE 'Low' END"


_SCORED = f"""(SELECT *, least(greatest(e+b+w, 0.0), 1.0) AS score FROM (SELECT *, elapsed_hours/historical_avg_hours AS ratio,
    elapsed_hours/historical_avg_hours*0.5e0 AS e, least(dept_backlog/50.0e0, 1.0)*0.3e0 AS b, least(prior_sla_warnings/3.0e0, 1.0)*0.2e0 AS w FROM {_FEATURES}))"""


@query(
    "prediction_features",
    f"""SELECT request_id, current_stage, assigned_department, {r6('elapsed_hours')} AS elapsed_hours, {r6('historical_avg_hours')} AS historical_avg_hours,
    dept_backlog, prior_sla_warnings, day_of_week, hour_of_day FROM {_FEATURES}""",
)
def prediction_features(spark, d):
    return _features(spark, d).withColumns({n: half_up(F.col(n), 6) for n in ("elapsed_hours", "historical_avg_hours")})


_DONE = "SELECT * FROM reqs WHERE current_stage = 'Completed'"
_RECOUNTED = f"""(SELECT d.request_id, d.journey_stage, d.entered_at AS t, r.created_at, r.updated_at,
      coalesce((SELECT avg({hours('c.created_at', 'c.updated_at')}) FROM ({_DONE}) c WHERE c.updated_at <= d.entered_at), 72.0e0) AS h,
      (SELECT count(*) FROM reqs b WHERE b.assigned_department = r.assigned_department AND b.created_at <= d.entered_at
        AND NOT (b.current_stage IN ('Completed', 'Cancelled') AND b.updated_at <= d.entered_at)) AS backlog,
      (SELECT count(*) FROM alerts w WHERE w.request_id = d.request_id AND w.severity = 'Warning' AND w.created_at <= d.entered_at) AS warnings,
      (SELECT count(*) FROM evald e WHERE e.request_id = d.request_id AND e.breached AND e.entered_at + to_hours(CAST(e.threshold_hours AS BIGINT)) > d.entered_at) AS later
    FROM dwell d JOIN ({_DONE}) r ON r.id = d.request_id WHERE d.journey_stage NOT IN ('Completed', 'Cancelled') AND r.updated_at <= {AS_OF_SQL})"""


@query(
    "training_features",
    f"""SELECT request_id, journey_stage, t AS judged_at, {r6(hours('created_at', 't'))} AS elapsed_hours, {r6('h')} AS historical_avg_hours,
    CAST(backlog AS BIGINT) AS dept_backlog, CAST(warnings AS BIGINT) AS prior_sla_warnings, CAST(dayofweek(t) AS BIGINT) AS day_of_week,
    CAST(hour(t) AS BIGINT) AS hour_of_day, CASE WHEN later > 0 THEN 1e0 ELSE 0e0 END AS label,
    {r6(f"greatest({hours('created_at', 'updated_at')}-h, 0e0)")} AS excess_hours FROM {_RECOUNTED}""",
)
def training_features(spark, d):
    """Features at each stage entry of the completed requests; the oracle recounts them at each moment."""
    rows = _training(spark, d)
    return rows.withColumns({n: half_up(F.col(n), 6) for n in ("elapsed_hours", "historical_avg_hours", "excess_hours")})


def _training(spark, d):
    evaluated = sla_evaluate(bulk.dwell(spark, d), bulk.rules(spark), keep_terminal=True)
    return predict.training_rows(bulk.requests(spark, d), bulk.alerts(spark, d), evaluated, bulk.AS_OF)


@query(
    "prediction_rows",
    f"""SELECT request_id, {rn('score', 3)} AS risk_score, {_label('score')} AS risk_label, 3 AS n_factors, false AS is_stale,
    {AS_OF_SQL} AS last_computed_at FROM {_SCORED}""",
)
def prediction_rows(spark, d):
    """Rows for the prediction log, with their factors counted."""
    rows = predict.prediction_rows(predict.score(_features(spark, d), bulk.AS_OF), bulk.AS_OF)
    return rows.select(
        "request_id", "risk_score", "risk_label", F.size("contributing_factors").alias("n_factors"), "is_stale", "last_computed_at"
    )


@query(
    "factor_clamp",
    """SELECT id, CAST(greatest(least(k%8, 5), 1) AS BIGINT) AS n_factors, CASE WHEN k%8 = 0 THEN 'elapsed_time' ELSE 'f1' END AS first_factor,
    CASE WHEN k%8 = 0 THEN 0e0 ELSE 1e0/least(k%8, 5) END AS last_influence FROM ev""",
)
def factor_clamp(spark, d):
    """Zero to seven factors per event, of falling influence."""
    n = (F.col("k") % 8).cast("int")
    made = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(7)), lambda i: i <= n),
        lambda i: F.struct(F.concat(F.lit("f"), i.cast("string")).alias("factor"), (F.lit(1.0) / i).alias("influence")),
    )
    clamped = bulk.plain_events(spark, d).select("id", predict.clamp_factors(made).alias("f"))
    return clamped.select(
        "id", F.size("f").alias("n_factors"), F.get("f", F.lit(0))["factor"].alias("first_factor"),
        F.element_at("f", -1)["influence"].alias("last_influence"),
    )


_DELAY = "CASE WHEN ratio > 1 THEN (ratio-1.0)*historical_avg_hours END"


@query(
    "risk_scores",
    f"""SELECT request_id, {rn('score', 3)} AS risk_score, {_label('score')} AS risk_label, {rn(_DELAY, 2)} AS predicted_delay_hours,
    CASE WHEN ratio > 1 THEN {rn('least(greatest(1.0-abs(score-0.5), 0.5), 0.95)', 3)} END AS delay_confidence,
    date_trunc('second', make_timestamp(epoch_us({AS_OF_SQL}) + CAST(floor({_DELAY}*3.6e9+0.5e0) AS BIGINT))) AS predicted_completion_at FROM {_SCORED}""",
)
def risk_scores(spark, d):
    scored = predict.score_heuristic(_features(spark, d), bulk.AS_OF)
    return scored.select(
        "request_id", "risk_score", "risk_label", "predicted_delay_hours", "delay_confidence",
        F.date_trunc("SECOND", "predicted_completion_at").alias("predicted_completion_at"),
    )


@query(
    "risk_factors",
    f"""SELECT request_id, string_agg(f || '=' || {fixed('v', 3)}, ',' ORDER BY v DESC, p) AS factors FROM
    (SELECT request_id, unnest(['elapsed_time_ratio', 'dept_backlog', 'prior_sla_warnings']) AS f,
      unnest([{rn('e', 3)}, {rn('b', 3)}, {rn('w', 3)}]) AS v, unnest([1, 2, 3]) AS p FROM {_SCORED}) GROUP BY 1""",
)
def risk_factors(spark, d):
    from stagewatch.functions.numbers import fixed_text

    scored = predict.score_heuristic(_features(spark, d), bulk.AS_OF)
    parts = F.transform(
        "contributing_factors", lambda f: F.concat(f["factor"], F.lit("="), fixed_text(f["influence"], 3))
    )
    return scored.select("request_id", F.array_join(parts, ",").alias("factors"))


@query(
    "risk_label",
    f"SELECT id, {_label('x')} AS risk_label FROM (SELECT id, least(elapsed_hours/96, 1.0) AS x FROM dwell)",
)
def risk_label(spark, d):
    """Label of every stage entry by its share of the longest threshold."""
    score = F.least(F.col("elapsed_hours") / 96, F.lit(1.0))
    return bulk.dwell(spark, d).select("id", label_of(score).alias("risk_label"))


def _plain_score(source: str, at: str) -> str:
    ratio = f"{hours('created_at', at)}/72.0e0"
    return f"""SELECT id AS request_id, assigned_department, least(greatest({ratio}*0.5e0, 0.0), 1.0) AS score,
    CASE WHEN {ratio} > 1 THEN ({ratio}-1.0)*72.0e0 END AS delay, {at} AS last_computed_at FROM ({source})"""


_EARLY = f"(SELECT *, assigned_department IS NULL AS is_stale FROM ({_plain_score(_ACTIVE, 'TIMESTAMP ' + repr(str(EARLIER)))}))"
_LOG = f"(SELECT * FROM {_EARLY} UNION ALL SELECT *, false FROM ({_plain_score(_ACTIVE + ' AND sla_breached', AS_OF_SQL)}))"


@query("mark_stale", f"SELECT request_id, {rn('score', 3)} AS risk_score, is_stale FROM {_EARLY}")
def mark_stale(spark, d):
    return _early(spark, d).select("request_id", "risk_score", "is_stale")


@query(
    "current_prediction",
    f"""SELECT request_id, {_label('score')} AS risk_label, {rn('delay', 2)} AS predicted_delay_hours, last_computed_at FROM {_LOG}
    WHERE NOT is_stale QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY last_computed_at DESC) = 1""",
)
def current_prediction(spark, d):
    return predict.current_prediction(_log(spark, d)).select(
        "request_id", "risk_label", "predicted_delay_hours", "last_computed_at"
    )


@query(
    "prediction_cache_miss",
    f"SELECT id, current_stage FROM ({_ACTIVE}) WHERE id NOT IN (SELECT request_id FROM {_LOG} WHERE NOT is_stale)",
)
def prediction_cache_miss(spark, d):
    return predict.prediction_cache_miss(bulk.requests(spark, d), _log(spark, d)).select("id", "current_stage")


@query(
    "risk_alerts",
    f"""SELECT request_id, 'Critical Delay Alert' AS alert_type, 'Critical' AS severity,
    'High risk detected: ' || {_label('score')} || ' (score: ' || {fixed(rn('score', 3), 3)} || ')' AS message, last_computed_at AS created_at
    FROM {_LOG} WHERE NOT is_stale AND score >= 0.5 AND last_computed_at = {AS_OF_SQL}
    AND request_id NOT IN (SELECT request_id FROM {_LOG} WHERE is_stale AND score >= 0.5)""",
)
def risk_alerts(spark, d):
    """Alerts of the later refresh; stale high risks already had theirs."""
    log = _log(spark, d)
    held = predict.risk_alerts(log.where("is_stale"))
    late = log.where(~F.col("is_stale") & (F.col("last_computed_at") == bulk.as_of()))
    return predict.risk_alerts(late, held).select("request_id", "alert_type", "severity", "message", "created_at")


@query("model_scores")
def model_scores(spark, d):
    """Boosted trees fitted on the stage entries of completed requests, scoring the active ones."""
    requests, alerts = bulk.requests(spark, d), bulk.alerts(spark, d)
    model = predict.fit_model(_training(spark, d))
    scored = predict.score(predict.prediction_features(requests, bulk.AS_OF, alerts), bulk.AS_OF, model)
    names = F.array_join(F.transform("contributing_factors", lambda f: f["factor"]), ",")
    return scored.select("request_id", "risk_score", "risk_label", "predicted_delay_hours", "delay_confidence", names.alias("factors"))
