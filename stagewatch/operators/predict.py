"""Delay-risk features, scores and the prediction log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stagewatch import schema as S
from stagewatch.functions.ladders import risk_label
from stagewatch.functions.numbers import fixed_text, half_up
from stagewatch.functions.times import hours_between, instant, plus_hours
from stagewatch.operators.sla import active_requests
from stagewatch.plans.sequence import Sequence, sequence

FEATURES = [
    "elapsed_hours",
    "historical_avg_hours",
    "dept_backlog",
    "prior_sla_warnings",
    "day_of_week",
    "hour_of_day",
]
MAX_DELAY_HOURS = 8760.0
MODEL_CONFIDENCE = 0.75


MAX_DEPARTMENTS = 10_000


def _backlog(requests: DataFrame) -> DataFrame:
    """Active requests per department, as a broadcast table of rows in hand while there are MAX_DEPARTMENTS at most.

    Departments are few keys with very many requests each; so requests needn't be shuffled by them. Beyond
    that number the counts stay a distributed table and the join is an ordinary one.
    """
    counted = active_requests(requests).groupBy("assigned_department").agg(F.count(F.lit(1)).alias("_backlog"))
    rows = counted.limit(MAX_DEPARTMENTS + 1).collect()
    if len(rows) > MAX_DEPARTMENTS:
        return counted
    return F.broadcast(requests.sparkSession.createDataFrame(rows, counted.schema))


def _timed(rows: DataFrame, at: Column) -> DataFrame:
    """Features of the time ``at`` at which a request is, or was, judged."""
    return rows.withColumns(
        {
            "elapsed_hours": hours_between(F.col("created_at"), at),
            "day_of_week": (F.dayofweek(at) - 1).cast("int"),
            "hour_of_day": F.hour(at),
        }
    )


def _measured(rows: DataFrame, requests: DataFrame, alerts: DataFrame) -> DataFrame:
    """Features measured on all requests and alerts: usual time, backlog of the department, warnings of the request."""
    history = requests.where(F.col("current_stage") == "Completed").agg(
        F.avg(hours_between(F.col("created_at"), F.col("updated_at")))
    )
    warnings = (
        alerts.where(F.col("severity") == "Warning")
        .groupBy(F.col("request_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("_warnings"))
    )
    joined = rows.join(warnings, "id", "left").join(_backlog(requests), "assigned_department", "left")
    return joined.withColumns(
        {
            "historical_avg_hours": F.coalesce(history.scalar(), F.lit(S.DEFAULT_HISTORY_HOURS)),
            "dept_backlog": F.coalesce("_backlog", F.lit(0)),
            "prior_sla_warnings": F.coalesce("_warnings", F.lit(0)),
        }
    )


def prediction_features(requests: DataFrame, as_of, alerts: DataFrame | None = None) -> DataFrame:
    """Feature row of every active request.

    Without ``alerts`` history, backlog and warnings are the fixed defaults. With it they are
    computed: mean completion time, active requests of the department, warnings of the request.
    """
    active = active_requests(requests)
    if alerts is None:
        rows = active.withColumns(
            {
                "historical_avg_hours": F.lit(S.DEFAULT_HISTORY_HOURS),
                "dept_backlog": F.lit(0).cast("bigint"),
                "prior_sla_warnings": F.lit(0).cast("bigint"),
            }
        )
    else:
        rows = _measured(active, requests, alerts)
    timed = _timed(rows, instant(as_of))
    return timed.select(F.col("id").alias("request_id"), "current_stage", "assigned_department", *FEATURES)


def _clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def _top_factors(pairs: list[tuple[str, Column]], most: int = 5) -> Column:
    """Factors by falling influence, earlier ones first on ties, at most ``most``."""
    entries = F.array(
        *[F.struct((-v).alias("order"), F.lit(i).alias("place"), F.lit(n).alias("factor"), v.alias("influence")) for i, (n, v) in enumerate(pairs)]
    )
    kept = F.slice(F.sort_array(entries), 1, most)
    return F.transform(kept, lambda e: F.struct(e["factor"].alias("factor"), e["influence"].alias("influence")))


def clamp_factors(factors: Column) -> Column:
    """One to five factors; a neutral one when there are none."""
    neutral = F.array(F.struct(F.lit("elapsed_time").alias("factor"), F.lit(0.0).alias("influence")))
    return F.when(F.coalesce(F.size(factors), F.lit(0)) <= 0, neutral).otherwise(F.slice(factors, 1, 5))


def score_heuristic(features: DataFrame, as_of) -> DataFrame:
    """Risk score, label, factors, expected delay, its confidence and completion time.

    Half the weight is elapsed over usual time, 0.3 the backlog (full at 50), 0.2 the warnings
    (full at 3). The label comes from the unrounded score.
    """
    usual = F.col("historical_avg_hours")
    ratio = F.when(usual > 0, F.col("elapsed_hours") / usual).otherwise(F.lit(0.0))
    rows = features.withColumn("_elapsed", ratio * 0.5).withColumns(
        {
            "_backlog": F.least(F.col("dept_backlog") / 50.0, F.lit(1.0)) * 0.3,
            "_warned": F.least(F.col("prior_sla_warnings") / 3.0, F.lit(1.0)) * 0.2,
            "_delay": F.when(ratio > 1, F.greatest((ratio - 1.0) * usual, F.lit(0.0))),
        }
    )
    rows = rows.withColumn("_score", _clip(F.col("_elapsed") + F.col("_backlog") + F.col("_warned"), 0.0, 1.0))
    confidence = F.when(F.col("_delay").isNotNull(), _clip(1.0 - F.abs(F.col("_score") - 0.5), 0.5, 0.95))
    factors = _top_factors(
        [
            ("elapsed_time_ratio", half_up(F.col("_elapsed"), 3)),
            ("dept_backlog", half_up(F.col("_backlog"), 3)),
            ("prior_sla_warnings", half_up(F.col("_warned"), 3)),
        ]
    )
    return rows.withColumns(
        {
            "risk_score": half_up(F.col("_score"), 3),
            "risk_label": risk_label(F.col("_score")),
            "contributing_factors": factors,
            "predicted_delay_hours": half_up(F.col("_delay"), 2),
            "delay_confidence": half_up(confidence, 3),
            "predicted_completion_at": plus_hours(instant(as_of), F.col("_delay")),
        }
    ).drop("_elapsed", "_backlog", "_warned", "_delay", "_score")


def _up_to(moments: DataFrame, facts: DataFrame, key: str, amounts: list[str], hot: dict | None = None, **cut) -> DataFrame:
    """Moments (``key``, ``at``, ``moment``, ...) with the sums of the facts' amounts of their key up to their time.

    Facts and moments are put in one order per key and the amounts run along; a fact at the very time counts. Hot keys
    are cut into chunks by ``sequence``.
    """
    steps = facts.withColumn("_tie", F.lit("0")).unionByName(
        moments.withColumn("_tie", F.concat(F.lit("1"), F.col("moment"))), allowMissingColumns=True
    )
    want = Sequence(running={f"_{a}": a for a in amounts})
    run = sequence(steps, key, "at", "_tie", want, hot, **cut).where(F.col("moment").isNotNull())
    return run.select(*moments.columns, *[F.col(f"_{a}").alias(a) for a in amounts])


def features_at(moments: DataFrame, requests: DataFrame, alerts: DataFrame, hot: dict | None = None, **cut) -> DataFrame:
    """Features of requests as they stood at given moments, unmoved by anything later.

    ``moments(moment, request_id, at, ...)`` are named uniquely by ``moment``. The backlog of a department is a running sum of
    requests that opened and closed, the usual time one of completed requests and their hours, warnings one of the
    request's alerts.
    """
    known = requests.select(F.col("id").alias("request_id"), "assigned_department", "created_at")
    rows = moments.join(known, "request_id")
    closed = requests.where(F.col("current_stage").isin(S.TERMINAL_STAGES))
    moves = [(requests, "created_at", 1), (closed, "updated_at", -1)]
    opened, left = (
        r.where(F.col("assigned_department").isNotNull()).select(
            F.col("assigned_department").alias("_of"), F.col(at).alias("at"), F.lit(n).cast("bigint").alias("_open")
        )
        for r, at, n in moves
    )
    # Moments without a department have no backlog; keys of their own spread them.
    rows = rows.withColumn("_of", F.coalesce("assigned_department", F.concat(F.lit("\0"), "moment")))
    rows = _up_to(rows, opened.unionByName(left), "_of", ["_open"], hot, **cut)
    took = F.unix_micros("updated_at") - F.unix_micros("created_at")
    done = requests.where(F.col("current_stage") == "Completed").select(
        F.lit("").alias("_all"), F.col("updated_at").alias("at"), F.lit(1).cast("bigint").alias("_done"), took.alias("_took")
    )
    rows = _up_to(rows.withColumn("_all", F.lit("")), done, "_all", ["_done", "_took"], hot, **cut)
    warned = alerts.where(F.col("severity") == "Warning").select("request_id", F.col("created_at").alias("at"), F.lit(1).cast("bigint").alias("_warned"))
    rows = _up_to(rows, warned, "request_id", ["_warned"], hot, **cut)
    usual = F.when(F.col("_done") > 0, F.col("_took") / 3.6e9 / F.col("_done"))
    return _timed(rows, F.col("at")).withColumns(
        {
            "historical_avg_hours": F.coalesce(usual, F.lit(S.DEFAULT_HISTORY_HOURS)),
            "dept_backlog": F.col("_open"),
            "prior_sla_warnings": F.col("_warned"),
        }
    ).drop("_all", "_of", "_open", "_done", "_took", "_warned")


def training_rows(requests: DataFrame, alerts: DataFrame, evaluated: DataFrame, as_of, hot: dict | None = None, **cut) -> DataFrame:
    """What was known when a request entered a stage, and what came of it, of requests completed by ``as_of``.

    ``evaluated`` is ``sla_evaluate`` of all stays. A row's features are those of the moment, ``label`` says whether a breach
    came after it, and ``excess_hours`` by how much the whole request outlasted what was usual then. Open requests have
    no outcome yet and give no rows.
    """
    ended = requests.where((F.col("current_stage") == "Completed") & (F.col("updated_at") <= instant(as_of)))
    moments = evaluated.where(F.col("journey_stage").isin(S.ACTIVE_STAGES)).select(
        F.col("id").alias("moment"), "request_id", "journey_stage", F.col("entered_at").alias("at")
    )
    due = F.when(F.col("breached"), plus_hours(F.col("entered_at"), F.col("threshold_hours")))
    breaches = evaluated.groupBy("request_id").agg(F.max(due).alias("_breach"))
    total = hours_between(F.col("created_at"), F.col("updated_at"))
    outcome = ended.select(F.col("id").alias("request_id"), total.alias("_total")).join(breaches, "request_id", "left")
    rows = features_at(moments.join(ended.select(F.col("id").alias("request_id")), "request_id", "left_semi"), requests, alerts, hot, **cut)
    return rows.join(outcome, "request_id").select(
        "request_id", "journey_stage", F.col("at").alias("judged_at"), *FEATURES,
        F.coalesce(F.col("_breach") > F.col("at"), F.lit(False)).cast("double").alias("label"),
        F.greatest(F.col("_total") - F.col("historical_avg_hours"), F.lit(0.0)).alias("excess_hours"),
    )


def fit_model(history: DataFrame, rounds: int = 5, depth: int = 3):
    """Boosted trees for the risk (classifier) and the delay (regressor), fitted on the cluster."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    risk = GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=depth, seed=7)
    delay = GBTRegressor(labelCol="excess_hours", predictionCol="_delay", maxIter=rounds, maxDepth=depth, seed=7)
    history = history.persist()  # the boosting passes read it again and again
    try:
        return Pipeline(stages=[assembler, risk, delay]).fit(history)
    finally:
        history.unpersist()


def score(features: DataFrame, as_of, model=None) -> DataFrame:
    """Scores from a fitted model, or from the heuristic when there is none."""
    if model is None:
        return score_heuristic(features, as_of)
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(features)
    chance = _clip(F.get(vector_to_array("probability"), F.lit(1)), 0.0, 1.0)
    weights = model.stages[1].featureImportances.toArray()
    factors = _top_factors([(n, F.lit(float(w))) for n, w in zip(FEATURES, weights, strict=True)])
    late = F.col("_late") > 0
    return (
        scored.withColumns({"_chance": chance, "_late": _clip(F.col("_delay"), 0.0, MAX_DELAY_HOURS)})
        .withColumns(
            {
                "risk_score": half_up(F.col("_chance"), 3),
                "risk_label": risk_label(F.col("_chance")),
                "contributing_factors": factors,
                "predicted_delay_hours": F.when(late, half_up(F.col("_late"), 2)),
                "delay_confidence": F.lit(MODEL_CONFIDENCE),
                "predicted_completion_at": F.when(late, plus_hours(instant(as_of), F.col("_late"))),
            }
        )
        .select(
            *features.columns, "risk_score", "risk_label", "contributing_factors", "predicted_delay_hours",
            "delay_confidence", "predicted_completion_at",
        )
    )


def prediction_rows(scored: DataFrame, as_of) -> DataFrame:
    """Rows for the prediction log: factors clamped, fresh, stamped."""
    return scored.select(
        "request_id",
        F.col("risk_score").cast("decimal(4,3)").alias("risk_score"),
        "risk_label",
        clamp_factors(F.col("contributing_factors")).alias("contributing_factors"),
        F.col("predicted_delay_hours").try_cast("decimal(8,2)").alias("predicted_delay_hours"),
        F.col("delay_confidence").cast("decimal(4,3)").alias("delay_confidence"),
        "predicted_completion_at",
        F.lit(False).alias("is_stale"),
        instant(as_of).alias("last_computed_at"),
    )


def current_prediction(predictions: DataFrame, pick: str = "latest") -> DataFrame:
    """One fresh prediction per request: the latest, or the oldest with ``pick='oldest'``."""
    rest = [c for c in predictions.columns if c != "request_id"]
    choose = F.max_by if pick == "latest" else F.min_by
    order = F.struct("last_computed_at", "risk_score")
    return (
        predictions.where(~F.col("is_stale"))
        .groupBy("request_id")
        .agg(choose(F.struct(*rest), order).alias("_row"))
        .select("request_id", "_row.*")
    )


def delay_prediction(predictions: DataFrame) -> DataFrame:
    """Delay and confidence of the current prediction of each request."""
    return current_prediction(predictions).select("request_id", "predicted_delay_hours", "delay_confidence")


def prediction_cache_miss(requests: DataFrame, predictions: DataFrame) -> DataFrame:
    """Active requests without a fresh prediction: only these need scoring."""
    fresh = predictions.where(~F.col("is_stale")).select(F.col("request_id").alias("id")).distinct()
    return active_requests(requests).join(fresh, "id", "left_anti")


def refresh_predictions(requests: DataFrame, as_of, model=None, alerts: DataFrame | None = None) -> DataFrame:
    """New prediction rows of all active requests, as one set-based job."""
    return prediction_rows(score(prediction_features(requests, as_of, alerts), as_of, model), as_of)


def risk_alerts(predictions: DataFrame, open_alerts: DataFrame | None = None) -> DataFrame:
    """Critical delay alerts for high and critical risks.

    With ``open_alerts`` a request that already has an open alert of this type gets no second one.
    """
    facts = F.struct(
        F.col("risk_score").cast("double").alias("riskScore"),
        F.col("risk_label").alias("riskLabel"),
        F.col("last_computed_at").alias("computedAt"),
    )
    message = F.format_string(
        "High risk detected: %s (score: %s)", F.col("risk_label"), fixed_text(F.col("risk_score").cast("double"), 3)
    )
    rows = predictions.where(F.col("risk_label").isin("High", "Critical")).select(
        F.concat_ws("|", "request_id", F.lit("risk"), F.unix_millis("last_computed_at").cast("string")).alias("id"),
        "request_id",
        F.lit(S.CRITICAL_DELAY).alias("alert_type"),
        F.lit("Critical").alias("severity"),
        F.lit("Created").alias("lifecycle_state"),
        message.alias("message"),
        F.to_json(facts).alias("metadata"),
        F.col("last_computed_at").alias("created_at"),
    )
    if open_alerts is None:
        return rows
    held = open_alerts.where((F.col("lifecycle_state") != "Archived") & (F.col("alert_type") == S.CRITICAL_DELAY))
    return rows.join(held.select("request_id").distinct(), "request_id", "left_anti").select(*rows.columns)
