"""Scores, factors, labels and the prediction log."""

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stagewatch.functions.ladders import risk_label
from stagewatch.operators import predict

NOW = datetime(2024, 1, 31, 10)
SHAPE = ("request_id string, current_stage string, assigned_department string, elapsed_hours double, historical_avg_hours double, "
         "dept_backlog bigint, prior_sla_warnings bigint, day_of_week int, hour_of_day int")


def features(spark, *rows):
    data = [(f"r{i:02d}", "Inquiry", None, *row, 1, 10) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, SHAPE)


def scores(spark, *rows):
    return predict.score_heuristic(features(spark, *rows), NOW).orderBy("request_id").collect()


def test_default_request(spark):
    row = scores(spark, (2.0, 8.0, 5, 0))[0]
    assert row.risk_score == pytest.approx(0.155, abs=1e-3) and row.risk_label == "Low"
    assert [(f.factor, f.influence) for f in row.contributing_factors] == [("elapsed_time_ratio", 0.125), ("dept_backlog", 0.03), ("prior_sla_warnings", 0.0)]
    assert row.predicted_delay_hours is None and row.delay_confidence is None and row.predicted_completion_at is None


def test_late_request(spark):
    row = scores(spark, (20.0, 8.0, 100, 9))[0]
    assert (row.risk_score, row.risk_label, row.predicted_delay_hours, row.delay_confidence) == (1.0, "Critical", 12.0, 0.5)
    assert row.predicted_completion_at == NOW + timedelta(hours=12)


def test_zero_history_and_order(spark):
    zero, low, high = scores(spark, (2.0, 0.0, 5, 0), (1.0, 8.0, 5, 0), (20.0, 8.0, 5, 0))
    assert zero.risk_score >= 0 and high.risk_score > low.risk_score
    # Equal influences keep their order.
    assert [f.factor for f in zero.contributing_factors][1:] == ["elapsed_time_ratio", "prior_sla_warnings"]


def test_absurd_history_gives_no_completion_time(spark):
    row = scores(spark, (5000.0, 5e-324, 0, 0))[0]
    assert row.risk_label == "Critical" and row.predicted_completion_at is None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 5000), st.floats(0, 500), st.integers(0, 300), st.integers(0, 20)), min_size=1, max_size=40))
def test_scores_stay_in_range(spark, rows):
    for r, (elapsed, usual, backlog, warned) in zip(scores(spark, *rows), rows, strict=True):
        ratio = elapsed / usual if usual > 0 else 0.0
        exact = min(max(ratio * 0.5 + min(backlog / 50, 1) * 0.3 + min(warned / 3, 1) * 0.2, 0), 1)
        assert 0 <= r.risk_score <= 1 and r.risk_score == pytest.approx(exact, abs=1e-3)
        assert 1 <= len(r.contributing_factors) <= 5
        assert (r.predicted_delay_hours is not None) == (ratio > 1)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=200))
def test_labels(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, 0.0, 0.25, 0.5, 0.75, 1.0]], "s double")
    for r in df.select("s", risk_label(F.col("s")).alias("l")).collect():
        assert r.l == ("Critical" if r.s >= 0.75 else "High" if r.s >= 0.5 else "Medium" if r.s >= 0.25 else "Low")


def test_prediction_log(spark):
    early = predict.prediction_rows(predict.score_heuristic(features(spark, (60.0, 72.0, 0, 0), (10.0, 72.0, 0, 0)), NOW), NOW)
    late = predict.prediction_rows(predict.score_heuristic(features(spark, (90.0, 72.0, 0, 0)), NOW), NOW + timedelta(hours=5))
    log = early.unionByName(late)
    now = {r.request_id: r for r in predict.current_prediction(log).collect()}
    assert float(now["r00"].risk_score) == 0.625 and now["r01"].risk_label == "Low"
    assert float({r.request_id: r for r in predict.current_prediction(log, "oldest").collect()}["r00"].risk_score) == 0.417
    assert predict.delay_prediction(log).where("request_id = 'r00'").first().predicted_delay_hours == 18
    alerts = predict.risk_alerts(log)
    assert [(r.request_id, r.message) for r in alerts.collect()] == [("r00", "High risk detected: High (score: 0.625)")]
    assert predict.risk_alerts(log, alerts).count() == 0


def test_empty_factors_get_a_neutral_one(spark):
    df = spark.sql("SELECT CAST(array() AS array<struct<factor:string,influence:double>>) AS f")
    assert df.select(predict.clamp_factors(F.col("f")).alias("f")).first().f[0].factor == "elapsed_time"


def test_model_scores(spark):
    rows = [(f"r{i}", float(i), 72.0, float(i % 7), float(i % 3), 1.0, 2.0, float(i > 60), max(i - 72.0, 0.0)) for i in range(120)]
    names = ["request_id", *predict.FEATURES, "label", "excess_hours"]
    model = predict.fit_model(spark.createDataFrame(rows, names))
    got = predict.score(features(spark, (5.0, 72.0, 1, 0), (115.0, 72.0, 1, 0)), NOW, model).orderBy("request_id").collect()
    assert got[0].risk_label == "Low" and got[1].risk_label == "Critical"
    assert got[1].predicted_delay_hours > 20 and got[1].delay_confidence == 0.75
    assert len(got[1].contributing_factors) == 5 and got[1].contributing_factors[0].factor == "elapsed_hours"


KIND = "id string, current_stage string, assigned_department string, sla_breached boolean, created_at timestamp, updated_at timestamp"


def test_fit_and_score_see_the_same_features(spark):
    """Features at the present moment are those that scoring sees."""
    made = datetime(2024, 1, 30, 4)
    rows = [(f"r{i}", "Inquiry", None if i == 3 else "Sales", i == 1, made, made) for i in range(4)]
    requests = spark.createDataFrame([*rows, ("done", "Completed", "Sales", False, made, datetime(2024, 1, 30, 8))], KIND)
    alerts = spark.createDataFrame([("r0", "Warning", made), ("r0", "Critical", made)], "request_id string, severity string, created_at timestamp")
    scored = {r.request_id: r for r in predict.prediction_features(requests, NOW, alerts).collect()}
    moments = requests.select(F.col("id").alias("moment"), F.col("id").alias("request_id"), F.lit(NOW).cast("timestamp").alias("at"))
    learned = {r.request_id: r for r in predict.features_at(moments, requests, alerts).collect()}
    for key, row in scored.items():
        assert [row[f] for f in predict.FEATURES] == [learned[key][f] for f in predict.FEATURES]
    assert (scored["r0"].dept_backlog, scored["r3"].dept_backlog, scored["r0"].prior_sla_warnings) == (3, 0, 1)


def _stays(spark, requests):
    """Each completed request enters Inquiry, then a breached Quotation after ten hours, then ends."""
    stays = []
    for r in requests.where("current_stage = 'Completed'").collect():
        later = r.created_at + timedelta(hours=10)
        stays += [(f"{r.id}-1", r.id, "Inquiry", r.created_at, False, 24.0), (f"{r.id}-2", r.id, "Quotation", later, True, 48.0), (f"{r.id}-3", r.id, "Completed", r.updated_at, None, None)]
    return spark.createDataFrame(stays, "id string, request_id string, journey_stage string, entered_at timestamp, breached boolean, threshold_hours double")


def test_training_rows_know_nothing_later(spark):
    start = datetime(2024, 1, 1)
    rows = [(f"r{i}", "Completed" if i % 2 else "Inquiry", "Sales", False, start + timedelta(hours=7 * i), start + timedelta(hours=7 * i + 90)) for i in range(10)]
    requests = spark.createDataFrame(rows, KIND)
    warned = [("r1", "Warning", start + timedelta(hours=12)), ("r1", "Critical", start), ("r3", "Warning", start + timedelta(hours=40))]
    shape = "request_id string, severity string, created_at timestamp"
    stays = _stays(spark, requests)

    def train(requests, warnings):
        found = predict.training_rows(requests, spark.createDataFrame(warnings, shape), stays, datetime(2024, 2, 1)).collect()
        return {(r.request_id, r.journey_stage): r for r in found}

    got = train(requests, warned)
    assert set(got) == {(f"r{i}", s) for i in range(1, 10, 2) for s in ("Inquiry", "Quotation")}
    for (key, stage), r in got.items():
        i, t = int(key[1:]), r.judged_at
        opened = sum(c <= t and not (s == "Completed" and u <= t) for _, s, _, _, c, u in rows)
        took = [90.0 for _, s, _, _, _, u in rows if s == "Completed" and u <= t]
        assert (r.dept_backlog, r.historical_avg_hours) == (opened, sum(took) / len(took) if took else 72.0)
        assert r.prior_sla_warnings == sum(k == key and s == "Warning" and w <= t for k, s, w in warned)
        assert r.elapsed_hours == (0.0 if stage == "Inquiry" else 10.0) and r.label == 1.0
        assert r.excess_hours == max(90.0 - r.historical_avg_hours, 0.0) and i % 2
    # A warning and a request that come later leave the earlier rows as they are.
    more = train(requests.unionByName(spark.createDataFrame([("new", "Inquiry", "Sales", False, start + timedelta(hours=50), start)], KIND)), [*warned, ("r1", "Warning", start + timedelta(hours=50))])
    early = {k: v for k, v in got.items() if v.judged_at < start + timedelta(hours=50)}
    assert early and all(more[k] == v for k, v in early.items())
    assert predict.training_rows(requests.limit(0), spark.createDataFrame(warned, shape), stays, NOW).count() == 0


def test_training_rows_of_hot_departments(spark):
    """Cut into chunks the running sums are the same."""
    start = datetime(2024, 1, 1)
    rows = [(f"r{i}", "Completed" if i % 3 else "Inquiry", "Sales" if i % 4 else None, False, start + timedelta(hours=i % 50), start + timedelta(hours=i % 50 + 30 + i % 7)) for i in range(300)]
    requests = spark.createDataFrame(rows, KIND)
    alerts = spark.createDataFrame([(f"r{i}", "Warning", start + timedelta(hours=i % 60)) for i in range(0, 300, 2)], "request_id string, severity string, created_at timestamp")
    stays = _stays(spark, requests)
    whole = predict.training_rows(requests, alerts, stays, datetime(2024, 3, 1), hot={})
    cut = predict.training_rows(requests, alerts, stays, datetime(2024, 3, 1), hot={"Sales": 500, "": 500}, rows_per_chunk=40)
    assert whole.count() == 400 and whole.exceptAll(cut).count() == cut.exceptAll(whole).count() == 0


def test_more_departments_than_are_broadcast(spark, monkeypatch):
    kind = "id string, current_stage string, assigned_department string, sla_breached boolean, created_at timestamp, updated_at timestamp"
    requests = spark.createDataFrame([(f"r{i}", "Inquiry", f"d{i % 5}", False, NOW, NOW) for i in range(10)], kind)
    alerts = spark.createDataFrame([], "request_id string, severity string")
    few = sorted(predict.prediction_features(requests, NOW, alerts).collect())
    monkeypatch.setattr(predict, "MAX_DEPARTMENTS", 3)
    assert sorted(predict.prediction_features(requests, NOW, alerts).collect()) == few and few[0].dept_backlog == 2
