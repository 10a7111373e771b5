"""SLA evaluation, alerts, compliance, bottlenecks and the alert lifecycle on literal rows."""

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stagewatch import schema as S
from stagewatch.operators import analytics, lifecycle, sla, timeline
from stagewatch.sources import bulk

START = datetime(2024, 1, 1)


def at(hours):
    return START + timedelta(hours=hours)


def events(spark, rows):
    """(request, hours, state) rows as events."""
    data = [(f"e{i}", r, s, at(h), "Sales") for i, (r, h, s) in enumerate(rows)]
    return spark.createDataFrame(data, "id string, request_id string, new_state string, occurred_at timestamp, department string")


def evaluate(spark, rows, as_of, rules=None):
    return sla.sla_evaluate(sla.stage_dwell(events(spark, rows), as_of), rules if rules is not None else bulk.rules(spark))


@pytest.mark.parametrize(
    ("share", "severity", "breached"),
    [(0.79, None, False), (0.801, "Warning", False), (0.99, "Warning", False), (1.0, "Critical", True), (1.5, "Critical", True)],
)
def test_thresholds(spark, share, severity, breached):
    done = evaluate(spark, [("r", 0, "Inquiry")], START + timedelta(minutes=round(24 * 60 * share)))
    found = [r.severity for r in sla.sla_alert_candidates(done).collect()]
    assert found == ([severity] if severity else [])
    assert done.first().breached == breached


def test_messages(spark):
    rows = [("r", 0, "Inquiry"), ("r", 30, "Sales Review")]
    found = {r.journey_stage: r for r in sla.sla_alert_candidates(evaluate(spark, rows, at(70))).collect()}
    assert found["Inquiry"].message == 'SLA breached for request r at stage "Inquiry". Elapsed: 30.00h / Threshold: 24h.'
    assert found["Sales Review"].message == 'SLA warning for request r at stage "Sales Review". 83.3% of threshold used (40.00h / 48h).'
    assert found["Inquiry"].alert_type == S.SLA_BREACH and found["Inquiry"].lifecycle_state == "Created"
    assert '"journeyStage":"Inquiry"' in found["Inquiry"].metadata


def test_stage_without_rule(spark):
    rules = bulk.rules(spark).where("journey_stage <> 'Inquiry'")
    done = evaluate(spark, [("r", 0, "Inquiry")], at(500), rules)
    row = done.first()
    assert (row.threshold_hours, row.percent_used, row.breached) == (0.0, 0.0, False)
    alert = sla.sla_alert_candidates(done).first()
    assert (alert.severity, alert.alert_type) == ("Info", S.OPERATIONAL)


def test_terminal_and_unknown_stages_are_not_evaluated(spark):
    assert evaluate(spark, [("r", 0, "Completed"), ("q", 0, "Cancelled"), ("p", 0, "Lunch")], at(999)).count() == 0


def test_dedup_against_open_and_archived_alerts(spark):
    done = evaluate(spark, [("a", 0, "Inquiry"), ("b", 0, "Inquiry"), ("c", 0, "Inquiry")], at(30))
    meta = '{"journeyStage":"Inquiry"}'
    old = spark.createDataFrame(
        [("a", "Critical", "Resolved", meta), ("b", "Critical", "Archived", meta), ("c", "Warning", "Created", meta)]
        + [("b", "Critical", "Archived", meta)],
        "request_id string, severity string, lifecycle_state string, metadata string",
    )
    candidates = sla.sla_alert_candidates(done)
    new = sla.dedup_alerts(candidates.unionByName(candidates), old)
    assert {r.request_id: r.id for r in new.collect()} == {"b": "b|Inquiry|Critical|3", "c": "c|Inquiry|Critical"}


def test_breach_flag_is_sticky(spark):
    requests = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "id string, sla_breached boolean")
    done = evaluate(spark, [("a", 0, "Inquiry"), ("a", 1, "Sales Review"), ("b", 0, "Inquiry")], at(30))
    assert {r.id: r.sla_breached for r in sla.apply_breach(requests, done).collect()} == {"a": True, "b": True, "c": False}


def test_rule_seed_and_upsert(spark):
    rules = bulk.rules(spark)
    assert sla.seed_rules(rules.where("journey_stage = 'Delivery'")).count() == 7
    assert sla.seed_rules(rules).count() == 7
    changes = spark.createDataFrame(
        [("Inquiry", 12.5), ("Delivery", 0.0), ("Approval", 8761.0), ("Lunch", 5.0), ("Cancelled", 1.0)],
        "journey_stage string, threshold_hours double",
    )
    after = {r.journey_stage: float(r.threshold_hours) for r in sla.upsert_rules(rules, changes).collect()}
    assert after["Inquiry"] == 12.5 and after["Delivery"] == 96 and after["Approval"] == 24
    assert "Lunch" not in after and "Cancelled" not in after and len(after) == 7
    twice = spark.createDataFrame(
        [("Inquiry", 30.0, 1), ("Inquiry", 20.0, 3), ("Inquiry", 25.0, 2)], "journey_stage string, threshold_hours double, changed_at int"
    )
    after = {r.journey_stage: float(r.threshold_hours) for r in sla.upsert_rules(rules, twice).collect()}
    assert after["Inquiry"] == 20 and len(after) == 7


def requests(spark, rows):
    return spark.createDataFrame(
        rows, "id string, assigned_department string, current_stage string, sla_breached boolean, created_at timestamp, updated_at timestamp"
    )


def test_compliance(spark):
    rows = [("1", "Sales", "Inquiry", True, at(1), at(2)), ("2", "Sales", "Approval", False, at(1), at(2)),
            ("3", None, "Inquiry", False, at(1), at(2)), ("4", "Sales", "Inquiry", True, at(999), at(999))]
    got = {(r.kind, r.label): r.compliance_rate for r in sla.compliance(requests(spark, rows), START, at(48)).collect()}
    assert got == {("department", "Sales"): 0.5, ("department", "Unassigned"): 1.0, ("stage", "Inquiry"): 0.5, ("stage", "Approval"): 1.0}
    overall = sla.compliance_overall(requests(spark, rows), START, at(48)).first()
    assert (overall.overall_rate, overall.departments, overall.records) == (0.75, 2, 3)
    empty = sla.compliance_overall(requests(spark, []), START, at(48)).first()
    assert (empty.overall_rate, empty.departments, empty.weighted_rate, empty.records) == (1.0, 0, 1.0, 0)


@pytest.mark.parametrize(("start", "end"), [(at(48), START), (START, at(23)), (START, at(24 * 366))])
def test_compliance_period(spark, start, end):
    with pytest.raises(ValueError):
        sla.compliance(requests(spark, []), start, end)


def test_trend_period(spark):
    analytics.check_trend_range(START, at(1))
    for end in (START, at(24 * 366 + 1)):
        with pytest.raises(ValueError):
            analytics.trends(requests(spark, []), START, end)


def test_kpis_of_nothing(spark):
    row = analytics.kpis(requests(spark, []), START).first()
    assert tuple(row) == (0.0, 1.0, 0.0, 0.0, 0.0)


def test_department_time(spark):
    rows = [("1", "A", at(0)), ("2", "A", at(10)), ("3", "A", at(2)), ("4", "B", at(5)), ("5", None, at(7))]
    df = spark.createDataFrame(rows, "id string, department string, occurred_at timestamp")
    assert {r.department: r.avg_hours for r in analytics.dept_processing_time(df).collect()} == {"A": 5.0, "B": 0.0}


def test_bottlenecks(spark):
    rows = [("r", 0, "Inquiry"), ("r", 34, "Approval"), ("q", 0, "Delivery")]
    heuristic = sla.bottlenecks_heuristic(events(spark, rows), bulk.rules(spark), 2).orderBy("rank").collect()
    assert [(r["rank"], r.journey_stage, round(r.avg_excess_hours, 6)) for r in heuristic] == [(1, "Delivery", 19.2), (2, "Approval", 4.8)]
    measured = sla.bottlenecks_measured(evaluate(spark, rows, at(60)), 5).orderBy("rank").collect()
    assert [(r.journey_stage, r.avg_excess_hours) for r in measured] == [("Inquiry", 10.0), ("Approval", 2.0)]


def test_period_bounds():
    moment = datetime(2024, 5, 15, 13, 30)
    assert [analytics.period_bounds(k, moment)[0] for k in S.SNAPSHOT_TYPES] == [
        datetime(2024, 5, 15), datetime(2024, 5, 13), datetime(2024, 5, 1), datetime(2024, 4, 1)]
    assert analytics.period_bounds("Quarterly", datetime(2024, 12, 31))[1] == datetime(2024, 12, 31, 23, 59, 59, 999000)


def test_snapshot_partitions_are_replaced(spark, tmp_path):
    from stagewatch.sources.tables import write_snapshot

    rows = [("1", "Sales", "Completed", False, at(1), at(5))]
    ev = spark.createDataFrame([("1", "A", at(0))], "id string, department string, occurred_at timestamp")
    path = str(tmp_path / "snapshots")
    for day in (0, 0, 1):
        bounds = analytics.period_bounds("Daily", at(24 * day))
        write_snapshot(analytics.snapshot_rows(requests(spark, rows), ev, "Daily", *bounds, at(30)), path)
    stored = spark.read.parquet(path)
    assert stored.groupBy("period_date").count().orderBy("period_date").collect()[0]["count"] == 6
    assert stored.count() == 11
    assert float(stored.where("kpi_key = 'avg_completion_time' and day(period_start) = 1").first().kpi_value) == 4.0


# --- lifecycle ------------------------------------------------------------------------------

NEXT = {"acknowledge": ("Created", "Acknowledged"), "resolve": ("Acknowledged", "Resolved"), "archive": ("Resolved", "Archived")}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(S.LIFECYCLE), st.lists(st.sampled_from([*NEXT, "escalate"]), max_size=8)), min_size=1, max_size=12))
def test_transitions_equal_a_replay(spark, cases):
    alerts = spark.createDataFrame(
        [(f"a{i}", None, S.OPERATIONAL, "Info", state, "m", None, START, None, None, None, None, None) for i, (state, _) in enumerate(cases)], S.TABLES["alerts"]
    )
    sent = [(f"c{i}-{j}", f"a{i}", action, f"u{j}", at(j)) for i, (_, actions) in enumerate(cases) for j, action in enumerate(actions)]
    commands = spark.createDataFrame(sent, S.TABLES["alert_commands"])
    after, rejects = lifecycle.apply_transitions(alerts, commands)
    states, refused, stamps = {}, {}, {}
    for i, (state, actions) in enumerate(cases):
        for j, action in enumerate(actions):
            if action in NEXT and NEXT[action][0] == state:
                state = NEXT[action][1]
                stamps[f"a{i}", state] = at(j)
            else:
                refused[f"c{i}-{j}"] = state
        states[f"a{i}"] = state
    rows = after.collect()
    assert {r.id: r.lifecycle_state for r in rows} == states
    assert {r.command_id: r.current_state for r in rejects.collect()} == refused
    for r in rows:
        assert r.acknowledged_at == stamps.get((r.id, "Acknowledged")) and r.archived_at == stamps.get((r.id, "Archived"))


def test_patches(spark):
    base = spark.createDataFrame(
        [("r", "SR-1", "Ann", "Sales", "u1", "Inquiry", START), ("q", "SR-2", "Bob", "Sales", "u2", "Inquiry", START)],
        "id string, request_number string, customer_name string, assigned_department string, assigned_user_id string, current_stage string, updated_at timestamp",
    )
    patches = spark.createDataFrame(
        [("r", "p1", at(1), ["customer_name", "assigned_user_id"], "Eve", None, None), ("r", "p2", at(2), ["assigned_department"], "ignored", "Ops", "u9")],
        "request_id string, patch_id string, at timestamp, fields array<string>, customer_name string, assigned_department string, assigned_user_id string",
    )
    got = {r.id: r for r in lifecycle.apply_patches(base, patches).collect()}
    assert (got["r"].customer_name, got["r"].assigned_department, got["r"].assigned_user_id, got["r"].updated_at) == ("Eve", "Ops", None, at(2))
    assert (got["r"].request_number, got["r"].current_stage) == ("SR-1", "Inquiry")
    assert (got["q"].customer_name, got["q"].updated_at) == ("Bob", START)


# --- timeline -------------------------------------------------------------------------------


def test_timeline_order_and_users(spark):
    rows = [("9", "r", "u1", at(1), at(1)), ("10", "r", None, at(1), at(2)), ("2", "r", "ghost", at(0), at(3))]
    ev = spark.createDataFrame(rows, "id string, request_id string, triggered_by_user string, occurred_at timestamp, received_at timestamp").withColumns(
        {c: F.lit(None).cast("string") for c in ("event_type", "department", "source_system", "previous_state", "new_state", "metadata")}
    )
    users = spark.createDataFrame([("u1", "a@example.com")], "id string, email string")
    got = timeline.timeline_of(ev, timeline.timeline_positions(ev), users, "r").collect()
    assert [r.event_id for r in got] == ["2", "10", "9"]
    assert [r.position for r in got] == [3, 2, 1]
    assert [r.triggered_by for r in got][:2] == [None, None] and got[2].triggered_by.email == "a@example.com"
    assert got[0].new_state is None and "department" in got[0].asDict()


def test_current_stage_follows_recorded_transitions(spark):
    rows = [("t1", "r", "u1", "Inquiry", "Approval", at(2))]
    commands = spark.createDataFrame(rows, "id string, request_id string, user_id string, previous_state string, new_state string, at timestamp")
    written = timeline.record_transitions(commands)
    assert written.first().pipeline_status == "complete" and written.first().event_type == "state_transition"
    before = events(spark, [("r", 0, "Inquiry")]).select("id", "request_id", "new_state", "occurred_at")
    both = before.unionByName(written.select(*before.columns))
    assert timeline.current_stage(both).first().current_stage == "Approval"
    assert timeline.journey_path(both).first().path == ["Inquiry", "Approval"]
