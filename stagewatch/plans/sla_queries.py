"""Queries over histories, SLA evaluation and the alert lifecycle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from stagewatch.functions.numbers import half_up
from stagewatch.functions.times import plus_hours
from stagewatch.operators import lifecycle, sla, timeline
from stagewatch.operators.broadcast import create_alerts
from stagewatch.plans.catalog import AS_OF_SQL, query, r6, rn
from stagewatch.sources import bulk

FROM, TO = datetime(2024, 1, 1), datetime(2024, 1, 31)


def r(column, digits: int = 6):
    return half_up(F.col(column) if isinstance(column, str) else column, digits)


def _evaluated(spark, d):
    return sla.sla_evaluate(bulk.dwell(spark, d), bulk.rules(spark))


@query("timeline_position", "SELECT request_id, id AS event_id, CAST(rn AS BIGINT) AS position FROM ops")
def timeline_position(spark, d):
    entries = timeline.timeline_positions(bulk.plain_events(spark, d), "occurred", bulk.hot_requests(spark, d))
    return entries.select("request_id", "event_id", "position")


@query(
    "timeline_position_arrival",
    "SELECT request_id, id AS event_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY received_at, id) AS BIGINT) AS position, received_at AS appended_at FROM ev",
)
def timeline_position_arrival(spark, d):
    return bulk.timelines(spark, d)


@query(
    "request_timeline",
    """SELECT o.request_id, o.id AS event_id, CAST(row_number() OVER (PARTITION BY o.request_id ORDER BY o.received_at, o.id) AS BIGINT) AS position,
    o.event_type, o.occurred_at, o.department, o.source_system, o.previous_state, o.new_state, o.metadata,
    u.id AS user_id, u.email AS user_email FROM ops o LEFT JOIN usr u ON u.id = o.triggered_by_user""",
)
def request_timeline(spark, d):
    entries = timeline.request_timeline(bulk.ops_events(spark, d), bulk.timelines(spark, d), bulk.users(spark, d))
    return entries.select(
        "request_id", "event_id", "position", "event_type", "occurred_at", "department", "source_system",
        "previous_state", "new_state", "metadata", F.col("triggered_by.id").alias("user_id"),
        F.col("triggered_by.email").alias("user_email"),
    )


@query(
    "journey_path",
    """SELECT request_id, string_agg(new_state, ' > ' ORDER BY first_at) AS path FROM
    (SELECT request_id, new_state, min(rn) AS first_at FROM ops GROUP BY 1, 2) GROUP BY 1""",
)
def journey_path(spark, d):
    return timeline.journey_path(bulk.ops_events(spark, d)).select("request_id", F.array_join("path", " > ").alias("path"))


@query(
    "current_stage",
    """SELECT request_id, new_state AS current_stage, occurred_at AS entered_at FROM ops
    WHERE next_at IS NULL""",
)
def current_stage(spark, d):
    return timeline.current_stage(bulk.ops_events(spark, d))


@query(
    "audited_transitions",
    """SELECT request_id, new_state AS current_stage, 'state_transition' AS event_type, occurred_at + INTERVAL 1 HOUR AS entered_at
    FROM ops WHERE next_at IS NULL AND rn < 8""",
)
def audited_transitions(spark, d):
    """Every open request is confirmed in its stage one hour after its last event."""
    here = timeline.current_stage(bulk.ops_events(spark, d)).where(F.col("current_stage") != "Completed")
    commands = here.select(
        F.concat(F.lit("t-"), "request_id").alias("id"), "request_id", F.lit("u1").alias("user_id"),
        F.col("current_stage").alias("previous_state"), F.col("current_stage").alias("new_state"),
        plus_hours(F.col("entered_at"), F.lit(1.0)).alias("at"),
    )
    written = timeline.record_transitions(commands)
    return written.select(
        "request_id", F.col("new_state").alias("current_stage"), "event_type", F.col("occurred_at").alias("entered_at")
    )


_DWELL = f"request_id, id AS event_id, journey_stage, entered_at, is_open, {r6('elapsed_hours')} AS elapsed_hours"


@query("stage_dwell", f"SELECT {_DWELL} FROM dwell")
def stage_dwell(spark, d):
    return bulk.dwell(spark, d).select(
        "request_id", F.col("id").alias("event_id"), "journey_stage", "entered_at", "is_open",
        r("elapsed_hours").alias("elapsed_hours"),
    )


@query(
    "sla_evaluation",
    f"SELECT {_DWELL}, threshold_hours, {r6('percent_used')} AS percent_used, breached FROM evald",
)
def sla_evaluation(spark, d):
    return _evaluated(spark, d).select(
        "request_id", F.col("id").alias("event_id"), "journey_stage", "entered_at", "is_open",
        r("elapsed_hours").alias("elapsed_hours"), "threshold_hours", r("percent_used").alias("percent_used"), "breached",
    )


@query(
    "sla_alerts",
    """SELECT id, request_id, alert_type, severity, message FROM alerts WHERE journey_stage <> 'Dispatch'
    UNION ALL SELECT request_id || '|Dispatch|Info', request_id, 'Operational Alert', 'Info',
    'No SLA rule defined for journey stage "Dispatch" on request ' || request_id || '.' FROM dwell WHERE journey_stage = 'Dispatch'""",
)
def sla_alerts(spark, d):
    """Candidates while the Dispatch stage has no rule."""
    rules = bulk.rules(spark).where(F.col("journey_stage") != "Dispatch")
    candidates = sla.sla_alert_candidates(sla.sla_evaluate(bulk.dwell(spark, d), rules))
    return candidates.select("id", "request_id", "alert_type", "severity", "message")


@query("sla_alerts_dedup", "SELECT id || '|2' AS id, request_id, journey_stage, severity FROM alerts WHERE lifecycle_state = 'Archived'")
def sla_alerts_dedup(spark, d):
    """Evaluating again raises only the alerts whose earlier copy was archived."""
    candidates = sla.sla_alert_candidates(_evaluated(spark, d))
    again = candidates.unionByName(candidates.withColumn("id", F.concat("id", F.lit("|again"))))
    return sla.dedup_alerts(again, bulk.alerts(spark, d)).select("id", "request_id", "journey_stage", "severity")


@query(
    "alert_reraise",
    """SELECT request_id, journey_stage, severity, CAST(1 + (lifecycle_state = 'Archived')::INT AS BIGINT) AS alerts,
    CAST(1 + (lifecycle_state = 'Archived')::INT AS BIGINT) AS ids, CAST(1 AS BIGINT) AS open_alerts FROM alerts""",
)
def alert_reraise(spark, d):
    """After another evaluation every breach and warning has one open alert, of its own id."""
    stored = bulk.alerts(spark, d)
    stage = F.get_json_object("metadata", "$.journeyStage").alias("journey_stage")
    new = sla.dedup_alerts(sla.sla_alert_candidates(_evaluated(spark, d)), stored)
    kept = ["id", "request_id", "severity", "lifecycle_state", stage]
    every = stored.select(*kept).unionByName(new.select(*kept))
    return every.groupBy("request_id", "journey_stage", "severity").agg(
        F.count(F.lit(1)).alias("alerts"),
        F.countDistinct("id").alias("ids"),
        F.count_if(F.col("lifecycle_state") != "Archived").alias("open_alerts"),
    )


@query(
    "breach_flags",
    f"""SELECT id, coalesce(assigned_department = 'Sales', false) OR sla_breached AS sla_breached,
    CASE WHEN sla_breached THEN {AS_OF_SQL} ELSE updated_at END AS updated_at FROM reqs""",
)
def breach_flags(spark, d):
    """Requests of one department start out flagged; the flag never goes back."""
    sales = F.coalesce(F.col("assigned_department") == "Sales", F.lit(False))
    before = bulk.requests(spark, d).withColumn("sla_breached", sales)
    return sla.apply_breach(before, _evaluated(spark, d), bulk.AS_OF).select("id", "sla_breached", "updated_at")


@query(
    "sla_rule_upsert",
    f"""SELECT coalesce(r.journey_stage, c.journey_stage) AS journey_stage, coalesce(c.t, r.threshold_hours) AS threshold_hours,
    c.t IS NOT NULL AS changed, c.at AS updated_at FROM rules r FULL JOIN
    (SELECT journey_stage, {rn('avg(elapsed_hours)', 2)} + CASE WHEN journey_stage = 'Delivery' THEN 1 ELSE 0 END AS t,
      max(occurred_at) + to_minutes(CASE WHEN journey_stage = 'Delivery' THEN 1 ELSE 0 END) AS at FROM dwell
      WHERE NOT is_open AND journey_stage NOT IN ('Inquiry', 'Completed', 'Cancelled') GROUP BY 1) c
    ON c.journey_stage = r.journey_stage""",
)
def sla_rule_upsert(spark, d):
    """New thresholds from the measured mean dwell; the one for Inquiry is out of range, Delivery's is changed twice."""
    measured = bulk.dwell(spark, d).where(~F.col("is_open")).groupBy("journey_stage").agg(
        r(F.avg("elapsed_hours"), 2).alias("threshold_hours"), F.max("occurred_at").alias("changed_at")
    )
    changes = measured.withColumn(
        "threshold_hours", F.when(F.col("journey_stage") == "Inquiry", F.lit(9000.0)).otherwise(F.col("threshold_hours"))
    )
    again = changes.where("journey_stage = 'Delivery'").select(
        "journey_stage", (F.col("threshold_hours") + 1).alias("threshold_hours"), F.timestamp_micros(F.unix_micros("changed_at") + 60_000_000).alias("changed_at")
    )
    return sla.upsert_rules(bulk.rules(spark), changes.unionByName(again)).select("journey_stage", "threshold_hours", "changed", "updated_at")


@query(
    "rule_seed",
    """SELECT journey_stage, coalesce(h.x, r.threshold_hours) AS threshold_hours, CASE WHEN h.x IS NULL THEN r.description END AS description
    FROM rules r FULL JOIN (SELECT journey_stage, CAST(least(count(*), 9999) AS DOUBLE) AS x FROM dwell
      WHERE department = 'Sales' AND journey_stage IN ('Inquiry', 'Dispatch', 'Completed') GROUP BY 1) h USING (journey_stage)""",
)
def rule_seed(spark, d):
    """Rules set from the traffic of three stages; the others get their defaults."""
    busy = bulk.dwell(spark, d).where((F.col("department") == "Sales") & F.col("journey_stage").isin("Inquiry", "Dispatch", "Completed"))
    held = busy.groupBy("journey_stage").agg(F.least(F.count(F.lit(1)), F.lit(9999)).cast("decimal(8,2)").alias("threshold_hours"))
    return sla.seed_rules(held.withColumn("description", F.lit(None).cast("string"))).select("journey_stage", "threshold_hours", "description")


@query(
    "request_states",
    f"""SELECT id AS request_id, current_stage, last_at AS entered_at, assigned_department, created_at, greatest(last_at, last_breach) AS updated_at,
    breached_at IS NOT NULL AS sla_breached, breached_at FROM reqs JOIN
    (SELECT o.request_id, max(o.occurred_at) AS last_at, min(e.due) AS breached_at, max(e.due) AS last_breach FROM ops o LEFT JOIN
      (SELECT id, entered_at + to_hours(CAST(threshold_hours AS BIGINT)) AS due FROM evald WHERE breached) e ON e.id = o.id GROUP BY 1) s ON s.request_id = reqs.id""",
)
def request_states(spark, d):
    return sla.request_states(bulk.ops_events(spark, d), bulk.rules(spark), bulk.AS_OF, bulk.hot_requests(spark, d))


@query(
    "alert_rows",
    """SELECT id, request_id, alert_type, severity, 'Created' AS lifecycle_state, message, created_at,
    false AS acknowledged, false AS archived FROM alerts""",
)
def alert_rows(spark, d):
    """Candidates as the alert sink stores them, whatever became of the alerts later."""
    kept = ("id", "request_id", "alert_type", "severity", "message", "metadata", "created_at")
    rows = create_alerts(bulk.alerts(spark, d).select(*kept))
    return rows.select(
        "id", "request_id", "alert_type", "severity", "lifecycle_state", "message", "created_at",
        F.col("acknowledged_at").isNotNull().alias("acknowledged"), F.col("archived_at").isNotNull().alias("archived"),
    )


@query(
    "sla_rules_list",
    """SELECT r.journey_stage, r.threshold_hours, r.description, CAST(count(q.id) AS BIGINT) AS active_count
    FROM rules r LEFT JOIN reqs q ON q.current_stage = r.journey_stage GROUP BY 1, 2, 3""",
)
def sla_rules_list(spark, d):
    return sla.list_rules(bulk.rules(spark), bulk.requests(spark, d))


_RATE = "CASE WHEN count(*) > 0 THEN (count(*)-sum(CAST(sla_breached AS INT)))/CAST(count(*) AS DOUBLE) ELSE 1.0 END"
_IN = f"created_at BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'"


def _sets(kind: str, label: str) -> str:
    return f"""SELECT '{kind}' AS kind, {label} AS label, CAST(count(*) AS BIGINT) AS total,
    CAST(sum(CAST(sla_breached AS INT)) AS BIGINT) AS breached, {r6(_RATE)} AS compliance_rate FROM reqs WHERE {_IN} GROUP BY 2"""


_BY_DEPT = _sets("department", "coalesce(assigned_department, 'Unassigned')")
_BY_STAGE = _sets("stage", "current_stage")


@query("compliance_sets", f"{_BY_DEPT} UNION ALL {_BY_STAGE}")
def compliance_sets(spark, d):
    df = sla.compliance(bulk.requests(spark, d), FROM, TO)
    return df.withColumn("compliance_rate", r("compliance_rate"))


@query("compliance_by_dept", f"SELECT label, total, breached, compliance_rate FROM ({_BY_DEPT})")
def compliance_by_dept(spark, d):
    return compliance_sets(spark, d).where(F.col("kind") == "department").drop("kind")


@query("compliance_by_stage", f"SELECT label, total, breached, compliance_rate FROM ({_BY_STAGE})")
def compliance_by_stage(spark, d):
    return compliance_sets(spark, d).where(F.col("kind") == "stage").drop("kind")


@query(
    "compliance_overall",
    f"""SELECT {r6('avg(rate)')} AS overall_rate, CAST(count(*) AS BIGINT) AS departments,
    {r6('(sum(total)-sum(breached))/CAST(sum(total) AS DOUBLE)')} AS weighted_rate, CAST(sum(total) AS BIGINT) AS records
    FROM (SELECT total, breached, (total-breached)/CAST(total AS DOUBLE) AS rate FROM ({_BY_DEPT}))""",
)
def compliance_overall(spark, d):
    df = sla.compliance_overall(bulk.requests(spark, d), FROM, TO)
    return df.withColumns({n: r(n) for n in ("overall_rate", "weighted_rate")})


@query("active_by_stage", "SELECT current_stage, CAST(count(*) AS BIGINT) AS active_count FROM reqs WHERE current_stage NOT IN ('Completed', 'Cancelled') GROUP BY 1")
def active_by_stage(spark, d):
    return sla.active_by_stage(bulk.requests(spark, d))


@query("active_requests", "SELECT id, current_stage, assigned_department, created_at FROM reqs WHERE current_stage NOT IN ('Completed', 'Cancelled')")
def active_requests(spark, d):
    return sla.active_requests(bulk.requests(spark, d)).select("id", "current_stage", "assigned_department", "created_at")


@query(
    "bottlenecks_heuristic",
    f"""SELECT journey_stage, department, {r6('threshold_hours*0.2e0')} AS avg_excess_hours, occurrence_count,
    CAST(row_number() OVER (ORDER BY threshold_hours*0.2e0 DESC, journey_stage) AS BIGINT) AS rank FROM
    (SELECT new_state AS journey_stage, CAST(count(*) AS BIGINT) AS occurrence_count,
      min_by(department, row(occurred_at, id)) AS department FROM ops WHERE department IS NOT NULL GROUP BY 1)
    JOIN rules USING (journey_stage) QUALIFY rank <= 5""",
)
def bottlenecks_heuristic(spark, d):
    df = sla.bottlenecks_heuristic(bulk.ops_events(spark, d), bulk.rules(spark), 5)
    return df.withColumn("avg_excess_hours", r("avg_excess_hours"))


@query(
    "bottlenecks_measured",
    f"""SELECT journey_stage, department, {r6('x')} AS avg_excess_hours, n AS occurrence_count,
    CAST(row_number() OVER (ORDER BY x DESC, journey_stage, department) AS BIGINT) AS rank FROM
    (SELECT journey_stage, department, avg(greatest(elapsed_hours-threshold_hours, 0.0)) AS x, CAST(count(*) AS BIGINT) AS n
     FROM evald WHERE breached AND department IS NOT NULL GROUP BY 1, 2) QUALIFY rank <= 10""",
)
def bottlenecks_measured(spark, d):
    df = sla.bottlenecks_measured(_evaluated(spark, d), 10)
    return df.withColumn("avg_excess_hours", r("avg_excess_hours"))


def _commands(spark, d):
    """Commands on every alert, some repeated, out of turn or unknown, by the alert's ``k``: six at most, so none is hot."""
    plan = [
        ("a", "acknowledge", 5.0, F.col("k") % 3 != 0), ("b", "resolve", 6.0, F.col("k") % 2 == 0),
        ("c", "archive", 7.0, F.lit(True)), ("d", "acknowledge", 4.5, F.col("k") % 5 == 0),
        ("e", "escalate", 8.0, F.col("k") % 7 == 0), ("f", "resolve", 9.0, F.lit(True)),
    ]
    items = F.array(
        *[F.struct(F.lit(c).alias("c"), F.lit(a).alias("action"), F.lit(h).alias("h"), t.alias("sent")) for c, a, h, t in plan]
    )
    rows = bulk.alerts(spark, d).select("id", "k", "created_at", F.explode(items).alias("p")).where("p.sent")
    return rows.select(
        F.concat_ws("|", "id", "p.c").alias("command_id"), F.col("id").alias("alert_id"), "p.action",
        F.lit("u2").alias("user_id"), plus_hours(F.col("created_at"), F.col("p.h")).alias("at"),
    )


@query(
    "alert_transitions",
    """, cmds AS (
      SELECT id, created_at, k, unnest([{'a': 'acknowledge', 'h': 270, 's': k%5 = 0}, {'a': 'acknowledge', 'h': 300, 's': k%3 <> 0},
        {'a': 'resolve', 'h': 360, 's': k%2 = 0}, {'a': 'archive', 'h': 420, 's': true}, {'a': 'escalate', 'h': 480, 's': k%7 = 0},
        {'a': 'resolve', 'h': 540, 's': true}]) AS c FROM alerts),
    lists AS (SELECT id, list({'a': c.a, 'h': c.h} ORDER BY c.h) AS cs FROM cmds WHERE c.s GROUP BY id),
    folded AS (SELECT a.*, list_reduce(
      list_prepend({'s': a.lifecycle_state, 'ack': -1, 'res': -1, 'arc': -1, 'bad': 0, 'a': '', 'h': 0},
        list_transform(cs, lambda c: {'s': '', 'ack': -1, 'res': -1, 'arc': -1, 'bad': 0, 'a': c.a, 'h': c.h})),
      lambda x, c: CASE WHEN c.a = 'acknowledge' AND x.s = 'Created' THEN {'s': 'Acknowledged', 'ack': c.h, 'res': x.res, 'arc': x.arc, 'bad': x.bad, 'a': '', 'h': 0}
        WHEN c.a = 'resolve' AND x.s = 'Acknowledged' THEN {'s': 'Resolved', 'ack': x.ack, 'res': c.h, 'arc': x.arc, 'bad': x.bad, 'a': '', 'h': 0}
        WHEN c.a = 'archive' AND x.s = 'Resolved' THEN {'s': 'Archived', 'ack': x.ack, 'res': x.res, 'arc': c.h, 'bad': x.bad, 'a': '', 'h': 0}
        ELSE {'s': x.s, 'ack': x.ack, 'res': x.res, 'arc': x.arc, 'bad': x.bad+1, 'a': '', 'h': 0} END) AS f
      FROM alerts a JOIN lists USING (id))
    SELECT id, f.s AS lifecycle_state,
      CASE WHEN f.ack >= 0 THEN created_at + to_minutes(f.ack) ELSE acknowledged_at END AS acknowledged_at,
      CASE WHEN f.res >= 0 THEN created_at + to_minutes(f.res) ELSE resolved_at END AS resolved_at,
      CASE WHEN f.arc >= 0 THEN created_at + to_minutes(f.arc) ELSE archived_at END AS archived_at,
      CAST(f.bad AS BIGINT) AS rejected FROM folded""",
)
def alert_transitions(spark, d):
    after, rejects = lifecycle.apply_transitions(bulk.alerts(spark, d), _commands(spark, d), hot={})
    refused = rejects.groupBy(F.col("alert_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    return after.join(refused, "id", "left").select(
        "id", "lifecycle_state", "acknowledged_at", "resolved_at", "archived_at", F.coalesce("_n", F.lit(0)).alias("rejected")
    )


@query(
    "alert_rejects",
    """, cmds AS (
      SELECT id, created_at, k, unnest([{'a': 'acknowledge', 'h': 270, 's': k%5 = 0, 'c': 'd'}, {'a': 'acknowledge', 'h': 300, 's': k%3 <> 0, 'c': 'a'},
        {'a': 'resolve', 'h': 360, 's': k%2 = 0, 'c': 'b'}, {'a': 'archive', 'h': 420, 's': true, 'c': 'c'}, {'a': 'escalate', 'h': 480, 's': k%7 = 0, 'c': 'e'},
        {'a': 'resolve', 'h': 540, 's': true, 'c': 'f'}]) AS c, lifecycle_state AS s0 FROM alerts),
    st AS (SELECT id, c.c AS c, c.a AS a, c.h AS h, s0, k, (k%3 <> 0 OR k%5 = 0) AS acks FROM cmds WHERE c.s),
    s1 AS (SELECT *, CASE WHEN s0 = 'Created' AND acks THEN CASE WHEN k%5 = 0 THEN 270 ELSE 300 END END AS ack_h FROM st),
    s2 AS (SELECT *, CASE WHEN s0 = 'Acknowledged' OR ack_h IS NOT NULL THEN CASE WHEN k%2 = 0 THEN 360 ELSE 540 END END AS res_h FROM s1),
    s3 AS (SELECT *, CASE WHEN s0 = 'Resolved' OR res_h = 360 THEN 420 END AS arc_h FROM s2),
    s4 AS (SELECT *, CASE WHEN arc_h < h THEN 'Archived' WHEN res_h < h THEN 'Resolved' WHEN ack_h < h THEN 'Acknowledged' ELSE s0 END AS cur FROM s3
      WHERE NOT (coalesce(a = 'acknowledge' AND h = ack_h, false) OR coalesce(a = 'resolve' AND h = res_h, false) OR coalesce(a = 'archive' AND h = arc_h, false)))
    SELECT id || '|' || c AS command_id, cur AS current_state, CASE WHEN a = 'escalate' THEN 'Action must be acknowledge, resolve, or archive'
      ELSE 'Invalid transition: ''' || cur || ''' → ''' || CASE a WHEN 'acknowledge' THEN 'Acknowledged' WHEN 'resolve' THEN 'Resolved' ELSE 'Archived' END
      || '''. Allowed next state is ''' || CASE cur WHEN 'Created' THEN 'Acknowledged' WHEN 'Acknowledged' THEN 'Resolved' WHEN 'Resolved' THEN 'Archived' ELSE 'none (terminal)' END || '''.' END AS reason FROM s4""",
)
def alert_rejects(spark, d):
    _, rejects = lifecycle.apply_transitions(bulk.alerts(spark, d), _commands(spark, d), hot={})
    return rejects.select("command_id", "current_state", "reason")


@query(
    "request_patch",
    """, ch AS (SELECT request_id, max({'t': occurred_at, 'i': id, 'v': 'Contacted ' || CAST(k AS VARCHAR)}) FILTER (WHERE event_type = 'click') AS st,
      max({'t': occurred_at, 'i': id, 'v': coalesce(department, '-')}) FILTER (WHERE event_type IN ('view', 'signup')) AS dp,
      max({'t': occurred_at, 'i': id, 'v': metadata}) FILTER (WHERE event_type = 'error') AS md,
      max(occurred_at) + INTERVAL 1 MINUTE AS at FROM ev WHERE event_type <> 'purchase' GROUP BY 1)
    SELECT r.id, r.request_number, r.current_stage, coalesce(ch.st.v, r.current_status) AS current_status,
      CASE WHEN ch.dp IS NOT NULL THEN nullif(ch.dp.v, '-') ELSE r.assigned_department END AS assigned_department,
      ch.md.v AS metadata, coalesce(ch.at, r.updated_at) AS updated_at FROM reqs r LEFT JOIN ch ON ch.request_id = r.id""",
)
def request_patch(spark, d):
    """Events as patches: clicks set the status, views and signups the department (or clear it)."""
    kind = F.col("event_type")
    fields = (
        F.when(kind == "click", F.array(F.lit("current_status")))
        .when(kind.isin("view", "signup"), F.array(F.lit("assigned_department")))
        .otherwise(F.array(F.lit("metadata")))
    )
    patches = bulk.plain_events(spark, d).where(kind != "purchase").select(
        "request_id", F.col("id").alias("patch_id"),
        plus_hours(F.col("occurred_at"), F.lit(1 / 60)).alias("at"), fields.alias("fields"),
        F.when(kind == "click", F.concat(F.lit("Contacted "), F.col("k").cast("string"))).alias("current_status"),
        F.col("department").alias("assigned_department"), "metadata",
    )
    return lifecycle.apply_patches(bulk.requests(spark, d), patches).select(
        "id", "request_number", "current_stage", "current_status", "assigned_department", "metadata", "updated_at"
    )


@query(
    "request_numbers",
    """SELECT o_orderkey, 'SR-' || CAST(year(o_orderdate) AS VARCHAR) || '-' || lpad(CAST(n AS VARCHAR), CAST(greatest(5, length(CAST(n AS VARCHAR))) AS INT), '0') AS request_number
    FROM (SELECT o.*, coalesce(c.taken, 0) + row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) AS n
      FROM orders o LEFT JOIN (SELECT count(*) AS taken FROM reqs) c ON year(o.o_orderdate) = 2000)""",
)
def request_numbers(spark, d):
    """Orders become new requests; the year 2000 already has as many numbers as there are requests."""
    new = bulk.table(spark, d, "orders").select(
        F.col("o_orderkey"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created_at")
    )
    taken = bulk.requests(spark, d).select(F.regexp_replace("request_number", "SR-2024", "SR-2000").alias("request_number"))
    return lifecycle.assign_request_numbers(new, taken).select("o_orderkey", "request_number")


@query(
    "new_requests",
    """SELECT o_orderkey, 'Inquiry' AS current_stage, 'Open' AS current_status, false AS sla_breached, o_orderdate AS created_at, o_orderdate AS updated_at,
    'SR-' || CAST(year(o_orderdate) AS VARCHAR) || '-' || lpad(CAST(n AS VARCHAR), CAST(greatest(5, length(CAST(n AS VARCHAR))) AS INT), '0') AS request_number
    FROM (SELECT *, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) AS n FROM orders)""",
)
def new_requests(spark, d):
    new = bulk.table(spark, d, "orders").select(
        F.col("o_orderkey"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created_at")
    )
    none = bulk.requests(spark, d).where(F.lit(False)).select("request_number")
    created = lifecycle.create_requests(new, none)
    return created.select(
        "o_orderkey", "current_stage", "current_status", "sla_breached", "created_at", "updated_at", "request_number"
    )
