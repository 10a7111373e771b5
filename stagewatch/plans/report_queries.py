"""Queries over KPIs, trends, snapshots, listings and display text."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from stagewatch import schema as S
from stagewatch.functions import ladders, text
from stagewatch.functions.numbers import half_up
from stagewatch.operators import analytics, listing
from stagewatch.plans.catalog import AS_OF_SQL, fixed, hours, query, r6, rn
from stagewatch.sources import bulk

FROM, TO = datetime(2024, 1, 1), datetime(2024, 1, 31)


def r(column, digits: int = 6):
    return half_up(F.col(column) if isinstance(column, str) else column, digits)


def _kpis(where: str = "true") -> str:
    return f"""SELECT coalesce(avg({hours('created_at', 'updated_at')}) FILTER (WHERE current_stage = 'Completed'), 0.0) AS avg_completion_time,
    (count(*)-count(*) FILTER (WHERE sla_breached))/CAST(count(*) AS DOUBLE) AS sla_compliance_rate,
    count(*) FILTER (WHERE created_at >= {AS_OF_SQL} - INTERVAL 30 DAY)/30.0e0 AS request_throughput,
    count(*) FILTER (WHERE sla_breached AND created_at >= {AS_OF_SQL} - INTERVAL 30 DAY)/30.0e0 AS delay_frequency,
    count(*) FILTER (WHERE current_stage = 'Completed')/CAST(count(*) AS DOUBLE) AS completion_rate FROM reqs WHERE {where}"""


_DEPT = f"""SELECT department, CASE WHEN count(*) >= 2 THEN {hours('min(occurred_at)', 'max(occurred_at)')}/(count(*)-1) ELSE 0.0 END AS avg_hours,
    CAST(count(*) AS BIGINT) AS event_count FROM ev WHERE department IS NOT NULL GROUP BY 1"""
_KEYS = analytics.KPI_KEYS


@query(
    "kpi_overview",
    f"""SELECT {', '.join(f'{r6(k)} AS {k}' for k in _KEYS)}, false AS is_stale, {AS_OF_SQL} AS computed_at,
    (SELECT string_agg(department || '=' || {fixed('avg_hours', 4)}, ',' ORDER BY department) FROM ({_DEPT})) AS departments FROM ({_kpis()})""",
)
def kpi_overview(spark, d):
    df = analytics.dashboard_overview(bulk.requests(spark, d), bulk.plain_events(spark, d), bulk.AS_OF)
    pairs = F.transform(
        F.map_entries("avg_department_processing_time"),
        lambda e: F.concat(e["key"], F.lit("="), text.fixed_text(e["value"], 4)),
    )
    return df.select(
        *[r(k).alias(k) for k in _KEYS], "is_stale", "computed_at", F.array_join(pairs, ",").alias("departments")
    )


@query("dept_processing_time", f"SELECT department, {r6('avg_hours')} AS avg_hours, event_count FROM ({_DEPT})")
def dept_processing_time(spark, d):
    return analytics.dept_processing_time(bulk.plain_events(spark, d)).withColumn("avg_hours", r("avg_hours"))


@query(
    "department_efficiency",
    f"""SELECT department, {r6('avg_hours')} AS avg_processing_time_hours,
    CAST((SELECT count(*) FROM rules q WHERE t.avg_hours > q.threshold_hours) AS BIGINT) AS bottleneck_frequency,
    (SELECT {r6('sla_compliance_rate')} FROM ({_kpis()})) AS sla_compliance_rate FROM ({_DEPT}) t""",
)
def department_efficiency(spark, d):
    df = analytics.department_efficiency(bulk.plain_events(spark, d), bulk.requests(spark, d), bulk.rules(spark), bulk.AS_OF)
    return df.withColumns({n: r(n) for n in ("avg_processing_time_hours", "sla_compliance_rate")})


@query(
    "team_efficiency",
    f"""SELECT department, {r6('avg_hours')} AS avg_processing_time_hours,
    CAST((SELECT count(*) FROM rules q WHERE t.avg_hours > q.threshold_hours) AS BIGINT) AS bottleneck_frequency
    FROM (SELECT request_id || '/' || department AS department, {hours('min(occurred_at)', 'max(occurred_at)')}/(count(*)-1) AS avg_hours
      FROM ev WHERE department IS NOT NULL GROUP BY 1 HAVING count(*) >= 2) t""",
)
def team_efficiency(spark, d):
    """The same figures per request and department, where the means do exceed thresholds."""
    events = bulk.plain_events(spark, d).withColumn("department", F.concat("request_id", F.lit("/"), "department"))
    df = analytics.department_efficiency(events, bulk.requests(spark, d), bulk.rules(spark), bulk.AS_OF)
    many = analytics.dept_processing_time(events).where(F.col("event_count") >= 2).select("department")
    return df.join(many, "department", "left_semi").select(
        "department", r("avg_processing_time_hours").alias("avg_processing_time_hours"), "bottleneck_frequency"
    )


@query(
    "compliance_today",
    f"""SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE sla_breached) AS BIGINT) AS breached,
    {rn('(count(*)-count(*) FILTER (WHERE sla_breached))/CAST(count(*) AS DOUBLE)*100', 1)} AS compliance_percent FROM reqs""",
)
def compliance_today(spark, d):
    return analytics.compliance_today(bulk.requests(spark, d))


@query("delay_by_department", "SELECT assigned_department AS department, CAST(count(*) AS BIGINT) AS breached_count FROM reqs WHERE sla_breached AND assigned_department IS NOT NULL GROUP BY 1")
def delay_by_department(spark, d):
    return analytics.breaches_by_department(bulk.requests(spark, d))


_TREND = f"""(SELECT date_trunc('day', created_at)::TIMESTAMP AS day, CAST(count(*) AS BIGINT) AS volume, CAST(count(*) FILTER (WHERE sla_breached) AS BIGINT) AS breached
    FROM reqs WHERE created_at BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}' GROUP BY 1)"""


@query("volume_trend", f"SELECT day, volume FROM {_TREND}")
def volume_trend(spark, d):
    return analytics.volume_trend(bulk.requests(spark, d), FROM, TO)


@query("sla_trend", f"SELECT day, breached, {r6('(volume-breached)/CAST(volume AS DOUBLE)')} AS compliance_rate FROM {_TREND}")
def sla_trend(spark, d):
    return analytics.sla_trend(bulk.requests(spark, d), FROM, TO).withColumn("compliance_rate", r("compliance_rate"))


@query("trend_chart", f"SELECT day, volume, {rn('(volume-breached)/CAST(volume AS DOUBLE)*100', 1)} AS sla_percent FROM {_TREND}")
def trend_chart(spark, d):
    return analytics.trend_chart(bulk.requests(spark, d), FROM, TO)


_MONTH = analytics.period_bounds("Monthly", FROM)
_SPAN = f"BETWEEN TIMESTAMP '{_MONTH[0]}' AND TIMESTAMP '{_MONTH[1]}'"


@query(
    "kpi_snapshot_rows",
    f"""SELECT 'Monthly' AS snapshot_type, TIMESTAMP '{_MONTH[0]}' AS period_start, TIMESTAMP '{_MONTH[1]}' AS period_end, department, kpi_key, {rn('v', 4)} AS kpi_value
    FROM (SELECT NULL AS department, unnest({_KEYS}) AS kpi_key, unnest([{', '.join(_KEYS)}]) AS v FROM ({_kpis('created_at ' + _SPAN)})
      UNION ALL SELECT department, 'avg_dept_processing_time', avg_hours FROM ({_DEPT}))""",
)
def kpi_snapshot_rows(spark, d):
    df = analytics.snapshot_rows(bulk.requests(spark, d), bulk.plain_events(spark, d), "Monthly", *_MONTH, bulk.AS_OF)
    return df.drop("journey_stage")


def _periods(kind: str) -> str:
    unit = analytics.PERIOD_UNITS[kind].lower()
    return f"""SELECT CAST(date_trunc('{unit}', created_at) AS TIMESTAMP) AS period_start, '{kind}' AS snapshot_type, CAST(count(*) AS BIGINT) AS requests,
    CAST(count(*) FILTER (WHERE sla_breached) AS BIGINT) AS breached, (count(*)-count(*) FILTER (WHERE sla_breached))/CAST(count(*) AS DOUBLE) AS sla_compliance_rate,
    coalesce(avg({hours('created_at', 'updated_at')}) FILTER (WHERE current_stage = 'Completed'), 0.0) AS avg_completion_time,
    count(*) FILTER (WHERE current_stage = 'Completed')/CAST(count(*) AS DOUBLE) AS completion_rate FROM reqs GROUP BY 1"""


_ALL_PERIODS = " UNION ALL ".join(f"({_periods(k)})" for k in S.SNAPSHOT_TYPES)
_RATES = ["sla_compliance_rate", "avg_completion_time", "completion_rate"]


@query(
    "snapshot_periods",
    f"SELECT period_start, snapshot_type, requests, breached, {', '.join(f'{r6(k)} AS {k}' for k in _RATES)} FROM ({_ALL_PERIODS})",
)
def snapshot_periods(spark, d):
    """All four kinds of period."""
    whole = analytics.snapshot_all_periods(bulk.requests(spark, d))
    return whole.withColumns({k: r(k) for k in _RATES})


@query(
    "snapshot_reports",
    f"""SELECT snapshot_type, period_start, kpi_key, {rn('v', 4)} AS kpi_value FROM
    (SELECT snapshot_type, period_start, unnest({_RATES}) AS kpi_key, unnest([{', '.join(_RATES)}]) AS v FROM ({_periods('Weekly')}))
    WHERE period_start BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-31' ORDER BY period_start DESC, kpi_key LIMIT 20""",
)
def snapshot_reports(spark, d):
    rows = analytics.snapshot_series(bulk.requests(spark, d), "Weekly")
    found = analytics.list_reports(rows, "Weekly", datetime(2024, 1, 8), datetime(2024, 1, 31))
    page = listing.paginate(found, [F.desc("period_start"), F.asc("kpi_key")], 1, 20)
    return page.select("snapshot_type", "period_start", "kpi_key", "kpi_value")


# --- listings -------------------------------------------------------------------------------

_EVENT = ["id", "request_id", "event_type", "source_system", "department", "occurred_at"]


@query(
    "events_filtered",
    f"""SELECT {', '.join(_EVENT)} FROM ev WHERE department = 'Finance' AND event_type = 'purchase'
    AND occurred_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'""",
)
def events_filtered(spark, d):
    found = listing.filter_events(
        bulk.plain_events(spark, d), department="Finance", event_type="purchase",
        start="2024-01-05T00:00:00Z", end="2024-01-20T12:00:00Z",
    )
    return found.select(*_EVENT)


@query(
    "events_page",
    f"SELECT {', '.join(_EVENT)} FROM ev WHERE event_type = 'click' ORDER BY occurred_at DESC, id LIMIT 20 OFFSET 40",
)
def events_page(spark, d):
    return listing.list_events(bulk.plain_events(spark, d), 3, 20, event_type="click", start="not a date").select(*_EVENT)


@query(
    "events_page_totals",
    "SELECT CAST(count(*) AS BIGINT) AS total, CAST(greatest(1, ceil(count(*)/20.0)) AS BIGINT) AS pages FROM ev WHERE event_type = 'click'",
)
def events_page_totals(spark, d):
    return listing.page_totals(listing.filter_events(bulk.plain_events(spark, d), event_type="click"), 20)


_REQUEST = ["id", "request_number", "current_stage", "current_status", "assigned_department", "sla_breached", "created_at"]


@query(
    "requests_page",
    f"SELECT {', '.join(_REQUEST)} FROM reqs WHERE assigned_department = 'Engineering' ORDER BY created_at, id LIMIT 100 OFFSET 0",
)
def requests_page(spark, d):
    return listing.list_requests(bulk.requests(spark, d), "Sales Engineer", "Engineering", 0, 500).select(*_REQUEST)


@query(
    "requests_by_stage",
    f"SELECT {', '.join(_REQUEST)} FROM reqs WHERE assigned_department = 'Sales' AND current_stage = 'Quotation' AND current_status = 'Open'",
)
def requests_by_stage(spark, d):
    return listing.filter_requests(bulk.requests(spark, d), "Sales", "Quotation", "Open").select(*_REQUEST)


@query(
    "requests_search",
    """SELECT id, request_number, c_name AS customer_name FROM reqs LEFT JOIN customer ON c_custkey = user_id
    WHERE contains(lower(request_number), 'r#0000000') OR contains(lower(c_name), 'r#0000000')""",
)
def requests_search(spark, d):
    named = bulk.with_customer(bulk.requests(spark, d), spark, d)
    return listing.search_requests(named, "R#0000000").select("id", "request_number", "customer_name")


@query(
    "requests_search_indexed",
    """SELECT text, id, request_number, c_name AS customer_name FROM reqs LEFT JOIN customer ON c_custkey = user_id,
    (VALUES ('R#0000000'), ('00080'), ('#0'), ('no such text')) q(text)
    WHERE contains(lower(request_number), lower(text)) OR contains(lower(c_name), lower(text))""",
)
def requests_search_indexed(spark, d):
    """Searches by postings: by customer, by number, by a text too short for a posting, and for nothing."""
    named = bulk.with_customer(bulk.requests(spark, d), spark, d)
    index = listing.search_index(named)
    found = [
        listing.search_by_index(named, index, text).select(F.lit(text).alias("text"), "id", "request_number", "customer_name")
        for text in ("R#0000000", "00080", "#0", "no such text")
    ]
    return reduce(DataFrame.unionByName, found)


@query(
    "events_page_after",
    """SELECT id, request_id, occurred_at, CAST((n-1)//40 + 1 AS BIGINT) AS page FROM
    (SELECT *, row_number() OVER (ORDER BY occurred_at DESC, id) AS n FROM ev WHERE event_type = 'click') WHERE n <= 120""",
)
def events_page_after(spark, d):
    """Three pages of the click events, each from the last row of the one before."""
    rows = listing.filter_events(bulk.plain_events(spark, d), event_type="click")
    last, pages = None, []
    for number in (1, 2, 3):
        page = listing.page_after(rows, 40, last).select("id", "request_id", "occurred_at", F.lit(number).cast("bigint").alias("page"))
        pages.append(page)
        end = page.orderBy("occurred_at", F.desc("id")).first()
        last = (end["occurred_at"], end["id"]) if end else last
    return reduce(DataFrame.unionByName, pages)


@query(
    "request_lookup",
    f"SELECT {', '.join(_REQUEST)} FROM reqs WHERE request_number = 'SR-2024-000000000804'",
)
def request_lookup(spark, d):
    return listing.get_request(bulk.requests(spark, d), "SR-2024-000000000804").select(*_REQUEST)


@query(
    "scoped_requests",
    """SELECT 'Administrator' AS role, CAST(count(*) AS BIGINT) AS visible, max(created_at) AS newest FROM reqs
    UNION ALL SELECT 'Logistics Officer', CAST(count(*) AS BIGINT), max(created_at) FROM reqs WHERE assigned_department = 'Logistics'
    UNION ALL SELECT 'Backend Designer', 0, NULL""",
)
def scoped_requests(spark, d):
    """What three viewers see; the last one has no department."""
    requests = bulk.requests(spark, d).select("assigned_department", "created_at")
    whole = None
    for role, department in (("Administrator", None), ("Logistics Officer", "Logistics"), ("Backend Designer", None)):
        seen = listing.scope_requests(requests, role, department).agg(
            F.count(F.lit(1)).alias("visible"), F.max("created_at").alias("newest")
        ).select(F.lit(role).alias("role"), "visible", "newest")
        whole = seen if whole is None else whole.unionByName(seen)
    return whole


@query(
    "delayed_requests",
    "SELECT id, request_number, current_stage, updated_at FROM reqs WHERE sla_breached ORDER BY updated_at DESC, id LIMIT 50",
)
def delayed_requests(spark, d):
    return listing.delayed_requests(bulk.requests(spark, d)).select("id", "request_number", "current_stage", "updated_at")


_ALERT = ["id", "request_id", "alert_type", "severity", "lifecycle_state", "created_at"]


@query(
    "alerts_filtered",
    f"""SELECT {', '.join(_ALERT)} FROM alerts WHERE severity = 'Critical' AND alert_type = 'SLA Breach Alert' AND lifecycle_state = 'Acknowledged'
    AND created_at >= TIMESTAMP '2024-01-05'""",
)
def alerts_filtered(spark, d):
    found = listing.filter_alerts(
        bulk.alerts(spark, d), "Critical", S.SLA_BREACH, "Acknowledged", start="2024-01-05T00:00:00Z"
    )
    return found.select(*_ALERT)


@query("alerts_page", f"SELECT {', '.join(_ALERT)} FROM alerts WHERE severity = 'Warning' ORDER BY created_at DESC, id LIMIT 20 OFFSET 20")
def alerts_page(spark, d):
    return listing.list_alerts(bulk.alerts(spark, d), 2, 20, severity="Warning").select(*_ALERT)


@query("recent_alerts", f"SELECT {', '.join(_ALERT)} FROM alerts WHERE lifecycle_state = 'Created' ORDER BY created_at DESC, id LIMIT 5")
def recent_alerts(spark, d):
    return listing.recent_alerts(bulk.alerts(spark, d)).select(*_ALERT)


@query(
    "critical_alerts",
    """SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE alert_type = 'SLA Breach Alert') AS BIGINT) AS sla_breach,
    CAST(count(*) FILTER (WHERE alert_type = 'Critical Delay Alert') AS BIGINT) AS critical_delay FROM alerts
    WHERE severity = 'Critical' AND lifecycle_state = 'Created'""",
)
def critical_alerts(spark, d):
    return listing.critical_alerts(bulk.alerts(spark, d))


_MATRIX = ", ".join(f"('{role}', '{p}')" for p, roles in S.PERMISSION_ROLES.items() for role in roles)


@query("role_permissions", f"SELECT u.id, u.role, m.permission FROM usr u JOIN (VALUES {_MATRIX}) m(role, permission) USING (role)")
def role_permissions(spark, d):
    return listing.user_permissions(bulk.users(spark, d)).select("id", "role", "permission")


@query("users_allowed", "SELECT id, role FROM usr WHERE role IN ('Administrator', 'Sales Engineer')")
def users_allowed(spark, d):
    return listing.require(bulk.users(spark, d), "create:service_request").select("id", "role")


@query(
    "stage_progress",
    f"""SELECT id, CAST(p AS BIGINT) AS place, stages[p+1] AS stage, CASE WHEN p < here THEN 'done' WHEN p = here THEN 'active' ELSE 'pending' END AS state
    FROM (SELECT id, {S.PROGRESS_STAGES} AS stages, list_position({S.PROGRESS_STAGES}, current_stage)-1 AS here, unnest(range(8)) AS p FROM reqs)""",
)
def stage_progress(spark, d):
    return listing.stage_progress(bulk.requests(spark, d))


# --- display text ---------------------------------------------------------------------------


@query(
    "fmt_hours",
    f"""SELECT request_id, id AS event_id, CASE WHEN h IS NULL THEN '—' WHEN h < 1 THEN CAST(CAST(floor(h*60+0.5e0) AS BIGINT) AS VARCHAR) || 'm'
    WHEN h < 24 THEN {fixed('h', 1)} || 'h' ELSE {fixed('h/24', 1)} || 'd' END AS duration
    FROM (SELECT request_id, id, CASE WHEN NOT is_open THEN elapsed_hours END AS h FROM dwell)""",
)
def fmt_hours(spark, d):
    closed = F.when(~F.col("is_open"), F.col("elapsed_hours"))
    return bulk.dwell(spark, d).select("request_id", F.col("id").alias("event_id"), text.fmt_hours(closed).alias("duration"))


@query(
    "text_format",
    """SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y, %H:%M') AS full_date, strftime(o_orderdate, '%d %b %Y') AS short_date,
    CASE WHEN length(label) > 9 THEN substr(label, 1, 9) || '…' ELSE label END AS cut_label,
    upper(substr(split_part(label, ' ', 1), 1, 1) || substr(split_part(label, ' ', 2), 1, 1)) AS initials,
    replace(code, '_', ' ') AS words FROM (SELECT o_orderkey, o_orderdate,
      o_orderpriority AS label, 'order_' || lower(o_orderstatus) || '_set' AS code FROM orders)"""
    .replace("strftime(o_orderdate, '%d %b %Y, %H:%M')", "replace(strftime(o_orderdate, '%d %b %Y, %H:%M'), ' Sep ', ' Sept ')")
    .replace("strftime(o_orderdate, '%d %b %Y')", "replace(strftime(o_orderdate, '%d %b %Y'), ' Sep ', ' Sept ')"),
)
def text_format(spark, d):
    at, label = F.col("o_orderdate").cast("timestamp"), F.col("o_orderpriority")
    code = F.concat(F.lit("order_"), F.lower("o_orderstatus"), F.lit("_set"))
    return bulk.table(spark, d, "orders").select(
        "o_orderkey", text.fmt_date(at).alias("full_date"), text.fmt_date_short(at).alias("short_date"),
        text.truncate(label, 9).alias("cut_label"), text.initials(label).alias("initials"), text.words(code).alias("words"),
    )


@query(
    "compliance_band",
    f"""SELECT day, CASE WHEN rate >= 0.85 THEN 'good' WHEN rate >= 0.65 THEN 'ok' ELSE 'bad' END AS band,
    CASE WHEN rate >= 0.9 THEN 'good' WHEN rate >= 0.7 THEN 'ok' ELSE 'bad' END AS strict_band, {fixed('rate*100', 1)} || '%' AS percent
    FROM (SELECT day, (volume-breached)/CAST(volume AS DOUBLE) AS rate FROM {_TREND})""",
)
def compliance_band(spark, d):
    rate = F.col("compliance_rate")
    return analytics.trends(bulk.requests(spark, d), FROM, TO).select(
        "day", ladders.compliance_band(rate).alias("band"),
        ladders.compliance_band(rate, 0.9, 0.7).alias("strict_band"), text.percent(rate).alias("percent"),
    )
