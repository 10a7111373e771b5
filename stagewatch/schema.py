"""Domain vocabulary and declared table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Enumerations of the domain, in their declared order.
# ---------------------------------------------------------------------------
STAGES = [
    "Inquiry",
    "Sales Review",
    "Engineering Design",
    "Quotation",
    "Approval",
    "Dispatch",
    "Delivery",
    "Completed",
    "Cancelled",
]
TERMINAL_STAGES = ["Completed", "Cancelled"]
ACTIVE_STAGES = STAGES[:7]
PROGRESS_STAGES = STAGES[:8]

ROLES = [
    "Administrator",
    "Regional Manager",
    "Sales Engineer",
    "Backend Designer",
    "Logistics Officer",
]
UNSCOPED_ROLES = ["Administrator", "Regional Manager"]

SEVERITIES = ["Info", "Warning", "Critical"]
ALERT_TYPES = [
    "Operational Alert",
    "SLA Breach Alert",
    "Critical Delay Alert",
    "Escalation Alert",
]
OPERATIONAL, SLA_BREACH, CRITICAL_DELAY, ESCALATION = ALERT_TYPES

SOURCES = [
    "CRM",
    "ERP",
    "Engineering Software",
    "Quotation System",
    "Logistics Platform",
    "Manual",
]
DEFAULT_SOURCE = "Manual"

SNAPSHOT_TYPES = ["Daily", "Weekly", "Monthly", "Quarterly"]

PIPELINE_STEPS = [
    "timeline-update",
    "sla-evaluate",
    "alert-generate",
    "realtime-broadcast",
    "analytics-update",
]

# Alert lifecycle: command -> (state it needs, state it leads to).
LIFECYCLE = ["Created", "Acknowledged", "Resolved", "Archived"]
ALERT_COMMANDS = {
    "acknowledge": ("Created", "Acknowledged"),
    "resolve": ("Acknowledged", "Resolved"),
    "archive": ("Resolved", "Archived"),
}

# Default SLA thresholds in hours and their descriptions.
SLA_SEED = [
    ("Inquiry", "24.00", "Initial customer inquiry must be acknowledged within 24 hours"),
    ("Sales Review", "48.00", "Sales team review and qualification within 48 hours"),
    ("Engineering Design", "72.00", "Engineering assessment and design scoping within 72 hours"),
    ("Quotation", "48.00", "Quotation preparation and delivery to customer within 48 hours"),
    ("Approval", "24.00", "Internal approval of quotation and work order within 24 hours"),
    ("Dispatch", "48.00", "Equipment and team dispatch coordination within 48 hours"),
    ("Delivery", "96.00", "On-site delivery and installation completion within 96 hours"),
]
MAX_THRESHOLD_HOURS = 8760

# Canonical event fields kept by ingestion.
CANONICAL_FIELDS = [
    "id",
    "requestId",
    "eventType",
    "sourceSystem",
    "department",
    "triggeredByUserId",
    "previousState",
    "newState",
    "metadata",
    "occurredAt",
    "receivedAt",
    "pipelineStatus",
    "failedSteps",
]

# Other spellings accepted for a canonical field, in order of preference.
FIELD_ALIASES = {
    "id": ["event_id"],
    "requestId": ["request_id"],
    "eventType": ["event_type"],
    "sourceSystem": ["source_system"],
    "triggeredByUserId": ["triggered_by_user_id", "triggered_by"],
    "previousState": ["previous_state"],
    "newState": ["new_state"],
}

# Permission matrix: permission -> roles that hold it.
PERMISSION_ROLES = {
    "create:service_request": ["Administrator", "Sales Engineer"],
    "view:all_requests": ["Administrator", "Regional Manager"],
    "view:dept_requests": ROLES,
    "manage:sla_rules": ["Administrator"],
    "view:dashboard:executive": ["Administrator", "Regional Manager"],
    "view:dashboard:operations": ROLES,
    "view:dashboard:analytics": ["Administrator", "Regional Manager"],
    "view:dashboard:ai": ["Administrator"],
    "manage:alerts": ROLES,
    "initiate:archival": ["Administrator"],
    "use:ai_copilot": ["Administrator", "Regional Manager"],
    "manage:users": ["Administrator"],
}

# Limits and cut points.
MAX_PAYLOAD_BYTES = 1_048_576
MAX_TEXT = 255
WARNING_SHARE = 0.8
BREACH_SHARE = 1.0
REPLAY_TTL_HOURS = 24
DEFAULT_HISTORY_HOURS = 72.0
RISK_BOUNDS = [(0.75, "Critical"), (0.50, "High"), (0.25, "Medium")]
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ISO_UTC_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"


def _table(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in columns])


_S, _TS, _B, _I = T.StringType(), T.TimestampType(), T.BooleanType(), T.IntegerType()
_NAMES = T.ArrayType(_S)

FACTOR = T.StructType([T.StructField("factor", _S), T.StructField("influence", T.DoubleType())])

TABLES: dict[str, T.StructType] = {
    "service_requests": _table(
        ("id", _S, False), ("request_number", _S, False), ("customer_name", _S, False),
        ("customer_contact", _S, True), ("request_type", _S, False), ("current_stage", _S, False),
        ("current_status", _S, False), ("assigned_department", _S, True),
        ("assigned_user_id", _S, True), ("metadata", _S, True), ("sla_breached", _B, False),
        ("created_at", _TS, False), ("updated_at", _TS, False),
    ),
    "events": _table(
        ("id", _S, False), ("request_id", _S, False), ("event_type", _S, False),
        ("source_system", _S, False), ("department", _S, True), ("triggered_by_user", _S, True),
        ("previous_state", _S, True), ("new_state", _S, True), ("metadata", _S, True),
        ("occurred_at", _TS, False), ("received_at", _TS, False),
        ("pipeline_status", _S, False), ("failed_steps", _NAMES, True),
    ),
    "timelines": _table(
        ("request_id", _S, False), ("event_id", _S, False), ("position", T.LongType(), False),
        ("appended_at", _TS, False),
    ),
    "sla_rules": _table(
        ("journey_stage", _S, False), ("threshold_hours", T.DecimalType(8, 2), False),
        ("description", _S, True), ("created_at", _TS, True), ("updated_at", _TS, True),
    ),
    "alerts": _table(
        ("id", _S, False), ("request_id", _S, True), ("alert_type", _S, False),
        ("severity", _S, False), ("lifecycle_state", _S, False), ("message", _S, False),
        ("metadata", _S, True), ("created_at", _TS, False), ("acknowledged_by", _S, True),
        ("acknowledged_at", _TS, True), ("resolved_by", _S, True), ("resolved_at", _TS, True),
        ("archived_at", _TS, True),
    ),
    "ai_predictions": _table(
        ("request_id", _S, False), ("risk_score", T.DecimalType(4, 3), False),
        ("risk_label", _S, False), ("contributing_factors", T.ArrayType(FACTOR), False),
        ("predicted_delay_hours", T.DecimalType(8, 2), True),
        ("delay_confidence", T.DecimalType(4, 3), True), ("predicted_completion_at", _TS, True),
        ("is_stale", _B, False), ("last_computed_at", _TS, False),
    ),
    "analytics_snapshots": _table(
        ("snapshot_type", _S, False), ("period_start", _TS, False), ("period_end", _TS, False),
        ("department", _S, True), ("journey_stage", _S, True), ("kpi_key", _S, False),
        ("kpi_value", T.DecimalType(12, 4), False),
    ),
    "integration_configs": _table(
        ("source_system", _S, False), ("webhook_secret", _S, True),
        ("normalization_map", T.MapType(_S, _S), True), ("sync_interval_mins", _I, True),
        ("last_synced_at", _TS, True), ("is_active", _B, False),
    ),
    "users": _table(
        ("id", _S, False), ("email", _S, False), ("role", _S, False), ("is_active", _B, False),
    ),
    "broadcasts": _table(
        ("channel", _S, False), ("event", _S, False), ("data", _S, True), ("sent_at", _TS, False),
    ),
    "clients": _table(
        ("connection_id", _S, False), ("user_id", _S, True), ("role", _S, True),
        ("subscribed_channels", _NAMES, False), ("last_received_at", _TS, True),
    ),
    # Landing format of raw payloads: ``delivery_id`` is unique per received payload (a Kafka
    # partition-offset, or the id the landing writer gave it).
    "raw_events": _table(
        ("delivery_id", _S, False), ("raw", _S, True), ("header_source", _S, True),
        ("signature", _S, True), ("received_at", _TS, False),
    ),
    "alert_commands": _table(
        ("command_id", _S, False), ("alert_id", _S, False), ("action", _S, False),
        ("user_id", _S, True), ("at", _TS, False),
    ),
}
