"""State changes as joins and aggregates: alert commands, request patches, new requests.

Plain files have no UPDATE, so each operator returns the state after the change. Several commands
for one alert or patches for one request are folded by aggregates, never gathered into a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stagewatch import schema as S
from stagewatch.functions.numbers import pad_number
from stagewatch.plans.sequence import Sequence, hot_keys, sequence


def _sent(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in ("at", "command_id", "user_id")])


def _later(one: Column, other: Column) -> Column:
    """One command acts after another: by time, then by id. False where the other is missing."""
    return other.isNotNull() & (F.struct(one["at"], one["command_id"]) > F.struct(other["at"], other["command_id"]))


def _judged(rows: DataFrame, alerts: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changed alerts and refused commands, of rows that have the alert (``_alert``) or a command (``_command``), the state
    ``before``, and per step of the lifecycle the command that took effect."""
    ack, res, arc = (F.col(f"_{a}") for a in S.ALERT_COMMANDS)
    state = F.when(arc.isNotNull(), "Archived").when(res.isNotNull(), "Resolved").when(ack.isNotNull(), "Acknowledged")
    changes = {
        "lifecycle_state": state, "acknowledged_by": ack["user_id"], "acknowledged_at": ack["at"],
        "resolved_by": res["user_id"], "resolved_at": res["at"], "archived_at": arc["at"],
    }
    old = {c: F.col("_alert")[c] for c in alerts.columns}
    changed = rows.where(F.col("_alert").isNotNull()).select(
        *[(F.coalesce(changes[c], v) if c in changes else v).alias(c) for c, v in old.items()]
    )

    sent = F.col("_sent")
    current = (
        F.when(_later(sent, arc), "Archived").when(_later(sent, res), "Resolved").when(_later(sent, ack), "Acknowledged")
        .otherwise(F.col("before"))
    )
    mine = F.lit(False)
    for step in (ack, res, arc):
        mine = mine | F.coalesce(step["command_id"] == sent["command_id"], F.lit(False))
    target, follower = F.lit(None).cast("string"), F.lit("none (terminal)")
    for action, (needed, to) in S.ALERT_COMMANDS.items():
        target = F.when(F.col("_command.action") == action, F.lit(to)).otherwise(target)
        follower = F.when(F.col("current_state") == needed, F.lit(to)).otherwise(follower)
    refused = F.format_string(
        "Invalid transition: '%s' → '%s'. Allowed next state is '%s'.", F.col("current_state"), F.col("target"), follower
    )
    reason = (
        F.when(F.col("before").isNull(), F.concat(F.lit("Alert not found: "), F.col("_command.alert_id")))
        .when(F.col("target").isNull(), F.lit("Action must be acknowledge, resolve, or archive"))
        .otherwise(refused)
    )
    rejects = (
        rows.where(F.col("_command").isNotNull() & ~mine)
        .withColumns({"current_state": current, "target": target})
        .withColumn("reason", reason)
        .select(*[F.col("_command")[c].alias(c) for c in commands.columns], "current_state", "reason")
    )
    return changed, rejects


def _rows(alerts: DataFrame, commands: DataFrame) -> DataFrame:
    """Alerts and commands as rows of one frame, by the alert's id; a command without one has a key of its own."""
    of_alerts = alerts.select(F.col("id").alias("_key"), F.struct(*alerts.columns).alias("_alert"))
    key = F.coalesce("alert_id", F.concat(F.lit("\0"), F.col("command_id")))
    of_commands = commands.select(key.alias("_key"), F.struct(*commands.columns).alias("_command"), _sent().alias("_sent"))
    return of_alerts.unionByName(of_commands, allowMissingColumns=True)


def _by_windows(alerts: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows of an alert in one task, exchanged once: a step takes the first command of its kind after the step before."""
    of_alert = Window.partitionBy("_key")
    rows = _rows(alerts, commands).withColumn("before", F.max("_alert.lifecycle_state").over(of_alert))
    previous = None
    for action, (needed, _) in S.ALERT_COMMANDS.items():
        eligible = F.col("before") == needed
        if previous is not None:
            eligible = eligible | _later(F.col("_sent"), F.col(previous))
        first = F.min(F.when((F.col("_command.action") == action) & eligible, F.col("_sent")))
        previous = f"_{action}"
        rows = rows.withColumn(previous, first.over(of_alert))
    return _judged(rows, alerts, commands)


def _by_minima(alerts: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For alerts with very many commands: grouped minima, summed up before they are shuffled, meet the rows by broadcast.

    ``alerts`` are those of at most ``sequence.MAX_KEYS`` keys.
    """
    steps = alerts.select(F.col("id").alias("_of"), F.col("lifecycle_state").alias("before"))
    previous = None
    for action, (needed, _) in S.ALERT_COMMANDS.items():
        sent = commands.where(F.col("action") == action).select(F.col("alert_id").alias("_of"), _sent().alias("_sent"))
        eligible = F.col("before") == needed
        if previous is not None:
            eligible = eligible | _later(F.col("_sent"), F.col(previous))
        first = sent.join(F.broadcast(steps), "_of").where(eligible).groupBy("_of").agg(F.min("_sent").alias(f"_{action}"))
        steps = steps.join(F.broadcast(first), "_of", "left")
        previous = f"_{action}"
    rows = _rows(alerts, commands).join(F.broadcast(steps), F.col("_key") == F.col("_of"), "left")
    return _judged(rows, alerts, commands)


def apply_transitions(alerts: DataFrame, commands: DataFrame, hot: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Alerts after their commands, and the commands that were refused with the reason.

    Commands act in the order (at, command_id). A command is valid only when it leads from the
    state the alert has at that moment to the next one. Alerts and commands are exchanged once; ``hot``, the outcome of
    ``hot_keys`` on the commands' alerts, names alerts whose commands are too many for one task. It is looked up when not given.
    """
    if hot is None:
        hot = hot_keys(commands, "alert_id")
    if not hot:
        return _by_windows(alerts, commands)
    many, named = F.col("id").isin(list(hot)), F.coalesce(F.col("alert_id").isin(list(hot)), F.lit(False))
    plain = _by_windows(alerts.where(~many), commands.where(~named))
    large = _by_minima(alerts.where(many), commands.where(named))
    return plain[0].unionByName(large[0]), plain[1].unionByName(large[1])


STAMPS = {
    "Acknowledged": ("acknowledged_by", "acknowledged_at"),
    "Resolved": ("resolved_by", "resolved_at"),
    "Archived": (None, "archived_at"),
}


def apply_log(alerts: DataFrame, log: DataFrame) -> DataFrame:
    """Alerts after the transitions of the log, which holds each state of an alert once."""
    facts = [F.max(F.when(F.col("state") == s, F.struct("at", "by"))).alias(f"_{s}") for s in STAMPS]
    joined = alerts.join(log.groupBy("id").agg(*facts), "id", "left")
    state = F.col("lifecycle_state")
    changes = {}
    for name, (by, at) in STAMPS.items():
        state = F.when(F.col(f"_{name}").isNotNull(), F.lit(name)).otherwise(state)
        changes[at] = F.coalesce(F.col(f"_{name}.at"), at)
        if by:
            changes[by] = F.coalesce(F.col(f"_{name}.by"), by)
    return joined.withColumns({**changes, "lifecycle_state": state}).select(*alerts.columns)


REQUIRED_FIELDS = ["customer_name", "customer_contact", "request_type", "current_status"]
CLEARABLE_FIELDS = ["assigned_department", "assigned_user_id", "metadata"]


def apply_patches(requests: DataFrame, patches: DataFrame) -> DataFrame:
    """Requests after their patches: each supplied field takes its latest value.

    ``patches(request_id, patch_id, at, fields, <field columns>)``; ``fields`` names what a patch supplies.
    Department, user and metadata may be cleared by an explicit null; id, number and stage never
    change. ``updated_at`` becomes the time of the last patch.
    """
    names = [n for n in REQUIRED_FIELDS + CLEARABLE_FIELDS if n in patches.columns and n in requests.columns]
    aggregates = [F.max("at").alias("_at")]
    for name in names:
        given = F.array_contains("fields", name)
        if name in REQUIRED_FIELDS:
            given = given & F.col(name).isNotNull()
        order = F.when(given, F.struct("at", "patch_id"))
        aggregates.append(F.max_by(F.struct(F.col(name).alias("v")), order).alias(f"_{name}"))
    latest = patches.groupBy("request_id").agg(*aggregates).withColumnRenamed("request_id", "id")
    changes = {n: F.when(F.col(f"_{n}").isNotNull(), F.col(f"_{n}.v")).otherwise(F.col(n)) for n in names}
    changes["updated_at"] = F.coalesce("_at", "updated_at")
    return requests.join(latest, "id", "left").withColumns(changes).select(*requests.columns)


def assign_request_numbers(new: DataFrame, existing: DataFrame, hot: dict | None = None, **cut) -> DataFrame:
    """Add ``request_number``: SR-year-sequence, going on from the numbers of that year.

    A year holds nearly all new rows, which is what ``sequence`` cuts into chunks. The width grows
    beyond five digits instead of cutting the number off.
    """
    taken = (
        existing.where(F.col("request_number").rlike(r"^SR-\d{4}-"))
        .groupBy(F.substring("request_number", 4, 4).cast("int").alias("_year"))
        .agg(F.count(F.lit(1)).alias("_taken"))
    )
    dated = new.withColumn("_year", F.year("created_at"))
    numbered = sequence(dated, "_year", "created_at", "id", Sequence(position="_place"), hot, **cut)
    number = F.coalesce("_taken", F.lit(0)) + F.col("_place")
    text = F.concat_ws("-", F.lit("SR"), F.col("_year").cast("string"), pad_number(number, 5))
    taken = F.broadcast(taken)  # four digits of year: 10,000 rows at most
    return numbered.join(taken, "_year", "left").withColumn("request_number", text).select(*new.columns, "request_number")


def create_requests(new: DataFrame, existing: DataFrame, hot: dict | None = None, **cut) -> DataFrame:
    """Complete rows for new requests: first stage, open, not breached, numbered."""
    rows = new.withColumns(
        {
            "current_stage": F.lit(S.STAGES[0]),
            "current_status": F.lit("Open"),
            "sla_breached": F.lit(False),
            "updated_at": F.col("created_at"),
        }
    )
    return assign_request_numbers(rows, existing, hot, **cut)


def mark_stale(predictions: DataFrame, failed: DataFrame) -> DataFrame:
    """Set the stale flag on all predictions of requests whose refresh failed."""
    hit = failed.select("request_id", F.lit(True).alias("_failed")).distinct()
    return (
        predictions.join(hit, "request_id", "left")
        .withColumn("is_stale", F.col("is_stale") | F.coalesce("_failed", F.lit(False)))
        .drop("_failed")
    )
