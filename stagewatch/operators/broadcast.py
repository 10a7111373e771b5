"""Outgoing messages: channels, fan-out to subscribers, replay of what was missed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stagewatch import schema as S
from stagewatch.functions.times import instant
from stagewatch.plans.sequence import Sequence, sequence


def create_alerts(candidates: DataFrame, created_at=None) -> DataFrame:
    """Alert rows in state Created; nothing acknowledged yet."""
    given = "created_at" in candidates.columns
    stamps = {
        "lifecycle_state": F.lit("Created"),
        "created_at": F.col("created_at") if given else instant(created_at),
        **{n: F.lit(None).cast("string") for n in ("acknowledged_by", "resolved_by")},
        **{n: F.lit(None).cast("timestamp") for n in ("acknowledged_at", "resolved_at", "archived_at")},
    }
    return candidates.withColumns(stamps).select(*[f.name for f in S.TABLES["alerts"].fields])


def broadcast_payloads(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """One message per alert on its severity channel and per event on its request channel."""
    alert_data = F.to_json(
        F.struct(
            F.col("id").alias("alertId"), F.col("request_id").alias("requestId"),
            F.col("alert_type").alias("alertType"), "severity",
            F.col("lifecycle_state").alias("lifecycleState"), "message",
        )
    )
    event_data = F.to_json(F.struct(F.col("id").alias("eventId"), F.col("request_id").alias("requestId")))
    from_alerts = alerts.select(
        F.concat(F.lit("alert:"), F.col("severity")).alias("channel"), F.lit("alert_created").alias("event"),
        alert_data.alias("data"), F.col("created_at").alias("sent_at"), F.col("id").alias("source_id"),
    )
    from_events = events.select(
        F.concat(F.lit("request:"), F.col("request_id")).alias("channel"), F.lit("event_received").alias("event"),
        event_data.alias("data"), F.col("received_at").alias("sent_at"), F.col("id").alias("source_id"),
    )
    return from_alerts.unionByName(from_events)


def subscriptions(clients: DataFrame) -> DataFrame:
    """One row per connection and channel."""
    return clients.select(
        "connection_id", "last_received_at", F.explode(F.array_distinct("subscribed_channels")).alias("channel")
    )


def fan_out(payloads: DataFrame, clients: DataFrame) -> DataFrame:
    """Every message to every subscriber of its channel. Subscriptions are not broadcast, as in ``delivery_counts``."""
    return payloads.join(subscriptions(clients).hint("merge"), "channel")


def delivery_counts(payloads: DataFrame, clients: DataFrame) -> DataFrame:
    """Messages each connection receives and the time of the last one.

    Messages are counted per channel before the join, so a channel with many messages and many
    subscribers costs one row per subscriber instead of one per delivery.
    Subscriptions are sent by channel, never broadcast: the optimizer takes them for as small as the clients they
    are exploded from.
    """
    per_channel = payloads.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"), F.max("sent_at").alias("last_sent_at")
    )
    return (
        subscriptions(clients).hint("merge").join(per_channel, "channel")
        .groupBy("connection_id")
        .agg(F.sum("n").alias("messages"), F.max("last_sent_at").alias("last_sent_at"))
    )


def replay(payloads: DataFrame, deliveries: DataFrame, clients: DataFrame, as_of, ttl_hours: int = S.REPLAY_TTL_HOURS) -> DataFrame:
    """Messages a reconnecting client missed: undelivered, within the TTL, after its last one.

    ``deliveries(connection_id, source_id)`` lists what arrived. Read in the order of ``sent_at``. The TTL
    filter comes first, so only the last day of messages is fanned out.
    """
    now = instant(as_of)
    oldest = F.timestamp_micros(F.unix_micros(now) - F.lit(ttl_hours * 3_600_000_000))
    recent = payloads.where((F.col("sent_at") > oldest) & (F.col("sent_at") <= now))
    missed = fan_out(recent, clients).where(
        F.col("last_received_at").isNull() | (F.col("sent_at") > F.col("last_received_at"))
    )
    return missed.join(deliveries, ["connection_id", "source_id"], "left_anti")


CURSOR = "connection_id string, delivered_to long"
GAP = "connection_id string, delivery_no long"


def delivery_queue(payloads: DataFrame, clients: DataFrame, hot: dict | None = None, **cut) -> DataFrame:
    """Every message of every connection in the order it is sent, numbered from 1 without gaps by ``delivery_no``.

    Order is (sent_at, source_id, channel). Connections with very many messages are cut by ``sequence``.
    """
    rows = fan_out(payloads, clients).withColumn("_tie", F.concat_ws("|", "source_id", "channel"))
    return sequence(rows, "connection_id", "sent_at", "_tie", Sequence(position="delivery_no"), hot, **cut).drop("_tie")


def advance_cursors(cursors: DataFrame, gaps: DataFrame, delivered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cursors and gaps after further deliveries (connection_id, delivery_no).

    A cursor says up to which number a connection's messages are accounted for, and the gaps which of these did
    not arrive: everything below the first gap is the delivered prefix. Only the new deliveries and the gaps are read.
    """
    got = delivered.select("connection_id", "delivery_no").distinct()
    reached = got.groupBy("connection_id").agg(F.max("delivery_no").alias("_reached"))
    both = cursors.join(reached, "connection_id", "full_outer").select(
        "connection_id", F.coalesce("delivered_to", F.lit(0).cast("bigint")).alias("_before"), F.col("_reached")
    )
    after = both.select("connection_id", F.greatest("_before", "_reached").alias("delivered_to"))
    passed = both.where(F.col("_reached") > F.col("_before")).select(
        "connection_id", F.explode(F.sequence(F.col("_before") + 1, F.col("_reached"))).alias("delivery_no")
    )
    open_ones = gaps.select("connection_id", "delivery_no").unionByName(passed)
    return after, open_ones.join(got, ["connection_id", "delivery_no"], "left_anti")


def delivered_prefix(cursors: DataFrame, gaps: DataFrame) -> DataFrame:
    """(connection_id, prefix, gaps): up to which number everything arrived, and how many behind it are missing."""
    first = gaps.groupBy("connection_id").agg(F.min("delivery_no").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return cursors.join(first, "connection_id", "left").select(
        "connection_id", F.coalesce(F.col("_first") - 1, F.col("delivered_to")).alias("prefix"), F.coalesce("_n", F.lit(0)).alias("gaps")
    )


def replay_from(queue: DataFrame, cursors: DataFrame, gaps: DataFrame, as_of, ttl_hours: int = S.REPLAY_TTL_HOURS) -> DataFrame:
    """Messages of the queue that a reconnecting client missed, with their ``delivery_no``, which is the order to send them in.

    What lies behind the cursor, and the gaps before it, within the TTL and after the client's last message. A
    connection meets one cursor row; no delivery is looked up.
    """
    now = instant(as_of)
    oldest = F.timestamp_micros(F.unix_micros(now) - F.lit(ttl_hours * 3_600_000_000))
    late = F.col("last_received_at").isNull() | (F.col("sent_at") > F.col("last_received_at"))
    recent = queue.where((F.col("sent_at") > oldest) & (F.col("sent_at") <= now) & late)
    placed = recent.join(cursors, "connection_id", "left").withColumn("_behind", F.col("delivery_no") > F.coalesce("delivered_to", F.lit(0)))
    missed = gaps.select("connection_id", "delivery_no")
    return placed.where("_behind").unionByName(
        placed.where(~F.col("_behind")).join(missed, ["connection_id", "delivery_no"], "left_semi").select(*placed.columns)
    ).drop("_behind", "delivered_to")
