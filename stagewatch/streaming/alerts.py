"""Alert lifecycle as a stream of commands.

The state of an alert is its created row plus the log of transitions that took effect, three rows at most per
alert. Both lie in buckets of the alert's request, so a batch opens the buckets of the alerts that it names, not the
whole log. Commands that are due are folded set-based, as in ``lifecycle.apply_transitions``, however many of them name
one alert; the log grows by the accepted transitions and nothing is rewritten.

Commands may come out of order: with ``lateness`` they wait until the clock, the latest command's time less the lateness,
has passed them, and then act by their time, whatever batches they came in. Each batch hands what still waits to
the next one. A command that comes later than that acts on the state it finds.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stagewatch import schema as S
from stagewatch.operators import lifecycle
from stagewatch.operators.lifecycle import STAMPS, apply_log
from stagewatch.sources.tables import read_batches
from stagewatch.streaming.store import LOG, Store, alert_bucket, batch_ids, buckets_in

COMMANDS = [f.name for f in S.TABLES["alert_commands"].fields]
CLOCK = T.StructType([T.StructField("latest", T.TimestampType())])


def log_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Log rows of the stamps that a batch of commands added."""
    old = before.select("id", *[F.col(at).alias(f"_{at}") for _, at in STAMPS.values()])
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("state"), (F.col(by) if by else F.lit(None).cast("string")).alias("by"),
                     F.col(at).alias("at"), F.col(f"_{at}").alias("old"))
            for name, (by, at) in STAMPS.items()
        ]
    )
    rows = after.join(old, "id").select("id", F.inline(entries))
    return rows.where(F.col("at").isNotNull() & ~F.col("at").eqNullSafe(F.col("old"))).select("id", "state", "by", "at")


def current_alerts(spark: SparkSession, alerts: DataFrame, store: Store) -> DataFrame:
    """All alerts in their present state."""
    return apply_log(alerts, read_batches(spark, LOG, store.path("alert_log")))


def _waiting(spark: SparkSession, store: Store, batch_id: int) -> DataFrame:
    return read_batches(spark, S.TABLES["alert_commands"], store.path("alert_waiting"), store.mine(batch_id))


def due_commands(commands: DataFrame, batch_id: int, store: Store, lateness: timedelta | None) -> tuple[DataFrame, DataFrame | None]:
    """Commands of this batch and of those waiting that the clock has passed, and the rest, which goes on waiting."""
    if lateness is None:
        return commands, None
    spark = commands.sparkSession
    before = read_batches(spark, CLOCK, store.path("alert_clock"), store.mine(batch_id - 1)).first()
    latest = [t for t in (before and before["latest"], commands.agg(F.max("at")).first()[0]) if t is not None]
    clock = spark.createDataFrame([(max(latest, default=None),)], CLOCK)
    store.write(clock, "alert_clock", batch_id)
    every = commands.unionByName(_waiting(spark, store, batch_id - 1))
    due = F.lit(False) if not latest else F.col("at") <= F.lit(max(latest) - lateness).cast("timestamp")
    return every.where(due), every.where(~due)


def command_batch(commands: DataFrame, batch_id: int, alerts: DataFrame, store: Store, lateness: timedelta | None = None) -> None:
    """Apply one micro-batch of commands; only the alerts it names are judged, only their buckets of the log are read.

    Where ``alerts`` is read from a store, its buckets are pruned too: it has a ``bucket`` column then.
    """
    spark, store = commands.sparkSession, store.of("commands")
    commands = commands.select(*COMMANDS).persist()
    try:
        due, rest = due_commands(commands, batch_id, store, lateness)
        due = due.persist()
        try:
            named = due.select(F.col("alert_id").alias("id"))
            near = buckets_in(named, alert_bucket("id"))
            known = alerts.where(near).drop("bucket") if "bucket" in alerts.columns else alerts
            ids = batch_ids(named)
            log = read_batches(spark, LOG, store.path("alert_log"), ~store.mine(batch_id) & near)
            before = apply_log(known.join(ids, "id", "left_semi"), log.join(ids, "id", "left_semi"))
            after, rejects = lifecycle.apply_transitions(before, due)
            # The rejects are judged by the log as it was; they go first, as the next write adds to it.
            store.write(rejects, "alert_rejects", batch_id)
            store.write(log_rows(before, after).withColumn("bucket", alert_bucket("id")), "alert_log", batch_id, by="bucket")
            if rest is not None:
                store.write(rest, "alert_waiting", batch_id)
        finally:
            due.unpersist()
    finally:
        commands.unpersist()


def stored_alerts(spark: SparkSession, store: Store) -> DataFrame:
    """Alerts of the store as they were created, with their ``bucket``, for ``command_batch``."""
    return read_batches(spark, S.TABLES["alerts"], store.path("alerts"), keep=("bucket",))


def waiting_commands(spark: SparkSession, store: Store) -> DataFrame:
    """Commands that the clock has not passed yet."""
    store = store.of("commands")
    last = read_batches(spark, CLOCK, store.path("alert_clock"), F.col("stream") == store.name, keep=("batch_id",)).agg(F.max("batch_id")).first()[0]
    return _waiting(spark, store, -1 if last is None else last)


def alert_state_stream(commands: DataFrame, alerts: DataFrame, store: Store, checkpoint: str, lateness: timedelta | None = None):
    """Apply a stream of ``alert_commands`` in order of time: within each micro-batch, or across batches within ``lateness``."""
    store = store.of("commands")
    store.claim(commands.sparkSession, checkpoint)
    return (
        commands.select(*COMMANDS)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: command_batch(batch, batch_id, alerts, store, lateness))
        .trigger(availableNow=True)
        .start()
    )
