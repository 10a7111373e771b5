"""SLA monitoring on event time: alerts fire when 80 % and 100 % of a threshold have passed.

Before the shuffle each Arrow batch is reduced. Consecutive transitions of a request that follow
each other faster than the shortest warning time cannot alert, so such a run is kept as its first
and last moment. A request with very many events thus sends a handful of rows to its task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from stagewatch import schema as S
from stagewatch.functions.times import hours_between
from stagewatch.operators.broadcast import broadcast_payloads, create_alerts
from stagewatch.operators.sla import dedup_alerts, sla_alert_candidates
from stagewatch.sources.tables import read_batches
from stagewatch.streaming.store import Store

RUN = "request_id string, start_at timestamp, end_at timestamp, event_id string, journey_stage string"
ALERT = (
    "request_id string, journey_stage string, severity string, alert_type string, event_id string, "
    "entered_at timestamp, due_at timestamp, threshold_hours double"
)
HOUR = 3_600_000_000
_TEXTS = ("id", "request_id", "alert_type", "severity", "lifecycle_state", "message", "metadata", "journey_stage")
CANDIDATE = T.StructType([*[T.StructField(c, T.StringType()) for c in _TEXTS], T.StructField("created_at", T.TimestampType())])


def micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


def reduce_runs(pdf: pd.DataFrame, limits: dict[str, float]) -> pd.DataFrame:
    """Runs of fast transitions as one row each; entries of stages without a rule stay."""
    pdf = pdf[pdf["new_state"].notna()].sort_values(["request_id", "occurred_at", "id"], kind="stable")
    if pdf.empty:
        return pd.DataFrame(columns=["request_id", "start_at", "end_at", "event_id", "journey_stage"])
    at = micros(pdf["occurred_at"])
    same = pdf["request_id"].eq(pdf["request_id"].shift())
    joins = same & (at.diff() < _shortest(limits))
    run = (~joins).cumsum()
    last = ~joins.shift(-1, fill_value=False)
    runs = pdf[last].assign(start_at=pdf.groupby(run)["occurred_at"].transform("first")[last])
    no_rule = pdf[~last & pdf["new_state"].isin([s for s in S.ACTIVE_STAGES if s not in limits])]
    no_rule = no_rule.drop_duplicates(["request_id", "new_state"]).assign(start_at=lambda d: d["occurred_at"])
    kept = pd.concat([runs, no_rule])
    return kept.rename(columns={"occurred_at": "end_at", "id": "event_id", "new_state": "journey_stage"})[
        ["request_id", "start_at", "end_at", "event_id", "journey_stage"]
    ]


def _shortest(limits: dict[str, float]) -> float:
    """Microseconds below which a stay in any stage raises nothing."""
    return S.WARNING_SHARE * min(limits.values(), default=0.0) * HOUR


def merge_runs(runs: list[list], limits: dict[str, float]) -> list[list]:
    """Runs [start, end, event id, stage] by time, those closer than the shortest warning joined."""
    merged: list[list] = []
    for run in sorted(runs):
        if merged and run[0] - merged[-1][1] < _shortest(limits):
            if (run[1], run[2]) > (merged[-1][1], merged[-1][2]):
                merged[-1][1:] = run[1:]
        else:
            merged.append(list(run))
    return merged


def watch(runs: list[list], emitted: set, watermark: int, limits: dict[str, float]) -> tuple[list, list, int | None]:
    """Advance one request to the watermark (microseconds): (alerts, runs to keep, next due time).

    The last event of a run enters a stage that ends when the next run starts. A run whose end is
    known and behind the watermark is finished; the open one stays. ``emitted`` remembers what the
    kept runs have raised, by their events: entering a stage again can alert again.
    """
    alerts, keep, due = [], [], []

    def emit(stage, severity, kind, event, entered, at, limit):
        if (stage, severity, event) not in emitted:
            emitted.add((stage, severity, event))
            alerts.append((stage, severity, kind, event, entered, at, limit))

    for _, t, event, stage in runs:
        if stage in S.ACTIVE_STAGES and stage not in limits:
            emit(stage, "Info", S.OPERATIONAL, event, t, t, 0.0)
    runs = merge_runs(runs, limits)
    for i, (start, t, event, stage) in enumerate(runs):
        over = runs[i + 1][0] if i + 1 < len(runs) else None
        if stage in limits:
            for share, severity in ((S.WARNING_SHARE, "Warning"), (S.BREACH_SHARE, "Critical")):
                at = t + round(share * limits[stage] * HOUR)
                if over is not None and over < at:
                    continue
                if at <= watermark:
                    emit(stage, severity, S.SLA_BREACH, event, t, at, limits[stage])
                elif (stage, severity, event) not in emitted:
                    due.append(at)
        if over is None or over > watermark:
            keep.append([start, t, event, stage])
    held = {event for _, _, event, _ in keep}
    emitted.intersection_update([e for e in emitted if e[2] in held])
    return alerts, keep, min(due, default=None)


def rule_limits(rules: DataFrame) -> dict[str, float]:
    """Thresholds by stage, in hours; a stage has one rule."""
    known = rules.where(F.col("journey_stage").isin(S.ACTIVE_STAGES)).groupBy("journey_stage")
    rows = known.agg(F.count(F.lit(1)).alias("n"), F.max("threshold_hours").alias("threshold_hours")).collect()
    if twice := sorted(r["journey_stage"] for r in rows if r["n"] > 1):
        raise ValueError(f"rules given twice: {twice}")
    return {r["journey_stage"]: float(r["threshold_hours"]) for r in rows}


def sla_monitor_stream(events: DataFrame, rules: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Alerts of a stream of canonical events, each severity once per entry into a stage.

    Events may come in any order within ``lateness``. ``rules`` has one row per stage; its thresholds
    travel with the tasks. ``dedup_alerts`` leaves out those of which an open copy is stored.
    """
    limits = rule_limits(rules)

    def compact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield reduce_runs(pdf, limits)

    def advance(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"runs": [], "emitted": []}
        runs = held["runs"]
        for pdf in frames:
            runs += [
                [int(s), int(e), i, g]
                for s, e, i, g in zip(micros(pdf["start_at"]), micros(pdf["end_at"]), pdf["event_id"], pdf["journey_stage"])
            ]
        emitted = {tuple(e) for e in held["emitted"]}
        watermark = state.getCurrentWatermarkMs()
        alerts, runs, due = watch(runs, emitted, watermark * 1000, limits)
        if len(runs) == 1 and runs[0][3] in S.TERMINAL_STAGES and runs[0][1] <= watermark * 1000:
            state.remove()
        else:
            state.update((json.dumps({"runs": runs, "emitted": sorted(emitted)}),))
            if due is not None:
                state.setTimeoutTimestamp(max(due // 1000 + 1, watermark + 1))
        if alerts:
            rows = [
                (key[0], stage, severity, kind, event, pd.Timestamp(t, unit="us"), pd.Timestamp(at, unit="us"), limit)
                for stage, severity, kind, event, t, at, limit in alerts
            ]
            columns = [c.split()[0] for c in ALERT.split(", ")]
            yield pd.DataFrame(rows, columns=columns)

    moves = events.select("request_id", "occurred_at", "id", "new_state")
    return (
        moves.mapInPandas(compact, RUN)
        .withWatermark("end_at", lateness)
        .groupBy("request_id")
        .applyInPandasWithState(advance, ALERT, "held string", "append", GroupStateTimeout.EventTimeTimeout)
    )


def alert_candidates(fired: DataFrame) -> DataFrame:
    """Fired alerts as candidates for the alert sink, as an evaluation at their due time gives them."""
    share = F.when(F.col("severity") == "Critical", S.BREACH_SHARE).when(F.col("severity") == "Warning", S.WARNING_SHARE)
    evaluated = fired.select(
        "request_id", "journey_stage", "threshold_hours",
        hours_between(F.col("entered_at"), F.col("due_at")).alias("elapsed_hours"),
        F.coalesce(share, F.lit(0.0)).alias("percent_used"),
        (F.col("severity") != "Info").alias("has_rule"),
        F.col("due_at").alias("created_at"),
    )
    return sla_alert_candidates(evaluated, carry=["created_at"])


def start_sla_monitor(events: DataFrame, rules: DataFrame, store: Store, checkpoint: str, lateness: str = "1 hour"):
    """Write the alerts of an event stream, and their messages, unless an open copy is stored."""
    store = store.of("monitor")
    store.claim(events.sparkSession, checkpoint)

    def raise_alerts(fired: DataFrame, batch_id: int) -> None:
        spark = fired.sparkSession
        # The stateful frame of a micro-batch must be computed only once.
        store.write(alert_candidates(fired), "fired_alerts", batch_id)
        found = read_batches(spark, CANDIDATE, store.path("fired_alerts"), store.mine(batch_id))
        new = dedup_alerts(found, store.alerts_before(spark, batch_id, found))
        store.write_alerts(create_alerts(new), batch_id)
        none = spark.createDataFrame([], S.TABLES["events"])
        payloads = broadcast_payloads(store.of_batch(spark, "alerts", batch_id), none)
        store.write(payloads, "alert_messages", batch_id)

    return (
        sla_monitor_stream(events, rules, lateness)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(raise_alerts)
        .trigger(availableNow=True)
        .start()
    )
