"""The present state of requests, kept up as events arrive: stage, breach flag, times of origin and last change.

State is keyed by the request. An event counts by the time it occurred, whenever it arrives: the stage is that of the
latest transition, the origin that of the earliest event, and the breach flag follows from the sequence of transitions,
which is kept for ``keep`` after the clock has passed it, so that a late one puts right what was judged without it.
The clock is the watermark on the time of arrival: an event may be as late as it likes and isn't dropped, but one that
occurred more than ``keep`` before the clock no longer changes whether earlier stays were a breach.

Arrow batches are reduced to runs before the shuffle, as in ``sla_monitor``: a request with very many events sends a
few rows to its task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from stagewatch.functions.times import instant
from stagewatch.operators.analytics import check_trend_range
from stagewatch.operators.sla import rate
from stagewatch.sources.tables import read_batches
from stagewatch.streaming.sla_monitor import HOUR, merge_runs, micros, reduce_runs, rule_limits
from stagewatch.streaming.store import Store, bucket_of, buckets_in

# A run as reduce_runs gives it, or the first and last event of an Arrow batch (then without a stage).
PIECE = (
    "request_id string, start_at timestamp, end_at timestamp, event_id string, journey_stage string, "
    "department string, arrived_at timestamp"
)
STATE = T.StructType(
    [
        T.StructField("request_id", T.StringType()), T.StructField("current_stage", T.StringType()),
        T.StructField("entered_at", T.TimestampType()), T.StructField("assigned_department", T.StringType()),
        T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()),
        T.StructField("sla_breached", T.BooleanType()), T.StructField("breached_at", T.TimestampType()),
        T.StructField("version", T.LongType()),
    ]
)


_OLD = {"old_stage": "current_stage", "old_department": "assigned_department", "old_created_at": "created_at", "old_breached": "sla_breached"}
CHANGE = T.StructType([*STATE.fields, *[T.StructField(new, STATE[old].dataType) for new, old in _OLD.items()]])
DAY = T.StructType(
    [
        T.StructField("day", T.TimestampType()), T.StructField("department", T.StringType()), T.StructField("stage", T.StringType()),
        T.StructField("requests", T.LongType()), T.StructField("breached", T.LongType()),
    ]
)


def pieces(pdf: pd.DataFrame, limits: dict[str, float]) -> pd.DataFrame:
    """Runs of an Arrow batch, and of each request its first event with the time of its last."""
    pdf = pdf.sort_values(["request_id", "occurred_at", "id"], kind="stable")
    runs = reduce_runs(pdf, limits)
    # The latest transition decides the stage even where a run of other events goes on.
    ends = pdf.groupby("request_id", sort=False)
    first = ends.head(1).rename(columns={"occurred_at": "start_at", "id": "event_id"})[["request_id", "start_at", "event_id", "department"]]
    first = first.merge(ends["occurred_at"].last().rename("end_at"), on="request_id")
    arrived = ends["received_at"].max()
    out = pd.concat([runs, first])
    out["arrived_at"] = out["request_id"].map(arrived)
    return out.reindex(columns=[c.split()[0] for c in PIECE.split(", ")])


def breach_time(runs: list[list], clock: int, limits: dict[str, float]) -> tuple[int | None, int | None, int | None]:
    """Of merged runs the first and the last moment at which a stay became a breach, and when the open one will."""
    hits, due = [], None
    for i, (_, t, _, stage) in enumerate(runs):
        if stage in limits:
            at = t + round(limits[stage] * HOUR)
            over = runs[i + 1][0] if i + 1 < len(runs) else None
            if at <= (clock if over is None else over):
                hits.append(at)
            elif over is None:
                due = at
    return min(hits, default=None), max(hits, default=None), due


def advance(held: dict, new: list[dict], clock: int, keep: int, limits: dict[str, float]) -> tuple[dict, int | None]:
    """The state of a request after further pieces, times in microseconds, and when its open stay becomes a breach."""
    state = dict(held)
    runs = [list(r) for r in held.get("runs", [])]
    for p in new:
        if p["journey_stage"] is None:
            first = [p["start_at"], p["event_id"], p["department"]]
            state["first"] = min(state.get("first", first), first, key=lambda f: f[:2])
            state["last"] = max(state.get("last", p["end_at"]), p["end_at"])
        else:
            runs.append([p["start_at"], p["end_at"], p["event_id"], p["journey_stage"]])
            entered = [p["end_at"], p["event_id"], p["journey_stage"]]
            state["stage"] = max(state.get("stage", entered), entered)
    runs = merge_runs(runs, limits)
    done = 0  # runs that the clock has left behind: whether they were a breach is settled
    while done + 1 < len(runs) and runs[done + 1][0] <= clock - keep:
        done += 1
    settled = breach_time([*runs[:done], *runs[done : done + 1]], -(1 << 62), limits)[:2]
    state["settled"] = _spread(state.get("settled"), settled)
    state["runs"] = runs[done:]
    first, last, due = breach_time(state["runs"], clock, limits)
    state["breach"] = _spread(state["settled"], (first, last))
    return state, due


def _spread(a: list | None, b: tuple) -> list | None:
    """The first and last moment of both, None if there is none."""
    moments = [x for x in [*(a or ()), *b] if x is not None]
    return [min(moments), max(moments)] if moments else None


def shown(key: str, state: dict, version: int) -> list:
    """The row of a request, times as microseconds."""
    at, _, stage = state.get("stage", (None, None, None))
    breach = state["breach"]
    updated = max(state["last"], breach[1]) if breach else state["last"]
    return [key, stage, at, state["first"][2], state["first"][0], updated, breach is not None, breach[0] if breach else None, version]


def request_state_stream(events: DataFrame, rules: DataFrame, arrival_delay: str = "1 hour", keep: timedelta = timedelta(days=30)) -> DataFrame:
    """Changed rows of requests, numbered by ``version``, with what they replace, from a stream of canonical events.

    Files may come out of order of arrival by ``arrival_delay``. The state of a request stays as long as the stream does.
    """
    limits = rule_limits(rules)
    kept = int(keep / timedelta(microseconds=1))
    times = ("start_at", "end_at")

    def compact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pieces(pdf, limits)

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        clock = state.getCurrentWatermarkMs() * 1000
        due = None
        new: list[dict] = []
        for pdf in frames:
            columns = {c: micros(pdf[c]).tolist() for c in times}
            columns |= {c: [None if pd.isna(x) else x for x in pdf[c]] for c in ("event_id", "journey_stage", "department")}
            new += [dict(zip(columns, values)) for values in zip(*columns.values())]
        after, due = advance(held.get("state", {}), new, clock, kept, limits)
        row = shown(key[0], after, held.get("version", 0) + 1)
        changed = row[:-1] != held.get("row")
        state.update((json.dumps({"state": after, "row": row[:-1], "version": row[-1] if changed else held["version"]}),))
        if due is not None:
            state.setTimeoutTimestamp(max(due // 1000 + 1, clock // 1000 + 1))
        if changed:
            before = held.get("row") or [None] * len(STATE.names)
            row += [before[STATE.names.index(old)] for old in _OLD.values()]
            for place, field in enumerate(CHANGE.fields):
                if isinstance(field.dataType, T.TimestampType):
                    row[place] = pd.NaT if row[place] is None else pd.Timestamp(row[place], unit="us")
            yield pd.DataFrame([row], columns=CHANGE.names)

    given = events.select("request_id", "occurred_at", "id", "new_state", "department", "received_at")
    return (
        given.mapInPandas(compact, PIECE)
        .withWatermark("arrived_at", arrival_delay)
        .groupBy("request_id")
        .applyInPandasWithState(step, CHANGE, "held string", "append", GroupStateTimeout.EventTimeTimeout)
    )


def start_request_states(
    events: DataFrame, rules: DataFrame, store: Store, checkpoint: str, arrival_delay: str = "1 hour", keep: timedelta = timedelta(days=30)
):
    """Write the changed rows of requests to the store, in buckets of the request, and what they change in the day totals."""
    store = store.of("requests")
    store.claim(events.sparkSession, checkpoint)

    def write(rows: DataFrame, batch_id: int) -> None:
        store.write(rows.withColumn("bucket", bucket_of("request_id")), "request_states", batch_id, by="bucket")
        # Read back: the stateful frame of a micro-batch must be computed only once.
        own = read_batches(rows.sparkSession, CHANGE, store.path("request_states"), store.mine(batch_id))
        store.write(day_changes(own).coalesce(1), "day_changes", batch_id)

    states = request_state_stream(events, rules, arrival_delay, keep)
    return states.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def day_changes(rows: DataFrame) -> DataFrame:
    """What changed rows add to and take back from the totals by day of origin, department and stage."""

    def counted(df: DataFrame, old: bool, sign: int) -> DataFrame:
        stage, department, created, breached = (F.col(c) for c in (_OLD if old else _OLD.values()))
        return df.select(
            F.date_trunc("DAY", created).alias("day"), department.alias("department"), stage.alias("stage"),
            F.lit(sign).cast("bigint").alias("requests"), (F.lit(sign) * breached.cast("int")).cast("bigint").alias("breached"),
        )

    both = counted(rows, False, 1).unionByName(counted(rows.where(F.col("old_created_at").isNotNull()), True, -1))
    sums = both.groupBy("day", "department", "stage").agg(F.sum("requests").alias("requests"), F.sum("breached").alias("breached"))
    return sums.where((F.col("requests") != 0) | (F.col("breached") != 0))


def day_totals(spark: SparkSession, store: Store) -> DataFrame:
    """Requests and breaches by day of origin, department and stage, as the changes add up to now."""
    changes = read_batches(spark, DAY, store.path("day_changes"))
    sums = changes.groupBy("day", "department", "stage").agg(F.sum("requests").alias("requests"), F.sum("breached").alias("breached"))
    return sums.where(F.col("requests") != 0)


def trends_of(totals: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Volume and compliance per day, from totals of whole days: ``analytics.trends`` without reading a request."""
    check_trend_range(start, end)
    days = totals.where(F.col("day").between(F.date_trunc("DAY", instant(start)), instant(end))).groupBy("day")
    sums = days.agg(F.sum("requests").alias("volume"), F.sum("breached").alias("breached"))
    return sums.withColumn("compliance_rate", rate(F.col("volume"), F.col("breached")))


def compliance_of(totals: DataFrame, by: str) -> DataFrame:
    """Requests, breaches and compliance by ``department`` (missing: Unassigned) or ``stage``, from the totals."""
    name = F.coalesce(F.col(by), F.lit("Unassigned")) if by == "department" else F.col(by)
    sums = totals.groupBy(name.alias(by)).agg(F.sum("requests").alias("total"), F.sum("breached").alias("breached"))
    return sums.withColumn("compliance_rate", rate(F.col("total"), F.col("breached")))


def stored_requests(spark: SparkSession, store: Store, requests: DataFrame | None = None) -> DataFrame:
    """The latest row of every request, or of the given ones, of which only the buckets are read."""
    where = None
    if requests is not None:
        where = buckets_in(requests, bucket_of("request_id"))
    rows = read_batches(spark, STATE, store.path("request_states"), where)
    if requests is not None:
        rows = rows.join(requests.select("request_id").distinct(), "request_id", "left_semi")
    rest = [c for c in STATE.names if c != "request_id"]
    latest = rows.groupBy("request_id").agg(F.max_by(F.struct(*rest), "version").alias("_row"))
    return latest.select("request_id", "_row.*").drop("version")
