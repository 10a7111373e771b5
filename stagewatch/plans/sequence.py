"""Order-dependent columns per key that stay parallel when one key is huge.

A window over a key sorts all rows of that key in one task. That is right for ordinary keys and
wrong for a key that holds a large share of the table. ``hot_keys`` finds the latter from one
column; ``sequence`` cuts only those keys into time chunks of about equal size, runs the window per
(key, chunk) and repairs the chunk borders from one small row per chunk. Which keys are cut, and
where, changes the plan, never the result.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

MIN_ROWS = 1_000_000  # keys with fewer rows are never cut
MAX_KEYS = 10_000  # any key beyond the largest ones holds less than 1/10,000 of the rows
SAMPLE = 1 / 256
ROWS_PER_CHUNK = 1_000_000
MAX_CHUNKS = 4096  # per key
MAX_BORDERS = 50_000  # of all keys together, about
SAMPLES_PER_CHUNK = 4


def hot_keys(df: DataFrame, key: str, min_rows: int = MIN_ROWS, fraction: float = SAMPLE) -> dict:
    """The largest keys with about ``min_rows`` rows or more, and their estimated sizes.

    Counted on a sample of one column, which costs a scan and a small shuffle. The sample only
    steers the plan; ``MAX_KEYS`` bounds what reaches the driver.
    """
    rows = (
        df.where(F.col(key).isNotNull())
        .select(key)
        .sample(fraction, seed=17)
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_rows * fraction)
        .orderBy(F.desc("n"))
        .limit(MAX_KEYS)
        .collect()
    )
    return {row[key]: int(row["n"] / fraction) for row in rows}


@dataclass
class Sequence:
    """Columns to derive: 1-based position, next and previous value and running sum within the key.

    A running sum takes in the row's own value.
    """

    position: str | None = None
    lead: dict[str, str] = field(default_factory=dict)
    lag: dict[str, str] = field(default_factory=dict)
    running: dict[str, str] = field(default_factory=dict)


def sequence(
    df: DataFrame,
    key: str,
    at: str,
    tie: str,
    want: Sequence,
    hot: dict | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add the wanted columns, ordering the rows of each key by (``at``, ``tie``).

    ``hot`` is the outcome of ``hot_keys``; it is looked up when not given. ``at`` must be a
    timestamp without nulls, ``tie`` must make the order total.
    """
    if hot is None:
        hot = hot_keys(df, key)
    if not hot:
        return _with_windows(df, Window.partitionBy(key).orderBy(at, tie), want)
    return _chunked(df, key, at, tie, want, hot, rows_per_chunk)


def _with_windows(df: DataFrame, window, want: Sequence) -> DataFrame:
    columns = {}
    if want.position:
        columns[want.position] = F.row_number().over(window).cast("bigint")
    columns.update({out: F.lead(c).over(window) for out, c in want.lead.items()})
    columns.update({out: F.lag(c).over(window) for out, c in want.lag.items()})
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns.update({out: F.coalesce(F.sum(c).over(so_far), F.lit(0)) for out, c in want.running.items()})
    return df.withColumns(columns)


def _chunk_borders(df: DataFrame, key: str, at: str, tie: str, hot: dict, rows_per_chunk: int) -> DataFrame:
    """One row per hot key with the sorted (time, tie) pairs at which it is cut.

    The borders are rows of a sample, about SAMPLES_PER_CHUNK for each chunk, so they also divide
    rows of one instant. MAX_BORDERS and MAX_KEYS bound the sample.
    """
    spark, total = df.sparkSession, sum(hot.values())
    size = max(rows_per_chunk, total // MAX_BORDERS)
    chunks = {k: min(MAX_CHUNKS, max(2, -(-n // size))) for k, n in hot.items()}
    fraction = min(1.0, SAMPLES_PER_CHUNK * sum(chunks.values()) / total)
    rows = (
        df.where(F.col(key).isin(list(hot)))
        .select(key, F.unix_micros(at).alias("at"), F.col(tie).alias("tie"))
        .sample(fraction, seed=17)
        .collect()
    )
    points: dict = defaultdict(list)
    for row in rows:
        points[row[key]].append((row["at"], row["tie"]))
    # The collected pairs become literals, so that every use of the borders, also after a lost
    # executor, cuts the rows at the same places.
    data = []
    for k, found in points.items():
        found.sort()
        data.append((k, sorted({found[i * len(found) // chunks[k]] for i in range(1, chunks[k])})))
    pair = T.StructType([T.StructField("at", T.LongType()), T.StructField("tie", df.schema[tie].dataType)])
    shape = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("_borders", T.ArrayType(pair))])
    return spark.createDataFrame(data, shape)


def chunk_of(borders: Column, value: Column) -> Column:
    """Number of sorted borders at or below the value, by binary search; 0 without borders."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(MAX_CHUNKS.bit_length()))])

    def advance(found: Column, step: Column) -> Column:
        fits = F.get(borders, found + step - F.lit(1)) <= value
        return F.when(fits, found + step).otherwise(found)

    return F.when(borders.isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), advance))


def _chunked(df, key, at, tie, want, hot, rows_per_chunk):
    borders = _chunk_borders(df, key, at, tie, hot, rows_per_chunk)
    place = F.struct(F.unix_micros(at).alias("at"), F.col(tie).alias("tie"))
    cut = (
        df.join(F.broadcast(borders), key, "left")
        .withColumn("_chunk", chunk_of(F.col("_borders"), place))
        .withColumn("_hot", F.col("_borders").isNotNull())
        .drop("_borders")
    )
    order = F.struct(F.col(at), F.col(tie))
    # One row per chunk of a hot key: its size and the values at its two ends.
    facts = {"_rows": F.count(F.lit(1))}
    facts.update({f"_head_{c}": F.min_by(F.struct(c), order) for c in set(want.lead.values())})
    facts.update({f"_tail_{c}": F.max_by(F.struct(c), order) for c in set(want.lag.values())})
    facts.update({f"_sum_{c}": F.coalesce(F.sum(c), F.lit(0)) for c in set(want.running.values())})
    chunks = cut.where("_hot").groupBy(key, "_chunk").agg(*[e.alias(n) for n, e in facts.items()])
    along = Window.partitionBy(key).orderBy("_chunk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    before = F.sum("_rows").over(earlier)
    ends = chunks.select(
        key,
        "_chunk",
        F.coalesce(before, F.lit(0)).alias("_before"),
        *[F.lead(f"_head_{c}").over(along).alias(f"_next_{c}") for c in set(want.lead.values())],
        *[F.lag(f"_tail_{c}").over(along).alias(f"_prev_{c}") for c in set(want.lag.values())],
        *[F.sum(f"_sum_{c}").over(earlier).alias(f"_so_far_{c}") for c in set(want.running.values())],
    )
    window = Window.partitionBy(key, "_chunk").orderBy(at, tie)
    edge = {"_first": F.row_number().over(window) == 1, "_last": F.lead(F.lit(1)).over(window).isNull()}
    joined = _with_windows(cut, window, want).withColumns(edge).join(
        F.broadcast(ends), [key, "_chunk"], "left"
    )
    fixed = {}
    if want.position:
        fixed[want.position] = F.col(want.position) + F.coalesce("_before", F.lit(0))
    for out, c in want.lead.items():
        fixed[out] = F.when(F.col("_last"), F.col(f"_next_{c}")[c]).otherwise(F.col(out))
    for out, c in want.lag.items():
        fixed[out] = F.when(F.col("_first"), F.col(f"_prev_{c}")[c]).otherwise(F.col(out))
    for out, c in want.running.items():
        fixed[out] = F.col(out) + F.coalesce(f"_so_far_{c}", F.lit(0))
    added = [n for n in (want.position, *want.lead, *want.lag, *want.running) if n]
    return joined.withColumns(fixed).select(*df.columns, *added)
