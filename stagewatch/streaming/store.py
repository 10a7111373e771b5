"""The store that the streaming jobs share, and what finds rows in it without reading the rest.

Every sink writes a micro-batch as its own partition, named by the job and the batch, so a batch that is replayed after a
failure replaces what it wrote before. Jobs of one store have names of their own: a job's kind is part of its name, and a
name belongs to one checkpoint (``Store.claim``).

Ids of stored events lie in ``BUCKETS`` hash buckets, one file per bucket and batch. Each file has a Bloom filter, kept as
rows of 64-bit words: an id sets ``HASHES`` bits of one word. A micro-batch meets the filters' words in one join on (bucket,
word); what it hits names the files to open, and their ids decide. Alerts and the log of their transitions lie in
buckets of the request, so that a batch opens those of its requests only.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stagewatch import schema as S
from stagewatch.operators.lifecycle import apply_log
from stagewatch.operators.listing import page_after
from stagewatch.sources.tables import read_batches, write_batch

MAX_BROADCAST_BYTES = 64 << 20  # of a batch's ids, which meet the store
ID_OVERHEAD = 40  # bytes of a broadcast row besides its id
BUCKETS = 16
BITS_PER_ID = 12
HASHES = 4
MAX_FILES = 5_000  # of the id index that are named one by one; beyond, its buckets are

LOG = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("state", T.StringType()),
     T.StructField("by", T.StringType()), T.StructField("at", T.TimestampType())]
)
ID = T.StructType([T.StructField("id", T.StringType())])
FILTER = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("word", T.LongType()), T.StructField("bits", T.LongType())])
CLAIM = T.StructType([T.StructField("checkpoint", T.StringType())])
DAYS = T.StructType(
    [T.StructField("day", T.DateType()), T.StructField("first_arrival", T.DateType()),
     T.StructField("last_arrival", T.DateType()), T.StructField("events", T.LongType())]
)


def bucket_of(key: str | Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def alert_bucket(alert_id: str | Column) -> Column:
    """Bucket of an alert: of its request, which its id begins with."""
    return bucket_of(F.substring_index(alert_id, "|", 1))


def buckets_in(keys: DataFrame, bucket: Column) -> Column:
    """Condition on the ``bucket`` partitions that hold some of the keys, ``BUCKETS`` at most."""
    found = [r[0] for r in keys.select(bucket.alias("b")).distinct().collect()]
    return F.col("bucket").isin(found) if found else F.lit(False)


@dataclass(frozen=True)
class Store:
    """Folders of one store on shared storage, and the name of the stream that writes them."""

    root: str
    stream: str = "main"
    kind: str = ""

    @property
    def name(self) -> str:
        """What a job's partitions are named by; jobs of different kinds never share it."""
        return f"{self.stream}-{self.kind}" if self.kind else self.stream

    def of(self, kind: str) -> Store:
        """The store as a job of the given kind writes it."""
        return self if self.kind else replace(self, kind=kind)

    def claim(self, spark: SparkSession, checkpoint: str) -> None:
        """Tie the name to the checkpoint; refused if another checkpoint's job has it, whose batches it would overwrite."""
        held = read_batches(spark, CLAIM, self.path("streams"), F.col("stream") == self.name).first()
        if held is None:
            self.write(spark.createDataFrame([(checkpoint,)], CLAIM), "streams", 0)
        elif held["checkpoint"] != checkpoint:
            raise ValueError(f"the stream {self.name!r} of this store belongs to the checkpoint {held['checkpoint']!r}")

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def write(self, df: DataFrame, name: str, batch_id: int, by: str | None = None) -> None:
        write_batch(df, self.path(name), batch_id, self.name, by)

    def write_alerts(self, alerts: DataFrame, batch_id: int) -> None:
        self.write(alerts.withColumn("bucket", alert_bucket("id")), "alerts", batch_id, by="bucket")

    def write_events(self, events: DataFrame, batch_id: int) -> None:
        """Events lie by day of arrival, so that recent ones are found without reading the rest.

        Their ids are written first: a batch that stops in between is replayed and writes the same events, and
        until then another job takes copies of them for duplicates, as they are.
        """
        self.write_ids(events, batch_id)
        arrival = F.to_date("received_at")
        days = events.groupBy(F.to_date("occurred_at").alias("day")).agg(
            F.min(arrival).alias("first_arrival"), F.max(arrival).alias("last_arrival"), F.count(F.lit(1)).alias("events")
        )
        self.write(days.coalesce(1), "event_days", batch_id)
        self.write(events.withColumn("received_date", F.to_date("received_at")), "events", batch_id, by="received_date")

    def write_ids(self, events: DataFrame, batch_id: int) -> None:
        keyed = events.select("id", bucket_of("id").alias("bucket"))
        self.write(keyed.repartition("bucket").sortWithinPartitions("bucket"), "event_ids", batch_id, by="bucket")
        filters = bloom_words(keyed, []).repartition("words").sortWithinPartitions("words", "bucket", "word")
        self.write(filters, "id_filters", batch_id, by="words")

    def mine(self, batch_id: int) -> Column:
        return (F.col("stream") == self.name) & (F.col("batch_id") == batch_id)

    def earlier(self, batch_id: int) -> Column:
        """Partitions of other streams, and of this one those of batches before the given one."""
        return (F.col("stream") != self.name) | (F.col("batch_id") < batch_id)

    def before(self, spark: SparkSession, name: str, batch_id: int, since: date | None = None, where: Column | None = None) -> DataFrame:
        """A table as it was without the given batch; events optionally from a day of arrival on."""
        kept = ~self.mine(batch_id)
        if since is not None:
            kept = kept & (F.col("received_date") >= F.lit(since))
        return read_batches(spark, S.TABLES[name], self.path(name), kept if where is None else kept & where)

    def alerts_before(self, spark: SparkSession, batch_id: int, requests: DataFrame) -> DataFrame:
        """Alerts of the buckets that hold the given requests, without those of the given batch, in their present state."""
        near = buckets_in(requests, bucket_of("request_id"))
        log = read_batches(spark, LOG, self.path("alert_log"), near)
        return apply_log(self.before(spark, "alerts", batch_id, where=near), log)

    def of_batch(self, spark: SparkSession, name: str, batch_id: int) -> DataFrame:
        return read_batches(spark, S.TABLES[name], self.path(name), self.mine(batch_id))

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return read_batches(spark, S.TABLES[name], self.path(name))


def first_day(batch: DataFrame, within_days: int | None) -> date | None:
    """Day from which stored events matter to a batch, or None for all of them."""
    if within_days is None:
        return None
    first = batch.agg(F.to_date(F.min("received_at"))).first()[0]
    return first - timedelta(days=within_days) if first else None


def batch_ids(ids: DataFrame) -> DataFrame:
    """The distinct ids of a cached batch, broadcast while their bytes are at most MAX_BROADCAST_BYTES."""
    ids = ids.select("id").distinct()
    size = ids.agg(F.sum(F.octet_length("id") + ID_OVERHEAD)).first()[0] or 0
    return F.broadcast(ids) if size <= MAX_BROADCAST_BYTES else ids


def _place(words: Column) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(1)), words)


def _mask() -> Column:
    """The bits that an id sets in its word."""
    spread = F.xxhash64("id", F.lit(2))
    mask = F.lit(0).cast("bigint")
    for k in range(HASHES):
        bit = F.shiftrightunsigned(spread, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return mask


def bloom_words(keyed: DataFrame, of: list[str]) -> DataFrame:
    """(of..., bucket, words, word, bits): a filter per bucket and ``of``, sized by its ids to a power of two of words."""
    file = [*of, "bucket"]
    n = F.count(F.lit(1)) * BITS_PER_ID / 64
    size = F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(n)), F.lit(0))).cast("bigint")
    sizes = keyed.groupBy(*file).agg(size.alias("words"))
    return (
        keyed.join(sizes, file).withColumns({"word": _place(F.col("words")), "mask": _mask()})
        .groupBy(*file, "words", "word").agg(F.bit_or("mask").alias("bits"))
    )


def candidate_files(spark: SparkSession, store: Store, ids: DataFrame, batch_id: int) -> Column | None:
    """Condition on the partitions of ``event_ids`` that may hold some of the ids; None if none can."""
    others = ~store.mine(batch_id)
    filters = read_batches(spark, FILTER, store.path("id_filters"), others, keep=("words", "stream", "batch_id"))
    # Sizes are powers of two, a few dozen at most, and name the folders.
    sizes = [r["words"] for r in filters.select("words").distinct().collect()]
    if not sizes:
        return None
    near = buckets_in(ids, bucket_of("id"))
    words = F.explode(F.array(*[F.lit(s).cast("bigint") for s in sizes]))
    asked = ids.select("id", bucket_of("id").alias("bucket"), words.alias("words"), _mask().alias("mask")).withColumn("word", _place(F.col("words")))
    asked = asked.select("bucket", "words", "word", "mask").distinct()
    met = filters.where(near).join(asked, ["bucket", "words", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    hit = [tuple(r) for r in met.select("bucket", "stream", "batch_id").distinct().limit(MAX_FILES + 1).collect()]
    if not hit:
        return None
    if len(hit) > MAX_FILES:
        return others & near
    named = F.concat_ws("/", F.col("bucket").cast("string"), F.col("stream"), F.col("batch_id").cast("string"))
    return F.col("bucket").isin(sorted({b for b, _, _ in hit})) & named.isin([f"{b}/{s}/{n}" for b, s, n in hit])


def known_ids(spark: SparkSession, store: Store, judged: DataFrame, batch_id: int, since: date | None = None) -> DataFrame:
    """Stored ids that occur in the batch, its own earlier write left out.

    The filters name the files that are read. With ``since``, a day, only events that arrived from then on are
    compared, by their day. A batch's ids are broadcast where they are few; else both sides are shuffled.
    """
    ids = batch_ids(judged)
    if since is not None:
        return store.before(spark, "events", batch_id, since).select("id").join(ids, "id", "left_semi")
    where = candidate_files(spark, store, ids, batch_id)
    if where is None:
        return spark.createDataFrame([], ID)
    return read_batches(spark, ID, store.path("event_ids"), where).join(ids, "id", "left_semi")


def repeated_ids(spark: SparkSession, store: Store, judged: DataFrame, batch_id: int, since: date | None = None) -> DataFrame:
    """``known_ids`` as written for the batch: read from a table of its own, they stay as they are when the index grows."""
    store.write(known_ids(spark, store, judged, batch_id, since), "repeated_ids", batch_id)
    return read_batches(spark, ID, store.path("repeated_ids"), store.mine(batch_id))


def events_after(spark: SparkSession, store: Store, size: int, last: tuple | None = None) -> DataFrame:
    """The page of live events, newest first, behind the row ``last`` = (time, id) of the page before.

    The days of events, a row per day and batch, say how far back a page reaches and on which days those events arrived:
    only the partitions of these arrival days are read.
    """
    days = read_batches(spark, DAYS, store.path("event_days"))
    if last is not None:
        days = days.where(F.col("day") <= F.lit(last[0].date()))
    known = days.groupBy("day").agg(F.sum("events").alias("n"), F.min("first_arrival").alias("a"), F.max("last_arrival").alias("b"))
    reach, first, until, oldest = 0, None, None, None
    # Newest days first, as many as hold a page behind the last row's own day.
    for r in known.orderBy(F.desc("day")).limit(MAX_FILES).collect():
        reach += r["n"] if last is None or r["day"] < last[0].date() else 0
        first, until = (r["a"], r["b"]) if first is None else (min(first, r["a"]), max(until, r["b"]))
        oldest = r["day"]
        if reach >= size:
            break
    events = read_batches(spark, S.TABLES["events"], store.path("events"), keep=("received_date",))
    if reach >= size:
        near = F.col("received_date").between(F.lit(first), F.lit(until)) & (F.col("occurred_at") >= F.lit(oldest).cast("timestamp"))
        events = events.where(near)
    return page_after(events.drop("received_date"), size, last)


def index_events(spark: SparkSession, store: Store) -> None:
    """Write ids and filters of all stored events, for a store that was written before it had them."""
    events = read_batches(spark, ID, store.path("events"), keep=("stream", "batch_id"))
    keyed = events.withColumn("bucket", bucket_of("id"))
    write_batch(keyed.repartition("bucket", "stream", "batch_id"), store.path("event_ids"), None, None, by="bucket")
    filters = bloom_words(keyed, ["stream", "batch_id"]).repartition("stream", "batch_id", "words")
    write_batch(filters.sortWithinPartitions("stream", "batch_id", "words", "bucket", "word"), store.path("id_filters"), None, None, by="words")
