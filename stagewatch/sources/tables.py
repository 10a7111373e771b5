"""Domain tables on shared storage: declared-schema reads and idempotent writes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stagewatch import schema as S


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Scan a domain table with its declared schema; nothing is inferred."""
    return spark.read.schema(S.TABLES[name]).parquet(path)


def read_raw_events(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Raw payloads as a stream of JSON-lines files in the landing folder."""
    return (
        spark.readStream.schema(S.TABLES["raw_events"])
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )


def read_raw_events_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same raw schema from a Kafka topic; needs the public Kafka connector on the classpath."""
    stream = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("includeHeaders", "true")
        .load()
    )

    def header(name: str):
        found = F.filter("headers", lambda h: F.lower(h["key"]) == name)
        return F.get(found, F.lit(0))["value"].cast("string")

    return stream.select(
        F.concat_ws("-", "topic", "partition", "offset").alias("delivery_id"),
        F.col("value").cast("string").alias("raw"),
        header("x-source-system").alias("header_source"),
        header("x-signature-sha256").alias("signature"),
        F.col("timestamp").alias("received_at"),
    )


PARTITIONS = {
    "received_date": T.DateType(),
    "bucket": T.IntegerType(),
    "words": T.LongType(),
    "stream": T.StringType(),
    "batch_id": T.LongType(),
}


def write_batch(df: DataFrame, path: str, batch_id: int | None, stream: str | None, by: str | None = None) -> None:
    """Write one micro-batch as its own partition: a replayed batch replaces itself.

    Batch ids count from 0 per checkpoint, so a stream with a new checkpoint needs a new name.
    ``by`` adds a leading partition column for readers that prune on it. Without ``stream`` the rows name
    their streams and batches themselves.
    """
    if stream is not None:
        df = df.withColumns({"stream": F.lit(stream), "batch_id": F.lit(batch_id).cast("bigint")})
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*([by] if by else []), "stream", "batch_id")
        .parquet(path)
    )


def read_batches(spark: SparkSession, kind: T.StructType, path: str, where: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows written by ``write_batch``; ``where`` may test the partition columns, ``keep`` returns some of them.

    These are declared, as a table to which only empty batches were written has no partitions yet. A table that
    was never written is empty.
    """
    partitions = [T.StructField(name, t) for name, t in PARTITIONS.items() if name not in kind.names]
    try:
        df = spark.read.schema(T.StructType([*kind.fields, *partitions])).parquet(path)
        df.columns  # noqa: B018 a missing path shows when the plan is resolved
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], T.StructType([*kind.fields, *partitions]))
    if where is not None:
        df = df.where(where)
    return df.select(*kind.names, *keep)


def write_snapshot(rows: DataFrame, path: str) -> None:
    """Replace the partitions of the periods present in ``rows`` and leave all others alone."""
    (
        rows.withColumn("period_date", F.to_date("period_start"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_type", "period_date")
        .parquet(path)
    )


def write_events(events: DataFrame, path: str) -> None:
    """Append events by day; rows of a request lie together for row-group pruning."""
    (
        events.withColumn("event_date", F.to_date("occurred_at"))
        .sortWithinPartitions("event_date", "request_id", "occurred_at")
        .write.mode("append")
        .partitionBy("event_date")
        .parquet(path)
    )
