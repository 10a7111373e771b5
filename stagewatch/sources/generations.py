"""Tables whose pieces are replaced whole, so that a job that dies half way neither loses nor doubles a row.

A piece (a day, a run) is written under a new generation number first; nobody reads it yet. Then one small file, the
pointers, names the generation of each piece. Readers take each piece from the generation that its latest pointer names. A
job that stops before the switch leaves a generation that no pointer names, and the next one writes over it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

MAX_PIECES = 100_000  # whose pointers are sent to every task

POINTER = T.StructType(
    [T.StructField("piece", T.StringType()), T.StructField("mark", T.TimestampType()), T.StructField("generation", T.LongType())]
)
_PLACE = [T.StructField("piece", T.StringType()), T.StructField("generation", T.LongType())]


def _read(spark: SparkSession, kind: T.StructType, path: str) -> DataFrame:
    try:
        df = spark.read.schema(kind).parquet(path)
        df.columns  # noqa: B018 a missing path shows when the plan is resolved
        return df
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kind)


def pointers(spark: SparkSession, path: str) -> DataFrame:
    """(piece, mark, generation): the generation in which each piece is to be read."""
    every = _read(spark, POINTER, f"{path}-pointers")
    latest = every.groupBy("piece").agg(F.max_by(F.struct("mark", "generation"), "generation").alias("_row"))
    return latest.select("piece", "_row.*")


def next_generation(spark: SparkSession, path: str) -> int:
    """One more than the last generation that was switched to; what a stopped job left under it is written over."""
    last = _read(spark, POINTER, f"{path}-pointers").agg(F.max("generation")).first()[0]
    return 0 if last is None else last + 1


def copy(rows: DataFrame, path: str, generation: int) -> None:
    """Write rows with their ``piece`` under a generation that no reader looks at yet."""
    (
        rows.withColumn("generation", F.lit(generation).cast("bigint"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("piece", "generation").parquet(path)
    )


def switch(pieces: DataFrame, path: str, generation: int) -> None:
    """Let readers see the pieces (piece, mark) in the generation: one file, so all of them or none."""
    marked = pieces.select("piece", F.col("mark").cast("timestamp").alias("mark"))
    (
        marked.withColumn("generation", F.lit(generation).cast("bigint")).coalesce(1)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("generation").parquet(f"{path}-pointers")
    )


def read(spark: SparkSession, kind: T.StructType, path: str, held: DataFrame | None = None) -> DataFrame:
    """Rows of all pieces, each from its generation, with their ``piece``; ``held`` are pointers read before."""
    rows = _read(spark, T.StructType([*kind.fields, *_PLACE]), path)
    held = (pointers(spark, path) if held is None else held).select("piece", "generation")
    few = held.limit(MAX_PIECES + 1).count() <= MAX_PIECES
    return rows.join(F.broadcast(held) if few else held, ["piece", "generation"]).select(*kind.names, "piece")
