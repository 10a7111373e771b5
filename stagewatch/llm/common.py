"""Shared by the corpus operators: declared reads, intermediate tables on shared storage, Arrow slices."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

CHECKPOINT = "spark.checkpoint.dir"

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_LIBC = ctypes.CDLL(None)

#: Side of a join that may be sent to every task: counted rows and their bytes.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20

#: Rows handed to Python at once; long texts are cut into further slices by their bytes.
ARROW_ROWS = 1_000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: bounded Arrow batches and skew-split joins."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` below the session's ``spark.checkpoint.dir``.

    Only where that is unset and all tasks run in this process, as in tests, a folder of this machine is taken; a
    cluster must name one that its machines share.
    """
    root = spark.conf.get(CHECKPOINT, None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[0-9*,]+\])?", master):
            raise ValueError(f"{CHECKPOINT} names no shared folder, and {master!r} has several machines")
        root = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set(CHECKPOINT, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table on shared storage and read it back: lineage ends here, no executor is needed again."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bytes(df: DataFrame) -> Column:
    """About what a row takes: its texts and 16 bytes a column."""
    size = F.lit(16 * len(df.columns)).cast("bigint")
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif not isinstance(f.dataType, T.AtomicType):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0))
    return size


def bounded(small: DataFrame) -> DataFrame:
    """``small`` marked for broadcast if it is, counted and measured, small enough; else as it is, to be joined by shuffle."""
    rows = small.select(_bytes(small).alias("size")).limit(BROADCAST_ROWS + 1)
    n, size = rows.agg(F.count("*"), F.sum("size")).first()
    return F.broadcast(small) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``most`` bytes in each; a longer value is a slice of its own."""
    for batch in batches:
        start, held = 0, 0
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for row, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column as text, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


class Recent(dict):
    """A bounded cache of two generations: what is asked for again is carried over, the rest goes.

    A generation is full at ``most`` entries, or at ``most_bytes`` of what ``keep`` was told its entries hold.
    """

    def __init__(self, most: int, most_bytes: int | None = None):
        super().__init__()
        self.most, self.most_bytes, self.held, self.older = most, most_bytes, 0, {}

    def keep(self, key, value, size: int) -> None:
        self[key] = value
        self.held += size

    def missing(self, wanted: set) -> list:
        """Members of ``wanted`` in neither generation; the others are in this one now."""
        if len(self) > self.most or (self.most_bytes is not None and self.held > self.most_bytes):
            self.older = dict(self)
            self.clear()
            self.held = 0
        out = []
        for x in wanted.difference(self):
            found = self.older.get(x)
            if found is None:
                out.append(x)
            else:
                self[x] = found
        return out


def give_back() -> None:
    """Return freed memory of this worker to the system, so that an idle worker keeps none from the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def tidy(run: Run) -> Run:
    """``run`` for ``mapInArrow``, giving its memory back when a task ends."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
