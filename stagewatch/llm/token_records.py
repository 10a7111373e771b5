"""Token sequences as length-delimited binary records, with an offset index for shuffled reads.

A record is: length of the body (8 bytes), masked checksum of those 8 bytes (4), the body, masked checksum
of the body (4), a line feed; all numbers little-endian. The checksum is CRC-32; the mask rotates it by
15 bits and adds a constant, so that a checksum of data that holds checksums is no trivial value. The
body is the document's doc_id (8 bytes signed), the width of an id (1 byte: 2 or 4) and its token ids, unsigned, in
the width that the largest of them needs.

Files hold ascending doc_id ranges, in the order of their numbers, and are written by Spark's text writer
with the line feed as separator, so its commit protocol covers them. The index is a table of its own:
file, offset and length of each record, and how many ids all documents before it have.

Defined cases: a null text is empty and has the end id alone; a null doc_id sorts first and comes back
null; rows with one doc_id follow each other in any order; an empty table gives an empty index; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stagewatch.llm.common import shared_folder, slices, stored, table, texts
from stagewatch.llm.registry import query

#: Bytes of text in a file; about as many bytes of records, which a reading task holds at once.
FILE_BYTES = 16 << 20

# Fixed values
MASK = 0xA282EAD8
NO_ID = -(2**63)
END_OF_TEXT = "<|endoftext|>"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(body: bytes) -> bytes:
    """The record without the line feed, which the writer adds."""
    size = struct.pack("<Q", len(body))
    return b"".join((size, struct.pack("<I", masked(size)), body, struct.pack("<I", masked(body))))


def unframe(data: bytes, at: int) -> tuple[int, bytes]:
    """Offset behind the record at ``at``, and its body; ValueError where a check fails."""
    if at + 12 > len(data):
        raise ValueError(f"record head cut off at {at}")
    size, check = struct.unpack_from("<QI", data, at)
    if masked(data[at : at + 8]) != check:
        raise ValueError(f"length checksum differs at {at}")
    end = at + 12 + size
    if end + 5 > len(data):
        raise ValueError(f"record cut off at {at}")
    body = data[at + 12 : end]
    if masked(body) != struct.unpack_from("<I", data, end)[0] or data[end + 4 : end + 5] != b"\n":
        raise ValueError(f"body checksum differs at {at}")
    return end + 5, body


def body_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return struct.pack("<qB", NO_ID if doc_id is None else doc_id, width) + ids.astype(f"<u{width}").tobytes()


def ids_of(body: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids, as 32-bit numbers, of a record's body."""
    doc_id, width = struct.unpack_from("<qB", body)
    return None if doc_id == NO_ID else doc_id, np.frombuffer(body, f"<u{width}", offset=9).astype("<u4")


class ByteEncoder:
    """Ids of a text as the tokenizers library gives them for the same vocabulary."""

    def __init__(self, ranks_path: str, pattern: str, special_id: int):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {END_OF_TEXT: special_id}
        self.encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all")


def byte_encoder(ranks: str | None = None) -> Callable[[], ByteEncoder]:
    """Makes the encoder in a task; ``ranks`` is the vocabulary's path there."""

    def make() -> ByteEncoder:
        import public_tokenizers as public

        # The vocabulary has no entry for the end of text: its id is the first free one.
        path = ranks or public.path("byte_bpe_50k.tiktoken")
        return ByteEncoder(path, public.PATTERN, special_id=50256)

    return make


def write_records(docs: DataFrame, path: str, encoder: Callable[[], Callable[[str], np.ndarray]], end_id: int = 0) -> None:
    """Encode (doc_id, text), end each sequence with ``end_id`` and write the records in ascending doc_id order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // FILE_BYTES))
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = encoder()
        for part in slices(batches, "text"):
            ids = part.column("doc_id").to_pylist()
            out = [frame(body_of(i, np.append(encoded(text), end_id))) for i, text in zip(ids, texts(part, "text"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # The text is dealt out before it is encoded, so that finding the ranges does not encode it too.
    ordered = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    framed = ordered.mapInArrow(encode, "value binary")
    framed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


_READ = "file string, part int, offset long, length long, doc_id long, n_tokens long, before long, ids_crc32 long, ids binary"
_READ_ARROW = pa.schema(
    [
        ("file", pa.string()),
        ("part", pa.int32()),
        *[(n, pa.int64()) for n in ("offset", "length", "doc_id", "n_tokens", "before", "ids_crc32")],
        ("ids", pa.binary()),
    ]
)


def read_records(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Every record below ``path`` with its place, checks made; ``before`` counts the ids before it in its file."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                part = int(re.search(r"part-(\d+)", file)[1])
                rows, at, before, held = [], 0, 0, 0
                while at < len(data):
                    after, body = unframe(data, at)
                    doc_id, numbers = ids_of(body)
                    ids, n = numbers.tobytes(), len(numbers)
                    rows.append((file, part, at, after - at, doc_id, n, before, zlib.crc32(ids), ids if with_ids else None))
                    at, before, held = after, before + n, held + 100 + len(ids) * with_ids
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(walk, _READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ_ARROW, strict=True)], schema=_READ_ARROW)


def offset_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of the records below ``path``: doc_id, file, offset, length, start, n_tokens, ids_crc32.

    Only one row per file takes part in the running sum over files.
    """
    placed = stored(read_records(spark, path, with_ids=False).drop("ids"), "record-places")
    totals = placed.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    return placed.join(starts, "part").select(
        "doc_id", "file", "offset", "length", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids as array) of the index rows ``wanted``, in any order: a shuffled read by file and offset.

    What is gathered for a file is bounded by the records it holds.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    places = wanted.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places"))
    record = F.explode("places")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ids_of(unframe(x, 0)[1]) for x in batch.column(0).to_pylist()]
            arrays = [pa.array([i for i, _ in found], pa.int64())]
            arrays.append(pa.array([ids.astype("i8") for _, ids in found], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids"])

    cut = files.join(places, "file").select("content", record.alias("p"))
    one = cut.select(F.substring("content", F.col("p.offset").cast("int") + 1, F.col("p.length").cast("int")).alias("record"))
    return one.mapInArrow(decode, "doc_id long, ids array<long>")


@query("op8_token_records")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "records")
    write_records(table(spark, sf_dir, "documents"), path, byte_encoder())
    return offset_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
