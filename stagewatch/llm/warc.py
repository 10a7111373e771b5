"""WARC archives: a writer with revisit records and a reader that salvages what damage leaves.

The reader walks each file from record to record and checks what it reads: the version line, the header
block, Content-Length, the blank lines behind the block, the block digest, and for gzip members their own
checksum. After a failed check it searches for the next version line or member header that passes all of
them; the bytes between become a gap row (file, start, end, reason), and reading goes on behind it.

Files are written by Spark's text writer, whose record separator is WARC's (two CRLF), so the commit
protocol covers them and any file system Spark knows can hold them. A file gets as many records as make up
``FILE_BYTES`` on average and stay below ``LARGEST_FILE`` at their longest, as a reading task holds one file at a time.

Defined cases: a null payload is empty; payloads below ``REVISIT_BYTES`` never make revisits; rows with
equal payload and the same largest page_id are all responses; a null page_id is written as such, comes
back as null and neither makes nor is a revisit; a null url is left out; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stagewatch.llm.common import bounded, shared_folder, stored, table
from stagewatch.llm.registry import query

FILE_BYTES = 16 << 20
REVISIT_BYTES = 1000
HEAD_LENGTH = 600  # a header block and HTTP headers, about
LARGEST_FILE = 1 << 30  # if all of a file's records were as long as the longest; Spark hands over files below 2 GB

EOL, END = "\r\n", "\r\n\r\n"
HTTP_HEAD = f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{END}"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
k AS (SELECT *, payload_bytes >= {REVISIT_BYTES} AND page_id < max(page_id) OVER (PARTITION BY payload_digest) AS again,
        max(page_id) OVER (PARTITION BY payload_digest) AS largest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN largest END AS refers_to FROM k
"""


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, refers_to) of the pages whose payload a page with a larger page_id has too."""
    narrow = pages.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("size"))
    narrow = narrow.where(F.col("size") >= REVISIT_BYTES).where("page_id IS NOT NULL")
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"))
    repeated = groups.where("least < refers_to").select("digest", "refers_to")
    return narrow.join(repeated, "digest").where("page_id < refers_to").select("page_id", "refers_to").distinct()


def write_warc(pages: DataFrame, path: str) -> None:
    """One record per row of (page_id, url, html) below ``path``; equal payloads of size become revisits."""
    pages = pages.select("page_id", "url", "html")
    size = F.coalesce(F.octet_length("html"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0)) + HEAD_LENGTH
    mean, longest = pages.agg(F.avg(size), F.max(size)).first()
    per_file = 1 if mean is None else max(1, min(int(FILE_BYTES // mean), LARGEST_FILE // longest))
    # Joined by page_id, not by digest: a payload that a third of all pages share stays spread out. Pages are
    # moved only where the revisits are too many to be sent to them.
    rows = pages.join(bounded(stored(revisits(pages), "revisits")), "page_id", "left")

    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    again = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    block = F.when(again, F.lit(HTTP_HEAD).cast("binary")).otherwise(F.concat(F.lit(HTTP_HEAD).cast("binary"), payload))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    head = F.concat_ws(
        EOL,
        F.lit("WARC/1.1"),
        field("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", urn("page_id")),
        field("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        field("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]", "")),
        F.when(again, field("WARC-Refers-To", urn("refers_to"))),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(payload))),
        field("WARC-Payload-Length", F.octet_length(payload).cast("string")),
        field("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1("block"))),
        field("Content-Length", F.octet_length("block").cast("string")),
    )
    record = F.concat(F.concat(head, F.lit(END)).cast("binary"), F.col("block"))
    rows.withColumn("block", block).select(record.cast("string").alias("value")).write.options(
        lineSep=END, maxRecordsPerFile=per_file
    ).text(path)


class Damaged(Exception):
    """A check that failed; the message is the gap's reason."""


_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\r\n")
_CANDIDATE = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")


def _digest_holds(digest: str, block: bytes) -> bool:
    """A SHA-1 digest, in hex or base32, is the block's; others are not checked."""
    kind, _, value = digest.partition(":")
    if kind.lower() == "sha1" and len(value) == 40:
        return hashlib.sha1(block).hexdigest() == value.lower()
    if kind.lower() == "sha1" and len(value) == 32:
        return base64.b32encode(hashlib.sha1(block).digest()).decode() == value.upper()
    return True


def _plain(data: bytes, at: int) -> tuple[int, dict[str, str], bytes]:
    """End, fields and block of the record at ``at``."""
    if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n"), at):
        raise Damaged("no version line")
    # Line by line: a header block may be as long as it likes, and one without end stops at the first line that is none.
    fields, k = {}, at + 10
    while not data.startswith(b"\r\n", k):
        m = _FIELD.match(data, k)
        if not m:
            raise Damaged("malformed header line" if data.find(b"\r\n", k) >= 0 else "header block without end")
        fields[m[1].decode("ascii").lower()] = m[2].decode("utf-8", "replace")
        k = m.end()
    if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")):
        raise Damaged("no valid Content-Length")
    start = k + 2
    end = start + int(fields["content-length"])
    if end > len(data):
        raise Damaged("block cut off")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("no blank lines behind the block")
    block = data[start:end]
    digest = fields.get("warc-block-digest", "")
    if not _digest_holds(digest, block):
        raise Damaged("block digest differs")
    return end + 4, fields, block


def _member(data: bytes, at: int) -> tuple[int, list[tuple[dict[str, str], bytes]]]:
    """End and records of the gzip member at ``at``; zlib tests its checksum and length."""
    stream = zlib.decompressobj(31)
    try:
        inner = stream.decompress(memoryview(data)[at:])
    except zlib.error as error:
        raise Damaged("gzip member: " + str(error).split(":")[-1].strip()) from error
    if not stream.eof:
        raise Damaged("gzip member cut off")
    records, k = [], 0
    while k < len(inner):
        k, fields, block = _plain(inner, k)
        records.append((fields, block))
    return len(data) - len(stream.unused_data), records


def scan(data: bytes) -> Iterator[tuple]:
    """("record", start, end, fields, block) and ("gap", start, end, reason) in order; together they cover all bytes."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            if data.startswith(b"\x1f\x8b", at):
                end, records = _member(data, at)
            else:
                end, fields, block = _plain(data, at)
                records = [(fields, block)]
        except Damaged as error:
            if gap is None:
                gap, reason = at, str(error)
            m = _CANDIDATE.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at, reason
            gap = None
        for fields, block in records:
            yield "record", at, end, fields, block
        at = end
    if gap is not None:
        yield "gap", gap, len(data), reason


SCANNED = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("gap", T.StringType()),  # reason, null for records
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to_id", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)

_ARROW = pa.schema(
    [(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in SCANNED.fields]
)


def _payload(fields: dict[str, str], block: bytes) -> bytes:
    """The block without HTTP headers, where it has them."""
    if "application/http" in fields.get("content-type", ""):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _row(file: str, found: tuple, with_payload: bool) -> dict:
    kind, start, end, *rest = found
    row = dict.fromkeys(_ARROW.names) | {"file": file, "start": start, "end": end}
    if kind == "gap":
        return row | {"gap": rest[0]}
    fields, block = rest
    row |= {
        "record_type": fields.get("warc-type"),
        "record_id": fields.get("warc-record-id"),
        "target_uri": fields.get("warc-target-uri"),
        "refers_to_id": fields.get("warc-refers-to"),
    }
    if row["record_type"] == "revisit":
        length = fields.get("warc-payload-length", "")
        return row | {
            "payload_digest": fields.get("warc-payload-digest", "").partition(":")[2].lower() or None,
            "payload_bytes": int(length) if length.isdecimal() else None,
        }
    body = _payload(fields, block)
    return row | {
        "payload_digest": hashlib.sha1(body).hexdigest(),
        "payload_bytes": len(body),
        "payload": body if with_payload else None,
    }


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of all files below ``path``; ``records`` and ``gaps`` select either.

    A revisit's digest and length are those its header states of the full payload.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, held = [], 0
                file = batch.column(0)[k].as_py()
                for found in scan(batch.column(1)[k].as_py()):
                    row = _row(file, found, with_payload)
                    rows.append(row)
                    held += 200 + len(row["payload"] or b"")
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(walk, SCANNED)


def records(scanned: DataFrame) -> DataFrame:
    return scanned.where("gap IS NULL").drop("gap")


def gaps(scanned: DataFrame) -> DataFrame:
    """The quarantine log: file, first byte, byte behind the last, reason."""
    return scanned.where("gap IS NOT NULL").select("file", "start", "end", F.col("gap").alias("reason"))


@query("op1_warc_salvage", ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    scanned = read_warc(spark, path, with_payload=False)
    # An archive just written has no gaps; if it had, a page would be missing.
    broken = F.raise_error(F.concat(F.lit("gap in an archive just written: "), F.col("file"), F.lit(", "), F.col("gap"))).cast("boolean")
    whole = scanned.where(F.when(F.col("gap").isNotNull(), broken).otherwise(F.lit(True)))
    return whole.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to_id").alias("refers_to"),
    )
