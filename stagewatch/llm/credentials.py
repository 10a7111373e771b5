"""Secrets in texts, weak ones only where the parts of a credential stand together.

Three base kinds follow fixed patterns and are always reported. Beside them there are parts that mean nothing alone: names
of accounts, short or unnamed values that may be secrets, addresses of services. A pass over the texts, read whole
where they lie, lists the parts of each document with their scope, a block of lines without an empty one. Parts are then
joined by their intervals: two of one scope link if no more than ``REACH`` characters lie between them. For
that, each interval, the weak part's widened by the reach, goes to all buckets of ``REACH`` characters that it
covers, and a pair meets in the first bucket that both cover. A document's intervals of one kind don't overlap, so
the buckets are bounded by the texts' length and one bucket holds few parts, whatever the document's size.

What a weak part needs among its links is stated in ``NEEDS``: a named value an account or a service, an unnamed
one both or an access key, an account's name a secret. Base spans serve as parts as well. A part without its
complement isn't reported. ``links`` gives the credentials themselves.

Defined cases: a null or empty text has no spans; documents are told apart by doc_id and text, so a repeated row gives the
same row again, and null doc_ids are kept; a weak part that overlaps a base span, or a weak part of a kind
named earlier, is no part; an empty table gives no rows; columns other than doc_id and text are ignored, whatever
their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stagewatch.llm.common import slices, stored, table, texts
from stagewatch.llm.registry import query

# Kinds in order, base patterns, patterns and words of the weak parts.
BASE = ("assign", "access", "hex")
WEAK = ("secret", "bare", "identifier")
KINDS = (*BASE, *WEAK)
SERVICE = len(KINDS)  # number of the kind of services, which are never reported
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}+")
SIGN = r"""["']?\x20{0,3}[:=]\x20{0,3}["']?"""
NAMED = re.compile(rf"""\b(?:password|passwd|passphrase|pass|pwd|secret[_-]?key|secret|private[_-]?key|api[_-]?key|auth[_-]?key|token){SIGN}[^\s"',;]{{4,}}+""", re.A | re.I)
ACCOUNT = re.compile(rf"""\b(?:user[_-]?name|user[_-]?id|user|login|client[_-]?id|account[_-]?id|account|access[_-]?key(?:[_-]?id)?){SIGN}[^\s"',;]{{2,}}+|\b(?:AKIA|ASIA)[A-Z0-9]{{8,}}+""", re.A | re.I)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
ADDRESS = re.compile(
    rf"""\b(?:https?|ftps?|sftp|ssh|jdbc:[a-z]{{2,12}}|postgres(?:ql)?|mysql|mongodb|redis|amqps?|ldaps?|s3)://[^\s"'<>]++"""
    rf"""|(?<![\w.-])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++:[0-9]{{2,5}}+\b|\b(?:host[_-]?name|host|endpoint|server|base[_-]?url){SIGN}[^\s"',;]{{3,}}+""",
    re.A | re.I,
)
BLOCK_END = re.compile(r"\n[ \t\r]*\n")
LEAST_BITS = 3.5  # entropy of a character of an unnamed value
REACH = 200  # characters between two parts of one credential

#: What each weak kind needs among its links.
NEEDS = {"secret": "account OR service", "bare": "access_key OR (account AND service)", "identifier": "value"}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base kinds, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def looks_random(value: str) -> bool:
    """Letters of both cases and digits, spread like random ones."""
    if not (any(map(str.isdigit, value)) and any(map(str.islower, value)) and any(map(str.isupper, value))):
        return False
    return sum(-n / len(value) * log2(n / len(value)) for n in Counter(value).values()) >= LEAST_BITS


class Taken:
    """Spans that a weak part must not overlap."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.spans = sorted((a, b) for a, _, b in spans)
        self.starts = [a for a, _ in self.spans]
        self.ends: list[int] = []  # greatest end so far
        for _, b in self.spans:
            self.ends.append(max(b, self.ends[-1] if self.ends else 0))

    def free(self, start: int, end: int) -> bool:
        before = bisect_right(self.starts, end - 1)
        return not before or self.ends[before - 1] <= start


def weak_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of parts that count in company only, and of services."""
    found: list[tuple[int, int, int]] = []
    patterns = {"secret": NAMED, "identifier": ACCOUNT, "bare": TOKEN}
    taken = Taken(base)
    for kind, pattern in patterns.items():
        new = [m.span() for m in pattern.finditer(text)]
        new = [(a, KINDS.index(kind), b) for a, b in new if taken.free(a, b) and (kind != "bare" or looks_random(text[a:b]))]
        if new:
            found += new
            taken = Taken([*base, *found])
    if not found:
        return []
    return sorted([*found, *[(m.start(), SERVICE, m.end()) for m in ADDRESS.finditer(text)]])


PART = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("scope", pa.int64())])
PARTS = "array<struct<start:long,kind:int,end:long,scope:long>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), base and weak parts of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            bases, weaks = [], []
            for text in texts(part, "text"):
                base = base_spans(text)
                weak = weak_parts(text, base)
                ends = [m.start() for m in BLOCK_END.finditer(text)] if weak else []
                for out, spans in ((bases, base), (weaks, weak)):
                    out.append([{"start": a, "kind": k, "end": b, "scope": bisect_right(ends, a)} for a, k, b in spans])
            arrays = [part.column("doc_id"), part.column("key"), pa.array(bases, pa.list_(PART)), pa.array(weaks, pa.list_(PART))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "base", "weak"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("key"), "text")
    return keyed.mapInArrow(run, f"doc_id long, key string, base {PARTS}, weak {PARTS}")


def _buckets(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / REACH), F.floor(end / REACH)))


def links(scanned: DataFrame) -> DataFrame:
    """(doc_id, key, start, kind, end, other_start, other_kind, other_end): weak parts, each with the parts near it."""
    open_rows = scanned.where(F.size("weak") > 0).select("doc_id", "key", F.explode(F.concat("base", "weak")).alias("p")).distinct()
    parts = open_rows.select("doc_id", "key", "p.scope", "p.start", "p.kind", "p.end")
    weak = parts.where((F.col("kind") >= len(BASE)) & (F.col("kind") < SERVICE)).withColumn("_low", F.greatest(F.col("start") - REACH, F.lit(0)))
    weak = weak.withColumn("bucket", _buckets(F.col("_low"), F.col("end") + REACH)).alias("a")
    other = parts.select("doc_id", "key", "scope", *[F.col(c).alias(f"other_{c}") for c in ("start", "kind", "end")])
    other = other.withColumn("bucket", _buckets(F.col("other_start"), F.col("other_end"))).alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    for c in ("key", "scope", "bucket"):
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    near = (F.col("other_start") <= F.col("end") + REACH) & (F.col("other_end") >= F.col("_low"))
    itself = (F.col("start") == F.col("other_start")) & (F.col("kind") == F.col("other_kind"))
    first = F.col("a.bucket") == F.greatest(F.floor(F.col("_low") / REACH), F.floor(F.col("other_start") / REACH))
    return weak.join(other, same & near & first & ~itself).select(
        "a.doc_id", "a.key", "start", "kind", "end", "other_start", "other_kind", "other_end"
    )


def supported(linked: DataFrame) -> DataFrame:
    """(doc_id, key, start, kind, end) of the weak parts whose complement stands near."""

    def met(*kinds: str) -> Column:
        return F.bool_or(F.col("other_kind").isin([KINDS.index(k) for k in kinds]))

    found = linked.groupBy("doc_id", "key", "start", "kind", "end").agg(
        met("access", "identifier").alias("account"), met("access").alias("access_key"), met("assign", "hex", "secret", "bare").alias("value"),
        F.bool_or(F.col("other_kind") == SERVICE).alias("service"),
    )
    enough = F.lit(False)
    for kind, need in NEEDS.items():
        enough = enough | ((F.col("kind") == KINDS.index(kind)) & F.expr(need))
    return found.where(enough).select("doc_id", "key", "start", "kind", "end")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and added spans, each an array of (start, kind, end) in order, of every row."""
    scanned = stored(scan(docs), "credential-parts")
    added = supported(links(scanned)).groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))

    def plain(name: str) -> Column:
        return F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    none = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    rows = scanned.withColumns({"base": plain("base"), "open": F.size("weak") > 0}).drop("weak")
    shut = rows.where(~F.col("open")).select("doc_id", "base", none.alias("added"))
    a, b = rows.where("open").alias("a"), added.alias("b")
    met = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")), "left")
    return shut.unionByName(met.select("a.doc_id", "base", F.coalesce("added", none).alias("added")))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, with commas between."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op13_linked_secrets")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    return find(table(spark, sf_dir, "documents")).select(
        "doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.sort_array(F.concat("base", "added"))).alias("spans")
    )
