"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles. Shingles are ordered from rare to frequent; two sets of
Jaccard similarity t or more share at least ``m`` shingles of their prefixes, if each prefix is as long as a prefix
filter asks for plus m - 1. Each document chooses its own m: a longer prefix costs rows, more required matches
save candidates, and the least sum of both by the estimated frequencies of its prefix decides. A pair
must match the smaller of its two numbers. Pairs that match are verified exactly on the whole sets.

How it stays linear in groups of copies. Documents with equal sets are one class from the start. In hub rounds each
prefix shingle pairs its documents with one hub only; verified links make components, and only pairs
between components are tried again, with other hubs, while that yields links. The last round takes all pairs of the
prefix index whose documents still lie in different components, which are all that may join two more. Groups are never
listed as pairs; nothing is dropped or capped. A prefix shingle's positions
bound the overlap a pair can reach, and pairs that cannot reach the threshold are not made.

These links make the components; each other link lies within one. To count them all, the classes of a component meet in
tiles, each two blocks of bounded bytes whose sizes can be similar, and a tile counts what its sets share at once. That
compares different texts of one component pair by pair, in memory; copies stay one class, with their number as its weight.

Frequencies come from a count sketch of ``SKETCH`` cells over all documents, 4 MB whatever the input; it only
orders shingles, estimates costs and tells frequent shingles, the result does not depend on it.

Texts are hashed twice: for signatures and the sketch, and for prefixes. Most prefix shingles stand in one set only
and can match nobody. To find that out, prefixes go once to parts by shingle, packed column by column, and only shared
shingles become rows. A shingle too frequent for one task, by the sketch, is taken for shared and spread by set.

Words are runs of characters other than ASCII white space, with A-Z lower-cased; a document of fewer than five words is
one shingle. Shingles are 64-bit hashes, equal sets are found by 128 bits.

Defined cases: null, empty and blank texts have no shingles and link with nothing; a null doc_id joins its class and
links like others but names none, and comes back as its own component null; rows with one doc_id and different texts are joined with each
other through it; repeated rows give a row each; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stagewatch.llm.common import bounded, slices, stored, table, tidy
from stagewatch.llm.registry import query

SHINGLE = 5
PERCENT = 80  # 100 * intersection >= PERCENT * union
SKETCH = 1 << 20
SKETCH_PART = 1 << 16
MATCHES = (1, 2, 3, 4, 6, 8)
TOKEN_COST, PAIR_COST = 1.0, 1.0  # of a prefix row and of a candidate
SLICE_BYTES = 1 << 20  # of texts hashed at once, which takes some fifty times their bytes
FREQUENT = 1 << 16  # by the sketch, and eight times its mean: tokens of so many sets are spread
PACKED_BYTES = 16 << 20  # of a task's packed prefixes at once
PART_BYTES = 16 << 20  # of the prefixes that meet in one part, about
PREFIX_SHARE = 0.25  # of a set's shingles stand in its prefix, about
ROWS_OUT = 50_000
REMEMBERED = 200_000  # sets whose copies a task does not index again
LEAST_YIELD = 20  # hub rounds go on while one of so many pairs tried is a link
CHUNK = 256  # pairs of one document verified together
TILE = 256  # sets of a block, about
TILE_BYTES = 8 << 20  # of a block's sets, about
BAND = 1.3  # similar sets differ less in size, so they lie in one band of sizes or in two that border on each other
FEW = 8  # sets with a shingle: up to so many are counted pair by pair, more by a product
COLUMNS = 4096  # shingles of one product

_WORD = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words in ``data``; one pass whatever the words' lengths."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    # A word is the polynomial of its bytes; powers restart in blocks so that they need no inverse.
    lengths = ends - starts
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    powers = np.ones(int(lengths.max()), np.uint64)
    powers[1:] = _BASE
    powers = np.cumprod(powers)
    terms = _WORD[_LOWER[data[~space]]] * powers[at]
    sums = np.add.reduceat(terms, np.cumsum(lengths) - lengths)
    return starts, _mix(sums ^ lengths.astype(np.uint64) * _BASE)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and where each text's begin (one more than texts)."""
    column = column.cast(pa.large_string())
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    first = int(bounds[0])
    data = np.frombuffer(values, np.uint8)[first : int(bounds[-1])] if values is not None else np.zeros(0, np.uint8)
    bounds = bounds - first
    if column.null_count:
        kept = np.asarray(column.is_valid().to_numpy(zero_copy_only=False))
    else:
        kept = np.ones(len(column), bool)
    # Texts border on each other in the buffer: a space after each keeps their words apart.
    spaced = np.full(len(data) + len(column), 32, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(len(column)), np.diff(bounds))] = data
    starts, words = _word_hashes(spaced)
    borders = bounds + np.arange(len(column) + 1)
    of = np.searchsorted(borders, starts, side="right") - 1  # the text of each word
    counts = np.bincount(of, minlength=len(column))[: len(column)] * kept
    keep = kept[of]
    words, of = words[keep], of[keep]
    ends = np.cumsum(counts)
    # Windows of five, or the whole text where it is shorter.
    n = np.where(counts == 0, 0, np.maximum(counts - (SHINGLE - 1), 1))
    owner = np.repeat(np.arange(len(column)), n)
    begin = np.repeat(ends - counts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    last = ends[owner]
    h = np.zeros(len(begin), np.uint64)
    for k in range(SHINGLE):
        at = begin + k
        inside = at < last
        h = _mix(h * _BASE + np.where(inside, words[np.minimum(at, max(len(words) - 1, 0))], np.uint64(k + 1)))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[fresh], owner[fresh]
    return h, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(column)))))


def _signature(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set: two sums of differently mixed hashes, with the size."""
    n = np.diff(starts)
    out = []
    for salt in (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(hashes ^ salt))))
        out.append(_mix((total[starts[1:]] - total[starts[:-1]]) ^ n.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, sig, sig2) of every document, and (part, cells) of each task's count sketch in rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(SKETCH, np.uint32)
        for part in slices(batches, "text", SLICE_BYTES):
            hashes, starts = shingle_sets(part.column("text"))
            cells += np.bincount((hashes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
            one, two = _signature(hashes, starts)
            n = part.num_rows
            arrays = [part.column("doc_id"), pa.array(np.diff(starts)), pa.array(one), pa.array(two), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, _SIGNED)
        for number, own in enumerate(np.minimum(cells, 65535).astype(np.uint16).reshape(-1, SKETCH_PART)):
            if own.any():
                arrays = [*[pa.nulls(1, pa.int64())] * 4, pa.array([number], pa.int32()), pa.array([own.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, _SIGNED)

    return docs.mapInArrow(tidy(run), "doc_id long, n_shingles long, sig long, sig2 long, part int, cells binary")


_SIGNED = ["doc_id", "n_shingles", "sig", "sig2", "part", "cells"]


def frequencies(signed: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches; tasks that own a part add as they read."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                own = np.frombuffer(cells, np.uint16).astype(np.uint32)
                sums[part] = sums[part] + own if part in sums else own
        for part, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["part", "cells"])

    sketches = signed.where("part IS NOT NULL").select("part", "cells")
    found = sketches.repartition(SKETCH // SKETCH_PART, "part").mapInArrow(add, "part int, cells binary").collect()
    out = np.zeros(SKETCH, np.uint32)
    for r in found:
        out[r["part"] * SKETCH_PART : (r["part"] + 1) * SKETCH_PART] = np.frombuffer(r["cells"], np.uint32)
    return out


def needed(n: int) -> int:
    """Shingles that a set of n must share with any set similar to it."""
    return -(-PERCENT * n // 100)


def prefix(hashes: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """The set's prefix, rare shingles first, the number of matches it asks for, chosen by cost, and the prefix's counts."""
    n = len(hashes)
    seen = sketch[(hashes & np.uint64(SKETCH - 1)).astype(np.int64)]
    order = np.lexsort((hashes, seen))
    shortest = n - needed(n)
    best, matches = None, 1
    reach = np.cumsum(np.maximum(seen[order].astype(np.float64) - 1, 0))
    for m in MATCHES:
        length = shortest + m
        if length > n:
            break
        # At most reach / m documents stand in m of the prefix's lists.
        cost = TOKEN_COST * length + PAIR_COST * reach[length - 1] / m
        if best is None or cost < best:
            best, matches = cost, m
    kept = order[: shortest + matches]
    return hashes[kept], matches, seen[kept]


#: Columns of a packed prefix row.
PACKED = (("token", np.uint64), ("sig", np.int64), ("n", np.int32), ("at", np.int32), ("matches", np.int32))
ROW_BYTES = sum(np.dtype(t).itemsize for _, t in PACKED)


def _pack(rows: list[np.ndarray], chosen: np.ndarray) -> bytes:
    return b"".join(column[chosen].tobytes() for column in rows)


def _unpack(blobs: list[bytes]) -> list[np.ndarray]:
    columns: list[list[np.ndarray]] = [[] for _ in PACKED]
    for blob in blobs:
        n, at = len(blob) // ROW_BYTES, 0
        for column, (_, kind) in zip(columns, PACKED, strict=True):
            column.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(c) for c in columns]


def prefixes(docs: DataFrame, sketch: np.ndarray, parts: int) -> DataFrame:
    """(part, rows): the prefixes of all sets, packed, by part of the token; parts from ``parts`` on hold frequent tokens by set.

    A task gives a set once, as far back as it remembers; so copies are as many rows as tasks at most, not documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    frequent = max(FREQUENT, 8 * int(sketch.mean()))

    def packed(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
        *rows, seen = [np.concatenate(c) for c in columns]
        token, sig = rows[0], rows[1]
        part = np.where(seen < frequent, token >> np.uint64(40), np.uint64(0)) % np.uint64(parts)
        part = np.where(seen < frequent, part, np.uint64(parts) + (sig.view(np.uint64) >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        borders = np.flatnonzero(np.diff(part[order])) + 1
        chosen = np.split(order, borders)
        return pa.RecordBatch.from_arrays([pa.array([part[c[0]] for c in chosen], pa.int32()), pa.array([_pack(rows, c) for c in chosen], pa.binary())], ["part", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        columns: list[list[np.ndarray]] = [[] for _ in range(len(PACKED) + 1)]
        held = 0
        for part in slices(batches, "text", SLICE_BYTES):
            hashes, starts = shingle_sets(part.column("text"))
            sig, _ = _signature(hashes, starts)
            if len(given) > REMEMBERED:
                given.clear()
            for k in range(part.num_rows):
                own = hashes[starts[k] : starts[k + 1]]
                if len(own) and int(sig[k]) not in given:
                    given.add(int(sig[k]))
                    tokens, matches, seen = prefix(own, shared.value)
                    m = len(tokens)
                    row = (tokens, np.full(m, sig[k]), np.full(m, len(own), np.int32), np.arange(m, dtype=np.int32), np.full(m, matches, np.int32), seen)
                    for c, x in zip(columns, row, strict=True):
                        c.append(x)
                    held += m
            if held * ROW_BYTES > PACKED_BYTES:
                yield packed(columns)
                columns, held = [[] for _ in columns], 0
        if held:
            yield packed(columns)

    return docs.select("text").mapInArrow(tidy(run), "part int, rows binary")


def shared_tokens(packed: DataFrame, parts: int) -> DataFrame:
    """Prefix rows whose token stands in the prefixes of two different sets.

    ``rank`` counts a set's shared tokens: those before it that are not shared cannot be matched by anyone.
    ``common`` is the part of the set's prefix that is shared; an original has more of it than its altered copies.
    A pair asks for the smaller of its two numbers of matches, so a set goes only if it shares fewer tokens than the
    least number asked for by any set it meets, itself included. Frequent tokens, whose sets are spread, count as shared
    and as met by a set that asks for one match: that only keeps more.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A partition holds a few parts, each of bounded bytes.
        blobs: dict[bool, list[bytes]] = {False: [], True: []}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                blobs[part >= parts].append(blob)
        for frequent, own in blobs.items():
            if not own:
                continue
            token, sig, n, at, matches = _unpack(own)
            order = np.lexsort((sig, token))
            token, sig, n, at, matches = (x[order] for x in (token, sig, n, at, matches))
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
            token, sig, n, at, matches = (x[fresh] for x in (token, sig, n, at, matches))
            starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(token)])))
            asked = np.repeat(np.minimum.reduceat(matches, starts), sizes)
            kept = np.ones(len(token), bool) if frequent else np.repeat(sizes > 1, sizes)
            asked = np.ones_like(asked) if frequent else asked
            columns = [sig, token.view(np.int64), n, at, matches, asked]
            for k in range(0, int(kept.sum()), ROWS_OUT):
                chosen = np.flatnonzero(kept)[k : k + ROWS_OUT]
                yield pa.RecordBatch.from_arrays([pa.array(c[chosen]) for c in columns], ["sig", "token", "n", "at", "matches", "asked"])

    found = packed.repartition(parts, "part").mapInArrow(tidy(keep), "sig long, token long, n int, at int, matches int, asked int")
    of_set = Window.partitionBy("sig")
    ranked = found.withColumn("rank", F.row_number().over(of_set.orderBy("at"))).withColumn("n_shared", F.count("*").over(of_set))
    ranked = ranked.withColumn("asked", F.min("asked").over(of_set))
    common = F.col("n_shared") / (F.col("n") - F.ceil(F.col("n") * F.lit(PERCENT) / F.lit(100)) + F.col("matches"))
    return ranked.where("n_shared >= asked").withColumn("common", common).drop("n_shared", "asked")


def _can_reach(n1: Column, n2: Column, at1: Column, at2: Column, rank1: Column, rank2: Column, need: Column) -> Column:
    """Whether a match at these places is one of the ``need`` that a similar pair has at least.

    A similar pair shares ``overlap`` shingles, so it shares ``need`` among the first n - overlap + need of either set.
    Before the places it shares no more than the lesser rank, behind them no more than the lesser rest.
    """
    overlap = F.ceil((n1 + n2) * F.lit(PERCENT) / F.lit(100 + PERCENT))
    early = (at1 - need < n1 - overlap) & (at2 - need < n2 - overlap)
    enough = F.least(rank1, rank2) + F.least(n1 - at1, n2 - at2) - 1 >= overlap
    return early & enough & (n1 * 100 >= n2 * PERCENT) & (n2 * 100 >= n1 * PERCENT)


def _c(side: str, name: str) -> Column:
    return F.col(f"{side}.{name}")


def _pairs(left: DataFrame, right: DataFrame, extra: Column) -> DataFrame:
    """(a, b, need) for each place where two sets match and can still share enough; ``need`` is how many such the pair asks for."""
    need = F.least(_c("l", "matches"), _c("r", "matches"))
    reach = _can_reach(*[_c(s, c) for c in ("n", "at", "rank") for s in ("l", "r")], need)
    met = left.alias("l").join(right.alias("r"), (_c("l", "token") == _c("r", "token")) & extra & reach)
    a, b = F.least(_c("l", "sig"), _c("r", "sig")), F.greatest(_c("l", "sig"), _c("r", "sig"))
    return met.select(a.alias("a"), b.alias("b"), need.alias("need"))


def class_sets(sides: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, hashes): the sets of the classes in ``sides``, each from one of its documents; once a task at least."""
    chosen = stored(classes.select("sig", F.col("named").alias("doc_id")).join(sides, "sig"), "candidate-documents")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for part in slices(batches, "text", SLICE_BYTES):
            hashes, starts = shingle_sets(part.column("text"))
            own, wanted = _signature(hashes, starts)[0], part.column("sig").to_pylist()
            if len(given) > REMEMBERED:
                given.clear()
            # A doc_id may have other texts too; those are not of the class. Repeated rows give their set once a task.
            right = []
            for k, sig in enumerate(own.tolist()):
                if wanted[k] in (None, sig) and sig not in given:
                    given.add(sig)
                    right.append(k)
            blobs = [hashes[starts[k] : starts[k + 1]].tobytes() for k in right]
            yield pa.RecordBatch.from_arrays([pa.array(own[right], pa.int64()), pa.array(blobs, pa.binary())], ["sig", "hashes"])

    kind = "sig long, hashes binary"
    named = docs.where("doc_id IS NOT NULL").join(bounded(chosen.where("doc_id IS NOT NULL")), "doc_id").select("sig", "text")
    found = named.mapInArrow(tidy(sets), kind)
    nameless = chosen.where("doc_id IS NULL").select("sig")
    if not nameless.isEmpty():  # classes that only rows without a doc_id have: these rows give all their sets
        rest = docs.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("sig"), "text").mapInArrow(tidy(sets), kind)
        found = found.unionByName(rest.join(bounded(nameless), "sig", "left_semi"))
    return stored(found, "candidate-sets")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of sigs whose sets are similar, counted on the whole texts of one document of each class.

    Pairs are dealt by ``a`` in chunks, each with its own copy of a's set, so that a set with very many partners
    is no task's burden; a task holds one set and reads its partners one after another.
    """
    pairs = stored(pairs.select("a", "b"), "candidate-pairs")
    hashed = class_sets(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), docs, classes)

    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("chunks"))
    chunked = stored(pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), "chunks").alias("chunk")), "pair-chunks")
    # Sets are far wider than pairs: they stay where they are unless the pairs are too many to be sent to them.
    heads = hashed.withColumnRenamed("sig", "a").join(bounded(chunked.select("a", "chunk").distinct()), "a").withColumn("b", F.lit(None).cast("long"))
    members = hashed.withColumnRenamed("sig", "b").join(bounded(chunked), "b")
    names = ["a", "chunk", "b", "hashes"]
    dealt = heads.select(*names).unionByName(members.select(*names)).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.asc_nulls_first("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            left, right = [], []
            for a, b, blob in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "hashes")], strict=True):
                own = np.frombuffer(blob, np.uint64)
                if b is None:
                    head = own
                    continue
                both = len(np.intersect1d(head, own, assume_unique=True))
                if 100 * both >= PERCENT * (len(head) + len(own) - both):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    # A set that several tasks gave is compared as often.
    return stored(dealt.mapInArrow(tidy(compare), "a long, b long").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(id, least): of every linked id the least it can reach. Each turn points ids to the least of their
    neighbours (large star), then neighbours to each other's least (small star), until nothing changes."""
    edges = links.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("least")).where("id <> least").distinct()
    edges = stored(edges, "component-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("least").alias("id"), F.col("id").alias("least")))
        low = both.groupBy("id").agg(F.min("least").alias("m")).select("id", F.least("id", "m").alias("m"))
        large = both.join(low, "id").where("least > id").select(F.col("least").alias("id"), F.col("m").alias("least"))
        large = large.where("id <> least").distinct()
        lowest = large.groupBy("id").agg(F.min("least").alias("m"))
        small = large.join(lowest, "id").select(F.col("least").alias("id"), F.col("m").alias("least")).where("id <> least")
        edges = stored(small.unionByName(lowest.select("id", F.col("m").alias("least"))).distinct(), "component-edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("id", "least").cast("decimal(38,0)"))).first()
        if state == before:
            return edges
        before = state


def _placed(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """The rows of tokens that stand in several components, with their set's component as ``place``."""
    if links is None:
        return rows.withColumn("place", F.col("sig"))
    found = rows.join(components(links).withColumnRenamed("id", "sig"), "sig", "left")
    placed = found.withColumn("place", F.coalesce("least", "sig")).drop("least")
    mixed = placed.groupBy("token").agg(F.min("place").alias("p"), F.max("place").alias("q")).where("p < q")
    return stored(placed.join(mixed.select("token"), "token", "left_semi"), "open-tokens")


def _links(rows: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links that make the components: every pair of the index that is similar lies in one of theirs. ``link_counts`` counts the others too."""
    links = done = None
    turn = 0
    apart = _c("l", "place") != _c("r", "place")
    while True:
        open_rows = _placed(rows, links)
        # A token's hub: first the set most like an original, then others by turns.
        choice = F.struct("common", "sig") if turn == 0 else F.struct(F.xxhash64(F.lit(turn), "sig"), F.col("sig"))
        hubs = open_rows.groupBy("token").agg(F.max(choice).alias("hub")).select("token", F.col("hub.sig").alias("sig"))
        spokes = _pairs(open_rows.join(hubs, ["token", "sig"], "left_semi"), open_rows, apart).select("a", "b").distinct()
        spokes = stored(spokes if done is None else spokes.join(done, ["a", "b"], "left_anti"), "hub-pairs")
        found = verified(spokes, docs, classes)
        tried, fresh = spokes.count(), found.count()
        links = found if links is None else stored(links.unionByName(found), "links")
        done = spokes if done is None else stored(done.unionByName(spokes), "tried-pairs")
        turn += 1
        if fresh * LEAST_YIELD <= tried:
            break
    # Whatever may still join two components.
    open_rows = _placed(rows, links)
    rest = _pairs(open_rows, open_rows, apart & (_c("l", "sig") < _c("r", "sig"))).groupBy("a", "b").agg(F.count("*").alias("met"), F.max("need").alias("need"))
    more = verified(rest.where("met >= need").join(done, ["a", "b"], "left_anti"), docs, classes)
    return stored(links.unionByName(more), "all-links")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of the sets share."""
    k = len(sets)
    token, owner = np.concatenate(sets), np.repeat(np.arange(k), [len(x) for x in sets])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    fresh = np.concatenate(([True], token[1:] != token[:-1]))
    sizes = np.diff(np.append(np.flatnonzero(fresh), len(token)))
    held = np.repeat(sizes, sizes)
    few, by = token[held <= FEW], owner[held <= FEW]
    both = np.zeros(k * k, np.int64)
    for lag in range(1, min(FEW, len(few))):
        same = few[lag:] == few[:-lag]
        if not same.any():
            break
        both += np.bincount(by[:-lag][same] * k + by[lag:][same], minlength=k * k)
    both = both.reshape(k, k)
    both = both + both.T
    by, column = owner[held > FEW], np.cumsum(fresh[held > FEW]) - 1
    borders = np.searchsorted(column, np.arange(0, column[-1] + 1 + COLUMNS, COLUMNS)) if len(column) else []
    for i, (p, q) in enumerate(zip(borders[:-1], borders[1:], strict=True)):
        stands = np.zeros((k, COLUMNS), np.float32)
        stands[by[p:q], column[p:q] - i * COLUMNS] = 1
        both += (stands @ stands.T).astype(np.int64)
    return both


def link_counts(linked: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, links): the documents of other classes that are similar to a class, for each that has any.

    ``linked`` are the components (id, least), outside of which there are no links. A component that is no block of its
    own is divided by bands of sizes, and a band by hash into blocks.
    """
    ids = linked.select(F.col("id").alias("sig"), "least").unionByName(linked.select(F.col("least").alias("sig"), "least").distinct())
    weights = classes.groupBy("sig").agg(F.sum("size").alias("size"), F.max("n").alias("n"))
    members = stored(ids.join(weights, "sig"), "linked-classes")
    blocks = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") * 8 / TILE_BYTES))
    small = members.groupBy("least").agg((blocks == 1).alias("small"))
    band = F.when(F.col("small"), 0).otherwise(F.floor(F.log("n") / F.log(F.lit(BAND)))).cast("long")
    banded = stored(members.join(small, "least").withColumn("band", band), "banded-classes")
    bands = banded.groupBy("least", "band").agg(blocks.alias("blocks"))
    placed = banded.join(bands, ["least", "band"]).withColumn("block", F.pmod(F.xxhash64("sig"), "blocks"))

    cells = bands.select("least", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    one, two = cells.alias("l"), cells.alias("r")
    beside = ((_c("l", "band") == _c("r", "band")) & (_c("l", "block") <= _c("r", "block"))) | (_c("l", "band") + 1 == _c("r", "band"))
    tiles = one.join(two, (_c("l", "least") == _c("r", "least")) & beside).select(
        _c("l", "least").alias("least"), *[_c(s, c).alias(f"{c}_{s}") for s in ("l", "r") for c in ("band", "block")]
    )
    key = tiles.columns
    right = F.when((F.col("band_l") < F.col("band_r")) | (F.col("block_l") < F.col("block_r")), F.struct(F.lit(1).alias("side"), F.col("band_r").alias("band"), F.col("block_r").alias("block")))
    left = F.struct(F.lit(0).alias("side"), F.col("band_l").alias("band"), F.col("block_l").alias("block"))
    sides = tiles.withColumn("cell", F.explode(F.array_compact(F.array(left, right)))).select(*key, "cell.*")
    dealt = stored(placed.join(sides, ["least", "band", "block"]).select(*key, "side", "sig", "size"), "tiles")
    hashed = class_sets(members.select("sig"), docs, classes)
    rows = hashed.join(bounded(dealt), "sig").select(*key, "side", "sig", "size", "hashes")

    def counted(tile: list[tuple]) -> pa.RecordBatch:
        side, sig, size = (np.array(x, np.int64) for x in list(zip(*tile, strict=True))[:3])
        sets = [np.frombuffer(x[3], np.uint64) for x in tile]
        n, both = np.array([len(x) for x in sets]), shared_counts(sets)
        similar = 100 * both >= PERCENT * (n[:, None] + n[None, :] - both)
        # Blocks of their own are compared with themselves in another tile.
        similar &= side[:, None] != side[None, :] if side.any() else ~np.eye(len(sets), dtype=bool)
        links = similar @ size
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(sig[some], pa.int64()), pa.array(links[some], pa.int64())], ["sig", "links"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile = None, []
        for batch in batches:
            for *where, side, sig, size, hashes in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if where != at:
                    if len(tile) > 1:
                        yield counted(tile)
                    at, tile = where, []
                if not tile or tile[-1][:2] != (side, sig):  # several tasks may have given a set
                    tile.append((side, sig, size, hashes))
        if len(tile) > 1:
            yield counted(tile)

    found = rows.repartition(*key).sortWithinPartitions(*key, "side", "sig").mapInArrow(tidy(count), "sig long, links long")
    return stored(found.groupBy("sig").agg(F.sum("links").alias("links")), "link-counts")


def similar_components(docs: DataFrame, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) and n_links of every document.

    n_links is the number of other documents (rows) that the document is linked with, copies included; it is left out
    without ``count_links``.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = stored(signatures(docs), "signatures")
    signed = sketched.where("part IS NULL").drop("part", "cells")
    classes = stored(
        signed.where("n_shingles > 0").groupBy("sig", "sig2").agg(F.min("doc_id").alias("named"), F.count("*").alias("size"), F.max("n_shingles").alias("n")), "classes"
    )
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(1, int(total * PREFIX_SHARE * ROW_BYTES) // PART_BYTES)
    rows = stored(shared_tokens(prefixes(docs, frequencies(sketched), parts), parts), "shared-tokens")
    every = _links(rows, docs, classes)

    # Where a doc_id has several texts, its classes meet through it.
    own = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    split_ids = own.groupBy("doc_id").agg(F.min("sig").alias("a"), F.max("sig").alias("q")).where("a < q").select("doc_id", "a")
    repeated = stored(own.join(split_ids, "doc_id").select("a", F.col("sig").alias("b")).where("a <> b").distinct(), "split-ids")
    linked = components(every)
    whole = linked if repeated.isEmpty() else components(every.unionByName(repeated))
    # From classes to documents: a component is named by its least doc_id.
    place = F.coalesce("least", "sig")
    of_class = classes.join(whole.withColumnRenamed("id", "sig"), "sig", "left").select("sig", "sig2", "size", "named", place.alias("place"))
    of_class = of_class.join(of_class.groupBy("place").agg(F.min("named").alias("component")), "place").select("sig", "sig2", "size", "component")
    if count_links:
        of_class = of_class.join(link_counts(linked, docs, classes), "sig", "left")
    found = signed.join(of_class, ["sig", "sig2"], "left")
    some = F.col("n_shingles") > 0
    component = F.when(some & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    if not count_links:
        return found.select("doc_id", "n_shingles", component)
    n_links = F.when(some, F.coalesce("links", F.lit(0)) + F.col("size") - 1).otherwise(F.lit(0)).cast("long").alias("n_links")
    return found.select("doc_id", "n_shingles", component, n_links)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, the one that names it; documents without shingles or doc_id all stay."""
    found = similar_components(docs, count_links=False)
    extra = found.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(stored(extra, "near-copies"), "doc_id", "left_anti")
    return kept.select(*docs.columns)


@query("op6_jaccard_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")
