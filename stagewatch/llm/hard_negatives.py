"""Hard-negative mining over rotated one-bit codes with stored alignments.

Vectors are scaled to integers. Each is turned by one fixed random rotation, and of every turned component only the
sign is kept: a code of one bit a dimension. Beside it stand the vector's length and its alignment, the cosine
between the vector and the code taken as a vector of +-1/sqrt(d). An anchor's turned components are rounded to four
bits, so the product of anchor and code is a sum of popcounts, off by no more than the known rounding. What the code
leaves out of a vector is orthogonal to the code; by Cauchy-Schwarz its product with the anchor is at most
the product of both residuals, whose lengths follow from the alignment. That gives each pair an interval that surely
holds its score. Pairs whose interval misses what is asked are gone; the others are scored in integers.

First the best rows of its own label are found for each anchor, its positives; then, for each positive, the best
rows of other labels whose score lies between two shares of the positive's. Rows are dealt into cells, anchors into
groups, each of bounded bytes, and each group meets each cell once; in a cell rows lie by label, so that own and other
labels are slices, whatever share one label holds. A bounded sample of rows sets each anchor's first bar; it
only saves work, as the bar is reached by rows that are there. No cap is set on candidates, the result is exact.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite component take no part; a
shorter vector has zeros behind its end; every row stands for itself, so rows that repeat a vec_id are each other's
candidates and, as anchors, are answered one by one; scores that tie go by vec_id; a positive with a score below zero has
no negatives, as the range between its shares is empty; anchors without positives give no rows, nor does an empty
table; other columns are ignored, whatever their names. Scores are whole numbers of 64 bits; one beyond them is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stagewatch.llm.common import stored, table
from stagewatch.llm.registry import query

CELL_BYTES = 4 << 20  # of the rows of a cell, as eight bytes a component
GROUP_BYTES = 1 << 20
SEED_BYTES = 1 << 20  # of the sample that sets the first bars
SEED_ROWS = 2048
BITS = 4  # of an anchor's rounded components
FIRST = 64  # rows scored before the bar of a positive is set in a cell
ROTATION = 20240229  # seed of the rotation
CODED = "row long, vec_id long, label long, v array<long>, norm double, align double, code binary"


def labelled_vectors(rows: DataFrame, scale: int, label: Column | str = "label") -> DataFrame:
    """(row, vec_id, label, v): floor(scale * x) of the usable rows, each with a number of its own."""
    label = F.col(label) if isinstance(label, str) else label
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = rows.where(F.col("vec_id").isNotNull() & label.isNotNull() & F.col("embedding").isNotNull() & finite)
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return usable.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        label.cast("long").alias("label"), scaled.alias("v"),
    )


@lru_cache(maxsize=2)
def rotation(width: int) -> np.ndarray:
    """An orthogonal matrix, the same in every process."""
    return np.linalg.qr(np.random.default_rng(ROTATION).standard_normal((width, width)))[0]


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors of whole numbers as rows, zeros behind their ends."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    sizes = np.diff(ends)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(ends[:-1] - ends[0], sizes)] = column.flatten().to_numpy()
    return out


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits of each row as 64-bit words."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view("<u8")


def codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector its length, its alignment with its code, and the code."""
    width = v.shape[1]
    turned = v.astype(float) @ rotation(width)
    norm = np.sqrt((turned * turned).sum(1))
    align = np.divide(np.abs(turned).sum(1), norm * np.sqrt(width), out=np.zeros(len(v)), where=norm > 0)
    return norm, np.minimum(align, 1.0), _words(turned > 0)


def encode(vectors: DataFrame, width: int) -> DataFrame:
    """The vectors with norm, align and code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm, align, code = codes(matrix(batch.column("v"), width))
            arrays = [batch.column(c) for c in ("row", "vec_id", "label", "v")]
            arrays += [pa.array(norm), pa.array(align), pa.array([c.tobytes() for c in code], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "vec_id", "label", "v", "norm", "align", "code"])

    return vectors.mapInArrow(run, CODED)


class Cell:
    """Rows by label, with what intervals and scores need."""

    def __init__(self, rows: pa.Table, width: int):
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("label", "ascending"), ("vec_id", "ascending"), ("row", "ascending")]))
        self.row, self.vec_id, self.label = (rows.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        self.v = matrix(rows.column("v"), width)
        self.floats = self.v.astype(float)
        self.norm, self.align = rows.column("norm").to_numpy(), rows.column("align").to_numpy()
        self.rest = np.sqrt(np.maximum(0.0, 1 - self.align**2))
        self.code = np.frombuffer(b"".join(rows.column("code").to_pylist()), "<u8").reshape(len(self.row), -(-width // 64))
        self.ones = np.bitwise_count(self.code).sum(1).astype(float)
        self.most = float(np.abs(self.floats).max(initial=0.0))

    def own(self, label: int) -> slice:
        return slice(int(np.searchsorted(self.label, label, "left")), int(np.searchsorted(self.label, label, "right")))

    def intervals(self, asked: Asked, part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Estimates of the scores of a slice of rows, and the bounds that surely hold them."""
        code, norm, align = self.code[part], self.norm[part], self.align[part]
        ones = sum(float(1 << j) * np.bitwise_count(code & plane).sum(1) for j, plane in enumerate(asked.planes))
        guess = (2 * (asked.least * self.ones[part] + asked.step * ones) - asked.total) / asked.root
        near = np.maximum(0.0, np.abs(guess) - asked.off)
        rest = self.rest[part] * np.sqrt(np.maximum(0.0, asked.norm**2 - near**2))
        spread = norm * (align * asked.off + rest) + 1e-9 * norm * asked.norm + 1e-6
        guess = norm * align * guess
        return guess, guess - spread, guess + spread

    def scores(self, asked: Asked, rows: np.ndarray) -> np.ndarray:
        """Whole scores: in doubles where these are exact, else in Python's integers."""
        if self.most * asked.most * self.v.shape[1] < 2**52:
            return (self.floats[rows] @ asked.floats).astype(np.int64)
        return (self.v[rows].astype(object) @ asked.v.astype(object)).astype(np.int64)


class Asked:
    """An anchor's vector turned and rounded to a few bits, as planes of bits."""

    def __init__(self, v: np.ndarray):
        self.v, self.floats = v, v.astype(float)
        turned = self.floats @ rotation(len(v))
        self.norm, self.root, self.most = float(np.sqrt((turned * turned).sum())), np.sqrt(len(v)), float(np.abs(self.floats).max(initial=0.0))
        self.least = float(turned.min())
        self.step = (float(turned.max()) - self.least) / (2**BITS - 1) or 1.0
        small = np.rint((turned - self.least) / self.step).astype(np.int64)
        rounded = self.least + self.step * small
        self.total = float(rounded.sum())
        self.off = float(np.abs(turned - rounded).sum()) / self.root
        self.planes = [_words((small[None, :] >> j & 1).astype(bool))[0] for j in range(BITS)]


def _best(cell: Cell, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties by vec_id."""
    return np.lexsort((cell.row[rows], cell.vec_id[rows], -scores))[:k]


def positives_in(cell: Cell, asked: Asked, row: int, label: int, k: int, bar: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the k best other rows of the anchor's label in the cell that reach the bar."""
    part = cell.own(label)
    _, low, high = cell.intervals(asked, part)
    other = cell.row[part] != row
    if np.count_nonzero(other) > k:
        bar = max(bar, np.partition(low[other], -k)[-k])
    rows = part.start + np.flatnonzero(other & (high >= bar))
    scores = cell.scores(asked, rows)
    best = _best(cell, rows, scores, k)
    return rows[best], scores[best]


def negatives_in(cell: Cell, asked: Asked, label: int, ranges: list[tuple[int, int]], k: int, bars: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each range of scores (rows, scores) of the k best rows of other labels in it that reach the range's bar."""
    guess, low, high = cell.intervals(asked, slice(0, len(cell.row)))
    low[cell.own(label)], high[cell.own(label)] = np.inf, -np.inf
    bars = [max(bar, least) for bar, (least, _) in zip(bars, ranges, strict=True)]
    rows, scores = np.empty(0, np.int64), np.empty(0, np.int64)

    def inside(least: int, most: int) -> np.ndarray:
        return np.flatnonzero((scores >= least) & (scores <= most))

    def reach(limit: int | None) -> np.ndarray:
        """Rows that may lie in a range at its bar or above; of each range only the ``limit`` nearest to its upper end."""
        wanted = np.zeros(len(cell.row), bool)
        for bar, (_, most) in zip(bars, ranges, strict=True):
            may = np.flatnonzero((high >= bar) & (low <= most))
            if limit and len(may) > limit:
                may = may[np.argpartition(np.abs(guess[may] - most), limit)[:limit]]
            wanted[may] = True
        wanted[rows] = False
        return np.flatnonzero(wanted)

    for limit in (FIRST, None):
        new = reach(limit)
        rows, scores = np.concatenate([rows, new]), np.concatenate([scores, cell.scores(asked, new)])
        found = [inside(*r) for r in ranges]
        bars = [max(bar, float(np.partition(scores[i], -k)[-k])) if len(i) >= k else bar for bar, i in zip(bars, found, strict=True)]
    out = []
    for i in found:
        i = i[_best(cell, rows[i], scores[i], k)]
        out.append((rows[i], scores[i]))
    return out


FOUND = "anchor_row long, place int, bar double, vec_id long, row long, score long"


def _answer(anchors: pa.Table, cell: Cell, width: int, k: int, shares: tuple[int, int] | None) -> pa.Table:
    """For each anchor, or with ``shares`` each of its positives, the cell's best rows; ``bar`` is the least of k whole ones."""
    v = matrix(anchors.column("v"), width)
    row, label = anchors.column("row").to_pylist(), anchors.column("label").to_pylist()
    bars = anchors.column("bars").to_pylist() if "bars" in anchors.column_names else [None] * len(v)
    positives = anchors.column("scores").to_pylist() if shares else [()] * len(v)
    out: list[tuple] = []
    for n in range(len(v)):
        asked = Asked(v[n])
        if shares is None:
            bar = bars[n][0] if bars[n] else -np.inf
            found = [positives_in(cell, asked, row[n], label[n], k, bar)]
        else:
            ranges = [(-(-shares[0] * s // 100), shares[1] * s // 100) for s in positives[n]]
            known = bars[n] or []
            found = negatives_in(cell, asked, label[n], ranges, k, [b if b is not None else -np.inf for b in [*known, *[None] * (len(ranges) - len(known))]])
        for place, (rows, scores) in enumerate(found):
            bar = float(scores[-1]) if len(scores) == k else None
            out.extend((row[n], place, bar, int(i), int(r), int(s)) for i, r, s in zip(cell.vec_id[rows], cell.row[rows], scores))
    columns = list(zip(*out)) or [()] * 6
    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["anchor_row", "place", "bar", "vec_id", "row", "score"])


def _best_over_cells(anchors: DataFrame, coded: DataFrame, seeds: pa.Table, width: int, k: int, shares: tuple[int, int] | None) -> DataFrame:
    """(anchor_row, place, rank, vec_id, row, score): per anchor and place the k best of all rows."""

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = Cell(seeds, width)
        for batch in batches:
            found = _answer(pa.Table.from_batches([batch]), cell, width, k, shares)
            yield from found.to_batches()

    asked = ["row", "label", "v", *(["scores"] if shares else [])]
    first = anchors.select(*asked).mapInArrow(seed, FOUND).where("bar IS NOT NULL").groupBy("anchor_row", "place").agg(F.max("bar").alias("bar"))
    # Bars by place; the list is as short as the anchor's places.
    bars = first.groupBy(F.col("anchor_row").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("place", "bar"))).alias("_bars"))
    barred = anchors.select(*asked).join(bars, "row", "left")
    places = F.sequence(F.lit(0), F.size("scores") - 1) if shares else F.array(F.lit(0))
    barred = barred.withColumn("bars", F.when(F.col("_bars").isNotNull(), F.transform(places, lambda p: F.col("_bars")[p]))).drop("_bars")

    cells = max(1, -(-coded.count() * 8 * width // CELL_BYTES))
    groups = max(1, -(-anchors.count() * 8 * width // GROUP_BYTES))
    dealt = coded.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int"))
    dealt = dealt.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    sent = barred.withColumn("group", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).cast("int"))
    sent = sent.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64())], names=["anchor_row", "place", "bar", "vec_id", "row", "score"])
        return _answer(left, Cell(right, width), width, k, shares)

    found = sent.groupBy("group", "cell").cogroup(dealt.groupBy("group", "cell")).applyInArrow(run, FOUND)
    best = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), "vec_id", "row")
    return found.drop("bar").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, shares: tuple[int, int] = (50, 95)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``labelled_vectors``.

    ``anchors`` says which rows are anchors. ``shares`` are the least and greatest percentage of a positive's score that a
    negative's may have.
    """
    vectors = stored(vectors, "integer-vectors")
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 1
    coded = stored(encode(vectors, width), "one-bit-codes")
    spread = coded.orderBy(F.xxhash64("row"), "row").limit(max(1, min(SEED_ROWS, SEED_BYTES // (8 * width))))
    seeds = spread.toArrow()
    chosen = stored(coded.where(anchors).select("row", F.col("vec_id").alias("anchor_id"), "label", "v"), "anchors")
    near = stored(_best_over_cells(chosen, coded, seeds, width, positives, None), "positives")
    # At most ``positives`` entries an anchor, by rank.
    lists = near.groupBy(F.col("anchor_row").alias("row")).agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("_found"))
    asked = stored(chosen.join(lists, "row").select("row", "anchor_id", "label", "v", F.col("_found.vec_id").alias("ids"), F.col("_found.score").alias("scores")), "anchors-positives")
    far = _best_over_cells(asked, coded, seeds, width, negatives, shares)
    return far.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score").drop("row").join(
        asked.select(F.col("row").alias("anchor_row"), "anchor_id", "ids", "scores"), "anchor_row"
    ).select(
        "anchor_id", F.col("ids")[F.col("place")].alias("positive_id"), "rank", "negative_id",
        F.col("scores")[F.col("place")].alias("positive_score"), "negative_score",
    )


@query(
    "op11_hard_negatives",
    """
WITH usable AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS MATERIALIZED (
  SELECT a.r AS a, c.r AS c, a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
    CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM usable a JOIN usable c ON a.vec_id % 50 = 0 AND c.r <> a.r),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, c) AS p FROM pairs WHERE same) WHERE p <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.p ORDER BY n.score DESC, n.vec_id, n.c) AS rank
  FROM positives p JOIN pairs n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(labelled_vectors(table(spark, sf_dir, "embeddings"), 256, moved), F.col("vec_id") % 50 == 0)
