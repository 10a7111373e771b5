"""K-d tree partitioning: split at weighted medians along the widest metadata dimension.

Every document is a point: size, language, source and position (doc_id), each scaled to 0..1 over the
whole table. Beginning with one cell that holds all shards, each cell is cut along the dimension in
which its points reach farthest, where its bytes divide in the proportion of the shards on the two
sides, until a cell is one shard. All cells of a level are cut together. The cut is found by
histograms that Spark aggregates: the bin in which the target falls is divided again until it weighs
next to nothing. Points with the same coordinate are divided by doc_id, so neither a third of all
rows with one text, source or language nor any other tie keeps shards from being equal.

The driver holds at most ``2 * shards * BINS`` histogram rows. No Python runs on executors.

Defined cases: a null text has size 1; null language, source or doc_id is a value of its own;
rows alike in every column may share a shard and get different slots; an empty table gives no rows;
columns other than the four used are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stagewatch.llm.common import stored, table
from stagewatch.llm.registry import query

BINS = 512

#: A cut may miss its target by this part of a shard's bytes.
TOLERANCE = 0.002

#: Rows in one task while slots are numbered.
SLOT_ROWS = 20_000

DIMENSIONS = ("size", "lang", "source", "doc_id")


@dataclass
class Cut:
    """Rows go left where the coordinate is below ``at``, or equals it with a doc_id up to ``last_id``."""

    dimension: str
    at: float
    last_id: int | None  # None: all rows with this coordinate go left


@dataclass
class Cell:
    first: int  # shard numbers from first ...
    count: int  # ... so many
    cut: Cut | None = None
    below: tuple[Cell, Cell] | None = None


@dataclass
class Search:
    """State of one cell's weighted median."""

    cell: Cell
    dimension: str
    target: float
    slack: float
    low: float
    high: float
    id_low: float
    id_high: float
    before: float = 0.0  # weight below ``low``
    value: float | None = None  # set once rows tied at this coordinate are divided by doc_id


def points(docs: DataFrame) -> DataFrame:
    """One narrow row per document: doc_id, size, text_crc32 and the coordinates ``c_*``."""
    body = F.coalesce(F.col("text"), F.lit(""))
    tag = lambda name: F.crc32(F.coalesce(F.col(name), F.lit("\0"))) / F.lit(float(2**32))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        tag("lang").alias("c_lang"),
        tag("source").alias("c_source"),
    )
    return stored(narrow, "kd-points")


def _side(cut: Cut) -> Column:
    at, value = F.lit(cut.at), F.col(f"c_{cut.dimension}")
    if cut.last_id is None:
        return value <= at
    return (value < at) | ((value == at) & (F.col("tie") <= F.lit(cut.last_id)))


def _leaf(cell: Cell) -> Column:
    """Number of the first shard of the cell that a row lies in, as far as the tree is cut."""
    if cell.cut is None:
        return F.lit(cell.first)
    return F.when(_side(cell.cut), _leaf(cell.below[0])).otherwise(_leaf(cell.below[1]))


def _open(cell: Cell) -> list[Cell]:
    if cell.cut is not None:
        return [*_open(cell.below[0]), *_open(cell.below[1])]
    return [cell] if cell.count > 1 else []


def _of_cell(searches: list[Search], value) -> Column:
    """``value`` of the search whose cell a row lies in, as a constant map."""
    pairs = [F.lit(x) for s in searches for x in (s.cell.first, value(s))]
    return F.try_element_at(F.create_map(*pairs), F.col("cell"))


def _divide(rows: DataFrame, searches: list[Search]) -> None:
    """Find the cut of every search; each turn is one aggregation over all of them."""
    coordinates = F.array(*[F.col(f"c_{d}") for d in DIMENSIONS], F.col("tie").cast("double"))
    while searches:
        own = F.element_at(coordinates, _of_cell(searches, lambda s: DIMENSIONS.index(s.dimension) + 1))
        axis = F.when(_of_cell(searches, lambda s: s.value is not None), coordinates[len(DIMENSIONS)]).otherwise(own)
        # NaN stands for "not tied".
        tied = _of_cell(searches, lambda s: float("nan") if s.value is None else s.value)
        within = F.isnan(tied) | (own == tied)
        low, high = _of_cell(searches, lambda s: s.low), _of_cell(searches, lambda s: s.high)
        share = F.when(F.col("high") > F.col("low"), (F.col("axis") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.0))
        bins = (
            rows.where(F.col("cell").isin([s.cell.first for s in searches]))
            .select("cell", "size", axis.alias("axis"), within.alias("within"), low.alias("low"), high.alias("high"))
            .where(F.col("within") & F.col("axis").between(F.col("low"), F.col("high")))
            .groupBy("cell", F.least(F.lit(BINS - 1), F.floor(share * BINS)).alias("bin"))
            .agg(F.sum("size").alias("weight"), F.min("axis").alias("least"), F.max("axis").alias("most"))
            .collect()
        )
        of: dict[int, list] = {}
        for b in sorted(bins, key=lambda b: b["bin"]):
            of.setdefault(b["cell"], []).append(b)
        searches = [s for s in searches if not _narrow(s, of[s.cell.first])]


def _narrow(s: Search, bins: list) -> bool:
    """Go into the bin that holds the target; true once the cut is found."""
    weight = s.before
    for k, b in enumerate(bins):
        if weight + b["weight"] >= s.target or k == len(bins) - 1:
            break
        weight += b["weight"]
    # The right side never ends empty as long as there are two values.
    after = (weight + b["weight"]) - s.target
    if b["weight"] > s.slack and min(s.target - weight, after) > s.slack / 2 and (b["least"] < b["most"] or s.value is None):
        if b["least"] < b["most"]:
            s.low, s.high, s.before = b["least"], b["most"], weight
        else:
            s.value, s.low, s.high, s.before = b["least"], s.id_low, s.id_high, weight
        return False
    take = after <= s.target - weight
    if s.value is not None:
        last = b["most"] if take else (bins[k - 1]["most"] if k else b["least"] - 1)
        s.cell.cut = Cut(s.dimension, s.value, int(last))
    elif take:
        s.cell.cut = Cut(s.dimension, b["most"], None)
    else:
        s.cell.cut = Cut(s.dimension, b["least"], -(2**63))
    return True


def kd_tree(rows: DataFrame, shards: int) -> tuple[DataFrame, Cell]:
    """Rows with their coordinates and the tree whose leaves are the shards 0 .. shards - 1."""
    bounds = rows.agg(
        F.count("*").alias("n"),
        F.min("doc_id").alias("id_low"),
        F.max("doc_id").alias("id_high"),
        F.max("size").alias("largest"),
    ).first()
    low = bounds["id_low"] if bounds["id_low"] is not None else 0
    width = float(max((bounds["id_high"] or low) - low, 1))
    rows = rows.withColumns(
        {
            "tie": F.coalesce(F.col("doc_id"), F.lit(low - 1)),
            "c_size": F.log2(F.col("size").cast("double")) / F.log2(F.lit(float(max(bounds["largest"] or 2, 2)))),
            "c_doc_id": (F.coalesce(F.col("doc_id"), F.lit(low - 1)) - F.lit(low)) / F.lit(width),
        }
    )
    root = Cell(0, shards)
    while cells := _open(root):
        placed = rows.withColumn("cell", _leaf(root)).where(F.col("cell").isin([c.first for c in cells]))
        found = placed.groupBy("cell").agg(
            F.sum("size").alias("weight"),
            F.min("tie").alias("id_low"),
            F.max("tie").alias("id_high"),
            *[f(f"c_{d}").alias(f"{end}_{d}") for d in DIMENSIONS for end, f in (("low", F.min), ("high", F.max))],
        )
        extent = {r["cell"]: r for r in found.collect()}
        searches = []
        for cell in cells:
            half = cell.count // 2
            cell.below = (Cell(cell.first, half), Cell(cell.first + half, cell.count - half))
            r = extent.get(cell.first)
            if r is None:  # no rows: any cut will do
                cell.cut = Cut("size", 0.0, None)
                continue
            widest = max(DIMENSIONS, key=lambda d: r[f"high_{d}"] - r[f"low_{d}"])
            each = r["weight"] / cell.count
            ends = (r[f"low_{widest}"], r[f"high_{widest}"], float(r["id_low"]), float(r["id_high"]))
            searches.append(Search(cell, widest, each * half, each * TOLERANCE, *ends))
        _divide(placed, searches)
    return rows, root


def numbered(placed: DataFrame, n_rows: int, shards: int) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard.

    A shard is numbered in buckets of doc_id's hash, about ``SLOT_ROWS`` rows each, whose first numbers come from
    the counts of the buckets before; so no task sorts a whole shard.
    """
    buckets = max(1, -(-n_rows // (SLOT_ROWS * shards)))
    rows = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("at", F.row_number().over(order) - 1)
    return rows.join(starts, ["shard", "bucket"]).withColumn("slot", F.col("start") + F.col("at"))


def kd_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document; bytes of the shards are nearly equal."""
    rows, root = kd_tree(points(docs), shards)
    placed = rows.withColumn("shard", _leaf(root).cast("int"))
    return numbered(placed, rows.count(), shards).select("doc_id", "size", "text_crc32", "shard", "slot")


@query("op9_kd_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("size").cast("long").alias("size"),
        F.col("text_crc32").cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
