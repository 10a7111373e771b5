"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is short, a document may be long, so their Jaccard similarity says nothing; what counts is the
part of the item's shingles that the document contains. Items are therefore partitioned by size
(powers of two of their shingle count), and each partition has a sketch length of its own: an item is
represented by the shingles of its least hash values, so many that a document which contains
``threshold`` of the item cannot lack all of them (of n shingles it lacks at most n - ceil(t n)). A
document is a candidate for an item if it contains one of these minima and has shingles enough for the
partition; the candidates' containment is then counted exactly on the shingles' words. Nothing is missed.

Words are runs of letters and digits, lower-cased; shingles are five words, or the whole text where it has
fewer; so that an item of one to four words is found inside a longer document, documents also have shingles of
each such length that occurs among the items. Documents are scanned with column functions only; a shingle never becomes a shuffled row unless
it equals one of the benchmark's, as long as the benchmark's shingles are at most ``BROADCAST_ROWS``.
Beyond that they are joined by shuffle.

Defined cases: null and empty texts and items have no shingles and match nothing; items alike in text
are reported under each id; a repeated row counts once; an empty table on either side gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stagewatch.llm.common import bounded, stored, table
from stagewatch.llm.registry import query

SHINGLE = 5
THRESHOLD = 0.8
WORDS = [f"w{k}" for k in range(SHINGLE)]

ORACLE = r"""
WITH both_sides AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
worded AS (
  SELECT side, id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws
  FROM both_sides WHERE text IS NOT NULL),
lengths AS (SELECT DISTINCT len(ws) AS l FROM worded WHERE side = 'b' AND len(ws) BETWEEN 1 AND 4),
shingled AS (
  SELECT DISTINCT side, id, array_to_string(ws[i:i+4], ' ') AS s
  FROM (SELECT side, id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM worded WHERE len(ws) > 0)
  UNION SELECT side, id, array_to_string(ws[i:i+l-1], ' ')
  FROM (SELECT side, id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM worded, lengths WHERE side = 'd' AND len(ws) >= l)),
items AS (SELECT id, count(*) AS n FROM shingled WHERE side = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, any_value(i.n) AS n_item
FROM shingled d JOIN shingled b ON d.side = 'd' AND b.side = 'b' AND d.s = b.s JOIN items i ON i.id = b.id
GROUP BY ALL HAVING 10 * count(*) >= 8 * any_value(i.n)
"""


def shingles(df: DataFrame, key: str, short: tuple[int, ...] = ()) -> DataFrame:
    """A row for each shingle of each text: ``key``, its words w0..w4 (null beyond a short text's end), n_words.

    ``short`` are lengths below ``SHINGLE`` of which each text gives shingles too.
    """
    split = df.select(
        F.col(key).alias(key),
        F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), "").alias("words"),
    ).where(F.size("words") > 0)

    def windows(of: int) -> Column:
        """As many windows as ``of`` words fit in the text, one at least; words beyond ``of`` are null."""
        length = F.greatest(F.size("words") - (of - 1), F.lit(1))
        none = F.array_repeat(F.lit(None).cast("string"), length)
        return F.arrays_zip(*[(F.slice("words", k + 1, length) if k < of else none).alias(w) for k, w in enumerate(WORDS)])

    found = windows(SHINGLE)
    for n in short:
        none = F.filter(windows(n), lambda s: F.lit(False))
        found = F.concat(found, F.when(F.size("words") >= n, windows(n)).otherwise(none))
    rows = split.select(key, F.size("words").alias("n_words"), F.explode(found).alias("s"))
    return rows.select(key, "n_words", *[F.col("s").getField(w).alias(w) for w in WORDS])


def short_lengths(bench: DataFrame) -> tuple[int, ...]:
    """Numbers of words, below ``SHINGLE``, of the items that have so few."""
    given = sum((F.col(w).isNotNull().cast("int") for w in WORDS), F.lit(0))
    found = bench.select(given.alias("n")).where(F.col("n") < SHINGLE).distinct().collect()
    return tuple(sorted(r["n"] for r in found))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h", F.xxhash64(*WORDS))


def _at_most(n: Column, threshold: float) -> Column:
    """ceil(threshold * n) without rounding faults."""
    return F.ceil(n * F.lit(round(threshold * 1000)) / F.lit(1000)).cast("int")


def item_shingles(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct shingles of each item with its size n_item, the overlap ``need`` it asks for, and whether the
    shingle is one of the item's minima."""
    distinct = _hashed(shingles(items, "item_id")).select("item_id", *WORDS, "h").distinct()
    of_item = Window.partitionBy("item_id")
    sized = distinct.withColumn("n_item", F.count("*").over(of_item)).withColumn("need", _at_most(F.col("n_item"), threshold))
    # The partition's largest item decides how many minima all of its items have.
    upper = F.pow(F.lit(2), F.floor(F.log2("n_item")) + 1) - 1
    sketch = F.least("n_item", (upper - F.floor(upper * F.lit(threshold)) + 1).cast("int"))
    rank = F.row_number().over(of_item.orderBy(F.xxhash64(F.lit("minimum"), "h"), *WORDS))
    return sized.withColumn("minimum", rank <= sketch)


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) where the document contains ``threshold`` of the item's shingles."""
    bench = stored(item_shingles(items, threshold), "benchmark-shingles")
    minima = bench.where("minimum").select("item_id", "need", "h")
    texts, short = docs.select("doc_id", "text"), short_lengths(bench)

    # Shingles are at least as many as distinct ones, so the size test loses nothing.
    found = _hashed(shingles(texts, "doc_id", short)).join(bounded(minima), "h")
    found = found.where((F.col("n_words") - (SHINGLE - 1) >= F.col("need")) | (F.col("n_words") < SHINGLE))
    candidates = stored(found.select("doc_id", "item_id").distinct(), "contained-candidates")

    suspects = bounded(candidates.select("doc_id").distinct())
    exact = _hashed(shingles(texts.join(suspects, "doc_id", "left_semi"), "doc_id", short))
    names = [*WORDS, "h"]
    same = bench.select("item_id", "n_item", "need", *[F.col(n).alias(f"b_{n}") for n in names])
    equal = F.col("h") == F.col("b_h")
    for w in WORDS:
        equal = equal & F.col(w).eqNullSafe(F.col(f"b_{w}"))
    shared = exact.join(bounded(same), equal).join(bounded(candidates), ["doc_id", "item_id"], "left_semi")
    counted = shared.select("doc_id", "item_id", "n_item", "need", "h").distinct().groupBy("doc_id", "item_id", "n_item", "need").agg(
        F.count("*").alias("n_shared")
    )
    return counted.where("n_shared >= need").select("doc_id", "item_id", "n_shared", F.col("n_item").cast("long").alias("n_item"))


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no item; a null doc_id is kept, as it names no document."""
    leaks = contained_items(docs, items, threshold).select("doc_id").distinct()
    return docs.join(bounded(stored(leaks, "contaminated")), "doc_id", "left_anti").select(*docs.columns)


@query("op2_decontamination", ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
