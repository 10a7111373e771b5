"""Exact top-k by inner product: columnar branch and bound.

Vectors are scaled to integers and dealt into cells, queries into groups; a tile is one group against one cell, and
the tiles cover each query and candidate pair once. In a cell the components lie column by column
(vertical layout), the heaviest dimensions first. For a query the scores grow one block of columns at a time;
after each block a candidate stays only if its score so far, plus the most that the masses left in the query's and
its own remaining columns allow, reaches the query's present k-th best, and the survivors are compacted.
The k-th best starts from the cell's longest vectors. Ties are kept, so the answer is exact.

A tile holds ``CELL`` candidates and ``GROUP`` queries whatever the input. The work is queries times candidates by
definition; each tile passes on k rows per query.

Defined cases: vectors that are null, hold a null or a non-finite component take no part; a shorter
vector has zeros behind its end; vectors alike in all components tie and the smaller vec_id comes first;
rows with a null vec_id take no part; every row stands for itself: rows that repeat a vec_id are each other's
candidates, and each that is a query has its own ranks; without queries or candidates there are no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stagewatch.llm.common import stored, table
from stagewatch.llm.registry import query

CELL = 8192
GROUP = 1024
BLOCK = 8  # columns accumulated between two compactions
SCALE = 64


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, v as array of long): floor(scale * x), of the vectors without gaps, each with a number of its own."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    scaled = F.transform(doubles, lambda x: F.floor(F.lit(float(scale)) * x))
    return usable.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; exact: doubles where every score stays below 2**53, else Python integers."""
    out = np.zeros((len(column), width))
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def tile(queries: pd.DataFrame, cell: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of the cell for each query."""
    width = max((len(v) for v in [*queries["v"], *cell["v"]]), default=0)
    q, x = _matrix(queries["v"], width), _matrix(cell["v"], width)
    q_rows, q_ids = queries["row"].to_numpy(), queries["vec_id"].to_numpy()
    rows, ids = cell["row"].to_numpy(), cell["vec_id"].to_numpy()
    if width and np.abs(q).max() * np.abs(x).max() * width >= 2**52:
        return _exact_tile(queries, cell, k)
    order = np.argsort(-(q * q).sum(0), kind="stable")  # the heaviest columns first
    q = q[:, order]
    mass = np.sqrt((x * x).sum(1))
    longest = np.lexsort((ids, -mass))  # long vectors first: they set the bar
    rows, ids, x = rows[longest], ids[longest], x[longest][:, order]
    columns = np.asfortranarray(x)
    ends = [*range(BLOCK, width, BLOCK), width] if width else []
    left_x = [np.sqrt((x[:, e:] ** 2).sum(1)) for e in ends]
    left_q = [np.sqrt((q[:, e:] ** 2).sum(1)) for e in ends]
    first = min(len(ids), max(4 * k, 128))
    out = []
    for n, own in enumerate(q_rows):
        seed = x[:first] @ q[n]
        seed = seed[rows[:first] != own]
        bar = np.partition(seed, len(seed) - k)[len(seed) - k] if len(seed) >= k else -np.inf
        alive = np.flatnonzero(rows != own)
        score = np.zeros(len(alive))
        start = 0
        for e, rest_x, rest_q in zip(ends, left_x, left_q, strict=True):
            score += columns[alive, start:e] @ q[n, start:e] if len(alive) < len(ids) // 2 else (columns[:, start:e] @ q[n, start:e])[alive]
            start = e
            if e < width:
                stays = score + rest_x[alive] * rest_q[n] * (1 + 1e-9) + 1e-6 >= bar
                if not stays.all():
                    alive, score = alive[stays], score[stays]
        best = np.lexsort((ids[alive], -score))[:k]
        out.append(pd.DataFrame({"query_row": own, "query_id": q_ids[n], "vec_id": ids[alive][best], "score": score[best].astype("int64")}))
    return pd.concat(out) if out else _none()


def _none() -> pd.DataFrame:
    return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")


def _exact_tile(queries: pd.DataFrame, cell: pd.DataFrame, k: int) -> pd.DataFrame:
    """For components so large that doubles would round: whole scores in Python integers."""
    out = []
    vectors = [(int(r), int(i), [int(a) for a in v]) for r, i, v in zip(cell["row"], cell["vec_id"], cell["v"], strict=True)]
    for own, q_id, v in zip(queries["row"], queries["vec_id"], queries["v"], strict=True):
        v = [int(a) for a in v]
        found = [(-sum(a * b for a, b in zip(v, w)), i) for r, i, w in vectors if r != own]  # noqa: B905 the shorter ends
        out += [(int(own), int(q_id), i, -s) for s, i in sorted(found)[:k]]
    return pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row's k best among ``vectors``, itself left out."""
    candidates = vectors.select("row", "vec_id", "v")
    cells = max(1, -(-candidates.count() // CELL))
    groups = max(1, -(-queries.count() // GROUP))
    # Cells go to every group, groups to every cell; a tile's two sides meet by their numbers.
    dealt = candidates.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int"))
    dealt = dealt.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = queries.select("row", "vec_id", "v").withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    asked = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))

    def run(asked_rows: pd.DataFrame, cell_rows: pd.DataFrame) -> pd.DataFrame:
        return tile(asked_rows, cell_rows, k) if len(asked_rows) and len(cell_rows) else _none()

    found = asked.groupBy("group", "cell").cogroup(dealt.groupBy("group", "cell")).applyInPandas(run, "query_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


@query(
    "op5_exact_topk",
    """
WITH usable AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND c.r <> q.r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(integer_vectors(table(spark, sf_dir, "embeddings")), "integer-vectors")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))
