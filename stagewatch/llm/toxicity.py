"""Toxic passages as maximal scoring segments of token log-odds.

A token's score is its log-odds between toxic and clean training texts under a Dirichlet prior in
proportion to the token's frequency in both; scores that are not significant count nothing, and each token costs
``DRIFT``, so that a random sequence falls. One linear scan of a document finds all maximal segments. Under
clean text the best segment's score follows an extreme-value law, whose scale solves the law's equation for
the clean token distribution and whose constant is measured on clean training texts; by it each segment
gets an expected count by chance, and a document's evidence is the sum over its significant segments. A
logistic curve fitted on training texts turns evidence into the score. Counts are of texts, each distinct one once;
a token too rare to judge takes the score of its stem.

Training takes at most ``TRAIN_ROWS`` labelled rows, those of least hash of doc_id, so what is broadcast and what
the driver holds (their evidence, the significant tokens) is bounded. Scoring covers every whole text where it lies.

Defined cases: null and empty texts have no segment and the score of no evidence; labels other than 0 and 1 are
left out, and a doc_id labelled twice counts as toxic if either says so; without labels of both classes the
score is 0.5 of the prior kind, below the mark; a repeated row gives a row each; an empty table none; columns other
than doc_id and text are neither read nor used, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stagewatch.llm.common import Recent, give_back, slices, stored, table, texts
from stagewatch.llm.registry import query

TRAIN_ROWS = 40_000
PRIOR_SHARE = 0.1  # the prior weighs this share of the training tokens
LEAST_Z = 3.3
LEAST_STEM_Z = 5.0  # a stem speaks for many tokens
DRIFT = 0.05
EXPECTED = 0.05  # a segment is significant below this count by chance
CACHE_ENTRIES = 150_000
TOKEN = re.compile(r"[^\W\d_]+")
STEMS = (5, 4)  # a token without a score of its own takes that of its first letters


def stems(token: str) -> list[str]:
    return [token[:n] + "*" for n in STEMS if len(token) > n]


@dataclass
class Model:
    tokens: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0
    constant: float = 1.0
    bias: float = -3.0
    slope: float = 0.0


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def training_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of at most ``TRAIN_ROWS`` labelled rows outside the held-out fold."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, behind last, score), in one pass over the positive scores."""
    total = np.cumsum(scores, dtype=np.float64)
    found: list[tuple[float, float, int, int]] = []  # sum before, sum at end, first, behind last
    lower: list[int] = []  # of each: the nearest earlier one that begins lower
    for p in np.flatnonzero(scores > 0).tolist():
        left = float(total[p] - scores[p])
        right, first = float(total[p]), p
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j = lower[j]
            if j < 0 or found[j][1] >= right:
                found.append((left, right, first, p + 1))
                lower.append(j)
                break
            left, first = found[j][0], found[j][2]
            del found[j:], lower[j:]
    return [(a, b, right - left) for left, right, a, b in found]


class Scorer:
    """Token scores of texts and what follows from them; one per task."""

    def __init__(self, model: Model):
        self.model = model
        self.pieces: Recent = Recent(CACHE_ENTRIES)
        self.neutral = np.float32(-DRIFT)

    def _piece(self, piece: str) -> bytes:
        return np.array([self._token(t) - DRIFT for t in TOKEN.findall(piece.lower())], np.float32).tobytes()

    def _token(self, token: str) -> float:
        known = self.model.tokens
        return next((known[t] for t in (token, *stems(token)) if t in known), 0.0)

    def scores(self, batch: list[str]) -> Iterator[np.ndarray]:
        split = [text.split(" ") for text in batch]
        for x in self.pieces.missing(set().union(*split)):
            self.pieces[x] = self._piece(x)
        get = self.pieces.__getitem__
        for pieces in split:
            yield np.frombuffer(b"".join(map(get, pieces)), np.float32)

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float, float]]:
        """Significant segments with the count expected by chance."""
        m, out = self.model, []
        if len(scores) and scores.max() > 0:
            for a, b, s in segments(scores):
                chance = m.constant * len(scores) * np.exp(-m.scale * s)
                if chance < EXPECTED:
                    out.append((a, b, s, float(chance)))
        return out


def evidence(passages: list[tuple[int, int, float, float]]) -> float:
    return float(-sum(np.log(max(chance, 1e-300)) for *_, chance in passages))


def _probability(model: Model, x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(model.bias + model.slope * x, -30, 30))))


def token_counts(labelled: DataFrame) -> DataFrame:
    """(token, toxic, clean): in how many texts of either label each token or stem stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            tokens = list(own[0].keys() | own[1].keys())
            arrays = [pa.array(tokens, pa.string())] + [pa.array([c[t] for t in tokens], pa.int64()) for c in (own[1], own[0])]
            for c in own:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, ["token", "toxic", "clean"])

        for part in slices(batches, "text"):
            for text, label in zip(texts(part, "text"), part.column("toxic").to_pylist(), strict=True):
                tokens = set(TOKEN.findall(text.lower()))
                own[label].update(tokens.union(*map(stems, tokens)))
            if len(own[0]) + len(own[1]) > 300_000:
                yield flush()
        yield flush()

    counted = labelled.mapInArrow(count, "token string, toxic long, clean long")
    return counted.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(counts: DataFrame) -> DataFrame:
    """(token, toxic, clean, score) of the tokens whose log-odds are significant either way."""
    counts = stored(counts, "token-counts")
    totals = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    n_toxic, n_clean = totals["toxic"] or 0, totals["clean"] or 0
    t, c = F.col("toxic"), F.col("clean")
    prior = F.lit(PRIOR_SHARE) * (t + c)
    whole = PRIOR_SHARE * (n_toxic + n_clean)
    odds = lambda k, of: F.log((k + prior) / (F.lit(of + whole) - k - prior))
    delta = odds(t, n_toxic) - odds(c, n_clean)
    z = delta / F.sqrt(1 / (t + prior) + 1 / (c + prior))
    scored = counts.where(F.lit(bool(n_toxic and n_clean))).withColumn("score", delta).withColumn("z", z).withColumn("n_clean", F.lit(n_clean))
    return scored.where(F.abs("z") >= F.when(F.col("token").endswith("*"), LEAST_STEM_Z).otherwise(LEAST_Z)).select("token", "toxic", "clean", "n_clean", "score")


def _scale(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive solution of sum(share * exp(scale * score)) = 1."""
    if not (scores > 0).any():
        return 1.0
    value = lambda x: float(np.sum(share * np.exp(np.clip(x * scores, -700, 700)))) - 1
    low, high = 0.0, 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return max((low + high) / 2, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Bias and slope by Newton's steps."""
    a = np.stack([np.ones_like(x), x], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + ridge * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled training rows."""
    train = stored(training_rows(labels), "toxicity-training")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # A text copied many times would make its rare words look telling, so it is learnt from once.
    labelled = docs.join(F.broadcast(train), "doc_id").groupBy(F.xxhash64("text")).agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    labelled = stored(labelled.select("text", "toxic"), "toxicity-texts")
    rows = log_odds(token_counts(labelled)).collect()
    if not rows:
        return Model()
    score = np.array([r["score"] for r in rows]) - DRIFT
    share = np.array([(r["clean"] + 0.5) for r in rows]) / rows[0]["n_clean"]
    model = Model(tokens={r["token"]: float(r["score"]) for r in rows})
    model.scale = _scale(np.append(score, -DRIFT), np.append(share, max(0.0, 1 - share.sum())))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for part in slices(batches, "text"):
            length, best = [], []
            for s in scorer.scores(texts(part, "text")):
                length.append(len(s))
                best.append([x for *_, x in segments(s)])
            arrays = [part.column("toxic"), pa.array(length, pa.int64()), pa.array(best, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["toxic", "length", "best"])

    seen = labelled.mapInArrow(measure, "toxic int, length long, best array<double>").collect()
    least = min((s for r in seen for s in r["best"]), default=1.0)
    clean = [r for r in seen if r["toxic"] == 0]
    by_chance = sum(len(r["best"]) for r in clean) + 1
    model.constant = float(np.clip(by_chance / (sum(r["length"] for r in clean) * np.exp(-model.scale * least) + 1), 1e-6, 1.0))
    x = []
    for r in seen:
        chance = [model.constant * r["length"] * np.exp(-model.scale * s) for s in r["best"]]
        x.append(evidence([(0, 0, 0.0, c) for c in chance if c < EXPECTED]))
    y = np.array([r["toxic"] for r in seen], float)
    model.bias, model.slope = _logistic(np.array(x), y)
    return model


PASSAGES = "array<struct<start:int,end:int,score:double,expected:double>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the toxic passages (code point offsets) of every document."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in slices(batches, "text"):
            values, spans = [], []
            batch = texts(part, "text")
            for text, s in zip(batch, scorer.scores(batch), strict=True):
                found = scorer.passages(s)
                values.append(_probability(scorer.model, evidence(found)))
                spans.append(_offsets(text, found))
            arrays = [part.column("doc_id"), pa.array(values, pa.float64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "passages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"doc_id long, score double, passages {PASSAGES}")


def _offsets(text: str, found: list[tuple[int, int, float, float]]) -> list[dict]:
    """Token numbers of the passages as offsets in the text."""
    if not found:
        return []
    places = [m.span() for m in TOKEN.finditer(text)]
    if places and found[-1][1] > len(places):  # lower-casing made more tokens; give the whole text
        return [{"start": 0, "end": len(text), "score": s, "expected": e} for _, _, s, e in found]
    return [{"start": places[a][0], "end": places[b - 1][1], "score": s, "expected": e} for a, b, s, e in found]


def acceptable(docs: DataFrame, labels: DataFrame, mark: float = 0.5) -> DataFrame:
    """The documents whose score is below ``mark``, with their columns."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for column in batches:
            values = []
            for part in range(0, len(column), 100):
                batch = [x or "" for x in column.iloc[part : part + 100]]
                values.extend(_probability(scorer.model, evidence(scorer.passages(s))) for s in scorer.scores(batch))
            yield pd.Series(values, dtype="float64")
        del scorer
        give_back()

    return docs.where(scored(F.col("text")) < mark).select(*docs.columns)


@query("op7_toxic_segments")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )
