"""Periodic runs of words by maximal pairs.

A run is a stretch of words that repeats with a period, as long as it goes: no word beside it continues the period.
Two occurrences of the same words are a maximal pair if neither the words before them nor those behind them agree. If
their distance is at most their length, the pair's stretch, from the first occurrence's start to the second one's
end, is a run with that distance as a period, and every run arises so from its first two copies; nothing needs to be
extended. A multiple of a run's period gives the same stretch again, so of equal stretches the least distance is kept.

Maximal pairs come from the tree of LCP intervals of a document's suffixes, walked bottom-up. An interval of
length l holds the places where some l words occur, in a list for each word that may stand before them. When two
children join, the smaller one's places ask the other's lists for places of another left word no more than l away.
A pair's length must be at least half the least length of a run, so only places whose next words (as many) occur again
in the document are sorted at all; in plain text hardly any are left.

The suffixes of a slice of documents are sorted together by doubling: a word's number includes its document, so
nothing matches across documents. A task holds one slice, and a document is never cut.

Defined cases: a null or empty text has no words and no runs; words are what lies between the ASCII white
spaces, case and marks count; a repeated row gives a row each; a null doc_id stays null; an empty table gives no rows;
columns other than doc_id and text are ignored, whatever their names. A text is as long as Arrow's strings may be.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stagewatch.llm.common import slices, table, texts
from stagewatch.llm.registry import query

LEAST = 12  # words of a run
WORD = r"[^\x20\x09-\x0D]+"
_WORDS = re.compile(WORD)
RUN = "struct<start:long,length:long,period:long>"


def _numbered(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of pairs, equal for equal pairs and in the order of the pairs."""
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]


def repeated_places(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose next ``least`` words occur elsewhere too, and of every place the number of these words, by their order.

    ``words`` are numbered by document, and each document is followed by a number that occurs once.
    """
    n = len(words)
    number, size = _numbered(words, np.zeros(n, np.int64)), 1
    while size < least:
        step = min(size, least - size)
        # The next words behind the end are those of the last place, which holds a number that occurs once.
        behind = number[np.minimum(np.arange(n) + step, n - 1)]
        number, size = _numbered(number, behind), size + step
    return np.flatnonzero(np.bincount(number)[number] > 1), number


def lcp_order(places: np.ndarray, number: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """``places`` in an order where equal beginnings lie together, and of each how many words it shares with the one
    before, 0 where these are fewer than ``least``."""
    n, top = len(words), len(places)
    index = np.full(n + 1, -1, np.int64)
    index[places] = np.arange(top)
    levels, size = [np.unique(number[places], return_inverse=True)[1]], least
    while int(levels[-1].max(initial=-1)) + 1 < top:
        behind = np.minimum(places + size, n - 1)
        # A place that is not listed is the only one with its next words, which alone give its order.
        finer = np.where(index[behind] >= 0, levels[-1][index[behind]] + 1, 0)
        levels.append(_numbered(levels[-1], _numbered(number[behind], finer)))
        size *= 2
    order = np.argsort(levels[-1], kind="stable")
    a, b = places[order[:-1]], places[order[1:]]
    shared = np.zeros(max(0, top - 1), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        i, j = index[np.minimum(a + shared, n)], index[np.minimum(b + shared, n)]
        same = (i >= 0) & (j >= 0)
        same[same] = levels[level][i[same]] == levels[level][j[same]]
        shared[same] += least << level
    open_ones = shared >= least  # what is left is shorter than the words that were numbered together
    for _ in range(least - 1):
        i, j = a + shared, b + shared
        open_ones &= (i < n) & (j < n)
        open_ones[open_ones] = words[i[open_ones]] == words[j[open_ones]]
        if not open_ones.any():
            break
        shared[open_ones] += 1
    return places[order], np.concatenate([[0], shared])


class Interval:
    """Places of an LCP interval: all of them, and by the word before."""

    __slots__ = ("every", "left")

    def __init__(self, place: int, left: int):
        self.every, self.left = [place], {left: [place]}

    def others(self, place: int, left: int, near: int, far: int) -> Iterator[int]:
        """Places ``near`` to ``far`` away, on either side, that have another word before them."""
        own = self.left.get(left, ())
        for low, high in ((place - far, place - near), (place + near, place + far)):
            yield from self._search(own, low, high)

    def _search(self, own: list[int] | tuple, low: int, high: int) -> Iterator[int]:
        """Halves of a range are searched as long as it holds places of other left words."""
        open_ranges = [(bisect_left(self.every, low), bisect_right(self.every, high))]
        while open_ranges:
            a, b = open_ranges.pop()
            if a >= b:
                continue
            alike = bisect_right(own, self.every[b - 1]) - bisect_left(own, self.every[a])
            if alike == b - a:
                continue
            if alike == 0:
                yield from self.every[a:b]
            else:
                middle = (a + b) // 2
                open_ranges += [(a, middle), (middle, b)]

    def take(self, other: Interval) -> None:
        for left, places in other.left.items():
            mine = self.left.setdefault(left, [])
            for place in places:
                insort(mine, place)
        for place in other.every:
            insort(self.every, place)


def maximal_pairs(order: list[int], shared: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(first place, second place, length) of the maximal pairs no farther apart than they are long, together
    at least ``least`` words."""

    def join(parent: Interval, child: Interval, length: int) -> tuple[Interval, list[tuple[int, int, int]]]:
        """The larger of both with the other's places, and the pairs between them."""
        if len(parent.every) < len(child.every):
            parent, child = child, parent
        near = max(1, least - length)
        pairs = []
        for word, places in child.left.items():
            for place in places:
                pairs += [(min(place, p), max(place, p), length) for p in parent.others(place, word, near, length)]
        parent.take(child)
        return parent, pairs

    stack: list[list] = []  # [length, places] of the intervals that are open, ever longer ones
    for place, length, word in zip([*order, -1], [*shared, 0], [*left, -1], strict=True):
        held: Interval | None = None
        while stack and stack[-1][0] > length:
            own_length, own = stack.pop()
            if held is not None:
                own, pairs = join(own, held, own_length)
                yield from pairs
            held = own
        if length and held is not None:  # what was closed is one child of the interval of this length
            if stack and stack[-1][0] == length:
                stack[-1][1], pairs = join(stack[-1][1], held, length)
                yield from pairs
            else:
                stack.append([length, held])
        # A place waits as an interval longer than any, until it is known what it shares with the next one.
        stack.append([1 << 62, Interval(place, word)])


def runs_of(documents: list[list[str]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Of each document its runs of at least ``least`` words, (start, length, period) by start, then period."""
    sizes = np.array([len(d) for d in documents], np.int64)
    out: list[dict[tuple[int, int], int]] = [{} for _ in documents]
    if sizes.sum():
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        number: dict[str, int] = {}
        # A number occurs in one document only; the one behind each document, nowhere else.
        owner = np.repeat(np.arange(len(documents)), sizes + 1)
        words = np.fromiter((number.setdefault(w, len(number)) for d in documents for w in [*d, ""]), np.int64, int(starts[-1]))
        words = words * len(documents) + owner
        half = -(-least // 2)
        places, known = repeated_places(words, half)
        if len(places):
            order, shared = lcp_order(places, known, words, half)
            before = np.where(order > starts[owner[order]], words[order - 1], -1)
            for a, b, length in maximal_pairs(order.tolist(), shared.tolist(), before.tolist(), least):
                document = int(owner[a])
                start = int(starts[document])
                key = (a - start, b + length - start)
                found = out[document]
                found[key] = min(b - a, found.get(key, b - a))
    return [sorted((a, b - a, period) for (a, b), period in found.items()) for found in out]


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words but those of a run behind its first period, one space between."""
    if not runs:
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    dropped = np.cumsum(change)
    return " ".join([w for w, d in zip(words, dropped.tolist()) if not d])


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, runs (by start, then period) and collapsed, the text without the repeats, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for part in slices(batches, "text", 2 << 20):
            documents = [_WORDS.findall(text) for text in texts(part, "text")]
            found = runs_of(documents, least)
            rows = [[{"start": a, "length": b, "period": c} for a, b, c in runs] for runs in found]
            collapsed = [collapse(words, runs) for words, runs in zip(documents, found, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind), pa.array(collapsed, pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, runs array<{RUN}>, collapsed string")


def planted(text: Column, doc_id: Column) -> Column:
    """The text, of each tenth document with its words from some place on repeating those from there."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    n = F.nullif(F.size(words), F.lit(0))
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    # Words before a, the period, and as much of its repeats as the text has room for.
    period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    spread = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), spread).otherwise(text)


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text", planted(F.col("text"), F.col("doc_id")))
    # The longest run, of equal ones the first: the greatest by (length, -start, -period).
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return periodic_runs(docs).withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"), F.floor(1000 * F.col("_best.length") / -F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
