"""Personal data by weak supervision.

Candidates are the four base kinds, found by their fixed patterns, and looser forms of the same kinds and of
access secrets. Each candidate is judged by labelers, which vote for, against or not at all: the form
(checksums, octets, digit groups), a gazetteer (mail hosts, calling codes, card issuers, key prefixes), the
words before it, and its make-up. How often each combination of kind, votes and make-up occurs is counted over all
documents; expectation-maximisation on these counts estimates how reliable each labeler is and how likely
each combination is personal data; a logistic classifier trained on that decides every span. Base spans
always stay, the classifier decides on the others, and of overlapping others the earlier, then longer, stays.

The combinations are bounded by the labelers and features, not by the data, so the driver holds a small table.
Patterns are anchored so that none rescans a run of characters; texts are read whole, where they lie.

Defined cases: null and empty texts have no span; a repeated row gives a row each; an empty table none, and no
counts leave the classifier undecided, which keeps base spans only; columns other than doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stagewatch.llm.common import give_back, slices, table, texts
from stagewatch.llm.registry import query

# Kinds in order, patterns of the base kinds, word lists of the labelers.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
MAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE = {
    "email": re.compile(r"\b[A-Za-z0-9._%+-]{1,64}\s?[\[(]\s?at\s?[\])]\s?[A-Za-z0-9-]{1,63}\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[A-Za-z]{2,24}\b", re.I),
    "phone": re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\s?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])"),
    "secret": re.compile(
        r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}+\b"
        r"|\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b\s{0,3}[=:]\s{0,3}[\"']?[^\s\"']{8,}+[\"']?",
        re.I,
    ),
}
HOSTS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu")
CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
PREFIXES = ("akia", "asia", "ghp_", "gho_", "password", "passwd", "pwd", "secret", "token", "api")
CUES = {
    "email": ("mail", "email", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "mastercard", "payment", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono"),
    "secret": ("key", "token", "password", "secret", "login", "credentials"),
}
AGAINST = ("version", "isbn", "section", "example", "page", "number", "chapter")
CUE_WORDS = 4
CUE_CHARACTERS = 48


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @; the local part reaches back to the match or @ before."""
    floor, at = 0, text.find("@")
    while at >= 0:
        # Whatever of the local part's characters stands directly before, behind the last match.
        start = at
        while start > floor and LOCAL_END.match(text, start - 1, start):
            start -= 1
        m = MAIL_DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        floor = m.end() if m else at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds by start, then kind."""
    found = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], BASE.index(s[0])))


DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")
#: What a text must have for a loose pattern to be worth a search.
HINTS = {"email": re.compile(r"[\[(]\s?at\s?[\])]", re.I), "phone": re.compile("[0-9]{3}[-. ][0-9]{4}"), "secret": re.compile("[=:]|A[KS]IA|gh[pousr]_", re.I)}


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further candidates that overlap no base span; a secret may hold some, as its value goes whole."""
    found = []
    for kind, pattern in LOOSE.items():
        if HINTS[kind].search(text):
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], [b for _, b in taken]
    out = []
    for kind, a, b in found:
        k = bisect_right(ends, a)  # the first base span that ends behind a; base spans may overlap each other
        if kind == "secret":
            last = bisect_left(starts, b)  # the first base span that starts behind the secret
            clash = any(y > a and not (x >= a and y <= b) for x, y in taken[max(0, k - len(BASE)) : last])
        else:
            clash = any(x < b and y > a for x, y in taken[max(0, k - len(BASE)) : k + len(BASE)])
        if not clash:
            out.append((kind, a, b))
    return out


def labels(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """Votes of form, gazetteer, context and make-up: 1 for, -1 against, 0 none."""
    value = text[start:end]
    low, digits = value.lower(), NOT_DIGIT.sub("", value)
    if kind == "email":
        form = 1 if "@" in value and not value.startswith(".") and ".." not in value else 0
        known = 1 if low.rpartition(".")[2].strip(" ])") in HOSTS else 0
    elif kind == "ip":
        parts = value.split(".")
        form = -1 if any(len(p) > 1 and p[0] == "0" for p in parts) else 1
        known = -1 if parts[0] in ("0", "255") else 0
    elif kind == "card":
        form, known = 1 if luhn(digits) else -1, 1 if digits.startswith(ISSUERS) else -1
    elif kind == "phone":
        form = 1 if 10 <= len(digits) <= 15 else -1
        known = 1 if value[0] == "+" and digits.startswith(CODES) else 0
    else:
        secret = re.split(r"[=:]", value)[-1].strip(" \"'")
        form = 1 if len(secret) >= 12 and DIGIT.search(secret) else -1
        known = 1 if low.startswith(PREFIXES) else 0
    before = re.findall(r"\w+", text[max(0, start - CUE_CHARACTERS) : start].lower())[-CUE_WORDS:]
    cue = 1 if any(w in CUES[kind] for w in before) else -1 if any(w in AGAINST for w in before) else 0
    variety = len(set(low)) / max(1, min(len(low), 20))
    return form, known, cue, 1 if variety >= 0.35 else -1


def features(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """Kind, votes and make-up in small whole numbers: what candidates are counted by."""
    value = text[start:end]
    share = sum(c.isdigit() for c in value) / max(1, len(value))
    edge = int(start == 0 or not text[start - 1].isalnum()) + 2 * int(end >= len(text) or not text[end].isalnum())
    return (KINDS.index(kind), *labels(text, kind, start, end), min(4, (end - start).bit_length() - 2), round(share * 4), edge)


VOTES = slice(1, 5)


def reliabilities(rows: list[tuple[tuple[int, ...], int]], turns: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """By expectation-maximisation: of each labeler the chance of each vote given either truth (labeler, truth, vote),
    and for each row of ``rows`` how likely it is personal data.

    The start trusts labelers a little, which settles which of the two hidden classes is which.
    """
    votes = np.array([r[VOTES] for r, _ in rows]) + 1
    weight = np.array([n for _, n in rows], float)
    n_labelers = votes.shape[1]
    chance = np.tile(np.array([[0.5, 0.3, 0.2], [0.1, 0.3, 0.6]]), (n_labelers, 1, 1))
    prior, p = 0.5, np.zeros(len(rows))
    for _ in range(turns):
        log = np.log([1 - prior, prior])[:, None] + sum(np.log(chance[k][:, votes[:, k]]) for k in range(n_labelers))
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        prior = float(np.clip((weight * p).sum() / weight.sum(), 0.05, 0.95))
        for k in range(n_labelers):
            for truth, share in enumerate((1 - p, p)):
                # The start's counts stay as a prior, so that no class turns into the other on few votes.
                counts = np.array([(weight * share)[votes[:, k] == v].sum() for v in range(3)])
                base = np.array([[5, 3, 2], [1, 3, 6]][truth], float)
                chance[k, truth] = (counts + base) / (counts + base).sum()
    return chance, p


def _design(rows: list[tuple[int, ...]]) -> np.ndarray:
    a = np.array(rows, float).reshape(-1, 8)
    kinds = np.eye(len(KINDS))[a[:, 0].astype(int)]
    votes = a[:, VOTES]
    return np.hstack([kinds, votes == 1, votes == -1, a[:, 5:6] / 4, a[:, 6:7] / 4, a[:, 7:8] == 3])


@dataclass
class Model:
    weights: np.ndarray | None = None
    chance: np.ndarray | None = None
    known: dict[tuple[int, ...], float] = field(default_factory=dict)

    def probability(self, row: tuple[int, ...]) -> float:
        if self.weights is None:
            return 0.0
        found = self.known.get(row)
        if found is None:
            z = float(_design([row])[0] @ self.weights)
            found = self.known[row] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return found


def train(rows: list[tuple[tuple[int, ...], int]], ridge: float = 1.0) -> Model:
    """The final span classifier, fitted to the estimated truth of every combination."""
    rows = sorted(rows)
    if not rows:
        return Model()
    chance, p = reliabilities(rows)
    a = _design([r for r, _ in rows])
    weight = np.array([n for _, n in rows], float)
    weight *= len(rows) * 10 / weight.sum()
    w = np.zeros(a.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (weight * q * (1 - q))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, a.T @ (weight * (q - p)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return Model(w, chance)


def combinations(docs: DataFrame) -> DataFrame:
    """How often each combination of features occurs among the candidates of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part in slices(batches, "text"):
            for text in texts(part, "text"):
                base = base_spans(text)
                seen.update(features(text, *s) for s in [*base, *loose_spans(text, base)])
        arrays = [pa.array([list(k) for k in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["features", "n"])

    return docs.select("text").mapInArrow(count, "features array<int>, n long").groupBy("features").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> Model:
    return train([(tuple(r["features"]), r["n"]) for r in combinations(docs).collect()])


def spans_of(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans with those that the classifier adds."""
    base = base_spans(text)
    added, end = [], 0
    for kind, a, b in sorted(loose_spans(text, base), key=lambda s: (s[1], -s[2])):
        if a >= end and model.probability(features(text, kind, a, b)) >= 0.5:
            added.append((kind, a, b))
            end = b
    return base, sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0])))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            pairs = [spans_of(text, model) for text in texts(part, "text")]
            counts = [Counter(s[0] for s in base) for base, _ in pairs]
            arrays = [part.column("doc_id")]
            arrays += [pa.array([c[kind] for c in counts], pa.int64()) for kind in BASE]
            arrays.append(pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in pairs]))
            arrays.append(pa.array([_joined(every) for _, every in pairs], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def redact(text: str | None, model: Model) -> str | None:
    """The text with ``[KIND]`` for each span; overlapping spans become one, named by the first."""
    if not text:
        return text
    out, end = [], 0
    for kind, a, b in spans_of(text, model)[1]:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]]) if out else text


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, personal data in ``text`` replaced; n_chars follows the text where the column exists."""

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield column.map(lambda text: redact(text, model))
        give_back()

    out = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*docs.columns)


@query("op4_weak_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))
