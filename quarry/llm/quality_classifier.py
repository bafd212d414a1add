"""Quality classifier: ordinal regression with cumulative links on graded ratings.

P(grade <= k) = sigmoid(t_k - s) with ordered thresholds t_0 < t_1 < ... and one score s a text, shared by all grades: the mean, over its words, of the
weights of the hashed word, of its hashed shape (kinds of characters, runs shortened) and of a repeat of the word before it,
plus a weight of its length class. The thresholds are t_0 and positive steps, so they stay ordered. Expected grade and tail
probability P(grade >= least) come from the same model; selection is by the tail.

Fitted to a bounded sample of labelled documents (``labelled.sample``); scoring reads whole texts.

Defined cases: a null or wordless text has the length class 0 and nothing else; without labels, or with one grade, every text has
that grade (0 without labels) with probability 1; repeated rows each get the same score; an empty table gives an empty result; columns other
than the id and the text are never read. Grades are whole numbers from 0 up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import importable
from . import labelled
from .common import picked

BUCKETS = 1 << 16
EPOCHS = 300
#: Weights are for means, which are small numbers.
SCALE = 20.0
MEMO = 100_000
PARTS = re.compile(r"[^\W\d_]+|\d+|(.)\1*")


def shape(word: str) -> str:
    """Kinds of characters of a word: a lower case, A upper case, C capitalised, x mixed; other characters stand for themselves, runs once."""

    def kind(m: re.Match) -> str:
        part = m[0]
        if m[1]:
            return m[1]
        if part.isdigit():
            return "0"
        return "a" if part.islower() else "A" if len(part) > 1 and part.isupper() else "C" if part[1:].islower() or len(part) == 1 else "x"

    return PARTS.sub(kind, word)


def slot(feature: str) -> int:
    return crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def features(word: str) -> tuple[int, int]:
    return slot("w" + word.lower()), slot("s" + shape(word))


REPEAT = slot("repeat")


def length_class(n: int) -> int:
    return slot(f"n{min(int(n).bit_length(), 12)}")


def vector(text: str | None, memo: dict) -> dict[int, float]:
    """Features of a text: shares of its words, and 1 / SCALE for its length class."""
    words = (text or "").split()
    if len(memo) > MEMO:
        memo.clear()
    counts: Counter[int] = Counter()
    for word, n in Counter(words).items():
        for f in memo.get(word) or memo.setdefault(word, features(word)):
            counts[f] += n
    counts[REPEAT] += sum(a == b for a, b in zip(words, words[1:], strict=False))
    out = {f: n / len(words) for f, n in counts.items()} if words else {}
    out[length_class(len(words))] = out.get(length_class(len(words)), 0.0) + 1 / SCALE
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: list[int]) -> None:
        self.weights, self.thresholds, self.grades = weights, thresholds, grades
        self.memo: dict = {}

    def score(self, text: str | None) -> float:
        return SCALE * sum(self.weights[f] * x for f, x in vector(text, self.memo).items())

    def chances(self, scores: np.ndarray) -> np.ndarray:
        """Probability of each grade for each score."""
        upto = np.hstack([sigmoid(self.thresholds[None, :] - scores[:, None]), np.ones((len(scores), 1))])
        return np.diff(upto, axis=1, prepend=0.0)


def sparse(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels of the texts of ``rows``, and their features as text, bucket and value; the texts themselves stay on the executors."""

    def features(text: str) -> dict[str, object]:
        own = vector(text, {})
        return {"col": np.fromiter(own, np.uint16, len(own)).tobytes(), "val": np.fromiter(own.values(), np.float32, len(own)).tobytes()}

    got = labelled.gather(rows, features, {"col": pa.binary(), "val": pa.binary()})
    row = np.repeat(np.arange(len(got["col"]), dtype=np.int32), [len(x) // 2 for x in got["col"]])
    return got["label"], row, np.frombuffer(b"".join(got["col"]), np.uint16), np.frombuffer(b"".join(got["val"]), np.float32)


def fit(y: np.ndarray, weight: np.ndarray, row: np.ndarray, col: np.ndarray, val: np.ndarray) -> Model:
    """Fits to grades and weights of texts, and their features (text, bucket, value)."""
    grades = sorted(set(y.tolist())) or [0]
    if len(grades) < 2:
        return Model(np.zeros(BUCKETS), np.zeros(0), grades)
    place = np.searchsorted(grades, y)
    val = val * np.float32(SCALE)
    upto = np.cumsum([weight[place == k].sum() for k in range(len(grades))])[:-1].clip(1e-4, 1 - 1e-4)
    start = np.log(upto / (1 - upto))
    w, first, steps = np.zeros(BUCKETS), start[:1].copy(), np.log(np.maximum(np.diff(start), 0.05))
    adam = labelled.Adam([w, first, steps], 0.03)
    n = np.arange(len(y))
    for _ in range(EPOCHS):
        adam.step(gradients(w, first, steps, place, weight, row, col, val, n)[1])
    return Model(w, np.concatenate([first, first + np.cumsum(np.exp(steps))]), grades)


def gradients(w: np.ndarray, first: np.ndarray, steps: np.ndarray, place: np.ndarray, weight: np.ndarray, row: np.ndarray, col: np.ndarray, val: np.ndarray, n: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss (mean log chance of the grades, and a small share of the squared weights) and its slopes by w, first and steps."""
    s = np.bincount(row, val * w[col], len(n))
    t = np.concatenate([first, first + np.cumsum(np.exp(steps))])
    link = sigmoid(t[None, :] - s[:, None])
    high = np.hstack([link, np.ones((len(s), 1))])[n, place]
    low = np.hstack([np.zeros((len(s), 1)), link])[n, place]
    chance = np.maximum(high - low, 1e-9)
    up, down = high * (1 - high) / chance, low * (1 - low) / chance
    gs = weight * (up - down)  # d loss / d s
    gt = np.zeros(len(t) + 2)
    np.add.at(gt, place + 1, -weight * up)
    np.add.at(gt, place, weight * down)
    gt = gt[1:-1]
    tail = np.cumsum(gt[::-1])[::-1]
    loss = -float((weight * np.log(chance)).sum()) + 5e-6 * float((w * w).sum())
    return loss, [np.bincount(col, val * gs[row], BUCKETS) + 1e-5 * w, tail[:1], tail[1:] * np.exp(steps)]


def train(docs: DataFrame, ratings: DataFrame, learn_from: Column) -> Model:
    """``docs`` (doc_id, text), ``ratings`` (doc_id, label); ``learn_from`` is a condition on doc_id."""
    rows, sizes = labelled.sample(docs, ratings, learn_from)
    y, *entries = sparse(rows)
    return fit(y, labelled.balanced(y, sizes), *entries)


def grade(docs: DataFrame, model: Model, least: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, expected_grade and tail (probability of a grade of ``least`` or more) of every text."""
    importable(docs.sparkSession)
    rows = picked(docs, doc_id=doc_id, text=text).withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        grades = np.array(model.grades)
        for batch in batches:
            chances = model.chances(np.fromiter(map(model.score, batch["text"]), np.float64, len(batch)))
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "expected_grade": chances @ grades, "tail": chances[:, grades >= least].sum(axis=1)})
        model.memo.clear()  # workers outlive the task

    return rows.mapInPandas(judge, f"doc_id {dict(rows.dtypes)['doc_id']}, expected_grade double, tail double")
