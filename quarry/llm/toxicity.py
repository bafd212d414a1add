"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and only documents have labels. A sentence is toxic with p_s = sigmoid(b + sum of the weights of
its hashed words and word beginnings); a document is, by noisy-or, with 1 - (1 - leak) * product of (1 - p_s). Weights, b and leak are
fitted together to the labels of documents; the leak takes up labels that no sentence explains, so they don't teach
words. The same p_s then name the offending sentences.

The fit uses a bounded sample of labelled documents (see ``labelled.sample``) and the words whose document share
differs between the labels by more than ``SCREEN`` standard errors. Scoring reads whole texts.

Defined cases: a null, empty or wordless text has no sentence and scores the leak; without labels of both kinds all
texts score the share of label 1 (0 without labels); repeated rows each get the same score; an empty table gives an empty result;
columns other than the id and the text are never read, those named like the result's, in any case, give way. A very long
text is read a sentence at a time; it needs a few times its own memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import importable
from . import labelled
from .common import Box

BUCKETS = 1 << 18
SCREEN = 3.5
EPOCHS = 400
#: Known words that a worker keeps before it starts anew.
MEMO = 100_000
#: Rows that a worker returns at a time.
ROWS = 1000
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


def buckets(word: str) -> list[int]:
    """Hashes of a word and of its beginnings of 3 to 6 letters: inflected and compound words share what they learn."""
    parts = [f"{word}$", *(word[:k] for k in range(3, 7) if len(word) >= k)]
    return [crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in parts]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    def __init__(self, weights: dict[int, float], bias: float, leak: float) -> None:
        self.weights, self.bias, self.leak = weights, bias, leak
        self.memo: dict[str, tuple[int, ...]] = {}

    def known(self, word: str) -> tuple[int, ...]:
        """Buckets of a word that have a weight."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[word] = tuple(b for b in buckets(word) if b in self.weights)
        return found

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of a text and its offending sentences as (start, end, p_s)."""
        kept, offending = np.log1p(-self.leak), []
        plain, rest = 0, float(sigmoid(np.array(self.bias)))
        for m in SENTENCE.finditer(text or ""):
            words = WORD.findall(m[0].lower())
            if not words:
                continue
            found = {b for own in map(self.known, words) if own for b in own}
            if not found:
                plain += 1
                continue
            p = float(sigmoid(np.array(self.bias + sum(self.weights[b] for b in sorted(found)))))
            kept += np.log1p(-min(p, 1 - 1e-12))
            if p >= 0.5:
                offending.append((m.start(), m.end(), p))
        return float(-np.expm1(kept + plain * np.log1p(-rest))), offending


class Bags:
    """Labelled documents as flat arrays: of each sentence with a chosen bucket its document, of each entry its sentence and its word."""

    def __init__(self, y: np.ndarray, weight: np.ndarray, plain: np.ndarray, doc: np.ndarray, at: np.ndarray, words: np.ndarray) -> None:
        self.y, self.weight, self.plain, self.doc, self.at, self.words = y, weight, plain, doc, at, words


def sentences(text: str | None) -> list[list[int]]:
    """Distinct buckets of each sentence that has a word."""
    memo: dict[str, list[int]] = {}
    found = [sorted({b for w in WORD.findall(s.lower()) for b in memo.get(w) or memo.setdefault(w, buckets(w))}) for s in SENTENCE.findall(text or "")]
    return [s for s in found if s]


def shares(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of label 0 and 1 that hold each bucket (2 by BUCKETS), and the number of documents of each label."""
    importable(rows.sparkSession)

    def work(batches: Iterator) -> Iterator:
        for batch in batches:
            for label, text in zip(batch.column("label"), batch.column("text"), strict=True):
                own = np.unique(np.fromiter((b for s in sentences(text.as_py()) for b in s), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), label.as_py(), np.int32)), pa.array(own)], ["label", "bucket"])

    held = rows.select((F.col("label") > 0).cast("int").alias("label"), "text").mapInArrow(work, "label int, bucket int")
    found = held.groupBy("label", "bucket").agg(F.count(F.lit(1)).cast("int").alias("n")).toArrow()  # a row a label and bucket
    seen = np.zeros((2, BUCKETS))
    seen[found.column("label").to_numpy(), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    n = {r["label"]: r["n"] for r in rows.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return seen, np.array([n.get(0, 0), n.get(1, 0)])


def screen(seen: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets whose document share differs between the labels by more than SCREEN standard errors, and the sign of it."""
    n = np.maximum(docs, 1)
    p = (seen.sum(axis=0) + 1) / (n.sum() + 2)
    z = (seen[1] / n[1] - seen[0] / n[0]) / np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))
    chosen = np.flatnonzero(np.abs(z) > SCREEN)
    return chosen.astype(np.int32), np.sign(z[chosen])


def bagged(rows: DataFrame, sizes: dict[int, int], chosen: np.ndarray) -> Bags:
    """What the fit reads of the sample's texts. Sentences without a chosen bucket are alike: they are only counted."""
    place = {b: i for i, b in enumerate(chosen.tolist())}

    def features(text: str) -> dict[str, object]:
        plain, lengths, words = 0, [], []
        for sentence in sentences(text):
            own = [place[b] for b in sentence if b in place]
            if own:
                lengths.append(len(own))
                words += own
            else:
                plain += 1
        return {"plain": plain, "lengths": np.array(lengths, np.int32).tobytes(), "words": np.array(words, np.int32).tobytes()}

    got = labelled.gather(rows, features, {"plain": pa.int64(), "lengths": pa.binary(), "words": pa.binary()})
    lengths = [np.frombuffer(x, np.int32) for x in got["lengths"]]
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), [len(x) for x in lengths])
    each = np.concatenate(lengths) if lengths else np.zeros(0, np.int32)
    at = np.repeat(np.arange(len(each), dtype=np.int32), each)
    words = np.frombuffer(b"".join(got["words"]), np.int32)
    return Bags((got["label"] > 0).astype(np.int64), labelled.balanced(got["label"], sizes), got["plain"].astype(float), doc, at, words)


def fit(bags: Bags, chosen: np.ndarray, sign: np.ndarray) -> Model:
    """Weights of the chosen buckets, which start with the ``sign`` of what the screening has found."""
    y, weight, doc, at, words = bags.y, bags.weight, bags.doc, bags.at, bags.words
    share = float((y * weight).sum())
    if not 0 < share < 1:
        return Model({}, -40.0, min(max(share, 0.0), 1 - 1e-9))
    w, b, leak = sign * 2.0, np.array([-6.0]), np.array([-3.0])
    adam = labelled.Adam([w, b, leak], 0.05)
    for _ in range(EPOCHS):
        ps, p0, e = sigmoid(b + np.bincount(at, w[words], len(doc))), sigmoid(b)[0], sigmoid(leak)[0]
        log_clean = np.bincount(doc, np.log1p(-np.minimum(ps, 1 - 1e-9)), len(y)) + bags.plain * np.log1p(-p0) + np.log1p(-e)
        clean = np.exp(log_clean)
        # d loss / d log_clean: label 0 costs -log_clean, label 1 costs -log(1 - clean).
        g = weight * np.where(y == 1, clean / np.maximum(1 - clean, 1e-9), -1.0)
        gs = -ps * g[doc]  # d log(1 - p) / d logit is -p
        adam.step([np.bincount(words, gs[at], len(w)) + 1e-5 * w, np.array([gs.sum() - (p0 * bags.plain * g).sum()]), np.array([-(e * g).sum()])])
    return Model({int(k): float(v) for k, v in zip(chosen, w, strict=True)}, float(b[0]), float(sigmoid(leak)[0]))


def train(docs: DataFrame, labels: DataFrame, learn_from: Column) -> Model:
    """``docs`` (doc_id, text), ``labels`` (doc_id, label 0/1); ``learn_from`` is a condition on doc_id.

    Sentences become buckets on the executors. The driver gets a count for each label and bucket, and of the sample's texts the chosen buckets.
    """
    rows, sizes = labelled.sample(docs, labels, learn_from)
    chosen, sign = screen(*shares(rows))
    return fit(bagged(rows, sizes, chosen), chosen, sign)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (default: all) with ``score`` and ``offending``, an array of (start, end, score)."""
    importable(docs.sparkSession)
    box = Box(docs, keep, ["score", "offending"])
    # A text that is kept goes to Python once, as part of its row.
    inside = f"c{box.place(text)}" if box.docs.dtypes[box.place(text)][1] == "string" and box.place(text) in [i for i, _ in box.kept] else None
    rows = box.rows() if inside else box.rows(text=box[text].cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = "array<struct<start:bigint,end:bigint,score:double>>"
    schema = rows.drop("text").withColumns({"score": F.lit(None).cast("double"), "offending": F.lit(None).cast(spans)}).schema

    def judge(batches: Iterator) -> Iterator:
        model = shared.value
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            found = [model.score(x.as_py()) for x in (batch.column("row").field(inside) if inside else batch.column("text"))]
            spans = pa.array([[{"start": a, "end": b, "score": p} for a, b, p in s] for _, s in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([s for s, _ in found], pa.float64()), spans], ["row", "score", "offending"])
        model.memo.clear()  # workers outlive the task

    return box.open(rows.mapInArrow(judge, schema), score=F.col("score"), offending=F.col("offending"))
