"""Bounded samples of labelled texts, for models that the driver fits.

Texts stay on the executors: a sample is a table, ``gather`` turns each of its texts into a few bytes of features there, and only
those come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import importable, materialize

#: Bounds of a sample: documents of each class, and characters of all texts together. A text of more than a tenth of the
#: characters is no part of a sample.
PER_CLASS = 3000
CHARS = 40_000_000
#: Labels that are broadcast at most, a row each.
BROADCAST_LABELS = 100_000


def lowest(known: DataFrame, per_class: int, *ties: str) -> DataFrame:
    """``known`` (doc_id, label, ...) with ``rank``, the ``per_class`` rows of each label with the lowest hashes of the id.

    Hashes are counted by their first 16 bits; the few rows up to the range in which a label is full are all that is ranked.
    Rows of one id are ordered by ``ties``.
    """
    marked = known.withColumn("_mark", F.coalesce(F.xxhash64(F.col("doc_id").cast("string")), F.lit(0))).withColumn("_bin", F.shiftright("_mark", 48))
    before = W.partitionBy("label").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    bins = marked.groupBy("label", "_bin").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(before))
    cut = bins.filter(F.coalesce("before", F.lit(0)) < per_class).groupBy("label").agg(F.max("_bin").alias("_last"))
    cut = materialize(cut, "cut")
    few = marked.join(F.broadcast(cut) if cut.count() <= BROADCAST_LABELS else cut, "label").filter("_bin <= _last")
    rank = F.row_number().over(W.partitionBy("label").orderBy("_mark", "doc_id", *ties))
    return few.withColumn("rank", rank).filter(F.col("rank") <= per_class).drop("_mark", "_bin", "_last")


def sample(docs: DataFrame, labels: DataFrame, learn_from: Column, per_class: int = PER_CLASS, chars: int = CHARS) -> tuple[DataFrame, dict[int, int]]:
    """A table of text, label and rank of at most ``per_class`` documents a class and ``chars`` characters in all, and the number
    of labelled documents of each class.

    ``labels``: (doc_id, label), the greatest label counts where an id has several; null labels don't. ``learn_from`` is
    a condition on doc_id. Lowest hashes of the id come first, at every size. An id that several texts share is one document, with the least text.
    """
    known = labels.filter(learn_from & F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    known = materialize(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "known")
    # At most per_class rows a class.
    ids = F.broadcast(lowest(known, per_class))
    texts = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "label", "rank").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    fit = materialize(texts.withColumn("size", F.length("text")).filter(F.col("size") <= chars // 10).select("text", "label", "rank", "size"), "sample")
    upto = W.partitionBy(F.lit(0)).orderBy("rank", "label").rowsBetween(W.unboundedPreceding, 0)
    within = fit.select("rank", "label", F.sum("size").over(upto).alias("sum")).filter(F.col("sum") <= chars).select("rank", "label")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    return materialize(fit.join(F.broadcast(within), ["rank", "label"]).select("text", "label", "rank"), "sample"), sizes


def gather(rows: DataFrame, features: Callable[[str], dict[str, object]], kinds: dict[str, pa.DataType]) -> dict[str, list | np.ndarray]:
    """Features of the texts of ``rows`` (text, label, rank), made on the executors, in the order of rank and label.

    ``features`` gives a value of the ``kinds``, binary or whole numbers, for each text. Binary columns come as lists of bytes, others as arrays.
    """
    importable(rows.sparkSession)
    names = {pa.binary(): "binary", pa.int64(): "bigint"}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(x.as_py()) for x in batch.column("text")]
            own = [pa.array([m[k] for m in made], kind) for k, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("rank"), *own], ["label", "rank", *kinds])

    got = rows.mapInArrow(work, "label int, rank int, " + ", ".join(f"{k} {names[kind]}" for k, kind in kinds.items())).toArrow()
    got = got.sort_by([("rank", "ascending"), ("label", "ascending")])
    return {k: got.column(k).to_pylist() if kinds.get(k) == pa.binary() else got.column(k).to_numpy() for k in got.column_names}


def balanced(labels: np.ndarray, sizes: dict[int, int]) -> np.ndarray:
    """Weights, 1 in all, that give the classes back the shares that they have among all labelled documents."""
    values, have = np.unique(labels, return_counts=True)
    share = {int(v): sizes[int(v)] / n for v, n in zip(values, have, strict=True)}
    weight = np.array([share[int(x)] for x in labels], float)
    return weight / max(weight.sum(), 1e-300)


class Adam:
    """Steps of a full-batch descent on numpy arrays, in place."""

    def __init__(self, params: list, rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-12)
