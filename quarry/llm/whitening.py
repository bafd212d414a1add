"""Whitening of embeddings by a tall-and-skinny QR: no covariance is formed.

Entries become whole numbers, so sums and centring are exact. Each task reduces its rows to one triangle R by QR, triangles meet in a tree, ``FAN`` at a
time, and the last one, as wide as a vector, gives singular values and right vectors on the driver. Rows are then projected and scaled. The fit sees each
distinct vector once.

Defined cases: vectors that are null or empty, or hold null or non-finite entries, or entries of 2**34 and more (64 times such a number is
no longer told exactly), are dropped; so are vectors of another length than the most frequent one (the longest of such); components without variance are not listed, so fewer
than ``top`` may come, and none from a single distinct vector; a deviation beyond a long is null; repeated rows and ids come back as they are; an empty table gives
no rows. Columns other than the two named don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, importable, materialize
from .common import picked

#: Whole numbers are ``floor(SCALE * c) + SHIFT``; the shift cancels in all that is centred and is left out.
SCALE, SHIFT = 64, 1_000_000
#: Bound of entries, triangles that meet at once, rows that are reduced at once.
BOUND, FAN, ROWS = 2.0**34, 16, 4096
#: Singular values below this share of the first are rounding, times the dimension.
FLAT = 2.0**-49


@dataclass(frozen=True)
class Fit:
    n: int
    sums: tuple[int, ...]  # of floor(SCALE * c), per dimension
    vectors: np.ndarray  # a column a component
    values: np.ndarray  # eigenvalues of the covariance
    trace: float
    identity_error: float = 0.0


def _grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of whole numbers; those that don't count are left out."""
    for batch in batches:
        ids, lists = batch.column("vec_id"), batch.column("vector")
        own = lists.values.to_numpy(zero_copy_only=False).astype(float)
        at = lists.offsets.to_numpy().astype(np.int64)
        fit = np.isfinite(own) & (np.abs(own) < BOUND)
        bad = np.concatenate([[0], np.cumsum(~fit)])
        keep = (bad[at[1:]] == bad[at[:-1]]) & (at[1:] > at[:-1]) & ~lists.is_null().to_numpy(zero_copy_only=False)
        raw = np.floor(SCALE * np.where(fit, own, 0)).astype("<i8").tobytes()
        rows = np.flatnonzero(keep).tolist()
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array([raw[8 * at[k] : 8 * at[k + 1]] for k in rows], pa.binary())], ["vec_id", "x"])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exact: in Python's whole numbers where 64 bits are too few."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """n and sums of a batch, a row a dimension."""
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"), d)
            # A batch of up to 2**20 rows of numbers below 2**41 stays within 64 bits.
            for part in np.array_split(x, -(-len(x) // (1 << 20))):
                yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([len(part)] * d, pa.int64()), pa.array(part.sum(0), pa.int64())], ["at", "n", "s"])


def _factors(batches: Iterator[pa.RecordBatch], d: int, n: int, sums: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """The triangle of a task's rows."""
    r = np.empty((0, d))
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            x = _matrix(batch.column("x").slice(lo, ROWS), d)
            r = _triangle(np.vstack([r, _centred(x, n, sums).astype(float) / n]))
    if len(r):
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([len(r)], pa.int32()), pa.array([r.tobytes()], pa.binary())], ["id", "rows", "r"])


def _products(batches: Iterator[pa.RecordBatch], d: int, fit: Fit) -> Iterator[pa.RecordBatch]:
    """Sums of products of whitened entries over a task's rows, a row a pair of components."""
    k = len(fit.values)
    total = np.zeros((k, k))
    for batch in batches:
        y = _whitened(_matrix(batch.column("x"), d), fit)
        total += y.T @ y
    a, b = np.divmod(np.arange(k * k), max(k, 1))
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total.ravel(), pa.float64())], ["a", "b", "s"])


def _whitened(x: np.ndarray, fit: Fit) -> np.ndarray:
    return _centred(x, fit.n, fit.sums).astype(float) / fit.n @ fit.vectors / np.sqrt(fit.values)


def _deviation(far: np.ndarray) -> list[int | None]:
    """Sums of squares of n * x - S, exact; None beyond a long."""
    if far.dtype != object and int(np.abs(far).max(initial=0)) ** 2 * far.shape[1] < 2**63:
        return (far * far).sum(1).tolist()
    return [s if s < 2**63 else None for s in (sum(int(v) ** 2 for v in row) for row in far)]


def grid(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x of the vectors that count: whole numbers, 64-bit and little-endian."""
    importable(rows.sparkSession)
    own = picked(rows, vec_id=vec_id, vector=vector).withColumn("vector", F.col("vector").cast("array<double>"))
    kind = own.schema["vec_id"].dataType.simpleString()
    return own.mapInArrow(_grid, f"vec_id {kind}, x binary")


def fit(distinct: DataFrame, d: int, top: int = 16) -> Fit | None:
    """Means, components and eigenvalues of the vectors ``x`` of length ``d``; None without rows."""
    sums = distinct.mapInArrow(lambda b: _sums(b, d), "at int, n bigint, s bigint").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    if not sums:
        return None
    n, by_dim = sums[0]["n"], {r["at"]: int(r["s"]) for r in sums}
    total = tuple(by_dim[i] for i in range(d))

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        got = table.sort_by("id").to_pylist()
        r = _triangle(np.vstack([np.frombuffer(x["r"]).reshape(x["rows"], d) for x in got]))
        return pa.table({"id": pa.array([key[0].as_py()], pa.int64()), "rows": pa.array([len(r)], pa.int32()), "r": pa.array([r.tobytes()], pa.binary())})

    schema = "id bigint, rows int, r binary"
    level = materialize(distinct.mapInArrow(lambda b: _factors(b, d, n, total), schema), "triangles")
    while level.count() > 1:
        upper = materialize(level.groupBy(F.floor(F.col("id") / FAN).alias("upper")).applyInArrow(meet, schema), "triangles")
        discard(level)
        level = upper
    last = level.first()
    discard(level)
    _, s, vt = np.linalg.svd(np.frombuffer(last["r"]).reshape(last["rows"], d))
    k = min(top, int((s > s.max(initial=0) * d * FLAT).sum()))
    vectors = vt[:k].T
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1, 1)
    found = Fit(n, total, vectors, s[:k] ** 2 / n, float((s**2).sum() / n))
    products = distinct.mapInArrow(lambda b: _products(b, d, found), "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s")).collect() if k else []
    error = max((abs(r["s"] / n - (r["a"] == r["b"])) for r in products), default=0.0)
    return Fit(n, total, vectors, found.values, found.trace, float(error))


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", top: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row a vector that counts and component, by falling variance.

    ``identity_error`` is measured over the fitted vectors: the largest entry, without its sign, of the covariance of what came out, less the identity.
    """
    every = materialize(grid(rows, vec_id, vector), "vectors")
    length = every.groupBy(F.length("x").alias("bytes")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("rows").desc(), F.col("bytes").desc()).first()
    kind = every.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    d = length["bytes"] // 8 if length else 0
    same = every.filter(F.length("x") == 8 * d)
    distinct = materialize(same.select("x").distinct(), "distinct")
    model = fit(distinct, d, top)
    discard(distinct)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    k = len(model.values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = _matrix(batch.column("x"), d), batch.num_rows
            if not m or not k:
                continue
            far = _deviation(_centred(x, model.n, model.sums))
            place = pa.array(np.repeat(np.arange(m), k))
            own = [
                batch.column("vec_id").take(place), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)), pa.array(far, pa.int64()).take(place),
                pa.array(_whitened(x, model).ravel()), pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(own, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return same.mapInArrow(work, schema)
