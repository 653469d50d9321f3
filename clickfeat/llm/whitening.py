"""Embedding whitening with a covariance found by polarisation.

For two dimensions 2 cov(a, b) = var(a + b) - var(a) - var(b): the variances of all dimensions and of all sums of two
dimensions give the whole covariance matrix. The fit is exact:

* An entry c becomes the whole number x = floor(64 c) + 1000000; n vectors have the sums S by dimension.
* Each value is centred before anything is multiplied: y = n x - S, a whole number (n times the distance to the mean).
* Tasks add up the exact squares of y for every dimension and of y_i + y_j for every pair, in 64 bits while they
  fit, else in limbs, and hand on one row per pair; Spark adds the rows of the tasks as decimals.
* The driver gets d (d + 1) / 2 sums for d dimensions, whatever the number of vectors, takes differences of whole
  numbers and rounds once, when a covariance becomes a double. ``eigh`` gives the components.

No row is shuffled: only the sums of the tasks are. The vectors are read again for each pass.

Odd input: vectors that are null or empty or hold a null or non-finite entry are dropped; so are vectors of another
length than most have (the longer length if two are as frequent). Entries beyond +-2^55 count as +-2^55, so that x is
a long. Null, equal and repeated ids each keep their row. A component whose variance is nothing but rounding (one
vector, repeated vectors, constant dimensions) has null ``whitened`` values; ``explained`` is null without variance
and ``identity_error`` without components. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import importable

SCALE, SHIFT, REACH = 64, 1_000_000, float(1 << 55)
COMPONENTS = 32
#: Vectors that are squared at a time.
ROWS = 4096
_LOW32, _LOW31, _LOW60 = (1 << 32) - 1, (1 << 31) - 1, (1 << 60) - 1
_WIDE = pa.decimal128(38, 0)


@dataclass
class Whitening:
    n: int
    sums: list[int]              # S, by dimension
    covariance: np.ndarray
    values: np.ndarray           # eigenvalues, falling
    components: np.ndarray       # unit eigenvectors as columns
    usable: np.ndarray           # components with a variance above rounding
    trace: float

    @property
    def explained(self) -> np.ndarray | None:
        return self.values / self.trace if self.trace > 0 else None


def entries(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """x of every vector of a batch (rows, dims)."""
    c = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.floor(SCALE * np.clip(c, -REACH, REACH)).astype(np.int64) + SHIFT


def total(a: np.ndarray) -> list[int]:
    """Exact column sums of 64-bit or Python numbers."""
    if a.dtype == object:
        return [int(v) for v in a.sum(0)] if len(a) else [0] * a.shape[1]
    return [(h << 32) + lo for h, lo in zip((a >> 32).sum(0).tolist(), (a & _LOW32).sum(0).tolist())]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit numbers if all stay below 2^61, else Python's."""
    mean = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, mean)]
    d = x - np.array(mean, np.int64)
    most = max(abs(int(d.min())), abs(int(d.max()))) if d.size else 0
    if n * (most + 1) < 1 << 61:
        return d * n - np.array(rest, np.int64)
    return d.astype(object) * n - np.array(rest, object)


def square_sums(s: np.ndarray) -> list[int]:
    """Exact column sums of squares (64-bit values below 2^62)."""
    if s.dtype == object:
        return total(s * s)
    most = max(abs(int(s.min())), abs(int(s.max()))) if s.size else 0
    if most * most * max(1, len(s)) < 1 << 63:
        return (s * s).sum(0).tolist()
    a, b = s >> 31, s & _LOW31
    return [(p << 62) + (q << 32) + r for p, q, r in zip(total(a * a), total(a * b), total(b * b))]


def _rows(keys: list[tuple[int, int]], sums: list[int]) -> pa.RecordBatch:
    """Sums in two limbs, so that adding them up stays within a decimal."""
    return pa.record_batch({
        "i": pa.array([k[0] for k in keys], pa.int32()), "j": pa.array([k[1] for k in keys], pa.int32()),
        "high": pa.array([Decimal(v >> 60) for v in sums], _WIDE), "low": pa.array([Decimal(v & _LOW60) for v in sums], _WIDE)})


_SUMS = "i int, j int, high decimal(38,0), low decimal(38,0)"


def _entry_sums(dims: int):
    def run(batches):
        sums, n = [0] * dims, 0
        for batch in batches:
            x = entries(batch, dims)
            sums = [s + v for s, v in zip(sums, total(x))]
            n += len(x)
        if n:
            yield _rows([(i, i) for i in range(dims)] + [(-1, -1)], [*sums, n])
    return run


def _pair_squares(dims: int, n: int, sums: list[int]):
    """For every dimension i the row (i, i), for every pair (i, j) the sum of squares of y_i + y_j."""
    def run(batches):
        keys = [(i, j) for i in range(dims) for j in range(i, dims)]
        out, some = [0] * len(keys), False
        for batch in batches:
            x = entries(batch, dims)
            for lo in range(0, len(x), ROWS):
                y = centred(x[lo:lo + ROWS], n, sums)
                found = []
                for i in range(dims):
                    s = y[:, i:] + y[:, i:i + 1]
                    s[:, 0] = y[:, i]
                    found += square_sums(s)
                out = [a + b for a, b in zip(out, found)]
                some = True
        if some:
            yield _rows(keys, out)
    return run


def _added(parts: DataFrame) -> dict[tuple[int, int], int]:
    """The sums of all tasks: as many rows as there are pairs of dimensions."""
    rows = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return {(r["i"], r["j"]): (int(r["high"]) << 60) + int(r["low"]) for r in rows}


def vectors_of(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, int]:
    """(id, vector) of the usable rows and their length (0 if there are none)."""
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    good = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector")).filter(
        F.col("vector").isNotNull() & (F.size("vector") > 0) & F.coalesce(finite, F.lit(False)))
    most = good.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = most["dims"] if most else 0
    return good.filter(F.size("vector") == dims), dims


def fit(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all ``vectors`` (None if there are none)."""
    if not dims:
        return None
    found = _added(vectors.mapInArrow(_entry_sums(dims), _SUMS))
    n, sums = found[(-1, -1)], [found[(i, i)] for i in range(dims)]
    squares = _added(vectors.mapInArrow(_pair_squares(dims, n, sums), _SUMS))
    cov = np.empty((dims, dims))
    for i in range(dims):
        cov[i, i] = squares[(i, i)] / n ** 3
        for j in range(i + 1, dims):
            cov[i, j] = cov[j, i] = (squares[(i, j)] - squares[(i, i)] - squares[(j, j)]) / (2 * n ** 3)
    values, axes = np.linalg.eigh(cov)
    k = min(components, dims)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    floor = max(float(values[0]), 0.0) * dims * np.finfo(float).eps * 8
    return Whitening(n, sums, cov, values, axes, (values > floor) & (values > 0), sum(squares[(i, i)] for i in range(dims)) / n ** 3)


def projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """(x - S / n) on the usable components, over the square roots of their variances."""
    mean = [s // model.n for s in model.sums]
    rest = np.array([(s - model.n * m) / model.n for s, m in zip(model.sums, mean)])
    z = (x - np.array(mean, np.int64)).astype(np.float64) - rest
    return z @ (model.components[:, model.usable] / np.sqrt(model.values[model.usable]))


def _products(dims: int, model: Whitening):
    """Sums (row -1) and products of the whitened values of a task."""
    def run(batches):
        k = int(model.usable.sum())
        sums, products, some = np.zeros(k), np.zeros((k, k)), False
        for batch in batches:
            w = projected(entries(batch, dims), model)
            sums += w.sum(0)
            products += w.T @ w
            some = True
        if some:
            i, j = np.divmod(np.arange(k * k), k) if k else (np.zeros(0, int), np.zeros(0, int))
            yield pa.record_batch({"i": pa.array([-1] * k + i.tolist(), pa.int32()), "j": pa.array(list(range(k)) + j.tolist(), pa.int32()),
                                   "v": pa.array(np.concatenate([sums, products.ravel()]))})
    return run


def identity_error(vectors: DataFrame, dims: int, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity."""
    k = int(model.usable.sum())
    if not k:
        return None
    rows = vectors.mapInArrow(_products(dims, model), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    mean, products = np.zeros(k), np.zeros((k, k))
    for r in rows:  # one row per pair of components
        if r["i"] < 0:
            mean[r["j"]] = r["v"] / model.n
        else:
            products[r["i"], r["j"]] = r["v"] / model.n
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())


def _whitened(dims: int, model: Whitening):
    def run(batches):
        k = len(model.usable)
        for batch in batches:
            x = entries(batch, dims)
            for lo in range(0, len(x), ROWS):
                part = x[lo:lo + ROWS]
                y = centred(part, model.n, model.sums)
                if y.dtype != object and dims * max(abs(int(y.min())), abs(int(y.max()))) ** 2 >= 1 << 63:
                    y = y.astype(object)
                far = [int(v) for v in (y * y).sum(1)]
                w = np.full((len(part), k), np.nan)
                w[:, model.usable] = projected(part, model)
                flat = pa.array(w.ravel(), mask=np.tile(~model.usable, len(part)))
                yield pa.record_batch({
                    "vec_id": batch.column("key").slice(lo, len(part)),
                    "deviation": pa.array([Decimal(v) if v < 10 ** 38 else None for v in far], _WIDE),
                    "whitened": pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * k, pa.int32()), flat)})
    return run


def whiten(vectors: DataFrame, dims: int, model: Whitening) -> DataFrame:
    """vec_id, deviation (exact; null beyond 38 digits) and the whitened vector of every row."""
    return vectors.mapInArrow(_whitened(dims, model), "vec_id long, deviation decimal(38,0), whitened array<double>")


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_components(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: see :data:`_OUT`. A deviation beyond a long is null."""
    spark = rows.sparkSession
    importable(spark)
    vectors, dims = vectors_of(rows, vector, key)
    model = fit(vectors, dims, components)
    if model is None:
        return spark.createDataFrame([], _OUT)
    error = identity_error(vectors, dims, model)
    share = F.lit(None).cast("double")
    if model.explained is not None:
        share = F.element_at(F.array(*[F.lit(float(v)) for v in model.explained]), F.col("component"))
    out = whiten(vectors, dims, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.withColumn("component", F.col("at") + 1).select(
        "vec_id", "component", F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation as long)").alias("deviation"), "whitened",
        share.alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
