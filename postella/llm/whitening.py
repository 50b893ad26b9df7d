"""Whitening of embeddings: leading eigenvectors of the covariance by LOBPCG over distributed block products.

Entries are scaled to integers, the fit list is each distinct vector once, and the covariance is never made: a pass
over the fit list multiplies it, centred row by row, with a block of at most three times `block` orthonormal directions.
The driver holds such blocks alone, of as many rows as a vector has entries, whatever the number of vectors. Each step is
a Rayleigh-Ritz projection on the span of the iterate, its residual and the previous direction; residuals come from
products with the covariance itself, so what they certify doesn't drift.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from .common import pick

#: Entries count in steps of 1 / SCALE.
SCALE = 256
#: Directions iterated beside the wanted ones, so that close eigenvalues don't hold them up.
GUARD = 16
#: Steps at most, and steps without gain after which the residuals are as small as the products' rounding lets them be.
STEPS, PATIENCE = 500, 8
#: Residual norms over the largest eigenvalue: what is aimed at, times the root of the dimensions, and what is accepted at least.
AIM, ACCEPT = 8 * np.finfo(float).eps, 1e-12


@dataclass(frozen=True)
class Whitener:
    """n vectors with sums S; components: columns of unit length; values: their eigenvalues; trace of the covariance;
    residuals of the components over the largest eigenvalue; error: of the whitened fit list's covariance from the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    error: float | None
    steps: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def spread(self) -> np.ndarray:
        """Which components the vectors vary in, beyond rounding."""
        return self.values > len(self.sums) * np.finfo(float).eps * self.trace

    @property
    def scaled(self) -> np.ndarray:
        """Components over the roots of their eigenvalues; zero where there is no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.spread, self.components / np.sqrt(self.values), 0.0)


def integers(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(k, x): ids and scaled vectors, without those that are null or hold null or non-finite entries."""
    rows = pick(df, k=(id_col, "long"), v=(vector_col, "array<double>"))
    whole = F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    return rows.where(whole).select("k", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _numbered(block: np.ndarray) -> pa.RecordBatch:
    """A block as rows (i, q0, q1, ...)."""
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(block), dtype=np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in block.T]], names=["i", *[f"q{j}" for j in range(block.shape[1])]])


def summed(rows: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over tasks of the block that each makes of its rows; tasks' blocks are added up by row in the cluster."""
    names = [f"q{j}" for j in range(shape[1])]
    parts = rows.mapInArrow(lambda batches: iter([_numbered(make(batches))]), "i int, " + ", ".join(f"{q} double" for q in names))
    got = parts.groupBy("i").agg(*[F.sum(q).alias(q) for q in names]).toArrow()
    out = np.zeros(shape)
    out[got.column(0).to_numpy()] = np.stack([got.column(q).to_numpy() for q in names], 1) if got.num_rows else 0
    return out


def block_product(fit: DataFrame, mean: np.ndarray, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """Multiplies a block by the covariance of the fit list, without making it."""
    d = len(mean)

    def product(block: np.ndarray) -> np.ndarray:
        def make(batches):
            total = np.zeros(block.shape)
            for b in batches:
                x = _matrix(b.column(0), d) - mean
                total += x.T @ (x @ block)
            return total

        return summed(fit, make, block.shape) / n

    return product


def _orthonormal(blocks: list[np.ndarray]) -> np.ndarray:
    """A basis of the span of the blocks, of which the first is orthonormal already; directions that are within rounding
    in the span of those before are left out."""
    basis = blocks[0]
    for b in blocks[1:]:
        size = np.linalg.norm(b, axis=0)
        b = b[:, size > 0] / size[size > 0]
        for _ in range(2):
            b = b - basis @ (basis.T @ b)
            if b.shape[1]:
                u, s, _ = np.linalg.svd(b, full_matrices=False)
                b = u[:, s > 1e-10]
        basis = np.hstack([basis, b])
    return basis[:, : len(basis)]


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues of the symmetric operator, their vectors, their residual norms over the largest
    eigenvalue, and the number of products. An error if residuals don't get below ACCEPT."""
    m = min(d, k + GUARD)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, m)))[0]
    blocks: list[np.ndarray] = [x]
    best, since = np.inf, 0
    for step in range(1, STEPS + 1):
        basis = _orthonormal(blocks)
        image = product(basis)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:m], turn[:, ::-1][:, :m]
        new, residual = basis @ turn, image @ turn
        residual -= new * values
        top = max(values[0], 0.0)
        norms = np.linalg.norm(residual[:, :k], axis=0) / (top or 1.0)
        worst = norms.max()
        since = 0 if worst < best / 2 else since + 1
        best = min(best, worst)
        if worst <= AIM * np.sqrt(d) or (worst <= ACCEPT and since >= PATIENCE):
            return np.maximum(values[:k], 0.0), new[:, :k] / np.linalg.norm(new[:, :k], axis=0), norms, step
        blocks = [np.linalg.qr(new)[0], residual, new - x @ (x.T @ new)]
        x = blocks[0]
    raise ArithmeticError(f"residuals are {best:.3g} of the largest eigenvalue after {STEPS} steps")


def fit_whitener(x: DataFrame, k: int = 4, seed: int = 0) -> Whitener | None:
    """Of (x) as `integers` gives them, all of one length. The fit list is written to the shared folder once, and read by each step."""
    spark = x.sparkSession
    path = f"{shared_folder(spark)}/whitening/{uuid.uuid4().hex}"
    x.select("x").distinct().write.parquet(path)
    fit = spark.read.parquet(path)
    n, most = fit.agg(F.count("*"), F.max(F.array_max(F.transform("x", lambda c: F.abs(F.greatest(c, F.lit(1 - (1 << 63)))))))).first()
    if not n or most is None:
        return None
    kind = "long" if n * most < 1 << 62 else "decimal(20,0)"
    sums = [int(r[1]) for r in fit.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast(kind))).orderBy("pos").collect()]
    d, mean = len(sums), np.array([s / n for s in sums])
    product = block_product(fit, mean, n)

    def squares(batches):
        return sum((np.square(_matrix(b.column(0), d) - mean).sum(0) for b in batches), np.zeros(d))[:, None]

    trace = float(summed(fit, squares, (d, 1)).sum() / n)
    values, components, residuals, steps = lobpcg(product, d, min(k, d), seed)
    # either sign is right; the largest entry is made positive
    components = components * np.sign(components[np.abs(components).argmax(0), np.arange(components.shape[1])])
    w = Whitener(n, sums, components, values, trace, residuals, None, steps)
    kept = w.scaled[:, w.spread]
    m = kept.shape[1]
    if not m:
        return w

    def moments(batches):
        total = np.zeros((m + 1, m))
        for b in batches:
            z = (_matrix(b.column(0), d) - mean) @ kept
            total[0] += z.sum(0)
            total[1:] += z.T @ z
        return total

    got = summed(fit, moments, (m + 1, m)) / n
    return Whitener(n, sums, components, values, trace, residuals, float(np.abs(got[1:] - np.outer(got[0], got[0]) - np.eye(m)).max()), steps)


OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _deviations(x: np.ndarray, w: Whitener) -> pa.Array:
    """Sums over the entries of (n x - S)^2, exact: in longs where they surely fit, else in integers of any size; null beyond 38 digits."""
    most = max(int(np.abs(x.astype(float)).max(initial=0)), max(map(abs, w.sums)) // w.n) + 1
    if len(w.sums) * (2 * w.n * most) ** 2 < 1 << 62:
        a = x * w.n - np.array(w.sums)
        return pa.array((a * a).sum(1), pa.int64()).cast(pa.decimal128(38, 0))
    s, y = np.array(w.sums, object), x.astype(object)
    exact = w.n * w.n * (y * y).sum(1) - 2 * w.n * (y * s).sum(1) + int((s * s).sum())
    return pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def whiten(df: DataFrame, k: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 0) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each vector's coordinates on the k leading
    components of the fit list's covariance, in units of their deviations.

    Left out are vectors that are null, hold null or non-finite entries, or are of another length than most (the longer of
    two that are as frequent). Repeated vectors count once in the fit and each gets its rows; a null id stays. Entries beyond
    the range of longs are the nearest long. Where the vectors don't vary in a component (one distinct vector, constant
    entries) whitened is null, explained 0, and identity_error is of the others, null if there is none. Fewer than k entries
    have as many components as entries. An empty table, or one of empty vectors, gives no rows. Columns are taken by name,
    others don't matter. Among equal eigenvalues any basis is right; the signs make each component's largest entry positive."""
    spark = df.sparkSession
    every = integers(df, id_col, vector_col)
    length = every.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None or not length.d:
        return spark.createDataFrame([], OUT)
    d = length.d
    x = every.where(F.size("x") == d)
    w = fit_whitener(x, k, seed)
    scaled, mean, spread = w.scaled, w.mean, w.spread
    m = len(spread)
    explained = w.values / w.trace if w.trace > 0 else np.zeros(m)

    def run(batches):
        for b in batches:
            rows = _matrix(b.column(1), d)
            at = np.repeat(np.arange(len(rows)), m)
            z = ((rows - mean) @ scaled).ravel()
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(at)),
                pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(rows))),
                pa.array(np.full(len(at), w.n, np.int64)),
                _deviations(rows, w).take(pa.array(at)),
                pa.array(z, mask=~np.tile(spread, len(rows))),
                pa.array(np.tile(explained, len(rows))),
                pa.array(np.full(len(at), np.nan if w.error is None else w.error), mask=np.full(len(at), w.error is None)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(run, OUT)
