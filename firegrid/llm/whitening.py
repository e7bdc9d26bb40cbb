"""Whitening of vectors: exact integer moments, and components by spectral divide-and-conquer with QDWH polar factors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.llm.shared import batch_of, in_batches, store

#: Entries scaled beyond this cannot be told from their neighbours as doubles; such vectors count as not finite.
LARGEST = float(1 << 52)
EPS = np.finfo(float).eps

WHITENED = pa.schema(
    [
        ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
    ]
)


# Spectral divide-and-conquer ------------------------------------------------------------------------


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps in their QR form."""
    size = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))  # below every singular value
    except np.linalg.LinAlgError:
        low = EPS
    low = min(max(low, EPS), 1.0)
    for _ in range(30):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        alpha = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root), 0.0))
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(gamma) * x, np.eye(size)]))
        new = beta / gamma * x + (alpha - beta / gamma) / np.sqrt(gamma) * (q[:size] @ q[size:].T)
        new = (new + new.T) / 2
        step = np.linalg.norm(new - x)
        x, low = new, min(low * (alpha + beta * low**2) / (1 + gamma * low**2), 1.0)
        if step < np.cbrt(EPS) and abs(1 - low) < 10 * EPS:
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces of ``a``, larger eigenvalues first; none where it is a multiple of 1.

    The polar factor of ``a`` less a shift has the eigenvalues 1 and -1, so (1 + factor) / 2 projects
    on the eigenvectors above the shift. Shifts are tried until one parts the spectrum cleanly.
    """
    size, scale = len(a), np.linalg.norm(a)
    mean = np.trace(a) / size
    spread = np.linalg.norm(a - mean * np.eye(size))
    if spread <= 4 * EPS * scale:
        return None
    width = spread / np.sqrt(size)
    best = None
    for shift in (float(np.median(np.diag(a))), mean, *(mean + width * f for f in (0.25, -0.25, 0.1, -0.1, 0.5, -0.5, 0.9, -0.9))):
        projector = (np.eye(size) + polar_factor(a - shift * np.eye(size))) / 2
        rank = round(float(np.trace(projector)))
        if not 0 < rank < size:
            continue
        # Two steps of subspace iteration; the start is fixed, so the same matrix gives the same basis.
        start = projector @ np.random.default_rng(size).standard_normal((size, rank))
        basis = np.linalg.qr(projector @ np.linalg.qr(start)[0], mode="complete")[0]
        over, under = basis[:, :rank], basis[:, rank:]
        left = np.linalg.norm(under.T @ a @ over)
        if best is None or left < best[0]:
            best = left, over, under
        if left <= 8 * EPS * scale * np.sqrt(size):
            break
    return None if best is None else best[1:]


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, split down to single components."""
    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    found: list[np.ndarray] = []
    open_ = [np.eye(len(a))]
    while open_:
        basis = open_.pop()
        parts = _split(_symmetric(basis.T @ a @ basis)) if basis.shape[1] > 1 else None
        if parts is None:
            found.append(basis)
        else:
            open_ += [basis @ part for part in parts]
    vectors = np.linalg.qr(np.hstack(found))[0]
    values = (vectors * (a @ vectors)).sum(0)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


# Moments on Spark -----------------------------------------------------------------------------------


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) with x = floor(scale * entry) as longs, without vectors that are null or hold null or non-finite entries."""
    entry = "cast(e AS double)"
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    # Not-a-number is larger than every number, so the bound drops it as well.
    finite = own.where(F.expr(f"v IS NOT NULL AND forall(v, e -> e IS NOT NULL AND abs({entry} * {scale}) < {LARGEST!r}D)"))
    return finite.select("vec_id", F.expr(f"transform(v, e -> cast(floor({entry} * {scale}) AS long))").alias("x"))


@dataclass(frozen=True)
class Moments:
    n: int
    sums: list[int]
    covariance: np.ndarray

    @property
    def means(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def matrix_of(batch: pa.RecordBatch, dims: int, column: str = "x") -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).flatten().to_numpy().reshape(-1, dims)


def _second_moments(rows: DataFrame, dims: int, centred) -> np.ndarray:
    """Sum of the outer products of ``centred(matrix)`` over all rows: added up in tasks, then entry by entry on Spark."""
    size = centred(np.zeros((1, dims), np.int64)).shape[1]
    upper = np.triu_indices(size)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            z = centred(matrix_of(batch, dims))
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), pa.array(total[upper])], names=["at", "v"])

    found = in_batches(rows).select("x").mapInArrow(task, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
    total = np.zeros(len(upper[0]))
    for row in found.collect():  # dims * (dims + 1) / 2 numbers
        total[row["at"]] = row["v"]
    out = np.zeros((size, size))
    out[upper] = total
    return out + np.triu(out, 1).T


def moments(distinct: DataFrame, dims: int) -> Moments:
    """Count, sums and covariance (divisor n) of the distinct vectors, centred before they are multiplied.

    Vectors are centred on the rounded means, so the products are whole numbers and their sums do not
    depend on the order of tasks; what the rounding leaves, at most a half in each dimension, is taken
    off the covariance at the end.
    """
    each = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    sums = [0] * dims
    for row in each.collect():  # one row a dimension
        sums[row["i"]] = int(row["s"])
    n = distinct.count()
    middle = np.array([round(s / n) for s in sums], np.int64)
    products = _second_moments(distinct, dims, lambda x: (x - middle).astype(np.float64))
    rest = np.array([float(s - n * int(m)) / n for s, m in zip(sums, middle)])
    return Moments(n, sums, products / n - np.outer(rest, rest))


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    means: np.ndarray
    projection: np.ndarray  # dims x components, each column an eigenvector over the root of its eigenvalue
    explained: np.ndarray
    identity_error: float


def fit(distinct: DataFrame, dims: int, components: int) -> Whitening:
    """The leading components of the distinct vectors; those without variance are left out."""
    m = moments(distinct, dims)
    values, vectors = eigenvectors(m.covariance)
    trace = float(np.trace(m.covariance))
    kept = min(components, int((values > dims * EPS * max(trace, 0.0)).sum()))
    projection = vectors[:, :kept] / np.sqrt(values[:kept])
    means = m.means
    error = 0.0
    if kept:
        # One more column holds ones, so the same pass gives the means that are taken off.
        def columns(x: np.ndarray) -> np.ndarray:
            return np.hstack([(x - means) @ projection, np.ones((len(x), 1))])

        products = _second_moments(distinct, dims, columns) / m.n
        centre = products[-1, :-1]
        error = float(np.abs(products[:-1, :-1] - np.outer(centre, centre) - np.eye(kept)).max())
    return Whitening(m.n, m.sums, means, projection, values[:kept] / trace if kept else values[:0], error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n * x - sums)^2 for each row, exact; null where a long cannot hold it."""
    rough = ((x * float(n) - np.array([float(s) for s in sums])) ** 2).sum(1)
    small = rough.max(initial=0.0) < 2.0**61 and max((abs(s) for s in sums), default=0) < 1 << 62
    if small and float(n) * float(np.abs(x).max(initial=0)) < 2.0**62:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    whole = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in whole]


def whiten(
    vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Rows of every vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Each distinct quantised vector counts once for the moments. They fit in ``dims`` squared numbers,
    which is all the driver sees and all that tasks receive. Vectors that are null or hold null or
    non-finite entries (or such that a double cannot tell apart) give no rows; rows that repeat, or
    lack an id, are whitened each. The most frequent length of the vectors, the smaller one of two,
    is their dimension; vectors of other lengths give no rows, either. Components beyond the rank of the
    covariance are left out, so fewer than two distinct vectors and an empty table give no rows.
    Components of equal eigenvalues are any basis of their space. Other columns are left out.
    """
    every = quantised(vectors, scale, id_col, vector_col)
    lengths = every.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n"))
    common = lengths.orderBy(F.desc("n"), "dims").first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common is None or common["dims"] == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = common["dims"]
    rows = every.where(F.size("x") == dims)
    w = fit(store(rows.select("x").distinct(), "vectors"), dims, components)
    kept = len(w.explained)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch, dims)
            whitened = (x - w.means) @ w.projection
            each = np.repeat(np.arange(len(x)), kept)
            columns = {
                "vec_id": batch.column(0).take(pa.array(each)),
                "component": np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x)),
                "n": np.full(len(each), w.n),
                "deviation": pa.array(deviations(x, w.n, w.sums), pa.int64()).take(pa.array(each)),
                "whitened": whitened.ravel(),
                "explained": np.tile(w.explained, len(x)),
                "identity_error": np.full(len(each), w.identity_error),
            }
            yield batch_of(WHITENED, columns)

    return in_batches(rows).mapInArrow(task, schema)
