"""Operator 12: embedding whitening by Chebyshev-filtered subspace iteration over distributed passes.

The covariance matrix is never formed. A pass multiplies it with a narrow block Q: each task centres its vectors, projects them
on Q and back (XᵀXQ), and Spark adds up the products. Each round

1. filters the block by a Chebyshev polynomial of the covariance, one pass a degree by the three-term recurrence: parts of the
   spectrum below the block's smallest Ritz value are damped, parts above grow with the degree;
2. makes it orthonormal (QR) and solves the projected problem (Rayleigh-Ritz, one pass more), whose residuals tell how near the
   vectors are to eigenvectors.

It ends on a certificate: the wanted vectors' residuals are at the rounding level, and a pass over an orthonormal basis of the
block's complement shows that no eigenvalue outside the block exceeds the wanted ones. A direction that the block has missed
would show there; it is taken into the block and the rounds go on.

Sums of the whole numbers are exact at any size, and vectors are centred by the exact mean: a whole part, which is subtracted
without rounding, and a fraction. Only blocks of (dimensions) x (width) sums come to the driver. A pass reads the packed blocks
from the shared folder, so a lost executor costs no more than its tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrisk.functions.shared import Scratch
from linkrisk.llm.vectors import EXACT, Partial, as_int, blocks_of, exact_sums, finite, held, whole

COMPONENTS = 32
SCALE = 64
SEED = 12
#: Vectors of a packed block.
BLOCK = 1024
#: Degree of the filter's polynomial.
DEGREE = 12
#: Residuals of this share of the largest eigenvalue are certified at once; those that no longer shrink, up to the second one.
NEAR, NEAR_ENOUGH = 1e-14, 1e-11
#: Components with less than this share of the largest eigenvalue have no spread that could be whitened.
LEAST_SHARE = 1e-12
MOST_ROUNDS = 200
#: What a long can hold after the contract's offset.
LARGEST = 1 << 62


@dataclass
class Centre:
    """The exact mean of n vectors: sums = n * base + rest, with 0 <= rest < n."""

    n: int
    sums: list[int]
    largest: int

    def __post_init__(self) -> None:
        self.base = [s // self.n for s in self.sums]
        self.rest = [s % self.n for s in self.sums]
        self.fraction = np.array([r / self.n for r in self.rest])
        self.plain = max([self.largest, *map(abs, self.base)], default=0) < EXACT // 4

    def whole(self, x: np.ndarray) -> np.ndarray:
        """x less the mean's whole part: exact doubles, or Python's whole numbers where those are not."""
        if self.plain:
            return x - np.array(self.base, float)
        return as_int(x) - np.array(self.base, object)

    def of(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, in doubles."""
        return self.whole(x).astype(float) - self.fraction

    def deviation(self, x: np.ndarray) -> list[int]:
        """The exact sum over dimensions of (n * x - sums)^2 for each row.

        With a = x - base it is n^2 * sum(a^2) - 2 n * sum(a * rest) + sum(rest^2), whose sums are small where x is.
        """
        a = self.whole(x)
        reach = int(np.abs(a).max(initial=0))
        if max(1, x.shape[1]) * reach * max(reach, self.n) < 1 << 62:
            a, rest = a.astype(np.int64), np.array(self.rest, np.int64)
        else:
            a, rest = as_int(a), np.array(self.rest, object)
        squares, mixed = (a * a).sum(axis=1).tolist(), (a * rest).sum(axis=1).tolist()
        own = sum(r * r for r in self.rest)
        return [self.n * self.n * s - 2 * self.n * m + own for s, m in zip(squares, mixed, strict=True)]


def entries(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), held at +-2^62."""
    out = whole(x, scale)
    return np.array(np.clip(out, -LARGEST, LARGEST), float)


def packed(rows: DataFrame, dims: int, size: int, scale: int) -> DataFrame:
    """(ids, values): blocks of rows (vec_id, v) as packed whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in blocks_of(batches, dims, size):
            columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([entries(x, scale).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "values"])

    return rows.select("vec_id", "v").mapInArrow(run, "ids array<long>, values binary")


def unpacked(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[list, np.ndarray]]:
    for batch in batches:
        for ids, values in zip(batch.column("ids"), batch.column("values"), strict=True):
            yield ids.as_py(), np.frombuffer(values.as_buffer(), float).reshape(-1, dims)


def added_up(blocks: DataFrame, dims: int, size: int, of_rows) -> np.ndarray:
    """The sum over all blocks of ``of_rows(x)``, an array of ``size`` doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for _, x in unpacked(batches, dims):
            total += of_rows(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["i", "value"])

    out = np.zeros(size)
    for i, value in blocks.mapInArrow(run, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect():
        out[i] = value
    return out


class Covariance:
    """The covariance of the packed vectors, as an operator."""

    def __init__(self, blocks: DataFrame, dims: int, centre: Centre):
        self.blocks, self.dims, self.centre = blocks, dims, centre
        self.passes = 0

    def times(self, q: np.ndarray) -> np.ndarray:
        """The covariance times q, by one pass."""
        centre = self.centre

        def product(x: np.ndarray) -> np.ndarray:
            c = centre.of(x)
            return (c.T @ (c @ q)).ravel()

        self.passes += 1
        return added_up(self.blocks, self.dims, q.size, product).reshape(q.shape) / centre.n

    def trace(self) -> float:
        centre = self.centre
        return float(added_up(self.blocks, self.dims, 1, lambda x: (centre.of(x) ** 2).sum())[0]) / centre.n


def orthonormal(x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x)[0]


def filtered(v: Covariance, x: np.ndarray, vx: np.ndarray, top: float, edge: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of the covariance, small on [0, edge] and of size 1 at ``top``, times x; vx is the first product.

    Three terms at a time, scaled so that nothing overflows.
    """
    half = edge / 2
    sigma = first = half / (top - half)
    y = (vx - half * x) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        x, y = y, 2 * (following / half) * (v.times(y) - half * y) - sigma * following * x
        sigma = following
    return y


def complement(v: Covariance, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values and vectors, by falling value, of the covariance on all that is orthogonal to q; a pass per width of q."""
    z = np.linalg.qr(q, mode="complete")[0][:, q.shape[1] :]
    vz = np.concatenate([v.times(z[:, i : i + q.shape[1]]) for i in range(0, z.shape[1], q.shape[1])], axis=1) if z.shape[1] else z
    h = z.T @ vz
    values, vectors = np.linalg.eigh((h + h.T) / 2)
    return values[::-1], z @ vectors[:, ::-1]


def eigenpairs(v: Covariance, k: int, seed: int = SEED, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their vectors, certified."""
    dims = v.dims
    width = min(dims, k + max(8, k // 2))
    q = orthonormal(np.random.default_rng(seed).normal(size=(dims, width)))
    before = np.inf
    for _ in range(MOST_ROUNDS):
        vq = v.times(q)
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = max(float(values[0]), 0.0)
        left = float(np.linalg.norm(vq[:, :k] - q[:, :k] * values[:k], axis=0).max(initial=0))
        if left <= NEAR * top or left > before / 2 and left <= NEAR_ENOUGH * top:
            others, directions = complement(v, q)
            if not len(others) or others[0] <= values[k - 1] + max(left, NEAR * top):
                return values[:k], q[:, :k]
            # missed directions take the place of the guard vectors
            found = directions[:, : width - k] if width > k else directions[:, :1]
            q, before = orthonormal(np.concatenate([q[:, : width - found.shape[1]], found], axis=1)), np.inf
            continue
        before = left
        edge = float(values[-1])
        # a block that holds all the spread needs no filter; one product leaves nothing outside it
        q = orthonormal(vq if edge <= LEAST_SHARE * top else filtered(v, q, vq, top, edge, degree))
    raise RuntimeError(f"no certificate after {MOST_ROUNDS} rounds; largest residual {left}")


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED, degree: int = DEGREE,
    key: str = "vec_id", vector: str = "embedding", block: int = BLOCK,
) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(rows, eigenvalues, eigenvectors): vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are left out. Each entry c becomes floor(scale * c); a constant
    added to all entries would change nothing of the result. Entries that do not fit a long are held at +-2^62. All vectors are
    taken to have one length: where lengths differ, the most frequent one counts (of equally frequent ones the largest), and
    rows of other lengths are left out. A direction with less than 1e-12 of the largest eigenvalue has no spread to whiten and
    gives no rows; so a single vector, or equal vectors, or an empty table give none. Repeated rows are rows of their own, rows
    without id keep their null. Equal eigenvalues have any orthonormal vectors of their space. A deviation that a long cannot
    hold is given as the largest long. Other columns are ignored, whatever they are called.
    """
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], WHITENED), np.empty(0), np.empty((0, 0))
    scratch = Scratch(spark, "whitening")
    rows = vectors.select(vectors[key].cast("long").alias("vec_id"), finite(vectors[vector]).alias("v")).where("v is not null")
    length = rows.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if not length or not length["dims"]:
        return nothing
    dims, n = length["dims"], length["n"]
    blocks = scratch.keep(packed(rows.where(F.size("v") == dims), dims, block, scale), "packed")

    def sums(batches: Iterator[pa.RecordBatch]) -> Partial:
        out: Partial = {}
        for _, x in unpacked(batches, dims):
            small = np.abs(x).max(initial=0) * len(x) < EXACT
            for i, s in enumerate((x if small else as_int(x)).sum(axis=0)):
                out[0, i] = out.get((0, i), 0) + int(s)
        return out

    exact = exact_sums(blocks, sums)
    reach = rows.where(F.size("v") == dims).agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    centre = Centre(n, [exact.get((0, i), 0) for i in range(dims)], min(LARGEST, int(reach) * scale + scale))
    v = Covariance(blocks, dims, centre)
    values, q = eigenpairs(v, min(components, dims), seed, degree)
    some = values > LEAST_SHARE * max(float(values[0]), 0.0)
    values, q = values[some], q[:, some]
    if not len(values):
        return nothing
    explained = values / v.trace()
    k, projection = len(values), q / np.sqrt(values)

    # the whitened vectors' covariance, centred by their own mean
    mean = added_up(blocks, dims, k, lambda x: (centre.of(x) @ projection).sum(axis=0)) / n

    def products(x: np.ndarray) -> np.ndarray:
        w = centre.of(x) @ projection - mean
        return (w.T @ w).ravel()

    error = float(np.abs(added_up(blocks, dims, k * k, products).reshape(k, k) / n - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in unpacked(batches, dims):
            m = len(ids)
            columns = [
                pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, n), pa.int64()),
                pa.array(np.repeat(np.array([held(d) for d in centre.deviation(x)], np.int64), k)),
                pa.array((centre.of(x) @ projection).ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in WHITENED.split(", ")])

    return blocks.mapInArrow(run, WHITENED), values, q


def digest(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return whiten(vectors)[0]
