"""Operator 11: centroid clustering with zone maps along a space-filling curve.

Vectors are sorted along a Hilbert curve over all their dimensions (a few bits of each) by a range shuffle, so that vectors that
lie next to each other are near each other, and are cut into blocks. Each block keeps the least and greatest value of every
dimension: its box. A pass over the blocks bounds the distance of a block's vectors to each centroid from below (to the box's
nearest point) and from above (to its farthest corner). A centroid whose lower bound exceeds the least upper bound is nearest
to none of them. Only the block's remaining candidates are compared with its vectors, exactly and all at once.

Equal vectors are told apart by their row when they are sorted, so that a hot vector is spread over as many ranges as it needs;
its blocks' boxes are points. All values are whole numbers: distances are computed in doubles where those are exact, else in
whole numbers of any size, and sums are exact at any size. A round sends (number of centroids) x (dimensions + 2) sums to the
driver. The blocks are written to the shared folder once and read by each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrisk.functions.shared import Scratch
from linkrisk.llm.vectors import EXACT, Partial, as_int, blocks_of, exact_sums, finite, held, rows_of, whole

DIMS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
SEED = 1
#: Vectors of a block.
BLOCK = 128
#: Bits of each dimension that the curve goes through.
BITS = 3
#: How many standard deviations from the mean the curve's cells reach.
REACH = 2.5


def hilbert(cells: np.ndarray, bits: int) -> list[bytes]:
    """The place of each row of cell numbers (below 2^bits) on the Hilbert curve, as bytes that sort like it.

    Skilling's transform, one dimension at a time for all rows: undo the turns from the highest bit down, then Gray code.
    """
    n, dims = cells.shape
    if not dims:
        return [b""] * n
    x = [cells[:, i].astype(np.int64) for i in range(dims)]
    for bit in range(bits - 1, 0, -1):
        q, below = 1 << bit, (1 << bit) - 1
        for i in range(dims):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & below)
            first = x[0] ^ np.where(turned, below, swap)
            x[i] = x[i] ^ swap
            x[0] = first
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(n, np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << bit), (1 << bit) - 1, 0)
    digits = np.stack([((v ^ flip) >> bit) & 1 for bit in range(bits - 1, -1, -1) for v in x], axis=1)
    return [row.tobytes() for row in np.packbits(digits.astype(np.uint8), axis=1)]


def spread_of(kept: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each dimension, as far as doubles hold them: they only shape the curve's cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, dims))
        with np.errstate(over="ignore"):
            for batch in batches:
                x = rows_of(batch, dims)
                total += np.stack([np.full(dims, len(x)), x.sum(axis=0), (x**2).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(3 * dims), pa.int32()), pa.array(total.ravel())], names=["i", "value"])

    sums = np.zeros(3 * dims)
    for i, value in kept.select("v").mapInArrow(run, "i int, value double").groupBy("i").agg(F.sum("value")).collect():
        sums[i] = value
    n, first, second = sums.reshape(3, dims)
    with np.errstate(all="ignore"):
        mean = first / n
        spread = np.sqrt(second / n - mean**2)
    return np.where(np.isfinite(mean), mean, 0), np.where(np.isfinite(spread) & (spread > 0), spread, 1)


def ordered(kept: DataFrame, dims: int, bits: int, size: int) -> DataFrame:
    """(ids, values, lo, hi): blocks of ``kept`` (vec_id, v) along the curve, with their boxes; values are packed doubles."""
    mean, spread = spread_of(kept, dims)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = (rows_of(batch, dims) - mean) / (spread * REACH)  # -1 to 1 for almost all
            cells = np.clip(np.floor((steps + 1) * (1 << bits - 1)), 0, (1 << bits) - 1)
            keys = pa.array(hilbert(cells, bits), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=["vec_id", "v", "row", "curve"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in blocks_of(batches, dims, size):
            columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())]
            columns += [pa.array([edge.tolist()], pa.list_(pa.float64())) for edge in (x.min(axis=0), x.max(axis=0))]
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "values", "lo", "hi"])

    # each row by itself: equal vectors, and equal rows, can be dealt to several ranges
    rows = kept.withColumn("row", F.xxhash64("vec_id", F.monotonically_increasing_id()))
    placed = rows.mapInArrow(place, "vec_id long, v array<double>, row long, curve binary")
    along = placed.repartitionByRange("curve", "row").sortWithinPartitions("curve", "row")
    return along.select("vec_id", "v").mapInArrow(cut, "ids array<long>, values binary, lo array<double>, hi array<double>")


class Nearest:
    """Exact nearest centroids of blocks."""

    def __init__(self, centroids: list[list[int]], scale: int):
        self.centroids, self.scale = centroids, scale
        self.largest = max((abs(v) for c in centroids for v in c), default=0)

    def exact(self, x: np.ndarray) -> bool:
        """Whether distances to x, and their parts, are whole numbers that a double holds."""
        if x.dtype == object:
            return False
        largest = max(self.largest, np.abs(x).max(initial=0))
        return 4 * x.shape[-1] * int(largest) ** 2 < EXACT

    def candidates(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Numbers, rising, of the centroids that may be nearest to a vector in the box; ties stay."""
        box = whole(np.stack([lo, hi]), self.scale)
        if not self.exact(box):
            return np.arange(len(self.centroids))
        c = np.array(self.centroids, float)
        least = (np.maximum(0, np.maximum(box[0] - c, c - box[1])) ** 2).sum(axis=1)
        most = (np.maximum(np.abs(c - box[0]), np.abs(c - box[1])) ** 2).sum(axis=1)
        return np.flatnonzero(least <= most.min())

    def of(self, x: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid's number and squared distance for each row of x; ties go to the smaller number."""
        if self.exact(x):
            c = np.array([self.centroids[i] for i in candidates], float)
            apart = (x**2).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c**2).sum(axis=1)
            best = apart.argmin(axis=1)
            return candidates[best], apart[np.arange(len(x)), best].astype(np.int64)
        x = as_int(x)
        apart = np.stack([((x - np.array(self.centroids[i], object)) ** 2).sum(axis=1) for i in candidates], axis=1)
        best = np.array([min(range(len(candidates)), key=row.__getitem__) for row in apart.tolist()], int)
        return candidates[best], apart[np.arange(len(x)), best]

    def over(self, batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, vectors, nearest, distances) of each block."""
        for batch in batches:
            for ids, values, lo, hi in zip(*(batch.column(c) for c in ("ids", "values", "lo", "hi")), strict=True):
                x = whole(np.frombuffer(values.as_buffer(), float).reshape(-1, dims), self.scale)
                some = self.candidates(np.array(lo.as_py(), float), np.array(hi.as_py(), float))
                yield ids.as_py(), x, *self.of(x, some)


def totals(blocks: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> dict[tuple[int, int], int]:
    """By (cluster, item): the sum of each dimension, then the count (item ``dims``) and the sum of distances."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Partial:
        out: Partial = {}
        for _, x, cluster, distance in Nearest(centroids, scale).over(batches, dims):
            for c in np.unique(cluster).tolist():
                mine = cluster == c
                own = x[mine]
                sums = [*(own if x.dtype != object and np.abs(own).max(initial=0) * len(own) < EXACT else as_int(own)).sum(axis=0), len(own), as_int(distance[mine]).sum()]
                for item, v in enumerate(sums):
                    out[c, item] = out.get((c, item), 0) + int(v)
        return out

    return exact_sums(blocks, partial)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


CLUSTERED = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED,
    key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, bits: int = BITS,
) -> tuple[DataFrame, list[list[int]]]:
    """(rows, centroids): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector, and the centroids.

    Vectors that are null, have another number of components than ``dims``, or hold null or non-finite ones are left out. Each
    component x becomes floor(scale * x). Centroids start as the k vectors whose id has the smallest sha256 of ``seed:id``, in
    that order; of repeated ids the smaller vector comes first, and null ids come last. Fewer than k vectors give as many
    centroids; none give no rows. Repeated rows are rows of their own; ties go to the smaller number. Sums of distances that a
    long cannot hold are given as the largest long. Other columns are ignored, whatever they are called.
    """
    scratch = Scratch(vectors.sparkSession, "clustering")
    v = finite(vectors[vector])
    kept = vectors.select(vectors[key].cast("long").alias("vec_id"), F.when(F.size(v) == dims, v).alias("v")).where("v is not null")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(digest.alias("digest"), "v").orderBy(F.col("digest").asc_nulls_last(), "v").limit(k).collect()
    centroids = [[int(x) for x in row] for row in whole(np.array([r["v"] for r in first], float).reshape(-1, dims), scale)]
    blocks = scratch.keep(ordered(kept, dims, bits, block), "blocks")
    for _ in range(rounds):
        sums = totals(blocks, centroids, dims, scale)
        centroids = [[sums.get((c, i), 0) // sums[c, dims] for i in range(dims)] if (c, dims) in sums else old for c, old in enumerate(centroids)]
    sums = totals(blocks, centroids, dims, scale)
    inertias = [sums.get((c, dims + 1), 0) for c in range(len(centroids))]
    hashes = [sha256(",".join(map(str, c))) for c in centroids]
    whole_inertia = held(sum(inertias))
    inertias = [held(x) for x in inertias]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CLUSTERED.split(", ")]
        for ids, _, cluster, distance in Nearest(centroids, scale).over(batches, dims):
            own = cluster.tolist()
            columns = [pa.array(ids, pa.int64()), pa.array(own, pa.int32()), pa.array([held(int(d)) for d in distance], pa.int64())]
            columns += [pa.array([inertias[c] for c in own], pa.int64()), pa.array([whole_inertia] * len(own), pa.int64()), pa.array([hashes[c] for c in own])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return blocks.mapInArrow(assign, CLUSTERED), centroids


def digest(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return cluster(vectors)[0]


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> str:
    """DuckDB SQL for ``digest``: every vector meets every centroid, component by component."""
    steps = [f"""
with kept as (
  select row_number() over () r, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) v from embeddings
  where embedding is not null and len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cell as (select r, unnest(range(1, {dims + 1})) j, unnest(v) x from kept),
c0 as (
  select row_number() over (order by sha256('{seed}:' || vec_id), v) - 1 c, v from kept
  qualify row_number() over (order by sha256('{seed}:' || vec_id), v) <= {k}),
m0 as (select c, unnest(range(1, {dims + 1})) j, unnest(v) y from c0)"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} as (
  select r, c, d from (select r, c, sum((x - y) * (x - y)) d from cell join m{i} using (j) group by r, c)
  qualify row_number() over (partition by r order by d, c) = 1)""")
        if i < rounds:
            steps.append(f"""
s{i} as (select c, j, cast(sum(x) as bigint) s, count(*) n from a{i} join cell using (r) group by c, j),
m{i + 1} as (select c, j, coalesce((s - ((s % n) + n) % n) // n, y) y from m{i} left join s{i} using (c, j))""")
    last = f"""
select vec_id, cast(c as integer) as "cluster", cast(d as bigint) distance, cast(sum(d) over (partition by c) as bigint) cluster_inertia,
  cast(sum(d) over () as bigint) inertia, h centroid_sha256
from a{rounds} join kept using (r) join (select c, sha256(string_agg(cast(y as varchar), ',' order by j)) h from m{rounds} group by c) using (c)"""
    return ",".join(steps) + last


ORACLE = oracle()
