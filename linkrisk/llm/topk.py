"""Operator 3: exact top-k search with an impact-ordered, score-at-a-time index.

Vectors of whole numbers are dealt into blocks by a hash of the row. In each block every dimension has a posting list; its
entries are grouped into segments by quantised impact (the component's magnitude in steps). Queries come in blocks too.
A task holds one block of each and processes the segments by descending impact for all its queries at once, adding
query weight times quantised impact to the accumulators. After each impact level, what a vector's score can still change by
is bounded in two ways: by the level's impact times the query's sum of weights, and by Cauchy-Schwarz on what is left of the
vector. When these bounds prove that few vectors can still be among the k best (or no level is left), those possible
members, and no others, are scored exactly. So results are exact at whatever level the processing stops.

The proof needs accumulators that do not round, which 53 bits allow as long as dimensions times the largest magnitude squared
is below ``EXACT``. A pair of blocks with larger magnitudes is scored outright, in 64-bit or, beyond those, unbounded whole
numbers.

Equal rows are one row with a number of copies, by map-side counts, so a hot id or vector fills no block. Vectors and queries
are paired block by block: a task holds about ``BLOCK`` vectors and ``QUERY_BLOCK`` queries, builds one index, and searches it
for ``PASS`` queries at a time. So a vector is sent once for each ``QUERY_BLOCK`` queries, a query once for each ``BLOCK``
vectors. Each pair of blocks gives at most k rows for a query, and those are merged by a window per query, which Spark limits to
k rows before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 10
BLOCK = 4096
QUERY_BLOCK = 8192
#: Queries that a task searches for at a time; what it holds beside its blocks is a few numbers for each of them and vector.
PASS = 256
#: Magnitudes are quantised in so many levels between 0 and the block's largest.
LEVELS = 64
#: Below this, sums of products are whole numbers that a double holds.
EXACT = 1 << 51
LONGEST = (1 << 63) - 1
#: Added to scores that a long cannot hold, so that their digits sort; such scores have fewer digits.
SHIFT = 10**640


def usable(vector: Column) -> Column:
    """The vector as doubles; null for one that is null or holds null or non-finite components."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(as_double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, as_double)


def whole(vectors: list, dims: int) -> np.ndarray:
    """floor(1024 * x) of each component: as doubles where they hold it exactly, else as Python's whole numbers."""
    x = np.array([np.asarray(v, float) for v in vectors], float).reshape(len(vectors), dims)
    with np.errstate(over="ignore"):
        out = np.floor(1024 * x)
    if np.isfinite(out).all():
        return out
    return np.array([1024 * int(v) if abs(v) >= EXACT else int(np.floor(1024 * v)) for v in x.flat], object).reshape(x.shape)


def exact_product(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The vectors' inner products with a query, in whole numbers wide enough."""
    if not vectors.shape[1] or not len(vectors):
        return np.zeros(len(vectors), np.int64)
    largest = vectors.shape[1] * max(abs(int(vectors.max())), abs(int(vectors.min()))) * max(abs(int(query.max())), abs(int(query.min())))
    if largest <= LONGEST:
        return vectors.astype(np.int64) @ query.astype(np.int64)
    as_int = np.frompyfunc(int, 1, 1)
    return as_int(vectors) @ as_int(query)


class ImpactIndex:
    """Posting segments of a block of vectors, by descending quantised impact."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.largest = int(np.abs(vectors).max(initial=0))
        if self.provable(self.largest):
            magnitude = np.abs(vectors).astype(np.int64)
            self.step = max(1, self.largest // LEVELS + 1)
            level = magnitude // self.step
            self.segments: list[tuple[int, list[tuple[int, np.ndarray]]]] = []
            for at in range(int(level.max(initial=0)), 0, -1):
                lists = [(j, np.flatnonzero(level[:, j] == at)) for j in range(vectors.shape[1])]
                self.segments.append((at, [(j, ids) for j, ids in lists if len(ids)]))

    def provable(self, largest: int) -> bool:
        """Whether sums of products up to this magnitude do not round."""
        return max(1, self.vectors.shape[1]) * max(self.largest, largest) ** 2 < EXACT

    def possible(self, queries: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """For each row and query whether the row can be among the query's k best. own: the query's own row here, or -1."""
        n = len(self.vectors)
        sums = np.zeros((n, len(queries)))
        weights = queries.T
        left = (self.vectors**2).sum(axis=1)
        l1, l2 = np.abs(queries).sum(axis=1), np.sqrt((queries**2).sum(axis=1))
        mine = np.flatnonzero(own >= 0)
        few = max(4 * k, n // 64)
        for i, (level, segment) in enumerate(self.segments):
            for j, ids in segment:
                values = self.vectors[ids, j]
                impact = np.sign(values) * (level * self.step)
                sums[ids] += impact[:, None] * weights[j]
                left[ids] += (values - impact) ** 2 - values**2
            ending = i + 1 == len(self.segments)
            # far from the end the bounds are wide, so they are tried seldom
            if not ending and level & (level - 1) and level > 4:
                continue
            # entries of this level and above are off by less than a step, all others lie below this level; sums are exact,
            # and roots and products of less than 2^51 are off by less than 1
            bound = np.minimum(level * self.step * l1, np.sqrt(np.maximum(left, 0))[:, None] * l2) + 1
            lower = sums - bound
            lower[own[mine], mine] = -np.inf
            best = np.partition(lower, n - k, axis=0)[n - k] if n > k else np.full(len(queries), -np.inf)
            possible = sums + bound >= best
            if ending or possible.sum() <= few * len(queries):
                return possible
        return np.ones_like(sums, bool)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, rows, scores) of all rows that can be among the query's k best."""
        if self.provable(int(np.abs(queries).max(initial=0))):
            possible = self.possible(queries, own, k)
            mine = np.flatnonzero(own >= 0)
            possible[own[mine], mine] = True  # for its copies
        else:
            possible = np.ones((len(self.vectors), len(queries)), bool)
        for q in range(len(queries)):
            rows = np.flatnonzero(possible[:, q])
            yield q, rows, exact_product(self.vectors[rows], queries[q])


FOUND = "row long, query_id long, query_copies long, vec_id long, score long, digits string"


def best_of_pair(k: int, pass_size: int = PASS):
    """The function for one pair of blocks: vectors on the left, queries on the right, ``pass_size`` of them at a time."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            dims = int(left["dims"].iat[0])
            ids, copies = left["vec_id"].tolist(), left["copies"].tolist()
            place = {x: i for i, x in enumerate(left["row"].tolist())}
            own = np.array([place.get(x, -1) for x in right["row"].tolist()])
            queries = list(zip(right["row"], right["vec_id"], right["copies"], strict=True))
            wanted = right["v"].tolist()
            index = ImpactIndex(whole(left["v"].tolist(), dims))
            parts = range(0, len(queries), pass_size)
            results = ((at + q, rows, scores) for at in parts for q, rows, scores in index.search(whole(wanted[at : at + pass_size], dims), own[at : at + pass_size], k))
            for q, rows, scores in results:
                ranked = sorted(zip((-scores).tolist(), (ids[r] for r in rows), rows.tolist(), strict=True))
                least, room = [], k
                for negative, vec_id, r in ranked:
                    if room <= 0:
                        break
                    again = min(room, copies[r] - (r == own[q]))
                    room -= again
                    score = -negative
                    held = max(-LONGEST - 1, min(LONGEST, score))
                    least += [(*queries[q], vec_id, held, None if held == score else f"{SHIFT + score:0641d}")] * again
                found += least
        return pd.DataFrame(found, columns=[c.split()[0] for c in FOUND.split(", ")])

    return run


def search(vectors: DataFrame, k: int = K, every: int = 100, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK, pass_size: int = PASS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of each row whose id is divisible by ``every``.

    Scores are inner products of floor(1024 * x); ties go to the smaller id, and between repeated ids to either row. Rows
    whose id is null, or whose vector is null or holds null or non-finite components, take no part; vectors of different
    length are not compared, and empty ones score 0 with each other. Rows are ranked by exact scores of any size; a score
    that a long cannot hold is given as the largest or smallest long. A query with fewer than k other rows gets those. A row
    that repeats a query's id, or the whole row, is a candidate of its own and, if a query, has results of its own. Other columns
    of any names do not matter.
    """
    rows = vectors.select(vectors[key].cast("long").alias("vec_id"), usable(vectors[vector]).alias("v")).where("vec_id is not null and v is not null")
    rows = rows.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("row", F.xxhash64("vec_id", "v")).withColumn("dims", F.size("v"))
    queries = rows.where(F.col("vec_id") % every == 0)
    ids = vectors.select(vectors[key].cast("long").alias("vec_id"))
    sizes = ids.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    n_blocks, n_query_blocks = -(-max(1, sizes[0]) // block), -(-max(1, sizes[1]) // query_block)
    left = rows.withColumn("b", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n_blocks))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))))
    right = queries.withColumn("q", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(n_query_blocks)).cast("int")).withColumn(
        "b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
    )
    keys = ["dims", "b", "q"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    found = pairs.applyInPandas(best_of_pair(k, pass_size), FOUND)
    order = Window.partitionBy("row", "query_id").orderBy(F.desc("score"), F.desc("digits"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ranked = ranked.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("query_copies"))))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def digest(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return search(vectors)


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id query_id, c.vec_id, cast(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) as bigint) score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10
"""
