"""Vectors of whole numbers, packed in blocks, and sums of whole numbers of any size over them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = (1 << 63) - 1
#: Whole numbers below this are exact in a double.
EXACT = 1 << 53

def finite(vector: Column) -> Column:
    """The vector as doubles; null for one that is null or holds null or non-finite components."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(as_double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, as_double)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) for a power of two: as doubles where they hold it exactly, else as Python's whole numbers."""
    with np.errstate(over="ignore"):
        out = np.floor(scale * x)
    if np.isfinite(out).all():
        return out
    return np.array([scale * int(v) if abs(v) >= EXACT else math.floor(scale * v) for v in x.flat], object).reshape(x.shape)


def as_int(x: np.ndarray) -> np.ndarray:
    """The array with Python's whole numbers."""
    return np.asarray(np.frompyfunc(int, 1, 1)(x), object)


def held(x: int) -> int:
    """x, or the largest or smallest long."""
    return max(-LONGEST - 1, min(LONGEST, x))


def rows_of(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """A batch's column ``v`` of vectors as a matrix."""
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)


def blocks_of(batches: Iterator[pa.RecordBatch], dims: int, size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, vectors) of ``size`` rows each, in the rows' order; the last of a task may have fewer."""
    ids, vectors = [], np.empty((0, dims))
    for batch in batches:
        ids += batch.column("vec_id").to_pylist()
        vectors = np.concatenate([vectors, rows_of(batch, dims)])
        while len(ids) >= size:
            yield ids[:size], vectors[:size]
            ids, vectors = ids[size:], vectors[size:]
    if ids:
        yield ids, vectors


Partial = dict[tuple[int, int], int]
LIMB = 30


def exact_sums(blocks: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], Partial]) -> dict[tuple[int, int], int]:
    """The sums over all tasks of ``partial``'s whole numbers by (group, item), of any size.

    Each number is cut into digits of ``LIMB`` bits, and Spark adds up digits of the same place. What comes back has one row for
    each group, item and digit, whatever the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for (group, item), total in partial(batches).items():
            sign, rest, place = (-1 if total < 0 else 1), abs(total), 0
            while rest:
                rows.append((group, item, place, sign * (rest & ((1 << LIMB) - 1))))
                rest >>= LIMB
                place += 1
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["g", "item", "place", "value"])

    made = blocks.mapInArrow(run, "g int, item int, place int, value long").groupBy("g", "item", "place").agg(F.sum("value").alias("value"))
    out: dict[tuple[int, int], int] = {}
    for g, item, place, value in made.collect():
        out[g, item] = out.get((g, item), 0) + (value << (LIMB * place))
    return out
