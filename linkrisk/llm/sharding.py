"""Operator 8: sharding by jump consistent hash, with DataFrame functions only.

The key's generator state is carried as two 32-bit halves, so that the 64-bit multiplication wraps without overflow errors.
The walk over buckets rises strictly, so ``shards`` steps always end it. With one shard more, a row either stays or goes
into the new shard: it goes there exactly if the walk's next bucket is that shard.

Slots: each shard is cut into ``cells`` cells by middle bits of the mixed key, and each cell into ``SUBCELLS`` by a hash of
the row, so that a key of many rows fills no cell. Equal rows are counted with map-side sums and numbered as one row with a
range of slots. Counts are summed up to each cell's offset, and rows are numbered within their cell only. So no task holds a
whole shard or key, and what is broadcast has at most ``shards * cells * SUBCELLS`` rows whatever the input. At the end a
range is dealt out in runs of at most ``RUN`` slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value: the multiplier of the generator of jump consistent hash.
MULTIPLIER = 2862933555777941757
LOW32 = 0xFFFFFFFF


def long(x: int) -> Column:
    return F.lit(x).cast("long")


def low(x: Column) -> Column:
    return x.bitwiseAND(long(LOW32))


def half(x: Column, c: int) -> Column:
    """The low 32 bits of x * c for x and c of 32 bits."""
    return low(low(x * long(c & 0xFFFF)) + F.shiftleft((x * long(c >> 16)).bitwiseAND(long(0xFFFF)), 16))


def following(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state: key * MULTIPLIER + 1 modulo 2^64."""
    c_hi, c_lo = MULTIPLIER >> 32, MULTIPLIER & LOW32
    upper = lo * long(c_lo >> 16)
    total = lo * long(c_lo & 0xFFFF) + F.shiftleft(upper.bitwiseAND(long(0xFFFF)), 16) + long(1)
    carry = F.shiftright(total, 32) + F.shiftright(upper, 16)
    return low(low(carry) + half(lo, c_hi) + half(hi, c_lo)), low(total)


def walk(key: Column, shards: int) -> Column:
    """struct(hi, lo, b, j): the state after the walk; b is the shard, j the next bucket that the key would jump to."""
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), low(key).alias("lo"), long(-1).alias("b"), long(0).alias("j")
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = following(s["hi"], s["lo"])
        # (key >> 33) + 1, then the jump in double precision
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double")))
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"), jump.cast("long").alias("j"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)


def key_of(docs: DataFrame, key: str) -> Column:
    """The key as a long: whole numbers as they are, others by hash of their text; null counts as 0."""
    whole = docs.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(F.col(key).cast("long") if whole else F.xxhash64(F.col(key).cast("string")), long(0))


def assign(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard`` and ``grown_shard``, the row's shard where there is one shard more.

    Only the key and the number of shards decide. A null key counts as 0; equal keys share a shard. Columns of these names
    are replaced; an empty table gives an empty one.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    at = docs.withColumn("_walk", walk(key_of(docs, key), shards))
    shard = F.col("_walk.b").cast("int")
    grown = F.when(F.col("_walk.j") == shards, F.lit(shards)).otherwise(shard).cast("int")
    return at.withColumn("shard", shard).withColumn("grown_shard", grown).drop("_walk")


SUBCELLS = 16
RUN = 100_000


def with_slots(rows: DataFrame, key: str, cells: int = 1024) -> DataFrame:
    """``rows`` (narrow ones, with ``shard``) and ``slot``: 0, 1, 2, ... within each shard without a gap."""
    columns = rows.columns
    hi, lo = following(F.shiftrightunsigned(key_of(rows, key), 32), low(key_of(rows, key)))
    middle = F.shiftright(lo, 20).bitwiseOR(F.shiftleft(hi.bitwiseAND(long(1)), 12))
    once = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    cell = F.pmod(middle, long(cells)) * SUBCELLS + F.pmod(F.xxhash64(*columns), long(SUBCELLS))
    celled = once.withColumn("_cell", cell.cast("int"))
    counts = celled.groupBy("shard", "_cell").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), long(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "_cell").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    numbered = celled.withColumn("_first", F.coalesce(F.sum("_n").over(inside), long(0)))
    # at most shards * cells * SUBCELLS rows are broadcast
    joined = numbered.join(F.broadcast(offsets), ["shard", "_cell"]).withColumn("_first", F.col("_offset") + F.col("_first"))
    runs = joined.withColumn("_run", F.explode(F.sequence(long(0), F.floor((F.col("_n") - 1) / RUN))))
    slots = F.sequence(F.col("_first") + F.col("_run") * RUN, F.col("_first") + F.least(F.col("_n"), (F.col("_run") + 1) * RUN) - 1)
    return runs.withColumn("slot", F.explode(slots)).select(*columns, "slot")


def digest(spark: SparkSession, docs: DataFrame, shards: int = 16) -> DataFrame:
    """The query's rows: each document's size, checksum, shard and slot.

    A null text has size 1 (no bytes, plus 1) and the checksum of the empty text, 0. Rows that repeat a doc_id share its
    shard and have slots of their own.
    """
    sized = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = with_slots(assign(sized, shards), "doc_id")
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
