"""Which block of addresses an address lies in: the longest prefix, by an equi-join.

A block such as ``2001:db8::/32`` is a number of leading bits. An address meets the blocks on its own leading bits, once for
each length that the table of blocks has (at most 129), so the join is on equal keys, whatever the size of either table, and
nothing is compared by ranges. Of the blocks that hold an address the smallest one counts, so a table states exceptions as
smaller blocks. Addresses of both versions are 128-bit numbers in one table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrisk import dims
from linkrisk.functions.addresses import number, prefix
from linkrisk.functions.shared import written

#: Most blocks of a table that is broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 500_000


def special_blocks(spark: SparkSession) -> DataFrame:
    """(block, kind) of the blocks that are local or multicast, with the global exceptions within them."""
    rows = [(block, kind) for kind, blocks in dims.SPECIAL_BLOCKS.items() for block in blocks]
    return spark.createDataFrame(rows + [(block, "local") for block in dims.LOCAL_IPV4], "block string, kind string")


def keyed(blocks: DataFrame) -> DataFrame:
    """(bits, key, kind) of the blocks, one row for each block; what is no block, or has no kind, is left out.

    Of several kinds for one block the largest counts. Bits behind a block's length do not matter.
    """
    parts = F.split(F.col("block"), "/")
    rows = blocks.select(number(F.get(parts, F.lit(0))).alias("digits"), F.get(parts, F.lit(0)).contains(":").alias("new"), F.get(parts, F.lit(1)).try_cast("int").alias("length"), "kind")
    rows = rows.where("digits is not null and kind is not null and length between 0 and if(new, 128, 32)")
    rows = rows.select("digits", F.when(F.col("new"), F.col("length")).otherwise(F.col("length") + 96).alias("bits"), "kind")
    return rows.groupBy("bits", prefix(F.col("digits"), F.col("bits")).alias("key")).agg(F.max("kind").alias("kind"))


def with_kind(rows: DataFrame, address: str, blocks: DataFrame, default: str = "global", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The distinct ``rows`` with ``kind``: that of the smallest block with ``address``; ``default`` in none; null for no address.

    ``rows`` has no columns of the names kind, _digits, _bits, _key. Null addresses have a null kind.
    """
    table = written(keyed(blocks), "blocks")
    sizes = table.agg(F.count(F.lit(1)), F.collect_set("bits")).first()
    rows = rows.withColumn("_digits", number(F.col(address)))
    met = rows.withColumn("_bits", F.explode_outer(F.array(*[F.lit(b) for b in sorted(sizes[1])]).cast("array<int>")))
    met = met.withColumn("_key", prefix(F.col("_digits"), F.col("_bits")))
    table = table.select(F.col("bits").alias("_bits"), F.col("key").alias("_key"), "kind")
    met = met.join(F.broadcast(table) if sizes[0] <= broadcast_rows else table, ["_bits", "_key"], "left")
    columns = [c for c in rows.columns if c != "_digits"]
    best = F.max_by("kind", F.when(F.col("kind").isNotNull(), F.col("_bits")))
    found = met.groupBy(*columns, "_digits").agg(best.alias("kind"))
    return found.select(*columns, F.when(F.col("_digits").isNotNull(), F.coalesce("kind", F.lit(default))).alias("kind"))
