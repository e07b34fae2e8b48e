"""Readers of text sources: the threat feed and brand lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The feed's columns.
FEED_FIELDS = ["id", "dateadded", "url", "url_status", "last_online", "threat", "tags", "urlhaus_link", "reporter"]
#: A quoted field.
QUOTED = r'"(?:[^"]|"")*+"'
_OPTIONS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "nullValue": "\u0001", "emptyValue": "", "mode": "PERMISSIVE"}


def parse_feed(lines: DataFrame) -> DataFrame:
    """Feed rows of (``value``, ``line_no``): nine text columns and ``short`` for rows with fewer fields.

    Blank lines and comments are dropped, further fields are cut.
    """
    schema = ", ".join(f"{f} string" for f in FEED_FIELDS)
    some = lines.where("value <> '' and not startswith(value, '#')")
    rows = some.select("line_no", "value", F.from_csv("value", schema, _OPTIONS).alias("_row"))
    # the parser does not tell an empty field from one that is not there, so commas outside quotes are counted
    n_fields = F.size(F.split(F.regexp_replace("value", QUOTED, ""), ","))
    short = n_fields < len(FEED_FIELDS)
    fields = [F.when(short, F.col(f"_row.{f}")).otherwise(F.coalesce(F.col(f"_row.{f}"), F.lit(""))).alias(f) for f in FEED_FIELDS]
    return rows.select("line_no", *fields, short.alias("short"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """The feed's rows; ``line_no`` sorts along each file, and from file to file in the order of their names.

    It holds the file's name, the place where its part of the file starts, and a number that rises within the part, so it
    does not depend on how Spark packs files into partitions.
    """
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    return parse_feed(spark.read.text(path).select("value", place.alias("line_no")))


def read_brands(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))
