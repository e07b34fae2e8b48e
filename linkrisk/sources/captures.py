"""Capture tables with their fixed schemas, and the result tables that jobs write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "requests": "analysis_id string, url string",
    "hops": "url string, method string, status_code int, raw_location string, content_type string, error string",
    "safe_browsing": "url string, checked boolean, error string, matches array<struct<threat_type: string, platform_type: string, cache_duration: string>>",
    "rdap": "domain string, fetched_at timestamp, body string, error string",
    "pages": "url string, status_code int, content_type string, content_length bigint, html string, error string",
    "rendered": "url string, html string, error string",
    "dns": "host string, ip string",
    "ai": "url string, raw string",
}


def read_capture(spark: SparkSession, kind: str, path: str, form: str = "parquet") -> DataFrame:
    """A capture table; nothing is inferred, columns that are absent are null."""
    return spark.read.schema(SCHEMAS[kind]).format(form).load(path)


def newest(rows: DataFrame, key: str) -> DataFrame:
    """One row per key: the last by ``fetched_at`` where there is such a column, else, and among equal times, by a hash of the row.

    The choice does not depend on the order of rows. Only keys and hashes are grouped, not the rows' contents.
    """
    order = [F.col("fetched_at")] if "fetched_at" in rows.columns else []
    marked = rows.withColumn("_order", F.struct(*[c.alias(f"t{i}") for i, c in enumerate(order)], F.xxhash64(*rows.columns).alias("hash")))
    last = marked.groupBy(key).agg(F.max("_order").alias("_order"))
    return marked.join(last, [key, "_order"], "left_semi").dropDuplicates([key]).select(rows.columns)


def write_verdicts(rows: DataFrame, path: str, batch: str) -> None:
    """Both arms in one table, by batch, status and verdict; a batch that is written again replaces its own rows."""
    parts = rows.withColumn("verdict_part", F.coalesce("verdict", F.lit("none")))
    parts.write.mode("overwrite").partitionBy("status", "verdict_part").parquet(f"{path}/batch={batch}")


def write_callbacks(rows: DataFrame, document, path: str, batch: str) -> None:
    """One JSON document a row, by batch; ``document`` is a Column. A batch that is written again replaces its own rows."""
    rows.select(document.alias("value")).write.mode("overwrite").text(f"{path}/batch={batch}")
