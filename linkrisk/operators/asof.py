"""Answers by time: the last capture at or before a row's time.

Rows and captures of a key stand in one order of time, and each row takes the last capture before it: one union and one ordered
window, so no row meets more than one capture. Keys with many rows are split into as many salted groups as they need; their
captures, few beside them, go to each group. So no task holds a popular key, and all rows keep their answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkrisk.dims import SETTINGS, Settings
from linkrisk.functions.shared import Scratch

#: Rows of a key from which on it is split into groups of about this size.
GROUP = 1_000_000


def as_of(rows: DataFrame, captures: DataFrame, key: str = "domain", time: str = "ts", captured: str = "fetched_at", within: str | None = None, name: str = "capture", group: int = GROUP) -> DataFrame:
    """``rows`` with the struct ``name`` of the capture's columns: the last one of the same key at or before ``time``.

    A capture that is ``within`` (an interval) old or older does not count. Of captures of one key and time the one with the
    largest hash counts, so the order of rows changes nothing. Null keys and times have no capture, and captures without them
    are none. Repeated rows each get theirs. Keys with more than ``group`` rows are split; at most (rows / group) keys are.
    """
    scratch = Scratch(rows.sparkSession, "asof")
    counts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > group)
    hot = scratch.keep(counts.select("_key", F.ceil(F.col("_n") / group).cast("int").alias("_groups")), "hot")
    kept = rows.columns
    split = rows.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(hot), F.col(key) == F.col("_key"), "left")
    salt = F.pmod(F.xxhash64("_row"), F.coalesce("_groups", F.lit(1))).cast("int")
    left = split.select(F.col(key).alias("_at"), salt.alias("_salt"), F.col(time).alias("_time"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_hash"), F.struct(*kept).alias("_left"))
    usable = captures.where(F.col(key).isNotNull() & F.col(captured).isNotNull())
    spread = usable.join(F.broadcast(hot), usable[key] == F.col("_key"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_groups", F.lit(1)) - 1)))
    columns = captures.columns
    right = spread.select(usable[key].alias("_at"), "_salt", F.col(captured).alias("_time"), F.lit(0).alias("_kind"), F.xxhash64(*[usable[c] for c in columns]).alias("_hash"), F.struct(*[usable[c] for c in columns]).alias("_right"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy("_at", "_salt").orderBy(F.col("_time").asc_nulls_first(), "_kind", "_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("_last", F.last("_right", ignorenulls=True).over(order)).where("_kind = 1")
    good = F.col("_at").isNotNull() & F.col("_time").isNotNull()
    if within is not None:
        good = good & (F.col(f"_last.{captured}") > F.col("_time") - F.expr(f"interval {within}"))
    return met.select("_left.*", F.when(good, F.col("_last")).alias(name))


def registrations_as_of(requests: DataFrame, captures: DataFrame, settings: Settings = SETTINGS, group: int = GROUP) -> DataFrame:
    """``requests`` (domain, ts, ...) with what was known of their domain at their time.

    Columns added: registrar, created_date, domain_age_days, is_new_domain (all at the request's time), rdap_error, and
    ``lookup_due``: no good capture younger than ``lookup_days``. Captures: domain, fetched_at, body, error.
    """
    from linkrisk.operators.domain import registration_facts

    met = as_of(requests, captures, within=f"{settings.lookup_days} days", group=group)
    made = met.withColumn("_facts", registration_facts(F.col("capture.body")))
    age = F.floor((F.unix_timestamp("ts") - F.unix_timestamp("_facts.created_date")) / 86400).cast("int")
    return made.select(
        *requests.columns,
        F.col("_facts.registrar").alias("registrar"),
        F.col("_facts.created_date").alias("created_date"),
        age.alias("domain_age_days"),
        F.coalesce(age < settings.new_domain_days, F.lit(False)).alias("is_new_domain"),
        F.col("capture.error").alias("rdap_error"),
        (F.col("capture").isNull() | F.col("capture.error").isNotNull()).alias("lookup_due"),
    )
