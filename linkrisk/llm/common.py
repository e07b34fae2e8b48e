"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrisk.functions.shared import written

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and no other letter; null stays null."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


#: Most rows of a table of ids that is broadcast.
BROADCAST_ROWS = 1_000_000


def without(docs: DataFrame, dropped: DataFrame, on: list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` but for the rows that ``dropped`` names in the columns ``on`` (null keys equal each other).

    ``dropped`` is broadcast if it has at most ``broadcast_rows`` rows, else the join is shuffled. Other columns of any names
    stay as they are; repeated rows go or stay together; an empty table gives an empty one.
    """
    names = {c: fresh(docs, f"dropped_{c}") for c in on}
    ids = written(dropped.select(*[F.col(c).alias(name) for c, name in names.items()]).distinct(), "dropped")
    few = ids.count() <= broadcast_rows
    met = None
    for c, name in names.items():
        same = docs[c].eqNullSafe(ids[name])
        met = same if met is None else met & same
    return docs.join(F.broadcast(ids) if few else ids, met, "left_anti")
