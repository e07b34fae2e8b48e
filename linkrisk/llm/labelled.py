"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(key: str, modulus: int):
    """crc32 of the key as text, modulo ``modulus``; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` labelled rows of each class, none of them held out.

    Which rows is decided by a hash of doc_id, so it does not depend on how the tables are stored. Rows whose label is null
    are left out. The chosen ids (at most 2 * per_class) are broadcast; a document that is repeated is used once, and of
    several texts the one with the smallest hash, so a task that runs again changes nothing.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder("doc_id", modulus) != held_out))
    rows = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    picked = [rows.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    met = docs.select("doc_id", "text").join(chosen, "doc_id")
    # digits of a checksum behind the hash, so that two texts of one hash do not tie; a null text comes after all others
    order = F.struct(F.col("text").isNull(), F.xxhash64("text"), F.sha2("text", 256))
    return met.groupBy("doc_id").agg(F.min_by(F.struct("text", "label"), order).alias("row")).select("doc_id", "row.text", "row.label")
