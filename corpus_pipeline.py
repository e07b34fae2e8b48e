"""A training corpus from ``documents``: rejects poor texts, keeps one of each group of near copies, drops contaminated
documents, puts out secrets, and encodes what is left.

Each stage's rows are written as Parquet and read again as the next stage's documents. Where rows repeat a doc_id, quality and
contamination judge each row by its own text, and near copies by the group of any of them. Null and empty texts pass all
stages that do not reject them; texts are read whole; an empty table gives an empty one; columns of other names are kept as
they are, whatever they are called. Workers live through all stages and keep the most they have held, so stages that give a
worker's rows make the session's batches small, whoever writes the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrisk.functions.shared import Scratch, dropped_at_end, small_batches
from linkrisk.llm import bpe, decontamination, jaccard, quality, secrets
from linkrisk.llm.common import fresh, table, without

#: Near copies: five-word shingles, similarity of 0.8 or more.
SHINGLE, NUM, DEN = 5, 80, 100


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; null and empty texts are judged by the model's bias alone."""
    small_batches(spark)
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies.

    Texts without words are no copies of anything and stay, as do rows without doc_id; rows that repeat a doc_id stay or go
    together.
    """
    groups = jaccard.join(docs, SHINGLE, NUM, DEN)
    return without(docs, groups.where("component_id <> doc_id"), ["doc_id"])


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of the benchmark than the contamination rule allows; equal rows go or stay together.

    Texts without words are clean; an empty benchmark leaves all.
    """
    found = decontamination.find(docs, table(spark, sf_dir, "benchmark"))
    name = fresh(docs, "text_hash")
    marked = docs.withColumn(name, F.xxhash64("text"))
    dropped = found.where("contaminated").select("doc_id", F.col("text_hash").alias(name))
    return without(marked, dropped, ["doc_id", name]).select(docs.columns)


def secrets_put_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; n_chars, where there is one, is counted anew."""
    small_batches(spark)
    clean = secrets.redact(docs)
    if "n_chars" in clean.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.length("text").cast(kind))
    return clean.select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the checksum of the decoded text; a null or empty text has no tokens."""
    small_batches(spark)
    return bpe.encode(docs, bpe.default_vocabulary(), outputs=("ids", "decoded_sha256"))


STAGES = [
    ("quality", good_quality),
    ("near_copies", one_of_each_group),
    ("decontamination", uncontaminated),
    ("secrets", secrets_put_out),
    ("bpe", encoded),
]

#: SQL cannot express the classifier or the encoder; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table is dropped once the next one's is written, and so are those in between."""
    scratch = Scratch(spark, "pipeline")
    docs = before = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        with dropped_at_end(spark):
            docs = scratch.keep(stage(spark, before, sf_dir), name)
        if i:
            scratch.drop(before)
        before = docs
    return docs
