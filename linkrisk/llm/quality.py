"""Operator 5: quality by hashed word n-grams and logistic regression with follow-the-regularised-leader updates.

Features are hashed 1-, 2- and 3-grams of words, and beside them 2- and 3-grams of word forms, where a word's form is its
letter case, its punctuation, or that it repeats the word before. Counts are damped by a logarithm, and each of the five kinds
is scaled to the same length, so long and short texts compare. The model is fitted on a bounded sample (``PER_CLASS`` rows of
each label, read off the corpus by a broadcast of their ids; its features are written and come to the driver in parts of at
most about ``FIT_BYTES``) and scores every row as a sparse dot product in Arrow batches: no shuffle of texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrisk.functions.shared import Scratch
from linkrisk.llm import labelled

BITS = 20
#: Most labelled rows of each class that the model is fitted on.
PER_CLASS = 2500
#: Most bytes of the sample's features that the driver holds at once.
FIT_BYTES = 16 << 20
#: Weights that are computed at once.
PIECE = 1 << 14
EPOCHS = 5
REMEMBERED_WORDS = 100_000
HELD_OUT = 2
MODULUS = 4

WORDS = re.compile(r"\w+|[^\w\s]+")
REPEATED = 7


def form(token: str) -> int:
    """A number below 2^16 for a token's form."""
    if not (token[0].isalnum() or token[0] == "_"):
        return 16 + zlib.crc32(token[:3].encode("utf-8", "replace")) % 4096
    if token.isdigit():
        return 1
    if token.isupper():
        return 2 if len(token) > 1 else 3
    if token.islower():
        return 4 if len(token) > 1 else 5
    return 6 if token.istitle() else 8


class Tokens(dict):
    """token -> hash of the lower-cased word << 16 | form; forgets all when full."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[token] = zlib.crc32(token.lower().encode("utf-8", "replace")) << 16 | form(token)
        return value


TOKENS = Tokens()
MIX = np.uint64(0x9E3779B97F4A7C15)


MULTIPLIER = np.uint64(0x9FB21C651E98DF25)


def hashed(a: np.ndarray, kind: int) -> np.ndarray:
    """Feature numbers of the grams of one kind."""
    x = (a ^ (a >> np.uint64(29))) * MULTIPLIER + np.uint64(kind)
    return ((x * MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def grams(text: str | None) -> list[np.ndarray]:
    """Numbers of the text's words, word pairs and triples, and form pairs and triples, in the order of the text."""
    tokens = WORDS.findall(text or "")
    if not tokens:
        return []
    coded = np.fromiter(map(TOKENS.__getitem__, tokens), np.uint64, len(tokens))
    words, forms = coded >> np.uint64(16), coded & np.uint64(0xFFFF)
    again = np.flatnonzero(words[1:] == words[:-1]) + 1
    forms[again] = REPEATED
    word_pairs = words[:-1] * MIX + words[1:]
    form_pairs = forms[:-1] << np.uint64(16) | forms[1:]
    return [words, word_pairs, word_pairs[:-1] * MIX + words[2:], form_pairs, form_pairs[:-1] << np.uint64(16) | forms[2:]]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a text; the last feature is the bias."""
    kinds = [hashed(x, i) for i, x in enumerate(grams(text)) if len(x)]
    ids, values = [], []
    for found in kinds:
        found, counts = np.unique(found, return_counts=True)
        damped = np.log1p(counts)
        ids.append(found)
        values.append(damped / np.sqrt((damped**2).sum() * len(kinds)))
    both, places = np.unique(np.concatenate([np.empty(0, np.int64), *ids]), return_inverse=True)
    summed = np.bincount(places, weights=np.concatenate([np.empty(0), *values]), minlength=len(both))
    return np.append(both, 1 << BITS), np.append(summed, 1.0)


@dataclass
class Ftrl:
    """Follow-the-regularised-leader with L1 and L2 penalties and a rate for each coordinate."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1

    def __post_init__(self):
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, ids: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def all_weights(self) -> np.ndarray:
        """The weights of all features, made piece by piece, so that the driver holds little beside them."""
        out = np.empty_like(self.z)
        for at in range(0, len(out), PIECE):
            out[at : at + PIECE] = self.weights(slice(at, at + PIECE))
        return out

    def update(self, ids: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(ids)
        g = (sigmoid(float(values @ w)) - label) * values
        n = self.n[ids]
        self.z[ids] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[ids] = n + g * g


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, modulus: int = MODULUS, held_out: int = HELD_OUT, fit_bytes: int = FIT_BYTES
) -> np.ndarray:
    """The weights, from at most ``per_class`` rows of each label; all zero (score 0.5) if there are none.

    Rows of ``labels`` that repeat a doc_id count once, with the larger label; of documents that repeat one, one is used. The
    updates run one after the other on the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(v.as_py()) for v in batch.column(1)]
            ids = pa.array([i.astype("<i4").tobytes() for i, _ in made], pa.binary())
            values = pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, values, batch.column(2)], names=["doc_id", "ids", "vals", "label"])

    rows = labelled.sample(docs, labels, label, modulus, held_out, per_class).select(F.col("doc_id").cast("string"), "text", "label")
    scratch = Scratch(docs.sparkSession, "quality")
    made = scratch.keep(rows.mapInArrow(run, "doc_id string, ids binary, vals binary, label int"), "features")
    size = made.agg(F.sum(F.octet_length("ids") + F.octet_length("vals"))).first()[0] or 0
    n_parts = max(1, -(-size // fit_bytes))

    def part(i: int) -> list:
        # one partition at a time passes through the driver's JVM
        got = made.where(F.pmod(F.xxhash64("doc_id"), F.lit(n_parts)) == i).toLocalIterator()
        return sorted(got, key=lambda r: (zlib.crc32(r.doc_id.encode()), r.doc_id))

    model, held = Ftrl(), part(0) if n_parts == 1 else None
    for _ in range(EPOCHS):
        for i in range(n_parts):
            for r in held if held is not None else part(i):
                model.update(np.frombuffer(r.ids, "<i4"), np.frombuffer(r.vals, "<f4").astype(float), r.label)
    scratch.drop_but()
    del held
    return model.all_weights()


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``key``, the columns in ``keep`` and the ``score`` of every row.

    A null or empty text has the bias as its only feature. Whole texts are read; repeated rows get equal scores; an empty
    table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype("<f4"))
    others = [key, *(keep or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            scores = []
            for v in batch.column(0):
                ids, values = features(v.as_py())
                scores.append(sigmoid(float(values @ w[ids])))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], names=[*others, "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    rows = docs.select(docs[text].alias("_text"), *[docs[c] for c in others])
    return rows.mapInArrow(run, f"{kinds}, score double")


def keep(docs: DataFrame, weights: np.ndarray, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``threshold``.

    A null or empty text is judged by the bias alone. Rows that repeat a doc_id are judged each by its own text. Whole texts
    are read; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype("<f4"))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            good = []
            for v in batch.column(at):
                ids, values = features(v.as_py())
                good.append(sigmoid(float(values @ w[ids])) >= threshold)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of every document; see ``score`` for odd rows."""
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        (labelled.remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def digest(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels)
