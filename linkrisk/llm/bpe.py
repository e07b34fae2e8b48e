"""Operator 7: byte-pair encoding and decoding with a given vocabulary.

A word's symbols form a doubly linked list. Each neighbouring pair that has a merge rule goes into a priority queue by
(rank, position); the lowest is taken, entries whose pair has changed meanwhile are skipped, and the merged symbol's new
pairs are put in. Decoding joins the vocabulary strings of the ids.

The vocabulary (a fixed file of under 2 MB) is read by the driver and sent to each Python worker once. Each row is encoded
on its own, so there is no shuffle, and a lost executor costs only its own rows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import struct
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Words whose ids a worker remembers; at that number it forgets all of them and starts anew (bounds memory only).
REMEMBERED_WORDS = 100_000


# White space; the letters and numbers that Unicode 16.0 adds to 15.1; and capitals of 16.0 and 17.0 with the
# distance to their small letters.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NEW_LETTERS = """1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E 11390-113B5
    113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0"""
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
NEW_CAPITALS = {
    (0x1C89, 0x1C89): 1,
    (0xA7CB, 0xA7CB): 0x264 - 0xA7CB,
    (0xA7CC, 0xA7CC): 1,
    (0xA7CE, 0xA7CE): 1,
    (0xA7D2, 0xA7D2): 1,
    (0xA7D4, 0xA7D4): 1,
    (0xA7DA, 0xA7DA): 1,
    (0xA7DC, 0xA7DC): 0x19B - 0xA7DC,
    (0x10D50, 0x10D65): 0x20,
    (0x16EA0, 0x16EB8): 0x1B,
}
SMALL = {c: c + d for (first, last), d in NEW_CAPITALS.items() for c in range(first, last + 1)}
CAPITAL = re.compile("[" + "".join(map(chr, SMALL)) + "]")


def code_points(kind: str, added: str) -> str:
    """A character class's ranges: what ``added`` names, and what has a category that starts with ``kind`` in Unicode 15.1.

    Letters are told by the Unicode version of the tokenizers library (16.0), whatever that of other packages is.
    """
    new = {c for r in added.split() for c in range(int(r.split("-")[0], 16), int(r.split("-")[1], 16) + 1)}
    ranges: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == kind or c in new:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(rf"\U{a:08X}-\U{b:08X}" for a, b in ranges)


@functools.lru_cache(maxsize=1)
def any_words() -> re.Pattern:
    """The word pattern of the vocabulary file's pre-tokenizer."""
    letters, numbers = code_points("L", NEW_LETTERS), code_points("N", NEW_NUMBERS)
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACES}{letters}{numbers}]+")


#: Blocks in which letters and numbers are the same in all versions of Unicode from 15.0 on: texts within them, most of all, take
#: the faster of two equal patterns.
COMMON = regex.compile(r"[\u0000-\u052F\u1E00-\u206F\u20A0-\u20BF\u2100-\u2BFF\u3000-\u30FF\u4E00-\u9FFF\uAC00-\uD7A3\uFF00-\uFFEF\U0001F300-\U0001F64F]*+")
COMMON_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")


def lowered(text: str) -> str:
    """Lower case; the capital sigma alike in all places, not by its place in a word."""
    text = text.replace("Σ", "σ").lower()
    return text.translate(SMALL) if CAPITAL.search(text) else text


# Fixed value: the word pattern of the vocabulary file's pre-tokenizer, for lower-case ASCII text.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def byte_symbols() -> list[str]:
    """For each byte the character that stands for it: printable Latin-1 for itself, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordPieces:
    """Encoder and decoder for a word-end BPE vocabulary (a parsed ``tokenizer.json``)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for s, i in [*self.ids.items(), *self.special.items()]:
            self.strings[i] = s
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        self.symbols = byte_symbols()
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.memory: dict[str, bytes] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """The ids of one word's symbols after all merges."""
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[int, int, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            rule = self.merges.get((symbols[left], symbols[right]))
            if rule:
                heapq.heappush(queue, (rule[0], left, symbols[left], symbols[right], rule[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, left, a, b, merged = heapq.heappop(queue)
            right = after[left]
            if symbols[left] != a or right < 0 or symbols[right] != b:
                continue  # stale: one of the two has been merged since
            symbols[left], symbols[right] = merged, -1
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> bytes:
        """The ids of a word as little-endian unsigned 32-bit integers."""
        chars = [self.symbols[b] for b in word.encode("utf-8")]
        chars[-1] += self.end
        ids = self.merge([self.ids[c] for c in chars if c in self.ids])
        if len(self.memory) >= REMEMBERED_WORDS:
            self.memory.clear()
        packed = self.memory[word] = struct.pack(f"<{len(ids)}I", *ids)
        return packed

    def plain(self, text: str) -> bytes:
        if text.isascii():
            words = ASCII_WORDS.findall(text.lower())
        else:
            text = unicodedata.normalize("NFC", text)
            if COMMON.fullmatch(text):
                words = COMMON_WORDS.findall(text.replace("Σ", "σ").lower())
            else:
                words = any_words().findall(lowered(text))
        known = self.memory.get
        return b"".join([known(w) or self.word(w) for w in words])

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers; none for null."""
        if not text:
            return b""
        if not self.split_special or "<" not in text:
            return self.plain(text)
        parts = self.split_special.split(text)
        return b"".join(struct.pack("<I", self.special[p]) if i % 2 else self.plain(p) for i, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids, with a space between two (the file names no decoder)."""
        numbers = array("I")
        numbers.frombytes(ids)
        strings = self.strings
        return " ".join([strings[i] for i in numbers])


@functools.lru_cache(maxsize=2)
def pieces(content: str) -> WordPieces:
    """One encoder per vocabulary and worker process."""
    return WordPieces(json.loads(content))


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


OUTPUTS = {"ids": pa.binary(), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """``key``, ``n_tokens`` and the ``outputs``: ids (binary, little-endian uint32), decoded text, or their SHA-256.

    ``vocabulary`` is the path of a tokenizer file. A null or empty text has no tokens and decodes to "". Texts of any
    length are encoded whole; equal texts give equal rows; other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pieces(content.value)
        makers = {
            "ids": lambda packed: packed,
            "ids_sha256": lambda packed: hashlib.sha256(packed).hexdigest(),
            "decoded": made.decode,
            "decoded_sha256": lambda packed: hashlib.sha256(made.decode(packed).encode("utf-8")).hexdigest(),
        }
        for batch in batches:
            packed = [made.encode(value.as_py()) for value in batch.column(1)]
            columns = [pa.array([makers[o](p) for p in packed], OUTPUTS[o]) for o in outputs]
            counts = pa.array([len(p) // 4 for p in packed], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, *columns], names=["key", "n_tokens", *outputs])

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kinds = "".join(f", {o} {OUTPUTS[o]}" for o in outputs)
    return rows.mapInArrow(run, f"key {kind}, n_tokens long{kinds}").withColumnRenamed("key", key)


def decode(rows: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and the ``decoded`` text of the ids (binary, little-endian uint32); null decodes to ""."""
    content = rows.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pieces(content.value)
        for batch in batches:
            texts = [made.decode(v.as_py() or b"") for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "decoded"])

    return rows.select(rows[key].alias("key"), rows[ids].alias("ids")).mapInArrow(run, f"key {kind}, decoded string").toDF(key, "decoded")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The query's rows: token count and SHA-256 of ids and decoded text per document."""
    return encode(docs, default_vocabulary(), outputs=("ids_sha256", "decoded_sha256"))
