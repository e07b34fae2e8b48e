"""A Bloom filter as a table of 64-bit words: most rows that no list holds are left out before any shuffle.

Each key sets four bits of one word, both chosen by its hash, so the filter is one ``bit_or`` per word (added up map-side) and
a probe is one equi-join on the word's number, which is broadcast. A key of the list is never left out; of keys that are not
in it, about one in a hundred passes (each word has room for ``KEYS_PER_WORD`` keys), and the join that follows sorts those
out. A table of keys too large for ``MOST_WORDS`` has no filter, and all rows pass.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrisk.functions.shared import written

KEYS_PER_WORD = 4
#: Words of the largest filter, some 100 MB where it is broadcast.
MOST_WORDS = 2_000_000


class Filter(NamedTuple):
    """The words with any bit (word, bits), and how many words there are."""

    words: DataFrame
    n_words: int


def _word(key: Column, kind: str, n_words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(kind), key), F.lit(n_words).cast("long"))


def _bits(key: Column, kind: str) -> Column:
    """Four bits, six digits of a second hash each; two may be one."""
    h = F.xxhash64(key, F.lit(kind))
    out = F.lit(0).cast("long")
    for i in range(4):
        place = F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return out


def build(rows: DataFrame, kinds: dict[str, Column], most_words: int = MOST_WORDS, densest: int = KEYS_PER_WORD) -> Filter | None:
    """A filter of the keys that ``kinds`` names in ``rows``, or None if they are too many; null keys are no keys.

    Keys of different kinds do not meet. Repeated keys count as often as they stand there, so the filter is only sparser. With
    up to ``densest`` keys a word a filter of the largest size is made all the same; it lets more other keys pass.
    """
    n_keys = rows.count() * len(kinds)
    if -(-n_keys // max(densest, KEYS_PER_WORD)) > most_words:
        return None
    n_words = max(1, min(-(-n_keys // KEYS_PER_WORD), most_words))
    keys = F.array(*[F.when(c.isNotNull(), F.struct(_word(c, k, n_words).alias("word"), _bits(c, k).alias("bits"))) for k, c in kinds.items()])
    marks = rows.select(F.explode(F.array_compact(keys)).alias("m")).select("m.*")
    return Filter(written(marks.groupBy("word").agg(F.bit_or("bits").alias("bits")), "filter"), n_words)


def may_hold(rows: DataFrame, kinds: dict[str, Column], found: Filter | None) -> DataFrame:
    """The rows that have a key of any of ``kinds`` that the filter may hold; repeated rows and all columns stay as they are.

    Rows whose keys are all null are left out. Without a filter all rows stay. No row is shuffled.
    """
    if found is None:
        return rows
    kept, met = rows, F.lit(False)
    for i, (kind, key) in enumerate(kinds.items()):
        word, bits, held = f"_word{i}", f"_bits{i}", f"_held{i}"
        words = F.broadcast(found.words.select(F.col("word").alias(word), F.col("bits").alias(held)))
        kept = kept.withColumns({word: F.when(key.isNotNull(), _word(key, kind, found.n_words)), bits: _bits(key, kind)}).join(words, word, "left")
        met = met | F.coalesce(F.col(held).bitwiseAND(F.col(bits)) == F.col(bits), F.lit(False))
    return kept.where(met).select(*rows.columns)
