"""Many labels sought in a text at once: a trie with failure links, which reads each text once however long the list is.

The list is broadcast, so plans hold a handle and not the labels. A worker builds the automaton once and keeps it. Labels of
lists too long for that meet the ``substrings`` of texts by a join.

The helpers are called non-deterministic, though they are not: else a filter on what they give is pushed below them and makes
Spark call them twice, by workers of their own.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Letters of a text at which substrings begin that are made at a time.
CHUNK = 256


class Automaton:
    """Finds all occurrences of all labels in one pass over a text."""

    def __init__(self, labels: tuple[str, ...]):
        self.labels = labels
        self.step: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for i, label in enumerate(labels):
            at = 0
            for letter in label:
                following = self.step[at].get(letter)
                if following is None:
                    following = self.step[at][letter] = len(self.step)
                    self.step.append({})
                    self.ends.append(-1)
                at = following
            if label:
                self.ends[at] = i
        # where to go on if no letter fits, and the next shorter label that ends at the same place
        self.back = [0] * len(self.step)
        self.shorter = [0] * len(self.step)
        waiting = deque(self.step[0].values())
        while waiting:
            at = waiting.popleft()
            for letter, following in self.step[at].items():
                back = self.back[at]
                while back and letter not in self.step[back]:
                    back = self.back[back]
                self.back[following] = self.step[back].get(letter, 0)
                waiting.append(following)
            behind = self.back[at]
            self.shorter[at] = behind if self.ends[behind] >= 0 else self.shorter[behind]

    def occurrences(self, text: str) -> Iterator[tuple[int, int]]:
        """(end, label number), by end; of labels that end at one place the longest comes first."""
        step, back, ends, shorter, at = self.step, self.back, self.ends, self.shorter, 0
        for i, letter in enumerate(text, 1):
            while at and letter not in step[at]:
                at = back[at]
            at = step[at].get(letter, 0)
            found = at if ends[at] >= 0 else shorter[at]
            while found:
                yield i, ends[found]
                found = shorter[found]

    def parts(self, text: str) -> list[str]:
        """The labels that are substrings of ``text``, in the list's order."""
        return [self.labels[i] for i in sorted({i for _, i in self.occurrences(text)})]

    def words(self, text: str) -> list[str]:
        """The labels that are words of ``text`` from left to right, the longest at each place, none overlapping the one before.

        A word ends where a letter, digit or underscore meets none.
        """
        inside = [c.isalnum() or c == "_" for c in text]
        border = [a != b for a, b in zip([False, *inside], [*inside, False], strict=True)]
        longest: dict[int, int] = {}
        for end, i in self.occurrences(text):
            start = end - len(self.labels[i])
            if border[start] and border[end]:
                longest[start] = max(longest.get(start, 0), end)
        out, free = [], 0
        for start in sorted(longest):
            if start >= free:
                free = longest[start]
                out.append(text[start:free])
        return out


@lru_cache(maxsize=8)
def automaton(labels: tuple[str, ...]) -> Automaton:
    return Automaton(labels)


def parts_within(text: Column, labels: Broadcast) -> Column:
    """The labels that are substrings of ``text``, in the list's order; none of a null text."""

    @F.pandas_udf("array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = automaton(labels.value)
        for batch in batches:
            yield batch.map(lambda x: machine.parts(x) if x else [])

    return find.asNondeterministic()(text)


def words_within(texts: Column, plain: Broadcast, other: Broadcast) -> Column:
    """The distinct labels of ``plain`` that are words, and of ``other`` that are substrings, of any of ``texts`` (lower case).

    They come text by text, and within a text words before substrings; null texts hold none.
    """

    @F.pandas_udf("array<string>")
    def find(batch: pd.Series) -> pd.Series:
        words, parts = automaton(plain.value), automaton(other.value)
        found = [[y for x in ([] if texts is None else texts) if x for y in (*words.words(x), *parts.parts(x))] for texts in batch]
        return pd.Series([list(dict.fromkeys(x)) for x in found], dtype=object)

    return find.asNondeterministic()(texts)


def substrings(rows: DataFrame, text: str, lengths: tuple[int, ...]) -> DataFrame:
    """``rows`` without ``text``, once for each substring of it that has one of ``lengths``, in ``label``.

    Texts are cut into chunks that overlap by the longest label, so making the substrings of a long one stays cheap.
    """
    one, kept = F.lit(1), [c for c in rows.columns if c != text]
    if not lengths:
        return rows.select(*kept, F.col(text).alias("label")).limit(0)
    df = rows.where(F.length(text) >= max(1, min(lengths))).withColumn("_from", F.explode(F.sequence(one, F.length(text), F.lit(CHUNK))))
    df = df.select(*kept, F.col(text).substr(F.col("_from"), F.lit(CHUNK + max(lengths))).alias("_chunk"))
    df = df.withColumn("_at", F.explode(F.sequence(one, F.least(F.length("_chunk"), F.lit(CHUNK)))))
    df = df.withColumn("_n", F.explode(F.array(*map(F.lit, lengths)))).where(F.col("_at") + F.col("_n") - 1 <= F.length("_chunk"))
    return df.select(*kept, F.col("_chunk").substr(F.col("_at"), F.col("_n")).alias("label"))


def word_spans(text: str, lengths: frozenset[int]) -> list[tuple[int, str]]:
    """(start, word) of the ASCII parts of ``text`` with one of ``lengths`` that end at word borders (see ``Automaton.words``)."""
    inside = [c.isalnum() or c == "_" for c in text]
    borders = [i for i, (a, b) in enumerate(zip([False, *inside], [*inside, False], strict=True)) if a != b]
    most, out = max(lengths, default=0), []
    for i, start in enumerate(borders):
        for end in borders[i + 1 :]:
            if end - start > most:
                break
            if end - start in lengths and text[start:end].isascii():
                out.append((start, text[start:end]))
    return out


def spans(text: Column, lengths: tuple[int, ...]) -> Column:
    """``word_spans`` as array<struct<start, label>>."""
    wanted = frozenset(lengths)

    @F.pandas_udf("array<struct<start: int, label: string>>")
    def find(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: [{"start": i, "label": w} for i, w in word_spans(x or "", wanted)])

    return find(text)


def in_order(hits: Column) -> Column:
    """The distinct labels of hits (text, part, start, label), as ``words_within`` gives them."""

    @F.pandas_udf("array<string>")
    def sort(batch: pd.Series) -> pd.Series:
        def one(found) -> list[str]:
            out, at, free = {}, -1, 0
            for text, part, start, _, label in sorted((h["text"], h["part"], h["start"], h["part"] or -len(h["label"]), h["label"]) for h in found):
                if text != at:
                    at, free = text, 0
                if part or start >= free:
                    out[label] = None
                    free = free if part else start + len(label)
            return list(out)

        return batch.map(one)

    return sort(hits)
