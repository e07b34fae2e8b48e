"""Operator 10: n-gram Jaccard join by PartEnum signatures.

A document is the set of its word shingles; equal sets are one class. Sets that link (similarity at least ``num / den``)
differ in at most k elements, where k follows from their sizes. Sizes are cut into bands; a set gets signatures for its own
band and, if it is large enough to link with the next band, for that one too.

Signatures are those of PartEnum with two levels. A band's feature domain is cut by a hash into parts and each part into
three second-level parts. Of more than k / 2 parts at least one holds at most one of the k differences, so at least two of
its three second-level parts are equal in both sets: each subset of two second-level parts is a signature. A set uses the
first parts, as many as its own k asks for, so sets that can differ in little have few signatures. Parts count only if at
least two of their second-level parts hold something; a set with too few such parts gets signatures by another hash as well,
and after ``SEEDS`` hashes its single elements. So two sets that link always share a signature of some content.

The plan:

1. One pass over the texts gives each document's class, and each class's signatures and parity sketch. The sketch has a bit
   for each of 2 to 4 cells per element, which tells whether the cell holds an odd number of elements. Two sketches differ
   in at most as many bits as the sets have differences.
2. Signatures are counted with map-side sums; those of one class only are dropped. What is left are memberships of buckets.
3. Each class is paired with the class of most memberships in each of its buckets: as many pairs as memberships at most,
   and few different ones within a group of near copies. Pairs whose sizes and sketches allow a link are verified on the
   sets. Links give components.
4. Buckets with classes of several components are left. In them classes of different components are compared by size and
   sketch, block by block; large buckets are dealt over many tasks by pairs of blocks. Of those that may link, each class
   proposes its nearest few, which are verified. Buckets in which some class has had more than those are gone through anew,
   with the components that have grown together meanwhile; where none grew, with more proposals of each class. It ends when
   each class has proposed all it has, so no link between different components is missed, while large groups of near copies
   cost a few passes, not all pairs.

Each table is written to the shared folder, and dropped when its readers are written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrisk.functions.shared import Scratch
from linkrisk.llm.components import components

SEEDS = 4
#: Most members of a bucket that one task compares with each other at once; larger buckets are cut into blocks.
BLOCK = 4096
#: Most rows of a table that is broadcast (each two longs).
BROADCAST_ROWS = 2_000_000
REMEMBERED_WORDS = 100_000
#: Rows whose signatures a worker holds at once.
ROWS = 1000
#: How many pairs a class proposes in a block at first; what it has beyond those is left to the next round.
NEAREST = 24
#: Bits of the smallest and largest sketch.
LEAST_BITS, MOST_BITS = 64, 1 << 16

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


WORD_HASHES = WordHashes()


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, sorted; with fewer words the whole sequence; none without words."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, ASCII white space only
    n = len(words)
    if not n:
        return np.empty(0, U)
    hashes = np.fromiter(map(WORD_HASHES.__getitem__, words), U, n)
    width = min(size, n)
    out = np.full(n - width + 1, width, U)
    for i in range(width):
        out = mix(out * U(0x9E3779B97F4A7C15) + hashes[i : n - width + 1 + i])
    return np.unique(out)


def class_of(x: np.ndarray) -> int | None:
    """The set's hash, null for the empty set."""
    return xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) if len(x) else None


#: The subsets of two of a part's three second-level parts.
SUBSETS = ((0, 1), (0, 2), (1, 2))


@dataclass
class PartEnum:
    """Signatures for similarity at least num / den."""

    num: int = 85
    den: int = 100
    starts: list[int] = field(default_factory=lambda: [1])
    sized: dict[int, int] = field(default_factory=dict)

    def start(self, band: int) -> int:
        """The smallest size of a band; a band spans two steps of the similarity."""
        while len(self.starts) <= band:
            last = self.starts[-1]
            self.starts.append(max(last + 1, -(-last * self.den * self.den // (self.num * self.num))))
        return self.starts[band]

    def differences(self, total: int) -> int:
        """The most elements in which two linked sets of ``total`` elements together can differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def most(self, n: int, band: int) -> int:
        """The most elements in which a set of n elements differs from one that it links with in ``band``."""
        return self.differences(n + min(n * self.den // self.num, self.start(band + 1) - 1))

    def bands(self, n: int) -> list[int]:
        band = 0
        while self.start(band + 1) <= n:
            band += 1
        return [band, band + 1] if n * self.den // self.num >= self.start(band + 1) else [band]

    def parts(self, band: int) -> int:
        """How many first-level parts a band has, so that all but rare sets have as many usable ones as they need."""
        if band not in self.sized:
            low, top = self.start(band), self.start(band + 1) - 1
            sizes = sorted({max(1, -(-low * self.num // self.den)), low, top})
            count = max(self.most(n, band) // 2 + 1 for n in sizes)
            limit = 2 * count + 8

            def enough(parts: int) -> bool:
                for n in sizes:
                    empty = math.exp(-n / (3 * parts))
                    unusable = parts * (3 * empty * empty * (1 - empty) + empty**3)
                    if parts - unusable < self.most(n, band) // 2 + 1 + 2 * math.sqrt(unusable):
                        return False
                return True

            while count < limit and not enough(count):
                count += 1 + count // 100
            self.sized[band] = count
        return self.sized[band]

    def of_band(self, x: np.ndarray, band: int, seed: int) -> tuple[np.ndarray, bool]:
        """Signatures of one band by one hash, and whether the guarantee holds for this set."""
        parts, need = self.parts(band), self.most(len(x), band) // 2 + 1
        spread = mix(x + U(seed))
        cell = ((spread >> U(32)) % U(3 * parts)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        content = np.zeros(3 * parts, U)
        content[cell[first]] = mix(np.add.reduceat(spread[order], first)) | U(1)
        content = content.reshape(parts, 3)
        usable = np.cumsum((content != 0).sum(axis=1) >= 2)
        holds = bool(usable[-1] >= need)
        content = content[: int(np.searchsorted(usable, need)) + 1] if holds else content
        salt = U(((band * 31 + seed) * 2 + 1) * 0x165667B19E3779F9 % (1 << 64))
        number = np.arange(len(content), dtype=U) * U(3) + salt
        found = []
        for i, (a, b) in enumerate(SUBSETS):
            some = (content[:, a] | content[:, b]) != 0
            found.append(mix(mix(content[some, a] + U(7)) * U(3) + content[some, b] + number[some] + U(i)))
        return np.concatenate(found), holds

    def signatures(self, x: np.ndarray) -> np.ndarray:
        found = [np.empty(0, U)]
        for band in self.bands(len(x)):
            if not self.most(len(x), band):
                continue  # only equal sets link, and those are one class
            for seed in range(SEEDS):
                some, holds = self.of_band(x, band, seed)
                found.append(some)
                if holds:
                    break
            else:
                found.append(mix(x + U((band * 2 + 1) * 0xD6E8FEB86659FD93 % (1 << 64))))
        return np.unique(np.concatenate(found))


def sketch(x: np.ndarray) -> bytes:
    """One bit for each of 2 to 4 cells an element: whether an odd number of elements falls into it."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(x) - 1).bit_length()))
    cells = (mix(x + U(0x51ED270B)) & U(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(cells, minlength=bits) & 1, bitorder="little").tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) with fewer cells, ``width`` words; the parity of two cells is that of their union."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def as_words(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the smallest one's width."""
    width = min(map(len, sketches)) // 8
    out = np.empty((len(sketches), width), U)
    sizes = np.array([len(s) for s in sketches])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        out[at] = folded(np.frombuffer(b"".join([sketches[i] for i in at]), "<u8").reshape(len(at), -1), width)
    return out


def may_link(left: bytes, right: bytes, most: int) -> bool:
    """Whether two sketches differ in at most ``most`` cells."""
    a, b = int.from_bytes(left, "little"), int.from_bytes(right, "little")
    wide, narrow = (a, b) if len(left) > len(right) else (b, a)
    size, least = 8 * max(len(left), len(right)), 8 * min(len(left), len(right))
    while size > least:
        size //= 2
        wide = (wide >> size) ^ (wide & ((1 << size) - 1))
    return (wide ^ narrow).bit_count() <= most


def features(docs: DataFrame, size: int, scheme: PartEnum) -> DataFrame:
    """doc_id with its set's size, class, signatures and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            n, cls, signatures, sketches = [], [], [], []
            for v in batch.column(1).cast(pa.binary()):
                x = shingles(v.as_py(), size)
                n.append(len(x))
                cls.append(class_of(x))
                signatures.append(scheme.signatures(x).tobytes() if len(x) else None)
                sketches.append(sketch(x) if len(x) else None)
            columns = [batch.column(0), pa.array(n, pa.int32()), pa.array(cls, pa.int64()), of_longs(signatures), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "cls", "signatures", "sketch"])

    def of_longs(values: list[bytes | None]) -> pa.Array:
        offsets = np.cumsum([0, *(len(v or b"") // 8 for v in values)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(v or b"" for v in values), np.int64)))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n int, cls long, signatures array<long>, sketch binary")


def smaller(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if it has at most ``rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def within(a: Column, b: Column, scheme: PartEnum) -> Column:
    """Whether the sizes allow a link."""
    return F.least(a, b) * scheme.den >= F.greatest(a, b) * scheme.num


def promising(pairs: DataFrame, classes: DataFrame, scheme: PartEnum) -> DataFrame:
    """Those of the pairs of classes (a, b) whose sizes and sketches allow a link."""
    left, right = classes.select("cls", "n", "sketch").toDF("a", "a_n", "a_sketch"), classes.select("cls", "n", "sketch").toDF("b", "b_n", "b_sketch")
    both = pairs.join(left, "a").join(right, "b").where(within(F.col("a_n"), F.col("b_n"), scheme))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a_n", "b_n", "a_sketch", "b_sketch")), strict=True)
            keep = [may_link(x, y, scheme.differences(n + m)) for n, m, x, y in rows]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch").mapInArrow(run, "a long, b long")


def sets_of(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, rows: int) -> DataFrame:
    """(cls, elements): the sorted elements of each class that occurs in the pairs."""
    needed = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    reps = classes.join(needed, "cls", "left_semi").select(F.col("cls").alias("wanted"), F.col("rep").alias("doc_id"))
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(smaller(reps, rows), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            made = [shingles(v.as_py(), size) for v in batch.column(1)]
            # a doc_id that is repeated may have texts of other classes too
            right = pa.array([class_of(x) == cls for x, cls in zip(made, batch.column(0).to_pylist(), strict=True)], pa.bool_())
            elements = pa.array([x.tobytes() for x in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), elements], names=["cls", "elements"]).filter(right)

    return texts.select("wanted", "text").mapInArrow(run, "cls long, elements binary").dropDuplicates(["cls"])


def verified(pairs: DataFrame, sets: DataFrame, scheme: PartEnum) -> DataFrame:
    """Those of the pairs of classes (a, b) whose sets link."""
    both = pairs.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for u, v in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(u.as_buffer(), U), np.frombuffer(v.as_buffer(), U)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(scheme.den * shared >= scheme.num * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete runs of equal keys, from sorted batches, with the places where runs start and the last one ends."""
    held = None
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            change = np.ones(rows.num_rows, bool)
            change[1:] = False
            for m in (rows[k].to_numpy() for k in keys):
                change[1:] |= m[1:] != m[:-1]
            starts = np.flatnonzero(change)
            held = rows.slice(int(starts[-1]))
            if len(starts) > 1:
                yield rows.slice(0, int(starts[-1])), starts
    if held is not None:
        yield held, np.array([0, held.num_rows])


def across(rows: DataFrame, scheme: PartEnum, block: int, nearest: int) -> DataFrame:
    """Pairs (a, b) of classes of different components in one bucket whose sizes and sketches allow a link, and unfinished buckets.

    ``rows``: sig, m (members of the bucket), cls, component, n, sketch. A bucket of more than ``block`` members is cut into
    blocks by a hash; each block meets itself (side 0) and each other block (as left, 1, or right, 2) in a task of its own.
    Each class gives its ``nearest`` pairs in a block. Where some class had others, a row gives the bucket (``sig``, else null).
    """
    cut = rows.withColumn("blocks", F.expr(f"cast(ceil(m / {block}) as int)")).withColumn("own", F.expr("pmod(hash(cls, 3), blocks)"))
    at = """transform(sequence(0, blocks - 1), c -> named_struct('i', least(c, own), 'j', greatest(c, own),
            'side', case when c = own then 0 when own < c then 1 else 2 end))"""
    cut = cut.withColumn("at", F.explode(F.expr(at)))
    dealt = cut.select("sig", "at.i", "at.j", "at.side", "cls", "component", "n", "sketch").repartition("sig", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int]] = set()
        unfinished: set[int] = set()
        for table, starts in whole_groups(batches, ["sig", "i", "j"]):
            sig, cls, comp, n, side = (table[c].to_numpy() for c in ("sig", "cls", "component", "n", "side"))
            sketches = table["sketch"].to_pylist()
            n = n.astype(np.int64)
            if len(given) > REMEMBERED_WORDS:
                yield batch_of(given, unfinished)
                given, unfinished = set(), set()
            for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if stop - start < 2 or (comp[start:stop] == comp[start]).all():
                    continue
                words = as_words(sketches[start:stop])
                size, part, place = n[start:stop], comp[start:stop], side[start:stop]
                right = np.flatnonzero(place != 1)
                for i in np.flatnonzero(place != 2):
                    j = right[part[right] != part[i]]
                    j = j[(j > i) | (place[j] != 0) | (place[i] != 0)]
                    low, high = np.minimum(size[j], size[i]), np.maximum(size[j], size[i])
                    j = j[low * scheme.den >= high * scheme.num]
                    if not len(j):
                        continue
                    apart = np.bitwise_count(words[j] ^ words[i]).sum(axis=1, dtype=np.int64)
                    fits = apart <= (size[j] + size[i]) * (scheme.den - scheme.num) // (scheme.den + scheme.num)
                    j, apart = j[fits], apart[fits]
                    if len(j) > nearest:
                        unfinished.add(int(sig[start]))
                        j = j[np.lexsort((cls[start + j], apart))[:nearest]]
                    a = int(cls[start + i])
                    given.update((a, b) if a < b else (b, a) for b in cls[start + j].tolist())
        yield batch_of(given, unfinished)

    def batch_of(given: set[tuple[int, int]], unfinished: set[int]) -> pa.RecordBatch:
        none = [None] * len(unfinished)
        columns = [[a for a, _ in given] + none, [b for _, b in given] + none, [None] * len(given) + list(unfinished)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "sig"])

    return dealt.sortWithinPartitions("sig", "i", "j").mapInArrow(run, "a long, b long, sig long").distinct()


def join(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100, block: int = BLOCK, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    ``component_id`` is the smallest doc_id that links reach, the document's own included. A null or empty text, or one
    without words, has no shingles, links with nothing, and is its own component. Equal texts link unless empty; ties do not
    arise, as components are named by the smallest id. Rows that repeat a doc_id each give a row. A text that only rows
    without doc_id have links with nothing, and its component is null. Shingles and classes are told apart by 64-bit hashes.
    Other columns are ignored; an empty table gives an empty one.
    """
    scheme = PartEnum(num, den)
    scratch = Scratch(docs.sparkSession, "jaccard")
    made = scratch.keep(features(docs, size, scheme), "features")
    usable = made.where("cls is not null")
    grouped = usable.groupBy("cls").agg(F.min("doc_id").cast("long").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = scratch.keep(grouped.where("rep is not null"), "classes")
    rows = scratch.keep(made.select("doc_id", "n", "cls"), "rows")

    # one row of each class has its signatures counted
    copied = classes.where("copies > 1").select("cls", "rep")
    others = usable.join(smaller(copied, broadcast_rows), "cls", "left").where("rep is null or rep = doc_id")
    flat = others.select(F.explode("signatures").alias("sig"), "cls")
    shared = scratch.keep(flat.groupBy("sig").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("sig"), "shared")
    members = scratch.keep(flat.join(smaller(shared, broadcast_rows), "sig", "left_semi").distinct(), "members")
    scratch.drop(made, shared)

    # each class with the one of most memberships in each of its buckets
    degrees = members.groupBy("cls").agg(F.count(F.lit(1)).alias("degree"))
    ranked = members.join(smaller(scratch.keep(degrees, "degrees"), broadcast_rows), "cls")
    centres = scratch.keep(ranked.groupBy("sig").agg(F.max(F.struct("degree", "cls")).alias("top")).select("sig", F.col("top.cls").alias("centre")), "centres")
    pairs = members.join(smaller(centres, broadcast_rows), "sig").where("cls <> centre")
    pairs = pairs.select(F.least("cls", "centre").alias("a"), F.greatest("cls", "centre").alias("b")).distinct()
    tested = scratch.keep(promising(pairs, classes, scheme), "pairs")
    scratch.drop(centres)

    def linked(pairs: DataFrame) -> DataFrame:
        sets = scratch.keep(sets_of(pairs, classes, docs, size, broadcast_rows), "sets")
        links = scratch.keep(verified(pairs, sets, scheme), "links")
        scratch.drop(sets)
        return links

    def merged(state: DataFrame, links: DataFrame) -> DataFrame:
        """Each class's component once the links are added."""
        left, right = state.toDF("a", "a_in"), state.toDF("b", "b_in")
        between = links.join(left, "a").join(right, "b").select(F.col("a_in").alias("a"), F.col("b_in").alias("b")).distinct()
        labels = components(scratch.keep(between, "between"), scratch)
        new = state.join(labels.toDF("component", "to"), "component", "left").select("cls", F.coalesce("to", "component").alias("component"))
        new = scratch.keep(new, "state")
        scratch.drop(labels)
        return new

    state = scratch.keep(classes.select("cls", F.col("cls").alias("component")), "state")
    state = merged(state, linked(tested))

    # pairs across components
    nearest = NEAREST
    while True:
        placed = members.select("sig", "cls").join(smaller(state, broadcast_rows), "cls")
        mixed = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m"))
        mixed = scratch.keep(mixed.where("lo <> hi").select("sig", "m"), "mixed")
        rest = scratch.keep(placed.join(smaller(mixed, broadcast_rows), "sig"), "rest")
        scratch.drop(members, mixed)
        found = scratch.keep(across(rest.join(classes.select("cls", "n", "sketch"), "cls"), scheme, block, nearest), "across")
        new = scratch.keep(found.where("sig is null").select("a", "b").join(tested, ["a", "b"], "left_anti"), "pairs")
        links = linked(new)
        grown = not links.isEmpty()
        if grown:
            state = merged(state, links)
        unfinished = found.where("sig is not null").select("sig")
        if unfinished.isEmpty():
            break
        members = scratch.keep(rest.select("sig", "cls").join(smaller(unfinished, broadcast_rows), "sig", "left_semi"), "members")
        scratch.drop(rest)
        nearest = NEAREST if grown else nearest * 8
        tested = scratch.keep(tested.unionByName(new), "tested")

    # a component's smallest doc_id
    named = scratch.keep(classes.select("cls", "rep").join(state, "cls"), "named")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    least = scratch.keep(named.join(least, "component").select("cls", "component_id"), "components")
    scratch.drop_but(rows, least)
    out = rows.join(least, "cls", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return join(docs)


ORACLE = r"""
with doc as (
  select row_number() over () r, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> '') w
  from documents),
sh as (
  select distinct r, doc_id, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') s
  from (select *, unnest(range(1, len(w) - least(len(w), 4) + 2)) i from doc where len(w) > 0)),
n as (select r, doc_id, count(*) n from sh group by all),
inter as (select a.r x, b.r y, count(*) c from sh a join sh b on a.s = b.s and a.r <> b.r group by all),
link as (
  select nx.doc_id a, ny.doc_id b from inter join n nx on nx.r = x join n ny on ny.r = y where 100 * c >= 85 * (nx.n + ny.n - c)),
reach as (
  with recursive walk(a, b) as (
    select doc_id, doc_id from doc union select walk.a, link.b from walk join link on walk.b = link.a)
  select a, min(b) m from walk group by a)
select doc.doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, reach.m component_id
from doc left join n using (r) join reach on reach.a = doc.doc_id
"""
