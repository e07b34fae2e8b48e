"""Operator 1: benchmark decontamination as a prefix-filtered containment join, with DataFrame functions only.

A benchmark item is cut into windows of 13 words (a shorter item is one window). A window is a set of word shingles, of
which a text that contains the window must have every one. So one shingle, the window's rarest in the documents, is a
sufficient prefix: documents are joined on that alone. A first pass counts how often the benchmark's shingles occur in the
documents; windows with a shingle that occurs nowhere are dropped, the others keep their rarest. A second pass joins each
word position on the prefix shingles, applies the positional and length bounds of the window, and compares the words.

Texts are never shuffled: both passes hash shingles as the words are read and look them up in a broadcast table. That table
comes from the benchmark alone; it is counted first and sent in blocks of at most ``BLOCK`` windows, so what is broadcast
has a bound and a larger benchmark takes more passes. A block is cut by hash and words, so a prefix that many windows share is
split too. Only counts, hits and one row per document are shuffled, by keys with
map-side combination.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrisk.llm.common import ascii_lower, written

WINDOW = 13
SHINGLE = 4
#: Most rows of one broadcast table (each at most a window of 13 words: about 100 MB).
BLOCK = 500_000
#: A document is contaminated if hit words are at least one in so many.
SHARE = 20

# Fixed value: the ASCII characters that are no word characters once A-Z are lower-cased.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The text's words; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def shingle_at(array: str, at: str, size: int) -> Column:
    """Hash of ``size`` words from index ``at`` on (0-based), null where the text ends before."""
    some = ", ".join(f"get({array}, {at} + {i})" for i in range(size))
    return F.expr(f"case when {at} >= 0 and {at} + {size} <= size({array}) then xxhash64({size}, {some}) end")


def windows_of(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item_id, size, grams, words, hashes): the distinct windows of each item with their shingles' hashes in order."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
    rows = rows.where("item_id is not null and size(w) > 0").withColumn("size", F.expr(f"least(size(w), {window})"))
    rows = rows.select("item_id", "size", F.explode(F.expr("transform(sequence(0, size(w) - size), i -> slice(w, i + 1, size))")).alias("words"))
    rows = rows.distinct().withColumn("grams", F.expr(f"least(size, {shingle})"))
    sized = [
        F.when(
            F.col("grams") == g,
            F.expr(f"transform(sequence(0, size - {g}), i -> xxhash64({g}, {', '.join(f'words[i + {k}]' for k in range(g))}))"),
        )
        for g in range(1, shingle + 1)
    ]
    return rows.withColumn("hashes", F.coalesce(*sized))


def positions(docs: DataFrame, grams: list[int], lookup: DataFrame, sentinel: bool, condition: str = "true") -> DataFrame:
    """Each word position whose shingle is in ``lookup`` (by ``hash``); with ``sentinel`` also one row per document (at = -1)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    rows = rows.select("*", F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("at", "_word"))
    rows = rows.drop("_word").withColumn("at", F.col("at") - 1)
    hashes = [shingle_at("w", "at", g) for g in grams]
    if len(hashes) > 1:
        rows = rows.withColumn("k", F.explode(F.when(F.col("at") < 0, F.array(F.lit(None).cast("long"))).otherwise(F.array(*hashes))))
    else:
        rows = rows.withColumn("k", hashes[0] if hashes else F.lit(None).cast("long"))
    met = F.expr(f"k = hash and ({condition})")
    if not sentinel:
        return rows.where("k is not null").join(F.broadcast(lookup), met)
    return rows.join(F.broadcast(lookup), met, "left").where("at < 0 or hash is not null")


def blocks(rows: DataFrame, columns: list[str], block: int) -> list[DataFrame]:
    """``rows`` cut by a hash of ``columns`` into parts of about ``block`` rows (one part at least)."""
    n = max(1, -(-rows.count() // block))
    return [rows.where(F.pmod(F.xxhash64(*columns), F.lit(n)) == i) for i in range(n)]


def prefixes(docs: DataFrame, items: DataFrame, window: int, shingle: int, block: int) -> DataFrame:
    """(hash, before, size, item_id, words) of each window that can occur: its rarest shingle and the words before it."""
    made = written(windows_of(items, window, shingle), "windows")
    grams = [r.grams for r in made.select("grams").distinct().orderBy("grams").collect()]  # at most ``shingle`` numbers
    known = made.select(F.explode("hashes").alias("hash")).distinct()
    counts = None
    for part in blocks(known, ["hash"], block):
        found = positions(docs, grams, part, sentinel=False).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
        counts = found if counts is None else counts.unionByName(found)
    each = made.withColumn("window", F.xxhash64("item_id", "words")).select("window", "item_id", "size", "words", F.posexplode("hashes").alias("before", "hash"))
    each = each.join(counts, "hash", "left")
    rarest = each.groupBy("window", "item_id", "size", "words").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "before")).alias("rarest")
    )
    rows = rarest.where("rarest.n > 0").select("rarest.hash", "rarest.before", "size", "item_id", "words")
    return written(rows, "prefixes"), grams


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = SHARE, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, text_hash.

    A word is hit if it lies in any occurrence of a window; n_items counts items with an occurring window. A null or empty
    text, or one without words, has 0 words and is clean. Items without words or id take no part. Rows that repeat an item
    count once; rows that repeat a document each give a row. Other columns are ignored; empty tables give clean documents
    or an empty table.
    """
    chosen, grams = prefixes(docs, items, window, shingle, block)
    fits = "at >= before and at - before + size <= size(w) and slice(w, at - before + 1, size) = words"
    parts = [positions(docs, grams, part, i == 0, fits) for i, part in enumerate(blocks(chosen, ["hash", "item_id", "words"], block))]
    found = None
    for part in parts:
        rows = part.select(
            "doc_id",
            "text_hash",
            F.when(F.col("at") < 0, F.expr("size(w)")).alias("n"),
            F.when(F.col("hash").isNotNull(), F.struct((F.col("at") - F.col("before")).alias("start"), (F.col("at") - F.col("before") + F.col("size")).alias("stop"))).alias("span"),
            F.col("item_id"),
        )
        found = rows if found is None else found.unionByName(rows)
    per_doc = found.groupBy("doc_id", "text_hash").agg(
        F.count("n").cast("int").alias("copies"),
        F.max("n").cast("long").alias("n_words"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    covered = F.expr(
        """aggregate(spans, named_struct('stop', 0, 'total', 0L), (a, s) -> named_struct('stop', greatest(a.stop, s.stop),
           'total', a.total + greatest(0, s.stop - greatest(s.start, a.stop)))).total"""
    )
    rows = per_doc.withColumn("n_hit", covered).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
        "items",
        "text_hash",
    )


def digest(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    return find(docs, items).drop("items", "text_hash")


ORACLE = r"""
with item as (
  select cast(item_id as varchar) item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark where item_id is not null),
win as (
  select distinct item_id, least(len(w), 13) size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') win
  from (select *, unnest(range(1, len(w) - least(len(w), 13) + 2)) i from item where len(w) > 0)),
doc as (
  select doc_id, row_number() over () r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from documents),
part as (
  select r, size, i, array_to_string(w[i : i + size - 1], ' ') win
  from (select r, w, size, unnest(range(1, len(w) - size + 2)) i from doc, (select distinct size from win) where len(w) >= size)),
hit as (select part.r, part.size, i, item_id from part join win on part.size = win.size and part.win = win.win),
word as (select r, count(distinct p) n_hit from (select r, unnest(range(i, i + size)) p from hit) group by r),
ids as (select r, count(distinct item_id) n_items, string_agg(distinct item_id, ',' order by item_id) s from hit group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from doc left join word using (r) left join ids using (r)
"""
