"""Brand lists: their sets, look-alikes of their labels, and marks of their own domains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrisk import dims
from linkrisk.dims import SETTINGS, Settings
from linkrisk.functions import patterns, urls
from linkrisk.functions.shared import written
from linkrisk.operators import sketch

#: Most lines of a brand list; its labels are broadcast (about 30 bytes a line), so their number is checked.
MAX_BRANDS = 200_000
#: Most rows of the look-alike index that are broadcast (a hash and a label each, about 100 bytes).
INDEX_ROWS = 500_000
#: Lines up to which ``brand_list`` sends the labels to all tasks, where a worker makes an automaton of them.
SENT_LINES = 20_000
#: Keys a word, at most, of the filter that stands before a join with the labels.
DENSEST = 16


@dataclass(frozen=True)
class Brands:
    """A brand list as a table, and the labels that rules look for, broadcast."""

    table: DataFrame
    lines: tuple[str, ...]
    lengths: tuple[int, ...]
    url_labels: Broadcast
    word_labels: Broadcast
    part_labels: Broadcast


@dataclass(frozen=True)
class LongBrands:
    """A brand list of any length: its labels stay tables (``label``), which texts meet by joins."""

    table: DataFrame
    lengths: tuple[int, ...]
    url_labels: DataFrame
    word_labels: DataFrame
    part_labels: DataFrame


def brand_table(lines: DataFrame) -> DataFrame:
    """(line, label, suffix, first_label) of a table of lines; blank lines and comments are dropped."""
    rows = lines.select(urls.stripped(F.col("line")).alias("line")).where("line <> '' and not startswith(line, '#')")
    parts = urls.domain_parts(urls.host_of(F.concat(F.lit("https://"), F.col("line"))))
    rows = rows.select("line", parts.alias("d")).select("line", F.col("d.domain").alias("label"), F.col("d.suffix").alias("suffix"))
    return rows.withColumn("first_label", F.lower(F.substring_index("line", ".", 1))).dropDuplicates(["line"])


def brand_sets(lines: DataFrame) -> Brands:
    """The sets of a brand list, which may have at most ``MAX_BRANDS`` lines."""
    spark = lines.sparkSession
    rows = brand_table(lines).limit(MAX_BRANDS + 1).collect()
    if len(rows) > MAX_BRANDS:
        raise ValueError(f"a brand list may have at most {MAX_BRANDS} lines")
    first = {r.first_label for r in rows if len(r.first_label) >= 3 and r.first_label not in dims.GENERIC_LABELS}
    text = sorted({r.label.lower() for r in rows if len(r.label) >= 4})
    send = lambda labels: spark.sparkContext.broadcast(tuple(sorted(labels)))
    return Brands(
        table=spark.createDataFrame(sorted(map(tuple, rows)), "line string, label string, suffix string, first_label string"),
        lines=tuple(sorted({r.line.lower() for r in rows})),
        lengths=tuple(sorted(len(x) for x in {r.label for r in rows if r.label and r.suffix})),
        url_labels=send(first | set(dims.SEEDED_LABELS)),
        word_labels=send(x for x in text if x.isascii()),
        part_labels=send(x for x in text if not x.isascii()),
    )


def brand_list(lines: DataFrame, sent_lines: int = SENT_LINES) -> Brands | LongBrands:
    """A brand list of any length: the sets of a short one (``brand_sets``), the tables of a longer one."""
    table = written(brand_table(lines), "brands")
    if table.limit(sent_lines + 1).count() <= sent_lines:
        return brand_sets(table.select("line"))
    text = table.where(F.length("label") >= 4).select(F.lower("label").alias("label")).distinct()
    plain = F.length("label") == F.octet_length("label")
    first = table.where((F.length("first_label") >= 3) & ~F.col("first_label").isin(list(dims.GENERIC_LABELS))).select(F.col("first_label").alias("label"))
    seeded = lines.sparkSession.createDataFrame([(x,) for x in dims.SEEDED_LABELS], "label string")
    return LongBrands(
        table=table,
        lengths=lengths_of(table.where("label <> '' and suffix <> ''")),
        url_labels=written(first.unionByName(seeded).distinct(), "url-labels"),
        word_labels=written(text.where(plain), "word-labels"),
        part_labels=written(text.where(~plain), "part-labels"),
    )


def lengths_of(labels: DataFrame) -> tuple[int, ...]:
    """The distinct lengths of ``label``."""
    return tuple(sorted(r.n for r in labels.select(F.length("label").alias("n")).distinct().collect()))


def met_labels(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``candidates`` whose ``label`` is one of ``labels``.

    Most are none: a Bloom filter leaves them out before the join, which AQE splits where one label is in very many texts.
    """
    found = sketch.build(labels, {"label": F.col("label")}, densest=DENSEST)
    return sketch.may_hold(candidates, {"label": F.col("label")}, found).join(labels.hint("merge"), "label", "left_semi")


def with_parts(df: DataFrame, name: str, text: Column, labels: Broadcast | DataFrame) -> DataFrame:
    """``df`` with the labels that are substrings of ``text``, in the order of their code points, in column ``name``."""
    if not isinstance(labels, DataFrame):
        return df.withColumn(name, patterns.parts_within(text, labels))
    rows = written(df.withColumns({"_row": F.monotonically_increasing_id(), "_sought": text}), "texts")
    parts = patterns.substrings(rows.select("_row", "_sought"), "_sought", lengths_of(labels))
    found = met_labels(parts, labels).groupBy("_row").agg(F.sort_array(F.collect_set("label")).alias(name))
    none = F.array().cast("array<string>")
    return rows.drop("_sought").join(found, "_row", "left").withColumn(name, F.coalesce(name, none)).drop("_row")


def with_words(df: DataFrame, name: str, texts: Column, brands: Brands | LongBrands) -> DataFrame:
    """``df`` with the brand labels that are words of ``texts`` (those that are not ASCII: parts of them) in column ``name``.

    The longest label wins a place; letters are compared in lower case.
    """
    lower = F.transform(texts, F.lower)
    if isinstance(brands, Brands):
        return df.withColumn(name, patterns.words_within(lower, brands.word_labels, brands.part_labels))
    rows = written(df.withColumns({"_row": F.monotonically_increasing_id(), "_sought": lower}), "texts")
    each = rows.select("_row", F.posexplode("_sought").alias("text", "_one")).where("_one <> ''")
    words = each.withColumn("_span", F.explode(patterns.spans(F.col("_one"), lengths_of(brands.word_labels))))
    words = met_labels(words.select("_row", "text", F.lit(0).alias("part"), "_span.start", "_span.label"), brands.word_labels)
    parts = patterns.substrings(each, "_one", lengths_of(brands.part_labels)).select("_row", "text", F.lit(1).alias("part"), F.lit(0).alias("start"), "label")
    hits = words.unionByName(met_labels(parts, brands.part_labels).distinct())
    found = hits.groupBy("_row").agg(F.collect_list(F.struct("text", "part", "start", "label")).alias("_hits")).select("_row", patterns.in_order(F.col("_hits")).alias(name))
    none = F.array().cast("array<string>")
    return rows.drop("_sought").join(found, "_row", "left").withColumn(name, F.coalesce(name, none)).drop("_row")


def sample_brands(spark) -> DataFrame:
    return spark.createDataFrame([(line,) for line in dims.SAMPLE_BRANDS], "line string")


def with_trust(df: DataFrame, registered: Column, brands: Brands | LongBrands) -> DataFrame:
    """``df`` with ``_own`` (the registered domain is a line of the list) and ``_trusted`` (or one of the trusted domains).

    A left join with the lines, sent to all tasks if ``brand_sets`` has bounded them.
    """
    lines = brands.table.select(F.lower("line").alias("_line")).distinct()
    lines = F.broadcast(lines) if isinstance(brands, Brands) else lines.hint("merge")
    met = df.withColumn("_registered_key", registered).join(lines, F.col("_registered_key") == F.col("_line"), "left")
    own = F.col("_line").isNotNull()
    trusted = own | F.coalesce(F.col("_registered_key").isin(list(dims.TRUSTED_DOMAINS)), F.lit(False))
    return met.withColumn("_own", own).withColumn("_trusted", trusted).drop("_registered_key", "_line")


def deletions(text: Column, most: int) -> Column:
    """Hashes of ``text`` and of all that is left of it without up to ``most`` letters.

    Two texts within an edit distance of ``most`` share one: each edit is undone by leaving out a letter on either side.
    """

    def shorter(s: Column) -> Column:
        places = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.length(s))))

    found, last = F.array(text), F.array(text)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, shorter)))
        found = F.concat(found, last)
    return F.array_distinct(F.transform(found, lambda s: F.xxhash64(s)))


def neighbourhood(label: Column, settings: Settings = SETTINGS) -> Column:
    """The keys on which a label meets its look-alikes; a label too short to be mistaken meets itself only."""
    return F.when(F.length(label) >= settings.typo_length, deletions(label, settings.typo_distance)).otherwise(F.array(F.xxhash64(label)))


def lookalikes(pairs: DataFrame, brands: Brands | LongBrands, settings: Settings = SETTINGS, index_rows: int = INDEX_ROWS) -> DataFrame:
    """Of the distinct (domain, suffix) in ``pairs`` those that look like a brand without being one.

    Labels within the allowed edit distance share a key of their deletion neighbourhoods, so candidates meet brands by an
    equi-join on those keys, and ``levenshtein`` decides. The brands' keys are broadcast if there are few (their number follows
    from the labels' lengths), else see ``_lookalikes_by_distance``. A domain whose length is no label's, give or take the
    distance, has no candidate. A pair that is a brand itself is cleared; pairs without domain or suffix are none.
    """
    near = settings.typo_distance
    likely = sorted({n + k for n in brands.lengths for k in range(-near, near + 1)})
    platform = F.concat_ws(".", "domain", "suffix").isin(list(dims.HOSTING_PLATFORMS))
    asked = pairs.where("domain <> '' and suffix <> ''").where(F.length("domain").isin(likely) & ~platform).select("domain", "suffix")
    known = brands.table.where("label <> '' and suffix <> ''").groupBy(F.col("label").alias("brand")).agg(F.collect_set("suffix").alias("of"))
    # of n letters, up to two left out: 1 + n + n(n - 1) / 2 ways, for the standard distance
    most = sum(1 + sum(n**k for k in range(1, near + 1)) if near > 2 else 1 + n + n * (n - 1) // 2 for n in brands.lengths)
    if isinstance(brands, LongBrands) or most > index_rows:
        return _lookalikes_by_distance(asked, known, settings)
    index = known.select("brand", "of", F.explode(neighbourhood(F.col("brand"), settings)).alias("key"))
    met = asked.select("domain", "suffix", F.explode(neighbourhood(F.col("domain"), settings)).alias("key")).join(F.broadcast(index), "key")
    met = met.withColumn("d", F.levenshtein("domain", "brand", near)).where("d >= 0")
    same, odd, elsewhere = _suffixes()
    exact = (F.col("d") == 0) & same
    long_enough = F.least(F.length("domain"), F.length("brand")) >= settings.typo_length
    fuzzy = ((F.col("d") == 0) & elsewhere) | (F.col("d").between(1, near) & long_enough & (same | odd))
    found = met.groupBy("domain", "suffix").agg(F.bool_or(exact).alias("exact"), F.bool_or(fuzzy).alias("fuzzy"))
    return found.where(F.col("fuzzy") & ~F.col("exact")).select("domain", "suffix")


def _suffixes() -> tuple[Column, Column, Column]:
    """Whether a domain's suffix is one of the label's, whether it is odd, and odd while the label has another."""
    same, odd = F.array_contains("of", F.col("suffix")), F.col("suffix").isin(list(dims.LOOKALIKE_SUFFIXES))
    return same, odd, odd & F.exists("of", lambda s: s != F.col("suffix"))


def _lookalikes_by_distance(asked: DataFrame, known: DataFrame, settings: Settings) -> DataFrame:
    """``lookalikes`` by shuffled joins, one for each distance from none upwards.

    Pairs that a distance settles do not go on to the next one, whose keys are shorter and so shared by more labels: in a list
    so dense that many labels share a key, most are settled before. Odd suffixes meet all labels, others those of their own.
    The joins are hinted: by the size of the files below, Spark would take the keys made of them for small and broadcast them.
    """
    same, odd, elsewhere = _suffixes()
    known = written(known, "known")
    first = asked.distinct().join(known.hint("merge"), F.col("domain") == F.col("brand"), "left")
    state = F.when(same, "brand").when(elsewhere, "found").otherwise("open")
    first = written(first.select("domain", "suffix", state.alias("state")), "pairs")
    found, left = first.where("state = 'found'").drop("state"), first.where("state = 'open'").drop("state")
    left = left.where(F.length("domain") >= settings.typo_length)
    labels = known.where(F.length("brand") >= settings.typo_length).select("brand", F.explode(F.array_union("of", F.array(F.lit("")))).alias("end"))
    ends = F.when(odd, F.lit("")).otherwise(F.col("suffix"))
    for distance in range(1, settings.typo_distance + 1):
        index = labels.select("brand", "end", F.explode(deletions(F.col("brand"), distance)).alias("key"))
        met = left.select("domain", "suffix", ends.alias("end"), F.explode(deletions(F.col("domain"), distance)).alias("key")).join(index.hint("merge"), ["key", "end"])
        met = met.where(F.levenshtein("domain", "brand", distance) >= 1).select("domain", "suffix").distinct()
        if distance < settings.typo_distance:
            met = written(met, "near")
            left = written(left.join(met, ["domain", "suffix"], "left_anti"), "left")
        found = found.unionByName(met)
    return found
