"""Operator 13: mixing sources to target weights by a multivariate-hypergeometric splitting tree, with DataFrame functions only.

1. Words are counted and summed by source. The sources' weights share the words of all; a target stops at ``most`` times its
   source's words, and what that leaves is shared anew by weight among the others (solved in one pass over the sources, in
   the order in which they reach that limit).
2. A source's documents stand in one stream, in the order of a hash. The stream is cut into blocks of equal numbers of words.
   A target of 2.3 times the source draws every block twice, and then blocks in the order of a hash up to the rest, the last
   of them in part. So the words drawn equal the target to the word, and a document is taken once per pass at most.
3. The output shards are split in halves, again and again. At each node of that tree the node's quota of blocks of each
   source is split: how many of them go to the left half is drawn from the multivariate hypergeometric distribution, source
   after source, by inversion from the mode. So shards hold equally many blocks, each source's quota is kept exactly, and a
   shard's share of a source varies as in a random deal.
4. The shards take disjoint stretches of each source's permuted blocks, whose lengths are their quotas. Blocks of one pass
   come before those of the next, so copies of a block lie in different shards where there is room.
5. Within a shard, pieces are ordered by a hash.

Where documents stand in their stream is found by cells (the first digits of their hash): words are summed by cell, cells are
summed up by source, and rows are added up within their cell only; equal rows are one row with a number of copies. So no task
holds a whole source. The tree and the blocks have a size that the parameters and the number of sources set, whatever the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkrisk.functions.shared import Scratch

WEIGHTS = (5, 2, 1)
MOST = 3
SHARDS = 16
#: Blocks that a shard holds on average, unless they would be of fewer words than LEAST_WORDS.
BLOCKS = 256
LEAST_WORDS = 1024
SEED = 13
#: Digits of a document's hash that name its cell: 16^3 cells a source.
CELL_DIGITS = 3
#: Most copies of a row that are dealt out at once.
RUN = 10_000
#: Most entries of the table of blocks that is broadcast, about 24 bytes each; beyond it the join is shuffled.
BROADCAST_ENTRIES = 1_000_000

SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

PIECE = "struct<shard:int,epoch:int,first:long,words:long>"


def long(x: int) -> Column:
    return F.lit(x).cast("long")


def words_in(text: Column) -> Column:
    """The number of words; null has none. Each word and the space after it shrink to one letter, whose number is counted."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD + r"[\x20\x09-\x0D]*", "w"), SPACE, "")), F.lit(0)).cast("long")


def hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL for how many marked ones are among ``drawn`` of ``total`` things: inversion at ``u`` in [0, 1), from the mode outwards.

    Probabilities are relative to the mode's, each made from its neighbour's, so nothing over- or underflows that matters. What
    rounding leaves, if anything, is the mode's. A transform of an array of one value gives that value a name.
    """
    above = "(s.k - j) * (s.n - j) / ((j + 1) * (s.t - s.k - s.n + j + 1))"
    below = "j * (s.t - s.k - s.n + j) / ((s.k - j + 1) * (s.n - j + 1))"

    def weight(steps: str, ratio: str) -> str:
        added = f"transform(array(a.p * {ratio}), p -> named_struct('p', p, 'sum', a.sum + p))[0]"
        return f"aggregate({steps}, named_struct('p', 1D, 'sum', 0D), (a, j) -> {added}, a -> a.sum)"

    def search(left: str, pick: str, steps: str, ratio: str, to: str) -> str:
        found = "named_struct('p', p, 'left', a.left - p, 'pick', if(a.pick is null and a.left < p, {0}, a.pick))".format(to)
        step = f"transform(array(a.p * {ratio}), p -> {found})[0]"
        return f"aggregate({steps}, named_struct('p', 1D, 'left', {left}, 'pick', {pick}), (a, j) -> {step})"

    upwards = search("s.u * w - 1", "if(s.u * w < 1, s.mode, null)", "s.up", above, "j + 1")
    downwards = search("z.left", "z.pick", "s.down", below, "j - 1")
    walked = f"transform(array(1 + {weight('s.up', above)} + {weight('s.down', below)}), w -> transform(array({upwards}), z -> coalesce({downwards}.pick, s.mode))[0])[0]"
    up = "if(b.hi > b.mode, sequence(b.mode, b.hi - 1), cast(array() as array<bigint>))"
    down = "if(b.mode > b.lo, sequence(b.mode, b.lo + 1, -1L), cast(array() as array<bigint>))"
    steps = f"named_struct('t', cast(b.t as double), 'k', cast(b.k as double), 'n', cast(b.n as double), 'u', b.u, 'mode', b.mode, 'up', {up}, 'down', {down})"
    low, high = "greatest(0L, g.n + g.k - g.t)", "least(g.n, g.k)"
    mode = f"least(greatest(cast(floor(cast((g.n + 1) * (g.k + 1) as double) / (g.t + 2)) as bigint), {low}), {high})"
    bounds = f"named_struct('t', g.t, 'k', g.k, 'n', g.n, 'u', g.u, 'lo', {low}, 'hi', {high}, 'mode', {mode})"
    given = f"named_struct('t', {total}, 'k', {marked}, 'n', {drawn}, 'u', {u})"
    return f"transform(transform(transform(array({given}), g -> {bounds}), b -> {steps}), s -> {walked})[0]"


def split(counts: str, total: str, left: str, key: str) -> str:
    """SQL for how many of each source's count are dealt to the left half, which takes ``left`` of all ``total``; ``key`` is of SQL."""
    drawn = hypergeometric("a.total", "x.c", "a.room", f"shiftrightunsigned(xxhash64({key}, x.i), 11) / {1 << 53}D")
    step = f"transform(array({drawn}), k -> named_struct('total', a.total - x.c, 'room', a.room - k, 'out', concat(a.out, array(k))))[0]"
    items = f"transform({counts}, (c, i) -> named_struct('c', c, 'i', i))"
    start = f"named_struct('total', {total}, 'room', {left}, 'out', cast(array() as array<bigint>))"
    return f"aggregate({items}, {start}, (a, x) -> {step}, a -> a.out)"


def quotas(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """(s, shard, quota): how many of each source's ``draws`` blocks (s, draws) each shard takes, from the splitting tree."""
    one = draws.agg(F.array_sort(F.collect_list(F.struct("s", "draws"))).alias("each"))
    start = ["0 lo", f"{shards} hi", "transform(each, x -> x.draws) counts", "transform(each, x -> x.s) sources", "aggregate(each, 0L, (a, x) -> a + x.draws) all"]
    nodes = one.selectExpr(*start)

    def edge(shard: str) -> str:
        return f"({shard} * all div {shards})"

    for _ in range(max(shards - 1, 0).bit_length()):
        middle = nodes.selectExpr("*", "cast((lo + hi) div 2 as int) mid")
        at = middle.selectExpr("*", split("counts", f"{edge('hi')} - {edge('lo')}", f"{edge('mid')} - {edge('lo')}", f"{seed}, lo, hi") + " left")
        halves = "array(named_struct('lo', lo, 'hi', mid, 'counts', left), named_struct('lo', mid, 'hi', hi, 'counts', zip_with(counts, left, (c, k) -> c - k)))"
        parts = at.selectExpr(f"explode(if(hi - lo > 1, {halves}, array(named_struct('lo', lo, 'hi', hi, 'counts', counts)))) x", "sources", "all")
        nodes = parts.selectExpr("x.lo", "x.hi", "x.counts", "sources", "all")
    pairs = nodes.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    return pairs.select(F.col("x.sources").alias("s"), "shard", F.col("x.counts").alias("quota"))


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(s, source, source_size, target) of each source of ``sizes`` (source, source_size); s is its place, from 0."""
    everything = Window.partitionBy()
    by_name = sizes.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    cycle = F.array(*[long(w) for w in weights])
    weighed = by_name.withColumn("weight", F.get(cycle, F.pmod("s", F.lit(len(weights))))).withColumn("limit", F.col("source_size") * most)
    order = Window.orderBy(F.col("limit") / F.col("weight"), "s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = weighed.withColumn("words", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), long(0)))
    sums = sums.withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), long(0)))
    # in this order the sources that stop at their limit come first; the first one that does not sets the level of all after it
    stops = F.col("limit").cast("double") * F.col("weights") <= F.col("words").cast("double") * F.col("weight")
    level = F.first(F.when(~stops, F.struct("words", "weights")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shared = sums.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("limit").cast("double")).otherwise((F.col("weight") * F.col("level.words")).cast("double") / F.col("level.weights"))
    return shared.select("s", "source", "source_size", target.alias("target"))


def blocks_of(sources: DataFrame, shards: int, blocks: int, most: int, seed: int) -> DataFrame:
    """(s, block, draws array<struct<shard, epoch, words>>, block_words): every block of each source and who draws it."""
    total = F.sum("source_size").over(Window.partitionBy())
    sized = sources.withColumn("block_words", F.greatest(long(LEAST_WORDS), F.floor((total + long(shards * blocks - 1)) / long(shards * blocks)).cast("long")))
    take = F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size") * most)
    sized = sized.withColumn("epochs", F.floor(F.try_divide(take, F.col("source_size"))).cast("int")).where("source_size > 0")
    sized = sized.withColumn("rest", take - F.col("epochs") * F.col("source_size"))
    cut = sized.withColumn("block", F.explode(F.sequence(long(0), F.floor((F.col("source_size") - 1) / F.col("block_words")))))
    cut = cut.withColumn("words", F.least("block_words", F.col("source_size") - F.col("block") * F.col("block_words")))
    cut = cut.withColumn("place", F.md5(F.concat_ws(":", F.lit(seed), "s", "block").cast("binary")))
    permuted = Window.partitionBy("s").orderBy("place", "block")
    before = F.coalesce(F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), long(0))
    cut = cut.withColumn("part", F.greatest(long(0), F.least("words", F.col("rest") - before)))
    passes = F.transform(F.sequence(F.lit(0), F.col("epochs")), lambda e: F.struct(e.alias("epoch"), F.when(e < F.col("epochs"), F.col("words")).otherwise(F.col("part")).alias("words")))
    drawn = cut.select("s", "block", "place", F.explode(F.filter(passes, lambda x: x["words"] > 0)).alias("x"))
    drawn = drawn.select("s", "block", "x.epoch", "x.words", (F.row_number().over(Window.partitionBy("s").orderBy("x.epoch", "place", "block")) - 1).alias("at"))
    share = quotas(drawn.groupBy("s").agg(F.count(F.lit(1)).alias("draws")), shards, seed).where("quota > 0")
    ends = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = share.withColumn("at", F.coalesce(F.sum("quota").over(ends), long(0))).select("s", "at", F.lit(0).alias("kind"), "shard")
    # each draw goes to the last shard that starts at or before it
    both = drawn.withColumn("kind", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    shard = F.last("shard", ignorenulls=True).over(Window.partitionBy("s").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    dealt = both.withColumn("shard", shard).where("kind = 1").groupBy("s", "block").agg(F.array_sort(F.collect_list(F.struct("shard", "epoch", "words"))).alias("draws"))
    nobody = F.array().cast("array<struct<shard:int,epoch:int,words:bigint>>")
    return cut.select("s", "block", "block_words").join(dealt, ["s", "block"], "left").withColumn("draws", F.coalesce("draws", nobody))


def plan(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED,
    key: str = "doc_id", source: str = "source", text: str = "text", broadcast_entries: int = BROADCAST_ENTRIES,
) -> DataFrame:
    """One row per document: doc_id, source, content (its text's md5), size, source_size, target and ``pieces``.

    ``pieces`` says which words of the document go to which shard: structs of shard, epoch (the pass over the source), first
    (word, from 0) and words. Sources are taken by code point, null last, and weigh ``weights``, repeating. A null or empty
    text, or one without words, has size 0 and no pieces; without any words all targets are 0. A null id counts as an empty
    one. Rows that repeat an id or a whole row stand in the stream on their own and are taken on their own; of equal rows any
    may get any of their pieces. Other columns are ignored, whatever they are called; an empty table gives an empty one. The
    same rows give the same mix, however they are stored.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    content = F.md5(F.coalesce(docs[text], F.lit("")).cast("binary"))
    place = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(docs[key].cast("string"), F.lit("")), content).cast("binary"))
    sized = docs.select(docs[key].alias("doc_id"), docs[source].alias("source"), words_in(docs[text]).alias("size"), content.alias("content"), place.alias("place"))
    rows = scratch.keep(sized.groupBy("doc_id", "source", "size", "content", "place").agg(F.count(F.lit(1)).alias("copies")), "rows")
    words = F.col("size") * F.col("copies")
    cell = F.substring("place", 1, CELL_DIGITS)
    cells = scratch.keep(rows.groupBy("source", cell.alias("cell")).agg(F.sum(words).alias("words")), "cells")
    sources = scratch.keep(targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most), "sources")
    drawn = scratch.keep(blocks_of(sources, shards, blocks, most, seed), "blocks")

    in_order = F.array_sort(F.collect_list(F.struct("block", "draws")))
    dealt = drawn.groupBy("s").agg(F.transform(in_order, lambda x: x["draws"]).alias("drawn"), F.max("block_words").alias("block_words"))
    known = scratch.keep(sources.join(dealt, "s", "left").select(F.col("source").alias("_source"), "source_size", "target", "drawn", "block_words"), "known")
    # a block is drawn most times at most, and each source has one block more than its share
    entries = (shards * blocks + sources.count()) * (most + 1)

    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(F.col("source").alias("_in"), F.col("cell").alias("_cell"), F.coalesce(F.sum("words").over(before), long(0)).alias("offset"))
    placed = rows.withColumn("cell", cell).join(offsets, F.col("source").eqNullSafe(F.col("_in")) & (F.col("cell") == F.col("_cell")))
    inside = Window.partitionBy("_in", "_cell").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.col("offset") + F.coalesce(F.sum(words).over(inside), long(0)))
    runs = placed.withColumn("run", F.explode(F.sequence(long(0), F.floor((F.col("copies") - 1) / RUN))))
    each = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN, F.least("copies", (F.col("run") + 1) * RUN) - 1)))
    each = each.select("doc_id", "source", "content", "size", (F.col("start") + F.col("copy") * F.col("size")).alias("start"))
    known = F.broadcast(known) if entries <= broadcast_entries else known
    met = each.join(known, F.col("source").eqNullSafe(F.col("_source")))

    start, end, width = F.col("start"), F.col("start") + F.col("size"), F.col("block_words")
    first = F.floor(start / width).cast("long")
    last = F.floor((end - 1) / width).cast("long")

    def of_block(draws: Column, i: Column) -> Column:
        begins = (first + i) * width
        made = F.transform(
            draws,
            lambda d: F.struct(d["shard"].alias("shard"), d["epoch"].alias("epoch"), (F.greatest(begins, start) - start).alias("first"), (F.least(end, begins + d["words"]) - F.greatest(begins, start)).alias("words")),
        )
        return F.filter(made, lambda p: p["words"] > 0)

    pieces = F.flatten(F.transform(F.slice("drawn", (first + 1).cast("int"), (last - first + 1).cast("int")), of_block))
    pieces = F.when(F.col("size") > 0, pieces).otherwise(F.array().cast(f"array<{PIECE}>"))
    scratch.drop(sources, drawn)
    return met.select("doc_id", "source", "content", "size", "source_size", "target", pieces.alias("pieces"))


def mixed(docs: DataFrame, planned: DataFrame, seed: int = SEED, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: shard, place, doc_id, epoch, first, words, text; one row per piece.

    ``place`` orders a shard's pieces. A document that is taken whole has its text as it is; of one that is cut at a block's
    border the words are joined by one space. Equal rows of ``docs`` are one text here.
    """
    content = F.md5(F.coalesce(docs[text], F.lit("")).cast("binary"))
    texts = docs.select(docs[key].alias("_id"), docs[source].alias("_of"), content.alias("_content"), docs[text].alias("text")).dropDuplicates(["_id", "_of", "_content"])
    pieces = planned.select("doc_id", "source", "content", "size", F.posexplode("pieces").alias("n", "piece"))
    met = pieces.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_of")) & (F.col("content") == F.col("_content")))
    split_words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(split_words, (F.col("piece.first") + 1).cast("int"), F.col("piece.words").cast("int")), " ")
    body = F.when(F.col("piece.words") == F.col("size"), F.col("text")).otherwise(cut)
    place = F.xxhash64(F.lit(seed), "piece.shard", "piece.epoch", "doc_id", "content", "piece.first")
    return met.select("piece.shard", place.alias("place"), "doc_id", "piece.epoch", "piece.first", "piece.words", body.alias("text"))


def write_shards(mix: DataFrame, path: str) -> None:
    """Writes a folder for each shard, its pieces in the order of ``place``; a shard is dealt over as many tasks as it needs."""
    mix.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The query's rows: how many of each document's words the shards' pieces take."""
    taken = F.aggregate("pieces", long(0), lambda a, p: a + p["words"])
    return plan(docs).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


#: Independent of the tree: what is taken does not depend on the shard that takes it.
ORACLE = r"""
with doc as (
  select doc_id, source, md5(coalesce(text, '')) content,
    cast(len(list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '')) as bigint) size from documents),
placed as (
  select *, coalesce(sum(size) over (partition by source order by md5(concat_ws(':', '13', coalesce(cast(doc_id as varchar), ''), content)), doc_id, size
    rows between unbounded preceding and 1 preceding), 0) start from doc),
named as (
  select source, sum(size) n, 3 * sum(size) most, (row_number() over (order by source nulls last) - 1) s, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] w
  from doc group by source),
-- a source stops at its limit if the level of all those that reach theirs no sooner lies above it
level as (
  select a.s, any_value(a.source) source, any_value(a.n) n, any_value(a.w) w, any_value(a.most) most,
    (select sum(n) from named) - coalesce(sum(b.most) filter (b.most * a.w < a.most * b.w or b.most * a.w = a.most * b.w and b.s < a.s), 0) rest,
    coalesce(sum(b.w) filter (not (b.most * a.w < a.most * b.w or b.most * a.w = a.most * b.w and b.s < a.s)), 0) weights
  from named a, named b group by a.s),
stop as (select *, most * weights <= rest * w stops from level),
free as (select (select sum(n) from named) - coalesce(sum(most) filter (stops), 0) rest, sum(w) filter (not stops) weights from stop),
goal as (
  select s, source, cast(n as bigint) n, case when stops then cast(most as double) else cast(w * free.rest as double) / free.weights end target,
    greatest(1024, ((select sum(n) from named) + 4095) // 4096) width
  from stop, free),
take as (select *, least(cast(floor(target + 0.5) as bigint), 3 * n) words from goal where n > 0),
block as (
  select s, source, n, width, words // n epochs, words % n rest, unnest(range(0, cast((n - 1) // width + 1 as bigint))) b from take),
part as (
  select *, least(width, n - b * width) size,
    coalesce(sum(least(width, n - b * width)) over (partition by s order by md5(concat_ws(':', '13', s, b)), b rows between unbounded preceding and 1 preceding), 0) before from block),
drawn as (
  select *, greatest(0, least(size, rest - before)) part from part),
summed as (select *, coalesce(sum(part) over (partition by s order by b rows between unbounded preceding and 1 preceding), 0) below from drawn)
select p.doc_id, p.size, g.n source_size, g.target,
  cast(coalesce(x.epochs * p.size + y.below + least(p.start + p.size - y.b * y.width, y.part) - x.below - least(p.start - x.b * x.width, x.part), 0) as bigint) taken
from placed p join goal g on p.source is not distinct from g.source
left join summed x on p.size > 0 and x.s = g.s and x.b = p.start // x.width
left join summed y on p.size > 0 and y.s = g.s and y.b = (p.start + p.size - 1) // y.width
"""
