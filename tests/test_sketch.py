"""Bloom filter: nothing listed is lost, little else passes, and nothing is shuffled for it."""

from pyspark.sql import functions as F

from linkrisk.operators import sketch, threat

LIST = "id long, url string, match_key string, threat string, tags string, urlhaus_link string"


def of(df, *columns):
    return {c: F.col(c) for c in columns}


def test_no_key_is_lost_and_few_others_pass(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("a"), F.concat(F.lit("m"), F.col("id") % 50).alias("b"))
    found = sketch.build(keys, of(keys, "a", "b"))
    rows = spark.range(200_000).select(F.concat(F.lit("k"), "id").alias("a"), F.lit(None).cast("string").alias("b"), "id")
    kept = sketch.may_hold(rows, of(rows, "a", "b"), found)
    assert kept.columns == rows.columns and kept.where("id < 20000").count() == 20_000
    assert kept.where("id >= 20000").count() < 180_000 * 0.02
    # a key of one kind is none of the other
    crossed = spark.range(20_000).select(F.lit(None).cast("string").alias("a"), F.concat(F.lit("k"), "id").alias("b"))
    assert sketch.may_hold(crossed, of(crossed, "a", "b"), found).count() < 20_000 * 0.02


def test_the_probe_shuffles_nothing(spark):
    keys = spark.range(100).select(F.col("id").cast("string").alias("a"))
    found = sketch.build(keys, of(keys, "a"))
    rows = spark.range(1000).select(F.col("id").cast("string").alias("a"))
    plan = sketch.may_hold(rows, of(rows, "a"), found)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_odd_tables(spark):
    rows = spark.createDataFrame([("x", 1), ("x", 1), (None, 2), ("", 3)], "a string, n int")
    none = sketch.build(rows.limit(0), of(rows, "a"))
    assert sketch.may_hold(rows, of(rows, "a"), none).count() == 0
    assert sketch.build(rows, of(rows, "a"), most_words=0) is None and sketch.may_hold(rows, of(rows, "a"), None).count() == 4
    own = sketch.may_hold(rows, of(rows, "a"), sketch.build(rows, of(rows, "a")))
    assert sorted(own.collect()) == [("", 3), ("x", 1), ("x", 1)]


def test_hits_with_and_without_filter(spark):
    entry = spark.range(300).selectExpr("id", "concat('http://h', id % 100, '.com/p', id, if(id % 3 = 0, '/', '')) url", "concat('h', id % 100, '.com') match_key", "concat('t', id) threat", "'a,b' tags", "'l' urlhaus_link")
    snap = spark.createDataFrame(entry.collect(), LIST)
    asked = spark.range(6000).selectExpr("concat(if(id % 2 = 0, 'http', 'https'), '://h', id % 900, '.com/p', id % 333, if(id % 5 = 0, '/', '')) url").unionByName(spark.createDataFrame([(None,), ("",), ("no url",)], "url string"))
    plain = sorted(map(tuple, threat.hits(asked, snap, filtered=False).collect()))
    assert len(plain) > 500 and {r[1] for r in plain} == {"url", "host"}
    assert sorted(map(tuple, threat.hits(asked, snap).collect())) == plain
    every = threat.lookup(asked, snap)
    assert every.count() == asked.where("url is not null").distinct().count() and every.where("is_threat").count() == len(plain)
    assert threat.hits(asked, snap.limit(0)).count() == 0
