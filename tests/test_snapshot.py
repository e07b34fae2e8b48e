"""The bucketed snapshot against the upsert of a whole one; what a batch writes, what readers see, and what a failed batch leaves."""

import os
import random

import pytest
from pyspark.sql import functions as F

from linkrisk.operators import threat
from linkrisk.sources.feed import parse_feed
from linkrisk.sources.snapshot import BucketedSnapshot, refresh_buckets
from linkrisk.streaming.jobs import SNAPSHOT


def line(i, url, threat_name="malware"):
    return f'"{i}","2024-01-01 00:00:00","{url}","online","","{threat_name}","","l","r"'


def feed(spark, lines):
    return parse_feed(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string"))


def rows(df):
    return sorted((r.id, r.url, r.threat) for r in df.collect())


def test_versions_equal_whole_upserts(spark, tmp_path):
    rng = random.Random(0)
    snapshot, whole = BucketedSnapshot(spark, f"{tmp_path}/s", 8), spark.createDataFrame([], SNAPSHOT)
    seen = []
    for n in range(3):
        # ids that come again, URLs that move to other ids, bad rows
        batch = feed(spark, [line(rng.randint(1, 40), f"http://h{rng.randint(1, 30)}.com/x", f"t{n}") for _ in range(25)] + ['"9","x"', line("no", "http://a.com/")])
        counts = snapshot.apply(batch, n)
        new, wanted = threat.upsert(whole, batch)
        whole = spark.createDataFrame(new.collect(), SNAPSHOT)
        assert counts.collect() == wanted.collect() and rows(snapshot.read()) == rows(whole)
        seen.append(rows(whole))
    assert snapshot.versions() == [0, 1, 2] and [rows(snapshot.read(v)) for v in range(3)] == seen
    # made again from the version before it
    assert snapshot.apply(batch, 2).first().updated == counts.first().updated and rows(snapshot.read()) == seen[-1]
    snapshot.drop_old(1)
    assert snapshot.versions() == [2] and rows(snapshot.read()) == seen[-1]


def test_a_batch_writes_its_buckets_only_and_a_failed_one_no_version(spark, tmp_path, monkeypatch):
    snapshot = BucketedSnapshot(spark, f"{tmp_path}/s")
    snapshot.apply(feed(spark, [line(i, f"http://h{i}.com/") for i in range(500)]), 0)
    first = snapshot.folders(0)
    assert len(first) == 64
    reader = snapshot.read()
    before = rows(reader)
    numbers = {r.id: r.b for r in spark.range(500).withColumn("b", snapshot.bucket(F.col("id"))).collect()}
    one = 7
    other = next(i for i in range(500) if numbers[i] != numbers[one])
    snapshot.apply(feed(spark, [line(one, "http://new.com/", "a"), line(other, f"http://h{other}.com/", "b")]), 1)
    second = snapshot.folders(1)
    assert {b for b in second if second[b] != first[b]} == {numbers[one], numbers[other]}
    folder = os.path.dirname(second[numbers[one]])
    assert len([d for d in os.listdir(f"{tmp_path}/s/{folder}") if d.startswith("bucket=")]) == 2
    # who reads the first version still does
    assert rows(reader) == before
    monkeypatch.setattr(BucketedSnapshot, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        snapshot.apply(feed(spark, [line(one, "http://newer.com/", "c")]), 2)
    assert snapshot.versions() == [0, 1] and (one, "http://new.com/", "a") in rows(snapshot.read())


def test_stream_of_feed_files(spark, tmp_path):
    os.makedirs(f"{tmp_path}/landing")
    run = lambda: refresh_buckets(spark, f"{tmp_path}/landing", f"{tmp_path}/s", f"{tmp_path}/stats", f"{tmp_path}/check", 4).awaitTermination()
    for n, lines in enumerate([[line(1, "http://a.com/x"), line(2, "http://b.com/"), '"3","x"'], [line(1, "http://a.com/x", "worse"), line(4, "http://b.com/")]]):
        with open(f"{tmp_path}/landing/{n}.csv", "w") as f:
            f.write("# head\n" + "\n".join(lines) + "\n")
        run()
    assert rows(BucketedSnapshot(spark, f"{tmp_path}/s", 4).read()) == [(1, "http://a.com/x", "worse"), (4, "http://b.com/", "malware")]
    stats = {r.batch: (r.inserted, r.updated, r.total, r.failed) for r in spark.read.parquet(f"{tmp_path}/stats").collect()}
    assert stats == {0: (2, 0, 3, 1), 1: (1, 1, 2, 0)}
