"""Streaming jobs run to the end of their input and compared with the batch results."""

import os

from pyspark.sql import functions as F

from linkrisk.functions import urls
from linkrisk.functions.shared import Scratch, shared_dir, written
from linkrisk.streaming import jobs


def test_requests_are_scored_once(spark, tmp_path):
    rows = [(str(i), f"https://h{i}.com/a/../b") for i in range(20)]
    df = spark.createDataFrame(rows, "analysis_id string, url string")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    score = lambda batch: urls.normalised(batch).select("analysis_id", "norm.normalized_url")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        jobs.score_stream(stream, score, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("analysis_id", "normalized_url").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, score(df).collect()))


def test_batches_leave_no_table(spark, tmp_path):
    """Scoring writes tables of its own; after ten batches the shared folder holds what it held before."""
    df = spark.createDataFrame([(str(i), f"https://h{i}.com/a") for i in range(10)], "analysis_id string, url string")
    for i in range(10):
        df.where(f"analysis_id = '{i}'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    folder = shared_dir(spark)
    before = set(os.listdir(folder))

    def score(batch):
        first = written(urls.normalised(batch).select("analysis_id", "norm.normalized_url"), "first")
        scratch = Scratch(spark, "second")
        return scratch.keep(first.withColumn("n", F.length("normalized_url")), "second")

    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.score_stream(stream, score, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10
    assert set(os.listdir(folder)) == before


def test_a_lost_step_sends_nothing_again(spark, tmp_path):
    """Each row is sent once a try, however often what was sent is read afterwards."""
    sent = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            sent.add(len(batch))
            yield batch

    rows = spark.createDataFrame([(i,) for i in range(30)], "id int")
    send = lambda df: df.mapInPandas(count, df.schema).withColumn("delivered", F.col("id") % 3 > 0)
    jobs.deliver(rows, send, f"{tmp_path}/out", f"{tmp_path}/dead", 1)
    assert sent.value == 30 + 10 + 10 and spark.read.parquet(f"{tmp_path}/dead").count() == 10


def test_feed_files_are_upserted_in_order(spark, tmp_path):
    os.makedirs(f"{tmp_path}/landing")
    line = '"{}","2024-01-01 00:00:00","{}","{}","","malware","","l","r"\n'
    with open(f"{tmp_path}/landing/1.csv", "w") as f:
        f.write("# head\n" + line.format(1, "http://a.com/x", "online") + line.format(2, "http://b.com/", "online") + '"3","x"\n')
    run = lambda: jobs.refresh_stream(spark, f"{tmp_path}/landing", f"{tmp_path}/snap", f"{tmp_path}/stats", f"{tmp_path}/check").awaitTermination()
    run()
    with open(f"{tmp_path}/landing/2.csv", "w") as f:
        f.write(line.format(1, "http://a.com/x", "offline") + line.format(4, "http://c.com/", "online"))
    run()
    version, snapshot = jobs.current_version(spark, f"{tmp_path}/snap")
    assert version == 1 and {(r.id, r.url_status) for r in snapshot.collect()} == {(1, "offline"), (2, "online"), (4, "online")}
    stats = {r.batch: (r.inserted, r.updated, r.total, r.failed) for r in spark.read.parquet(f"{tmp_path}/stats").collect()}
    assert stats == {0: (2, 0, 3, 1), 1: (1, 1, 2, 0)}


def test_a_domain_is_looked_up_once(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "https://a.com/1"), ("2024-01-02 00:00:00", "https://www.a.com/2"), ("2024-01-02 00:00:00", "https://b.co.uk/")]
    df = spark.createDataFrame(rows, "ts string, url string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    stream = jobs.lookups(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("memory").queryName("looked_up").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.domain for r in spark.table("looked_up").collect()) == ["a.com", "b.co.uk"]


def test_delivery_and_dead_letters(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    send = lambda df: df.withColumn("delivered", F.col("id") < 3)
    for _ in range(2):
        jobs.deliver(rows, send, f"{tmp_path}/out", f"{tmp_path}/dead", 7)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/dead").collect()] == [3]
