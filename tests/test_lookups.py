"""Shared look-ups as a stream: what is asked, what waits, what is served, and what is given up."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkrisk.functions import urls
from linkrisk.operators import domain
from linkrisk.streaming import lookups

REQUEST = "analysis_id string, url string, ts timestamp"
ANSWER = "domain string, fetched_at timestamp, body string, error string"
START = datetime(2024, 1, 1)


def day(n):
    return START + timedelta(days=n)


@pytest.fixture
def stream(spark, tmp_path):
    """run(batches of (requests, answers)) -> the events of all batches; a batch is a file on each side."""
    lookups.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def run(*batches, **options):
        out = []
        for i, (requests, answers) in enumerate(batches):
            spark.createDataFrame(requests, REQUEST).coalesce(1).write.parquet(f"{tmp_path}/requests/{i}")
            spark.createDataFrame(answers, ANSWER).coalesce(1).write.parquet(f"{tmp_path}/answers/{i}")
            asked = spark.readStream.schema(REQUEST).parquet(f"{tmp_path}/requests/*")
            told = spark.readStream.schema(ANSWER).parquet(f"{tmp_path}/answers/*")
            events = lookups.shared_lookups(asked, told, **options)
            # each run goes on from the checkpoint of the one before
            query = events.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
            query.awaitTermination()
            rows = spark.read.schema(lookups.EVENTS).parquet(f"{tmp_path}/out").collect()
            out.append(sorted((r.kind, r.domain, r.analysis_id or "", r.body or "", r.error or "") for r in rows))
        return out

    yield run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def new(out, i):
    """The events that run i added."""
    before = list(out[i - 1]) if i else []
    rest = list(out[i])
    for e in before:
        rest.remove(e)
    return rest


def test_one_question_and_its_answer_for_all_that_wait(stream):
    out = stream(
        ([("1", "https://a.com/x", day(0)), ("2", "https://www.a.com/y", day(0)), ("3", "https://b.com/", day(0))], []),
        ([("4", "https://a.com/z", day(0.01))], []),
        ([], [("a.com", day(0.02), "A", None), ("b.com", day(0.02), None, "not_found")]),
        ([("5", "https://a.com/", day(3)), ("6", "https://b.com/", day(3))], []),
        ([("7", "https://a.com/", day(8))], []),
        patience=timedelta(days=1),
        late="30 days",
    )
    assert new(out, 0) == [("ask", "a.com", "", "", ""), ("ask", "b.com", "", "", "")]
    assert new(out, 1) == []
    assert new(out, 2) == [("answer", "a.com", "1", "A", ""), ("answer", "a.com", "2", "A", ""), ("answer", "a.com", "4", "A", ""), ("answer", "b.com", "3", "", "not_found")]
    # within the time to keep a good answer serves at once, an error does not
    assert new(out, 3) == [("answer", "a.com", "5", "A", ""), ("ask", "b.com", "", "", "")]
    assert new(out, 4) == [("ask", "a.com", "", "", "")]


def test_order_within_a_batch_does_not_matter_and_unanswered_requests_are_given_up(stream):
    out = stream(
        ([("1", "https://a.com/", day(0)), ("2", "https://a.com/", day(9)), ("3", "https://c.com/", day(0))], [("a.com", day(0.001), "A", None)]),
        ([("4", "https://d.com/", day(20))], []),
        ([("5", "https://d.com/", day(21)), ("late", "https://e.com/", day(1))], []),
        ([], []),
        patience=timedelta(hours=1),
        late="1 hour",
    )
    assert {("answer", "a.com", "1", "A", ""), ("ask", "a.com", "", "", ""), ("ask", "c.com", "", "", "")} <= set(new(out, 0))
    everything = out[-1]
    assert ("answer", "c.com", "3", "", lookups.GIVEN_UP) in everything and ("answer", "a.com", "2", "", lookups.GIVEN_UP) in everything
    # rows later than the watermark are dropped
    assert not [e for e in everything if e[1] == "e.com"]
    assert sum(e[:2] == ("ask", "d.com") for e in everything) == 2 and ("answer", "d.com", "4", "", lookups.GIVEN_UP) in everything


def test_questions_are_the_batch_jobs_domains_to_refresh(spark, stream):
    now = day(30)
    captures = [(f"d{i}.com", now - timedelta(days=i % 14, minutes=1), "B", None if i % 5 else "not_found") for i in range(40)]
    requests = [(str(i), f"https://x.d{i % 60}.com/{i}", now) for i in range(200)]
    wanted = spark.createDataFrame(requests, REQUEST).select(urls.registered_or_host(urls.host_of(F.col("url"))).alias("domain"))
    batch = domain.to_refresh(wanted, spark.createDataFrame(captures, ANSWER), F.lit(now))
    out = stream(([], captures), (requests, []), late="60 days")
    assert {e[1] for e in new(out, 1) if e[0] == "ask"} == {r.domain for r in batch.collect()}
    assert len([e for e in new(out, 1) if e[0] == "ask"]) == batch.count()
