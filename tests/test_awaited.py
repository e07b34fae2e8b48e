"""Requests that wait for captures: the stream gives what the tables give, whatever the order, and degraded rows for what is absent."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkrisk.operators import domain
from linkrisk.streaming import awaited

REQUEST = "analysis_id string, url string, ts timestamp"
HOP = "url string, status_code int, raw_location string, error string, ts timestamp"
PAGE = "url string, status_code int, content_type string, content_length bigint, html string, error string, ts timestamp"
START = datetime(2024, 1, 1)
FORM = "<title>NAVER</title><form action='https://c.test/x'><input type=password></form>"


def at(minutes):
    return START + timedelta(minutes=minutes)


def page(url, minutes, html=FORM, status=200, error=None):
    return url, status, "text/html", None, html, error, at(minutes)


REQUESTS = [
    ("both", "https://a.com/", at(0)), ("twice", "https://a.com/", at(1)), ("hopped", "https://b.com/x", at(0)), ("no page", "https://c.com/", at(0)), ("no hop", "https://d.com/", at(0)),
    ("nothing", "https://e.com/", at(0)), ("too late", "https://f.com/", at(0)), ("too early", "https://g.com/", at(5)), ("gone", "https://h.com/", at(0)), ("none", None, at(0)),
]
HOPS = [
    ("https://a.com/", 200, None, None, at(2)), ("https://b.com/x", 302, "/y", None, at(1)), ("https://c.com/", 200, None, None, at(1)), ("https://f.com/", 200, None, None, at(30)),
    ("https://g.com/", 200, None, None, at(1)), ("https://h.com/", None, None, "timeout", at(1)), (None, 200, None, None, at(1)),
]
PAGES = [page("https://a.com/", 3), page("https://b.com/y", 4, "<title>plain</title>"), page("https://d.com/", 2), page("https://f.com/", 40), page("https://g.com/", 2), page("https://h.com/", 2, None, 404)]
#: What carries the watermarks on, so that what still waits is let go.
TIDE = ([("tide", "https://tide.com/", at(1000))], [("https://tide.com/", 200, None, None, at(1000))], [page("https://tide.com/", 1000)])


def result(rows):
    return sorted((r.analysis_id, r.final_url, r.hop_status, r.hop_error, r.status_code, r.fetch_error, r.html) for r in rows.collect() if r.analysis_id != "tide")


def tables(spark):
    return [spark.createDataFrame(rows, schema) for rows, schema in ((REQUESTS, REQUEST), (HOPS, HOP), (PAGES, PAGE))]


def test_batch_result(spark):
    got = {r[0]: r[1:] for r in result(awaited.classified(awaited.with_captures(*tables(spark))))}
    assert len(got) == len(REQUESTS)
    assert got["both"] == got["twice"] == ("https://a.com/", 200, None, 200, None, FORM)
    assert got["hopped"][0] == "https://b.com/y" and got["hopped"][4] is None
    assert got["no page"][1:] == (200, None, None, awaited.LATE, None) and got["no hop"][1:] == (None, awaited.LATE, 200, None, FORM)
    for name in ("nothing", "too late", "too early", "none"):
        assert got[name][1:] == (None, awaited.LATE, None, awaited.LATE, None)
    assert got["gone"][1:] == (None, "timeout", 404, "http_error_404", None)


@pytest.fixture(autouse=True)
def few_parts(spark):
    """Each part of a join keeps four state stores."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def started(spark, folder, steps, sink):
    """Runs ``sink`` over the three streams once for each step of {side: rows}, each run from the checkpoint of the one before."""
    schemas = {"requests": REQUEST, "hops": HOP, "pages": PAGE}
    for i, step in enumerate([{"requests": [], "hops": [], "pages": []}, *steps]):
        for side, rows in step.items():
            spark.createDataFrame(rows, schemas[side]).coalesce(1).write.parquet(f"{folder}/{side}/{i}")
        if i:
            sink(*[spark.readStream.schema(schema).parquet(f"{folder}/{side}/*") for side, schema in schemas.items()]).awaitTermination()


def streamed(spark, folder, steps):
    """What the stream gives over the steps and, at last, the tide."""

    def sink(*sides):
        rows = awaited.classified(awaited.with_captures(*sides))
        return rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start(f"{folder}/out")

    started(spark, folder, [*steps, {"requests": TIDE[0], "hops": TIDE[1], "pages": TIDE[2]}], sink)
    return result(spark.read.parquet(f"{folder}/out"))


def test_stream_equals_batch_out_of_order(spark, tmp_path):
    wanted = result(awaited.classified(awaited.with_captures(*tables(spark))))
    mixed = [{"pages": PAGES[3:], "requests": REQUESTS[5:]}, {"hops": HOPS, "pages": PAGES[:3], "requests": REQUESTS[:5]}]
    assert sorted(streamed(spark, str(tmp_path), mixed), key=str) == sorted(wanted, key=str)


COLUMNS = ["analysis_id", "final_url", "fetch_error", "domain_score", "content_signals", "content_score", "score", "verdict"]


def test_verdicts_of_the_stream_and_degraded_rows(spark, tmp_path):
    brands = domain.brand_sets(domain.sample_brands(spark))
    wanted = awaited.scored(awaited.classified(awaited.with_captures(*tables(spark))), brands).select(*COLUMNS).collect()
    everything = [{"requests": REQUESTS + TIDE[0], "hops": HOPS + TIDE[1], "pages": PAGES + TIDE[2]}]
    started(spark, tmp_path, everything, lambda *sides: awaited.score_awaited(*sides, brands, f"{tmp_path}/out", f"{tmp_path}/check"))
    got = spark.read.parquet(f"{tmp_path}/out").where("analysis_id <> 'tide'").select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, wanted), key=str)
    by_id = {r.analysis_id: r for r in got}
    # the degraded row: no page, so no more points than a failed fetch has
    assert tuple(by_id["nothing"])[2:] == (awaited.LATE, 0, ["FETCH_FAILED"], 15, 15, "safe") and by_id["both"].verdict == "danger"


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    late = [{"requests": TIDE[0], "hops": TIDE[1], "pages": TIDE[2]}, {"requests": [("early", "https://a.com/", at(0)), ("tide", "https://t.com/", at(1001))]}]
    assert streamed(spark, str(tmp_path), late) == []


def test_null_tables(spark):
    none = [df.where(F.lit(False)) for df in tables(spark)]
    assert awaited.classified(awaited.with_captures(*none)).count() == 0
