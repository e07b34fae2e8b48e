"""Readers, result tables and IPv6 tests."""

import ipaddress

from pyspark.sql import functions as F

from linkrisk.operators import blocks, redirects, threat
from linkrisk.sources import captures
from linkrisk.sources.feed import parse_feed, read_feed
from linkrisk.streaming import jobs

LINE = '"{}","2024-01-01 00:00:00","{}","{}","","malware","","l","r"\n'


def test_feed_files_are_ordered_by_name_whatever_their_size(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text(LINE.format(1, "http://a.com/", "old"))
    (tmp_path / "in/b.csv").write_text("".join(LINE.format(i, f"http://b{i}.com/", "filler") for i in range(5, 3000)) + LINE.format(1, "http://a.com/", "new") + LINE.format(1, "http://a.com/", "newest"))
    rows = threat.latest(threat.entries(read_feed(spark, f"{tmp_path}/in")).where("not failed"))
    assert [r.url_status for r in rows.where("id = 1").collect()] == ["newest"]


def test_feed_lines(spark):
    lines = ["1,a,http://x.com/,on,b,c,d,e,", "1,a", '2,"a,""b",http://y.com/,on,b,c,d,e,f,g,h', "", "#x"]
    rows = parse_feed(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")).orderBy("line_no").collect()
    assert [(r.id, r.dateadded, r.reporter, r.short) for r in rows] == [("1", "a", "", False), ("1", "a", None, True), ("2", 'a,"b', "f", False)]


def test_ipv6_addresses(spark):
    texts = ["::1", "fe80::1", "fc00::1", "2001:db8::1", "2606:4700::1111", "::ffff:10.0.0.1", "ff02::1", "64:ff9b::808:808", "nope:", "[::1]", "fe80::1%eth0", None]
    rows = blocks.with_kind(spark.createDataFrame([(t,) for t in texts], "a string"), "a", blocks.special_blocks(spark)).collect()
    assert {r.a for r in rows} == set(texts)
    for text, kind in rows:
        try:
            a = ipaddress.ip_address(text.strip("[]")) if text else None
        except ValueError:
            a = None
        assert kind == (None if a is None else "local" if not a.is_global else "multicast" if a.is_multicast else "global"), text


def test_hosts_of_both_address_kinds(spark):
    rows = [("dual", "93.184.216.34"), ("dual", "2606:4700::1"), ("inner", "93.184.216.34"), ("inner", "fd00::1"), ("old", "10.0.0.1"), ("odd", "x:y"), ("none", None), ("mapped", "::ffff:127.0.0.1")]
    got = dict(redirects.unsafe_hosts(spark.createDataFrame(rows, "host string, ip string")).collect())
    assert got == {"dual": False, "inner": True, "old": True, "odd": True, "none": True, "mapped": True}


def test_captures_and_results(spark, tmp_path):
    rows = [("https://a.com/", 200, f"<p>{i}</p>") for i in range(20)] + [("https://b.com/", 404, None)]
    df = spark.createDataFrame(rows, "url string, status_code int, html string")
    df.write.parquet(f"{tmp_path}/pages")
    read = captures.read_capture(spark, "pages", f"{tmp_path}/pages")
    assert read.columns == ["url", "status_code", "content_type", "content_length", "html", "error"] and read.where("error is null").count() == 21
    one = sorted(map(tuple, captures.newest(df, "url").collect()))
    assert len(one) == 2 and one == sorted(map(tuple, captures.newest(df.repartition(7).orderBy(F.desc("html")), "url").collect()))
    timed = df.withColumn("fetched_at", F.when(F.col("html") == "<p>7</p>", 9).otherwise(3))
    assert captures.newest(timed, "url").where("html is not null").first().html == "<p>7</p>"
    results = spark.createDataFrame([("1", "succeeded", "safe"), ("2", "failed", None)], "analysis_id string, status string, verdict string")
    for _ in range(2):  # a batch that is run again replaces its rows
        captures.write_verdicts(results, f"{tmp_path}/verdicts", "7")
        captures.write_callbacks(results, F.to_json(F.struct("analysis_id")), f"{tmp_path}/callbacks", "7")
    captures.write_verdicts(results, f"{tmp_path}/verdicts", "8")
    assert spark.read.parquet(f"{tmp_path}/verdicts").count() == 4 and spark.read.text(f"{tmp_path}/callbacks").count() == 2


def test_failed_feed_rows_are_put_aside(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing/1.csv").write_text(LINE.format(1, "http://a.com/x", "online") + '"3","x"\n' + LINE.format("x", "http://b.com/", "online"))
    jobs.refresh_stream(spark, f"{tmp_path}/landing", f"{tmp_path}/snap", f"{tmp_path}/stats", f"{tmp_path}/check").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/stats-rejected").collect()) == ["3", "x"]
