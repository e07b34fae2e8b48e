"""Operators on small tables: examples with known outcomes."""

from pyspark.sql import functions as F

from linkrisk.functions import html, urls
from linkrisk.functions.shared import written
from linkrisk.operators import content, domain, metrics, redirects, threat, verdict
from linkrisk.plans import catalog
from linkrisk.sources.feed import parse_feed


def brands(spark):
    return domain.brand_sets(domain.sample_brands(spark))


def signals(spark, *urls):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    return {r.url: (r.domain_signals, r.domain_score) for r in domain.score_domains(df, brands(spark)).collect()}


def test_domain_signals(spark):
    got = signals(
        spark,
        "http://192.168.0.1/login",
        "https://naver.com/",
        "https://naverr.com/",
        "https://naver.net/",
        "https://naver.xyz/",
        "https://a.b.c.d.shop.com/",
        "https://secure-login-my-bank.com/",
        "https://amazon-x.vercel.app/login",
        "https://x.com/go?url=https%3A%2F%2Fevil.test",
        "https://x.com/go?url=https://www.x.com/a",
        "https://x.com/go?next=/home",
        "https://user@x.com/",
        "https://bit.ly/x",
        "https://vercel.app/",
    )
    assert got["http://192.168.0.1/login"] == (["IP_DIRECT"], 40)
    assert got["https://naver.com/"] == ([], 0)
    assert got["https://naverr.com/"][0] == ["BRAND_IN_URL", "TYPO_DOMAIN"]
    assert "TYPO_DOMAIN" not in got["https://naver.net/"][0]
    assert got["https://naver.xyz/"][0] == ["SUSPICIOUS_TLD", "TYPO_DOMAIN"]
    assert got["https://a.b.c.d.shop.com/"][0] == ["SUBDOMAIN_OVERUSE"]
    assert {"HYPHEN_OVERUSE", "SENSITIVE_PATH"} <= set(got["https://secure-login-my-bank.com/"][0])
    assert {"HOSTING_PLATFORM", "SENSITIVE_PATH", "BRAND_IN_URL", "FREE_HOSTING_LURE"} <= set(got["https://amazon-x.vercel.app/login"][0])
    assert got["https://amazon-x.vercel.app/login"][1] == 80
    assert "OPEN_REDIRECT_PARAM" in got["https://x.com/go?url=https%3A%2F%2Fevil.test"][0]
    assert "OPEN_REDIRECT_PARAM" not in got["https://x.com/go?url=https://www.x.com/a"][0]
    assert "OPEN_REDIRECT_PARAM" in got["https://x.com/go?next=/home"][0]
    assert "URL_USERINFO" in got["https://user@x.com/"][0]
    assert "URL_SHORTENER" in got["https://bit.ly/x"][0]
    assert "TYPO_DOMAIN" not in got["https://vercel.app/"][0]


def test_feed_and_upsert(spark):
    lines = [
        "# comment",
        "",
        '"1","2024-01-01 00:00:00","http://a.com/x","online","2024-01-02 00:00:00 UTC","malware","exe, emotet","l","r"',
        '"2","None","http://github.com/u/r/x","online","","malware","","l","r","more"',
        '"3","x","y"',
        '"z","None","http://b.com/","online","","m","","l","r"',
        '"4","None","http://github.com/only","online","","m","","l","r"',
        '"1","2024-01-03 00:00:00","http://a.com/x","offline","","malware","","l","r"',
    ]
    feed = parse_feed(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no long, value string"))
    rows = {r.line_no: r for r in threat.entries(feed).collect()}
    assert {k: r.failed for k, r in rows.items()} == {2: False, 3: False, 4: True, 5: True, 6: True, 7: False}
    assert rows[3].match_key == "github.com/u/r" and rows[2].date_added.year == 2024 and rows[3].date_added is None
    old = threat.entries(parse_feed(spark.createDataFrame([(0, '"2","None","http://github.com/u/r/x","online","","old","","l","r"')], "line_no long, value string"))).select(*threat.ENTRY)
    new, stats = threat.upsert(old, feed)
    assert {(r.id, r.url_status, r.threat) for r in new.collect()} == {(1, "offline", "malware"), (2, "online", "malware")}
    assert stats.first().asDict() == {"inserted": 1, "updated": 1, "total": 6, "failed": 3}
    again, stats = threat.upsert(new, feed)
    assert again.count() == 2 and stats.first().inserted == 0


def test_lookup(spark):
    rows = [(1, "http://a.com/x", "a.com", "t1"), (2, "https://b.com/", "b.com", "t2"), (3, "http://github.com/u/r/x", "github.com/u/r", "t3"), (4, "https://a.com/y//", "a.com", "t4")]
    snap = spark.createDataFrame([(i, u, k, t, "a, b,", "l") for i, u, k, t in rows], "id long, url string, match_key string, threat string, tags string, urlhaus_link string")
    asked = ["https://a.com/x/", "https://a.com/other", "https://github.com/u/r/y", "https://github.com/u/z/y", "https://b.com", "https://c.com/", "https://a.com/y//"]
    got = {r.url: (r.match_type, r.matched_key, r.threat) for r in threat.lookup(spark.createDataFrame([(u,) for u in asked], "url string"), snap).collect()}
    assert got["https://a.com/x/"] == ("url", "http://a.com/x", "t1")
    assert got["https://a.com/other"] == ("host", "a.com", "t4")
    assert got["https://github.com/u/r/y"] == ("host_path", "github.com/u/r", "t3")
    assert got["https://github.com/u/z/y"] == (None, None, None) and got["https://c.com/"] == (None, None, None)
    assert got["https://b.com"][0] == "url" and got["https://a.com/y//"] == ("url", "https://a.com/y//", "t4")


HOPS = "url string, method string, status_code int, raw_location string, content_type string, error string"


def test_redirects(spark):
    h = [
        ("https://a.com/", "HEAD", 301, "/b", None, None), ("https://a.com/b", "HEAD", 405, None, None, None), ("https://a.com/b", "GET", 302, "http://other.com/", None, None),
        ("http://other.com/", "HEAD", 200, None, "text/html", None), ("https://l.com/1", "HEAD", 302, "/2", None, None), ("https://l.com/2", "HEAD", 302, "/1", None, None),
        ("https://j.com/", "HEAD", 302, "javascript:x", None, None), ("https://e.com/", "HEAD", 503, None, None, None), ("https://t.com/", "GET", None, None, None, "timeout"),
        ("https://s.com/", "HEAD", 200, None, "text/html", None), ("https://n.com/", "HEAD", 302, None, None, None), ("https://n.com/", "GET", 302, None, None, None),
        *[(f"https://m.com/{i}", "HEAD", 302, f"/{i + 1}", None, None) for i in range(7)],
    ]
    hops = spark.createDataFrame(h, HOPS)
    asked = [("https://a.com/", False), ("https://l.com/1", False), ("https://j.com/", False), ("https://e.com/", False), ("https://t.com/", False), ("http://s.com/", True), ("https://m.com/0", False), ("http://10.0.0.1/", False), ("https://n.com/", False), ("https://none.com/", False)]
    starts = redirects.preferred(spark.createDataFrame(asked, "url string, scheme_was_added boolean"), hops)
    got = {r.start: r for r in redirects.unchain(starts, hops).collect()}
    a = got["https://a.com/"]
    assert a.final_url == "http://other.com/" and a.hop_count == 3 and [x.method for x in a.hops] == ["HEAD", "GET", "HEAD"]
    assert a.chain_signals == ["scheme_downgrade", "cross_origin:a.com->other.com"] and a.error is None
    assert got["https://l.com/1"].chain_signals == ["redirect_loop"] and got["https://l.com/1"].hop_count == 2
    assert got["https://j.com/"].error == "unsafe_redirect_scheme:javascript" and got["https://j.com/"].hops[0].location == "javascript:x"
    assert got["https://e.com/"].error == "server_error_503" and got["https://t.com/"].timed_out
    assert got["https://s.com/"].chain_signals == ["schemeless_https_upgrade"]
    assert got["https://m.com/0"].final_url == "https://m.com/5" and got["https://m.com/0"].chain_signals == ["max_hops_reached"]
    assert got["http://10.0.0.1/"].chain_signals == ["ssrf_blocked"] and got["https://n.com/"].error == "missing_location_header"
    assert got["https://none.com/"].error == "pipeline_timeout"


def test_locations_are_resolved_once_for_all_rounds(spark, monkeypatch):
    made = []
    resolve = redirects.urls.resolve
    monkeypatch.setattr(redirects.urls, "resolve", lambda *a: made.append(a) or resolve(*a))
    hops = spark.createDataFrame([("https://a.com/", "HEAD", 301, "/b/../c", None, None), ("https://a.com/c", "HEAD", 302, "//d.org/.x", None, None)], HOPS)
    got = redirects.unchain(spark.createDataFrame([("https://a.com/", False)], "start string, upgraded boolean"), hops).first()
    assert len(made) == 1  # a plan for each round would hold it again
    assert got.final_url == "https://d.org/.x" and got.chain_signals == ["cross_origin:a.com->d.org", "pipeline_timeout"]


def test_chains_normalise_each_url_once(spark, monkeypatch, tmp_path):
    pages = [(i, f"https://h{i % 2}.com/{i}", "") for i in range(1, 7)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    seen = {}

    def watched(df, name):
        out = written(df, name)
        seen[name] = df._jdf.queryExecution().optimizedPlan().toString().count("too_long"), out
        return out

    monkeypatch.setattr(catalog, "written", watched)
    rows = catalog.j15_https_upgrade(spark, str(tmp_path)).collect()
    asked = catalog.fixture(spark, str(tmp_path), "url_inputs").select("url").distinct().count()
    assert max(n for n, _ in seen.values()) == 2  # once for plain rows, once for others: no filter does it again
    assert seen["normal"][1].count() == asked < 24 * len(pages)
    assert len(rows) == seen["starts"][1].count() == len(set(rows))


PAGE = """<html><head><title> NAVER login </title><script>var a = "<input type=password>"</script></head><body><p>Hello   world<p>Again
<form action="https://collector.test/x"><label for=i>주민번호</label><input id=i name=rrn><label>Tel <input name=mobile></label><input type=PassWord name=pw><input type=submit value=Go></form>
<a href="/app.apk">get</a><a href="https://other.com/">out</a><a href="mailto:x@y">mail</a><img alt=" Naver "><img alt=""><meta http-equiv=Refresh content="0; URL='https://evil.test'"></body></html>"""


def test_page_features_and_score(spark):
    df = spark.createDataFrame([(1, "https://www.shop.com/a", PAGE), (2, "https://naver.com/", "<title>naver</title><input type=password>"), (3, "https://x.com/", '<div id="ROOT"></div>'), (4, "https://x.com/", None)], "i int, url string, html string")
    scored = content.score_features(html.features(df), brands(spark))
    got = {r.i: r for r in scored.collect()}
    f = got[1].features
    assert f.title == "NAVER login" and f.has_password_field and f.has_password_form_external_action
    assert f.has_meta_refresh and f.has_external_meta_refresh and abs(f.external_link_ratio - 0.5) < 1e-9
    assert f.image_alts == ["Naver"] and f.download_links == ["https://www.shop.com/app.apk"] and f.cta_texts == ["Go", "get", "out", "mail"]
    assert f.form_field_summaries[:2] == ["label=주민번호 name=rrn id=i", "label=Tel name=mobile"] and f.sensitive_field_types == ["resident_registration_number", "phone"]
    assert f.body_text_snippets[:2] == ["Hello world", "Again"]
    assert got[1].content_signals[:2] == ["BRAND_IMPERSONATION_FORM", "CREDENTIAL_FORM_EXTERNAL"] and got[1].content_score == 100
    assert got[2].content_signals == [] and got[3].content_signals == ["SPA_SHELL"]
    assert got[4].features.title is None and got[4].features.external_link_ratio is None and got[4].content_score == 0


def test_metrics(spark):
    pairs = [("danger", "danger")] * 2 + [("danger", "caution")] + [("danger", "safe")] + [("safe", "danger"), ("safe", "caution")] + [("safe", "safe")] * 2
    row = metrics.verdict_metrics(spark.createDataFrame(pairs, "expected string, predicted string"), ["danger"], ["danger", "caution"]).first()
    assert (row.accuracy, row.recall, row.precision, row.f1, row.false_positive_rate) == (0.5, 0.75, 0.6, 0.666667, 0.5)
    empty = metrics.verdict_metrics(spark.createDataFrame([], "expected string, predicted string"), ["danger"], ["danger"]).first()
    assert empty.total == 0 and empty.f1 == 0.0


def test_ai_answers(spark):
    cases = [
        ('{"verdict": "phishing", "reason": " x "}', ("phishing", "x")),
        ('{"verdict": "other", "verdict": "benign", "reason": 1, "reason": "last"}', ("benign", "last")),
        ('{"meta": {"reason": "x"}, "verdict": "benign", "reason": 5}', None),
        ('{"verdict": "benign", "reason": {"reason": "x"}}', None),
        ('{"verdict": ["benign"], "reason": "x"}', None),
        ('{"verdict": "benign", "reason": "x", "n": NaN}', ("benign", "x")),
        ('{"verdict": "benign", "reason": ""}', ("benign", "")),
        ('{"verdict": "benign", "reason": "%s"}' % ("y" * 150), ("benign", "y" * 100)),
        ('{"verdict": "benign", "reason": "x"} tail', None),
        ('{"verdict": "benign", "reason": "x"}, {"verdict": "benign", "reason": "x"}', None),
        ("{'verdict': 'benign', 'reason': 'x'}", None),
        *[(raw, None) for raw in ('{"verdict": "other", "reason": "x"}', '{"verdict": ', '{"verdict": "benign"}', None, "", "null", "5", '["x"]', '{"verdict": "benign", "reason": 5}', '{"verdict": "benign", "reason": null}')],
    ]
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(cases)], "i int, raw string").withColumn("a", content.ai_answer(F.col("raw")))
    assert [r.a and tuple(r.a) for r in df.orderBy("i").collect()] == [wanted for _, wanted in cases]


def test_verdicts(spark):
    requests = spark.createDataFrame([("1", "https://www.shop.com/a"), ("2", "  "), ("3", "https://listed.com/x"), ("4", "https://gone.com/"), ("5", "https://naver.com/")], "analysis_id string, url string")
    hops = spark.createDataFrame([(f"https://{h}", "HEAD", s, None, "text/html", None) for h, s in (("www.shop.com/a", 200), ("listed.com/x", 200), ("gone.com/", 404), ("naver.com/", 200))], HOPS)
    hops = hops.unionByName(spark.createDataFrame([("https://gone.com/", "GET", 404, None, None, None)], HOPS))
    pages = spark.createDataFrame([("https://www.shop.com/a", 200, "text/html", None, PAGE, None), ("https://naver.com/", 200, "text/html", None, "<title>naver</title>", None)], "url string, status_code int, content_type string, content_length bigint, html string, error string")
    snap = spark.createDataFrame([(1, "http://listed.com/x", "listed.com", "malware", "", "")], "id long, url string, match_key string, threat string, tags string, urlhaus_link string")
    got = {r.analysis_id: r for r in verdict.score_urls(requests, brands(spark), hops, pages, snap).collect()}
    assert (got["1"].verdict, got["1"].score, got["1"].status) == ("danger", 100, "succeeded")
    assert (got["2"].status, got["2"].failed_at_stage, got["2"].error) == ("failed", "normalize", "empty_url")
    assert (got["3"].verdict, got["3"].score, got["3"].content_signals, got["3"].threat_types) == ("danger", 100, ["SKIPPED_ALREADY_DANGER"], ["malware"])
    assert (got["4"].status, got["4"].failed_at_stage, got["4"].error_status) == ("failed", "unchain", 404)
    assert (got["5"].verdict, got["5"].score, got["5"].summary) == ("safe", 0, verdict.SAFE)
    assert [r.code for r in got["3"].reasons] == ["URLHAUS_MATCH"]


def test_verdict_stages_see_each_url_and_page_once(spark, monkeypatch):
    read, searched = [], []
    normalised, score_features = urls.normalised, content.score_features
    monkeypatch.setattr(urls, "normalised", lambda df, *a: (read.append(df.count()), normalised(df, *a))[1])
    monkeypatch.setattr(content, "score_features", lambda df, *a, **k: (searched.append(df.count()), score_features(df, *a, **k))[1])
    asked = ["https://a.com/", "https://a.com/", None, None, "https://b.com/", "  "]
    requests = spark.createDataFrame([(str(i), u) for i, u in enumerate(asked)], "analysis_id string, url string")
    hops = spark.createDataFrame([(f"https://{h}.com/", "HEAD", 200, None, "text/html", None) for h in "ab"], HOPS)
    pages = spark.createDataFrame([("https://a.com/", 200, "text/html", None, '<body><div id="root"></div></body>', None), ("https://b.com/", 200, "text/html", None, "<p>b</p>", None)], "url string, status_code int, content_type string, content_length bigint, html string, error string")
    rendered = spark.createDataFrame([(f"https://{h}.com/", "<title>naver</title><form><input type=password></form>", None) for h in "ab"], "url string, html string, error string")
    got = {r.analysis_id: r for r in verdict.score_urls(requests, brands(spark), hops, pages, rendered=rendered).collect()}
    assert [got[str(i)].status for i in range(6)] == ["succeeded", "succeeded", "failed", "failed", "succeeded", "failed"]
    assert got["0"].asDict() | {"analysis_id": "1"} == got["1"].asDict() and got["0"].rendered_used and not got["4"].rendered_used
    assert "RENDERED_DOM_ANALYZED" in got["0"].content_signals and "BRAND_IMPERSONATION_FORM" in got["0"].content_signals
    assert got["4"].content_signals == []
    # distinct URLs; both pages, and then only the one that a rendered form changes
    assert read == [4] and searched == [2, 1]


def test_safe_browsing_of_two_urls(spark):
    known = [("a", True, None, ["X"]), ("b", True, None, ["Y", "X"]), ("c", False, "late", None), ("d", False, "down", None), ("e", None, None, [])]
    captures = spark.createDataFrame(known, "url string, checked boolean, error string, types array<string>")
    captures = captures.withColumn("matches", F.transform("types", lambda t: F.struct(t.alias("threat_type")))).drop("types")
    pairs = [("a", "b"), ("b", "b"), ("c", "d"), ("e", "d"), ("z", "a"), (None, "b"), (None, None), ("a", "b")]
    rows = threat.safe_browsing(spark.createDataFrame(pairs, "final_url string, original_url string"), captures).collect()
    got = {(r.final_url, r.original_url): (r.gsb_checked, r.gsb_threat, r.gsb_types, r.gsb_error) for r in rows}
    assert len(rows) == 6 and got == {
        ("a", "b"): (True, True, ["X", "Y"], None),
        ("b", "b"): (True, True, ["Y", "X"], None),
        ("c", "d"): (False, False, [], "late"),
        ("e", "d"): (False, False, [], "down"),
        ("z", "a"): (True, True, ["X"], None),
        (None, "b"): (True, True, ["Y", "X"], None),
    }
