"""URL functions against examples and against the standard library."""

import random
from urllib.parse import parse_qsl, urljoin, urlparse

from pyspark.sql import functions as F

from linkrisk.functions import urls

EXAMPLES = {
    "  https://Example.COM/  ": "https://example.com/",
    "example.com": "http://example.com/",
    "HTTP://EXAMPLE.com:80/Path#frag": "http://example.com/Path",
    "https://example.com:443/a": "https://example.com/a",
    "https://example.com:8080/a": "https://example.com:8080/a",
    "https://example.com:/a": "https://example.com/a",
    "https://example.com:0/a": "https://example.com:0/a",
    "https://example.com:0080/a": "https://example.com:80/a",
    "https://google.com@evil.com/x": "https://evil.com/x",
    "https://a.com//b///c": "https://a.com/b/c",
    "https://a.com/a/b/..": "https://a.com/a",
    "https://a.com/a/.": "https://a.com/a",
    "https://a.com/..": "https://a.com/",
    "https://a.com/%2e%2e/x": "https://a.com/x",
    "https://a.com/%7Euser/%2fx%41?q=%61": "https://a.com/~user/%2FxA?q=a",
    "https://a.com/%2541": "https://a.com/%2541",
    "https://a.com/%%41%zz": "https://a.com/%A%zz",
    "https://a.com/p;%7eq?x=1#f": "https://a.com/p;~q?x=1",
    "https://a.com/\x00x\ny": "https://a.com/xy",
    "https://münchen.de/ü": "https://xn--mnchen-3ya.de/ü",
    "https://é.com/": "https://xn--9ca.com/",
    "example.com/path://weird": "http://example.com/path:/weird",
}
FAILURES = {
    "": "empty_url",
    "   ": "empty_url",
    None: "empty_url",
    "https://a.com/" + "x" * 1011: "too_long",
    "ftp2://a.com/": "bad_scheme",
    "javascript://a": "bad_scheme",
    "http://[::1]/x": "ipv6_host",
    "http://[::1/x": "unparsable",
    "http:///x": "empty_host",
    "http://a.com:99999/": "bad_port",
    "http://a.com:8x/": "bad_port",
    "mailto:x": "bad_port",
}


def columns(spark, rows, **made):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]))))
    return [tuple(r)[1:] for r in df.select("i", *[c.alias(n) for n, c in made.items()]).orderBy("i").collect()]


def test_normalise(spark):
    rows = [(u,) for u in [*EXAMPLES, *FAILURES]]
    df = urls.normalised(spark.createDataFrame(rows, "url string"))
    got = {r.url: r.norm for r in df.collect()}
    assert {u: got[u].normalized_url for u in EXAMPLES} == EXAMPLES
    assert {u: got[u].failure for u in FAILURES} == FAILURES
    assert all(got[u].failure is None for u in EXAMPLES) and all(got[u].normalized_url is None for u in FAILURES)
    assert got["example.com"].scheme_was_added and not got["https://a.com/.."].scheme_was_added


def random_urls(n):
    rng = random.Random(5)
    pieces = ["a", "b.c", "..", ".", "/", "//", "?", "#", ";", "=", "&", "%41", "%zz", "x", "-", "_", ":", "80", "@"]
    return ["".join(["http://h.com", *rng.choices(pieces, k=rng.randint(0, 8))]) for _ in range(n)]


def test_split_agrees_with_the_standard_library(spark):
    texts = [u for u in random_urls(600) if "[" not in u]
    got = columns(spark, [(u,) for u in texts], p=urls.split_url(F.col("c0")))
    for u, (p,) in zip(texts, got, strict=True):
        w = urlparse(u)
        assert (p.scheme, p.netloc, p.path, p.params, p.query, p.fragment, p.host) == (w.scheme, w.netloc, w.path, w.params, w.query, w.fragment, w.hostname or ""), u


def test_resolve_agrees_with_the_standard_library(spark):
    refs = ["", "x", "/x", "//o.com/x", "?q=1", "#f", "../x", "../../../x", "./", "..", "x/./y/../z", ";p", "http:x", "https://o.com/a/../b", "mailto:a@b", "javascript:1", "x//y", "/a//b/../c", "x?y=/../z"]
    bases = ["http://h.com/a/b/c?d#e", "http://h.com", "http://h.com/", "http://h.com/a/", "https://h.com/a;p?q", "http://h.com/a//b/c"]
    rows = [(b, r) for b in bases for r in refs]
    got = columns(spark, rows, u=urls.resolve(F.col("c0"), F.col("c1")))
    wrong = [(b, r, u, urljoin(b, r)) for (b, r), (u,) in zip(rows, got, strict=True) if u != urljoin(b, r)]
    assert not wrong


def test_query_params(spark):
    texts = ["", "a=1&b=", "a", "a=b=c&&d=%41+x", "url=https%3A%2F%2Fe.com", "x=%zz"]
    got = columns(spark, [(t,) for t in texts], q=urls.query_params(F.col("c0")))
    for t, (q,) in zip(texts, got, strict=True):
        assert [(x.k, x.v) for x in q] == parse_qsl(t, keep_blank_values=True)


def test_domain_parts(spark):
    wanted = {
        "www.google.co.uk": ("www", "google", "co.uk", "google.co.uk"),
        "github.io": ("", "github", "io", "github.io"),
        "user.github.io": ("", "user", "github.io", "user.github.io"),
        "a.b.c.example.com": ("a.b.c", "example", "com", "example.com"),
        "localhost": ("", "localhost", "", ""),
        "co.kr": ("", "co", "kr", "co.kr"),
        "192.168.1.1": ("192.168", "1", "1", "1.1"),
        "": ("", "", "", ""),
    }
    got = columns(spark, [(h,) for h in wanted], p=urls.domain_parts(F.col("c0")))
    assert [tuple(p) for (p,) in got] == list(wanted.values())


def test_variants_and_keys(spark):
    u = ["http://a.com", "https://a.com/x/", "https://a.com/x?q", "ftp://a.com/x", "https://github.com/u/r/raw", "https://github.com/only", "https://A.com/p"]
    got = columns(spark, [(x,) for x in u], v=urls.url_variants(F.col("c0")), k=urls.match_key(F.col("c0")))
    assert got[0][0] == ["http://a.com", "http://a.com/", "https://a.com", "https://a.com/"]
    assert got[1][0] == ["https://a.com/x/", "https://a.com/x", "http://a.com/x/", "http://a.com/x"]
    assert got[2][0] == ["https://a.com/x?q", "https://a.com/x/?q", "http://a.com/x?q", "http://a.com/x/?q"]
    assert got[3][0] == ["ftp://a.com/x", "ftp://a.com/x/"]
    assert [k for _, k in got[4:]] == ["github.com/u/r", None, "a.com"]


def test_hosts_and_labels(spark):
    hosts = ["127.0.0.1", "8.8.8.8", "10.1.2.3", "172.31.0.1", "172.32.0.1", "localhost", "a.com", "01.2.3.4", "224.0.0.1", ""]
    got = columns(spark, [(h,) for h in hosts], ip=urls.is_ip(F.col("c0")), local=urls.is_local_ipv4(F.col("c0")), blocked=urls.is_blocked_host(F.col("c0")))
    assert [g[0] for g in got] == [True, True, True, True, True, False, False, False, True, False]
    assert [g[1] for g in got] == [True, False, True, True, False, False, False, False, False, False]
    assert [g[2] for g in got] == [True, False, True, True, False, True, False, False, True, True]
    got = columns(spark, [("",), ("aaaa",), ("abcd",), ("bcd1",)], e=urls.entropy(F.col("c0")), s=urls.consonant_share(F.col("c0")))
    assert [(abs(e), s) for e, s in got] == [(0.0, 0.0), (0.0, 0.0), (2.0, 0.75), (2.0, 1.0)]


def test_external(spark):
    base = "https://www.a.com/x"
    refs = {"/y": False, "https://a.com/z": False, "https://b.com": True, "mailto:x@b.com": False, " //c.com ": True}
    got = columns(spark, [(r, base) for r in refs], e=urls.is_external(F.col("c0"), F.col("c1")))
    assert [e for (e,) in got] == list(refs.values())
