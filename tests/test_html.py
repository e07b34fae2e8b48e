"""The page reader: what tags it sees, and that no page takes it more than linear time."""

import random
import time
from html.parser import HTMLParser

import pytest

from linkrisk.functions.html import read_page
from linkrisk.functions.markup import Markup, attributes_of, closes_itself

TOKENS = """<p> </p> <div> </div> <div_id=root> <form> </form> <form_action=x> <label> </label> <label_for=a> <input_type=password> <input_id='a'> <a_href="x>y"> </a>
<b> </b> <title> </title> <ul> <li> </ul> <script> </script> <style> </style> word &amp; <!--_c_--> <td> <table> </table> <option> <select> </select> <button> </button> <br/> <a/> <br_/>
<template> </template> <head> </head> <body> <!DOCTYPE_html> <?x?> <img_alt=q/> <img_alt="&lt;"> < > = " ' / <a_ <b_c=' -->""".split()


class Events(HTMLParser):
    """The standard library's view of a page: tags with attributes."""

    def __init__(self):
        super().__init__()
        self.seen = []

    def handle_starttag(self, tag, attrs):
        self.seen.append((tag, dict(reversed([(k, v or "") for k, v in attrs]))))

    def handle_endtag(self, tag):
        self.seen.append(("/" + tag, {}))


def events(page):
    markup, at, out = Markup(page), 0, []
    while tag := markup.find(at):
        at = tag.end
        if tag.name and tag.ending:
            out.append(("/" + tag.name, {}))
        elif tag.name:
            out.append((tag.name, attributes_of(tag.attributes)))
            if closes_itself(tag.attributes):
                out.append(("/" + tag.name, {}))
    return out


def test_tags_are_those_of_the_standard_library():
    rng = random.Random(0)
    whole = [t.replace("_", " ") for t in TOKENS if t.startswith("<") and t.endswith(">") and len(t) > 1 and "script" not in t and "style" not in t] + ["word", " ", "&amp;"]
    for _ in range(3000):
        page = "".join(rng.choice(whole) for _ in range(rng.randint(0, 25)))
        parser = Events()
        parser.feed(page)
        parser.close()
        assert events(page) == parser.seen, page


@pytest.mark.parametrize(
    "page,tags",
    [
        ("<a href=http://x/>t</a>", [("a", {"href": "http://x/"}), ("/a", {})]),
        ("<A HREF='a>b' x/>", [("a", {"href": "a>b", "x": ""}), ("/a", {})]),
        ("a < b <c", []),
        ("<!-- <a> ", []),
        ("<a b='c><d>", [("a", {"b": "'c"}), ("d", {})]),
        ("<a b=\"c", []),
        ("</a b><//><!x><?y>", [("/a", {})]),
    ],
)
def test_odd_tags(page, tags):
    assert events(page) == tags


PATTERNS = ["<b>x", "<a>x", "<label>x", "<title>x", "<p><div>", "<li><b>", "<form>", "</x>", "<a ", "<b '>'", "<b x='", "<!--", "<!", "</", "&#", "<script>", "<a b=c=d", "<input type=password>", "<p><div>" + "<b>" * 50 + "<p></p>"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_two_mebibytes_are_read_in_seconds(pattern):
    began = time.process_time()
    read_page(pattern * (2 * 1024 * 1024 // len(pattern)))
    assert time.process_time() - began < 8


def test_time_grows_with_the_page():
    rng = random.Random(1)
    tokens = [t.replace("_", " ") for t in TOKENS]
    for _ in range(12):
        unit = "".join(rng.choice(tokens) for _ in range(rng.randint(1, 5)))

        def spent(size, unit=unit):
            page = unit * (size // len(unit))
            began = time.process_time()
            read_page(page)
            return time.process_time() - began

        spent(50_000)
        assert spent(800_000) < 40 * max(spent(50_000), 0.005), unit


def test_texts_of_nested_elements_and_lists_of_many_nodes():
    page = read_page("<title>a<b>c</title><title>d</title>" + "<a>x" * 2000 + "<input type=password>" * 1500 + "<label>" + "y" * 500 + "</label>")
    tags = [e["tag"] for e in page["elements"]]
    assert tags.count("a") == 1000 and tags.count("input") == 1500
    assert page["elements"][0]["text"] == "a c" and len(page["elements"][2]["text"]) > 180
    assert page["elements"][-1]["text"] == "y" * 182


def test_pages_are_handed_on_in_small_parts_and_read_once(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from linkrisk.functions import html
    from linkrisk.operators import content, domain

    cut = list(html.slices(pd.Series(["x"] * 150 + [None, "y" * 600_000, "z"])))
    assert cut == [(0, 64), (64, 128), (128, 152), (152, 153)] and list(html.slices(pd.Series([], dtype=object))) == []
    pages = spark.createDataFrame([(i, "https://a.test/", f"<title>naver {i}</title><a href='/{i}'>x</a>") for i in range(200)], "id int, url string, html string").coalesce(1)
    rows = html.with_page(pages)
    assert [r.t for r in rows.orderBy("id").select(F.col("page.elements")[0]["text"].alias("t")).collect()] == [f"naver {i}" for i in range(200)]
    brands = domain.brand_sets(domain.sample_brands(spark))
    scored = content.score_features(html.features(pages), brands).where("content_score >= 0")
    plan = scored.select("id", "content_score")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # the page and its brand words, once each


def test_all_elements_of_a_tag_are_listed_however_many():
    from linkrisk.functions import html

    pages = ["<a href=/0>x</a>" * 3, None, "<p>no anchor</p>", "".join(f"<A HREF='/{i}' x>t" for i in range(25_000)) + "<script><a href=/no></script><a/>", "y" * 600_000 + "<a b=c>", "<a href=/z>"]
    parts = list(html.pieces(pages, "a"))
    assert [sum(len(found) for *_, found in part) for part in parts] == [10_000, 10_000, 5_005, 1]
    listed = {}
    for number, begin, found in (x for part in parts for x in part):
        assert begin == len(listed.setdefault(number, []))
        listed[number] += found
    many = [{"href": f"/{i}", "x": ""} for i in range(25_000)]
    assert listed == {0: [{"href": "/0"}] * 3, 3: [*many, {}], 4: [{"b": "c"}], 5: [{"href": "/z"}]}


@pytest.mark.parametrize("pattern", PATTERNS)
def test_all_elements_of_two_mebibytes_are_listed_in_seconds(pattern):
    from linkrisk.functions import html

    began = time.process_time()
    for _ in html.pieces([pattern * (2 * 1024 * 1024 // len(pattern))], "a"):
        pass
    assert time.process_time() - began < 8


def test_page_links_has_every_anchor_of_a_page(spark, tmp_path):
    from linkrisk.plans import catalog

    hrefs = {12: [f"/p/{i}" for i in range(12_000)], 24: ["https://b.test/x"], 36: [], 48: [f"https://www.a.test/{i}" for i in range(1_001)], 60: None}
    made = [(k, f"https://a.test/{k}", h and "<p>" + "".join(f'<a href="{x}">t</a>' for x in h)) for k, h in hrefs.items()]
    spark.createDataFrame(made, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    links = catalog.u11_u19_page_links(spark, str(tmp_path))
    rows = [tuple(r) for r in links.orderBy("page_id", "pos").collect()]
    assert rows == [(k, i, x, x if "://" in x else "https://a.test" + x, k == 24) for k, h in hrefs.items() for i, x in enumerate(h or [])]
    generate = links._jdf.queryExecution().optimizedPlan().toString().partition("Generate posexplode")[2].partition("\n")[0]
    assert "), [3], false" in generate  # the array is not carried to each of its elements
