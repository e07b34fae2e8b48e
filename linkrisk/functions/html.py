"""Page features: one vectorised helper reads HTML to an element array, the features are expressions on that array.

Contract of the helper: tags as ``markup`` finds them; void elements have no content; ``p``, ``li``,
``option``, ``tr``, ``td`` end an open one of their kind; an end tag closes up to its start tag, one without start is dropped.
Text of ``script``, ``style`` and ``template`` and comments is no text; the title is outside the body.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrisk import dims
from linkrisk.functions import urls
from linkrisk.functions.markup import Markup, attributes_of, closes_itself
from linkrisk.functions.urls import let

ELEMENT = "struct<tag: string, attrs: map<string, string>, text: string, form: int, label: int>"
PAGE = f"struct<elements: array<{ELEMENT}>, strings: array<string>>"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_ITSELF = frozenset("p li option tr td th dt dd".split())
#: An element that ends itself ends no element beyond one of these.
BARRIERS = frozenset("ul ol select table dl div body".split())
SILENT = frozenset("script style template".split())
#: Elements whose content is no markup, and how their end tags begin.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style")}
KEPT = frozenset("title form input textarea select meta a img div label button".split()) | set(dims.SPA_MOUNT_TAGS)
WITH_TEXT = frozenset("title a button label".split())

MAX_NODES, MAX_ALTS = 1000, 200
MAX_TEXTS, MAX_FIELDS, MAX_CTAS, MAX_LINKS = 40, 80, 40, 40
MAX_CHARS = 180
#: Pages and letters that a worker reads before it hands on what it has read: a page's elements take it many times the page.
SLICE_PAGES, SLICE_CHARS = 64, 500_000
#: Elements that a worker hands on at once where all of a tag are asked for.
PIECE_ELEMENTS = 10_000


class Reader:
    """Collects the elements that features need, in document order, and the body's strings, in one pass.

    Per tag at most ``MAX_NODES`` elements are kept, but password inputs are kept wherever they stand. Body strings end at
    ``MAX_TEXTS`` distinct ones. Time and memory are linear in the page whatever its depth: what is open is known by tag, and
    an element notes where its text begins and ends. Of the texts of links, buttons and labels as much is joined as features
    read (they cut at ``MAX_CHARS``); the first title is kept whole.
    """

    def __init__(self):
        self.open: list[tuple[str, dict | None]] = []
        self.places: dict[str, list[int]] = {}
        self.barriers: list[int] = []
        self.forms_open: list[int] = []
        self.labels_open: list[int] = []
        self.silent = self.speaking = 0
        self.elements: list[dict] = []
        self.counts: dict[str, int] = {}
        self.forms = 0
        self.texts: list[str] = []
        self.first_title: int | None = None
        self.title: list[str] = []
        self.strings: dict[str, None] = {}

    def read(self, page: str) -> None:
        """Reads a whole page. What stands in a script or style element is no markup."""
        markup, at = Markup(page), 0
        while tag := markup.find(at):
            self._data(page[at : tag.begin])
            at = tag.end
            if not tag.name:
                continue
            if tag.ending:
                self._end(tag.name)
                continue
            self._start(tag.name, attributes_of(tag.attributes))
            if closes_itself(tag.attributes):
                if tag.name not in VOID:
                    self._end(tag.name)
            elif tag.name in RAW:
                # up to its end tag, which is found next; without one, to the page's end
                end = RAW[tag.name].search(page, at)
                at = end.start() if end else len(page)
        self._data(page[at:])

    def _start(self, tag: str, values: dict[str, str]) -> None:
        if tag in ENDS_ITSELF and self.places.get(tag) and (not self.barriers or self.places[tag][-1] > self.barriers[-1]):
            self._close_to(self.places[tag][-1])
        element = None
        if tag == "form":
            self.forms += 1
        self.counts[tag] = self.counts.get(tag, 0) + 1
        password = tag == "input" and values.get("type", "").lower() == "password"
        if tag in KEPT and (self.counts[tag] <= MAX_NODES or password) and (tag != "div" or "id" in values):
            form = self.forms if tag == "form" else self.forms_open[-1] if self.forms_open else -1
            element = {"tag": tag, "attrs": values, "from": len(self.texts), "to": None, "form": form, "label": self.labels_open[-1] if self.labels_open else -1, "at": len(self.elements)}
            self.elements.append(element)
            if tag == "title" and self.first_title is None:
                self.first_title = element["at"]
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append((tag, element))
            if tag in BARRIERS:
                self.barriers.append(len(self.open) - 1)
            self.silent += tag in SILENT
            if element is not None:
                self.speaking += tag in WITH_TEXT
                if tag == "form":
                    self.forms_open.append(element["form"])
                elif tag == "label":
                    self.labels_open.append(element["at"])

    def _close_to(self, place):
        while len(self.open) > place:
            tag, element = self.open.pop()
            self.places[tag].pop()
            if tag in BARRIERS:
                self.barriers.pop()
            self.silent -= tag in SILENT
            if element is not None:
                self.speaking -= tag in WITH_TEXT
                element["to"] = len(self.texts)
                if tag == "form":
                    self.forms_open.pop()
                elif tag == "label":
                    self.labels_open.pop()

    def _end(self, tag: str) -> None:
        if self.places.get(tag):
            self._close_to(self.places[tag][-1])

    def _data(self, data: str) -> None:
        text = data.strip()
        if not text or self.silent:
            return
        text = unescape(text).strip() if "&" in text else text
        if not text:
            return
        titled = self.places.get("title")
        if self.speaking:
            self.texts.append(" ".join(text.split())[: MAX_CHARS + 2])
        if titled and self.open[titled[0]][1]["at"] == self.first_title:
            self.title.append(text)
        if not self.places.get("head") and not titled and len(self.strings) < MAX_TEXTS:
            squeezed = " ".join(text.split())
            self.strings[squeezed if len(squeezed) <= MAX_CHARS else squeezed[:MAX_CHARS].rstrip()] = None

    def _text(self, element) -> str:
        """The element's text, as far as features read it."""
        if element["tag"] not in WITH_TEXT:
            return ""
        if element["at"] == self.first_title:
            return " ".join(self.title)
        stop, parts, size = len(self.texts) if element["to"] is None else element["to"], [], 0
        for i in range(element["from"], stop):
            parts.append(self.texts[i])
            size += len(self.texts[i]) + 1
            if size > MAX_CHARS + 2:
                break
        return " ".join(parts)

    def page(self) -> dict:
        kept = [{"tag": e["tag"], "attrs": e["attrs"], "text": self._text(e), "form": e["form"], "label": e["label"]} for e in self.elements]
        return {"elements": kept, "strings": list(self.strings)}


def read_page(html: str | None) -> dict:
    reader = Reader()
    reader.read(html or "")
    return reader.page()


class Every(Reader):
    """Collects the attributes of all elements of one tag, however many there are, in document order, and nothing else."""

    def __init__(self, tag: str):
        super().__init__()
        self.tag = tag
        self.found: list[dict[str, str]] = []

    def _start(self, tag: str, values: dict[str, str]) -> None:
        if tag == self.tag:
            self.found.append(values)

    def _end(self, tag: str) -> None:
        pass

    def _data(self, data: str) -> None:
        pass


def pieces(pages: Iterable[str | None], tag: str) -> Iterator[list[tuple[int, int, list[dict[str, str]]]]]:
    """Lists of (page's number, elements before, attributes of the elements from there on), each of at most ``PIECE_ELEMENTS``
    elements; one ends, too, with the page that brings it to ``SLICE_CHARS``."""
    out, size, chars = [], 0, 0
    for number, page in enumerate(pages):
        reader = Every(tag)
        reader.read(page or "")
        chars += len(page or "")
        begin = 0
        while begin < len(reader.found):
            end = min(begin + PIECE_ELEMENTS - size, len(reader.found))
            out.append((number, begin, reader.found[begin:end]))
            size, begin = size + end - begin, end
            if size == PIECE_ELEMENTS or end == len(reader.found) and chars >= SLICE_CHARS:
                yield out
                out, size, chars = [], 0, 0
    if out:
        yield out


def slices(batch: pd.Series) -> Iterator[tuple[int, int]]:
    """(begin, end) of parts of a batch of pages; a part ends at ``SLICE_PAGES`` pages or when it has ``SLICE_CHARS``."""
    begin = size = 0
    for end, page in enumerate(batch, 1):
        size += len(page or "")
        if size >= SLICE_CHARS or end - begin >= SLICE_PAGES:
            yield begin, end
            begin, size = end, 0
    if begin < len(batch):
        yield begin, len(batch)


def with_page(df: DataFrame, html: str = "html", name: str = "page") -> DataFrame:
    """``df`` with the element array of ``html`` in column ``name`` (the html stays; drop it as soon as it is not needed)."""

    @F.pandas_udf(PAGE)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin, end in slices(batch):
                yield pd.DataFrame([read_page(x) for x in batch[begin:end]], columns=["elements", "strings"])

    # see ``patterns``: a page is read once, whatever filters follow
    return df.withColumn(name, read.asNondeterministic()(F.col(html)))


def with_every(df: DataFrame, tag: str, html: str = "html", name: str = "page") -> DataFrame:
    """``df`` without ``html``, with all elements of ``tag``, however many a page has, in ``name``: their tags and attributes alone.

    A page's elements come in rows of at most ``PIECE_ELEMENTS``; column ``begin`` has the number of those before. It is no part
    of ``name``, else Spark would carry a row's whole array to each element exploded from it. A page without any has no row.
    """
    at = df.columns.index(html)
    schema = df.drop(html).withColumns({"begin": F.lit(0), name: F.lit(None).cast(f"struct<elements: array<{ELEMENT}>>")}).schema
    pair = pa.map_(pa.string(), pa.string())
    kind = pa.struct({"elements": pa.list_(pa.struct({"tag": pa.string(), "attrs": pair, "text": pa.string(), "form": pa.int32(), "label": pa.int32()}))})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = batch.remove_column(at)
            for part in pieces((x.as_py() for x in batch.column(at)), tag):
                made = [{"elements": [{"tag": tag, "attrs": list(a.items()), "text": "", "form": -1, "label": -1} for a in found]} for *_, found in part]
                rows = others.take(pa.array([number for number, *_ in part], pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([begin for _, begin, _ in part], pa.int32()), pa.array(made, kind)], names=schema.names)

    return df.mapInArrow(read, schema)


def attr(e: Column, name: str) -> Column:
    """The attribute's value, null without it."""
    return F.try_element_at(e["attrs"], F.lit(name))


def trimmed(text: Column) -> Column:
    """White space squeezed, at most 180 characters."""
    squeezed = F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))
    return F.when(F.length(squeezed) <= MAX_CHARS, squeezed).otherwise(F.rtrim(F.substring(squeezed, 1, MAX_CHARS)))


def first_distinct(texts: Column, n: int) -> Column:
    """The first ``n`` distinct non-empty texts, each trimmed."""
    return F.slice(F.array_distinct(F.filter(F.transform(texts, trimmed), lambda x: F.coalesce(x, F.lit("")) != "")), 1, n)


def of_tags(elements: Column, *tags: str, limit: int | None = MAX_NODES) -> Column:
    some = F.filter(elements, lambda e: e["tag"].isin(list(tags)))
    return F.slice(some, 1, limit) if limit else some


def is_password(e: Column) -> Column:
    return (e["tag"] == "input") & (F.lower(F.coalesce(attr(e, "type"), F.lit(""))) == "password")


def first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def title(elements: Column) -> Column:
    text = F.trim(first(of_tags(elements, "title", limit=1))["text"])
    return F.nullif(text, F.lit(""))


def external_password_form(elements: Column, base: Column) -> Column:
    """Whether the first form that has a password field and an action sends it to another site."""
    passwords = F.transform(F.filter(elements, is_password), lambda e: e["form"])
    forms = F.filter(elements, lambda e: (e["tag"] == "form") & F.array_contains(passwords, e["form"]) & (urls.stripped(F.coalesce(attr(e, "action"), F.lit(""))) != ""))
    action = attr(first(forms), "action")
    return F.when(action.isNotNull(), urls.is_external(action, base)).otherwise(F.lit(False))


def refreshes(elements: Column) -> Column:
    return F.filter(
        of_tags(elements, "meta"),
        lambda e: (F.lower(F.coalesce(attr(e, "http-equiv"), F.lit(""))) == "refresh") & (urls.stripped(F.coalesce(attr(e, "content"), F.lit(""))) != ""),
    )


def refresh_target(content: Column) -> Column:
    """The target in a refresh's content, "" without one."""
    return urls.stripped(F.regexp_extract(content, r"(?i)(?:^|;)\s*url\s*=\s*['\"]?([^'\";]+)", 1))


def external_refresh(elements: Column, base: Column) -> Column:
    return F.exists(refreshes(elements), lambda e: let(refresh_target(attr(e, "content")), lambda t: (t != "") & urls.is_external(t, base)))


def links(elements: Column, base: Column) -> Column:
    """(url, download) of the http(s) links among the first anchors."""
    some = F.filter(of_tags(elements, "a"), lambda e: F.coalesce(attr(e, "href"), F.lit("")) != "")
    made = F.transform(some, lambda e: F.struct(urls.resolve(base, urls.stripped(attr(e, "href"))).alias("url"), F.map_contains_key(e["attrs"], "download").alias("download")))
    return F.filter(made, lambda x: F.lower(x["url"]).rlike("^https?:"))


def external_ratio(made: Column, base: Column) -> Column:
    bare = lambda h: F.regexp_replace(h, r"^www\.", "")
    outside = F.filter(made, lambda x: bare(urls.host_of(x["url"])) != bare(urls.host_of(base)))
    return F.try_divide(F.size(outside).cast("double"), F.size(made).cast("double"))


def downloads(made: Column) -> Column:
    dot = lambda exts: "(" + "|".join(x.replace(".", r"\.") for x in exts) + ")$"

    def risky(x: Column) -> Column:
        path = F.lower(urls.split_url(x["url"])["path"])
        return path.rlike(dot(dims.RISKY_EXTENSIONS)) | (x["download"] & path.rlike(dot(dims.RISKY_DOWNLOAD_EXTENSIONS)))

    return first_distinct(F.transform(F.filter(made, risky), lambda x: x["url"]), MAX_LINKS)


def spa_shell(elements: Column) -> Column:
    interactive = F.exists(elements, lambda e: e["tag"].isin("form", "input"))
    mounts = F.exists(elements, lambda e: (e["tag"] == "div") & F.lower(F.coalesce(attr(e, "id"), F.lit(""))).isin(list(dims.SPA_MOUNT_IDS)))
    tags = F.exists(elements, lambda e: e["tag"].isin(list(dims.SPA_MOUNT_TAGS)))
    return ~interactive & (mounts | tags)


def field_summaries(elements: Column) -> Column:
    labels = F.filter(of_tags(elements, "label"), lambda e: (urls.stripped(F.coalesce(attr(e, "for"), F.lit(""))) != "") & (e["text"] != ""))
    by_for = lambda key: first(F.reverse(F.filter(labels, lambda x: urls.stripped(attr(x, "for")) == key)))["text"]
    opt = lambda name, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{name}="), x))

    def one(e: Column) -> Column:
        around = F.when(e["label"] >= 0, F.get(elements, e["label"])["text"])
        label = F.coalesce(trimmed(by_for(trimmed(attr(e, "id")))), F.nullif(trimmed(around), F.lit("")))
        parts = [opt(n, trimmed(attr(e, n))) for n in ("name", "type", "placeholder", "id", "title", "aria-label")]
        return F.array_join(F.array_compact(F.array(opt("label", label), *parts)), " ")

    return first_distinct(F.transform(of_tags(elements, "input", "textarea", "select"), one), MAX_FIELDS)


def ctas(elements: Column) -> Column:
    def one(e: Column) -> Column:
        button = F.lower(trimmed(F.coalesce(attr(e, "type"), F.lit("")))).isin("submit", "button", "reset")
        return F.when(e["tag"] != "input", e["text"]).when(button, attr(e, "value"))

    return first_distinct(F.transform(of_tags(elements, "button", "a", "input"), one), MAX_CTAS)


def alts(elements: Column) -> Column:
    found = F.transform(of_tags(elements, "img", limit=MAX_ALTS), lambda e: urls.stripped(attr(e, "alt")))
    return F.filter(found, lambda x: F.coalesce(x, F.lit("")) != "")


def sensitive_types(summaries: Column) -> Column:
    text = F.lower(F.array_join(summaries, "\n"))
    met = [F.when(_any(text, words), F.lit(name)) for name, words in dims.SENSITIVE_FIELDS.items()]
    return F.array_compact(F.array(*met))


def _any(text: Column, words) -> Column:
    met = F.lit(False)
    for w in words:
        met = met | text.contains(w.lower())
    return met


def keywords(text: Column, words) -> Column:
    return F.array_compact(F.array(*[F.when(text.contains(w.lower()), F.lit(w)) for w in words]))


FEATURES = [
    "title", "has_password_field", "has_password_form_external_action", "has_meta_refresh", "has_external_meta_refresh", "external_link_ratio", "image_alts",
    "is_spa_shell", "body_text_snippets", "form_field_summaries", "cta_texts", "download_links", "sensitive_field_types", "korean_lure_keywords", "public_agency_keywords",
]


def features(df: DataFrame, html: str = "html", base: str = "url", name: str = "features") -> DataFrame:
    """``df`` without ``html``, with the struct of page features in ``name``. No shuffle; a null page counts as empty."""
    kept = [c for c in df.columns if c != html]
    df = with_page(df, html, "_page").drop(html)
    e, b = F.col("_page.elements"), F.col(base)
    df = df.withColumn("_links", links(e, b)).withColumn("_fields", field_summaries(e)).withColumn("_ctas", ctas(e)).withColumn("_alts", alts(e)).withColumn("_title", title(e))
    heard = F.concat(F.array_compact(F.array(F.col("_title"))), F.col("_page.strings"), F.col("_fields"), F.col("_ctas"), F.col("_alts"))
    df = df.withColumn("_heard", F.lower(F.array_join(heard, "\n")))
    made = {
        "title": F.col("_title"),
        "has_password_field": F.exists(e, is_password),
        "has_password_form_external_action": external_password_form(e, b),
        "has_meta_refresh": F.size(refreshes(e)) > 0,
        "has_external_meta_refresh": external_refresh(e, b),
        "external_link_ratio": external_ratio(F.col("_links"), b),
        "image_alts": F.col("_alts"),
        "is_spa_shell": spa_shell(e),
        "body_text_snippets": F.col("_page.strings"),
        "form_field_summaries": F.col("_fields"),
        "cta_texts": F.col("_ctas"),
        "download_links": downloads(F.col("_links")),
        "sensitive_field_types": sensitive_types(F.col("_fields")),
        "korean_lure_keywords": keywords(F.col("_heard"), dims.LURE_KEYWORDS),
        "public_agency_keywords": keywords(F.col("_heard"), dims.AGENCY_KEYWORDS),
    }
    return df.withColumn(name, F.struct(*[made[f].alias(f) for f in FEATURES])).select(*kept, name)


def merged(static: Column, rendered: Column) -> Column:
    """The features of a page and of its rendered form together."""
    union = lambda f: F.array_distinct(F.concat(static[f], rendered[f]))
    either = lambda f: static[f] | rendered[f]
    own = {"title": F.coalesce(rendered["title"], static["title"]), "external_link_ratio": F.coalesce(rendered["external_link_ratio"], static["external_link_ratio"]), "is_spa_shell": rendered["is_spa_shell"]}
    made = {f: own[f] if f in own else either(f) if f.startswith("has_") else union(f) for f in FEATURES}
    return F.struct(*[c.alias(f) for f, c in made.items()])
