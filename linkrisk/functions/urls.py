"""URL functions as Column expressions.

They stay inside the JVM; only hosts and texts that are not ASCII go through a vectorised helper, and for those rows alone
(see ``normalised``).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from linkrisk import dims
from linkrisk.dims import SETTINGS, Settings

PARTS = r"(?s)^([a-zA-Z][a-zA-Z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SCHEME = r"^[a-zA-Z][a-zA-Z0-9+\-.]*://"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: a long expression is not repeated wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _in(column: Column, values) -> Column:
    return column.isin(list(values))


def split_url(url: Column) -> Column:
    """struct(scheme, netloc, userinfo, host, bracketed, port_text, path, params, query, fragment) of an absolute URL.

    ``userinfo`` and ``port_text`` are null if there is no ``@`` or ``:``; parts that are absent are "". Null for null.
    """
    pieces = lambda u: F.struct(*[F.regexp_extract(u, PARTS, i).alias(f"p{i}") for i in range(1, 6)])
    return let(let(url, pieces), _parts)


def _parts(p: Column) -> Column:
    part = lambda i: p[f"p{i}"]
    netloc = part(2)
    hostport = F.substring_index(netloc, "@", -1)
    inside = hostport.contains("[")
    after = F.when(inside, F.substring_index(F.substring_index(hostport, "[", -1), "]", -1)).otherwise(hostport)
    host = F.when(inside, _bracketed(hostport)).otherwise(F.substring_index(hostport, ":", 1))
    port = F.when(after.contains(":"), F.regexp_extract(after, r"(?s)^[^:]*:(.*)$", 1))
    user = F.when(netloc.contains("@"), F.regexp_extract(netloc, "(?s)^(.*)@", 1))
    path = part(3)
    last = F.substring_index(path, "/", -1)
    cut = last.contains(";")
    params = F.when(cut, F.regexp_extract(last, "(?s)^[^;]*;(.*)$", 1)).otherwise("")
    return F.struct(
        F.lower(part(1)).alias("scheme"),
        netloc.alias("netloc"),
        user.alias("userinfo"),
        F.lower(host).alias("host"),
        inside.alias("bracketed"),
        port.alias("port_text"),
        F.when(cut, F.substr(path, F.lit(1), F.length(path) - F.length(params) - 1)).otherwise(path).alias("path"),
        params.alias("params"),
        part(4).alias("query"),
        part(5).alias("fragment"),
    )


def host_of(url: Column) -> Column:
    """The lower-case host, "" without one; as in ``split_url``, but no other part is sought."""
    hostport = let(F.regexp_extract(url, PARTS, 2), lambda netloc: F.substring_index(netloc, "@", -1))
    return let(hostport, lambda x: F.lower(F.when(x.contains("["), _bracketed(x)).otherwise(F.substring_index(x, ":", 1))))


def scheme_of(url: Column) -> Column:
    """The lower-case scheme, "" if the URL is not absolute."""
    return F.lower(F.regexp_extract(url, PARTS, 1))


def _bracketed(hostport: Column) -> Column:
    return F.substring_index(F.substring_index(hostport, "[", -1), "]", 1)


def cleaned(url: Column) -> Column:
    """Trimmed, without control characters."""
    return F.regexp_replace(stripped(url), r"[\x00-\x1f\x7f-\x9f]", "")


def stripped(text: Column) -> Column:
    """Without white space (Unicode's and the information separators) at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def with_scheme(url: Column) -> Column:
    return F.when(url.rlike(SCHEME), url).otherwise(F.concat(F.lit("http://"), url))


def percent_normalised(text: Column) -> Column:
    """Unreserved characters decoded, other escapes in upper case; one pass."""
    return let(text, _percent)


def _percent(text: Column) -> Column:
    pieces = F.split(text, "%")

    def one(piece: Column, i: Column) -> Column:
        char = F.char(F.conv(F.substring(piece, 1, 2), 16, 10).cast("long"))
        rest = F.substr(piece, F.lit(3))
        escape = F.when(char.rlike("^[A-Za-z0-9._~-]$"), F.concat(char, rest)).otherwise(F.concat(F.lit("%"), F.upper(F.substring(piece, 1, 2)), rest))
        return F.when(i == 0, piece).when(piece.rlike("^[0-9A-Fa-f]{2}"), escape).otherwise(F.concat(F.lit("%"), piece))

    return F.when(text.contains("%"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def path_normalised(path: Column) -> Column:
    """Percent form, single slashes, dot segments resolved; never above the root, no slash left by a trailing dot."""
    form = F.regexp_replace(percent_normalised(F.when(path == "", F.lit("/")).otherwise(path)), "/{2,}", "/")
    return let(form, _without_dots)


def _without_dots(form: Column) -> Column:
    empty = F.array().cast("array<string>")

    def step(done: Column, seg: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        back = F.when(last.isNotNull() & (last != ""), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)
        return F.when(seg == ".", done).when(seg == "..", back).otherwise(F.concat(done, F.array(seg)))

    segments = F.aggregate(F.split(form, "/"), empty, step)
    head = lambda x: F.coalesce(F.get(x, F.lit(0)), F.lit("-"))
    rooted = let(segments, lambda x: F.when(form.startswith("/") & (head(x) != ""), F.concat(F.array(F.lit("")), x)).otherwise(x))
    dotted = form.contains("/.") | form.startswith(".")
    return let(F.when(dotted, F.array_join(rooted, "/")).otherwise(form), lambda x: F.when(x == "", F.lit("/")).otherwise(x))


def joined_url(scheme: Column, netloc: Column, path: Column, params: Column, query: Column, fragment: Column) -> Column:
    """A URL of its parts; empty parts leave no delimiter."""
    opt = lambda mark, x: F.when(x != "", F.concat(F.lit(mark), x)).otherwise("")
    bare = (netloc != "") & (path != "") & ~path.startswith("/")
    rooted = F.when(bare, F.concat(F.lit("/"), path)).otherwise(path)
    return F.concat(scheme, F.lit("://"), netloc, rooted, opt(";", params), opt("?", query), opt("#", fragment))


def normalise(url: Column, settings: Settings = SETTINGS) -> Column:
    """struct(original_url, normalized_url, scheme_was_added, failure) of a raw ASCII URL; null counts as empty.

    ``failure`` is null or, in the order of the tests: empty_url, too_long, unparsable, bad_scheme, ipv6_host, empty_host,
    bad_port. For text that is not ASCII use ``normalised``.
    """
    original = stripped(F.coalesce(url, F.lit("")))
    return let(original, lambda o: let(without_controls(o), lambda c: _normal(o, c, None, settings)))


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x1f\x7f-\x9f]", "")


def _normal(original: Column, clean: Column, idna_host: Column | None, settings: Settings) -> Column:
    parts = let(with_scheme(clean), split_url)
    return let(parts, lambda p: _checked(original, clean, p, p["host"] if idna_host is None else idna_host, settings))


def _checked(original: Column, clean: Column, p: Column, host: Column, settings: Settings) -> Column:
    port = F.when(p["port_text"].rlike("^[0-9]+$"), p["port_text"].try_cast("int"))
    no_port = F.coalesce(p["port_text"], F.lit("")) == ""
    uneven = p["netloc"].contains("[") != p["netloc"].contains("]")
    failure = (
        F.when(original == "", "empty_url")
        .when(F.length(with_scheme(clean)) > settings.max_url_length, "too_long")
        .when(uneven | (p["bracketed"] & ~p["host"].contains(":")), "unparsable")
        .when(~_in(p["scheme"], DEFAULT_PORTS), "bad_scheme")
        .when(p["bracketed"], "ipv6_host")
        .when(host == "", "empty_host")
        .when(~no_port & (port.isNull() | (port > 65535)), "bad_port")
    )
    default = F.coalesce(*[F.when(p["scheme"] == s, F.lit(n)) for s, n in DEFAULT_PORTS.items()], F.lit(-1))
    netloc = F.when(no_port | (port == default), host).otherwise(F.concat(host, F.lit(":"), port.cast("string")))
    made = F.struct(
        netloc.alias("netloc"),
        path_normalised(p["path"]).alias("path"),
        percent_normalised(p["params"]).alias("params"),
        percent_normalised(p["query"]).alias("query"),
        failure.alias("failure"),
    )
    return let(
        made,
        lambda m: F.struct(
            original.alias("original_url"),
            F.when(m["failure"].isNull(), joined_url(p["scheme"], m["netloc"], m["path"], m["params"], m["query"], F.lit(""))).alias("normalized_url"),
            (~clean.rlike(SCHEME)).alias("scheme_was_added"),
            m["failure"].alias("failure"),
        ),
    )


@F.pandas_udf(StringType())
def nfc_helper(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def punycode(host: str) -> str:
    try:
        return host.encode("idna").decode("ascii")
    except UnicodeError:
        return host


@F.pandas_udf(StringType())
def idna_helper(host: pd.Series) -> pd.Series:
    return host.map(punycode, na_action="ignore")


def normalised(urls: DataFrame, column: str = "url", settings: Settings = SETTINGS) -> DataFrame:
    """``urls`` with a struct column ``norm`` (see ``normalise``).

    Rows of plain ASCII stay in the JVM; the others are split off, go through the Unicode helpers, and are put back.
    """
    plain = F.coalesce(F.length(column) == F.octet_length(column), F.lit(True))
    ascii_rows = urls.where(plain).withColumn("norm", normalise(F.col(column), settings))
    other_rows = urls.where(~plain).withColumn("_original", stripped(F.col(column)))
    other_rows = other_rows.withColumn("_clean", nfc_helper(without_controls(F.col("_original"))))
    other_rows = other_rows.withColumn("_host", idna_helper(host_of(with_scheme(F.col("_clean")))))
    other_rows = other_rows.withColumn("norm", _normal(F.col("_original"), F.col("_clean"), F.col("_host"), settings))
    return ascii_rows.unionByName(other_rows.drop("_original", "_clean", "_host"))


def domain_parts(host: Column) -> Column:
    """struct(subdomain, domain, suffix, registered) of a host; a host of one label has no suffix."""
    labels = F.filter(F.split(F.lower(host), r"\."), lambda x: x != "")
    pair = lambda x: F.array_join(F.slice(x, F.greatest(F.size(x) - 1, F.lit(1)), F.lit(2)), ".")
    measured = lambda x: F.struct(
        x.alias("labels"),
        pair(x).alias("pair"),
        F.when(F.size(x) <= 1, 0).when((F.size(x) >= 3) & _in(pair(x), dims.TWO_LABEL_SUFFIXES), 2).otherwise(1).alias("k"),
    )
    return let(let(labels, measured), _domain_parts)


def _domain_parts(m: Column) -> Column:
    labels, k = m["labels"], m["k"]
    n = F.size(labels)
    suffix = F.when(k == 2, m["pair"]).when(k == 1, F.get(labels, n - 1)).otherwise("")
    domain = F.coalesce(F.get(labels, n - k - 1), F.lit(""))
    subdomain = F.when(n - k - 1 > 0, F.array_join(F.slice(labels, F.lit(1), n - k - 1), ".")).otherwise("")
    registered = F.when((k > 0) & (domain != ""), F.concat(domain, F.lit("."), suffix)).otherwise("")
    return F.struct(subdomain.alias("subdomain"), domain.alias("domain"), suffix.alias("suffix"), registered.alias("registered"))


def registered_or_host(host: Column) -> Column:
    return let(domain_parts(host)["registered"], lambda name: F.when(name != "", name).otherwise(F.lower(host)))


def domain_changed(left: Column, right: Column) -> Column:
    return (left != right) & (registered_or_host(left) != registered_or_host(right))


def resolve(base: Column, ref: Column) -> Column:
    """``ref`` as an absolute URL, read against the absolute URL ``base`` (RFC 3986, dot segments keep a trailing slash)."""
    scheme = F.lower(F.regexp_extract(ref, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    tail = F.when(scheme != "", F.regexp_replace(ref, r"^[a-zA-Z][a-zA-Z0-9+.\-]*:", "")).otherwise(ref)
    known = F.struct(base.alias("base"), ref.alias("ref"), scheme.alias("scheme"), split_url(base).alias("b"), split_url(F.concat(F.lit("x:"), tail)).alias("r"))
    return let(known, lambda k: _resolved(k["base"], k["ref"], k["scheme"], k["b"], k["r"]))


def _resolved(base: Column, ref: Column, scheme: Column, b: Column, r: Column) -> Column:
    folder = let(F.split(b["path"], "/"), lambda x: F.when(F.element_at(x, -1) != "", F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x))
    merged = let(F.concat(folder, F.split(r["path"], "/")), lambda m: F.filter(m, lambda x, i: (x != "") | (i == 0) | (i == F.size(m) - 1)))
    segments = F.when(r["path"].startswith("/"), F.split(r["path"], "/")).otherwise(merged)

    def step(done: Column, seg: Column) -> Column:
        back = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when(seg == ".", done).when(seg == "..", back).otherwise(F.concat(done, F.array(seg)))

    def path_of(seg: Column) -> Column:
        resolved = F.aggregate(seg, F.array().cast("array<string>"), step)
        ended = F.when(F.element_at(seg, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return let(F.array_join(F.concat(resolved, ended), "/"), lambda x: F.when(x == "", F.lit("/")).otherwise(x))

    bare = (r["path"] == "") & (r["params"] == "")
    undotted = r["path"].startswith("/") & ~r["path"].contains("/.")
    path = F.when(bare, b["path"]).when(undotted, r["path"]).otherwise(let(segments, path_of))
    params = F.when(bare, b["params"]).otherwise(r["params"])
    query = F.when(bare & (r["query"] == ""), b["query"]).otherwise(r["query"])
    same_host = let(
        F.struct(path.alias("path"), params.alias("params"), query.alias("query")),
        lambda m: joined_url(b["scheme"], b["netloc"], m["path"], m["params"], m["query"], r["fragment"]),
    )
    new_host = joined_url(b["scheme"], r["netloc"], r["path"], r["params"], r["query"], r["fragment"])
    other = (scheme != "") & (scheme != b["scheme"])
    return F.when(ref == "", base).when(other, ref).when(r["netloc"] != "", new_host).otherwise(same_host)


def https_variant(url: Column) -> Column:
    """The https form of an http URL with a host, else null."""
    return F.when(url.rlike("^(?i)http://") & (host_of(url) != ""), F.regexp_replace(url, "^(?i)http://", "https://"))


def url_variants(url: Column) -> Column:
    """Up to four forms by priority: as it is, other trailing slash, other scheme, both."""
    return let(F.struct(url.alias("url"), split_url(url).alias("p")), lambda k: _variants(k["url"], k["p"]))


def _variants(url: Column, p: Column) -> Column:
    path = F.concat(p["path"], F.when(p["params"] != "", F.concat(F.lit(";"), p["params"])).otherwise(""))
    slash = lambda x: F.when(x == "", "/").when(x == "/", "").when(x.endswith("/"), F.regexp_replace(x, "/+$", "")).otherwise(F.concat(x, F.lit("/")))
    other = F.when(p["scheme"] == "https", "http").when(p["scheme"] == "http", "https")
    form = lambda scheme, x: joined_url(scheme, p["netloc"], x, F.lit(""), p["query"], p["fragment"])
    both = lambda f: F.array(url, form(p["scheme"], f["a"]), form(p["scheme"], f["b"]), form(other, f["a"]), form(other, f["b"]))
    forms = let(let(path, lambda x: F.struct(x.alias("a"), slash(x).alias("b"))), both)
    usable = (p["scheme"] != "") & (p["netloc"] != "")
    return F.when(usable, F.array_distinct(F.array_compact(forms))).otherwise(F.array(url))


def match_key(url: Column) -> Column:
    """The host, or for multi-tenant hosts host/seg1/seg2; null without host or with too short a path."""
    return let(split_url(url), _match_key)


def _match_key(p: Column) -> Column:
    tenants = F.create_map(*[F.lit(x) for pair in dims.MULTITENANT_HOSTS.items() for x in pair])
    need = F.try_element_at(tenants, p["host"])
    segments = F.filter(F.split(p["path"], "/"), lambda s: s != "")
    tenant = let(segments, lambda x: F.when(F.size(x) >= need, F.concat_ws("/", p["host"], F.array_join(F.slice(x, F.lit(1), need), "/"))))
    return F.when(p["host"] == "", F.lit(None)).when(need.isNull(), p["host"]).otherwise(tenant)


def query_params(query: Column) -> Column:
    """array<struct<k, v>> of a query string; blanks kept, escapes decoded where they are well formed."""
    plain = lambda s: F.coalesce(F.try_url_decode(s), F.translate(s, "+", " "))
    pieces = F.filter(F.split(query, "&"), lambda s: s != "")
    return F.transform(
        pieces,
        lambda s: F.struct(plain(F.substring_index(s, "=", 1)).alias("k"), plain(F.regexp_extract(s, "(?s)^[^=]*=(.*)$", 1)).alias("v")),
    )


def entropy(label: Column) -> Column:
    """Shannon entropy of the label's characters, in bits; 0 for ""."""

    def of(chars: Column) -> Column:
        share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars).cast("double")
        return -F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + let(share(c), lambda p: p * F.log2(p)))

    return F.when(label == "", F.lit(0.0)).otherwise(let(F.split(label, ""), of))


def consonant_share(label: Column) -> Column:
    """Consonants among the letters; 0 without letters."""
    letters = F.regexp_replace(F.lower(label), r"\P{L}", "")
    consonants = F.length(F.regexp_replace(letters, "[^bcdfghjklmnpqrstvwxyz]", ""))
    return F.when(letters == "", F.lit(0.0)).otherwise(consonants / F.length(letters))


def is_ip(host: Column) -> Column:
    """An IPv4 literal, or anything with a colon (hosts of brackets)."""
    return host.rlike(IPV4) | host.contains(":")


def ipv4_number(host: Column) -> Column:
    octets = F.split(host, r"\.")
    return F.aggregate(octets, F.lit(0).cast("long"), lambda acc, o: acc * 256 + F.coalesce(o.try_cast("long"), F.lit(0).cast("long")))


def is_local_ipv4(host: Column) -> Column:
    """An IPv4 literal that is not global."""
    number = ipv4_number(host)
    met = F.lit(False)
    for block in dims.LOCAL_IPV4:
        address, bits = block.split("/")
        low = sum(int(o) << (8 * (3 - i)) for i, o in enumerate(address.split(".")))
        met = met | number.between(low, low + (1 << (32 - int(bits))) - 1)
    return host.rlike(IPV4) & met


def is_blocked_host(host: Column) -> Column:
    """A blocked name, no name, or an IPv4 literal that is not global or is multicast."""
    multicast = host.rlike(IPV4) & ipv4_number(host).between(224 << 24, (240 << 24) - 1)
    return (host == "") | _in(host, dims.BLOCKED_HOSTS) | is_local_ipv4(host) | multicast


def is_external(ref: Column, base: Column) -> Column:
    """Whether ``ref``, read against ``base``, is http(s) on another host (a leading ``www.`` does not count)."""
    bare = lambda h: F.regexp_replace(h, r"^www\.", "")
    target = split_url(resolve(base, stripped(ref)))
    return let(target, lambda t: t["scheme"].isin("http", "https") & (bare(t["host"]) != bare(host_of(base))))
