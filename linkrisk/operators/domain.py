"""Domain signals of URLs: lexical rules, brand look-alikes, registration age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrisk import dims
from linkrisk.dims import SETTINGS, Settings
from linkrisk.functions import urls
from linkrisk.functions.shared import written
from linkrisk.functions.urls import let
from linkrisk.operators.brands import Brands, LongBrands, brand_list, brand_sets, brand_table, lookalikes, sample_brands, with_parts, with_trust

__all__ = ["Brands", "LongBrands", "brand_list", "brand_sets", "brand_table", "lookalikes", "sample_brands", "with_parts", "with_trust"]

def with_facts(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with the URL's parts (``_p``) and its host's labels (``_d``, with ``registered_host``)."""
    df = df.withColumn("_p", urls.split_url(F.col(url)))
    df = df.withColumn("_d", urls.domain_parts(F.col("_p.host")))
    registered = F.coalesce(F.nullif(F.col("_d.registered"), F.lit("")), F.col("_p.host"))
    return df.withColumn("_registered", registered)


def has_redirect_param(p: Column, registered: Column) -> Column:
    """A redirect parameter whose value is blank, not http(s), without host, or of another registered domain."""

    def bad(value: Column) -> Column:
        return let(
            urls.split_url(value),
            lambda v: ~v["scheme"].isin("http", "https") | (v["host"] == "") | (urls.registered_or_host(v["host"]) != registered),
        )

    named = F.filter(urls.query_params(p["query"]), lambda x: F.lower(x["k"]).isin(list(dims.REDIRECT_PARAMS)))
    return F.when(p["query"] == "", F.lit(False)).otherwise(F.exists(named, lambda x: bad(x["v"])))


def url_text(p: Column) -> Column:
    """Host, path and query (those there are) with spaces between, lower case."""
    opt = lambda x: F.when(x != "", x)
    return F.lower(F.concat_ws(" ", opt(p["host"]), opt(p["path"]), opt(p["query"])))


def is_dga_like(label: Column, trusted: Column, settings: Settings = SETTINGS) -> Column:
    odd = (urls.entropy(label) >= settings.dga_entropy) | (urls.consonant_share(label) >= settings.dga_consonants)
    return (F.length(label) >= settings.dga_length) & ~trusted & odd


def pattern_flags(df: DataFrame, brands: Brands | LongBrands, settings: Settings = SETTINGS) -> DataFrame:
    """``df`` (with facts) and one boolean column for each lexical signal, in ``_flags``."""
    p, d, registered = F.col("_p"), F.col("_d"), F.col("_registered")
    df = with_trust(df.withColumn("_text", url_text(p)), registered, brands)
    df = with_parts(df, "_brands", F.col("_text"), brands.url_labels)
    own_brand = F.col("_own")
    label = d["domain"]
    platforms = list(dims.HOSTING_PLATFORMS)
    hosting = (d["suffix"] != "") & (d["suffix"].isin(platforms) | ((d["subdomain"] != "") & F.concat_ws(".", label, d["suffix"]).isin(platforms)))
    tokens = F.regexp_extract_all(F.col("_text"), F.lit("[a-z]+"), F.lit(0))
    sensitive = F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in dims.SENSITIVE_TOKENS]))
    some_brand = F.size("_brands") > 0
    flags = {
        "IP_DIRECT": urls.is_ip(p["host"]),
        "NO_HTTPS": p["scheme"] == "http",
        "URL_USERINFO": p["netloc"].contains("@"),
        "SUBDOMAIN_OVERUSE": F.size(F.filter(F.split(d["subdomain"], r"\."), lambda s: s != "")) >= settings.subdomain_labels,
        "PUNYCODE_IDN": p["host"].contains("xn--"),
        "HYPHEN_OVERUSE": (F.length(label) - F.length(F.translate(label, "-", "")) >= settings.hyphens) | (F.length(label) >= settings.label_length),
        "SUSPICIOUS_TLD": d["suffix"].isin(list(dims.SUSPICIOUS_TLDS)),
        "OPEN_REDIRECT_PARAM": has_redirect_param(p, registered),
        "HOSTING_PLATFORM": hosting,
        "URL_SHORTENER": registered.isin(list(dims.SHORTENERS)),
        "SENSITIVE_PATH": sensitive & ~own_brand,
        "BRAND_IN_URL": some_brand & ~own_brand & ~F.array_contains("_brands", label),
        "FREE_HOSTING_LURE": hosting & (some_brand | sensitive),
        "DGA_LIKE": is_dga_like(label, F.col("_trusted"), settings),
    }
    return df.withColumn("_flags", F.struct(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()]))


RDAP_SCHEMA = """struct<events: array<struct<eventAction: string, eventDate: string>>,
  entities: array<struct<roles: array<string>, vcardArray: string>>>"""


def iso_time(text: Column) -> Column:
    """A timestamp of an ISO date or time; without a zone it is UTC (the session's zone); null if malformed."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(shaped, F.try_to_timestamp(text))


def registration_facts(body: Column) -> Column:
    """struct(registrar, created_date, expiry_date) of a registration document; an action that occurs twice has its last date."""

    def of(doc: Column) -> Column:
        last = lambda action: F.get(F.reverse(F.filter(doc["events"], lambda e: e["eventAction"] == action)), F.lit(0))["eventDate"]
        cards = F.filter(doc["entities"], lambda e: F.array_contains(e["roles"], "registrar"))
        entries = F.from_json(F.get_json_object(F.get(cards, F.lit(0))["vcardArray"], "$[1]"), "array<array<string>>")
        name = F.get(F.get(F.filter(entries, lambda x: F.get(x, F.lit(0)) == "fn"), F.lit(0)), F.lit(3))
        return F.struct(name.alias("registrar"), iso_time(last("registration")).alias("created_date"), iso_time(last("expiration")).alias("expiry_date"))

    return let(F.from_json(body, RDAP_SCHEMA), of)


def registrations(captures: DataFrame, now: Column, settings: Settings = SETTINGS) -> DataFrame:
    """(domain, registrar, created_date, expiry_date, domain_age_days, is_new_domain, rdap_error), one row per domain.

    Of a domain's captures the latest counts. An action that occurs twice has its last date.
    """
    latest = captures.groupBy("domain").agg(F.max_by(F.struct("body", "error"), F.struct("fetched_at", "body")).alias("_row")).select("domain", "_row.*")
    df = latest.withColumn("facts", registration_facts(F.col("body"))).select("domain", "error", "facts.*")
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("created_date")) / 86400).cast("int")
    df = df.withColumn("domain_age_days", age)
    is_new = F.coalesce(F.col("domain_age_days") < settings.new_domain_days, F.lit(False))
    return df.select("domain", "registrar", "created_date", "expiry_date", "domain_age_days", is_new.alias("is_new_domain"), F.col("error").alias("rdap_error"))


def to_refresh(domains: DataFrame, captures: DataFrame, now: Column, settings: Settings = SETTINGS) -> DataFrame:
    """The distinct domains without a capture younger than ``lookup_days``."""
    fresh = captures.where((F.col("fetched_at") > now - F.expr(f"interval {settings.lookup_days} days")) & F.col("error").isNull())
    return domains.select("domain").where("domain <> ''").distinct().join(fresh.select("domain").distinct(), "domain", "left_anti")


def weighted(signals: Column, weights: dict[str, int], cap: int) -> Column:
    """The sum of the signals' weights, at most ``cap``."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.least(F.lit(cap), F.aggregate(signals, F.lit(0), lambda acc, s: acc + F.coalesce(F.try_element_at(table, s), F.lit(0))))


def score_domains(df: DataFrame, brands: Brands | LongBrands, known: DataFrame | None = None, url: str = "url", settings: Settings = SETTINGS) -> DataFrame:
    """``df`` with ``domain``, ``domain_signals`` (in order), ``domain_score`` and, given registrations, their columns.

    The flags are written, so URLs are taken apart once. The look-alike join runs on distinct (domain, suffix) pairs, the
    registration join on the registered domain; both join back as a left join on a table with one row per key, which AQE
    broadcasts or splits if it is skewed.
    """
    rows = pattern_flags(with_facts(df, url), brands, settings)
    rows = rows.select(*df.columns, "_registered", "_flags", F.col("_d.domain").alias("_domain"), F.col("_d.suffix").alias("_suffix"))
    rows = written(rows, "flags")
    flags = [f for f in dims.DOMAIN_WEIGHTS if f not in ("TYPO_DOMAIN", "NEW_DOMAIN", "REDIRECT_CROSS_ORIGIN")]
    ip, hosting = F.col("_flags.IP_DIRECT"), F.col("_flags.HOSTING_PLATFORM")
    pairs = rows.where(~ip & ~hosting).select(F.col("_domain").alias("domain"), F.col("_suffix").alias("suffix")).distinct()
    typos = lookalikes(pairs, brands, settings).select(F.col("domain").alias("_domain"), F.col("suffix").alias("_suffix"), F.lit(True).alias("_typo"))
    rows = rows.join(typos, ["_domain", "_suffix"], "left")
    new = F.lit(False)
    extra = []
    if known is not None:
        known = known.withColumnRenamed("domain", "_rdap_domain").withColumn("_rdap_found", F.col("rdap_error").isNull())
        rows = rows.join(known, rows["_registered"] == known["_rdap_domain"], "left")
        extra = ["registrar", "created_date", "domain_age_days", "is_new_domain", "rdap_error"]
        new = F.coalesce(F.col("is_new_domain"), F.lit(False))
    met = {
        **{f: F.col(f"_flags.{f}") & ~ip for f in flags if f != "IP_DIRECT"},
        "TYPO_DOMAIN": F.coalesce(F.col("_typo"), F.lit(False)) & ~ip & ~hosting,
        "NEW_DOMAIN": new & ~ip,
    }
    array = F.array_compact(F.array(F.when(ip, F.lit("IP_DIRECT")), *[F.when(c, F.lit(n)) for n, c in met.items()]))
    rows = rows.withColumn("domain_signals", array)
    rows = rows.withColumn("domain_score", weighted(F.col("domain_signals"), settings.domain_weights, settings.domain_cap))
    rows = rows.withColumn("domain", F.col("_registered"))
    return rows.select(*df.columns, "domain", "domain_signals", "domain_score", *extra)
