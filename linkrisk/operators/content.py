"""Content signals and scores of pages, fetch classes, rendered forms and AI results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrisk import dims
from linkrisk.dims import SETTINGS, Settings
from linkrisk.functions import html, patterns, urls
from linkrisk.functions.shared import written
from linkrisk.functions.urls import let
from linkrisk.operators.brands import Brands, LongBrands, with_trust, with_words
from linkrisk.sources.captures import newest

# Why a page was not analysed.
REASONS = {
    "http_error_404": "페이지를 찾을 수 없습니다.",
    "timeout": "페이지 응답 시간이 초과되었습니다.",
    "connect_error": "페이지에 연결할 수 없습니다.",
    "dns_failure": "도메인 주소를 확인할 수 없습니다.",
    "not_html": "분석 가능한 HTML 페이지가 아닙니다.",
    "too_large": "페이지가 너무 커서 분석하지 않았습니다.",
    "blocked_host": "내부망 또는 차단된 호스트라 분석하지 않았습니다.",
    "unexpected_redirect": "예상하지 못한 리다이렉트 응답으로 페이지를 분석하지 못했습니다.",
}
REASON_4XX = "페이지 요청이 거부되었거나 찾을 수 없습니다."
REASON_5XX = "대상 서버 오류로 페이지를 확인할 수 없습니다."
REASON_OTHER = "페이지를 가져오지 못했습니다."
REASON_SKIPPED = "위험성이 확인된 URL입니다. 페이지를 열지 않는 것이 좋습니다."
REASON_LATE = "콘텐츠 분석 시간이 초과되었습니다."
UNSCORED = ["not_html", "too_large", "unexpected_redirect", "blocked_host"]


def brands_in(texts: Column, brands: Brands) -> Column:
    """The brand labels that are words of ``texts`` (labels that are not ASCII: parts of them); the longest label wins a place."""
    return patterns.words_within(F.transform(texts, F.lower), brands.word_labels, brands.part_labels)


def score_features(df: DataFrame, brands: Brands | LongBrands, features: str = "features", url: str = "url", settings: Settings = SETTINGS) -> DataFrame:
    """``df`` with ``content_signals`` (in order) and ``content_score``."""
    f, w = F.col(features), settings.content_weights
    own = urls.domain_parts(urls.host_of(F.col(url)))["domain"]
    df, texts = df.withColumn("_own", own), {"_tb": F.array(f["title"]), "_ab": f["image_alts"]}
    if isinstance(brands, Brands):
        df = df.withColumns({name: brands_in(x, brands) for name, x in texts.items()})  # together, so by one worker
    else:
        for name, x in texts.items():
            df = with_words(df, name, x, brands)
    foreign = lambda b: (F.size(b) > 0) & ~F.array_contains(F.col(b), F.col("_own"))
    types = f["sensitive_field_types"]
    has = lambda *names: F.arrays_overlap(types, F.array(*[F.lit(n) for n in names]))
    pii, money, ident = has("resident_registration_number", "phone", "otp"), has("card", "cvc", "account"), has("resident_registration_number", "otp")
    lure, agency, risky = F.size(f["korean_lure_keywords"]) > 0, F.size(f["public_agency_keywords"]) > 0, F.size(f["download_links"]) > 0
    rules = [
        ("SPA_SHELL", f["is_spa_shell"], None),
        ("BRAND_IMPERSONATION_FORM", f["has_password_field"] & foreign("_tb"), None),
        ("CREDENTIAL_FORM_EXTERNAL", f["has_password_form_external_action"], None),
        ("KOREAN_LURE_TEXT", lure, lure & (pii | money | risky)),
        ("PUBLIC_AGENCY_LURE", agency, agency & pii),
        ("PII_COLLECTION_FORM", pii, None),
        ("SENSITIVE_ID_FIELD", ident, None),
        ("FINANCIAL_FIELD", money, None),
        ("RISKY_DOWNLOAD_LINK", risky, None),
        ("LOGO_ALT_IMPERSONATION", foreign("_ab"), None),
        ("META_REFRESH", f["has_meta_refresh"], None),
        ("EXTERNAL_META_REFRESH", f["has_meta_refresh"] & f["has_external_meta_refresh"], None),
        ("EXTERNAL_LINK_OVERUSE", F.coalesce(f["external_link_ratio"] >= settings.external_links, F.lit(False)), None),
    ]
    signals = F.array_compact(F.array(*[F.when(met, F.lit(name)) for name, met, _ in rules]))
    points = F.lit(0)
    for name, met, earns in rules:
        points = points + F.when(met if earns is None else earns, w.get(name, 0)).otherwise(0)
    return df.withColumn("content_signals", signals).withColumn("content_score", F.least(F.lit(settings.content_cap), points)).drop("_own", "_tb", "_ab")


def wants_rendering(score: Column, f: Column, settings: Settings = SETTINGS) -> Column:
    """Pages whose rendered form may change the verdict."""
    some = [F.size(f[x]) > 0 for x in ("download_links", "sensitive_field_types", "korean_lure_keywords", "public_agency_keywords")]
    return (score < settings.danger) & (f["is_spa_shell"] | (score >= settings.precision_score) | some[0] | some[1] | some[2] | some[3])


def fetch_error(df: DataFrame, blocked: Column | None = None, settings: Settings = SETTINGS) -> Column:
    """The class of a page capture's failure, null if the page can be read; a missing capture is ``pipeline_timeout``."""
    status, kind = F.col("status_code"), F.lower(F.coalesce("content_type", F.lit("")))
    size = F.greatest(F.coalesce("content_length", F.lit(0)), F.coalesce(F.octet_length("html"), F.lit(0)))
    host = urls.is_blocked_host(urls.host_of(F.col("url")))
    return (
        F.when(host | F.coalesce(blocked if blocked is not None else F.lit(False), F.lit(False)), "blocked_host")
        .when(F.coalesce(F.col("error"), F.lit("")) != "", F.col("error"))
        .when(status.isNull(), "pipeline_timeout")
        .when(status.between(300, 399), "unexpected_redirect")
        .when(status >= 400, F.concat(F.lit("http_error_"), status.cast("string")))
        .when(~kind.contains("text/html"), "not_html")
        .when(size > settings.page_bytes, "too_large")
    )


def failed_score(error: Column, settings: Settings = SETTINGS) -> Column:
    return F.when(error.isin(UNSCORED), 0).otherwise(settings.content_weights["FETCH_FAILED"])


def failed_reason(error: Column) -> Column:
    out = F.when(error == "http_error_404", REASONS["http_error_404"]).when(error.startswith("http_error_4"), REASON_4XX).when(error.startswith("http_error_5"), REASON_5XX)
    out = out.when(error == "pipeline_timeout", REASON_LATE)
    for code, text in REASONS.items():
        out = out.when(error == code, text)
    return out.otherwise(REASON_OTHER)


AI = "struct<verdict: string, reason: string>"


def ai_answer(raw: Column) -> Column:
    """struct(verdict, reason) of an AI's JSON answer; null if it is no object, lacks text or has an unknown verdict.

    Both keys are read as variants, which know their type: of a repeated key the last counts, a nested one is none, and a
    number is no text. Read within brackets, an answer with anything behind its object is malformed.
    """
    read = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<struct<verdict: variant, reason: variant>>", {"allowSingleQuotes": "false"})

    def text(x: Column) -> Column:
        return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))

    def of(a: Column) -> Column:
        first = F.get(a, F.lit(0))
        good = (F.size(a) == 1) & text(first["verdict"]).isin("phishing", "suspicious", "benign") & text(first["reason"]).isNotNull()
        return F.when(good, F.struct(text(first["verdict"]).alias("verdict"), F.substring(urls.stripped(text(first["reason"])), 1, 100).alias("reason")))

    return let(read, of)


def ai_points(verdict: Column, trusted: Column, signals: Column, upstream: Column, settings: Settings = SETTINGS) -> Column:
    """Points of an AI verdict; suspicious counts on a trusted domain only beside a strong signal."""
    strong = F.arrays_overlap(signals, F.array(*map(F.lit, dims.STRONG_CONTENT_SIGNALS))) | F.arrays_overlap(upstream, F.array(*map(F.lit, dims.STRONG_UPSTREAM_SIGNALS)))
    return F.when(verdict == "phishing", settings.ai_phishing).when((verdict == "suspicious") & (~trusted | strong), settings.ai_suspicious).otherwise(0)


def prompt(url: Column, f: Column, upstream: Column) -> Column:
    """The JSON document that an AI is asked with; lists cut to 10, 10, 20, 10 and 10."""
    plain = ["title", "has_password_field", "has_password_form_external_action", "has_meta_refresh", "has_external_meta_refresh", "external_link_ratio"]
    cut = {"image_alts": ("image_alts", 10), "body_text": ("body_text_snippets", 10), "form_fields": ("form_field_summaries", 20), "cta_texts": ("cta_texts", 10), "download_links": ("download_links", 10)}
    rest = ["sensitive_field_types", "korean_lure_keywords", "public_agency_keywords"]
    columns = [url.alias("final_url"), *[f[x].alias(x) for x in plain], f["is_spa_shell"].alias("spa_shell")]
    columns += [F.slice(f[x], 1, n).alias(name) for name, (x, n) in cut.items()] + [f[x].alias(x) for x in rest] + [upstream.alias("upstream_signals")]
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def fetched_pages(df: DataFrame, pages: DataFrame, dns: DataFrame | None = None, url: str = "final_url") -> DataFrame:
    """``df`` left-joined with the page captures on ``url``: ``html`` (null if unreadable), ``status_code``, ``fetch_error``.

    Captures meet the distinct URLs first, so a page is sent once however many rows ask for it.
    """
    asked = df.select(F.col(url).alias("url")).where("url is not null").distinct()
    one = newest(pages.join(asked, "url", "left_semi"), "url")
    wanted = asked.join(one.drop("page_id", "fetched_at"), "url", "left")
    blocked = None
    if dns is not None:
        from linkrisk.operators.redirects import unsafe_hosts

        hosts = unsafe_hosts(dns).withColumnRenamed("host", "_h")
        wanted = wanted.withColumn("_h", urls.host_of(F.col("url"))).join(hosts, "_h", "left").drop("_h")
        blocked = F.col("blocked")
    wanted = wanted.withColumn("fetch_error", fetch_error(wanted, blocked))
    return wanted.select("url", "status_code", "fetch_error", F.when(F.col("fetch_error").isNull(), F.col("html")).alias("html"))


def analyse(
    rows: DataFrame,
    pages: DataFrame,
    brands: Brands,
    rendered: DataFrame | None = None,
    ai: DataFrame | None = None,
    dns: DataFrame | None = None,
    url: str = "final_url",
    settings: Settings = SETTINGS,
) -> DataFrame:
    """Content result per distinct (``url``, ``upstream_signals``) of ``rows``.

    Columns: fetched, status_code, fetch_error, features, content_signals, content_score, content_reason, ai_verdict,
    ai_reason, rendered_used. HTML is parsed once per URL and dropped before any further join; titles and alts are searched for
    brands once, and again only where a rendered form changes them.
    """
    got = html.features(fetched_pages(rows, pages, dns, url), "html", "url")
    got = written(score_features(got, brands, settings=settings), "features")
    ok = F.col("fetch_error").isNull()
    if rendered is not None:
        queue = got.where(ok & wants_rendering(F.col("content_score"), F.col("features"), settings))
        forms = newest(rendered.where("error is null").join(queue.select("url"), "url", "left_semi"), "url").select("url", "html")
        forms = html.features(forms, "html", "url", "rendered")
        # only pages with a rendered form are scored again
        again = got.join(forms, "url").withColumn("features", html.merged(F.col("features"), F.col("rendered")))
        again = score_features(again.drop("rendered", "content_signals", "content_score"), brands, settings=settings)
        again = written(again.withColumn("content_signals", F.concat("content_signals", F.array(F.lit("RENDERED_DOM_ANALYZED")))), "rendered")
        used = lambda df, x: df.withColumn("rendered_used", F.lit(x))
        got = used(got.join(again.select("url"), "url", "left_anti"), False).unionByName(used(again, True))
    else:
        got = got.withColumn("rendered_used", F.lit(False))
    out = rows.select(F.col(url).alias("url"), "upstream_signals").distinct().join(got, "url", "left")
    if ai is not None:
        answers = newest(ai, "url").select("url", ai_answer(F.col("raw")).alias("_ai"))
        out = out.join(answers, "url", "left")
    else:
        out = out.withColumn("_ai", F.lit(None).cast(AI))
    out = with_trust(out, urls.registered_or_host(urls.host_of(F.col("url"))), brands)
    points = ai_points(F.col("_ai.verdict"), F.col("_trusted"), F.col("content_signals"), F.col("upstream_signals"), settings)
    total = F.least(F.lit(settings.content_cap), F.col("content_score") + F.coalesce(points, F.lit(0)))
    error = F.col("fetch_error")
    return out.select(
        F.col("url").alias(url),
        "upstream_signals",
        error.isNull().alias("fetched"),
        "status_code",
        error.alias("fetch_error"),
        F.when(error.isNull(), F.col("features")).alias("features"),
        F.when(error.isNull(), F.col("content_signals")).otherwise(F.array(F.lit("FETCH_FAILED"))).alias("content_signals"),
        F.when(error.isNull(), total).otherwise(failed_score(error, settings)).alias("content_score"),
        F.when(error.isNotNull(), failed_reason(error)).alias("content_reason"),
        F.when(error.isNull(), F.col("_ai.verdict")).alias("ai_verdict"),
        F.when(error.isNull(), F.col("_ai.reason")).alias("ai_reason"),
        "rendered_used",
    )
