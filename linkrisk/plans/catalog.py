"""The registered queries of the URL-risk jobs. Their DuckDB counterparts are in ``oracles``.

Names begin with the identifiers of the operators they cover. Results have only plain columns; arrays are joined to text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrisk.functions import html, urls
from linkrisk.functions.shared import balanced, written
from linkrisk.operators import asof, blocks, content, domain, metrics, redirects, threat, verdict
from linkrisk.operators.brands import with_words
from linkrisk.plans import oracles, verdict_sql
from linkrisk.plans.fixtures import NOW, fixture
from linkrisk.sources.feed import parse_feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = oracles.ORACLES | verdict_sql.ORACLES


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def joined(column: str, name: str | None = None):
    return F.array_join(column, "|").alias(name or column.split(".")[-1])


def now():
    return F.lit(NOW).cast("timestamp")


def requests(spark: SparkSession, d: str) -> DataFrame:
    """The requests, made once: plain and other rows are read apart, and a filter would be made of the rule again."""
    return written(fixture(spark, d, "url_inputs"), "inputs")


def normal(spark: SparkSession, d: str) -> DataFrame:
    """(analysis_id, url) of the requests that normalise. Written before the filter, which would normalise a second time."""
    rows = urls.normalised(requests(spark, d)).select("analysis_id", "norm.normalized_url", "norm.failure")
    return written(rows, "normal").where("failure is null").select("analysis_id", F.col("normalized_url").alias("url"))


def with_host(df: DataFrame) -> DataFrame:
    return df.withColumn("host", urls.host_of(F.col("url")))


def brands(spark: SparkSession) -> domain.Brands:
    return domain.brand_sets(domain.sample_brands(spark))


def long_list(spark: SparkSession, d: str) -> domain.Brands | domain.LongBrands:
    return domain.brand_list(fixture(spark, d, "brand_lines").select("line"))


def hops(spark: SparkSession, d: str) -> DataFrame:
    """The captured hops, made once: chains ask for them twice."""
    return written(fixture(spark, d, "hops"), "captured")


def gsb(spark: SparkSession, d: str) -> DataFrame:
    rows = fixture(spark, d, "safe_browsing")
    match = F.struct(F.col("threat_type"), F.lit("ANY").alias("platform_type"), F.lit("300s").alias("cache_duration"))
    return rows.select("url", "checked", "error", F.when(F.col("threat_type").isNotNull(), F.array(match)).alias("matches"))


def snapshot(spark: SparkSession, d: str) -> DataFrame:
    return threat.latest(threat.entries(fixture(spark, d, "feed")).where("not failed")).select(*threat.ENTRY)


def rdap(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "rdap").select("domain", "fetched_at", "body", "error")


def page_features(spark: SparkSession, d: str) -> DataFrame:
    return written(html.features(fixture(spark, d, "page_capture").select("page_id", "url", "html")), "features")


# URL functions


@query
def u01_u09_normalize_url(spark, d):
    rows = urls.normalised(requests(spark, d))
    return rows.select("analysis_id", F.col("norm.original_url").alias("original_url"), F.col("norm.normalized_url").alias("normalized_url"), F.col("norm.scheme_was_added").alias("scheme_was_added"), F.col("norm.failure").alias("failure"))


@query
def u03_split_url(spark, d):
    rows = requests(spark, d).withColumn("p", urls.split_url(urls.with_scheme(urls.cleaned(F.col("url")))))
    return rows.select("analysis_id", "p.scheme", "p.userinfo", "p.host", "p.port_text", "p.path", "p.params", "p.query", "p.fragment")


@query
def u10_domain_parts(spark, d):
    return with_host(normal(spark, d)).withColumn("p", urls.domain_parts(F.col("host"))).select("analysis_id", "p.subdomain", "p.domain", "p.suffix", "p.registered")


@query
def u11_u19_page_links(spark, d):
    """Each anchor of each page, resolved, and whether it leads to another site."""
    pages = html.with_every(fixture(spark, d, "page_capture").select("page_id", "url", "html"), "a")
    rows = pages.select("page_id", "url", "begin", F.posexplode(html.of_tags(F.col("page.elements"), "a", limit=None)).alias("n", "e"))
    href = html.attr(F.col("e"), "href")
    return rows.select("page_id", (F.col("begin") + F.col("n")).alias("pos"), href.alias("href"), urls.resolve(F.col("url"), href).alias("resolved"), urls.is_external(href, F.col("url")).alias("external"))


@query
def u12_https_variant(spark, d):
    return normal(spark, d).select("analysis_id", urls.https_variant(F.col("url")).alias("https_url"))


@query
def u13_url_variants(spark, d):
    return normal(spark, d).select("analysis_id", urls.url_variants(F.col("url")).alias("v")).select("analysis_id", joined("v", "variants"))


@query
def u14_match_key(spark, d):
    return normal(spark, d).select("analysis_id", urls.match_key(F.col("url")).alias("match_key"))


@query
def u15_query_params(spark, d):
    rows = normal(spark, d).select("analysis_id", F.posexplode(urls.query_params(urls.split_url(F.col("url"))["query"])).alias("pos", "p"))
    return rows.select("analysis_id", "pos", "p.k", "p.v")


@query
def u16_u17_label_statistics(spark, d):
    rows = with_host(normal(spark, d)).select(urls.domain_parts(F.col("host"))["domain"].alias("label")).distinct()
    return rows.select("label", F.round(urls.entropy(F.col("label")), 6).alias("entropy"), F.round(urls.consonant_share(F.col("label")), 6).alias("consonants"))


@query
def u18_address_tests(spark, d):
    rows = with_host(normal(spark, d)).select("host").distinct()
    h = F.col("host")
    return rows.select("host", urls.is_ip(h).alias("is_ip"), urls.is_local_ipv4(h).alias("is_local"), urls.is_blocked_host(h).alias("is_blocked"))


@query
def u18_ipv6_addresses(spark, d):
    """The class of each address, by the smallest special block that holds it; "" for what is no address."""
    rows = blocks.with_kind(fixture(spark, d, "addresses").select("address"), "address", blocks.special_blocks(spark))
    return rows.select("address", F.coalesce("kind", F.lit("")).alias("kind"))


@query
def u20_domain_changed(spark, d):
    known = redirects.answers(hops(spark, d)).where("raw_location is not null")
    rows = known.select("url", urls.resolve(F.col("url"), F.col("raw_location")).alias("target"))
    return rows.select("url", "target", urls.domain_changed(urls.host_of(F.col("url")), urls.host_of(F.col("target"))).alias("changed"))


# domain signals


@query
def h01_h14_domain_flags(spark, d):
    rows = domain.pattern_flags(domain.with_facts(requests(spark, d).select("analysis_id", urls.with_scheme(F.col("url")).alias("url"))), brands(spark))
    return rows.select("analysis_id", "_flags.*")


@query
def h15_j06_lookalikes(spark, d):
    rows = with_host(normal(spark, d)).select(urls.domain_parts(F.col("host")).alias("p")).select("p.domain", "p.suffix").distinct()
    return domain.lookalikes(rows, brands(spark))


@query
def h15_j06_f06_lookalikes_of_a_long_list(spark, d):
    rows = with_host(fixture(spark, d, "brand_requests")).select(urls.domain_parts(F.col("host")).alias("p")).select("p.domain", "p.suffix").distinct()
    return domain.lookalikes(rows, long_list(spark, d))


@query
def h12_labels_of_a_long_list(spark, d):
    """The labels within each request's URL."""
    rows = fixture(spark, d, "brand_requests").withColumn("text", domain.url_text(urls.split_url(F.col("url"))))
    found = domain.with_parts(rows.select("analysis_id", "text"), "found", F.col("text"), long_list(spark, d).url_labels)
    return found.select("analysis_id", joined("found", "labels"))


@query
def k01_words_of_a_long_list(spark, d):
    """The brand words of each request's title."""
    found = with_words(fixture(spark, d, "brand_requests").select("analysis_id", "title"), "found", F.array("title"), long_list(spark, d))
    return found.select("analysis_id", joined("found", "words"))


@query
def h18_h19_domain_score_with_a_long_list(spark, d):
    rows = domain.score_domains(fixture(spark, d, "brand_requests").select("analysis_id", "url"), long_list(spark, d))
    return rows.select("analysis_id", "domain", joined("domain_signals"), "domain_score")


@query
def h16_j07_registrations(spark, d):
    rows = domain.registrations(rdap(spark, d), now())
    return rows.select("domain", "registrar", "domain_age_days", "is_new_domain", "rdap_error")


@query
def j07_j13_s05_registrations_as_of(spark, d):
    """What was known of each request's domain at the request's time."""
    captures = fixture(spark, d, "timed_rdap")
    rows = asof.registrations_as_of(fixture(spark, d, "timed_requests").select("analysis_id", "domain", "ts"), captures)
    return rows.select("analysis_id", "domain", "registrar", "domain_age_days", "is_new_domain", "rdap_error", "lookup_due")


@query
def h18_trusted_domains(spark, d):
    rows = with_host(normal(spark, d)).select("host").distinct()
    return domain.with_trust(rows, urls.registered_or_host(F.col("host")), brands(spark)).where("_trusted").select("host")


@query
def h19_a05_domain_score(spark, d):
    rows = domain.score_domains(normal(spark, d), brands(spark))
    return rows.select("analysis_id", "domain", joined("domain_signals"), "domain_score")


@query
def h19_domain_score_with_age(spark, d):
    rows = domain.score_domains(normal(spark, d), brands(spark), domain.registrations(rdap(spark, d), now()))
    return rows.select("analysis_id", "domain", joined("domain_signals"), "domain_score", "domain_age_days")


@query
def j13_x04_domains_to_refresh(spark, d):
    rows = with_host(normal(spark, d)).select(urls.registered_or_host(F.col("host")).alias("domain"))
    return domain.to_refresh(rows, rdap(spark, d), now())


# threat lists


@query
def s02_f01_f10_feed_entries(spark, d):
    rows = threat.entries(fixture(spark, d, "feed"))
    return rows.select("line_no", "id", "url", "host", "match_key", "threat", F.array_join(threat.tag_list(F.col("tags")), "|").alias("tags"), "url_status", "date_added", "last_online", "failed")


@query
def s02_feed_lines(spark, d):
    """A feed file's lines as rows."""
    rows = parse_feed(fixture(spark, d, "feed_lines").select("line_no", "value"))
    return rows.select("line_no", "id", "dateadded", "url", "url_status", "last_online", "threat", "tags", "urlhaus_link", "reporter", "short")


@query
def w01_feed_latest(spark, d):
    return threat.latest(threat.entries(fixture(spark, d, "feed")).where("not failed")).select("id", "url", "url_status")


@query
def s03_snapshot_upsert(spark, d):
    new, _ = threat.upsert(snapshot(spark, d), fixture(spark, d, "feed_next"))
    return new.select("id", "url", "match_key", "threat", "reporter", "date_added")


@query
def a02_sync_stats(spark, d):
    return threat.upsert(snapshot(spark, d), fixture(spark, d, "feed_next"))[1]


@query
def w02_match_key_rows(spark, d):
    return threat.by_match_key(snapshot(spark, d)).select("match_key", "id", "url")


@query
def j01_j03_list_lookup(spark, d):
    rows = threat.lookup(normal(spark, d), snapshot(spark, d))
    return rows.select("url", "is_threat", "match_type", "matched_key", "threat", joined("tags"), "urlhaus_link")


@query
def j04_a06_safe_browsing(spark, d):
    rows = normal(spark, d).select(F.col("url").alias("final_url"), F.regexp_replace("url", "[?].*$", "").alias("original_url"))
    out = threat.safe_browsing(rows, gsb(spark, d))
    return out.select("final_url", "original_url", "gsb_checked", "gsb_threat", joined("gsb_types"), "gsb_error")


@query
def j05_a04_x01_merged_lists(spark, d):
    rows = normal(spark, d).select(F.col("url").alias("final_url"), F.regexp_replace("url", "[?].*$", "").alias("original_url"))
    out = threat.check(rows, snapshot(spark, d), gsb(spark, d))
    return out.select("final_url", "original_url", "is_malicious", "sources_checked", joined("threat_types"), "match_type", "matched_key")


# redirects


def starts(spark, d, captured):
    """Each URL that requests ask for is normalised once: equal ones are one row, and the filter reads what is written."""
    with balanced(spark):
        asked = written(fixture(spark, d, "url_inputs").select("url").distinct(), "asked")
        rows = written(urls.normalised(asked).select("norm.normalized_url", "norm.scheme_was_added", "norm.failure"), "normal")
        rows = rows.where("failure is null").select(F.col("normalized_url").alias("url"), "scheme_was_added").distinct()
        return redirects.preferred(written(rows, "starts"), captured)


def chains(spark, d):
    captured = hops(spark, d)
    with balanced(spark):
        return redirects.unchain(starts(spark, d, captured), captured)


@query
def j15_https_upgrade(spark, d):
    return starts(spark, d, hops(spark, d)).select("url", "scheme_was_added", "start", "upgraded")


@query
def j08_a03_redirect_chains(spark, d):
    rows = chains(spark, d)
    chain = F.array_join(F.transform("hops", lambda h: F.concat_ws(" ", h["method"], h["status_code"].cast("string"), h["url"])), "|")
    return rows.select("start", "final_url", "hop_count", chain.alias("hops"), "timed_out", "error", joined("chain_signals"))


@query
def j09_unblocked_requests(spark, d):
    return redirects.without_blocked(normal(spark, d), fixture(spark, d, "dns")).select("analysis_id", "url")


@query
def p01_w05_f11_unavailable(spark, d):
    rows = chains(spark, d)
    gone = verdict.unavailable(F.col("hops"), F.col("error"))
    return rows.select("start", gone.alias("g")).where("g is not null").select("start", "g.message", "g.status_code")


# page content


@query
def c01_c15_page_features(spark, d):
    f = page_features(spark, d).select("page_id", "features.*")
    texts = ("image_alts", "form_field_summaries", "download_links", "sensitive_field_types", "korean_lure_keywords", "public_agency_keywords")
    plain = ("title", "has_password_field", "has_password_form_external_action", "has_meta_refresh", "has_external_meta_refresh", "is_spa_shell")
    return f.select("page_id", *plain, F.round("external_link_ratio", 6).alias("external_link_ratio"), *[joined(t) for t in texts])


@query
def c09_c11_page_texts(spark, d):
    f = page_features(spark, d).select("page_id", "features.*")
    return f.select("page_id", F.size("body_text_snippets").alias("n_snippets"), F.array_join("body_text_snippets", "\n").alias("snippets"), joined("cta_texts"))


@query
def k01_k14_content_score(spark, d):
    rows = content.score_features(page_features(spark, d), brands(spark))
    return rows.select("page_id", joined("content_signals"), "content_score")


@query
def k15_rendering_queue(spark, d):
    rows = content.score_features(page_features(spark, d), brands(spark))
    return rows.where(content.wants_rendering(F.col("content_score"), F.col("features"))).select("page_id", "content_score")


@query
def k16_ai_prompts(spark, d):
    return page_features(spark, d).select("page_id", content.prompt(F.col("url"), F.col("features"), F.array(F.lit("NO_HTTPS"))).alias("prompt"))


@query
def k17_ai_answers(spark, d):
    rows = fixture(spark, d, "ai").withColumn("a", content.ai_answer(F.col("raw")))
    return rows.select("url", "a.verdict", "a.reason")


@query
def k17_ai_answer_shapes(spark, d):
    rows = fixture(spark, d, "ai_shapes").withColumn("a", content.ai_answer(F.col("raw")))
    return rows.select("answer_id", "a.verdict", "a.reason")


@query
def j10_k19_p02_fetch_classes(spark, d):
    pages = fixture(spark, d, "page_capture")
    error = content.fetch_error(pages)
    rows = pages.select("page_id", error.alias("fetch_error"))
    e = F.col("fetch_error")
    return rows.select("page_id", "fetch_error", F.when(e.isNotNull(), content.failed_score(e)).alias("score"), F.when(e.isNotNull(), content.failed_reason(e)).alias("reason"), verdict.page_unavailable(e).alias("unavailable"))


def analysed(spark, d, ai=True):
    pages = fixture(spark, d, "page_capture")
    rows = pages.select(F.col("url").alias("final_url"), F.array(F.lit("NO_HTTPS")).alias("upstream_signals"))
    return content.analyse(rows, pages, brands(spark), fixture(spark, d, "rendered"), fixture(spark, d, "ai") if ai else None, fixture(spark, d, "dns"))


@query
def j11_j12_k18_x02_x03_content_analysis(spark, d):
    rows = analysed(spark, d)
    return rows.select("final_url", "fetched", "fetch_error", joined("content_signals"), "content_score", "content_reason", "ai_verdict", "ai_reason", "rendered_used")


@query
def p14_fetch_audit(spark, d):
    pages = fixture(spark, d, "page_capture")
    rows = pages.select("page_id", "status_code", F.length("html").alias("html_length"), F.substring("html", 1, 2048).alias("preview"))
    return rows


# verdicts


def scored(spark, d, lists=True, ai=True):
    rows = requests(spark, d).select("analysis_id", "url")
    return verdict.score_urls(
        rows,
        brands(spark),
        hops(spark, d),
        fixture(spark, d, "page_capture"),
        snapshot(spark, d) if lists else None,
        gsb(spark, d) if lists else None,
        domain.registrations(rdap(spark, d), now()),
        fixture(spark, d, "rendered"),
        fixture(spark, d, "ai") if ai else None,
        fixture(spark, d, "dns"),
    )


VERDICT = ["analysis_id", "status", "failed_at_stage", "final_url", "verdict", "score", "error"]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    return rows.select(*VERDICT, "error_status", "domain_score", joined("domain_signals"), "is_malicious", joined("threat_types"), "content_score", joined("content_signals"), "hop_count", joined("chain_signals"), "summary")


@query
def p03_p09_j14_x05_verdicts(spark, d):
    return flagship(spark, d)


@query
def p08_p11_verdicts_without_lists(spark, d):
    return scored(spark, d, lists=False).select(*VERDICT, joined("upstream_signals"))


@query
def p12_verdicts_without_ai(spark, d):
    return scored(spark, d, ai=False).select(*VERDICT, "summary")


@query
def p10_reasons(spark, d):
    rows = scored(spark, d).where("status = 'succeeded'").select("analysis_id", F.posexplode("reasons").alias("pos", "r"))
    return rows.select("analysis_id", "pos", "r.code", "r.stage", "r.weight", "r.message")


@query
def p13_chains(spark, d):
    rows = scored(spark, d).where("status = 'succeeded'")
    return rows.select("analysis_id", F.array_join(verdict.chain(), "|").alias("chain"))


@query
def s07_callbacks(spark, d):
    return scored(spark, d).select("analysis_id", verdict.callback("1", now(), F.lit(0)).alias("document"))


@query
def verdict_counts(spark, d):
    rows = scored(spark, d).groupBy("status", "verdict").agg(F.count(F.lit(1)).alias("n"))
    return rows


@query
def a01_verdict_metrics(spark, d):
    return metrics.verdict_metrics(fixture(spark, d, "cases"), ["danger"], ["danger", "caution"])


@query
def s04_brand_sets(spark, d):
    """The brand labels that occur in page URLs' hosts, with their sets (the list itself is a parameter)."""
    table = domain.brand_table(domain.sample_brands(spark))
    hosts = with_host(normal(spark, d)).select(urls.domain_parts(F.col("host"))["registered"].alias("line")).distinct()
    return hosts.join(table, "line").select("line", "label", "suffix", "first_label")
