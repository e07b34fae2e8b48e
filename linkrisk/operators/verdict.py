"""Verdicts from the stages' results, with summaries and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrisk import dims
from linkrisk.dims import SETTINGS, Settings
from linkrisk.functions import urls
from linkrisk.functions.shared import balanced, written
from linkrisk.operators import content, redirects, threat
from linkrisk.operators.domain import Brands, score_domains

STRINGS = "cast(array() as array<string>)"
# Errors that mean a page cannot be had, and the messages for it.
UNAVAILABLE = ["dns_failure", "timeout", "connect_error", "blocked_host", "invalid_host"]
MESSAGE_404 = "페이지를 찾을 수 없습니다."
MESSAGE_4XX = "페이지 요청이 거부되었거나 찾을 수 없습니다."
MESSAGE_5XX = "대상 서버 오류로 페이지를 확인할 수 없습니다."
MESSAGES = {
    "dns_failure": "도메인 주소를 확인할 수 없습니다.",
    "timeout": "페이지 응답 시간이 초과되었습니다.",
    "connect_error": "페이지에 연결할 수 없습니다.",
    "blocked_host": "내부망 또는 차단된 호스트라 분석하지 않았습니다.",
    "invalid_host": "내부망 또는 차단된 호스트라 분석하지 않았습니다.",
}
MESSAGE_REFUSED = "페이지에 연결할 수 없습니다."
MESSAGE_HTTP = "페이지를 가져오지 못했습니다."
# Summaries, by priority.
KNOWN_MALICIOUS = "악성으로 알려진 페이지 입니다."
SAFE = "현재 분석 기준에서 뚜렷한 위험 신호가 확인되지 않았습니다."
CAUTION = "주의가 필요한 페이지입니다. 링크와 입력 정보를 한 번 더 확인하세요."
DANGER = "위험성이 높은 페이지입니다. 접속과 정보 입력을 피하세요."
UNKNOWN_PAGE = "페이지를 확인할 수 없어 안전 여부를 판단하기 어렵습니다."
SUMMARY_LOGIN = "브랜드 사칭과 로그인 정보 입력 유도 정황이 있어 비밀번호를 입력하지 마세요."
SUMMARY_EXTERNAL = "로그인 정보가 외부 주소로 전송될 수 있어 계정 정보를 입력하지 마세요."
SUMMARY_BRAND = "브랜드 사칭 정황이 있어 링크와 입력 정보를 신중히 확인하세요."
SUMMARY_PRIVATE = "민감정보 입력을 유도하는 정황이 있어 개인정보나 결제 정보를 입력하지 마세요."
SUMMARY_FILE = "위험한 파일 다운로드를 유도할 수 있어 파일을 열지 마세요."
SUMMARY_LURE = "국내 사용자 또는 공공기관을 사칭하는 유인 문구가 있어 주의하세요."
SUMMARY_TYPO = "유명 서비스와 유사한 도메인이므로 로그인이나 결제 정보를 입력하지 마세요."
SUMMARY_REDIRECT = "URL이 다른 사이트 이동이나 위장에 악용될 수 있어 접속 전 주소를 확인하세요."
SUMMARY_TRUST = "신뢰도가 낮은 도메인 특성이 있어 링크와 입력 정보를 한 번 더 확인하세요."
# Messages of reasons.
DOMAIN_MESSAGES = {
    "IP_DIRECT": "IP 주소로 직접 접근하는 URL입니다.",
    "TYPO_DOMAIN": "유명 서비스와 유사한 도메인입니다.",
    "PUNYCODE_IDN": "문자 혼동을 유도할 수 있는 국제화 도메인입니다.",
    "NEW_DOMAIN": "최근 등록된 도메인입니다.",
    "SUBDOMAIN_OVERUSE": "하위 도메인을 과도하게 사용합니다.",
    "NO_HTTPS": "HTTPS가 아닌 연결을 사용합니다.",
    "OPEN_REDIRECT_PARAM": "오픈 리다이렉트에 악용될 수 있는 파라미터가 있습니다.",
    "HYPHEN_OVERUSE": "하이픈을 과도하게 사용한 도메인입니다.",
    "SUSPICIOUS_TLD": "피싱에 자주 악용되는 최상위 도메인입니다.",
    "DGA_LIKE": "자동 생성된 것으로 의심되는 도메인입니다.",
    "HOSTING_PLATFORM": "무료 호스팅 플랫폼을 사용합니다.",
    "URL_USERINFO": "URL에 사용자 정보 형식이 포함되어 있습니다.",
    "BRAND_IN_URL": "URL에 브랜드명을 포함해 신뢰를 유도합니다.",
    "FREE_HOSTING_LURE": "무료 호스팅 주소에서 신뢰를 유도하는 문구를 사용합니다.",
    "SENSITIVE_PATH": "로그인 또는 인증 관련 경로를 사용합니다.",
    "URL_SHORTENER": "단축 URL 서비스를 사용합니다.",
    "REDIRECT_CROSS_ORIGIN": "입력 URL이 다른 사이트로 이동합니다.",
}
CONTENT_MESSAGES = {
    "BRAND_IMPERSONATION_FORM": "브랜드를 사칭하는 로그인 폼이 확인되었습니다.",
    "LOGO_ALT_IMPERSONATION": "브랜드 로고 또는 이미지 설명을 사칭합니다.",
    "CREDENTIAL_FORM_EXTERNAL": "로그인 정보가 외부 주소로 전송될 수 있습니다.",
    "PII_COLLECTION_FORM": "개인정보 입력을 유도하는 폼이 있습니다.",
    "SENSITIVE_ID_FIELD": "민감 식별정보 입력을 요구합니다.",
    "FINANCIAL_FIELD": "금융정보 입력을 요구합니다.",
    "RISKY_DOWNLOAD_LINK": "위험한 파일 다운로드를 유도합니다.",
    "PUBLIC_AGENCY_LURE": "공공기관을 사칭하는 문구가 있습니다.",
    "KOREAN_LURE_TEXT": "국내 사용자를 노린 유인 문구가 있습니다.",
    "META_REFRESH": "자동 이동 태그가 포함되어 있습니다.",
    "EXTERNAL_META_REFRESH": "외부 사이트로 자동 이동할 수 있습니다.",
    "EXTERNAL_LINK_OVERUSE": "외부 링크 비율이 높습니다.",
    "SPA_SHELL": "정적 분석만으로는 페이지 내용을 확인하기 어렵습니다.",
    "FETCH_FAILED": "페이지 내용을 가져오지 못했습니다.",
    "SKIPPED_ALREADY_DANGER": "선행 단계에서 위험성이 확인되어 콘텐츠 분석을 생략했습니다.",
}
GSB_MESSAGE = "Google Safe Browsing에 악성 URL로 등록되어 있습니다."
LIST_MESSAGE = "URLhaus에 악성 URL로 등록되어 있습니다."
AI_MESSAGES = {"AI_PHISHING": "AI가 피싱 가능성이 높다고 판단했습니다.", "AI_SUSPICIOUS": "AI가 의심스러운 페이지로 판단했습니다."}
# What redirect signals are called for the AI.
REDIRECT_CODES = {
    "cross_origin:": "REDIRECT_CROSS_ORIGIN",
    "scheme_downgrade": "REDIRECT_SCHEME_DOWNGRADE",
    "redirect_loop": "REDIRECT_LOOP",
    "max_hops_reached": "REDIRECT_MAX_HOPS_REACHED",
    "unsafe_scheme:": "REDIRECT_UNSAFE_SCHEME",
    "ssrf_blocked": "REDIRECT_SSRF_BLOCKED",
}


def status_message(status: Column) -> Column:
    return F.when(status == 404, MESSAGE_404).when(status.between(400, 499), MESSAGE_4XX).otherwise(MESSAGE_5XX)


def status_of_error(error: Column) -> Column:
    """The number in server_error_N or http_error_N."""
    return F.nullif(F.regexp_extract(error, "^(?:server|http)_error_([0-9]+)$", 1), F.lit("")).try_cast("int")


def error_message(error: Column) -> Column:
    out = F.when(error.startswith("connection_refused"), MESSAGE_REFUSED).when(error.startswith("server_error_"), MESSAGE_5XX).when(error.startswith("http_error_"), MESSAGE_HTTP)
    for code, text in MESSAGES.items():
        out = out.when(error == code, text)
    return out.otherwise("페이지를 확인할 수 없습니다.")


def unavailable(hops: Column, error: Column) -> Column:
    """struct(message, status_code) if the chain shows that the page cannot be had: its last status of 400 or more, or an error."""
    bad = F.filter(hops, lambda h: h["status_code"] >= 400)
    last = F.get(F.reverse(bad), F.lit(0))["status_code"]
    named = error.isin(UNAVAILABLE) | error.rlike("^(connection_refused|server_error_|http_error_)")
    status = status_of_error(error)
    by_error = F.when(status > 0, status_message(status)).otherwise(error_message(error))
    return F.when(last.isNotNull(), F.struct(status_message(last).alias("message"), last.alias("status_code"))).when(
        named, F.struct(by_error.alias("message"), status.alias("status_code"))
    )


def page_unavailable(error: Column) -> Column:
    """Whether a fetch error means that the page cannot be had."""
    return F.coalesce(error.isin(UNAVAILABLE) | error.startswith("http_error_"), F.lit(False))


def redirect_codes(signals: Column) -> Column:
    def code(s: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for raw, name in REDIRECT_CODES.items():
            out = out.when(s.startswith(raw) if raw.endswith(":") else s == raw, name)
        return out

    return F.array_compact(F.transform(signals, code))


def verdict(score: Column, malicious: Column, settings: Settings = SETTINGS) -> Column:
    return F.when(malicious | (score >= settings.danger), "danger").when(score >= settings.caution, "caution").otherwise("safe")


def total_score(domain_score: Column, lists: Column, content_score: Column, malicious: Column, settings: Settings = SETTINGS) -> Column:
    """All points, at most the cap; the cap itself if listed. ``lists``: how many sources list the URL."""
    return F.when(malicious, settings.total_cap).otherwise(F.least(F.lit(settings.total_cap), domain_score + settings.list_weight * lists + content_score))


def summary() -> Column:
    """One sentence by priority, from the columns of ``score_urls``."""
    d, c = F.col("domain_signals"), F.col("content_signals")
    has = lambda a, *names: F.arrays_overlap(a, F.array(*map(F.lit, names)))
    password = F.coalesce("features.has_password_field", F.lit(False))
    reason = F.col("content_reason")
    return (
        F.when(F.col("is_malicious"), KNOWN_MALICIOUS)
        .when(F.coalesce("ai_reason", F.lit("")) != "", F.col("ai_reason"))
        .when(has(c, "FETCH_FAILED"), F.coalesce(reason, F.lit(UNKNOWN_PAGE)))
        .when(has(c, "SKIPPED_ALREADY_DANGER"), F.coalesce(reason, F.lit(DANGER)))
        .when(has(c, "BRAND_IMPERSONATION_FORM") & (password | has(d, "SENSITIVE_PATH")), SUMMARY_LOGIN)
        .when(has(c, "CREDENTIAL_FORM_EXTERNAL"), SUMMARY_EXTERNAL)
        .when(has(c, "BRAND_IMPERSONATION_FORM", "LOGO_ALT_IMPERSONATION"), SUMMARY_BRAND)
        .when(has(c, "PII_COLLECTION_FORM", "SENSITIVE_ID_FIELD", "FINANCIAL_FIELD"), SUMMARY_PRIVATE)
        .when(has(c, "RISKY_DOWNLOAD_LINK"), SUMMARY_FILE)
        .when(has(c, "PUBLIC_AGENCY_LURE", "KOREAN_LURE_TEXT"), SUMMARY_LURE)
        .when(has(d, "TYPO_DOMAIN"), SUMMARY_TYPO)
        .when(has(d, "URL_USERINFO", "OPEN_REDIRECT_PARAM", "REDIRECT_CROSS_ORIGIN"), SUMMARY_REDIRECT)
        .when(has(d, "NEW_DOMAIN", "SUSPICIOUS_TLD", "DGA_LIKE"), SUMMARY_TRUST)
        .when(F.coalesce(reason, F.lit("")) != "", reason)
        .when(F.col("verdict") == "danger", DANGER)
        .when(F.col("verdict") == "caution", CAUTION)
        .otherwise(SAFE)
    )


def reasons() -> Column:
    """array<struct(code, stage, weight, message)> from the columns of ``score_urls``; codes without weight are left out."""
    s = SETTINGS
    one = lambda code, stage, weight, message: F.struct(code.alias("code"), F.lit(stage).alias("stage"), weight.alias("weight"), message.alias("message"))
    table = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    of = lambda signals, stage, weights, messages: F.transform(
        signals, lambda x: one(x, stage, F.coalesce(F.try_element_at(table(weights), x), F.lit(0)), F.try_element_at(table(messages), x))
    )
    when = lambda met, code, stage, weight, message: F.when(met, F.array(one(F.lit(code), stage, F.lit(weight), message)))
    none = F.array().cast("array<struct<code: string, stage: int, weight: int, message: string>>")
    parts = [
        when(F.col("gsb_threat"), "GSB_MATCH", 2, s.list_weight, F.lit(GSB_MESSAGE)),
        when(F.col("list_threat"), "URLHAUS_MATCH", 2, s.list_weight, F.lit(LIST_MESSAGE)),
        of(F.col("domain_signals"), 3, s.domain_weights, DOMAIN_MESSAGES),
        of(F.col("content_signals"), 4, s.content_weights, CONTENT_MESSAGES),
        when(F.col("ai_verdict") == "phishing", "AI_PHISHING", 4, s.ai_phishing, F.coalesce("ai_reason", F.lit(AI_MESSAGES["AI_PHISHING"]))),
        when(F.col("ai_verdict") == "suspicious", "AI_SUSPICIOUS", 4, s.ai_suspicious, F.coalesce("ai_reason", F.lit(AI_MESSAGES["AI_SUSPICIOUS"]))),
    ]
    return F.filter(F.concat(*[F.coalesce(p, none) for p in parts]), lambda r: r["weight"] > 0)


def chain() -> Column:
    """The hops' URLs, or the input's, with the final URL at the end if it is not among them."""
    seen = F.when(F.size("hops") > 0, F.col("hops.url")).otherwise(F.array("normalized_url"))
    return F.when(F.array_contains(seen, F.col("final_url")), seen).otherwise(F.concat(seen, F.array("final_url")))


def callback(engine: str, analyzed_at: Column, elapsed_ms: Column) -> Column:
    """The report of one row of ``score_urls`` as a JSON document with camel-case names."""
    meta = [F.lit(engine).alias("engineVersion"), F.date_format(analyzed_at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("analyzedAt"), elapsed_ms.alias("elapsedMs")]
    head = [F.col("analysis_id").alias("analysisId"), F.col("analysis_id").alias("requestId")]
    stages = F.struct(
        F.struct(
            F.struct(F.col("gsb_threat").alias("isThreat"), F.col("gsb_types").alias("matchedTypes")).alias("gsb"),
            F.struct(F.col("list_threat").alias("isThreat"), urls.host_of(F.col("final_url")).alias("host")).alias("urlhaus"),
        ).alias("externalDb"),
        F.struct(F.col("hop_count").alias("hops"), chain().alias("chain")).alias("unchain"),
        F.struct(F.col("domain_signals").alias("signals")).alias("domainHeuristic"),
        F.struct(F.col("fetched"), F.coalesce("features.has_password_field", F.lit(False)).alias("hasPasswordField"), F.col("ai_verdict").alias("aiVerdict"), F.col("ai_reason").alias("aiReason")).alias("contentAnalysis"),
    )
    good = F.to_json(
        F.struct(*head, F.lit("succeeded").alias("status"), F.col("original_url").alias("originalUrl"), F.col("final_url").alias("finalUrl"), "verdict", "score", F.col("reasons"), stages.alias("stages"), "summary", *meta)
    )
    stage_no = F.when(F.col("failed_at_stage") == "content_analysis", 4).otherwise(1)
    code = F.when(F.col("failed_at_stage") == "normalize", "NORMALIZE_FAILED").otherwise("PAGE_UNAVAILABLE")
    error = F.struct(code.alias("code"), stage_no.alias("stage"), F.col("error").alias("message"), F.col("error_status").alias("statusCode"))
    bad = F.to_json(F.struct(*head, F.lit("failed").alias("status"), F.col("original_url").alias("originalUrl"), error.alias("error"), *meta, F.col("final_url").alias("finalUrl")))
    return F.when(F.col("status") == "succeeded", good).otherwise(bad)


def score_urls(
    requests: DataFrame,
    brands: Brands,
    hops: DataFrame,
    pages: DataFrame,
    snapshot: DataFrame | None = None,
    safe_browsing: DataFrame | None = None,
    registrations: DataFrame | None = None,
    rendered: DataFrame | None = None,
    ai: DataFrame | None = None,
    dns: DataFrame | None = None,
    settings: Settings = SETTINGS,
) -> DataFrame:
    """A verdict, or a failure, for each (analysis_id, url) of ``requests``.

    Without ``snapshot`` the lists are not asked (the list-independent verdict); without ``ai`` there is none. All stages run
    on distinct URLs and are joined back, so a URL that many requests ask for is worked on once. Stages' results are written to
    the shared folder, so a lost executor repeats one stage at most and plans stay short.
    """
    with balanced(requests.sparkSession):
        return _score_urls(requests, brands, hops, pages, snapshot, safe_browsing, registrations, rendered, ai, dns, settings)


def _score_urls(requests, brands, hops, pages, snapshot, safe_browsing, registrations, rendered, ai, dns, settings) -> DataFrame:
    asked = requests.select("analysis_id", F.col("url").alias("_asked"))
    rows = urls.normalised(asked.select("_asked").distinct(), "_asked", settings)
    rows = written(rows.select("_asked", "norm.*"), "requests")
    failed = rows.where("failure is not null")
    good = rows.where("failure is null")
    distinct = good.select(F.col("normalized_url").alias("url"), "scheme_was_added").distinct()
    starts = written(redirects.preferred(distinct, hops), "starts")
    chains = starts.join(redirects.unchain(starts, hops, dns, settings), ["start", "upgraded"])
    chains = written(chains.withColumn("gone", unavailable(F.col("hops"), F.col("error"))).withColumnRenamed("url", "normalized_url"), "chains")
    domains = score_domains(chains.select(F.col("final_url").alias("url")).distinct(), brands, registrations, settings=settings)
    domains = domains.select(F.col("url").alias("final_url"), "domain", F.col("domain_signals").alias("own_signals"), F.col("domain_score").alias("own_score"))
    facts = written(chains.join(domains, "final_url"), "domains")
    if snapshot is not None:
        pairs = facts.select("final_url", F.col("normalized_url").alias("original_url"))
        found = threat.check(pairs, snapshot, safe_browsing).withColumnRenamed("original_url", "normalized_url")
        facts = facts.join(found, ["final_url", "normalized_url"])
    else:
        no, none = F.lit(False), F.lit(None).cast("string")
        facts = facts.withColumns({"is_malicious": no, "sources_checked": F.lit(0), "threat_types": F.expr(STRINGS), "gsb_threat": no, "gsb_types": F.expr(STRINGS), "list_threat": no, "match_type": none, "matched_key": none})
    crossed = redirects.crosses(F.col("chain_signals"))
    signals = F.when(F.col("is_malicious"), F.expr(STRINGS)).otherwise(F.col("own_signals"))
    score = F.when(F.col("is_malicious"), 0).otherwise(F.col("own_score"))
    weight = settings.domain_weights["REDIRECT_CROSS_ORIGIN"]
    facts = facts.withColumn("domain_signals", F.when(crossed, F.concat(signals, F.array(F.lit("REDIRECT_CROSS_ORIGIN")))).otherwise(signals))
    facts = facts.withColumn("domain_score", F.when(crossed, F.least(F.lit(settings.domain_cap), score + weight)).otherwise(score))
    upstream = F.col("domain_signals") if snapshot is not None else F.array_distinct(F.concat("domain_signals", redirect_codes(F.col("chain_signals"))))
    facts = written(facts.withColumn("upstream_signals", upstream).drop("own_signals", "own_score"), "facts")
    open_rows = facts.where(~F.col("is_malicious") & F.col("gone").isNull())
    analysed = written(content.analyse(open_rows, pages, brands, rendered, ai, dns, "final_url", settings), "content")
    facts = facts.join(analysed.withColumn("_done", F.lit(True)), ["final_url", "upstream_signals"], "left")
    listed, gone = F.col("is_malicious"), F.col("gone").isNotNull()
    pick = lambda a, b, c: F.when(gone, a).when(listed, b).otherwise(c)
    facts = facts.withColumns(
        {
            "fetched": pick(F.lit(False), F.lit(False), F.coalesce("fetched", F.lit(False))),
            "content_status": pick(F.col("gone.status_code"), F.lit(None).cast("int"), F.col("status_code")),
            "content_error": pick(F.lit("page_unavailable"), F.lit("skipped_already_danger"), F.col("fetch_error")),
            "content_signals": pick(F.array(F.lit("FETCH_FAILED")), F.array(F.lit("SKIPPED_ALREADY_DANGER")), F.col("content_signals")),
            "content_score": pick(F.lit(0), F.lit(0), F.col("content_score")),
            "content_reason": pick(F.col("gone.message"), F.lit(content.REASON_SKIPPED), F.col("content_reason")),
            "features": F.when(~gone & ~listed, F.col("features")),
            "ai_verdict": F.when(~gone & ~listed, F.col("ai_verdict")),
            "ai_reason": F.when(~gone & ~listed, F.col("ai_reason")),
        }
    )
    lists = F.col("gsb_threat").cast("int") + F.col("list_threat").cast("int")
    facts = facts.withColumn("score", total_score(F.col("domain_score"), lists, F.col("content_score"), listed, settings))
    facts = facts.withColumn("verdict", verdict(F.col("score"), listed, settings))
    lost = ~listed & (F.col("score") < settings.caution)
    stage = F.when(lost & gone, "unchain").when(lost & page_unavailable(F.col("content_error")), "content_analysis")
    facts = facts.withColumn("failed_at_stage", stage).withColumn("status", F.when(stage.isNull(), "succeeded").otherwise("failed"))
    facts = facts.withColumn("error_status", F.when(F.col("failed_at_stage").isNotNull(), F.coalesce("content_status", status_of_error(F.col("content_error")))))
    facts = facts.withColumn("chain_error", F.col("error")).withColumn("error", F.when(F.col("failed_at_stage").isNotNull(), F.col("content_reason")))
    facts = facts.withColumn("verdict", F.when(F.col("status") == "succeeded", F.col("verdict"))).withColumn("score", F.when(F.col("status") == "succeeded", F.col("score")))
    facts = facts.withColumn("summary", F.when(F.col("status") == "succeeded", summary())).withColumn("reasons", F.when(F.col("status") == "succeeded", reasons()))
    facts = facts.drop("_done", "gone", "status_code", "fetch_error", "start", "upgraded")
    out = good.drop("failure").join(facts, ["normalized_url", "scheme_was_added"])
    invalid = failed.select("_asked", "original_url", "scheme_was_added", F.lit("failed").alias("status"), F.lit("normalize").alias("failed_at_stage"), F.col("failure").alias("error"))
    out = out.unionByName(invalid, allowMissingColumns=True).withColumnRenamed("_asked", "_url")
    return asked.join(out, F.col("_asked").eqNullSafe(F.col("_url"))).drop("_asked", "_url")
