"""DuckDB SQL for page analysis and verdicts, composed of the parts in ``oracles`` and written apart from the Spark code."""

from __future__ import annotations

from linkrisk import dims
from linkrisk.dims import SETTINGS
from linkrisk.operators import content, verdict
from linkrisk.plans import oracles as o
from linkrisk.plans.fixtures import NOW, duck

TABLES = ("url_inputs", "feed", "feed_next", "hops", "safe_browsing", "rdap", "dns", "ai", "page_capture", "rendered")


def _after(text: str, start: str) -> str:
    assert text.startswith(start)
    return text[len(start) :]


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _case(value: str, values: dict[str, object], other: str) -> str:
    return f"case {value} " + " ".join(f"when {_text(k)} then {_text(v) if isinstance(v, str) else v}" for k, v in values.items()) + f" else {other} end"


BASE = duck(*TABLES)
NORM = _after(o.NORM, duck("url_inputs"))
GOOD, LABELS = _after(o.FACTS, o.NORM).split(",\nbits as", 1)
FINAL_FACTS = ",\nbits as" + LABELS.replace("from good)", "from fin)")
STARTS = _after(o.STARTS, o.FACTS + ", " + duck("hops").removeprefix("with "))
LOCAL = "regexp_matches(w.cur, '^[a-z]+://(10|127|192[.]168)[.][0-9.]+([/:?]|$)')"
assert LOCAL in o.WALK
WALK = _after(o.WALK, o.STARTS).replace(LOCAL, f"({LOCAL} or lower(regexp_extract(w.cur, '://([^/?#:]*)', 1)) in (select host from dns where regexp_matches(ip, '^(10[.]|fd)')))")
FEATURES = _after(o.FEATURES, duck("page_capture"))
SIGNALS = _after(o.SCORED, o.FEATURES)
SCORE = SETTINGS.content_weights

#: What an AI said, parsed from its JSON; null for other answers than an object with a known verdict and a text.
ANSWERS = """,
said as (select url, case when json_valid(raw) then json_extract_string(raw, '$.verdict') end verdict, case when json_valid(raw) then json_extract_string(raw, '$.reason') end reason from ai),
told as (select url, case when verdict in ('phishing', 'suspicious', 'benign') and reason is not null then verdict end ai_verdict,
  case when verdict in ('phishing', 'suspicious', 'benign') and reason is not null then substr(trim(reason), 1, 100) end ai_reason from said)"""

_REASON = _case(
    "fetch_error",
    content.REASONS,
    f"case when fetch_error like 'http_error_4%' then {_text(content.REASON_4XX)} when fetch_error like 'http_error_5%' then {_text(content.REASON_5XX)} when fetch_error = 'pipeline_timeout' then {_text(content.REASON_LATE)} else {_text(content.REASON_OTHER)} end",
)


def analysed(asked: str, ai: bool = True) -> str:
    """Content results by (url, upstream) of the rows in ``asked`` (url, upstream: a list)."""
    host = "lower(regexp_extract(url, '://([^/?#:]*)', 1))"
    strong = f"list_has_any(signals, {o._list(dims.STRONG_CONTENT_SIGNALS)}) or list_has_any(upstream, {o._list(dims.STRONG_UPSTREAM_SIGNALS)})"
    trusted = f"list_contains({o._list([*dims.SAMPLE_BRANDS, *dims.TRUSTED_DOMAINS])}, {o._reg(host)})"
    points = f"case when ai_verdict = 'phishing' then {SETTINGS.ai_phishing} when ai_verdict = 'suspicious' and (not {trusted} or {strong}) then {SETTINGS.ai_suspicious} else 0 end"
    return rf"""{ANSWERS},
ask as (select distinct url, upstream from {asked}),
seen as (select ask.url, ask.upstream, p.page_id, p.status_code, case when regexp_matches({host.replace("url", "ask.url")}, '^(10|127|192[.]168)[.][0-9.]+$') or {host.replace("url", "ask.url")} in (select host from dns where regexp_matches(ip, '^(10[.]|fd)')) then 'blocked_host'
    when coalesce(p.error, '') <> '' then p.error when p.status_code is null then 'pipeline_timeout' when p.status_code between 300 and 399 then 'unexpected_redirect' when p.status_code >= 400 then 'http_error_' || cast(p.status_code as varchar)
    when not contains(lower(coalesce(p.content_type, '')), 'text/html') then 'not_html' when greatest(coalesce(p.content_length, 0), strlen(p.html)) > {SETTINGS.page_bytes} then 'too_large' end fetch_error
  from ask left join page_capture p on p.url = ask.url),
own as (select seen.*, coalesce(r.url is not null and sig.m = 11, false) drawn, coalesce(sig.has_password_field, false) or coalesce(r.url is not null and sig.m = 11, false) password, sig.points static_points, sig.signals static_signals
  from seen left join sig on sig.page_id = seen.page_id and fetch_error is null left join rendered r on r.url = seen.url and r.error is null and fetch_error is null),
both_forms as (select *, case when fetch_error is not null then ['FETCH_FAILED'] when drawn then ['BRAND_IMPERSONATION_FORM', 'RENDERED_DOM_ANALYZED'] else static_signals end signals,
  case when fetch_error is null then case when drawn then {SCORE["BRAND_IMPERSONATION_FORM"]} else static_points end when fetch_error in ('not_html', 'too_large', 'unexpected_redirect', 'blocked_host') then 0 else {SCORE["FETCH_FAILED"]} end points from own),
heard as (select both_forms.*, {"case when fetch_error is null then ai_verdict end" if ai else "cast(null as varchar)"} ai_verdict, {"case when fetch_error is null then ai_reason end" if ai else "cast(null as varchar)"} ai_reason from both_forms left join told using (url)),
pages_done as (select url, upstream, fetch_error is null fetched, status_code, fetch_error, signals content_signals, case when fetch_error is null then least({SETTINGS.content_cap}, points + {points}) else points end content_score,
  case when fetch_error is not null then {_REASON} end content_reason, ai_verdict, ai_reason, drawn rendered_used, fetch_error is null and password password from heard)"""


LISTED = rf""",
everyone as (select final_url url from pair union select original_url from pair),
v2 as (select url, regexp_extract(url, '^(https?|ftp)', 1) s, regexp_replace(url, '^[a-z]+://([^/?#]*)([^?#]*).*$', '\1') n, regexp_replace(url, '^[a-z]+://([^/?#]*)([^?#]*).*$', '\2') p, regexp_extract(url, '([?].*)$', 1) q from everyone),
f2 as (select *, case when p = '' then '/' when p = '/' then '' when p like '%/' then regexp_replace(p, '/+$', '') else p || '/' end p2, case s when 'https' then 'http' when 'http' then 'https' end s2 from v2),
t2 as (select url, unnest(l) form, generate_subscripts(l, 1) place from (select url, list_filter([s || '://' || n || p || q, s || '://' || n || p2 || q, s2 || '://' || n || p || q, s2 || '://' || n || p2 || q], lambda x: x is not null) l from f2)),
e2 as (select t2.url, snap.url matched, threat from t2 join snap on snap.url = form qualify row_number() over (partition by t2.url order by place) = 1),
keyrow as (select match_key, arg_max(threat, id) threat from snap group by 1),
m2 as (select w.url, coalesce(e2.matched, k.match_key) matched_key, coalesce(e2.threat, k.threat) threat from (select url, {o._KEY} mk from everyone) w left join e2 using (url) left join keyrow k on k.match_key = w.mk),
asked as (select final_url, original_url, 1 pos, final_url url from pair union all select final_url, original_url, 2, original_url from pair where original_url <> final_url),
answer as (select final_url, original_url, bool_or(threat_type is not null) gsb_threat, max(threat_type) gsb_types from asked left join safe_browsing s using (url) group by 1, 2),
listed as (select final_url, original_url, gsb_threat, gsb_types, coalesce(a.matched_key, b.matched_key) is not null list_threat, list_filter([gsb_types, coalesce(a.threat, b.threat)], lambda x: coalesce(x, '') <> '') threat_types
  from answer left join m2 a on a.url = final_url left join m2 b on b.url = original_url)"""
UNLISTED = """,
listed as (select final_url, original_url, false gsb_threat, cast(null as varchar) gsb_types, false list_threat, cast([] as varchar[]) threat_types from pair)"""

_MESSAGE = _case(
    "error",
    verdict.MESSAGES,
    f"case when error like 'connection_refused%' then {_text(verdict.MESSAGE_REFUSED)} when error like 'server_error_%' then {_text(verdict.MESSAGE_5XX)} when error like 'http_error_%' then {_text(verdict.MESSAGE_HTTP)} end",
)
_CODES = "list_filter(list_transform(chain_signals, lambda s: case " + " ".join(
    f"when {'starts_with(s, ' + _text(k) + ')' if k.endswith(':') else 's = ' + _text(k)} then {_text(v)}" for k, v in verdict.REDIRECT_CODES.items()
) + " end), lambda x: x is not null)"


def _any(column: str, *names: str) -> str:
    return f"list_has_any({column}, {o._list(names)})"


_D, _C = "domain_signals", "content_signals"
_SUMMARY = f"""case when bad then {_text(verdict.KNOWN_MALICIOUS)} when coalesce(ai_reason, '') <> '' then ai_reason
  when {_any(_C, "FETCH_FAILED")} then coalesce(content_reason, {_text(verdict.UNKNOWN_PAGE)}) when {_any(_C, "SKIPPED_ALREADY_DANGER")} then coalesce(content_reason, {_text(verdict.DANGER)})
  when {_any(_C, "BRAND_IMPERSONATION_FORM")} and (password or {_any(_D, "SENSITIVE_PATH")}) then {_text(verdict.SUMMARY_LOGIN)}
  when {_any(_C, "CREDENTIAL_FORM_EXTERNAL")} then {_text(verdict.SUMMARY_EXTERNAL)} when {_any(_C, "BRAND_IMPERSONATION_FORM", "LOGO_ALT_IMPERSONATION")} then {_text(verdict.SUMMARY_BRAND)}
  when {_any(_C, "PII_COLLECTION_FORM", "SENSITIVE_ID_FIELD", "FINANCIAL_FIELD")} then {_text(verdict.SUMMARY_PRIVATE)} when {_any(_C, "RISKY_DOWNLOAD_LINK")} then {_text(verdict.SUMMARY_FILE)}
  when {_any(_C, "PUBLIC_AGENCY_LURE", "KOREAN_LURE_TEXT")} then {_text(verdict.SUMMARY_LURE)} when {_any(_D, "TYPO_DOMAIN")} then {_text(verdict.SUMMARY_TYPO)}
  when {_any(_D, "URL_USERINFO", "OPEN_REDIRECT_PARAM", "REDIRECT_CROSS_ORIGIN")} then {_text(verdict.SUMMARY_REDIRECT)} when {_any(_D, "NEW_DOMAIN", "SUSPICIOUS_TLD", "DGA_LIKE")} then {_text(verdict.SUMMARY_TRUST)}
  when coalesce(content_reason, '') <> '' then content_reason when points >= {SETTINGS.danger} then {_text(verdict.DANGER)} when points >= {SETTINGS.caution} then {_text(verdict.CAUTION)} else {_text(verdict.SAFE)} end"""


def scored(lists: bool = True, ai: bool = True) -> str:
    """The rows of ``score_urls`` in ``verdicts``."""
    upstream = "domain_signals" if lists else f"list_filter(domain_signals || {_CODES}, lambda x, i: list_position(domain_signals || {_CODES}, x) = i)"
    return (
        BASE
        + NORM
        + GOOD
        + STARTS
        + WALK
        + ",\nfin as (select distinct cur url, cur analysis_id, 0 page_id, 0 v, false added from ends)"
        + FINAL_FACTS
        + o.FLAGS
        + o.TYPOS
        + (o.SNAPSHOT if lists else "")
        + FEATURES
        + SIGNALS
        + rf""",
judged_hosts as (select url, {o._score()} from (select flags.*, age, coalesce(age < 30, false) young from flags left join rdap on rdap.domain = reg) flags left join typo on flags.domain = typo.domain and flags.suffix = typo.suffix),
chains as (select st.url normalized_url, st.added, ends.cur final_url, ends.hops, ends.error, signals || case when alive then ['max_hops_reached'] else [] end chain_signals,
  list_last(list_filter(list_transform(hops, lambda h: cast(split_part(h, ' ', 2) as int)), lambda s: s >= 400)) last_status from st join ends on ends.st = st.st and ends.upgraded = st.upgraded),
pair as (select distinct final_url, normalized_url original_url from chains)"""
        + (LISTED if lists else UNLISTED)
        + rf""",
sums as (select chains.*, gsb_threat or list_threat bad, gsb_threat, gsb_types, list_threat, threat_types, list_filter(string_split(j.domain_signals, '|'), lambda x: x <> '') own_signals, j.domain_score own_score,
  len(list_filter(chain_signals, lambda s: starts_with(s, 'cross_origin:'))) > 0 crossed,
  case when last_status = 404 then {_text(verdict.MESSAGE_404)} when last_status < 500 then {_text(verdict.MESSAGE_4XX)} when last_status >= 500 then {_text(verdict.MESSAGE_5XX)} else {_MESSAGE} end gone
  from chains join listed on listed.final_url = chains.final_url and original_url = normalized_url join judged_hosts j on j.url = chains.final_url),
led as (select *, case when bad then cast([] as varchar[]) else own_signals end || case when crossed then ['REDIRECT_CROSS_ORIGIN'] else [] end domain_signals,
  case when crossed then least({SETTINGS.domain_cap}, case when bad then 0 else own_score end + {dims.DOMAIN_WEIGHTS["REDIRECT_CROSS_ORIGIN"]}) when bad then 0 else own_score end domain_score from sums),
up as (select *, {upstream} upstream from led),
still as (select final_url url, upstream from up where not bad and gone is null)"""
        + analysed("still", ai)
        + rf""",
filled as (select up.*, gone is null and not bad and coalesce(d.fetched, false) fetched, case when gone is not null then last_status when not bad then d.status_code end content_status,
  case when gone is not null then 'page_unavailable' when bad then 'skipped_already_danger' else d.fetch_error end content_error,
  case when gone is not null then ['FETCH_FAILED'] when bad then ['SKIPPED_ALREADY_DANGER'] else d.content_signals end content_signals, case when gone is not null or bad then 0 else d.content_score end content_score,
  case when gone is not null then gone when bad then {_text(content.REASON_SKIPPED)} else d.content_reason end content_reason, d.ai_verdict, d.ai_reason, coalesce(d.password, false) password
  from up left join pages_done d on d.url = final_url and d.upstream = up.upstream and not bad and gone is null),
added_up as (select *, case when bad then {SETTINGS.total_cap} else least({SETTINGS.total_cap}, domain_score + {SETTINGS.list_weight} * (cast(gsb_threat as int) + cast(list_threat as int)) + content_score) end points from filled),
staged as (select *, case when bad or points >= {SETTINGS.caution} then null when gone is not null then 'unchain' when content_error in {tuple(verdict.UNAVAILABLE)} or content_error like 'http_error_%' then 'content_analysis' end failed_stage from added_up),
verdicts as (select n.analysis_id, n.original, case when n.failure is not null or failed_stage is not null then 'failed' else 'succeeded' end status, case when n.failure is not null then 'normalize' else failed_stage end failed_at_stage, s.final_url,
  case when failed_stage is null then case when bad or points >= {SETTINGS.danger} then 'danger' when points >= {SETTINGS.caution} then 'caution' when points is not null then 'safe' end end verdict, case when failed_stage is null then points end score,
  case when n.failure is not null then n.failure when failed_stage is not null then content_reason end error, case when failed_stage is not null then coalesce(content_status, try_cast(nullif(regexp_extract(content_error, '^(?:server|http)_error_([0-9]+)$', 1), '') as int)) end error_status,
  domain_score, domain_signals, bad, gsb_threat, gsb_types, list_threat, threat_types, content_score, content_signals, hops, chain_signals, upstream, fetched, password, ai_verdict, ai_reason, n.normalized,
  case when failed_stage is null and s.final_url is not null then {_SUMMARY} end summary
  from norm n left join staged s on n.failure is null and s.normalized_url = n.normalized and s.added = n.added)"""
    )


VERDICT = "analysis_id, status, failed_at_stage, final_url, verdict, score, error"
#: Each reason with its stage and its place: lists, domain signals, content signals, AI.
REASONS = f""",
code as (select analysis_id, 1 part, 1 i, 'GSB_MATCH' code, 2 stage, {SETTINGS.list_weight} weight, {_text(verdict.GSB_MESSAGE)} message from verdicts where status = 'succeeded' and gsb_threat
  union all select analysis_id, 2, 1, 'URLHAUS_MATCH', 2, {SETTINGS.list_weight}, {_text(verdict.LIST_MESSAGE)} from verdicts where status = 'succeeded' and list_threat
  union all select analysis_id, 3, i, s, 3, {_case("s", dict(dims.DOMAIN_WEIGHTS), "0")}, {_case("s", dict(verdict.DOMAIN_MESSAGES), "null")} from (select analysis_id, unnest(domain_signals) s, generate_subscripts(domain_signals, 1) i from verdicts where status = 'succeeded')
  union all select analysis_id, 4, i, s, 4, {_case("s", dict(dims.CONTENT_WEIGHTS), "0")}, {_case("s", dict(verdict.CONTENT_MESSAGES), "null")} from (select analysis_id, unnest(content_signals) s, generate_subscripts(content_signals, 1) i from verdicts where status = 'succeeded')
  union all select analysis_id, 5, 1, 'AI_PHISHING', 4, {SETTINGS.ai_phishing}, coalesce(ai_reason, {_text(verdict.AI_MESSAGES["AI_PHISHING"])}) from verdicts where status = 'succeeded' and ai_verdict = 'phishing'
  union all select analysis_id, 6, 1, 'AI_SUSPICIOUS', 4, {SETTINGS.ai_suspicious}, coalesce(ai_reason, {_text(verdict.AI_MESSAGES["AI_SUSPICIOUS"])}) from verdicts where status = 'succeeded' and ai_verdict = 'suspicious'),
reason as (select analysis_id, cast(row_number() over (partition by analysis_id order by part, i) - 1 as int) pos, code, stage, weight, message from code where weight > 0)"""
CHAIN = """(select case when list_contains(c, final_url) then c else list_append(c, final_url) end from (select case when len(hops) > 0 then list_transform(hops, lambda h: split_part(h, ' ', 3)) else [normalized] end c))"""
_J = "cast(to_json({}) as varchar)".format


def _field(name: str, value: str, optional: bool = False) -> str:
    """One member of a JSON object, with its comma; absent where an optional value is null."""
    made = f"""'"{name}":' || {_J(value)} || ','"""
    return f"coalesce({made}, '')" if optional else made


_STAMP = NOW.replace(" ", "T") + "Z"
_META = f"""'"engineVersion":"1","analyzedAt":"{_STAMP}","elapsedMs":0'"""
_HEAD = f"""{_field("analysisId", "v.analysis_id")} || {_field("requestId", "v.analysis_id")} || '"status":"' || status || '",' || {_field("originalUrl", "original")}"""
_DOCUMENT = f"""case when status = 'succeeded' then '{{' || {_HEAD} || {_field("finalUrl", "final_url")} || {_field("verdict", "verdict")} || {_field("score", "score")}
  || '"reasons":[' || coalesce(list_text, '') || '],"stages":{{"externalDb":{{"gsb":{{"isThreat":' || {_J("gsb_threat")} || ',"matchedTypes":' || {_J("list_filter([gsb_types], lambda x: x is not null)")} || '}},"urlhaus":{{"isThreat":' || {_J("list_threat")}
  || ',"host":' || {_J("lower(regexp_extract(final_url, '://([^/?#:]*)', 1))")} || '}}}},"unchain":{{"hops":' || {_J("len(hops)")} || ',"chain":' || {_J(CHAIN)} || '}},"domainHeuristic":{{"signals":' || {_J("domain_signals")}
  || '}},"contentAnalysis":{{"fetched":' || {_J("fetched")} || ',"hasPasswordField":' || {_J("password")} || coalesce(',"aiVerdict":' || {_J("ai_verdict")}, '') || coalesce(',"aiReason":' || {_J("ai_reason")}, '') || '}}}},' || {_field("summary", "summary")} || {_META} || '}}'
  else '{{' || {_HEAD} || '"error":{{"code":"' || case failed_at_stage when 'normalize' then 'NORMALIZE_FAILED' else 'PAGE_UNAVAILABLE' end || '","stage":' || case failed_at_stage when 'content_analysis' then '4' else '1' end
  || coalesce(',"message":' || {_J("error")}, '') || coalesce(',"statusCode":' || {_J("error_status")}, '') || '}},' || {_META} || coalesce(',"finalUrl":' || {_J("final_url")}, '') || '}}' end"""
_REASON_TEXT = f"""'{{"code":"' || code || '","stage":' || stage || ',"weight":' || weight || coalesce(',"message":' || {_J("message")}, '') || '}}'"""


def _joined(column: str) -> str:
    return f"array_to_string({column}, '|') {column}"


_FULL = scored()
_LIST = lambda c: f"""case when coalesce({c}, '') = '' then [] else string_split({c}, '|') end"""
_PROMPT = "'{' || " + " || ',' || ".join(
    f"""'"{name}":' || coalesce({_J(value)}, 'null')"""
    for name, value in {
        "final_url": "url",
        "title": "title",
        "has_password_field": "has_password_field",
        "has_password_form_external_action": "has_password_form_external_action",
        "has_meta_refresh": "has_meta_refresh",
        "has_external_meta_refresh": "has_external_meta_refresh",
        "external_link_ratio": "case when anchors = 0 then null when m = 10 then 10 / anchors else cast(0 as double) end",
        "spa_shell": "is_spa_shell",
        "image_alts": _LIST("image_alts"),
        "body_text": "snippets[1:10]",
        "form_fields": _LIST("form_field_summaries"),
        "cta_texts": "ctas[1:10]",
        "download_links": _LIST("download_links"),
        "sensitive_field_types": _LIST("sensitive_field_types"),
        "korean_lure_keywords": _LIST("korean_lure_keywords"),
        "public_agency_keywords": _LIST("public_agency_keywords"),
        "upstream_signals": "['NO_HTTPS']",
    }.items()
) + " || '}'"
_SEEN = duck("page_capture", "rendered", "ai", "dns") + FEATURES + SIGNALS + ", wish as (select url, ['NO_HTTPS'] upstream from page_capture)" + analysed("wish")

# the class of an address, from its own groups
DIGITS = r""", bare as (select distinct address, lower(split_part(trim(address, '[]'), '%', 1)) s from addresses),
dotted as (select *, case when contains(s, '.') then list_transform(string_split(regexp_extract(s, '[0-9.]+$'), '.'), lambda x: try_cast(x as int)) end o from bare),
plain as (select address, case when o is null then s when len(o) = 4 and len(list_filter(o, lambda x: x is null or x > 255)) = 0
  then case when contains(s, ':') then regexp_extract(s, '^.*:') else '::ffff:' end || printf('%02x%02x:%02x%02x', o[1], o[2], o[3], o[4]) end s from dotted),
parts as (select address, len(string_split(s, '::')) n, list_filter(string_split(string_split(s, '::')[1], ':'), lambda x: x <> '') hi,
  list_filter(string_split(coalesce(string_split(s, '::')[2], ''), ':'), lambda x: x <> '') lo from plain),
digits as (select address, case when len(list_filter(hi || lo, lambda x: not regexp_matches(x, '^[0-9a-f]{1,4}$'))) = 0 and case n when 1 then len(hi) = 8 when 2 then len(hi) + len(lo) < 8 else false end
  then array_to_string(list_transform(hi, lambda x: lpad(x, 4, '0')), '') || repeat('0000', 8 - len(hi) - len(lo)) || array_to_string(list_transform(lo, lambda x: lpad(x, 4, '0')), '') end d from parts)"""
KIND_OF_DIGITS = """case when d is null then '' when starts_with(d, '00000000000000000000ffff') then
    case when d[25:26] in ('00', '0a', '7f') or d[25:28] in ('a9fe', 'c0a8') or d[25:30] in ('c00002', 'c63364', 'cb0071') or d[25:28] between 'ac10' and 'ac1f' or d[25:28] between '6440' and '647f' or d[25:25] = 'f' then 'local'
      when d[25:25] = 'e' then 'multicast' else 'global' end
  when starts_with(d, '20010003') then 'global' when starts_with(d, 'ff') then 'multicast'
  when d[1:31] = repeat('0', 31) and d[32:32] in ('0', '1') or d[1:2] in ('fc', 'fd') or d[1:4] between 'fe80' and 'febf' or d[1:4] = '2002' or d[1:8] = '20010db8' or d[1:8] between '20010000' and '200101ff'
    or d[1:12] = '0064ff9b0001' or d[1:16] = '0100000000000000' then 'local' else 'global' end"""

_ENTITY = """list_filter(json_extract(body, '$.entities[*]'), lambda e: contains(cast(json_extract(e, '$.roles') as varchar), '"registrar"'))[1]"""
_BORN = """json_extract_string(list_last(list_filter(json_extract(body, '$.events[*]'), lambda e: json_extract_string(e, '$.eventAction') = 'registration')), '$.eventDate')"""

ORACLES: dict[str, str] = {
    "h16_j07_registrations": f"""{duck("rdap")}, r as (select domain, error, case when body is not null then json_extract_string(list_filter(json_extract({_ENTITY}, '$.vcardArray[1][*]'), lambda x: json_extract_string(x, '$[0]') = 'fn')[1], '$[3]') end registrar,
  case when body is not null then cast(date_diff('day', try_cast(substr({_BORN}, 1, 10) as date), date '{NOW[:10]}') as int) end age_days from rdap)
select domain, registrar, age_days domain_age_days, coalesce(age_days < {SETTINGS.new_domain_days}, false) is_new_domain, error rdap_error from r""",
    "u18_ipv6_addresses": f"{duck('addresses')}{DIGITS} select address, {KIND_OF_DIGITS} kind from digits",
    "s02_feed_lines": f"""{duck("feed_lines")} select line_no, case when v = 7 then '# no comment' else k end id, case v when 2 then '2024-01-02 03:04:05' when 3 then 'a' when 4 then 't' when 5 then 'a' when 6 then 't' end dateadded,
  case when v in (3, 4, 6) then url when v = 5 then '' end url, case when v in (3, 4, 6) then 'online' when v = 5 then 'offline' end url_status, case v when 3 then 'b' when 4 then '' when 5 then '' when 6 then 'N/A' end last_online,
  case v when 3 then 'c' when 4 then 'say "hi"' when 5 then '' when 6 then 'm' end threat, case v when 3 then 'x,y' when 4 then 'exe, "emotet"' when 5 then '' when 6 then 'a,b' end tags, case v when 3 then 'd' when 4 then 'l' when 5 then '' when 6 then 'l' end urlhaus_link,
  case v when 3 then 'e' when 4 then 'r' when 5 then '' when 6 then 'r' end reporter, v in (2, 7) short from feed_lines where v > 1""",
    "p03_p09_j14_x05_verdicts": f"{_FULL} select {VERDICT}, error_status, domain_score, {_joined('domain_signals')}, bad is_malicious, {_joined('threat_types')}, content_score, {_joined('content_signals')}, cast(len(hops) as int) hop_count, {_joined('chain_signals')}, summary from verdicts",
    "p08_p11_verdicts_without_lists": f"{scored(lists=False)} select {VERDICT}, array_to_string(upstream, '|') upstream_signals from verdicts",
    "p12_verdicts_without_ai": f"{scored(ai=False)} select {VERDICT}, summary from verdicts",
    "p10_reasons": f"{_FULL}{REASONS} select * from reason",
    "p13_chains": f"{_FULL} select analysis_id, array_to_string({CHAIN}, '|') chain from verdicts where status = 'succeeded'",
    "s07_callbacks": f"{_FULL}{REASONS}, texts as (select analysis_id, string_agg({_REASON_TEXT}, ',' order by pos) list_text from reason group by 1) select v.analysis_id, {_DOCUMENT} as document from verdicts v left join texts using (analysis_id)",
    "verdict_counts": f"{_FULL} select status, verdict, count(*) n from verdicts group by 1, 2",
    "j11_j12_k18_x02_x03_content_analysis": f"{_SEEN} select url final_url, fetched, fetch_error, {_joined('content_signals')}, content_score, content_reason, ai_verdict, ai_reason, rendered_used from pages_done",
    "k16_ai_prompts": f"{duck('page_capture')}{FEATURES.replace('m, snippets, ctas from h', 'm, snippets, ctas, anchors from h')} select page_id, {_PROMPT} prompt from feat",
    "k17_ai_answers": f"{duck('ai')}{ANSWERS} select url, ai_verdict verdict, ai_reason reason from told",
    "u11_u19_page_links": rf"""{duck("page_capture")}, a as (select page_id, url, unnest(l) href, generate_subscripts(l, 1) - 1 pos from (select page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) l from page_capture)),
r as (select *, case when regexp_matches(href, '^[a-z]+://') then href else {o._ORIGIN.format(u="url")} || href end resolved from a)
select page_id, cast(pos as int) pos, href, resolved, {o._reg("lower(regexp_extract(resolved, '://([^/?#:]*)', 1))")} <> {o._reg("lower(regexp_extract(url, '://([^/?#:]*)', 1))")} "external" from r""",
    "s04_brand_sets": f"""{o.FACTS}, line(line, label, suffix, first_label) as (values {", ".join(f"('{b}', '{lab}', '{suf}', '{b.split('.')[0]}')" for b, lab, suf in ((b, *((b.split('.')[0], b.split('.', 1)[1]) if b.count('.') == 1 or b.endswith('.co.kr') else (b.split('.')[1], b.split('.')[2]))) for b in dims.SAMPLE_BRANDS))})
select distinct line.* from facts join line on registered = line.line""",
}
