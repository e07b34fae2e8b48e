"""DuckDB SQL for the registered queries, written apart from the Spark code."""

from __future__ import annotations

from linkrisk import dims
from linkrisk.plans.fixtures import duck


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _split(u: str) -> str:
    """Columns scheme, netloc, rest and query of a URL expression."""
    return rf"""lower(regexp_extract({u}, '^([a-zA-Z][a-zA-Z0-9+.\-]*):', 1)) scheme, regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1) netloc,
  regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.\-]*:(?://[^/?#]*)?([^?#]*)', 1) rest, regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1) query, regexp_extract({u}, '#(.*)$', 1) fragment"""


def _pct(x: str) -> str:
    return rf"""array_to_string(list_transform(string_split({x}, '%'), lambda s, i: case when i = 1 then s
  when regexp_matches(s, '^[0-9A-Fa-f][0-9A-Fa-f]') then case when regexp_matches(chr(cast('0x' || s[1:2] as int)), '^[A-Za-z0-9._~-]$') then chr(cast('0x' || s[1:2] as int)) else '%' || upper(s[1:2]) end || s[3:]
  else '%' || s end), '')"""


# requests: split, checked, normalised
NORM = (
    duck("url_inputs")
    + rf""",
raw as (select analysis_id, page_id, v, trim(url) original, case when regexp_matches(trim(url), '^[a-zA-Z][a-zA-Z0-9+.\-]*://') then trim(url) else 'http://' || trim(url) end u,
  not regexp_matches(trim(url), '^[a-zA-Z][a-zA-Z0-9+.\-]*://') added from url_inputs),
cut as (select *, {_split("u")} from raw),
parts as (select *, lower(regexp_extract(regexp_replace(netloc, '^.*@', ''), '^([^:]*)', 1)) host,
  case when contains(netloc, '@') then regexp_replace(netloc, '@[^@]*$', '') end userinfo,
  case when regexp_matches(regexp_replace(netloc, '^.*@', ''), ':') then regexp_extract(regexp_replace(netloc, '^.*@', ''), '^[^:]*:(.*)$', 1) end port_text,
  case when regexp_matches(rest, ';[^/]*$') then regexp_replace(rest, '^(.*/[^/;]*);.*$', '\1') else rest end path,
  case when regexp_matches(rest, ';[^/]*$') then regexp_extract(rest, '^.*/[^/;]*;(.*)$', 1) else '' end params from cut),
judged as (select *, case when original = '' then 'empty_url' when length(u) > 1024 then 'too_long' when scheme not in ('http', 'https', 'ftp') then 'bad_scheme'
  when contains(netloc, '[') then 'ipv6_host' when host = '' then 'empty_host' when port_text <> '' and (try_cast(port_text as int) is null or try_cast(port_text as int) > 65535) then 'bad_port' end failure from parts),
squeezed as (select *, regexp_replace({_pct("case when path = '' then '/' else path end")}, '/+', '/', 'g') p1 from judged),
dotted as (select *, list_reduce(list_prepend(cast([] as varchar[]), list_transform(string_split(p1, '/'), lambda s: [s])),
  lambda a, s: case when s[1] = '.' then a when s[1] = '..' then case when len(a) > 0 and a[len(a)] <> '' then a[1:len(a) - 1] else a end else list_concat(a, s) end) segs from squeezed),
norm as (select *, case when failure is null then scheme || '://' || host || case when coalesce(port_text, '') = '' or try_cast(port_text as int) = case scheme when 'http' then 80 when 'https' then 443 else 21 end then '' else ':' || cast(try_cast(port_text as int) as varchar) end
  || coalesce(nullif(array_to_string(case when len(segs) = 0 or segs[1] <> '' then list_prepend('', segs) else segs end, '/'), ''), '/')
  || case when params <> '' then ';' || {_pct("params")} else '' end || case when query <> '' then '?' || {_pct("query")} else '' end end normalized from dotted)"""
)
# hosts of normalised requests by label
FACTS = (
    NORM
    + rf""",
good as (select analysis_id, page_id, v, added, normalized url from norm where failure is null),
bits as (select *, {_split("url")} from good),
labels as (select *, lower(case when contains(netloc, '[') then regexp_extract(netloc, '\[([^\]]*)\]', 1) else regexp_extract(regexp_replace(netloc, '^.*@', ''), '^([^:]*)', 1) end) host from bits),
lab as (select *, list_filter(string_split(host, '.'), lambda x: x <> '') l from labels),
suf as (select *, case when len(l) < 2 then 0 when len(l) > 2 and list_contains({_list(dims.TWO_LABEL_SUFFIXES)}, l[len(l) - 1] || '.' || l[len(l)]) then 2 else 1 end k from lab),
facts as (select *, array_to_string(l[1 : len(l) - k - 1], '.') subdomain, coalesce(l[len(l) - k], '') as domain, array_to_string(l[len(l) - k + 1 : len(l)], '.') suffix,
  case when k > 0 then l[len(l) - k] || '.' || array_to_string(l[len(l) - k + 1 : len(l)], '.') else '' end registered from suf)"""
)
_BRANDS = _list(dims.SAMPLE_BRANDS)
_FIRST = sorted({b.split(".")[0] for b in dims.SAMPLE_BRANDS if len(b.split(".")[0]) >= 3 and b.split(".")[0] not in dims.GENERIC_LABELS} | set(dims.SEEDED_LABELS))
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = rf"regexp_matches(host, '^{_OCTET}(\.{_OCTET}){{3}}$')"
_LETTERS = "regexp_replace(lower(domain), '[^\\p{L}]', '', 'g')"
_PARAMS = """list_filter(list_transform(list_filter(string_split(query, '&'), lambda s: s <> ''), lambda s: {'k': url_decode(replace(split_part(s, '=', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(s, '^[^=]*=(.*)$', 1), '+', ' '))}), lambda p: true)"""


def _reg(host: str) -> str:
    """The registered domain of a host expression without rare suffixes (as the derived tables have)."""
    return rf"""case when list_contains({_list(dims.TWO_LABEL_SUFFIXES)}, regexp_extract({host}, '([^.]+[.][^.]+)$', 1)) and length({host}) - length(replace({host}, '.', '')) > 1
  then regexp_extract({host}, '([^.]+[.][^.]+[.][^.]+)$', 1) when contains({host}, '.') then regexp_extract({host}, '([^.]+[.][^.]+)$', 1) else {host} end"""


_ENTROPY = """-list_sum(list_transform(list_distinct(string_split(domain, '')), lambda c: (length(domain) - length(replace(domain, c, ''))) / length(domain) * log2((length(domain) - length(replace(domain, c, ''))) / length(domain))))"""
_CONSONANTS = f"case when {_LETTERS} = '' then 0.0 else length(regexp_replace({_LETTERS}, '[^bcdfghjklmnpqrstvwxyz]', '', 'g')) / length({_LETTERS}) end"

# one boolean for each lexical signal
FLAGS = rf""",
text as (select *, lower(host || case when path0 <> '' then ' ' || path0 else '' end || case when query <> '' then ' ' || query else '' end) t
  from (select *, case when regexp_matches(rest, ';[^/]*$') then regexp_replace(rest, '^(.*/[^/;]*);.*$', '\1') else rest end path0, coalesce(nullif(registered, ''), host) reg from facts)),
pre as (select *, list_filter({_list(_FIRST)}, lambda b: contains(t, b)) found, list_has_any(regexp_extract_all(t, '[a-z]+'), {_list(dims.SENSITIVE_TOKENS)}) sensitive,
  list_contains({_BRANDS}, reg) own, suffix <> '' and (list_contains({_list(dims.HOSTING_PLATFORMS)}, suffix) or (subdomain <> '' and list_contains({_list(dims.HOSTING_PLATFORMS)}, domain || '.' || suffix))) hosting from text),
targets as (select analysis_id, bool_or(not regexp_matches(lower(p.v), '^https?://[^/?#]') or {_reg("lower(regexp_extract(p.v, '://([^/?#:]*)', 1))")} <> reg) bad
  from (select analysis_id, reg, unnest({_PARAMS}) p from pre where query <> '') where list_contains({_list(dims.REDIRECT_PARAMS)}, lower(p.k)) group by 1),
flags as (select pre.*, {_IP} or contains(host, ':') IP_DIRECT, scheme = 'http' NO_HTTPS, contains(netloc, '@') URL_USERINFO,
  len(list_filter(string_split(subdomain, '.'), lambda s: s <> '')) >= 4 SUBDOMAIN_OVERUSE, contains(host, 'xn--') PUNYCODE_IDN,
  length(domain) - length(replace(domain, '-', '')) >= 3 or length(domain) >= 20 HYPHEN_OVERUSE, list_contains({_list(dims.SUSPICIOUS_TLDS)}, suffix) SUSPICIOUS_TLD,
  coalesce(bad, false) OPEN_REDIRECT_PARAM, hosting HOSTING_PLATFORM, list_contains({_list(dims.SHORTENERS)}, reg) URL_SHORTENER, sensitive and not own SENSITIVE_PATH,
  len(found) > 0 and not own and not list_contains(found, domain) BRAND_IN_URL, hosting and (len(found) > 0 or sensitive) FREE_HOSTING_LURE,
  length(domain) >= 8 and not list_contains({_list([*dims.SAMPLE_BRANDS, *dims.TRUSTED_DOMAINS])}, reg) and ({_ENTROPY} >= 3.5 or {_CONSONANTS} >= 0.8) DGA_LIKE
  from pre left join targets using (analysis_id))"""
_NAMES = [n for n in dims.DOMAIN_WEIGHTS if n not in ("TYPO_DOMAIN", "NEW_DOMAIN", "REDIRECT_CROSS_ORIGIN")]

_PAIRS = ", ".join(f"('{b.split('.', 1)[0] if b.count('.') == 1 or b.endswith('.co.kr') else b.split('.', 1)[1].split('.')[0]}', '{b.split('.', 1)[1] if b.count('.') == 1 or b.endswith('.co.kr') else b.rsplit('.', 1)[1]}')" for b in dims.SAMPLE_BRANDS)
TYPOS = rf""",
brand(b, bs) as (select distinct * from (values {_PAIRS})),
typo as (select domain, suffix from (select domain, suffix, b, bs, levenshtein(domain, b) dist from (select distinct domain, suffix from facts where suffix <> '') cross join brand)
  group by domain, suffix having not bool_or(dist = 0 and suffix = bs)
  and bool_or((suffix = bs or list_contains({_list(dims.LOOKALIKE_SUFFIXES)}, suffix)) and ((dist = 0 and suffix <> bs) or (dist between 1 and 2 and least(length(domain), length(b)) >= 5)))
  and not list_contains({_list(dims.HOSTING_PLATFORMS)}, domain || '.' || suffix))"""


def _score(extra: str = "") -> str:
    terms = " + ".join(f"case when {n} and (not IP_DIRECT or '{n}' = 'IP_DIRECT') then {dims.DOMAIN_WEIGHTS[n]} else 0 end" for n in _NAMES)
    names = ", ".join(f"case when {n} and (not IP_DIRECT or '{n}' = 'IP_DIRECT') then '{n}' end" for n in _NAMES)
    typo = "(typo.domain is not null and not IP_DIRECT and not HOSTING_PLATFORM)"
    new = "(coalesce(young, false) and not IP_DIRECT)"
    return f"""array_to_string(list_filter([{names}, case when {typo} then 'TYPO_DOMAIN' end, case when {new} then 'NEW_DOMAIN' end], lambda x: x is not null), '|') domain_signals,
  least(80, {terms} + case when {typo} then 30 else 0 end + case when {new} then 25 else 0 end) domain_score"""


_AGES = duck("rdap").replace("with ", ", ", 1)
_KEY = rf"""case when lower(regexp_extract(url, '://([^/?#:]*)', 1)) = '' then null
  when list_contains({_list(dims.MULTITENANT_HOSTS)}, lower(regexp_extract(url, '://([^/?#:]*)', 1))) then nullif(lower(regexp_extract(url, '://([^/?#:]*)', 1)) || regexp_extract(url, '://[^/?#]*(/[^/?#]+/[^/?#]+)', 1), lower(regexp_extract(url, '://([^/?#:]*)', 1)))
  else lower(regexp_extract(url, '://([^/?#:]*)', 1)) end"""
_TIME = "try_cast(nullif(replace({c}, ' UTC', ''), '') as timestamp)"


def _entries(table: str, name: str) -> str:
    return f"""{name} as (select line_no, try_cast(id as bigint) id, url, lower(regexp_extract(url, '://([^/?#:]*)', 1)) host, {_KEY} match_key, nullif(threat, '') threat, nullif(tags, '') tags, url_status,
  {_TIME.format(c="dateadded")} date_added, {_TIME.format(c="last_online")} last_online, urlhaus_link, reporter, try_cast(id as bigint) is null or url = '' or {_KEY} is null failed from {table})"""


SNAPSHOT = f""", {_entries("feed", "entry")},
snap as (select * from entry where not failed qualify row_number() over (partition by id order by line_no desc) = 1)"""
NEXT = f""", {_entries("feed_next", "entry2")},
batch as (select * from entry2 where not failed qualify row_number() over (partition by id order by line_no desc) = 1)"""
_TAGS = "array_to_string(list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda t: trim(t)), lambda t: t <> ''), '|')"
_ALL = duck("url_inputs", "feed", "feed_next", "safe_browsing")


def _with_feed(base: str) -> str:
    """``base`` (which has url_inputs) and the feed tables."""
    rest = duck("feed", "feed_next").split("feed as (", 1)[1]
    return f"{base}, feed as ({rest}"


# each URL's variants with their places
VARIANTS = r""",
vp as (select distinct url, regexp_extract(url, '^(https?|ftp)', 1) s, regexp_replace(url, '^[a-z]+://([^/?#]*)([^?#]*).*$', '\1') n, regexp_replace(url, '^[a-z]+://([^/?#]*)([^?#]*).*$', '\2') p, regexp_extract(url, '([?].*)$', 1) q from good),
forms as (select url, s, n, p, q, case when p = '' then '/' when p = '/' then '' when p like '%/' then regexp_replace(p, '/+$', '') else p || '/' end p2, case s when 'https' then 'http' when 'http' then 'https' end s2 from vp),
variant as (select url, list_filter([s || '://' || n || p || q, s || '://' || n || p2 || q, s2 || '://' || n || p || q, s2 || '://' || n || p2 || q], lambda x: x is not null) l from forms)"""
LOOKUP = (
    VARIANTS
    + rf""",
tried as (select url, unnest(l) form, generate_subscripts(l, 1) place from variant),
exact as (select tried.url, snap.url matched, threat, tags, urlhaus_link from tried join snap on snap.url = form qualify row_number() over (partition by tried.url order by place) = 1),
keyrow as (select match_key, arg_max(threat, id) threat, arg_max(tags, id) tags, arg_max(urlhaus_link, id) urlhaus_link, max(id) id, arg_max(url, id) url from snap group by 1),
found as (select g.url, e.matched is not null or k.match_key is not null is_threat, case when e.matched is not null then 'url' when k.match_key like '%/%' then 'host_path' when k.match_key is not null then 'host' end match_type,
  coalesce(e.matched, k.match_key) matched_key, case when e.matched is not null then e.threat else k.threat end threat, case when e.matched is not null then e.tags else k.tags end tags, case when e.matched is not null then e.urlhaus_link else k.urlhaus_link end urlhaus_link
  from (select distinct url, {_KEY} mk from good) g left join exact e on e.url = g.url left join keyrow k on k.match_key = g.mk)"""
)
FEED_BASE = _with_feed(FACTS) + SNAPSHOT
GSB = duck("safe_browsing").replace("with ", ", ", 1)
_GSB = r""",
pair as (select distinct url final_url, regexp_replace(url, '[?].*$', '') original_url from good),
asked as (select final_url, original_url, 1 pos, final_url url from pair union all select final_url, original_url, 2, original_url from pair where original_url <> final_url),
answer as (select final_url, original_url, bool_or(coalesce(checked, false)) gsb_checked, bool_or(threat_type is not null) gsb_threat, max(threat_type) types, arg_min(error, pos) filter (error is not null) err
  from asked left join safe_browsing s using (url) group by 1, 2)"""
_LINE = lambda c: f"coalesce({c}, '')"

_CAP = duck("page_capture")
_BASE_HOST = "lower(regexp_extract(url, '://([^/?#:]*)', 1))"
_ENTITIES = """replace(replace(replace(replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&')"""
_SNIP = "rtrim(substr(trim(regexp_replace({x}, '\\s+', ' ', 'g')), 1, 180))"
# the injected fragments have a fixed shape, so features follow from the page's number, its anchors and its texts
FEATURES = (
    _CAP
    + rf""",
f as (select page_id, page_id % 12 m, url, html, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) raw_title,
  list_filter(string_split(regexp_replace(regexp_replace(html, '(?s)^.*<body>', ''), '(?s)<[^>]*>', chr(1), 'g'), chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> '') nodes from page_capture),
g as (select *, nullif({_ENTITIES.format(x="raw_title")}, '') title, len(regexp_extract_all(html, '<a href="[^"]+"')) anchors,
  list_transform(nodes, lambda x: {_SNIP.format(x=_ENTITIES.format(x="x"))}) texts, list_transform(regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1), lambda x: {_SNIP.format(x=_ENTITIES.format(x="x"))}) links from f),
h as (select *, list_filter(texts, lambda x, i: list_position(texts, x) = i)[1:40] snippets, list_filter(links, lambda x, i: x <> '' and list_position(links, x) = i)[1:40] ctas from g),
feat as (select page_id, url, title, m in (1, 2) has_password_field, m = 1 has_password_form_external_action, m in (4, 5) has_meta_refresh, m = 4 has_external_meta_refresh, m = 11 is_spa_shell,
  round(case when anchors = 0 then null when m = 10 then 10 / anchors else 0 end, 6) external_link_ratio, case when m = 3 then 'NAVER' else '' end image_alts,
  case m when 1 then 'name=id|name=pw type=password' when 2 then 'name=pw type=password' when 6 then 'label=주민번호 name=rrn id=r|label=휴대폰 name=mobile' when 7 then 'name=card_number placeholder=카드번호|name=cvc' else '' end form_field_summaries,
  case m when 8 then regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/app.apk' when 9 then regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/payload.js' else '' end download_links,
  case m when 6 then 'resident_registration_number|phone' when 7 then 'card|cvc' else '' end sensitive_field_types,
  case when m = 8 then '택배' when m = 6 and list_contains(snippets, '국민건강보험 안내') then '건강보험' else '' end korean_lure_keywords,
  case when m = 6 and list_contains(snippets, '국민건강보험 안내') then '국민건강보험|건강보험' else '' end public_agency_keywords, m, snippets, ctas from h)"""
)
SCORED = (
    FEATURES
    + r""",
sig as (select *, case when m = 11 then ['SPA_SHELL'] when m = 1 then ['BRAND_IMPERSONATION_FORM', 'CREDENTIAL_FORM_EXTERNAL'] when m = 3 then ['LOGO_ALT_IMPERSONATION'] when m = 4 then ['META_REFRESH', 'EXTERNAL_META_REFRESH']
    when m = 5 then ['META_REFRESH'] when m = 6 then case when public_agency_keywords <> '' then ['KOREAN_LURE_TEXT', 'PUBLIC_AGENCY_LURE'] else [] end || ['PII_COLLECTION_FORM', 'SENSITIVE_ID_FIELD'] when m = 7 then ['FINANCIAL_FIELD']
    when m = 8 then ['KOREAN_LURE_TEXT', 'RISKY_DOWNLOAD_LINK'] when m = 9 then ['RISKY_DOWNLOAD_LINK'] when m = 10 and external_link_ratio >= 0.8 then ['EXTERNAL_LINK_OVERUSE'] else [] end signals,
  case m when 1 then 95 when 3 then 10 when 4 then 45 when 5 then 20 when 6 then 50 + case when public_agency_keywords <> '' then 35 else 0 end when 7 then 25 when 8 then 35 when 9 then 20 when 10 then case when external_link_ratio >= 0.8 then 5 else 0 end else 0 end points from feat)"""
)
# a long brand list: every label by every text, every domain by every label
LONG = (
    duck("brand_requests")
    + rf""",
asked as (select analysis_id, url, lower(title) title, regexp_extract(url, '://([^/?]+)', 1) host, regexp_extract(url, '://[^/?]+([^?]*)', 1) path, regexp_extract(url, '[?](.*)$', 1) query from brand_requests),
cut as (select *, case when host like '%.co.kr' then 'co.kr' else split_part(host, '.', 2) end suffix, split_part(host, '.', 1) as domain from asked),
listed as (select distinct label, tld, line from brand_lines),
alike as (select domain, suffix, label, tld, levenshtein(domain, label) dist from (select distinct domain, suffix from cut) join listed on abs(length(domain) - length(label)) <= 2 where levenshtein(domain, label) <= 2),
far as (select domain, suffix from alike group by domain, suffix having not bool_or(dist = 0 and suffix = tld)
  and bool_or((suffix = tld or list_contains({_list(dims.LOOKALIKE_SUFFIXES)}, suffix)) and (dist > 0 or suffix <> tld) and (dist = 0 or least(length(domain), length(label)) >= 5))),
every as (select list_sort(list_distinct(list(label) || {_list(dims.SEEDED_LABELS)})) names from listed),
heard as (select *, host || ' ' || path || case when query <> '' then ' ' || query else '' end t from cut),
within as (select heard.*, list_filter(names, lambda x: contains(t, x)) found from heard, every)"""
)
# redirect chains as a recursive walk
_ORIGIN = "regexp_extract({u}, '^[a-z]+://[^/?#]+', 0)"
STARTS = (
    FACTS
    + ", "
    + duck("hops").removeprefix("with ")
    + r""",
st0 as (select distinct url, added from good),
ok as (select distinct url from hops where method = 'HEAD' and status_code between 200 and 399 and content_type like '%text/html%'),
st as (select st0.url, added, case when ok.url is not null then ok.url else st0.url end st, ok.url is not null upgraded from st0 left join ok on added and st0.url like 'http://%' and ok.url = 'https' || substr(st0.url, 5))"""
)
WALK = (
    STARTS
    + rf""",
hd as (select url, max(status_code) s, max(raw_location) l, max(error) e, true seen from hops where method = 'HEAD' group by 1),
gt as (select url, max(status_code) s, max(raw_location) l, max(error) e, true seen from hops where method = 'GET' group by 1),
an as (select coalesce(hd.url, gt.url) url, hd.seen is null or hd.s is null or hd.s in (400, 403, 405) or (hd.s in (301, 302, 303, 307, 308) and coalesce(hd.l, '') = '') retry, hd.s hs, hd.l hl, hd.e he, gt.s gs, gt.l gl, gt.e ge, gt.seen gseen from hd full join gt using (url)),
ans as (select url, case when retry then gs else hs end s, case when retry then gl else hl end l, case when retry then ge else he end e, case when retry then 'GET' else 'HEAD' end method, not retry or gseen is not null known from an),
nxt as (select *, case when s in (301, 302, 303, 307, 308) and coalesce(l, '') <> '' then case when regexp_matches(l, '^[a-z]+:') then l when l like '/%' then {_ORIGIN.format(u="url")} || l else regexp_replace(regexp_replace(url, '[?].*$', ''), '[^/]*$', '') || l end end nx from ans),
walk as (with recursive w(st, upgraded, cur, n, alive, visited, hops, signals, error) as (
  select distinct st, upgraded, st, 0, true, cast([] as varchar[]), cast([] as varchar[]), case when upgraded then ['schemeless_https_upgrade'] else [] end, cast(null as varchar) from st
  union all
  select st, upgraded, case when goes then nx else cur end, n + 1, goes, list_append(visited, cur), case when took then list_append(hops, method || ' ' || cast(s as varchar) || ' ' || cur) else hops end,
    signals || case when loop then ['redirect_loop'] when loc then ['ssrf_blocked'] when known is null or not known then ['pipeline_timeout'] when unsafe then ['unsafe_scheme:' || regexp_extract(nx, '^([a-z]+):', 1)] else [] end
      || case when goes and cur like 'https:%' and nx like 'http:%' then ['scheme_downgrade'] else [] end || case when goes and ra <> rb then ['cross_origin:' || ha || '->' || hb] else [] end,
    case when loop then null when loc then 'ssrf_blocked' when known is null or not known then 'pipeline_timeout' when s is null then coalesce(e, 'dns_failure') when s >= 500 then 'server_error_' || cast(s as varchar)
      when s in (301, 302, 303, 307, 308) and nx is null then 'missing_location_header' when unsafe then 'unsafe_redirect_scheme:' || regexp_extract(nx, '^([a-z]+):', 1) end
  from (select *, {_reg("ha")} ra, {_reg("hb")} rb, not loop and not loc and s is not null and s < 500 and nx is not null and not unsafe goes, not loop and not loc and s is not null took from (
    select w.st, w.upgraded, w.cur, w.n, w.visited, w.hops, w.signals, nxt.s, nxt.nx, nxt.e, nxt.method, nxt.known, list_contains(w.visited, w.cur) loop, coalesce(not regexp_matches(nxt.nx, '^(https?|ftp):'), false) unsafe,
      lower(regexp_extract(w.cur, '://([^/?#:]*)', 1)) ha, lower(regexp_extract(coalesce(nxt.nx, ''), '://([^/?#:]*)', 1)) hb, regexp_matches(w.cur, '^[a-z]+://(10|127|192[.]168)[.][0-9.]+([/:?]|$)') loc
    from w left join nxt on nxt.url = w.cur where w.alive and w.n < 5) a) b)
  select * from w),
ends as (select * from walk qualify row_number() over (partition by st, upgraded order by n desc) = 1)"""
)

ORACLES: dict[str, str] = {
    "u01_u09_normalize_url": f"{NORM} select analysis_id, original original_url, normalized normalized_url, added scheme_was_added, failure from norm",
    "u03_split_url": f"{NORM} select analysis_id, scheme, userinfo, case when contains(netloc, '[') then '::1' else host end host, case when contains(netloc, '[') then null else port_text end port_text, path, params, query, fragment from parts",
    "u10_domain_parts": f"{FACTS} select analysis_id, subdomain, domain, suffix, registered from facts",
    "u12_https_variant": f"{FACTS} select analysis_id, case when scheme = 'http' then 'https' || substr(url, 5) end https_url from facts",
    "u13_url_variants": f"{FACTS}{VARIANTS} select analysis_id, array_to_string(l, '|') variants from good join variant using (url)",
    "u14_match_key": f"{FACTS} select analysis_id, {_KEY} match_key from good",
    "u15_query_params": f"{FACTS} select analysis_id, cast(i - 1 as int) pos, p.k k, p.v v from (select analysis_id, unnest(l) p, generate_subscripts(l, 1) i from (select analysis_id, {_PARAMS} l from facts where query <> ''))",
    "u16_u17_label_statistics": f"{FACTS} select distinct domain as label, round({_ENTROPY}, 6) entropy, round({_CONSONANTS}, 6) consonants from facts",
    "u18_address_tests": f"{FACTS} select distinct host, {_IP} is_ip, {_IP} and regexp_matches(host, '^(10|127|192[.]168|169[.]254|172[.](1[6-9]|2[0-9]|3[01]))[.]') is_local, {_IP} and regexp_matches(host, '^(10|127|192[.]168|169[.]254|172[.](1[6-9]|2[0-9]|3[01]))[.]') is_blocked from facts",
    "h01_h14_domain_flags": f"""{FACTS.replace("select analysis_id, page_id, v, added, normalized url from norm where failure is null", "select analysis_id, page_id, v, added, u url from raw")}{FLAGS}
select analysis_id, {", ".join(_NAMES)} from flags""",
    "h15_j06_lookalikes": f"{FACTS}{TYPOS} select domain, suffix from typo",
    "h15_j06_f06_lookalikes_of_a_long_list": f"{LONG} select domain, suffix from far",
    "h12_labels_of_a_long_list": f"{LONG} select analysis_id, array_to_string(found, '|') labels from within",
    "k01_words_of_a_long_list": rf"""{LONG}, named as (select list(label) labels from listed),
w as (select analysis_id, list_filter(regexp_extract_all(title, '[\p{{L}}\p{{N}}_]+'), lambda x: list_contains(labels, x)) l from asked, named)
select analysis_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') words from w""",
    "h18_h19_domain_score_with_a_long_list": f"""{LONG}, f as (select w.*, own.line is not null own, far.domain is not null typo, list_has_any(regexp_extract_all(t, '[a-z]+'), {_list(dims.SENSITIVE_TOKENS)}) sensitive,
  length(w.domain) >= 8 and own.line is null and ({_ENTROPY.replace("domain", "w.domain")} >= 3.5 or {_CONSONANTS.replace("domain", "w.domain")} >= 0.8) dga
  from within w left join (select distinct line from listed) own on own.line = w.domain || '.' || w.suffix left join far on far.domain = w.domain and far.suffix = w.suffix),
g as (select *, list_filter([case when list_contains({_list(dims.SUSPICIOUS_TLDS)}, suffix) then 'SUSPICIOUS_TLD:25' end, case when query <> '' then 'OPEN_REDIRECT_PARAM:31' end, case when sensitive and not own then 'SENSITIVE_PATH:20' end,
  case when len(found) > 0 and not own and not list_contains(found, domain) then 'BRAND_IN_URL:30' end, case when dga then 'DGA_LIKE:31' end, case when typo then 'TYPO_DOMAIN:30' end], lambda x: x is not null) met from f)
select analysis_id, domain || '.' || suffix as domain, array_to_string(list_transform(met, lambda x: split_part(x, ':', 1)), '|') domain_signals,
  cast(least(80, coalesce(list_sum(list_transform(met, lambda x: cast(split_part(x, ':', 2) as int))), 0)) as int) domain_score from g""",
    "h16_j07_registrations": f"{duck('rdap')} select domain, case when error is null then 'Reg ' || cast(n % 4 as varchar) end registrar, age domain_age_days, coalesce(age < 30, false) is_new_domain, error rdap_error from rdap",
    "j07_j13_s05_registrations_as_of": rf"""{duck("timed_requests", "timed_rdap")},
met as (select q.*, c.fetched_at, c.body, c.error from timed_requests q asof left join timed_rdap c on q.domain = c.domain and q.ts >= c.fetched_at),
good as (select *, fetched_at > ts - interval 7 days fresh from met),
known as (select *, case when fresh then date_diff('second', cast(regexp_extract(body, '"eventDate": "([0-9-]+)T', 1) || ' 00:00:00' as timestamp), ts) // 86400 end age from (select *, case when fresh then body end b from good) where b is not null)
select g.analysis_id, g.domain, regexp_extract(k.body, '"text", "([^"]*)"', 1) registrar, cast(k.age as int) domain_age_days, coalesce(k.age < 30, false) is_new_domain, case when g.fresh then g.error end rdap_error,
  not coalesce(g.fresh, false) or g.error is not null lookup_due from good g left join known k using (analysis_id)""",
    "h18_trusted_domains": f"{FACTS} select distinct host from facts where list_contains({_list([*dims.SAMPLE_BRANDS, *dims.TRUSTED_DOMAINS])}, coalesce(nullif(registered, ''), host))",
    "h19_a05_domain_score": f"""{FACTS}{FLAGS}{TYPOS} select analysis_id, reg as domain, {_score()} from (select *, false young from flags) flags left join typo on flags.domain = typo.domain and flags.suffix = typo.suffix""",
    "h19_domain_score_with_age": f"""{FACTS}{FLAGS}{TYPOS}{_AGES} select analysis_id, reg as domain, {_score()}, age domain_age_days
from (select flags.*, age, coalesce(age < 30, false) young from flags left join rdap on rdap.domain = reg) flags left join typo on flags.domain = typo.domain and flags.suffix = typo.suffix""",
    "j13_x04_domains_to_refresh": f"{FACTS}{_AGES} select distinct coalesce(nullif(registered, ''), host) as domain from facts where coalesce(nullif(registered, ''), host) not in (select domain from rdap where error is null)",
    "s02_f01_f10_feed_entries": f"{FEED_BASE} select line_no, id, url, host, match_key, threat, {_TAGS} tags, url_status, date_added, last_online, failed from entry",
    "w01_feed_latest": f"{FEED_BASE} select id, url, url_status from snap",
    "w02_match_key_rows": f"{FEED_BASE} select match_key, max(id) id, arg_max(url, id) url from snap group by 1",
    "s03_snapshot_upsert": f"""{FEED_BASE}{NEXT} select id, url, match_key, threat, reporter, date_added from
(select * from batch union all by name select * from snap where id not in (select id from batch)) qualify row_number() over (partition by url order by id desc) = 1""",
    "a02_sync_stats": f"{FEED_BASE}{NEXT} select (select count(*) from batch where id not in (select id from snap)) inserted, (select count(*) from batch where id in (select id from snap)) updated, (select count(*) from entry2) total, (select count(*) from entry2 where failed) failed",
    "j01_j03_list_lookup": f"{FEED_BASE}{LOOKUP} select url, is_threat, match_type, matched_key, threat, {_TAGS} tags, urlhaus_link from found",
    "j04_a06_safe_browsing": f"{FACTS}{GSB}{_GSB} select final_url, original_url, gsb_checked, gsb_threat, coalesce(types, '') gsb_types, case when not gsb_checked then err end gsb_error from answer",
    "j05_a04_x01_merged_lists": f"""{FEED_BASE}{GSB}{_GSB}{LOOKUP.replace("from good)", "from good union select distinct regexp_replace(url, '[?].*$', ''), " + _KEY.replace("url", "regexp_replace(url, '[?].*$', '')") + " from good)", 0)}
, everyone as (select distinct url from good union select original_url from pair)
, v2 as (select url, regexp_extract(url, '^(https?|ftp)', 1) s, regexp_replace(url, '^[a-z]+://([^/?#]*)([^?#]*).*$', '\\1') n, regexp_replace(url, '^[a-z]+://([^/?#]*)([^?#]*).*$', '\\2') p, regexp_extract(url, '([?].*)$', 1) q from everyone)
, f2 as (select *, case when p = '' then '/' when p = '/' then '' when p like '%/' then regexp_replace(p, '/+$', '') else p || '/' end p2, case s when 'https' then 'http' when 'http' then 'https' end s2 from v2)
, t2 as (select url, unnest(l) form, generate_subscripts(l, 1) place from (select url, list_filter([s || '://' || n || p || q, s || '://' || n || p2 || q, s2 || '://' || n || p || q, s2 || '://' || n || p2 || q], lambda x: x is not null) l from f2))
, e2 as (select t2.url, snap.url matched, threat from t2 join snap on snap.url = form qualify row_number() over (partition by t2.url order by place) = 1)
, m2 as (select w.url, coalesce(e2.matched, k.match_key) matched_key, case when e2.matched is not null then 'url' when k.match_key like '%/%' then 'host_path' when k.match_key is not null then 'host' end match_type, coalesce(e2.threat, k.threat) threat
  from (select url, {_KEY} mk from everyone) w left join e2 using (url) left join keyrow k on k.match_key = w.mk)
select final_url, original_url, gsb_threat or coalesce(a.matched_key, b.matched_key) is not null is_malicious, cast(1 + cast(gsb_checked as int) as int) sources_checked,
  array_to_string(list_filter([types, coalesce(a.threat, b.threat)], lambda x: x is not null), '|') threat_types, coalesce(a.match_type, b.match_type) match_type, coalesce(a.matched_key, b.matched_key) matched_key
from answer left join m2 a on a.url = final_url left join m2 b on b.url = original_url""",
    "p14_fetch_audit": f"{_CAP} select page_id, status_code, cast(length(html) as int) html_length, substr(html, 1, 2048) preview from page_capture",
    "j10_k19_p02_fetch_classes": rf"""{_CAP}, c as (select page_id, case when error is not null then error when status_code between 300 and 399 then 'unexpected_redirect' when status_code >= 400 then 'http_error_' || cast(status_code as varchar)
  when not contains(content_type, 'text/html') then 'not_html' when greatest(coalesce(content_length, 0), strlen(html)) > 2097152 then 'too_large' end fetch_error from page_capture)
select page_id, fetch_error, case when fetch_error is null then null when fetch_error in ('not_html', 'too_large', 'unexpected_redirect') then 0 else 15 end score,
  case fetch_error when 'timeout' then '페이지 응답 시간이 초과되었습니다.' when 'unexpected_redirect' then '예상하지 못한 리다이렉트 응답으로 페이지를 분석하지 못했습니다.' when 'http_error_404' then '페이지를 찾을 수 없습니다.'
    when 'not_html' then '분석 가능한 HTML 페이지가 아닙니다.' when 'too_large' then '페이지가 너무 커서 분석하지 않았습니다.' end reason,
  coalesce(fetch_error in ('timeout', 'http_error_404'), false) unavailable from c""",
    "k17_ai_answers": f"{duck('ai')} select a.url, case page_id % 6 when 0 then 'phishing' when 1 then 'suspicious' when 2 then 'benign' end verdict, case page_id % 6 when 0 then 'asks for a password' when 1 then 'odd host' when 2 then 'plain' end reason from ai a join site p on a.url = regexp_replace(p.url, '#.*$', '')",
    "k17_ai_answer_shapes": f"""{duck("ai_shapes")}, j as (select answer_id, case when json_valid(raw) then cast(raw as json) end j from ai_shapes),
t as (select answer_id, case when json_type(j, '$.verdict') = 'VARCHAR' and json_type(j, '$.reason') = 'VARCHAR' then json_extract_string(j, '$.verdict') end verdict, json_extract_string(j, '$.reason') reason from j)
select answer_id, case when verdict in ('phishing', 'suspicious', 'benign') then verdict end verdict, case when verdict in ('phishing', 'suspicious', 'benign') then substr(trim(reason), 1, 100) end reason from t""",
    "a01_verdict_metrics": f"""{duck("cases")}, n as (select count(*) total, count_if(expected = predicted) correct, count_if(expected = 'danger' and predicted <> 'safe') tp, count_if(expected <> 'danger' and predicted <> 'safe') fp,
  count_if(expected <> 'danger' and predicted = 'safe') tn, count_if(expected = 'danger' and predicted = 'safe') fn from cases),
r as (select *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) p, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) q from n)
select total, correct, tp true_positive, fp false_positive, tn true_negative, fn false_negative, round(coalesce(correct / nullif(total, 0), 0), 6) accuracy, p as precision, q as recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) false_positive_rate from r""",
    "c01_c15_page_features": f"{FEATURES} select page_id, title, has_password_field, has_password_form_external_action, has_meta_refresh, has_external_meta_refresh, is_spa_shell, external_link_ratio, image_alts, form_field_summaries, download_links, sensitive_field_types, korean_lure_keywords, public_agency_keywords from feat",
    "c09_c11_page_texts": f"{FEATURES} select page_id, cast(len(snippets) as int) n_snippets, array_to_string(snippets, chr(10)) snippets, array_to_string(ctas, '|') cta_texts from feat",
    "k01_k14_content_score": f"{SCORED} select page_id, array_to_string(signals, '|') content_signals, points content_score from sig",
    "k15_rendering_queue": f"{SCORED} select page_id, points content_score from sig where points < 61 and (m = 11 or points >= 20 or download_links <> '' or sensitive_field_types <> '' or korean_lure_keywords <> '' or public_agency_keywords <> '')",
    "j15_https_upgrade": f'{STARTS} select url, added scheme_was_added, st as "start", upgraded from st',
    "j08_a03_redirect_chains": f"""{WALK} select st as "start", cur final_url, cast(len(hops) as int) hop_count, array_to_string(hops, '|') hops, coalesce(error = 'timeout', false) timed_out, error,
array_to_string(signals || case when alive then ['max_hops_reached'] else [] end, '|') chain_signals from ends""",
    "u20_domain_changed": f"{WALK} select url, nx target, {_reg(chr(108) + 'ower(regexp_extract(url, ' + chr(39) + '://([^/?#:]*)' + chr(39) + ', 1))')} <> {_reg('lower(regexp_extract(nx, ' + chr(39) + '://([^/?#:]*)' + chr(39) + ', 1))')} changed from nxt where l is not null and nx is not null",
    "p01_w05_f11_unavailable": f"""{WALK}, u as (select st, error, cast(regexp_extract(list_last(list_filter(hops, lambda h: cast(split_part(h, ' ', 2) as int) >= 400)), ' ([0-9]+) ', 1) as varchar) code from ends)
select st as "start", case when code = '404' then '페이지를 찾을 수 없습니다.' when code like '4%' then '페이지 요청이 거부되었거나 찾을 수 없습니다.' when code like '5%' then '대상 서버 오류로 페이지를 확인할 수 없습니다.' else '페이지 응답 시간이 초과되었습니다.' end message,
  try_cast(nullif(code, '') as int) status_code from u where nullif(code, '') is not null or error = 'timeout'""",
    "j09_unblocked_requests": f"{FACTS}, {duck('dns').removeprefix('with ')} select analysis_id, url from facts where not (regexp_matches(host, '^(10|127|192[.]168)[.][0-9.]+$')) and host not in (select host from dns where regexp_matches(ip, '^(10[.]|fd)'))",
}
