"""Tables derived from the given ones: URL requests, threat feed, hops and other captures.

Each rule is plain SQL that Spark and DuckDB read alike, but for two tokens: ``EACH(n)`` gives 0..n-1 as rows and
``STAMP`` is the type of a time without zone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from linkrisk.functions.shared import TASKS_A_CORE, written

NOW = "2024-01-31 00:00:00"

RULES = {
    # 24 requests for each page
    "url_inputs": """
select cast(page_id as string) || '-' || cast(v as string) as analysis_id, page_id, v, case v
  when 0 then url
  when 1 then 'HTTP://' || upper(host) || ':80/Path#frag'
  when 2 then host || '/path'
  when 3 then 'https://account.help@' || host || '/session'
  when 4 then 'https://' || host || '//a/./b/../c'
  when 5 then 'https://' || host || '/%7Euser/%2fx%41?q=%61'
  when 6 then 'https://' || host || '/p;%7eq?x=1#f'
  when 7 then 'https://' || host || ':99999/'
  when 8 then 'ftp2://' || host || '/'
  when 9 then '   '
  when 10 then 'http://192.168.' || cast(page_id % 256 as string) || '.1/login'
  when 11 then 'http://[::1]/x'
  when 12 then 'https://nnaver.com/' || cast(page_id as string)
  when 13 then 'https://paypal.xyz/login?id=' || cast(page_id as string)
  when 14 then 'https://ebay-outlet-' || cast(page_id as string) || '.vercel.app/login'
  when 15 then 'https://bit.ly/' || cast(page_id as string)
  when 16 then 'https://' || host || '/go?url=https%3A%2F%2Fevil.test%2F' || cast(page_id as string)
  when 17 then 'https://' || host || '/go?next=https://' || host || '/x'
  when 18 then 'https://' || host || '/go?redirect='
  when 19 then 'https://' || translate(md5(cast(page_id as string)), '0123456789', 'ghjkmnpqrs') || '.com/'
  when 20 then 'https://a.b.c.d.' || host || '/'
  when 21 then 'https://login-secure-auth-' || cast(page_id as string) || '.com/verify'
  when 22 then 'https://xn--rger-0ra.net/' || cast(page_id as string)
  else 'https://github.com/u' || cast(page_id % 50 as string) || '/r' || cast(page_id % 7 as string) || '/raw/x.sh' end as url
from (select page_id, url, regexp_extract(url, '://([^/?#]+)', 1) as host, EACH(24) as v from pages) t""",
    # a brand list of 20 lines for each page
    "brand_lines": """
select page_id, v, label, tld, label || '.' || tld as line from (
  select page_id, v, translate(substr(md5(cast(page_id * 20 + v as string)), 1, cast(5 + (page_id + v) % 6 as int)), '0123456789abcdef', 'bkdlmnprstaeiouz') as label,
    case v % 5 when 0 then 'com' when 1 then 'net' when 2 then 'co.kr' when 3 then 'io' else 'org' end as tld
  from (select page_id, EACH(20) as v from pages) t) u""",
    # a request for each of its lines, most of them misspelt, with a title
    "brand_requests": """
select cast(page_id as string) || '-' || cast(v as string) as analysis_id, 'https://' || case v % 8 when 1 then substr(label, 1, 1) || substr(label, 3) when 2 then substr(label, 1, 2) || substr(label, 2)
    when 3 then substr(label, 1, 2) || 'x' || substr(label, 4) when 4 then substr(label, 1, 1) || substr(label, 3, 1) || substr(label, 2, 1) || substr(label, 4) when 5 then substr(label, 1, 1) || substr(label, 3) || 'q'
    when 6 then reverse(label) || 'w' else label end || '.' || case when v % 8 = 7 then 'xyz' when v % 3 = 0 then tld when v % 3 = 1 then 'top' else 'net' end
  || case v % 4 when 0 then '/pay/' || label || '-x/' when 1 then '/?next=' || reverse(label) else '/' end as url,
  case v % 4 when 0 then 'Sign in: ' || upper(label) || ' online' when 1 then label || '_x ' || label || '-' || label || ' paypal' when 2 then 'my' || label || ' ' || substr(label, 1, 5) else 'Über ' || label || 's' end as title
from brand_lines""",
    # the first batch of the threat feed; every fiftieth id comes again, later
    "feed": """
select id, dateadded, url, url_status, last_online, threat, tags, urlhaus_link, reporter, line_no, false as short from (
select case when page_id % 100 = 1 then 'x' else cast(page_id * 24 + v as string) end as id,
  case when page_id % 7 = 0 then 'None' when page_id % 2 = 0 then '2024-01-02 03:04:05' else '2024-01-02 03:04:05 UTC' end as dateadded,
  case when page_id % 100 = 2 then 'https://github.com/only' when page_id % 100 = 3 then ''
    when v = 0 and page_id % 30 = 0 then regexp_replace(swapped, '[?#].*$', '') || '/' else swapped end as url,
  case when again = 1 then 'offline' else 'online' end as url_status, 'N/A' as last_online, 'malware_download' as threat,
  'exe, emotet,' as tags, 'https://list.test/' || cast(page_id * 24 + v as string) as urlhaus_link, 'r' || cast(page_id % 3 as string) as reporter,
  page_id * 24 + v + again * 1000000000 as line_no, page_id, again, v
from (select page_id, v, EACH(2) as again, case when page_id % 20 = 0 and url like 'https://%' then 'http://' || substr(url, 9)
    when page_id % 20 = 0 and url like 'http://%' then 'https://' || substr(url, 8) else url end as swapped
  from url_inputs where (page_id % 10 = 0 or page_id % 100 in (1, 2, 3)) and v in (0, 4, 14, 16, 23)) t) u
where again = 0 or (page_id * 24 + v) % 50 = 0""",
    # the second batch
    "feed_next": """
select cast(page_id * 24 + v as string) as id, '2024-01-03 00:00:00' as dateadded, url, 'online' as url_status, 'N/A' as last_online,
  'phishing' as threat, '' as tags, 'https://list.test/' || cast(page_id * 24 + v as string) as urlhaus_link, 'r9' as reporter, page_id * 24 + v as line_no, false as short
from url_inputs where page_id % 10 = 0 and (v = 15 or (page_id % 40 = 0 and v in (0, 4, 14, 16)))""",
    # one page for each URL without fragment
    "site": """
select page_id, url, html from pages where page_id in (select min(page_id) from pages group by regexp_replace(url, '#.*$', ''))""",
    "hops": """
with p as (select page_id, page_id % 8 as m, regexp_replace(url, '#.*$', '') as u, regexp_extract(url, '://([^/?#]+)', 1) as host, cast(page_id as string) as k from site),
s as (select page_id, m, host, k, EACH(7) as n from p)
select u as url, 'HEAD' as method, cast(case m when 0 then 200 when 1 then 301 when 2 then 302 when 3 then 302 when 4 then 301 when 5 then 302 when 6 then 307 else 405 end as int) as status_code,
  case m when 1 then '/final' || k when 2 then 'h' || k || '/0' when 3 then 'https://other' || k || '.test/land' when 4 then 'http://' || host || '/plain' || k
    when 5 then '/loop' || k when 6 then '/far' || k || '/0' end as raw_location, 'text/html' as content_type, cast(null as string) as error from p
union all select u, 'GET', cast(404 as int), cast(null as string), 'text/html', cast(null as string) from p where m = 7
union all select regexp_extract(u, '^[^:]+://[^/]+', 0) || '/final' || k, 'HEAD', cast(200 as int), cast(null as string), 'text/html', cast(null as string) from p where m = 1
union all select 'https://other' || k || '.test/land', 'HEAD', cast(case when page_id % 16 = 3 then 200 else 503 end as int), cast(null as string), 'text/html', cast(null as string) from p where m = 3
union all select 'http://' || host || '/plain' || k, 'HEAD', cast(200 as int), cast(null as string), 'text/html', cast(null as string) from p where m = 4
union all select regexp_extract(u, '^[^:]+://[^/]+', 0) || '/loop' || k, 'HEAD', cast(302 as int), u, 'text/html', cast(null as string) from p where m = 5
union all select x.url, 'HEAD', cast(307 as int), '/far' || k || '/' || cast(n + 1 as string), 'text/html', cast(null as string)
  from (select s.k, s.n, regexp_extract(p.u, '^[^:]+://[^/]+', 0) || '/far' || s.k || '/' || cast(s.n as string) as url from s join p on s.page_id = p.page_id where s.m = 6) x
union all select distinct 'https://bit.ly/' || k, 'HEAD', cast(case page_id % 4 when 0 then 301 when 1 then 302 when 2 then null else 301 end as int),
  case page_id % 4 when 0 then 'javascript:alert(1)' when 3 then 'https://evil' || k || '.top/x' end, cast(null as string), case when page_id % 4 = 2 then 'timeout' end from p
union all select distinct 'https://' || host || '/path', 'HEAD', cast(200 as int), cast(null as string), 'text/html', cast(null as string) from p where length(host) % 2 = 0""",
    "dns": """
select distinct host, ip from (
  select regexp_extract(url, '://([^/?#:]+)', 1) as host, '93.184.216.34' as ip from pages
  union all select regexp_extract(url, '://([^/?#:]+)', 1), '2606:4700::' || cast(page_id % 1000 as string) from pages where page_id % 3 = 0
  union all select regexp_extract(url, '://([^/?#:]+)', 1), 'fd00::' || cast(page_id % 1000 as string) from pages where page_id % 40 = 9
  union all select regexp_extract(url, '://([^/?#:]+)', 1), '10.0.0.1' from pages where page_id % 40 = 7) t""",
    # addresses of both versions, in many spellings, and texts that are none
    "addresses": """
select distinct case v when 0 then '::1' when 1 then 'fe80::' || n when 2 then 'fd12:3456::' || n when 3 then '2001:db8::' || n when 4 then '2606:4700::' || n when 5 then '::ffff:10.0.0.' || cast(page_id % 256 as string)
  when 6 then 'ff0e::' || n when 7 then '2A00:1450:4001::' || n when 8 then n || ':zz::1' when 9 then '::' when 10 then '203.0.113.' || o when 11 then '8.8.' || o || '.1' when 12 then '2001:3::' || n when 13 then 'febf::' || n
  when 14 then 'fec0::' || n when 15 then '[fe80::' || n || '%eth0]' when 16 then '1:2:3:4:5:6:7:' || n when 17 then '1::2::' || n when 18 then '224.0.0.' || o when 19 then '64:ff9b:1::' || n || ':0' else '::ffff:8.8.8.' || o end as address, v
from (select page_id, cast(page_id % 10000 as string) as n, cast(page_id % 256 as string) as o, EACH(21) as v from pages) t""",
    # lines of a feed file: quoted fields, comments, blank, short and over-long lines
    "feed_lines": '''
select page_id * 8 + v as line_no, v, case v when 0 then '# ' || url when 1 then '' when 2 then '"' || k || '","2024-01-02 03:04:05"' when 3 then k || ',a,' || url || ',online,b,c,"x,y",d,e,f,g'
  when 4 then '"' || k || '", "t", "' || url || '", "online", "", "say ""hi""", "exe, ""emotet""", "l", "r"' when 5 then k || ',a,,offline,,,,,' when 6 then '"' || k || '","t","' || url || '","online","N/A","m","a,b","l","r"' else ' # no comment' end as value,
  k, url from (select page_id, cast(page_id as string) as k, regexp_replace(url, '[",]', '') as url, EACH(8) as v from pages) t''',
    "safe_browsing": """
select u as url, page_id % 13 <> 0 as checked, case when page_id % 13 = 0 then 'timeout' end as error,
  case when page_id % 17 = 0 then 'MALWARE' end as threat_type from (select page_id, regexp_replace(url, '#.*$', '') as u from site) t""",
    "cases": """
select case when l.toxic = 1 then 'danger' else 'safe' end as expected, case d.n_chars % 3 when 0 then 'safe' when 1 then 'caution' else 'danger' end as predicted
from labels l join documents d on l.doc_id = d.doc_id""",
    "ai": """
select regexp_replace(url, '#.*$', '') as url, case page_id % 6
  when 0 then '{"verdict": "phishing", "reason": "  asks for a password "}' when 1 then '{"verdict": "suspicious", "reason": "odd host"}'
  when 2 then '{"verdict": "benign", "reason": "plain"}' when 3 then '{"verdict": "other", "reason": "x"}' else '{"verdict": ' end as raw
from site where page_id % 6 < 5""",
    # answers of many shapes: nested and mistyped keys, text behind the object, unknown verdicts
    "ai_shapes": """
select page_id * 10 + v as answer_id, case v when 0 then '{"verdict": "phishing", "reason": "  asks ' || k || ' "}' when 1 then '{"meta": {"reason": "x"}, "verdict": "benign", "reason": ' || k || '}'
  when 2 then '{"verdict": ["benign"], "reason": "x"}' when 3 then '{"reason": {"reason": "' || k || '"}, "verdict": "benign"}' when 4 then '{"verdict": "benign", "reason": null}'
  when 5 then '{"verdict": "suspicious", "reason": "' || repeat(k || ' ', 60) || '"}' when 6 then '{"verdict": "benign", "reason": "x"} and more' when 7 then '{"verdict": "benign", "reason": "' || k
  when 8 then '{"verdict": "unsure", "reason": "x"}' else '{"reason": "r ' || k || '", "extra": [1, 2], "verdict": "suspicious"}' end as raw
from (select page_id, cast(page_id as string) as k, EACH(10) as v from pages) t""",
    # pages with a fragment before the article's end
    "page_capture": """
select page_id, regexp_replace(url, '#.*$', '') as url, cast(case page_id % 19 when 1 then 404 when 2 then 302 when 5 then null else 200 end as int) as status_code,
  case when page_id % 19 = 3 then 'application/pdf' else 'text/html; charset=utf-8' end as content_type,
  cast(case when page_id % 19 = 4 then 3000000 end as bigint) as content_length,
  case page_id % 12 when 11 then '<html><head><title>app</title></head><body><div id="root"></div></body></html>' else replace(html, '</article>', case page_id % 12
    when 1 then '<form action="https://inbox9.test/login"><input name="id"><input type="password" name="pw"></form></article>'
    when 2 then '<form action="/login"><input type="password" name="pw"></form></article>'
    when 3 then '<img src="l.png" alt="NAVER"></article>'
    when 4 then '<meta http-equiv="refresh" content="0; url=https://evil.test/x"></article>'
    when 5 then '<meta http-equiv="Refresh" content="5;URL=/next"></article>'
    when 6 then '<label for="r">주민번호</label><input id="r" name="rrn"><label>휴대폰 <input name="mobile"></label><p>국민건강보험 안내</p></article>'
    when 7 then '<input name="card_number" placeholder="카드번호"><input name="cvc"></article>'
    when 8 then '<a href="/app.apk">택배 조회</a></article>'
    when 9 then '<a href="/payload.js" download>run</a><a href="/other.js">no</a></article>'
    when 10 then '<a href="https://o1.test/1">1</a><a href="https://o2.test/2">2</a><a href="https://o3.test/3">3</a><a href="https://o4.test/4">4</a><a href="https://o5.test/5">5</a><a href="https://o6.test/6">6</a><a href="https://o7.test/7">7</a><a href="https://o8.test/8">8</a><a href="https://o9.test/9">9</a><a href="https://o10.test/10">10</a></article>'
    else '</article>' end) end as html,
  case when page_id % 19 = 5 then 'timeout' end as error
from (select page_id, url, case when page_id % 12 = 1 then replace(html, '<title>', '<title>NAVER ') else html end as html from site) t""",
    "rendered": """
select regexp_replace(url, '#.*$', '') as url, '<html><head><title>NAVER</title></head><body><form action="/login"><input type="password"></form></body></html>' as html,
  case when page_id % 24 = 23 then 'timeout' end as error from site where page_id % 12 = 11""",
    # requests for each page's domain at several times, and registrations as they stood at several times
    "timed_requests": """
select cast(page_id as string) || '-' || cast(v as string) as analysis_id, domain, v,
  cast(cast(cast('2024-01-01' as date) + cast((page_id * 7 + v * 11) % 60 as int) as string) || case when v % 3 = 0 then ' 06:00:00' when v % 3 = 1 then ' 12:00:00' else ' 18:30:00' end as STAMP) as ts
from (select page_id, regexp_extract(url, '([^./]+[.][a-z]+)(?:/|[?#]|$)', 1) as domain, EACH(6) as v from pages) t""",
    "timed_rdap": """
select domain, cast(cast(cast('2024-01-01' as date) + cast((n * 3 + v * 13) % 70 as int) as string) || ' 12:00:00' as STAMP) as fetched_at,
  case when (n + v) % 5 = 0 then null else '{"events": [{"eventAction": "registration", "eventDate": "' || cast(cast('2023-12-20' as date) + cast((n + v * 9) % 40 as int) as string) || 'T00:00:00Z"}], "entities": [{"roles": ["registrar"], "vcardArray": ["vcard", [["fn", {}, "text", "Reg ' || cast(v as string) || '"]]]}]}' end as body,
  case when (n + v) % 5 = 0 then 'not_found' end as error
from (select domain, n, EACH(5) as v from (select regexp_extract(url, '([^./]+[.][a-z]+)(?:/|[?#]|$)', 1) as domain, min(page_id) as n from pages group by 1) a) b""",
    "rdap": """
select domain, cast('2024-01-30 00:00:00' as STAMP) as fetched_at, case when n % 11 = 0 then null else
  '{"events": [{"eventAction": "registration", "eventDate": "2000-01-01T00:00:00Z"}, {"eventAction": "' || case when n % 7 = 0 then 'changed' else 'registration' end || '", "eventDate": "' || case when n % 5 = 0 then 'soon' else day || 'T00:00:00Z' end
  || '"}], "entities": [{"roles": ["abuse"], "vcardArray": ["vcard", [["fn", {}, "text", "Nobody"]]]}, {"roles": ["registrar"], "vcardArray": ["vcard", [["version", {}, "text", "4.0"], ["fn", {}, "text", "Reg ' || cast(n % 4 as string) || '"]]]}]}' end as body,
  case when n % 11 = 0 then 'not_found' end as error, n, case when n % 11 = 0 then null when n % 7 = 0 then 8796 when n % 5 = 0 then null else back end as age
from (select domain, length(domain) + page as n, back, cast(cast('2024-01-31' as date) - back as string) as day from (
  select domain, page, cast(page % 90 as int) as back from (
    select regexp_extract(url, '([^./]+[.][a-z]+)(?:/|[?#]|$)', 1) as domain, min(page_id) as page from pages group by 1
    union all select 'other' || cast(page_id as string) || '.test', page_id from pages where page_id % 8 = 3
    union all select 'login-secure-auth-' || cast(page_id as string) || '.com', page_id from pages) a) b) c""",
}
#: Which rules and given tables a rule reads.
TABLES = ("pages", "labels", "documents")
#: A rule that reads another one many times, and the columns that it reads: these are written first.
READ_OFTEN = {"hops": ("site", ["page_id", "url"])}


def needs(name: str) -> list[str]:
    """The rules that ``name`` reads, in the order to make them, itself last."""
    out: list[str] = []
    for other in RULES:
        if other != name and re.search(rf"(?:from|join) {other}\b", RULES[name]):
            out += [x for x in needs(other) if x not in out]
    return [*out, name]


def duck(*names: str) -> str:
    """The rules as the start of a DuckDB WITH clause."""
    order = list(dict.fromkeys(x for n in names for x in needs(n)))
    made = [f"{n} as ({RULES[n]})" for n in order]
    text = ", ".join(made)
    return "with " + re.sub(r"EACH\((\d+)\)", r"unnest(range(\1))", text).replace("STAMP", "timestamp")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table."""
    text = RULES[name]
    text = re.sub(r"EACH\((\d+)\)", lambda m: f"explode(sequence(cast(0 as bigint), cast({int(m[1]) - 1} as bigint)))", text).replace("STAMP", "timestamp")
    used = {}
    for table in TABLES:
        if re.search(rf"(?:from|join) {table}\b", text):
            used[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if "EACH(24)" in RULES[name]:  # a page becomes many rows, but the given files have few parts
        used["pages"] = used["pages"].select("page_id", "url").repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    for other in needs(name)[:-1]:
        used[other] = fixture(spark, sf_dir, other)
    if name in READ_OFTEN:
        other, columns = READ_OFTEN[name]
        used[other] = written(used[other].select(*columns), other)
    text = re.sub(r"[{}]", lambda m: m[0] * 2, text)
    for table in used:
        text = re.sub(rf"((?:from|join)) {table}\b", rf"\1 {{{table}}}", text)
    return spark.sql(text.replace("\\", "\\\\"), **used) if used else spark.sql(text)
