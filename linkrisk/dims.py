"""Fixed values (word lists, weights, thresholds) that results depend on, and the settings that jobs take."""

from __future__ import annotations

from dataclasses import dataclass, field


def _words(text: str) -> tuple[str, ...]:
    return tuple(text.split())


# Suffixes of two labels, public and private.
TWO_LABEL_SUFFIXES = _words(
    """ac.kr co.in co.jp co.kr co.uk com.au com.br com.cn com.hk com.mx com.my com.sg com.tr com.tw edu.au go.kr gov.au gov.uk
    ne.kr net.cn or.kr org.cn re.kr
    amazonaws.com azurewebsites.net backblazeb2.com duckdns.org firebaseapp.com fly.dev free.nf github.io gitlab.io glitch.me
    godaddysites.com herokuapp.com my.id netlify.app pages.dev railway.app render.com replit.app surge.sh vercel.app wasmer.app
    web.app workers.dev"""
)
# Suffixes that are a signal of their own.
SUSPICIOUS_TLDS = _words(
    """zip mov xyz top pw tk ml ga cf cfd gq help fit work surf click link loan download stream racing review trade win bid
    party date faith science cricket accountant men"""
)
# Suffixes under which a brand's own label counts as a look-alike.
LOOKALIKE_SUFFIXES = _words("bid cf click date faith ga gq link loan men ml mov party pw racing review science stream surf tk top trade win xyz zip")
# Hosting platforms, shorteners and trusted domains.
HOSTING_PLATFORMS = _words(
    """netlify.app vercel.app pages.dev github.io gitlab.io web.app firebaseapp.com amazonaws.com azurewebsites.net
    herokuapp.com glitch.me replit.app surge.sh render.com fly.dev railway.app cyclic.app workers.dev wasmer.app
    godaddysites.com duckdns.org free.nf my.id backblazeb2.com"""
)
SHORTENERS = _words("bit.ly cutt.ly goo.gl is.gd ow.ly qrco.de rebrand.ly shorturl.at t.co tinyurl.com")
TRUSTED_DOMAINS = _words("example.com httpbin.org")
# Words of paths that ask for credentials or payment.
SENSITIVE_TOKENS = _words(
    """account admin auth billing claim confirm credential invoice login password pay portal recover secure session signin
    support suporte validate verification verify wallet"""
)
# Brand labels that are always searched for, and labels too common to search for.
SEEDED_LABELS = _words(
    """adobe amazon apple binance coinbase discord dpd facebook google instagram iphone metamask microsoft netflix office
    outlook paypal roblox societegenerale telegram tmobile t-mobile trezor whatsapp wps yahoo"""
)
GENERIC_LABELS = _words("bank blog cafe card cloud finance gov home map mvno news pay place shop shopping support")
# Query parameters that redirect.
REDIRECT_PARAMS = _words(
    """url redirect redirect_url redirect_uri next return return_url returnurl goto destination target link forward continue
    redir out"""
)
# Hosts that are never fetched.
BLOCKED_HOSTS = _words("localhost ip6-localhost ip6-loopback metadata metadata.google.internal instance-data instance-data.ec2.internal")
# Hosts whose first path segments tell tenants apart.
MULTITENANT_HOSTS = {
    "github.com": 2,
    "raw.githubusercontent.com": 2,
    "gist.github.com": 2,
    "gitlab.com": 2,
    "bitbucket.org": 2,
    "sites.google.com": 2,
    "dropbox.com": 2,
    "www.dropbox.com": 2,
    "dropboxusercontent.com": 2,
    "dl.dropboxusercontent.com": 2,
    "www.dropboxusercontent.com": 2,
}
# IPv4 ranges that are not global.
LOCAL_IPV4 = _words(
    """0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/29 192.0.0.170/31 192.0.2.0/24
    192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4 255.255.255.255/32"""
)
# Special blocks of both versions beside those; smaller blocks are exceptions from larger ones.
SPECIAL_BLOCKS = {
    "local": _words("::/128 ::1/128 64:ff9b:1::/48 100::/64 2001::/23 2001:db8::/32 2002::/16 fc00::/7 fe80::/10"),
    "global": _words("2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28"),
    "multicast": _words("224.0.0.0/4 ff00::/8"),
}
# Marks of single-page applications, downloads, lures and sensitive fields.
SPA_MOUNT_IDS = _words("root app __next __nuxt __layout svelte q-app")
SPA_MOUNT_TAGS = _words("app-root ng-app")
RISKY_EXTENSIONS = _words(".apk .ipa .exe .msi .dmg .scr .bat .cmd .vbs")
RISKY_DOWNLOAD_EXTENSIONS = (".js",)
LURE_KEYWORDS = _words("지원금 환급금 택배 부고 청첩장 과태료 건강보험 정부기관 카카오톡 인증번호 otp")
AGENCY_KEYWORDS = _words("국민건강보험 건강보험공단 건강보험 정부24 정부 공단 국세청 관세청 경찰청 검찰청 고용노동부 보건복지부 행정안전부")
SENSITIVE_FIELDS = {
    "resident_registration_number": _words("resident_registration rrn 주민등록 주민번호"),
    "phone": _words("mobile phone tel 휴대폰 전화번호"),
    "card": _words("card_number credit_card creditcard 카드번호 카드"),
    "cvc": _words("cvc cvv"),
    "account": _words("account bank 계좌 은행"),
    "otp": _words("otp auth_code verification_code 인증번호 인증"),
}

# Weights of domain signals, in the order in which they are appended.
DOMAIN_WEIGHTS = {
    "IP_DIRECT": 40,
    "NO_HTTPS": 20,
    "URL_USERINFO": 45,
    "SUBDOMAIN_OVERUSE": 20,
    "PUNYCODE_IDN": 35,
    "HYPHEN_OVERUSE": 20,
    "SUSPICIOUS_TLD": 25,
    "OPEN_REDIRECT_PARAM": 31,
    "HOSTING_PLATFORM": 20,
    "URL_SHORTENER": 25,
    "SENSITIVE_PATH": 20,
    "BRAND_IN_URL": 30,
    "FREE_HOSTING_LURE": 25,
    "DGA_LIKE": 31,
    "TYPO_DOMAIN": 30,
    "NEW_DOMAIN": 25,
    "REDIRECT_CROSS_ORIGIN": 15,
}
# Weights of content signals.
CONTENT_WEIGHTS = {
    "BRAND_IMPERSONATION_FORM": 50,
    "LOGO_ALT_IMPERSONATION": 10,
    "CREDENTIAL_FORM_EXTERNAL": 45,
    "PII_COLLECTION_FORM": 20,
    "SENSITIVE_ID_FIELD": 30,
    "FINANCIAL_FIELD": 25,
    "RISKY_DOWNLOAD_LINK": 20,
    "PUBLIC_AGENCY_LURE": 20,
    "KOREAN_LURE_TEXT": 15,
    "META_REFRESH": 20,
    "EXTERNAL_META_REFRESH": 25,
    "EXTERNAL_LINK_OVERUSE": 5,
    "FETCH_FAILED": 15,
}
# Signals that let a suspicious AI verdict count on a trusted domain.
STRONG_CONTENT_SIGNALS = _words("BRAND_IMPERSONATION_FORM CREDENTIAL_FORM_EXTERNAL SENSITIVE_ID_FIELD FINANCIAL_FIELD RISKY_DOWNLOAD_LINK EXTERNAL_META_REFRESH")
STRONG_UPSTREAM_SIGNALS = _words(
    "URL_USERINFO OPEN_REDIRECT_PARAM BRAND_IN_URL FREE_HOSTING_LURE SENSITIVE_PATH SUSPICIOUS_TLD PUNYCODE_IDN TYPO_DOMAIN"
)

#: A small brand list of our own; jobs take any table of lines instead.
SAMPLE_BRANDS = _words(
    """naver.com paypal.com google.com amazon.com netflix.com daum.net daum.com kb.co.kr kakao.com apple.com microsoft.com
    facebook.com instagram.com github.com dropbox.com coupang.com samsung.com spotify.com ebay.com twitter.com linkedin.com
    yahoo.com adobe.com toss.im wooribank.com shinhan.com ing.com bing.com t-mobile.com mail.google.com"""
)


@dataclass(frozen=True)
class Settings:
    """Thresholds and caps, with their standard values."""

    max_url_length: int = 1024
    max_hops: int = 5
    new_domain_days: int = 30
    lookup_days: int = 7
    subdomain_labels: int = 4
    hyphens: int = 3
    label_length: int = 20
    dga_length: int = 8
    dga_entropy: float = 3.5
    dga_consonants: float = 0.8
    typo_length: int = 5
    typo_distance: int = 2
    domain_cap: int = 80
    content_cap: int = 100
    total_cap: int = 100
    danger: int = 61
    caution: int = 31
    list_weight: int = 50
    ai_phishing: int = 45
    ai_suspicious: int = 31
    external_links: float = 0.8
    precision_score: int = 20
    page_bytes: int = 2 * 1024 * 1024
    domain_weights: dict[str, int] = field(default_factory=lambda: dict(DOMAIN_WEIGHTS))
    content_weights: dict[str, int] = field(default_factory=lambda: dict(CONTENT_WEIGHTS))


SETTINGS = Settings()
