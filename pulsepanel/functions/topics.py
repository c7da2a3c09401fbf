"""Topic matching, tone and domain parsing for news records."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword, theme and domain lists, patterns.
KEYWORDS = {
    "all": ["bitcoin", "btc", "cryptocurrency", "crypto currency", "satoshi", "blockchain",
            "coinbase", "binance", "cryptomarket", "digital currency", "digitalcurrency"],
    "balanced": ["bitcoin", "btc"],
    "sensitive": ["bitcoin", "btc", "cryptocurrency"],
    "strong": ["bitcoin", "btc"],
}
THEMES = {
    "all": ["WEB_BITCOIN", "ECON_CRYPTOCURRENCY", "ECON_DIGITALCURRENCY", "BITCOIN", "CRYPTO", "BTC"],
    "balanced": ["WEB_BITCOIN", "BITCOIN"],
    "sensitive": ["WEB_BITCOIN", "BITCOIN"],
    "strong": ["WEB_BITCOIN"],
}
STRONG_URL = (
    r"\b(bitcoin|satoshi|coinbase|binance|cryptocurrency|crypto[-_]market|"
    r"bitcoin[-_]price|bitcoin[-_]news|btc[-_]usd|btcusd|"
    r"bitcoin[-_]mining|bitcoin[-_]wallet|bitcoin[-_]exchange|"
    r"crypto[-_]currency|cryptomarket|altcoin|defi|"
    r"web3|nft|ethereum|litecoin|ripple|dogecoin)\b"
)
AMBIGUOUS_URL = r"\b(btc|blockchain|crypto)\b"
CONTEXT_URL = (
    r"\b(bitcoin|coin|wallet|mining|exchange|crypto|"
    r"blockchain|satoshi|hodl|altcoin|defi|token|"
    r"market[-_]cap|mcap|digital[-_]currency|"
    r"price|usd|eur|bull|bear|pump|dump)\b"
)
ON_TOPIC_DOMAINS = [
    "coindesk.com", "cointelegraph.com", "bitcoin.com", "bitcoinmagazine.com",
    "decrypt.co", "theblock.co", "coinbase.com", "binance.com",
    "cryptoslate.com", "ambcrypto.com", "newsbtc.com", "u.today",
    "cryptonews.com", "bitcoinist.com", "cryptobriefing.com",
]
LOW_CRED_DOMAINS = [
    "news.bitcoin.com", "newsbtc.com", "cryptocoinsnews.com", "ccn.com",
    "altcointoday.com", "thebitcoinnews.com", "coinreport.net", "bravenewcoin.com",
    "coinspeaker.com", "4-traders.com", "econotimes.com", "zerohedge.com",
    "cryptonewsz.com", "insidebitcoins.com", "nulltx.com", "zycrypto.com",
    "ambcrypto.com", "coingape.com", "cryptodaily.co.uk", "u.today",
    "coinpedia.org", "cryptopotato.com", "beincrypto.com",
    "ibtimes.com", "ibtimes.co.uk", "beforeitsnews.com",
]
TRUSTED_DOMAINS = [
    "reuters.com", "bloomberg.com", "ft.com", "wsj.com", "cnbc.com", "forbes.com",
    "fortune.com", "businessinsider.com", "marketwatch.com", "finance.yahoo.com",
    "nasdaq.com", "bbc.com", "bbc.co.uk", "coindesk.com", "cointelegraph.com",
    "bitcoinmagazine.com", "theblock.co", "decrypt.co", "apnews.com", "theguardian.com",
    "bis.org", "ecb.europa.eu", "sec.gov", "cftc.gov",
]


def any_of(words: list[str]) -> str:
    """Case-insensitive pattern for any of the words, taken literally."""
    return "(?i)" + "|".join(re.escape(w) for w in words)


def contains_any(text: Column, words: list[str]) -> Column:
    return F.coalesce(text.rlike(any_of(words)), F.lit(False))


def match_topic(line: Column, keywords: list[str], themes: list[str], theme_fields=(7, 8)) -> Column:
    """A keyword anywhere in the tab row, or a theme in one of the theme fields."""
    hit = contains_any(line, keywords)
    for i in theme_fields:
        hit = hit | contains_any(tab_field(line, i), themes)
    return hit


def tab_field(line: Column, i: int) -> Column:
    """Field ``i`` of a tab row, NULL when the row is shorter."""
    return F.get(F.split(line, "\t", -1), F.lit(i))


def parse_tone(c: Column) -> Column:
    """Leading signed number of a comma list, kept when within [-100, 100]."""
    value = F.regexp_extract(F.trim(c), r"^(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.when(value.between(-100.0, 100.0), value)


def host_of(url: Column) -> Column:
    """Host with port, lower case; empty when the text is not a URL."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def domain_of(url: Column) -> Column:
    return F.replace(host_of(url), F.lit("www."), F.lit(""))


def match_article_url(
    url: Column,
    domains: list[str] | None = None,
    strong: str = STRONG_URL,
    ambiguous: str = AMBIGUOUS_URL,
    context: str = CONTEXT_URL,
    anchor: str = "bitcoin",
) -> Column:
    """Two tiers: sure signs accept; unsure words need context in the URL."""
    low = F.lower(url)
    known = contains_any(domain_of(url), domains or ON_TOPIC_DOMAINS)
    hits = F.size(F.regexp_extract_all(low, F.lit(context), F.lit(0)))
    unsure = low.rlike(ambiguous) & ((hits >= 2) | low.contains(anchor))
    return F.coalesce(known | low.rlike(strong) | unsure, F.lit(False))


def _suffix_of(domain: Column, names: list[str]) -> Column:
    return domain.rlike("(^|\\.)(" + "|".join(re.escape(n) for n in names) + ")$")


def classify_domain(
    domain: Column, low_cred: list[str] | None = None, trusted: list[str] | None = None
) -> Column:
    """Exact domain or a subdomain of a listed one; the low list is asked first."""
    d = F.trim(F.replace(F.lower(F.coalesce(domain, F.lit(""))), F.lit("www."), F.lit("")))
    return (
        F.when(_suffix_of(d, low_cred or LOW_CRED_DOMAINS), "low_cred")
        .when(_suffix_of(d, trusted or TRUSTED_DOMAINS), "trusted")
        .otherwise("unknown")
    )


def host_suffixes(domain: Column) -> Column:
    """The domain and what is left of it after each dot, longest first."""
    parts = F.split(domain, "\\.")
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))
