"""URLs in short texts: finding, classifying and removing them. All native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..skew import let

# Results depend on these lists and their order of tests.
MEDIA_EXTENSIONS = (".gif", ".jpg", ".jpeg", ".png", ".mp4", ".webm", ".mov")
SOCIAL_DOMAINS = ("twitter.com", "t.co", "facebook.com", "instagram.com", "reddit.com", "linkedin.com", "tiktok.com")
NEWS_DOMAINS = (
    "nytimes.com", "bbc.com", "cnn.com", "reuters.com", "apnews.com", "theguardian.com", "washingtonpost.com",
    "bloomberg.com", "wsj.com", "foxnews.com", "nbcnews.com", "abcnews.com", "usatoday.com", "npr.org",
)
ACADEMIC_DOMAINS = (
    "arxiv.org", "doi.org", "pubmed.gov", "scholar.google.com", "researchgate.net", "academia.edu", "sciencedirect.com",
    "jstor.org", "ieee.org", "acm.org",
)
SHORTENED_DOMAINS = ("t.co", "bit.ly", "tinyurl.com", "goo.gl", "ow.ly", "buff.ly", "is.gd", "tiny.cc")
EPISTEMIC_MARKERS = (
    "study", "studies", "research", "data", "report", "reports", "according to", "shows that", "evidence", "findings",
    "analysis", "statistics", "survey", "poll",
)
URL_PLACEHOLDER = "[URL]"

# One character class: an alternation in a group would recurse once per character in Java.
URL_PATTERN = r"https?://[!$-_a-z]+"
_SHORTENED_PATTERN = rf"(?:https?://)?(?:{'|'.join(SHORTENED_DOMAINS)})/\S+"


def _contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, needles)), lambda d: F.contains(text, d))


def extract_urls(text: Column) -> Column:
    """All URLs in order; none for null and empty texts."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(URL_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def extract_domain(url: Column) -> Column:
    """Lower-case network location without one leading ``www.``; user and port stay; empty if there is none."""
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(place), r"^www\.", "")


def raw_domain(url: Column) -> Column:
    """What follows ``://`` up to the next slash, as it is."""
    return F.regexp_extract(url, r"://([^/]+)", 1)


def classify_domain(url: Column, domain: Column) -> Column:
    low = F.lower(url)
    return (
        F.when(F.exists(F.array(*map(F.lit, MEDIA_EXTENSIONS)), lambda e: F.endswith(low, e)), "media")
        .when(domain == "", "other")
        .when(_contains_any(domain, SHORTENED_DOMAINS), "shortened")
        .when(_contains_any(domain, SOCIAL_DOMAINS), "social")
        .when(_contains_any(domain, NEWS_DOMAINS), "news")
        .when(_contains_any(domain, ACADEMIC_DOMAINS), "academic")
        .otherwise("other")
    )


def classify_url(url: Column) -> Column:
    """media, shortened, social, news, academic or other; domains are tested as substrings, in this order."""
    return let(extract_domain(url), lambda domain: classify_domain(url, domain))


def is_shortened(url: Column) -> Column:
    return url.rlike(_SHORTENED_PATTERN)


def should_fetch(url_type: Column, label: Column, text: Column) -> Column:
    """Whether a URL of this type is worth fetching for a text of this class."""
    return (
        F.when(url_type.isin("media", "social"), False)
        .when(label == "reason", True)
        .when(label == "statement", _contains_any(F.lower(text), EPISTEMIC_MARKERS))
        .when(label == "notification", url_type.isin("news", "academic"))
        .otherwise(False)
    )


def analyze_urls(text: Column, label: Column | None = None) -> Column:
    """Struct of has_urls, url_count and urls (url, type, domain, is_shortened, should_fetch)."""

    def element(url: Column) -> Column:
        def of_domain(domain: Column) -> Column:
            def of_kind(kind: Column) -> Column:
                fetch = F.lit(False) if label is None else F.coalesce(should_fetch(kind, label, text), F.lit(False))
                return F.struct(url.alias("url"), kind.alias("type"), domain.alias("domain"), is_shortened(url).alias("is_shortened"), fetch.alias("should_fetch"))

            return let(classify_domain(url, domain), of_kind)

        return let(extract_domain(url), of_domain)

    urls = F.transform(extract_urls(text), element)
    return let(urls, lambda u: F.struct((F.size(u) > 0).alias("has_urls"), F.size(u).alias("url_count"), u.alias("urls")))


def remove_urls(text: Column, placeholder: str = URL_PLACEHOLDER) -> Column:
    return F.regexp_replace(text, URL_PATTERN, placeholder.replace("\\", "\\\\").replace("$", "\\$"))


def text_without_urls(text: Column) -> Column:
    """Struct of the text without URLs, its white space joined, and the URLs."""
    rest = F.trim(F.regexp_replace(F.regexp_replace(text, URL_PATTERN, ""), r"(?U)\s+", " "))
    return F.struct(rest.alias("text"), extract_urls(text).alias("urls"))


def has_external_url(text: Column, resolved: Column) -> Column:
    """1 if a URL of the text leads, by the map ``resolved``, somewhere other than twitter.com; unknown targets count as such."""
    leads = lambda u: F.coalesce(F.try_element_at(resolved, u), F.lit(""))
    return F.exists(extract_urls(text), lambda u: ~F.contains(leads(u), F.lit("twitter.com"))).cast("int")


def resolve_url(url: Column) -> Column:
    """Where a URL leads: itself, as nothing is fetched."""
    return url


def fetch_url(url: Column) -> Column:
    """Fetched content (title, summary, content_type): null, as nothing is fetched."""
    return F.lit(None).cast("struct<title:string,summary:string,content_type:string>")


def url_alive(url: Column) -> Column:
    return F.lit(True)
