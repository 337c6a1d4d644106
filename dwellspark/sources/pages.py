"""Listing fields out of raw HTML pages, with regular expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Bounds of plausible coordinates.
LAT_RANGE, LNG_RANGE = (49.0, 61.0), (-8.0, 2.0)


def visible_text(html: Column) -> Column:
    """A page's text: no scripts, styles or comments; blocks end lines; entities of markup resolved."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)</(?:p|div|li|h[1-6]|dt|dd|td|th|tr|title|ul|section|article|nav)>|<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, r"[ \t\x0B\f\r ]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r" ?\n[ \n]*", "\n"), r"^\s+|\s+$", "")


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(html: Column) -> Column:
    """Targets of all links, without query and fragment, in order and once each."""
    found = F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*\bhref="([^"#?]*)'), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def pairs(html: Column) -> Column:
    """map of label to text from definition lists (the first of equal labels)."""
    hits = F.regexp_extract_all(html, F.lit(r"(?is)<dt[^>]*>(.*?)</dt>\s*<dd[^>]*>.*?</dd>"), F.lit(0))
    clean = lambda x, tag: F.trim(F.regexp_replace(F.regexp_extract(x, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), r"<[^>]*>", ""))
    entries = F.transform(hits, lambda x: F.struct(F.lower(clean(x, "dt")).alias("key"), clean(x, "dd").alias("value")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(entries, lambda e: e["key"] == k), F.lit(0))["value"]))


def images(html: Column, n: int = 10) -> Column:
    found = F.regexp_extract_all(html, F.lit(r'(?i)<img\b[^>]*\bsrc="([^"]+)"'), F.lit(1))
    real = F.filter(F.array_distinct(found), lambda x: ~F.lower(x).rlike(r"logo|icon|placeholder|\.svg"))
    return F.slice(real, 1, n)


def coordinate(html: Column, names: str, low: float, high: float) -> Column:
    v = F.regexp_extract(html, rf'(?i)"(?:{names})"\s*:\s*"?(-?[0-9]+\.[0-9]+)', 1).try_cast("double")
    return F.when(v.between(low, high), v)


def parse_pages(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """Listing fields of each page (url, html)."""
    h = F.col(html)
    body = visible_text(h)
    pcm, pw = text.price_of_page(body)
    return pages.select(
        F.col(url),
        title(h).alias("title"),
        body.alias("body"),
        pcm.alias("price_pcm"),
        pw.alias("price_pw"),
        text.monthly_price(pcm, pw).alias("monthly"),
        text.postcode_district(body).alias("postcode_district"),
        text.largest_size(body, "sq\\.?\\s*ft").alias("size_sqft"),
        coordinate(h, "lat|latitude", *LAT_RANGE).alias("latitude"),
        coordinate(h, "lng|lon|longitude", *LNG_RANGE).alias("longitude"),
        pairs(h).alias("details"),
        links(h).alias("links"),
        images(h).alias("images"),
    )
