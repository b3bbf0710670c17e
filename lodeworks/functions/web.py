"""Addresses and page text with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeworks.functions.exprs import col, trimmed

SCHEME_HOST = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)(.*)$"


def host_of(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), SCHEME_HOST, 2))


def bare_host(url: Column | str) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "")


def site_root(url: Column | str) -> Column:
    """``scheme://host``, null without a host."""
    url = col(url)
    scheme, host = F.regexp_extract(url, SCHEME_HOST, 1), F.regexp_extract(url, SCHEME_HOST, 2)
    return F.when(host != "", F.concat(scheme, F.lit("://"), host))


def normalize_url(url: Column | str) -> Column:
    """Null synonyms to null, scheme and host lower-cased, scheme added when missing."""
    s = trimmed(url)
    low = F.lower(s)
    lowered = F.concat(
        F.lower(F.regexp_extract(s, SCHEME_HOST, 1)),
        F.lit("://"),
        F.lower(F.regexp_extract(s, SCHEME_HOST, 2)),
        F.regexp_extract(s, SCHEME_HOST, 3),
    )
    return (
        F.when(s.isNull() | low.isin("null", "none", "n/a", "-"), F.lit(None))
        .when(low.rlike(r"^https?://[^/?#]"), lowered)
        .when(F.startswith(s, F.lit("//")), F.concat(F.lit("https:"), s))
        .when(low.rlike(r"^https?://"), s)
        .otherwise(F.concat(F.lit("https://"), s))
    )


def prefixed_url(url: Column | str) -> Column:
    """Short form: trim, add a scheme when missing."""
    s = trimmed(url)
    return F.when(F.lower(s).rlike(r"^https?://"), s).otherwise(F.concat(F.lit("https://"), s))


def flattened_url(url: Column | str) -> Column:
    """Whole address lower-cased with doubled slashes after the scheme collapsed."""
    s = F.lower(prefixed_url(url))
    return F.concat(
        F.regexp_extract(s, r"^(https?://)", 1),
        F.regexp_replace(F.regexp_replace(s, r"^https?://+", ""), r"/{2,}", "/"),
    )


def html_text(html: Column | str) -> Column:
    """Page text: scripts and styles dropped, tags dropped, blanks collapsed."""
    s = F.regexp_replace(col(html), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))
