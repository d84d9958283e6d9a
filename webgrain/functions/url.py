"""Column expressions over URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webgrain.functions import vocab as V


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def host(url: Column) -> Column:
    """Lower-case host without user, port; empty where there is none."""
    place = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r":\d*$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)


def normalize(url: Column) -> Column:
    """Scheme and host in lower case, default port and fragment dropped, an empty path as /."""
    place = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    plain = F.when(scheme(url) == "http", F.regexp_replace(place, r":80$", "")).when(scheme(url) == "https", F.regexp_replace(place, r":443$", "")).otherwise(place)
    tail = F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise("")
    return F.when(place != "", F.concat(scheme(url), F.lit("://"), plain, F.when(path(url) == "", "/").otherwise(path(url)), tail)).otherwise(url)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url))


def registrable_domain(name: Column) -> Column:
    """The last two labels of a host, three under a second-level suffix."""
    labels = F.split(F.lower(name), r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 2), F.lit(3)), ".")
    return F.when(F.size(labels) <= 2, F.lower(name)).when(two.isin(*V.SECOND_LEVEL), three).otherwise(two)


def without_www(name: Column) -> Column:
    return F.regexp_replace(name, r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    return (a != "") & (without_www(a) == without_www(b))


def segments(url: Column) -> Column:
    return F.filter(F.split(F.lower(path(url)), "/"), lambda p: p != "")


def is_page_part(url: Column) -> Column:
    """Whether a path segment names a piece of a page."""
    return F.arrays_overlap(segments(url), F.array(*[F.lit(s) for s in V.PAGE_PART_SEGMENTS]))


def country_language(name: Column) -> Column:
    """The language of a country domain, else null."""
    table = F.create_map(*[F.lit(x) for pair in V.CCTLD_LANGUAGE.items() for x in pair])
    return F.try_element_at(table, F.element_at(F.split(name, r"\."), -1))


def language_edition(url: Column) -> Column:
    """The language that the first path segment or the leftmost label of the host names, else null."""
    codes = [F.lit(c) for c in V.LANG_CODES]
    first, label = F.get(segments(url), F.lit(0)), F.element_at(F.split(host(url), r"\."), 1)
    short = F.regexp_extract(first, r"^([a-z]{2})(?:[-_][a-z]{2})?$", 1)
    return F.coalesce(F.when(short.isin(*codes), short), F.when(label.isin(*codes), label))


def canonical_key(url: Column) -> Column:
    """What two URLs of one page share: host without www, path in lower case without the last slash."""
    return F.concat(without_www(host(url)), F.regexp_replace(F.lower(path(url)), r"/+$", ""))


def sitemap_rank(url: Column) -> Column:
    """0 to 8: site-wide sitemaps first, slices of a site last."""
    parts = segments(url)
    stem = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), r"\.(xml|txt)(\.gz)?$", "")
    names = F.filter(F.split(stem, r"[^a-z]+"), lambda w: w != "")
    has = lambda table: F.arrays_overlap(names, F.array(*[F.lit(w) for w in table]))
    base = F.when(stem.isin("sitemap", "sitemap_index", "sitemap-index", "sitemapindex"), 0).when(has(V.SITEMAP_GENERAL), 1).otherwise(2)
    return base + F.when(F.size(parts) > 1, 2).otherwise(0) + F.when(has(V.SITEMAP_SPECIFIC), 4).otherwise(0)
