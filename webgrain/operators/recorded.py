"""Recorded answers: their encoding and charset, encyclopedia lookups, press surfaces, mention searches, and reports of runs that failed."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.functions.text import let, matches, normal_name, squeeze
from webgrain.functions.url import host, path, registrable_domain, segments
from webgrain.functions import vocab as V
from webgrain.operators.robots import decide

#: Where a charset is looked for, and what marks an encyclopedia's pages.
CHARSET_HEAD = 2048
HEADER_CHARSET, META_CHARSET = r"(?i)charset=([\w-]+)", r"(?i)<meta[^>]+charset=[\"']?([\w-]+)"
ARTICLE_TITLE, ARTICLE_ITEM = r"(?is)<title>(.*?)\s+-\s+Wikipedia</title>", r'"wgWikibaseItemId"\s*:\s*"(Q\d+)"'
DISAMBIGUATION = ("dmbox-disambig", "Category:Disambiguation_pages", '"All disambiguation pages"')
ARTICLE_BODY, ARTICLE_END, NO_ARTICLE = "mw-parser-output", 'id="catlinks"', "noarticletext"
MENTION_SEARCHES = 5
#: Characters that a page name keeps beside letters, digits and _.-~, as the encoder writes them; it leaves * and turns it round here.
KEPT_IN_NAMES = {"%28": "(", "%29": ")", "%2C": ",", "%27": "'", "%26": "&", "%7E": "~", "*": "%2A"}

_LATIN = "".join(map(chr, range(0x80, 0xA0)))
_WINDOWS = "".join(bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0))
_ENTITY = """struct<entities: map<string, struct<labels: map<string, struct<value: string>>, aliases: map<string, array<struct<value: string>>>,
claims: struct<P856: array<struct<mainsnak: struct<datavalue: struct<value: string>>>>>>>>"""


def charset_of(content_type: Column, body: Column) -> Column:
    """What the answer's header names, else a meta tag in the body's first CHARSET_HEAD bytes, else utf-8."""
    head = F.decode(F.substring(body, 1, CHARSET_HEAD), "ISO-8859-1")
    named = [F.nullif(F.regexp_extract(where, pattern, 1), F.lit("")) for where, pattern in ((content_type, HEADER_CHARSET), (head, META_CHARSET))]
    return F.lower(F.coalesce(*named, F.lit("utf-8")))


def text_in(body: Column, charset: Column) -> Column:
    """A body's text. Charsets beside Latin-1, Windows-1252 and the UTF-16 family are read as UTF-8; bytes that mean nothing become replacement characters."""
    latin = F.decode(body, "ISO-8859-1")
    known = F.when(charset.isin("iso-8859-1", "latin1", "latin-1"), latin).when(charset.isin("windows-1252", "cp1252"), F.translate(latin, _LATIN, _WINDOWS))
    for name in ("utf-16", "utf-16le", "utf-16be"):
        known = known.when(charset == name, F.decode(body, name.upper()))
    return known.otherwise(F.decode(body, "UTF-8"))


def inflate(body: bytes | None, encoding: str | None, most: int) -> bytes | None:
    kind = (encoding or "").lower()
    ways = (16 + zlib.MAX_WBITS,) if "gzip" in kind else (zlib.MAX_WBITS, -zlib.MAX_WBITS) if "deflate" in kind else ()
    for bits in ways if body else ():
        reader = zlib.decompressobj(bits)
        try:
            out = reader.decompress(body, most)
        except zlib.error:
            continue
        if reader.eof or len(out) == most:
            return out
    return body


def decompressed(body: Column, encoding: Column, most: int = 2 << 20) -> Column:
    """A body without its gzip or deflate encoding, cut off beyond `most` bytes; one that is not whole or not so encoded stays as it is."""
    @F.pandas_udf("binary")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bodies, encodings in batches:
            yield pd.Series([inflate(b, e, most) for b, e in zip(bodies, encodings, strict=True)], dtype=object)

    return run(body, encoding)


def fetchable(urls: DataFrame, agents: DataFrame, rules: DataFrame, token: str) -> DataFrame:
    """urls (site, url, ...) without those that the robots rules of their site forbid to `token`; sites without rules allow all."""
    asked = urls.select("site", F.lit(token).alias("token"), path(F.col("url")).alias("path")).distinct()
    denied = decide(agents, rules, asked).where("not allowed").select("site", "path")
    return urls.withColumn("_path", path(F.col("url"))).join(denied.withColumnRenamed("path", "_path"), ["site", "_path"], "left_anti").select(*urls.columns)


def article_name(name: Column) -> Column:
    """The page name under which an encyclopedia would have an article on `name`; null without one."""
    plain = F.trim(squeeze(name))
    coded = F.url_encode(F.replace(F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 1 << 30)), F.lit(" "), F.lit("_")))
    for code, kept in KEPT_IN_NAMES.items():
        coded = F.replace(coded, F.lit(code), F.lit(kept))
    return F.when(plain != "", coded)


def article_signals(html: Column, domain: Column) -> Column:
    """struct(title, item, disambiguation, entries, mentions_domain, no_article) of an encyclopedia page; entries are list items of a disambiguation page's body."""
    text = F.coalesce(html, F.lit(""))
    title, item = F.regexp_extract(text, ARTICLE_TITLE, 1), F.regexp_extract(text, ARTICLE_ITEM, 1)
    several = F.greatest(*[text.contains(mark) for mark in DISAMBIGUATION])
    begin = F.locate(ARTICLE_BODY, text)
    end = F.position(F.lit(ARTICLE_END), text, F.greatest(begin, F.lit(1)))
    body = F.when(begin == 0, text).when(end == 0, F.substring(text, begin, F.char_length(text))).otherwise(F.substring(text, begin, end - begin))
    return F.struct(
        F.when(F.regexp_like(text, F.lit(ARTICLE_TITLE)), F.trim(F.regexp_replace(title, "<[^>]+>", ""))).alias("title"), F.nullif(item, F.lit("")).alias("item"), several.alias("disambiguation"),
        F.when(several, F.regexp_count(body, F.lit(r"<li\b"))).otherwise(0).alias("entries"),
        F.coalesce((domain != "") & F.contains(F.lower(text), F.lower(domain)), F.lit(False)).alias("mentions_domain"), text.contains(NO_ARTICLE).alias("no_article"))


def entity_signals(json: Column, item: Column, brand: Column, domain: Column) -> Column:
    """struct(label, aliases, website, label_match, website_match) of an entity document: the entity `item`, else the first; the website is the first that is a string."""
    entities = F.from_json(json, _ENTITY)["entities"]
    entity = F.coalesce(F.try_element_at(entities, item), F.get(F.map_values(entities), F.lit(0)))

    def signals(e: Column) -> Column:
        label = F.try_element_at(e["labels"], F.lit("en"))["value"]
        aliases = F.coalesce(F.transform(F.try_element_at(e["aliases"], F.lit("en")), lambda a: a["value"]), F.array().cast("array<string>"))
        sites = F.filter(F.transform(e["claims"]["P856"], lambda c: c["mainsnak"]["datavalue"]["value"]), lambda v: v.isNotNull() & ~v.rlike(r"^[{\[]"))
        website, own = F.get(sites, F.lit(0)), normal_name(brand)
        return F.struct(label.alias("label"), F.slice(aliases, 1, 5).alias("aliases"), website.alias("website"),
                        ((own != "") & F.exists(F.concat(F.array(label), aliases), lambda x: normal_name(x) == own)).alias("label_match"),
                        F.coalesce((domain != "") & (registrable_domain(host(website)) == domain), F.lit(False)).alias("website_match"))

    return let(entity, signals)


def lookups_due(names: DataFrame, cached: DataFrame) -> DataFrame:
    """Sites of names that no cached lookup answers; one that was unavailable is asked again."""
    return names.join(cached.where("outcome <> 'unavailable'").select("site"), "site", "left_anti")


def press_surface(docs: DataFrame) -> DataFrame:
    """(site, kind, value, page): a site's page of news, else the first page's link to one, or feed. Sites without any have no row."""
    named = lambda x: matches(x["text"], "press_link") | F.coalesce(F.lower(F.get(segments(x["url"]), F.lit(0))).isin(*V.PRESS_PATH_SEGMENTS), F.lit(False))
    links = F.filter("links", lambda x: x["internal"] & ~F.lower(x["href"]).rlike("^(mailto|tel):") & named(x))
    link = F.get(links, F.lit(0))
    kind = F.when(F.col("role") == "blog", "role:blog").when(F.size(links) > 0, "link").when(F.size("feeds") > 0, "feed")
    value = F.when(F.col("role") == "blog", F.col("url")).when(F.size(links) > 0, F.concat(F.substring(F.trim(link["text"]), 1, 40), F.lit(" -> "), link["url"])).otherwise(F.get("feeds", F.lit(0)))
    found = docs.select("site", "page_ord", kind.alias("kind"), value.alias("value"), F.col("url").alias("page")).where("kind is not null")
    return found.groupBy("site").agg(F.min_by(F.struct("kind", "value", "page"), F.struct(F.col("kind") != "role:blog", "page_ord", "page")).alias("s")).select("site", "s.*")


def mention_searches(brand: Column, domain: Column, city: Column, most: int = MENTION_SEARCHES) -> Column:
    """Searches for mentions elsewhere: the name alone, with its city, its domain, reviews and a profile; the domain stands in for a missing name."""
    quoted = F.concat(F.lit('"'), F.coalesce(brand, domain, F.lit("")), F.lit('"'))
    tails = (F.lit(""), F.when(city != "", city), F.coalesce(domain, F.lit("")), F.lit("reviews"), F.lit("site:linkedin.com"))
    asked = F.array(*[F.trim(F.concat(quoted, F.lit(" "), tail)) for tail in tails])
    return F.slice(F.filter(asked, lambda q: q.isNotNull() & (q != '""')), 1, most)


def failed_report(runs: DataFrame) -> DataFrame:
    """(site, report): what stands for the report of a run that failed, so that it never reads as a clean one. runs: site, error."""
    error = F.coalesce("error", F.lit("unknown"))
    finding = F.struct(F.lit("F-001").alias("id"), F.lit("or.run.probe_error").alias("check_id"), F.lit("info").alias("severity"), F.lit("The audit did not finish").alias("title"),
                       F.substring(error, 1, 280).alias("evidence"), F.lit("Run it again when what it reads is there.").alias("action"))
    counts = F.struct(F.lit(1).alias("total"), *[F.lit(int(s == "info")).alias(s) for s in ("critical", "high", "medium", "low", "info")])
    report = F.struct(F.col("site"), counts.alias("summary"), F.concat(F.lit("Nothing was evaluated: "), F.substring(error, 1, 160)).alias("headline"), F.array(finding).alias("findings"),
                      F.array(F.concat(F.lit("The audit did not finish: "), error)).alias("limitations"))
    return runs.select("site", report.alias("report"))
