"""What a site calls itself, and whether that name leads to it: candidates for the name, shorter names, and lookups as a fold over attempts.

A lookup tries at most two targets in order: the site's own link to an encyclopedia or an entity base where it has one, else the
article under its name and under its shortest other name. The first answer that is not "no such page" decides, the last one at any rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webgrain.functions.text import normal_name, squeeze
from webgrain.functions.url import host
from webgrain.operators.facts import ORG_TYPES, text_of
from webgrain.operators.recorded import article_name

#: What parts a title, how many words a name has, hosts and paths of lookups, how many targets are tried.
TITLE_PARTS = r"\s+[|—–-]\s+|\s*:\s+"
NAME_WORDS = 4
ENCYCLOPEDIA, ENTITIES, ENTITY_PATH = "en.wikipedia.org", "www.wikidata.org", r"/(Q\d+)(?:[/.]|$)"
TARGETS = 2
#: Outcomes that leave an open question about the name.
AMBIGUOUS = ("ambiguous", "collision", "mismatch")


def _words(name: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != ""))


def name_candidates(pages: DataFrame) -> DataFrame:
    """(site, ord, name, source, page): names from the metadata of one page, from the nodes of organizations (on personal sites of persons too), and the part that most titles share.

    pages: usable pages with site, category, role, page_ord, final_url, meta, title, nodes. Home and about come first. A part must stand in the titles of two pages.
    """
    order = F.struct(F.when(F.col("role") == "home", 0).when(F.col("role") == "about", 1).otherwise(2).alias("r"), F.col("page_ord"), F.col("final_url").alias("u"))
    own = F.coalesce(*[F.nullif(F.trim(F.try_element_at("meta", F.lit(k))), F.lit("")) for k in ("og:site_name", "application-name")])
    meta = pages.select("site", "final_url", order.alias("o"), own.alias("name")).where("name is not null").groupBy("site").agg(F.min_by(F.struct("name", "final_url"), "o").alias("m"))
    named = meta.select("site", F.struct(F.lit(0).alias("a"), F.lit(None).cast("struct<r:int,page_ord:int,u:string>").alias("b"), F.lit(0).alias("c")).alias("at"), "m.name", F.lit("meta:og:site_name").alias("source"), F.col("m.final_url").alias("page"))
    who = F.filter("nodes", lambda n: n["top"] & (F.exists(n["types"], lambda t: t.isin(*ORG_TYPES)) | ((F.col("category") == "portfolio_personal") & F.array_contains(n["types"], "Person"))))
    told = pages.select("site", "final_url", order.alias("o"), F.posexplode(F.transform(who, lambda n: F.struct(F.trim(text_of(n["json"], "name")).alias("name"), F.get(n["types"], F.lit(0)).alias("type")))).alias("c", "n"))
    structured = told.where("n.name <> ''").select("site", F.struct(F.lit(1).alias("a"), F.col("o").alias("b"), "c").alias("at"), "n.name", F.concat(F.lit("jsonld:"), F.col("n.type"), F.lit(".name")).alias("source"), F.col("final_url").alias("page"))
    parts = pages.select("site", "final_url", order.alias("o"), F.posexplode(F.transform(F.split("title", TITLE_PARTS), lambda s: F.trim(s))).alias("c", "name")).where(_words(F.col("name")).between(1, NAME_WORDS))
    shared = parts.groupBy("site", "name").agg(F.count_distinct("final_url").alias("n"), F.min(F.struct("o", "c")).alias("first")).where("n >= 2")
    common = shared.groupBy("site").agg(F.min_by("name", F.struct((-F.col("n")).alias("k"), "first")).alias("name"))
    titled = common.select("site", F.struct(F.lit(2).alias("a"), F.lit(None).cast("struct<r:int,page_ord:int,u:string>").alias("b"), F.lit(0).alias("c")).alias("at"), "name", F.lit("title:common_segment").alias("source"), F.lit(None).cast("string").alias("page"))
    cast = lambda df: df.select("site", F.col("at").cast("struct<a:int,b:struct<r:int,page_ord:bigint,u:string>,c:int>").alias("at"), "name", "source", "page")
    every = cast(named).unionByName(cast(structured)).unionByName(cast(titled))
    return every.withColumn("ord", F.row_number().over(W.partitionBy("site").orderBy("at", "name"))).select("site", "ord", "name", "source", "page")


def distinct_names(candidates: DataFrame) -> DataFrame:
    """(site, key, ord, name, source, page): candidates that differ beyond case, punctuation and legal form, each as it comes first."""
    rows = candidates.withColumn("key", normal_name(F.col("name"))).where("key <> ''")
    return rows.groupBy("site", "key").agg(F.min_by(F.struct("ord", "name", "source", "page"), "ord").alias("f")).select("site", "key", "f.*")


def conflicts(candidates: DataFrame) -> DataFrame:
    """(site, names): sites with two names of which neither holds the other; names are all distinct ones in order (name, source, page)."""
    rows = distinct_names(candidates).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "source", "page", "key"))).alias("names"))
    apart = F.exists("names", lambda a: F.exists("names", lambda b: ~F.contains(a["key"], b["key"]) & ~F.contains(b["key"], a["key"])))
    return rows.where(apart)


def alternates(brands: DataFrame, candidates: DataFrame) -> DataFrame:
    """(site, names): shorter names that the site also uses, fewest words first, then fewest letters, then as they come. brands: site, brand."""
    known = candidates.join(brands.select("site", "brand"), "site").withColumn("name", squeeze(F.col("name")))
    rows = known.withColumn("key", normal_name(F.col("name"))).where(
        (_words(F.col("name")) < _words(F.coalesce("brand", F.lit("")))) & F.col("name").rlike("[A-Za-z]{2}") & (F.col("key") != "") & (F.col("key") != normal_name(F.col("brand"))))
    firsts = rows.groupBy("site", "key").agg(F.min_by(F.struct("ord", "name"), "ord").alias("f")).select("site", "f.*")
    return firsts.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct(_words(F.col("name")).alias("w"), F.char_length("name").alias("l"), "ord", "name"))), lambda x: x["name"]).alias("names"))


def lookup_plan(names: DataFrame) -> DataFrame:
    """(site, mode, item, targets): what to ask, in order. names: site, brand, same_as (links), alternates (names).

    verify_wikipedia: the first link to an encyclopedia; verify_wikidata: the first to an entity; else discover: the article under the brand
    and under the first alternate, where they differ. skipped: there is no name of two letters to look up, and no target.
    """
    links = F.coalesce("same_as", F.array().cast("array<string>"))
    article = F.get(F.filter(links, lambda u: F.contains(host(u), F.lit("wikipedia.org"))), F.lit(0))
    entity = F.get(F.filter(links, lambda u: F.contains(host(u), F.lit("wikidata.org")) & F.regexp_like(u, F.lit(ENTITY_PATH))), F.lit(0))
    item = F.when(article.isNull() & entity.isNotNull(), F.regexp_extract(entity, ENTITY_PATH, 1))
    page = lambda name: F.concat(F.lit(f"https://{ENCYCLOPEDIA}/wiki/"), article_name(name))
    speaking = F.coalesce(F.col("brand").rlike("[A-Za-z]{2}") & article_name(F.col("brand")).isNotNull(), F.lit(False))
    mode = F.when(article.isNotNull(), "verify_wikipedia").when(entity.isNotNull(), "verify_wikidata").when(speaking, "discover").otherwise("skipped")
    found = F.slice(F.array_distinct(F.array_compact(F.array(page(F.col("brand")), page(F.get(F.coalesce("alternates", F.array().cast("array<string>")), F.lit(0)))))), 1, TARGETS)
    targets = F.when(article.isNotNull(), F.array(article)).when(entity.isNotNull(), F.array(F.concat(F.lit(f"https://{ENTITIES}/wiki/Special:EntityData/"), item, F.lit(".json")))).when(
        speaking, found).otherwise(F.array().cast("array<string>"))
    return names.select("site", mode.alias("mode"), item.alias("item"), targets.alias("targets"))


def deciding_attempt(plan: DataFrame, answers: DataFrame) -> DataFrame:
    """plan with target and answer (a struct): the first attempt that did not say 404, else the last. answers: url, status, error, skipped and signals."""
    asked = plan.select("site", "mode", F.size("targets").alias("n"), F.posexplode("targets").alias("seq", "url"))
    rows = asked.join(answers, "url")
    final = (F.coalesce(F.col("status"), F.lit(0)) != 404) | (F.col("seq") == F.col("n") - 1)
    rest = [c for c in answers.columns if c != "url"]
    picked = rows.groupBy("site").agg(F.coalesce(F.min_by(F.struct("url", *rest), F.when(final, F.col("seq"))), F.max_by(F.struct("url", *rest), "seq")).alias("answer"))
    return plan.join(picked, "site", "left")


def lookup_outcome(plan: DataFrame, answers: DataFrame) -> DataFrame:
    """(site, mode, target, outcome, reason) of recorded lookups.

    answers: url, status, error, skipped, and for articles no_article, disambiguation, mentions_domain (article_signals), for entities label_match,
    website_match (entity_signals; both null where the document could not be read). outcome: verified, ambiguous (the name has several meanings),
    collision (the article is about something else), mismatch (the site's own link is about something else), not_found, unavailable, skipped.
    """
    met, a = deciding_attempt(plan, answers), lambda c: F.col(f"answer.{c}")
    failed = F.when(F.col("answer").isNull(), "network_disabled").when(a("skipped").isNotNull(), "robots_disallow").when(a("error").contains("timeout"), "lookup_timeout").when(
        a("error") == "network_disabled", "network_disabled").when(a("error").isNotNull(), "lookup_failed").when(a("status") == 404, F.lit(None)).when(
        F.coalesce(a("status"), F.lit(0)) != 200, "lookup_failed").when((F.col("mode") == "verify_wikidata") & a("label_match").isNull() & a("website_match").isNull(), "lookup_failed")
    yes = lambda c: F.coalesce(a(c), F.lit(False))
    verifying = F.col("mode") == "verify_wikipedia"
    outcome = (F.when(F.col("mode") == "skipped", "skipped").when(failed.isNotNull(), "unavailable").when(a("status") == 404, "not_found")
               .when(F.col("mode") == "verify_wikidata", F.when(yes("label_match") | yes("website_match"), "verified").otherwise("mismatch")).when(yes("no_article"), "not_found")
               .when(verifying & yes("disambiguation"), "mismatch").when(verifying, "verified").when(yes("disambiguation"), "ambiguous").when(yes("mentions_domain"), "verified").otherwise("collision"))
    reason = F.when(F.col("mode") == "skipped", "no_brand_name").otherwise(failed)
    return met.select("site", "mode", F.coalesce(a("url"), F.get("targets", F.lit(0))).alias("target"), outcome.alias("outcome"), reason.alias("reason"))
