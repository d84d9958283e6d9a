"""Which page plays which role, which link is worth a check, what kind of site it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webgrain.functions import vocab as V
from webgrain.functions.dims import dim
from webgrain.functions.text import squeeze
from webgrain.functions.url import host, is_page_part, path, registrable_domain, segments

LABEL_CHARS = 60


def label(text: Column) -> Column:
    return F.lower(squeeze(text))


def phrase_in(text: Column, phrase: Column) -> Column:
    """Whether a phrase is in a text as whole words; the text is a label, with a space on each side of every word."""
    return (text == phrase) | bare_words(text).contains(bare_words(phrase))


def bare_words(text: Column) -> Column:
    """The words of a text with one space before, between and after them."""
    return F.concat(F.lit(" "), F.regexp_replace(text, r"(?U)[^\w']+", " "), F.lit(" "))


def is_label(text: Column, max_words: int = V.NAV_LABEL_MAX_WORDS) -> Column:
    return (text != "") & (F.char_length(text) <= LABEL_CHARS) & (F.size(F.split(text, r"\s+")) <= max_words)


def role_candidates(links: DataFrame, sitemap: DataFrame | None = None) -> DataFrame:
    """links: site, ord, url, text, context (internal ones of the home page). One row for each site, role and URL, `rank` from 1.

    A link is a candidate by the first keyword of its label or a slug at an end of its path; both together are strongest, then the
    landmark, then the depth. Sitemap URLs follow by pattern order.
    """
    spark = links.sparkSession
    rows = links.where(~is_page_part(F.col("url"))).select("site", "ord", "url", label(F.col("text")).alias("label"), F.coalesce("context", F.lit("body")).alias("context"),
                                                           segments(F.col("url")).alias("parts"))
    words = dim(spark, "role_keyword").groupBy("role").agg(F.array_sort(F.collect_list(F.struct("ord", "phrase", bare_words(F.col("phrase")).alias("bare")))).alias("phrases"))
    slugs = dim(spark, "role_slug").groupBy("role").agg(F.array_sort(F.collect_list(F.struct("ord", "slug"))).alias("slugs"))
    rules = F.broadcast(words.join(slugs, "role").agg(F.array_sort(F.collect_list(F.struct("role", "phrases", "slugs"))).alias("rules")))  # one row of five roles
    named = F.when(is_label(F.col("label")), F.struct("label", bare_words(F.col("label")).alias("bare")))
    crossed = rows.select("site", "ord", "url", "context", "parts", named.alias("named")).join(rules)
    keyword = lambda r: F.when(F.col("named").isNotNull(), F.get(F.filter(r["phrases"], lambda p: (F.col("named.label") == p["phrase"]) | F.col("named.bare").contains(p["bare"])), F.lit(0))["phrase"])
    slug = lambda r: F.when(F.size("parts") > 0, F.get(F.filter(r["slugs"], lambda s: (F.get(F.col("parts"), F.lit(0)) == s["slug"]) | ((F.size("parts") > 1) & (F.element_at("parts", -1) == s["slug"]))), F.lit(0))["slug"])
    found = F.filter(F.transform("rules", lambda r: F.struct(r["role"].alias("role"), keyword(r).alias("keyword"), slug(r).alias("slug"))), lambda x: x["keyword"].isNotNull() | x["slug"].isNotNull())
    hit = crossed.select("site", "ord", "url", "context", F.size("parts").alias("depth"), F.inline(found))
    ranked = hit.join(F.broadcast(dim(spark, "context_rank")), "context", "left").select(
        "site", "role", "url", F.lit(0).alias("src"), F.when(F.col("keyword").isNotNull() & F.col("slug").isNotNull(), 0).otherwise(1).alias("strength"),
        F.coalesce("rank", F.lit(3)).alias("place"), "depth", "ord", F.coalesce("keyword", "slug").alias("matched"))
    if sitemap is not None:
        patterns = F.broadcast(dim(spark, "role_sitemap_pattern").withColumnRenamed("ord", "pattern_ord"))
        p = F.lower(path(F.col("url")))
        fits = F.when(F.col("pattern").endswith("/"), p.startswith(F.col("pattern"))).otherwise(F.regexp_replace(p, "/+$", "") == F.regexp_replace("pattern", "/+$", ""))
        mapped = sitemap.where(~is_page_part(F.col("url"))).join(patterns, fits).select(
            "site", "role", "url", F.lit(1).alias("src"), F.lit(0).alias("strength"), F.col("pattern_ord").alias("place"), F.lit(0).alias("depth"), "ord",
            F.col("pattern").alias("matched"))
        ranked = ranked.unionByName(mapped)
    best = ("src", "strength", "place", "depth", "ord", "url")
    # one shuffle by site serves both windows and what picks from a site's candidates
    once = ranked.repartition("site").withColumn("key", F.regexp_replace("url", "/+$", "")).withColumn("n", F.row_number().over(
        W.partitionBy("site", "role", "key").orderBy(*best))).where("n = 1")
    return once.withColumn("rank", F.row_number().over(W.partitionBy("site", "role").orderBy(*best))).select(
        "site", "role", "rank", "url", F.when(F.col("src") == 0, "nav").otherwise("sitemap").alias("source"), "matched")


def pick_pages(candidates: DataFrame) -> DataFrame:
    """The page of each role, in role order; a URL that a role took is not free for the next. candidates: as role_candidates() ranks them.

    The roles before one take a URL each, so its first len(ROLE_ORDER) candidates decide, and those of a site are a row of bounded size.
    """
    turn = F.array_position(F.array(*map(F.lit, V.ROLE_ORDER)), F.col("role"))
    rows = candidates.where(F.col("rank") <= len(V.ROLE_ORDER)).select("site", F.struct(turn.alias("turn"), "rank", "role", "url", "source", "matched", F.regexp_replace("url", "/+$", "").alias("key")).alias("c")).where("c.turn > 0")
    listed = rows.groupBy("site").agg(F.array_sort(F.collect_list("c")).alias("c"))
    free = lambda taken, c: ~F.exists(taken, lambda t: (t["turn"] == c["turn"]) | (t["key"] == c["key"]))
    picked = F.aggregate("c", F.slice("c", 1, 0), lambda taken, c: F.when(free(taken, c), F.array_append(taken, c)).otherwise(taken))
    return listed.select("site", F.inline(picked)).select("site", "role", "url", "source", "matched")


def missing_roles(picked: DataFrame, sites: DataFrame) -> DataFrame:
    roles = F.broadcast(dim(picked.sparkSession, "role").select("role"))
    return sites.select("site").join(roles).join(picked.select("site", "role"), ["site", "role"], "left_anti")


def link_sample(links: DataFrame, most: int = V.LINK_SAMPLE_MAX) -> DataFrame:
    """links: site, page_ord, ord, url, context. The first `most` distinct internal URLs of a site by landmark, page and place."""
    ranks = F.create_map(*[F.lit(x) for pair in V.CONTEXT_RANK.items() for x in pair])
    rows = links.withColumn("place", F.coalesce(F.try_element_at(ranks, F.col("context")), F.lit(3))).withColumn("key", F.regexp_replace("url", "/+$", ""))
    order = ("place", "page_ord", "ord", "url")
    once = rows.withColumn("n", F.row_number().over(W.partitionBy("site", "key").orderBy(*order))).where("n = 1")
    return once.withColumn("rank", F.row_number().over(W.partitionBy("site").orderBy(*order))).where(F.col("rank") <= most).select("site", "rank", "url", "context")


#: Pages that make a small site, prices that make a shop.
SMALL_SITE, SHOP_PRICES = 5, 3


def score_categories(spark: SparkSession, sites: DataFrame, nav: DataFrame, urls: DataFrame, types: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Scores of every site and category. nav: site, text. urls: site, url. types: site, type (JSON-LD). counts: site, pages, prices.

    Each kind of evidence is counted once for each distinct value and capped; a declared type counts 3, a general one 2. Labels of a cluster count with the
    other labels, where enough of its members are there. Few pages speak for a personal site, several prices on the home page for a shop.
    """
    signal = F.broadcast(dim(spark, "category_signal").withColumnRenamed("ord", "signal_ord"))
    of = lambda kind: signal.where(F.col("kind") == kind)
    texts = nav.select("site", label(F.col("text")).alias("label")).distinct().where(is_label(F.col("label")))
    words = texts.join(of("nav"), phrase_in(F.col("label"), F.col("value"))).withColumn(
        "n", F.row_number().over(W.partitionBy("site", "category", "label").orderBy("signal_ord"))).where("n = 1").select("site", "category", "kind", "value")
    least = V.CATEGORY_SIGNALS["publisher_media"]["nav_cluster"]["min"]
    section = texts.join(of("nav_cluster"), phrase_in(F.col("label"), F.col("value"))).groupBy("site", "category").agg(
        F.collect_set("value").alias("members")).where(F.size("members") >= least).select("site", "category", F.lit("section").alias("kind"), F.array_join(F.array_sort("members"), "+").alias("value"))
    paths = urls.select("site", F.lower("url").alias("url")).distinct().join(of("url"), F.col("url").contains(F.col("value"))).select("site", "category", "kind", "value").distinct()
    labels = F.split("site", r"\.")
    tld = sites.select("site").join(of("tld"), F.array_contains(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), F.col("value"))).select("site", "category", "kind", "value")
    own = types.select("site", "type").distinct()
    declared = own.join(signal.where("kind in ('jsonld', 'jsonld_generic')"), F.col("type") == F.col("value")).select("site", "category", "kind", "value")
    every = words.unionByName(section).unionByName(paths).unionByName(tld).unionByName(declared)
    if counts is not None:
        told = F.array_compact(F.array(F.when(F.col("pages") <= SMALL_SITE, F.struct(F.lit("portfolio_personal").alias("category"), F.lit("pages").alias("kind"), F.lit(f"<={SMALL_SITE}").alias("value"))),
                                       F.when(F.col("prices") >= SHOP_PRICES, F.struct(F.lit("ecommerce").alias("category"), F.lit("prices").alias("kind"), F.col("prices").cast("string").alias("value")))))
        every = every.unionByName(counts.select("site", F.inline(told)))
    kinds = every.groupBy("site", "category", "kind").agg(F.count_distinct("value").alias("n"), F.array_sort(F.collect_set("value")).alias("values"))
    caps = V.SCORE_CAPS
    labels_found = F.sum(F.when(F.col("kind") == "nav", F.least("n", F.lit(caps["nav"])))).over(W.partitionBy("site", "category"))
    members = F.size(F.split(F.get("values", F.lit(0)), r"\+"))
    kinds = kinds.withColumn("room", F.greatest(F.lit(0), F.least(members, caps["nav"] - F.coalesce(labels_found, F.lit(0)))))
    points = (F.when(F.col("kind") == "jsonld", caps["jsonld"]).when(F.col("kind") == "jsonld_generic", caps["jsonld_generic"]).when(F.col("kind").isin("pages", "prices"), 2)
              .when(F.col("kind") == "section", F.col("room")).when(F.col("kind") == "nav", F.least("n", F.lit(caps["nav"])))
              .when(F.col("kind") == "url", F.least("n", F.lit(caps["url"]))).otherwise(caps["tld"]))
    rank = F.when(F.col("kind").startswith("jsonld"), 3).when(F.col("kind").isin("nav", "section"), 2).when(F.col("kind") == "url", 1).otherwise(0)
    specific = W.partitionBy("site", "category")
    kept = kinds.withColumn("has_type", F.max(F.col("kind") == "jsonld").over(specific)).where(~((F.col("kind") == "jsonld_generic") & F.col("has_type")))
    summed = kept.groupBy("site", "category").agg(F.sum(points).cast("int").alias("score"), F.max(rank).alias("strength"), F.count(F.lit(1)).cast("int").alias("breadth"),
                                                  F.array_sort(F.flatten(F.collect_list(F.transform("values", lambda v: F.concat("kind", F.lit(":"), v))))).alias("signals"))
    every_category = sites.select("site").join(F.broadcast(dim(spark, "category")))
    return every_category.join(summed, ["site", "category"], "left").fillna({"score": 0, "strength": 0, "breadth": 0})


def categorize(scores: DataFrame) -> DataFrame:
    """(site, category, confidence): the best score if it reaches the threshold and is no exact tie, else unknown."""
    order = W.partitionBy("site").orderBy(F.desc("score"), F.desc("strength"), F.desc("breadth"), "ord")
    key = F.struct("score", "strength", "breadth")
    ranked = scores.withColumn("key", key).withColumn("next", F.lead("key").over(order)).withColumn("n", F.row_number().over(order)).where("n = 1")
    sure = (F.col("score") >= V.THRESHOLD) & ~F.coalesce(F.col("key") == F.col("next"), F.lit(False))
    return ranked.select("site", F.when(sure, F.col("category")).otherwise("unknown").alias("category"),
                         F.when(sure & (F.col("score") >= 6), "high").when(sure, "medium").otherwise("low").alias("confidence"), "score")


def sibling(url: Column, site: Column) -> Column:
    """Whether a URL is of the site's registrable domain."""
    return registrable_domain(host(url)) == registrable_domain(site)
