"""Queries over pages and answers that are made of the tables by a rule on the key: structured data at any depth, names, lookups, redirects, sitemaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from webgrain.operators import entities, fetched, html, nodes
from webgrain.queries import SITES, _sites, _t, query
from webgrain.sources.store import written

_ORG = '{"@type": "Organization", "name": "Maker", "address": {"streetAddress": "1 High Street"}}'
#: What hangs from a made page's node, by its key modulo 6: over one owner key, another key, three owner keys, four, a person, nothing.
_HANGING = [f', "publisher": {_ORG}', f', "about": {_ORG}', f', "author": {{"publisher": [{{"creator": {_ORG}}}]}}', f', "author": {{"publisher": {{"creator": {{"brand": {_ORG}}}}}}}', ', "author": {"@type": "Person", "name": "Ann"}', ""]
#: Types by the key modulo 5.
_TYPES = ['"Product"', '"Bakery"', '["Thing", "School"]', '["School", "Person"]', '"Widget"']


def _marked(spark, sf_dir):
    """A page for each part: a node whose name is blank for every third, whose offers are missing for every seventh."""
    p = F.col("p_partkey")
    turn = lambda values: F.element_at(F.array(*map(F.lit, values)), (p % len(values) + 1).cast("int"))
    offers = F.when(p % 7 != 0, F.concat(F.lit(', "offers": [{"price": "'), p.cast("string"), F.lit('"}, {"price": '), p.cast("string"), F.lit(".5}]"))).otherwise("")
    node = F.concat(F.lit('{"@graph": [{"@type": '), turn(_TYPES), F.lit(', "name": "'), F.when(p % 3 == 0, " ").otherwise(F.concat(F.lit("Part "), p.cast("string"))), F.lit('"'), offers, turn(_HANGING), F.lit("}]}"))
    page = F.concat(F.lit('<html><head><script type="application/ld+json">'), node, F.lit("</script></head><body><p>x</p></body></html>"))
    return html.parse_pages(_t(spark, sf_dir, "part").select(p.alias("p"), F.concat(F.lit("https://m.test/"), p.cast("string")).alias("url"), page.alias("html")))


@query("""WITH q AS (SELECT p_partkey AS p, p_partkey % 6 AS h FROM part), w AS (SELECT p, CASE h WHEN 0 THEN 'publisher' WHEN 1 THEN 'about' WHEN 2 THEN 'author.publisher.0.creator' WHEN 3 THEN 'author.publisher.creator.brand' END AS stem FROM q)
    SELECT p, '@type' AS path, '@type' AS key, ['Product', 'Bakery', NULL, NULL, 'Widget'][p % 5 + 1] AS value FROM q WHERE p % 5 IN (0, 1, 4) UNION ALL SELECT p, '@type.0', '@type', ['Thing', 'School'][p % 5 - 1] FROM q WHERE p % 5 IN (2, 3)
    UNION ALL SELECT p, '@type.1', '@type', ['School', 'Person'][p % 5 - 1] FROM q WHERE p % 5 IN (2, 3) UNION ALL SELECT p, 'name', 'name', CASE WHEN p % 3 = 0 THEN ' ' ELSE concat('Part ', p) END FROM q
    UNION ALL SELECT p, 'offers.0.price', 'price', p::VARCHAR FROM q WHERE p % 7 <> 0 UNION ALL SELECT p, 'offers.1.price', 'price', concat(p, '.5') FROM q WHERE p % 7 <> 0
    UNION ALL SELECT p, concat(stem, '.@type'), '@type', 'Organization' FROM w WHERE stem IS NOT NULL UNION ALL SELECT p, concat(stem, '.name'), 'name', 'Maker' FROM w WHERE stem IS NOT NULL
    UNION ALL SELECT p, concat(stem, '.address.streetAddress'), 'streetAddress', '1 High Street' FROM w WHERE stem IS NOT NULL UNION ALL SELECT p, 'author.@type', '@type', 'Person' FROM q WHERE h = 4 UNION ALL SELECT p, 'author.name', 'name', 'Ann' FROM q WHERE h = 4""")
def jsonld_walk(spark, sf_dir):
    """Every leaf of the structured data with its path, its nearest key and its value."""
    return nodes.jsonld_walk(_marked(spark, sf_dir), "p").select("p", "path", "key", "value")


@query("""WITH q AS (SELECT p_partkey AS p, p_partkey % 5 AS t, p_partkey % 3 = 0 AS bare, p_partkey % 7 = 0 AS free FROM part), g AS (SELECT p, t, ['Product', 'LocalBusiness', 'Organization', 'Person'][t + 1] AS as_type,
        list_filter(CASE t WHEN 0 THEN ['name'] WHEN 1 THEN ['name', 'address'] WHEN 2 THEN ['name', 'url'] ELSE ['name'] END, lambda k: k <> 'name' OR bare) AS missing, CASE WHEN t = 0 AND free THEN 'offers|aggregateRating|review' ELSE '' END AS unmet FROM q WHERE t < 4)
    SELECT p, ['Product', 'Bakery', 'Thing', 'School'][t + 1] AS type, as_type, array_to_string(missing, ',') AS missing, unmet FROM g WHERE len(missing) > 0 OR unmet <> ''""")
def jsonld_required(spark, sf_dir):
    """Properties that nodes lack, a kind of business graded as a business, a school as an organization, unless one of its types has rules of its own."""
    return nodes.incomplete_nodes(_marked(spark, sf_dir), "p").select("p", "type", "as_type", F.array_join("missing", ",").alias("missing"), F.array_join("unmet", ",").alias("unmet"))


@query("""SELECT p_partkey AS p, (p_partkey % 5 IN (1, 2, 3))::INT + (p_partkey % 6 IN (0, 2))::INT AS organizations, (p_partkey % 5 IN (1, 2, 3))::INT + (p_partkey % 6 IN (0, 2, 4))::INT AS with_persons,
        concat(['Product', 'Bakery', 'Thing,School', 'School,Person', 'Widget'][p_partkey % 5 + 1], CASE WHEN p_partkey % 6 < 4 THEN ',Organization' WHEN p_partkey % 6 = 4 AND p_partkey % 5 <> 3 THEN ',Person' ELSE '' END) AS types,
        CASE WHEN p_partkey % 7 <> 0 THEN concat(p_partkey, ',', p_partkey, '.5') ELSE '' END AS prices FROM part""")
def jsonld_owners(spark, sf_dir):
    """Who is behind a page: at the top, or over three owner keys at most; the types and prices at any depth."""
    return _marked(spark, sf_dir).select("p", F.size(nodes.owners()).alias("organizations"), F.size(nodes.owners(F.lit(True))).alias("with_persons"), F.array_join(nodes.distinct_types(), ",").alias("types"),
                                         F.array_join(nodes.values_of("price"), ",").alias("prices"))


#: Three parts are a site; its pages name it in metadata (every fourth part), in a node (every third) and in titles.
_NAMED = """q AS (SELECT p_partkey // 3 AS s, p_partkey % 3 AS i, p_partkey AS p FROM part), o AS (SELECT *, CASE WHEN i = 0 THEN 0 WHEN i = 1 THEN 1 ELSE 2 END AS r FROM q),
    m AS (SELECT s, min_by(concat('Shop Number ', s), r) AS name, min_by(p, r) AS p FROM o WHERE p % 4 = 0 GROUP BY 1), t AS (SELECT s, count(*) AS n FROM q WHERE p % 5 <> 0 GROUP BY 1),
    e AS (SELECT s, 0 AS a, 0 AS b, name, 'meta:og:site_name' AS source FROM m UNION ALL SELECT s, 1, r, CASE WHEN s % 2 = 0 THEN concat('Other ', s) ELSE concat('Shop Number ', s, ' Ltd') END, 'jsonld:Bakery.name' FROM o WHERE p % 3 = 1
        UNION ALL SELECT s, 2, 0, concat('Number ', s), 'title:common_segment' FROM t WHERE n >= 2),
    c AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY a, b) AS ord, name, source FROM e)"""


def _names(spark, sf_dir):
    p = F.col("p_partkey")
    s, i = F.floor(p / 3), p % 3
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    meta = F.when(p % 4 == 0, text('<meta property="og:site_name" content="Shop Number ', s, '">')).otherwise("")
    name = F.when(s % 2 == 0, text("Other ", s)).otherwise(text("Shop Number ", s, " Ltd"))
    node = F.when(p % 3 == 1, text('<script type="application/ld+json">{"@type": "Bakery", "name": "', name, '"}</script>')).otherwise("")
    title = F.when(p % 5 != 0, text("<title>Page of part ", p, " | Number ", s, "</title>")).otherwise(text("<title>A long title that is no name of anything at all ", p, "</title>"))
    keys = html.spread(_t(spark, sf_dir, "part").select("p_partkey"))  # keys are moved, not pages
    rows = keys.select(s.alias("s"), text("https://s", s, ".test/", p).alias("url"), text("<html><head>", title, meta, node, "</head><body></body></html>").alias("html"),
                                            F.element_at(F.array(F.lit("home"), F.lit("about"), F.lit("blog")), (i + 1).cast("int")).alias("role"), i.cast("int").alias("page_ord"))
    # names are looked for in three ways: the pages are parsed once for them all
    return written(html.parse_pages(rows, parts=("meta", "title", "nodes")), "named").withColumns({"final_url": F.col("url"), "category": F.lit("unknown")})


@query(f"WITH {_NAMED} SELECT concat('s', s, '.test') AS site, ord::INT AS ord, name, source FROM c")
def name_candidates(spark, sf_dir):
    return entities.name_candidates(_names(spark, sf_dir)).select("site", "ord", "name", "source")


@query(f"""WITH {_NAMED} SELECT concat('s', s, '.test') AS site, string_agg(name, ' / ' ORDER BY ord) AS names FROM c WHERE NOT (source = 'jsonld:Bakery.name' AND name LIKE 'Shop%' AND EXISTS (SELECT 1 FROM c d WHERE d.s = c.s AND d.source LIKE 'meta%'))
    GROUP BY s HAVING count(*) FILTER (name LIKE 'Other%') > 0 AND count(*) FILTER (name NOT LIKE 'Other%') > 0""")
def name_conflicts(spark, sf_dir):
    """Legal forms make no other name, a shorter form of a name contradicts nothing."""
    return entities.conflicts(entities.name_candidates(_names(spark, sf_dir))).select("site", F.array_join(F.transform("names", lambda n: n["name"]), " / ").alias("names"))


@query(f"""WITH {_NAMED} SELECT concat('s', s, '.test') AS site, string_agg(name, '|' ORDER BY len(string_split(name, ' ')), length(name), ord) AS names FROM c WHERE len(string_split(name, ' ')) < 3 GROUP BY s""")
def lookup_names(spark, sf_dir):
    """Shorter names of the site besides its brand of three words, the shortest first."""
    found = written(entities.name_candidates(_names(spark, sf_dir)), "names")
    brands = found.select("site").distinct().withColumn("brand", F.concat(F.lit("Shop Number "), F.regexp_extract("site", r"^s(\d+)", 1)))
    return entities.alternates(brands, found).select("site", F.array_join("names", "|").alias("names"))


def _lookups(spark, sf_dir):
    c, k = F.col("c_custkey"), F.col("c_custkey") % 12
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    profile, none = F.lit("https://social.test/me"), F.array().cast("array<string>")
    links = F.when(k < 3, F.array(profile, text("https://de.wikipedia.org/wiki/A", c))).when(k < 6, F.array(text("https://www.wikidata.org/wiki/Q", c), profile)).otherwise(none)
    names = _t(spark, sf_dir, "customer").select(c.alias("site"), F.when(k == 10, "7").otherwise(text("acme works ", c)).alias("brand"), links.alias("same_as"), F.when(k.isin(8, 9), F.array(text("Acme", c))).otherwise(none).alias("alternates"))
    plan = entities.lookup_plan(names)
    asked = plan.select("site", F.posexplode("targets").alias("seq", "url"))
    k, yes = F.col("site") % 12, lambda cond: F.when(cond, True).otherwise(False)
    missing = (k == 2) | (k == 9) | ((k == 8) & (F.col("seq") == 0))
    answers = asked.select("url", F.when(missing, 404).when(k != 11, 200).alias("status"), F.when(k == 11, "read_timeout").alias("error"), F.lit(None).cast("string").alias("skipped"), F.lit(False).alias("no_article"),
                           yes(k.isin(1, 6)).alias("disambiguation"), yes(k == 7).alias("mentions_domain"), F.when(k.isin(3, 4), False).alias("label_match"), F.when(k.isin(3, 4), k == 3).alias("website_match"))
    return plan, answers


@query("""WITH q AS (SELECT c_custkey AS site, c_custkey % 12 AS k, concat('https://en.wikipedia.org/wiki/Acme_works_', c_custkey) AS own FROM customer)
    SELECT site, CASE WHEN k < 3 THEN 'verify_wikipedia' WHEN k < 6 THEN 'verify_wikidata' WHEN k = 10 THEN 'skipped' ELSE 'discover' END AS mode, CASE WHEN k < 3 THEN concat('https://de.wikipedia.org/wiki/A', site)
        WHEN k < 6 THEN concat('https://www.wikidata.org/wiki/Special:EntityData/Q', site, '.json') WHEN k IN (8, 9) THEN concat(own, ' https://en.wikipedia.org/wiki/Acme', site) WHEN k = 10 THEN '' ELSE own END AS targets FROM q""")
def lookup_plans(spark, sf_dir):
    """The site's own links before its name, the name before one shorter name."""
    return _lookups(spark, sf_dir)[0].select("site", "mode", F.array_join("targets", " ").alias("targets"))


@query("""WITH q AS (SELECT c_custkey AS site, c_custkey % 12 AS k FROM customer) SELECT site, ['verified', 'mismatch', 'not_found', 'verified', 'mismatch', 'unavailable', 'ambiguous', 'verified', 'collision', 'not_found', 'skipped', 'unavailable'][k + 1] AS outcome,
    CASE k WHEN 5 THEN 'lookup_failed' WHEN 10 THEN 'no_brand_name' WHEN 11 THEN 'lookup_timeout' END AS reason, CASE WHEN k IN (8, 9) THEN concat('https://en.wikipedia.org/wiki/Acme', site) END AS second_target FROM q""")
def lookup_outcomes(spark, sf_dir):
    """Twelve ways in which a lookup ends; only a page that does not exist leads to the next target."""
    got = entities.lookup_outcome(*_lookups(spark, sf_dir))
    return got.select("site", "outcome", "reason", F.when((F.col("site") % 12).isin(8, 9), F.col("target")).alias("second_target"))


def _chain(spark, sf_dir):
    """A first url for each supplier and the hops that it meets: p % 8 of them, in four forms of location."""
    p = F.col("s_suppkey")
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    keys = _t(spark, sf_dir, "supplier").select(p.alias("p"), text("https://r", p, ".test/0").alias("url"))
    steps = keys.select("p", F.explode(F.sequence(F.lit(0), (F.col("p") % 8).cast("int"))).alias("i"))
    n, i, p = F.col("p") % 8, F.col("i"), F.col("p")
    form = F.when(p % 3 == 0, text("https://r", p, ".test/", i + 1)).when(p % 3 == 1, text("/", i + 1)).otherwise(text(i + 1))
    last = (i == n - 1) & (n == 3)
    away = F.when(last & (p % 5 == 0), text("https://other", p, ".example/", i + 1)).when(last & (p % 5 == 1), F.lit("ftp://x/")).when(last & (p % 5 == 2), text("/de/", i + 1)).when(last & (p % 5 == 3), text("https://r", p, ".test/0")).otherwise(form)
    hops = steps.select(text("https://r", p, ".test/", i).alias("url"), F.lit(0).alias("attempt"), F.when(i < n, 301).when((i == n) & (n % 2 == 0), 429).otherwise(200).alias("status"), F.when(i < n, away).alias("location"))
    again = steps.where((i == n) & (n % 2 == 0)).select(text("https://r", p, ".test/", i).alias("url"), F.lit(1).alias("attempt"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("location"))
    ends = keys.where((n == 3) & (p % 5).isin(0, 2)).select(F.when(p % 5 == 0, text("https://other", p, ".example/3")).otherwise(text("https://r", p, ".test/de/3")).alias("url"), F.lit(0).alias("attempt"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("location"))
    return keys, hops.unionByName(again).unionByName(ends)


@query("""WITH q AS (SELECT s_suppkey AS p, s_suppkey % 8 AS n, s_suppkey % 5 AS f FROM supplier), c AS (SELECT *, n = 3 AS odd FROM q)
    SELECT p, CASE WHEN odd AND f = 0 THEN concat('https://other', p, '.example/3') WHEN odd AND f = 1 THEN concat('https://r', p, '.test/2') WHEN odd AND f = 2 THEN concat('https://r', p, '.test/de/3') WHEN odd AND f = 3 THEN concat('https://r', p, '.test/2')
        ELSE concat('https://r', p, '.test/', least(n, 5)) END AS final_url, CASE WHEN odd AND f IN (1, 3) THEN 301 WHEN n > 5 THEN 301 ELSE 200 END::INT AS status, CASE WHEN odd AND f = 3 THEN 5 ELSE least(n, 5) END::INT AS hops,
        odd AND f = 0 AS cross_domain, CASE WHEN odd AND f = 1 THEN 'unsupported_scheme' WHEN (odd AND f = 3) OR n > 5 THEN 'too_many_redirects' END AS error, CASE WHEN odd AND f = 2 THEN 'de' END AS edition, n % 2 = 0 AND n <= 5 AS retried FROM c""")
def redirect_chains(spark, sf_dir):
    """None to seven redirects, some to another domain, another scheme, a language edition or back to the start; a busy answer is asked again."""
    seeds, hops = _chain(spark, sf_dir)
    return fetched.redirect_chains(seeds, hops).select("p", "final_url", "status", "hops", "cross_domain", "error", "edition", "retried")


_INDEX, _LIST = "<sitemapindex><sitemap><loc>{}</loc></sitemap></sitemapindex>", "<urlset><url><loc>https://x.test/a</loc></url><url><loc> https://x.test/b </loc></url></urlset>"


@query(f"""WITH q AS (SELECT site, first_page AS p, first_page % 9 AS k, concat('https://', site, '/') AS o FROM {SITES})
    SELECT site, ['ok', 'ok', 'invalid', 'missing', 'challenge', 'unreachable', 'ok', 'ok', 'missing'][k + 1] AS state, CASE k WHEN 3 THEN NULL WHEN 5 THEN concat(o, 'sitemap_index.xml') WHEN 6 THEN concat(o, 'pages.xml') WHEN 7 THEN concat(o, 'sitemap_index.xml') ELSE concat(o, 'sitemap.xml') END AS url,
        CASE WHEN k IN (0, 1, 6) THEN 2 ELSE 0 END::INT AS urls, CASE WHEN k IN (1, 2) THEN concat(o, 'child.xml') END AS child_url, CASE k WHEN 0 THEN 1 WHEN 4 THEN 1 WHEN 6 THEN 1 ELSE 2 END::INT AS tried FROM q""")
def sitemap_search(spark, sf_dir):
    """Nine ways in which the search ends within two requests: a list, an index with a good and a bad child, nothing, a challenge, errors, a gzip file that robots rules name, an index found last, a forbidden one."""
    import gzip
    k, o = F.col("first_page") % 9, F.concat(F.lit("https://"), F.col("site"), F.lit("/"))
    at = lambda name: F.concat(o, F.lit(name))
    sites = _sites(spark, sf_dir)
    asked = sites.select("site", F.concat(F.lit("https://"), "site").alias("origin"), F.when(k == 6, F.array(at("news/products.xml"), at("pages.xml"))).alias("sitemaps"))
    body = lambda text: F.encode(text if not isinstance(text, str) else F.lit(text), "UTF-8")
    index = body(F.concat(F.lit(_INDEX.split("{}")[0]), at("child.xml"), F.lit(_INDEX.split("{}")[1])))
    row = lambda cond, name, status=200, error=None, challenge=False, skipped=None, content=None: F.when(cond, F.struct(
        at(name).alias("url"), F.lit(status).cast("int").alias("status"), F.lit(error).cast("string").alias("error"), F.lit(challenge).alias("challenge"), F.lit(skipped).cast("string").alias("skipped"), (F.lit(None) if content is None else content).cast("binary").alias("body")))
    rows = F.array(row(k == 0, "sitemap.xml", content=body(_LIST)), row(k.isin(1, 2), "sitemap.xml", content=index), row(k == 1, "child.xml", content=body(_LIST)), row(k == 2, "child.xml", content=body("<html>no</html>")),
                   row(k == 3, "sitemap.xml", 404), row(k == 3, "sitemap_index.xml", 404), row(k == 4, "sitemap.xml", challenge=True), row(k == 5, "sitemap.xml", content=body("<p>nothing")), row(k == 5, "sitemap_index.xml", 503),
                   row(k == 6, "pages.xml", content=F.lit(gzip.compress(_LIST.encode(), mtime=0))), row(k == 7, "sitemap.xml", 404), row(k == 7, "sitemap_index.xml", content=index), row(k == 8, "sitemap.xml", None, skipped="robots_disallow"), row(k == 8, "sitemap_index.xml", 404))
    answers = sites.select("site", "first_page", F.explode(F.array_compact(rows)).alias("r")).select("r.*")
    return fetched.discover_sitemaps(asked, answers).select("site", "state", "url", F.size("urls").alias("urls"), "child_url", F.size("tried").alias("tried"))
