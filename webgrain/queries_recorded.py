"""Queries over recorded answers that are made of `part`, `supplier` and `customer` by a rule on the key."""

from __future__ import annotations

from pyspark.sql import functions as F

from webgrain.operators import html, recorded
from webgrain.queries import _t, query

_TYPE = "CASE p % 4 WHEN 0 THEN 'text/html; charset=ISO-8859-1' WHEN 1 THEN 'text/html' WHEN 3 THEN 'text/html; Charset=Windows-1252' END"
_BODY = """CASE p % 3 WHEN 0 THEN '<meta charset="KOI8-R">' WHEN 1 THEN '<meta content="text/html; charset=utf-16">' ELSE '<p>charset=none' END"""


@query("""SELECT p_partkey AS p, CASE p_partkey % 4 WHEN 0 THEN 'iso-8859-1' WHEN 3 THEN 'windows-1252' ELSE ['koi8-r', 'utf-16', 'utf-8'][p_partkey % 3 + 1] END AS charset FROM part""")
def charset_sniff(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    return rows.select("p", recorded.charset_of(F.expr(_TYPE), F.encode(F.expr(_BODY), "UTF-8")).alias("charset"))


@query("""SELECT p_partkey AS p, decoded AS text FROM (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' é' WHEN 1 THEN ' €' ELSE ' ü' END AS decoded FROM part)""")
def charset_decode(spark, sf_dir):
    p = F.col("p_partkey")
    body = lambda tail: F.concat(F.encode("p_name", "UTF-8"), F.unhex(F.lit(tail)))
    rows = _t(spark, sf_dir, "part").select(p.alias("p"), F.when(p % 3 == 0, body("20E9")).when(p % 3 == 1, body("2080")).otherwise(body("20C3BC")).alias("body"),
                                            F.when(p % 3 == 0, "latin1").when(p % 3 == 1, "windows-1252").otherwise("utf-8").alias("charset"))
    return rows.select("p", recorded.text_in(F.col("body"), F.col("charset")).alias("text"))


@query(r"""WITH t AS (SELECT p_partkey AS p, trim(regexp_replace(concat(' ', p_name, ' & ', p_type, '  (', p_brand, ', 50%)*'), '\s+', ' ', 'g')) AS t FROM part)
    SELECT p, replace(replace(replace(replace(replace(url_encode(replace(upper(t[1]) || t[2:], ' ', '_')), '%28', '('), '%29', ')'), '%2C', ','), '%27', chr(39)), '%26', '&') AS name FROM t""")
def article_names(spark, sf_dir):
    text = F.concat(F.lit(" "), F.col("p_name"), F.lit(" & "), F.col("p_type"), F.lit("  ("), F.col("p_brand"), F.lit(", 50%)*"))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), recorded.article_name(text).alias("name"))


_ARTICLE = """concat(CASE WHEN c % 5 <> 0 THEN concat('<title>C<i>', c, '</i> - Wikipedia</title>') ELSE '<p class="noarticletext">' END, CASE WHEN c % 3 <> 0 THEN concat('"wgWikibaseItemId": "Q', c, '"') ELSE '' END,
    '<li>before</li>', CASE WHEN c % 4 = 0 THEN '<table id="dmbox-disambig">' ELSE '' END, '<div class="mw-parser-output">', repeat('<li>one</li>', CAST(c % 7 AS INT)), '<link>',
    CASE WHEN c % 8 = 0 THEN '' ELSE '<div id="catlinks"><li>after</li>' END, CASE WHEN c % 6 = 0 THEN concat('https://S', c, '.test/') ELSE '' END)"""


@query("""SELECT c_custkey AS c, CASE WHEN c_custkey % 5 <> 0 THEN concat('C', c_custkey) END AS title, CASE WHEN c_custkey % 3 <> 0 THEN concat('Q', c_custkey) END AS item, c_custkey % 4 = 0 AS disambiguation,
    CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 7 ELSE 0 END::INT AS entries, c_custkey % 6 = 0 AS mentions_domain, c_custkey % 5 = 0 AS no_article FROM customer""")
def article_kinds(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"))
    return rows.select("c", recorded.article_signals(F.expr(_ARTICLE), F.concat(F.lit("s"), F.col("c").cast("string"), F.lit(".test"))).alias("s")).select("c", "s.*")


_ENTITY = """concat('{"entities":{"Q', s, '":{"labels":{"en":{"value":"', CASE WHEN s % 2 = 0 THEN concat('Shop ', s) ELSE 'Other' END, '"}},"aliases":{"en":[{"value":"Alias ', s, '"}]},"claims":{"P856":',
    '[{"mainsnak":{"datavalue":{"value":{"x":1}}}},{"mainsnak":{"datavalue":{"value":"https://www.s', s, '.test/"}}}]}}}}')"""


@query("""SELECT s_suppkey AS s, CASE WHEN s_suppkey % 2 = 0 THEN concat('Shop ', s_suppkey) ELSE 'Other' END AS label, concat('Alias ', s_suppkey) AS aliases, concat('https://www.s', s_suppkey, '.test/') AS website,
    s_suppkey % 3 = 0 OR s_suppkey % 2 = 0 AS label_match, s_suppkey % 5 <> 0 AS website_match FROM supplier""")
def entity_answers(spark, sf_dir):
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"))
    item = F.expr("concat('Q', CASE WHEN s % 7 = 0 THEN 'x' ELSE CAST(s AS STRING) END)")
    brand, domain = F.expr("CASE WHEN s % 3 = 0 THEN concat('ALIAS-', s) ELSE concat('shop ', s) END"), F.expr("CASE WHEN s % 5 = 0 THEN 'else.test' ELSE concat('s', s, '.test') END")
    found = rows.select("s", recorded.entity_signals(F.expr(_ENTITY), item, brand, domain).alias("e"))
    return found.select("s", "e.label", F.array_join("e.aliases", ",").alias("aliases"), "e.website", "e.label_match", "e.website_match")


@query("""SELECT c_custkey::VARCHAR AS site FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_custkey % 2 = 1)""")
def lookups_due(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("site"), F.col("c_custkey").alias("c"))
    cached = rows.where("c % 3 = 0").select("site", F.when(F.col("c") % 2 == 0, "unavailable").otherwise("match").alias("outcome"))
    return recorded.lookups_due(rows.select("site"), cached)


@query("""WITH q AS (SELECT concat('s', s_nationkey, '.test') AS site, s_suppkey AS s, concat('https://s', s_nationkey, '.test/p/', s_suppkey) AS page, s_suppkey % 23 = 0 AS blog, s_suppkey % 5 AS k FROM supplier),
    f AS (SELECT *, CASE WHEN blog THEN 'role:blog' WHEN k = 0 OR k = 3 THEN 'link' WHEN k = 1 THEN 'feed' END AS kind FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY NOT blog, s) AS n FROM f WHERE kind IS NOT NULL)
    SELECT site, kind, CASE kind WHEN 'role:blog' THEN page WHEN 'feed' THEN concat('https://', site, '/feed.xml') ELSE concat(CASE WHEN k = 0 THEN 'Our newsroom' ELSE 'More' END, ' -> https://', site, CASE WHEN k = 0 THEN '/x' ELSE '/press/1' END) END AS value, page FROM r WHERE n = 1""")
def press_surfaces(spark, sf_dir):
    body = """CASE s_suppkey % 5 WHEN 0 THEN '<a href="/x">Our newsroom</a>' WHEN 1 THEN '<link rel="alternate" type="application/rss+xml" href="/feed.xml"><a href="/x">Plain</a>'
        WHEN 2 THEN '<a href="mailto:press@a.test">Press</a>' WHEN 3 THEN '<a href="/press/1">More</a>' ELSE '<a href="https://elsewhere.test/press">Press</a>' END"""
    pages = _t(spark, sf_dir, "supplier").select(F.expr("concat('https://s', s_nationkey, '.test/p/', s_suppkey)").alias("url"), F.when(F.col("s_suppkey") % 23 == 0, "blog").otherwise("product").alias("role"),
                                                 F.col("s_suppkey").alias("page_ord"), F.expr(f"concat('<html><body>', {body}, '</body></html>')").alias("html"))
    return recorded.press_surface(html.parse_pages(pages))


@query("""WITH q AS (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS b, CASE WHEN s_suppkey % 3 <> 0 THEN concat('s', s_suppkey, '.test') END AS d, CASE WHEN s_suppkey % 2 = 0 THEN 'Paris' END AS c FROM supplier),
    n AS (SELECT *, concat(chr(34), coalesce(b, d, ''), chr(34)) AS q FROM q)
    SELECT s, array_to_string(list_filter([q, q || ' ' || c, trim(q || ' ' || coalesce(d, '')), q || ' reviews', q || ' site:linkedin.com'], lambda x: x IS NOT NULL AND x <> chr(34) || chr(34))[1:5], '|') AS searches FROM n""")
def mention_searches(spark, sf_dir):
    s = F.col("s_suppkey")
    asked = recorded.mention_searches(F.when(s % 7 != 0, F.col("s_name")), F.when(s % 3 != 0, F.concat(F.lit("s"), s.cast("string"), F.lit(".test"))), F.when(s % 2 == 0, "Paris"))
    return _t(spark, sf_dir, "supplier").select(s.alias("s"), F.array_join(asked, "|").alias("searches"))


@query("""SELECT concat('s', s_suppkey, '.test') AS site, concat('Nothing was evaluated: timeout ', s_suppkey) AS headline, concat('The audit did not finish: timeout ', s_suppkey) AS limitation, 1 AS total, 1 AS info FROM supplier""")
def failed_reports(spark, sf_dir):
    s = F.col("s_suppkey").cast("string")
    runs = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), s, F.lit(".test")).alias("site"), F.concat(F.lit("timeout "), s).alias("error"))
    return recorded.failed_report(runs).select("site", "report.headline", F.element_at("report.limitations", 1).alias("limitation"), "report.summary.total", "report.summary.info")
