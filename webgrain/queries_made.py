"""Queries over pages and answers that are made of the tables by a rule on their keys, so that SQL can state from the same keys what must come out.

The pages of the test tables have no structured data, metadata, forms or images, so what reads those is tried on a page for each row
of `part` or `supplier`: the rule says which defects it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.functions import text as T
from webgrain.functions import vocab as V
from webgrain.functions.dims import dim
from webgrain.functions.url import host
from webgrain.operators import checks, facts, gates, grade, html, report, sampling
from webgrain.operators.evidence import EVIDENCE
from webgrain.queries import _LETTERS, _RESULTS, _STAGE_RESULTS, SITES, _dealt, _results, _sites, _stage_results, _t, _values, query
from webgrain.sources.store import written

_WORDS = "plain words stand here and say nothing that a rule would look for " * 6


def _when(cond: str, text: str, other: str = "") -> str:
    return f"CASE WHEN {cond} THEN '{text}' ELSE '{other}' END"


#: The page of a part with key p.
_PAGE = "concat('<!DOCTYPE html><html lang=\"en\"><head><title>', " + ", ".join([
    "CASE WHEN p % 7 = 0 THEN 'Home' ELSE concat('Part ', p, ' in detail') END", "'</title>'", _when("p % 2 = 0", '<meta name="description" content="About it">'),
    _when("p % 3 = 0", '<meta property="og:title" content="Part">'), _when("p % 5 <> 0", '<meta name="viewport" content="width=device-width">'),
    _when("p % 11 = 0", '<meta name="robots" content="noindex, follow">'),
    "CASE p % 10 WHEN 0 THEN '' WHEN 1 THEN '<link rel=\"canonical\" href=\"https://other.example/x\">' WHEN 2 THEN concat('<link rel=\"canonical\" href=\"https://shop', p % 50, '.test/another\">') "
    "ELSE concat('<link rel=\"canonical\" href=\"https://shop', p % 50, '.test/p/', p, '\">') END",
    "CASE p % 6 WHEN 0 THEN '' WHEN 1 THEN '<script type=\"application/ld+json\">{\"@type\": </script>' WHEN 2 THEN '<script type=\"application/ld+json\">{\"@type\": \"Product\", \"name\": \"a\", \"offers\": {\"price\": 1}}</script>' "
    "WHEN 3 THEN '<script type=\"application/ld+json\">{\"@type\": \"Product\", \"name\": \"a\"}</script>' WHEN 4 THEN '<script type=\"application/ld+json\">{\"@type\": \"Organization\", \"name\": \"a\", \"url\": \"https://a.test\"}</script>' "
    "ELSE '<script type=\"application/ld+json\">{\"@type\": \"Organization\", \"url\": \"https://a.test\"}</script>' END",
    "repeat('<script>1</script>', CASE WHEN p % 40 = 7 THEN 41 ELSE 2 END)", "'</head><body>'", "repeat(concat('<h1>Part ', p, '</h1>'), CAST(p % 4 AS INT))",
    "repeat('<img src=\"/a.png\">', CAST(p % 8 AS INT))", "repeat('<img src=\"/b.png\" alt=\"picture of it\">', 4)",
    _when("p % 9 = 4 AND p % 13 <> 0 AND p % 17 <> 0", '<div class="modal" style="position: fixed">' + "join our letter now " * 15 + "</div>"),
    _when("p % 13 = 0", "<noscript>Please enable JavaScript</noscript>"), _when("p % 17 = 0 AND p % 13 <> 0", '<div id="root"></div>'),
    _when("p % 13 = 0 OR p % 17 = 0", "", _WORDS)]) + ", '</body></html>')"

#: check id -> which parts' pages fail it. u: the page is usable, that is neither asks for scripts nor is an empty frame.
_FAILS = {
    "cr.render.js_gate": "p % 13 = 0", "cr.render.csr_shell": "p % 13 <> 0 AND p % 17 = 0", "cr.index.noindex_on_key_page": "p % 11 = 0", "cr.index.canonical_offsite": "p % 10 = 1",
    "cr.index.canonical_mismatch": "p % 10 = 2", "fx.jsonld.malformed": "u AND p % 6 = 1", "fx.jsonld.required_props_missing": "u AND p % 6 IN (3, 5)",
    "fx.identity.title_missing_or_generic": "u AND p % 7 = 0", "fx.identity.h1_missing_or_multiple": "u AND p % 4 <> 1", "fx.identity.meta_description_missing": "u AND p % 2 = 1",
    "fx.identity.og_missing": "u AND p % 3 <> 0", "fx.media.alt_text_missing": "u AND p % 8 >= 2 AND p % 8 > 0.3 * (p % 8 + 4)", "en.mobile.viewport_missing": "p % 5 = 0",
    "en.perf.page_weight_heavy": "p % 40 = 7",
    "en.interstitial.blocking": "u AND p % 9 = 4 AND p % 4 = 0",
}
_USABLE = "(p % 13 <> 0 AND p % 17 <> 0) AS u"


def _made(spark: SparkSession, sf_dir: str, parts: tuple[str, ...] = (), signs: tuple[str, ...] = (), step: str | None = None) -> DataFrame:
    """A page for each part with its state; parts of the document and signs beside it as a query asks for them. step: the parsed pages are a written table of that name."""
    rows = _dealt(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("p")))  # keys are moved, not pages
    pages = rows.select("p", F.expr("concat('https://shop', p % 50, '.test/p/', p)").alias("url"), F.lit("product").alias("role"), F.expr(_PAGE).alias("html"))
    docs = html.parse_pages(pages, parts=(*checks.STATE_PARTS, *parts))
    sites = pages.select(host(F.col("url")).alias("site")).distinct()  # by the address: no page is parsed for it
    return checks.prepare(written(docs, step) if step else docs, F.broadcast(sites.withColumn("category", F.lit("ecommerce"))), signs)  # fifty sites


@query("WITH q AS (SELECT p_partkey AS p, " + _USABLE.replace("(p ", "(p_partkey ").replace("AND p ", "AND p_partkey ") + " FROM part) " + " UNION ALL ".join(
    f"SELECT p, '{check}' AS check_id FROM q WHERE {cond}" for check, cond in _FAILS.items()))
def made_page_checks(spark, sf_dir):
    """Every page check whose defect a made page can have, over a page for each part."""
    flags = checks.page_flags(F.lit("2024-06-01").cast("date"))
    failed = F.array(*[F.when(F.coalesce(flags[k][0] & flags[k][1], F.lit(False)), F.lit(k)) for k in _FAILS])
    parts = ("title", "canonical", "meta", "html_bytes", "script_tags", "images", "overlays", "jsonld", "nodes", "body_mpos", "content_mpos")
    return _made(spark, sf_dir, parts, ("lacking",)).select("p", F.explode(failed).alias("check_id")).where("check_id is not null")


@query("""WITH q AS (SELECT p_partkey AS p FROM part), s AS (SELECT concat('shop', p % 50, '.test') AS site, p % 13 <> 0 AND p % 17 <> 0 AS u, p FROM q)
    SELECT site, 'fx.jsonld.missing' AS check_id, CASE WHEN NOT bool_or(u) THEN 'not_evaluated' WHEN bool_or(u AND p % 6 <> 0) THEN 'pass' ELSE 'fail' END AS status FROM s GROUP BY site
    UNION ALL SELECT site, 'ef.entity.sameas_missing', CASE WHEN bool_or(u AND p % 6 IN (4, 5)) THEN 'fail' ELSE 'not_evaluated' END FROM s GROUP BY site
    UNION ALL SELECT site, 'ef.freshness.no_visible_dates', CASE WHEN bool_or(u) THEN 'fail' ELSE 'not_evaluated' END FROM s GROUP BY site
    UNION ALL SELECT site, 'en.nav.breadcrumbs_missing', CASE WHEN bool_or(u) THEN 'fail' ELSE 'not_evaluated' END FROM s GROUP BY site
    UNION ALL SELECT site, 'fx.content.faq_absent', CASE WHEN bool_or(u) THEN 'fail' ELSE 'not_evaluated' END FROM s GROUP BY site
    UNION ALL SELECT site, 'en.lang.attribute_missing', 'not_evaluated' FROM s GROUP BY site
    UNION ALL SELECT site, 'cr.access.challenge_page', 'pass' FROM s GROUP BY site""")
def made_site_checks(spark, sf_dir):
    """Site checks over the same pages, by the one aggregation of grade_pages."""
    wanted = ("fx.jsonld.missing", "ef.entity.sameas_missing", "ef.freshness.no_visible_dates", "en.nav.breadcrumbs_missing", "fx.content.faq_absent", "en.lang.attribute_missing", "cr.access.challenge_page")
    made = _made(spark, sf_dir, ("jsonld", "nodes", "times", "breadcrumb"), step="made")
    return checks.grade_pages(made, F.lit("2024-06-01").cast("date"), wanted).select("site", "check_id", "status")


@query("SELECT p_partkey AS p, CASE WHEN p_partkey % 13 = 0 THEN 'gate' WHEN p_partkey % 17 = 0 THEN 'shell' ELSE 'ok' END AS render_state FROM part")
def made_render_states(spark, sf_dir):
    return _made(spark, sf_dir).select("p", "render_state")


_NOTICE = "concat(CASE p % 3 WHEN 0 THEN '© ' WHEN 1 THEN 'Copyright (c) Acme Ltd ' ELSE '(C) by us, ' END, 1990 + p % 30, CASE p % 4 WHEN 0 THEN '' WHEN 1 THEN '-current' WHEN 2 THEN concat(' – ', 2000 + p % 20) ELSE ' to be' END)"


@query("SELECT p_partkey AS p, CASE p_partkey % 4 WHEN 1 THEN 2024 WHEN 2 THEN 2000 + p_partkey % 20 ELSE 1990 + p_partkey % 30 END::INT AS year FROM part")
def made_copyright_years(spark, sf_dir):
    """Notices with a name before the year, ranges and open ranges."""
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("p")).withColumn("text", F.expr(_NOTICE))
    return rows.select("p", F.explode(T.copyright_years(F.col("text"), F.lit("2024-06-01").cast("date"))).alias("year"))


_TALK = """CASE c % 5 WHEN 0 THEN concat('Call 020 7946 ', 1000 + c % 9000, ' today or +44 20 1234 5678') WHEN 1 THEN concat('Order 123 456 7890, then tel: 030 ', 1000000 + c)
    WHEN 2 THEN concat('You may phone us at any time on 020 7946 ', 1000 + c % 9000) WHEN 3 THEN concat('+44 20 1234 ', 1000 + c % 9000) ELSE concat('Part no. 020 7946 ', 1000 + c % 9000) END"""


@query("""SELECT c_custkey AS c, CASE c_custkey % 5 WHEN 1 THEN concat('030 ', 1000000 + c_custkey) WHEN 3 THEN concat('+44 20 1234 ', 1000 + c_custkey % 9000) WHEN 2 THEN NULL WHEN 4 THEN NULL
    ELSE concat('020 7946 ', 1000 + c_custkey % 9000) END AS phone FROM customer""")
def made_phones(spark, sf_dir):
    """The first number that qualifies by a plus or by a cue right before it; a cue further off does not do."""
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c")).select("c", facts.text_phone(F.expr(_TALK)).alias("phone"))


#: Addresses of which the first that looks like one is guarded away: {n} is the key.
_PLACES = ["4 x AB1 2CD, 2 x Foo House LS1 {n}AP.", "Room, 45000 Requests in 2020 and so much more than that was said here by many of us. Anschrift: Beispielweg, 10115 Berlin",
           "Seen by, 99999 Visitors so far and by more than that in other years of this house. Come to, 75011 Paris, France for {n} years", "Code EC1A 1BB", "Room, 45000 Requests handled", "12 Harbour Street, Leeds and 14 Other Road, York"]


@query("""WITH q AS (SELECT c_custkey AS c, c_custkey % 6 AS k, c_custkey % 9 + 1 AS n FROM customer)
    SELECT c, CASE k WHEN 0 THEN 'uk_postcode' WHEN 1 THEN 'eu_postcode_city' WHEN 2 THEN 'eu_postcode_city' WHEN 3 THEN 'uk_postcode' WHEN 5 THEN 'street' END AS label,
        CASE k WHEN 0 THEN concat('LS1 ', n, 'AP') WHEN 1 THEN ', 10115 Berlin' WHEN 2 THEN ', 75011 Paris' WHEN 3 THEN 'EC1A 1BB' WHEN 5 THEN '12 Harbour Street' END AS m FROM q""")
def made_addresses(spark, sf_dir):
    """Every match of a grammar is tried until its guard lets one pass: words before a postcode, a cue or a country beside a town."""
    c = F.col("c_custkey")
    text = F.replace(F.element_at(F.array(*map(F.lit, _PLACES)), (c % len(_PLACES) + 1).cast("int")), F.lit("{n}"), (c % 9 + 1).cast("string"))
    return _t(spark, sf_dir, "customer").select(c.alias("c"), facts.address_span(text).alias("s")).select("c", "s.label", "s.m")


@query(f"""SELECT s.site, c.check_id, CASE WHEN c.check_id IN ('cr.access.challenge_page', 'or.run.probe_error') THEN 'pass' ELSE 'not_evaluated' END AS status,
        CASE WHEN c.check_id NOT IN ('cr.access.challenge_page', 'or.run.probe_error') THEN 'not_recorded' END AS reason
    FROM {SITES} s, {_values([(r[0],) for r in V.CHECKS], 'check_id').replace('AS v', 'AS c')}
    WHERE regexp_matches(c.check_id, '^(cr\\.robots|cr\\.index\\.sitemap|cr\\.access\\.(edge|ua)_|cr\\.access\\.challenge|en\\.links|en\\.errors|ef\\.entity\\.wikidata|or\\.run)')""")
def audit_status(spark, sf_dir):
    """Pages without any recorded answers: what only those could tell is not evaluated, what the pages tell is."""
    pages = _t(spark, sf_dir, "pages")
    docs = html.parse_pages(pages, parts=(*checks.STATE_PARTS, "parse_error")).withColumns({"role": F.lit("home"), "page_ord": F.lit(0)})
    sites = pages.select(host(F.col("url")).alias("site")).distinct().withColumn("category", F.lit("unknown"))
    results = checks.grade_pages(checks.prepare(docs, sites, ()), F.lit("2024-06-01").cast("date"), tuple(checks.OPEN_PAGES))
    results = written(results, "open")  # two rows a site, read twice
    every = grade.fill_unreported(grade.never_run(results, sites), sites)
    own = [k for begins in grade.RECORDED_CHECKS.values() for k in begins] + ["cr.access.challenge_page", "or.run"]
    return every.where(F.greatest(*[F.col("check_id").startswith(k) for k in own])).select("site", "check_id", "status", "reason")


# ---- folding --------------------------------------------------------------------------------

_HOME = "home"


def _seen(value=None, kind="computed", page="u1", location=None, note=None):
    return (page, kind, value or "x=1", location, note)


def _case(primary, victim, pages=("u1", "u2"), own=("u1",), main=(), said=(), read=("home", "u1", "u2", "u3"), category="ecommerce", others=()):
    """The findings of a made site: primary and victim with their pages and evidence, and others that are neither."""
    return [(c, list(pg), list(ev), list(read), category) for c, pg, ev in ((primary, pages, main), (victim, own, said), *others)]


_BLOCK = "script[type=application/ld+json][1]"
_NAP, _FACT = "ef.entity.nap_missing_plain_text", "fx.facts.key_fact_missing"
#: row, primary, victim, and a site where the two fold beside one where they do not (None: they always do; the same in both places: never).
_FOLD_CASES = [
    (1, "cr.access.challenge_page", "fx.identity.og_missing", {}, {"own": ("u3",)}),
    (1, "cr.access.challenge_page", "ef.freshness.no_visible_dates", None, {"own": ()}),  # a finding of the site as a whole stays
    (2, "cr.robots.blanket_disallow", "cr.robots.index_bot_blocked", {"own": ()}, None),
    (3, "cr.access.non_html_seed", "en.mobile.viewport_missing", {"own": ("home",)}, {"own": ("home", "u1")}),
    (4, "cr.render.csr_shell", "en.hero.value_prop_unclear", {}, {"own": ("u1", "u3")}),
    (4, "cr.render.js_gate", "en.mobile.viewport_missing", None, {}),
    (5, "cr.render.js_gate", _FACT, {"pages": ("home", "u1"), "own": (), "read": ("home", "u1")}, {"pages": ("home", "u1"), "own": (), "read": ("home", "u1", "u4")}),
    (5, "cr.render.js_gate", _FACT, {"pages": ("home",), "own": (), "read": ("home", "u1"), "others": [("cr.render.csr_shell", ("u1",), ())]}, {"pages": ("u1",), "own": (), "read": ("home", "u1"), "others": [("cr.render.csr_shell", ("u4",), ())]}),
    (6, "fx.jsonld.missing", "fx.jsonld.no_organization", {"own": ()}, None),
    (6, "fx.jsonld.missing", "ef.entity.name_inconsistent", {"own": (), "said": [_seen("Acme", note="jsonld:Organization.name")]}, {"own": (), "said": [_seen("Acme", note="meta:og:site_name")]}),
    (7, "fx.jsonld.malformed", "fx.jsonld.required_props_missing", {"main": [_seen(location=_BLOCK)], "said": [_seen(location=_BLOCK)]}, {"main": [_seen(location=_BLOCK)], "said": [_seen(location=_BLOCK.replace("1", "2"))]}),
    (8, _NAP, _FACT, {"own": (), "category": "local_business", "said": [_seen("key_facts=6; missing=address,phone")]}, {"own": (), "category": "local_business", "said": [_seen("key_facts=6; missing=address,opening_hours")]}),
    (8, _NAP, _FACT, {"own": (), "category": "local_business", "said": [_seen("missing=phone; pages=2")]}, {"own": (), "said": [_seen("missing=phone; pages=2")]}),
    (9, "en.links.blocked_cluster", "en.links.broken_sampled", {"own": (), "said": [_seen("GET /a -> 403", "http_status"), _seen("GET /b -> 429", "http_status")]}, {"own": (), "said": [_seen("GET /a -> 403", "http_status"), _seen("GET /b -> 404", "http_status")]}),
    (10, "fx.identity.h1_missing_or_multiple", "en.continuity.h1_title_mismatch", {"main": [_seen("h1_count=0")]}, {"main": [_seen("h1_count=2")]}),
    (10, "fx.identity.h1_missing_or_multiple", "en.hero.value_prop_unclear", {"main": [_seen("h1_count=0")], "said": [_seen("signals=h1_missing")]}, {"main": [_seen("h1_count=0")], "said": [_seen("signals=lead_text_no_offer")]}),
    (11, "cr.index.sitemap_missing", "cr.index.sitemap_invalid", {"own": ()}, None),
    (12, "ef.entity.wikidata_unavailable", "ef.entity.wikidata_not_found", {"own": ()}, None),
]


def _fold_sites(spark, sf_dir):
    """A site for each part: a case of a row of the folding table, met in one half of them."""
    made = [(i, yes, *f) for i, (_, primary, victim, met, not_met) in enumerate(_FOLD_CASES) for yes, spec in ((True, met), (False, not_met)) for f in _case(primary, victim, **(spec if spec is not None else met or not_met))]
    cases = spark.createDataFrame(made, f"k int, yes boolean, check_id string, pages array<string>, evidence {EVIDENCE}, html_urls array<string>, category string")
    n, p = len(_FOLD_CASES), F.col("p_partkey")
    rows = _t(spark, sf_dir, "part").select(p.cast("string").alias("site"), (p % n).cast("int").alias("k"), (F.floor(p / n) % 2 == 0).alias("yes"), p)
    return rows.join(F.broadcast(cases), ["k", "yes"]).withColumns({"home_url": F.lit(_HOME), "severity": F.lit("medium"), "max_severity": F.lit("high")})


@query(f"""SELECT p_partkey::VARCHAR AS site, f.victim AS check_id, f.primary_id AS folded_into, f.fold_row::INT AS fold_row FROM part JOIN (VALUES (0, 1, 'cr.access.challenge_page', 'fx.identity.og_missing', 1),
        (2, 2, 'cr.robots.blanket_disallow', 'cr.robots.index_bot_blocked', 2), (3, 3, 'cr.access.non_html_seed', 'en.mobile.viewport_missing', 1), (4, 4, 'cr.render.csr_shell', 'en.hero.value_prop_unclear', 1),
        (6, 5, 'cr.render.js_gate', '{_FACT}', 1), (7, 5, 'cr.render.js_gate', '{_FACT}', 1), (8, 6, 'fx.jsonld.missing', 'fx.jsonld.no_organization', 2), (9, 6, 'fx.jsonld.missing', 'ef.entity.name_inconsistent', 1),
        (10, 7, 'fx.jsonld.malformed', 'fx.jsonld.required_props_missing', 1), (11, 8, '{_NAP}', '{_FACT}', 1), (12, 8, '{_NAP}', '{_FACT}', 1), (13, 9, 'en.links.blocked_cluster', 'en.links.broken_sampled', 1),
        (14, 10, 'fx.identity.h1_missing_or_multiple', 'en.continuity.h1_title_mismatch', 1), (15, 10, 'fx.identity.h1_missing_or_multiple', 'en.hero.value_prop_unclear', 1), (16, 11, 'cr.index.sitemap_missing', 'cr.index.sitemap_invalid', 2),
        (17, 12, 'ef.entity.wikidata_unavailable', 'ef.entity.wikidata_not_found', 2)) AS f(k, fold_row, primary_id, victim, halves) ON f.k = p_partkey % 18 WHERE f.halves = 2 OR (p_partkey // 18) % 2 = 0""")
def made_folds(spark, sf_dir):
    """Each row of the folding table both ways, by pages, places, statuses, notes, facts, category and the pages that were read."""
    return grade.fold(_fold_sites(spark, sf_dir))[1].select("site", "check_id", "folded_into", "fold_row")


@query("""WITH q AS (SELECT p_partkey AS p, ['critical', 'high', 'medium', 'low'][p_partkey % 4 + 1] AS victim, ['high', 'medium', 'low', 'info'][(p_partkey // 4) % 4 + 1] AS own, ['critical', 'high', 'medium', 'info'][(p_partkey // 16) % 4 + 1] AS top,
        p_partkey % 5 <> 0 AS failed FROM part), r AS (SELECT *, ['critical', 'high', 'medium', 'low', 'info'] AS s FROM q), n AS (SELECT *, list_position(s, victim) AS v, list_position(s, own) AS o, list_position(s, top) AS t FROM r)
    SELECT p AS site, CASE WHEN failed AND greatest(t, v) < o THEN s[greatest(t, v)] ELSE own END AS severity, CASE WHEN failed AND greatest(t, v) < o THEN 'folded=fx.identity.og_missing; note=root cause: content is not present in the server response|severity_inherited_from=fx.identity.og_missing'
        ELSE 'folded=fx.identity.og_missing; note=root cause: content is not present in the server response' END AS notes FROM n""")
def made_inheritance(spark, sf_dir):
    """What a primary takes over from its victim: its severity, up to its own largest and only where it has failed, and notes in its evidence."""
    p = F.col("p_partkey")
    turn = lambda by, *values: F.element_at(F.array(*map(F.lit, values)), (F.floor(p / by) % len(values) + 1).cast("int"))
    parts = _t(spark, sf_dir, "part")
    page = F.array(F.lit("u1"))
    main = parts.select(p.alias("site"), F.lit("cr.render.js_gate").alias("check_id"), page.alias("pages"), turn(4, "high", "medium", "low", "info").alias("severity"), turn(16, "critical", "high", "medium", "info").alias("max_severity"), F.when(p % 5 != 0, "fail").otherwise("inconclusive").alias("status"))
    rest = parts.select(p.alias("site"), F.lit("fx.identity.og_missing").alias("check_id"), page.alias("pages"), turn(1, "critical", "high", "medium", "low").alias("severity"), F.lit("critical").alias("max_severity"), F.lit("fail").alias("status"))
    return grade.fold(main.unionByName(rest))[0].select("site", "severity", F.array_join(F.transform("evidence", lambda e: e["value"]), "|").alias("notes"))


# ---- gates ----------------------------------------------------------------------------------

_LANG = "['en', 'de', NULL, 'xx', 'fr'][first_page % 5 + 1]"


@query(f"""WITH {_RESULTS}, f AS (SELECT r.*, s.first_page FROM res r JOIN {SITES} s USING (site) WHERE status IS NOT NULL), b AS (SELECT *, status = 'fail' AND coalesce(({_LANG} <> 'en' AND check_id IN ('fx.facts.key_fact_missing', 'fx.content.faq_absent',
        'ef.corroboration.press_page_missing', 'en.hero.value_prop_unclear', 'en.trust.signals_missing', 'en.nav.related_links_missing')) OR ({_LANG} = 'xx' AND check_id = 'en.cta.missing'), FALSE) AS blind FROM f)
    SELECT site, check_id, CASE WHEN blind THEN 'not_evaluated' ELSE status END AS status, CASE WHEN blind THEN 'language_not_supported' END AS reason FROM b""")
def language_gate(spark, sf_dir):
    """Calls to act are read in German and French too, everything else in English alone."""
    langs = F.array(F.lit("en"), F.lit("de"), F.lit(None).cast("string"), F.lit("xx"), F.lit("fr"))
    sites = _sites(spark, sf_dir).select("site", F.element_at(langs, (F.col("first_page") % 5 + 1).cast("int")).alias("lang"))
    return gates.language_gate(_results(spark, sf_dir).withColumn("reason", F.lit(None).cast("string")), sites).select("site", "check_id", "status", "reason")


@query("""WITH q AS (SELECT s_suppkey // 4 AS site, s_suppkey AS o, CASE s_suppkey % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'de' END AS declared, CASE WHEN (s_suppkey // 4) % 3 <> 0 THEN CASE s_suppkey % 7 WHEN 0 THEN 'fr' WHEN 1 THEN 'en' WHEN 2 THEN 'fr' END END AS detected FROM supplier),
    v AS (SELECT site, 0 AS k, detected AS lang, o FROM q WHERE detected IS NOT NULL UNION ALL SELECT site, 1, declared, o FROM q WHERE declared IS NOT NULL),
    n AS (SELECT site, k, lang, count(*) AS n, min(o) AS o FROM v GROUP BY ALL) SELECT site, first(lang ORDER BY k, n DESC, o) AS lang FROM n GROUP BY 1""")
def sample_languages(spark, sf_dir):
    """Pages of four to a site: what most pages' words say wins over what most declare, of equals the first."""
    k = F.col("s_suppkey")
    some = lambda by, *values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (k % by + 1).cast("int"))
    site = F.floor(k / 4)
    rows = _t(spark, sf_dir, "supplier").select(site.alias("site"), k.alias("page_ord"), some(5, "en", "de", "de", None, None).alias("declared"), F.when(site % 3 != 0, some(7, "fr", "en", "fr", None, None, None, None)).alias("detected"))
    return gates.sample_language(rows)


@query(f"""WITH {_RESULTS}, f AS (SELECT r.*, s.first_page AS p FROM res r JOIN {SITES} s USING (site) WHERE status IS NOT NULL), b AS (SELECT *, status = 'fail' AND p % 2 = 0 AND p % 3 <> 1 AND p % 5 <> 2 AND check_id IN ('en.nav.landmark_missing', 'en.nav.site_search_missing',
        'en.nav.breadcrumbs_missing', 'en.nav.related_links_missing', 'en.cta.missing', 'en.trust.signals_missing', 'en.errors.unhelpful_404', 'ef.freshness.no_visible_dates') AS blind FROM f)
    SELECT site, check_id, CASE WHEN blind THEN 'not_evaluated' ELSE status END AS status, CASE WHEN blind THEN 'chrome_rendered_by_javascript' END AS reason FROM b""")
def chrome_gate(spark, sf_dir):
    """An empty header alone does not do: no nav may be served, and a script must be there to fill it."""
    p = F.col("first_page")
    homes = _sites(spark, sf_dir).select("site", F.when(p % 2 == 0, 1).otherwise(0).alias("empty_chrome"), F.when(p % 3 == 1, 1).otherwise(0).alias("nav_count"), F.when(p % 5 == 2, 0).otherwise(3).alias("external_scripts"))
    return gates.chrome_gate(_results(spark, sf_dir).withColumn("reason", F.lit(None).cast("string")), homes).select("site", "check_id", "status", "reason")


@query(f"""WITH q AS (SELECT site, first_page AS p, first_page % 4 = 0 AS no_blog, CASE WHEN first_page % 3 = 0 THEN 4 ELSE 2 END AS gone, CASE WHEN first_page % 7 <> 0 THEN first_page % 5 + 1 END AS links FROM {SITES})
    SELECT site, CASE WHEN no_blog AND (coalesce(links <= 3, FALSE) OR gone >= 4) THEN 'not_evaluated' ELSE 'fail' END AS status, CASE WHEN no_blog AND (coalesce(links <= 3, FALSE) OR gone >= 4) THEN 'navigation_not_readable' END AS reason FROM q""")
def press_gate(spark, sf_dir):
    """Few links or many unread roles withdraw the finding only where no blog page was read."""
    p, sites = F.col("first_page"), _sites(spark, sf_dir)
    listed = lambda *roles: F.array(*map(F.lit, roles))
    last = F.when(p % 4 == 0, "blog").otherwise("product")
    roles = F.when(p % 3 == 0, F.concat(listed("about", "contact", "pricing"), F.array(last))).otherwise(F.concat(listed("about"), F.array(last)))
    seen = sites.select("site", F.when(p % 7 != 0, p % 5 + 1).alias("links"), roles.alias("missing_roles"))
    rows = sites.select("site", F.lit("ef.corroboration.press_page_missing").alias("check_id"), F.lit("fail").alias("status"), F.lit(None).cast("string").alias("reason"))
    return gates.press_gate(rows, seen).select("site", "status", "reason")


@query(f"""WITH g AS (SELECT s.site, s.first_page, k.fact_id FROM {SITES} s, {_values([(f,) for f in V.KEY_FACTS['ecommerce']], 'fact_id').replace('AS v', 'AS k')} WHERE (s.first_page + length(k.fact_id)) % 3 <> 0),
    o AS (SELECT g.*, EXISTS (SELECT 1 FROM {_values([(f, r) for f, rs in V.FACT_ROLES.items() for r in rs], 'fact_id, role')} WHERE v.fact_id = g.fact_id AND (g.first_page + length(v.role)) % 4 = 0) AS unread FROM g)
    SELECT site, count(*) FILTER (NOT unread) AS confirmed, count(*) FILTER (unread) AS unchecked,
        CASE WHEN count(*) FILTER (NOT unread) >= 2 THEN 'high' WHEN count(*) FILTER (NOT unread) = 1 THEN 'medium' END AS severity FROM o GROUP BY 1""")
def fact_gate(spark, sf_dir):
    sites = _sites(spark, sf_dir)
    asked = sites.join(F.broadcast(dim(spark, "key_fact").where("category = 'ecommerce'").select("fact_id")))
    known = asked.select("site", "fact_id", F.lit(True).alias("required"), F.when((F.col("first_page") + F.char_length("fact_id")) % 3 == 0, "present").otherwise("absent").alias("status"))
    roles = F.broadcast(dim(spark, "fact_role").select("role").distinct())
    unread = sites.join(roles).where((F.col("first_page") + F.char_length("role")) % 4 == 0).select("site", "role")
    return gates.fact_gate(known, unread).select("site", F.size("confirmed").cast("bigint").alias("confirmed"), F.size("unchecked").cast("bigint").alias("unchecked"), "severity")


_FACT_SITES = f"(SELECT site, first_page, {[*V.CATEGORIES]}[first_page % {len(V.CATEGORIES)} + 1] AS category FROM {SITES})"


@query(f"""WITH s AS {_FACT_SITES},
    w AS (SELECT s.*, k.fact_id FROM s JOIN {_values([(c, f) for c, fs in V.KEY_FACTS.items() for f in fs], 'category, fact_id').replace('AS v', 'AS k')} ON k.category = s.category
        UNION ALL SELECT s.*, f FROM s, (VALUES ('audience'), ('differentiator')) AS o(f)),
    m AS (SELECT w.site, w.fact_id, min_by(d.detector, d.n) AS detector FROM w JOIN {_values([(f, i, d) for f, ds in facts.FACT_DETECTORS.items() for i, d in enumerate(ds)], 'fact_id, n, detector').replace('AS v', 'AS d')}
        ON d.fact_id = w.fact_id WHERE (w.first_page + length(d.detector)) % 2 = 0 GROUP BY ALL)
    SELECT w.site, w.fact_id, CASE WHEN m.detector IS NULL THEN 'absent' WHEN w.fact_id = 'pricing_or_trial' AND m.detector = 'free_trial' THEN 'partial' ELSE 'present' END AS status,
        CASE WHEN m.detector IS NOT NULL THEN concat(m.detector, ' of ', w.site) END AS value FROM w LEFT JOIN m ON m.site = w.site AND m.fact_id = w.fact_id""")
def resolve_facts(spark, sf_dir):
    """All facts of all categories from a made table of what was detected."""
    kinds = F.array(*map(F.lit, V.CATEGORIES))
    sites = _sites(spark, sf_dir).withColumn("category", F.element_at(kinds, (F.col("first_page") % len(V.CATEGORIES) + 1).cast("int")))
    detectors = spark.createDataFrame(sorted({(d,) for ds in facts.FACT_DETECTORS.values() for d in ds}), "detector string")
    detected = sites.join(F.broadcast(detectors)).where((F.col("first_page") + F.char_length("detector")) % 2 == 0).select(
        "site", "detector", F.concat("detector", F.lit(" of "), "site").alias("value"), F.lit("u").alias("page"), F.lit("text").alias("source"))
    return facts.resolve(detected, sites.select("site", "category")).select("site", "fact_id", "status", "value")


# ---- words of a report ----------------------------------------------------------------------


def _times(n: str, one: str) -> str:
    return f"concat({n}, ' {one}', CASE WHEN {n} = 1 THEN '' ELSE 's' END)"


@query(f"""WITH n AS (SELECT site, first_page % 3 AS c, first_page % 2 AS h, first_page % 5 AS m, first_page % 4 AS l, first_page % 6 AS pages, first_page % 7 AS gated, first_page % 11 = 0 AS broken FROM {SITES}), r AS (SELECT *, concat({_times('pages', 'page')}, ' read') AS pg,
        array_to_string(list_filter([CASE WHEN c > 0 THEN concat(c, ' critical') END, CASE WHEN h > 0 THEN concat(h, ' high') END], lambda x: x IS NOT NULL), ' and ') AS s,
        array_to_string(list_filter([CASE WHEN m > 0 THEN concat(m, ' medium') END, CASE WHEN l > 0 THEN concat(l, ' low') END], lambda x: x IS NOT NULL), ' and ') AS w FROM n)
    SELECT site, concat(CASE WHEN broken THEN 'The run was incomplete: 1 probe did not finish. ' ELSE '' END, CASE WHEN c + h > 0 THEN concat(s, ' finding', CASE WHEN c + h = 1 THEN '' ELSE 's' END, ' on the ', pg, '.')
        WHEN m + l > 0 THEN concat('No critical or high findings on the ', pg, '; ', w, '.') ELSE concat('No defects on the ', pg, '.') END, CASE WHEN c + h + m + l > 0 THEN ' Start with F-002: Mend it.' ELSE '' END,
        CASE WHEN gated > 0 THEN concat(' ', {_times('gated', 'check')}, ' had no verdict because parts of the site were not reached; see Coverage and limitations.') ELSE '' END) AS headline FROM r""")
def report_headline(spark, sf_dir):
    p, sites = F.col("first_page"), _sites(spark, sf_dir)
    counts = sites.select("site", *[(p % k).alias(s) for s, k in (("critical", 3), ("high", 2), ("medium", 5), ("low", 4))])
    start = counts.where("critical + high + medium + low > 0").select("site", F.lit("F-002").alias("id"), F.lit("Mend it.").alias("title"))
    reasons = F.array(F.lit("role_page_not_sampled"), F.lit("navigation_not_readable"))
    gaps = sites.where(p % 7 > 0).select("site", F.explode(F.sequence(F.lit(1), (p % 7).cast("int"))).alias("i")).select("site", F.concat(F.lit("c."), "i").alias("check_id"), F.lit("not_evaluated").alias("status"), F.element_at(reasons, F.col("i") % 2 + 1).alias("reason"))
    broken = sites.where(p % 11 == 0).select("site", F.lit("or.run.probe_error").alias("check_id"), F.lit("fail").alias("status"), F.lit(None).cast("string").alias("reason"))
    return report.headline(counts, sites.select("site", (p % 6).alias("pages")), start, gaps.unionByName(broken))


_CHOSEN = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ', ')"
_PICK = lambda key, known, state: _CHOSEN.format(", ".join(f"max({key}) FILTER ({key} = '{k}' AND state = '{state}')" for k in known))
_STAGES = ("access", "render", "extract", "entity", "freshness", "corroboration", "engagement")


@query(f"""WITH {_STAGE_RESULTS}, l0 AS (SELECT st.site, letter, any_value(base) AS base, bool_and(state = 'not_evaluated') AS none, bool_and(state = 'evaluated') AS whole FROM st JOIN {_values(_LETTERS, 'letter, stage, base')} ON v.stage = st.stage GROUP BY ALL),
    l AS (SELECT site, letter, CASE WHEN none THEN 'not_evaluated' WHEN whole THEN base ELSE 'partial' END AS state FROM l0),
    a AS (SELECT site, {_PICK('letter', 'ABCD', 'covered')} AS lc, {_PICK('letter', 'ABCD', 'partial')} AS lp, {_PICK('letter', 'ABCD', 'not_evaluated')} AS ln FROM l GROUP BY 1),
    b AS (SELECT site, {_PICK('stage', _STAGES, 'evaluated')} AS se, {_PICK('stage', _STAGES, 'partial')} AS sp, {_PICK('stage', _STAGES, 'not_evaluated')} AS sn FROM st GROUP BY 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY check_id) AS n FROM x WHERE status NOT IN ('pass', 'fail') AND reason <> 'not_applicable_for_category'),
    y AS (SELECT site, string_agg(concat(string_split(check_id, '.')[-1], ': ', reason), '; ' ORDER BY n) AS why FROM o WHERE n <= 3 GROUP BY 1)
    SELECT a.site, concat('Concepts covered: ', coalesce(nullif(array_to_string(list_filter([CASE WHEN lc <> '' THEN concat(lc, ' fully') END, CASE WHEN lp <> '' THEN concat(lp, ' partially', CASE WHEN why IS NOT NULL THEN concat(' (', why, ')') ELSE '' END) END,
        CASE WHEN ln <> '' THEN concat(ln, ' not evaluated') END], lambda v: v IS NOT NULL), '; '), ''), 'none'), '; E and F out of scope for a site audit, site-side levers reported. Stages evaluated: ', CASE WHEN se = '' THEN 'none' ELSE se END,
        CASE WHEN sp <> '' THEN concat('; partial: ', sp) ELSE '' END, CASE WHEN sn <> '' THEN concat('; not evaluated: ', sn) ELSE '' END, '. Pages sampled: ', CASE WHEN first_page % 2 = 0 THEN '2 (home, about); no page found for: blog' ELSE '1 (home)' END,
        '. Requests made: ', CASE WHEN first_page % 3 = 0 THEN 'unknown' ELSE (first_page % 9)::VARCHAR END, '. This audit reads what a non-JavaScript fetcher receives; it does not query live assistants or execute scripts.') AS statement
    FROM a JOIN b USING (site) JOIN {SITES} s USING (site) LEFT JOIN y USING (site)""")
def coverage_statement(spark, sf_dir):
    rows, p = _stage_results(spark, sf_dir), F.col("first_page")
    listed = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    sample = _sites(spark, sf_dir).select("site", F.when(p % 2 == 0, listed("home", "about")).otherwise(listed("home")).alias("roles"), F.when(p % 2 == 0, listed("blog")).otherwise(listed()).alias("missing_roles"), F.when(p % 3 != 0, p % 9).alias("requests"))
    stages = report.stage_coverage(rows)
    return report.coverage_statement(stages, report.concept_coverage(stages), rows, sample)


@query(f"""WITH q AS (SELECT s.site, s.first_page, v.ord, v.facts FROM {SITES} s JOIN {_values([(c, i, list(f)) for c, rows in V.SIMULATION_QUESTIONS.items() for i, (_, f, _) in enumerate(rows)], 'category, ord, facts')}
        ON v.category = ['ecommerce', 'saas_software', 'unknown'][s.first_page % 3 + 1])
    SELECT site, ord::INT AS ord, CASE WHEN len(list_filter(facts, lambda f: (first_page + length(f)) % 2 <> 0 OR (first_page + length(f)) % 8 = 0)) = 0 THEN concat('According to the site, "', facts[1], '!".',
        CASE WHEN len(facts) > 1 THEN concat(' It also states "', array_to_string(list_transform(facts[2:], lambda f: concat(f, '!')), '" and "'), '".') ELSE '' END) END AS answer FROM q""")
def question_answers(spark, sf_dir):
    """Values quoted to the letter; one that is navigation is no answer."""
    kinds = F.array(F.lit("ecommerce"), F.lit("saas_software"), F.lit("unknown"))
    sites = _sites(spark, sf_dir).withColumn("category", F.element_at(kinds, (F.col("first_page") % 3 + 1).cast("int")))
    asked = sites.join(F.broadcast(dim(spark, "sim_question")), "category")
    n = F.col("first_page") + F.char_length("fact_id")
    known = asked.select("site", "first_page", F.explode("fact_ids").alias("fact_id")).distinct().where(n % 2 == 0)
    value = F.when(n % 8 == 0, "a | b").otherwise(F.concat(F.lit(" "), "fact_id", F.lit("! ")))
    return report.answers(asked.select("site", "ord", "fact_ids"), known.select("site", "fact_id", F.lit("present").alias("status"), value.alias("value")))


@query(r"""WITH q AS (SELECT p_partkey AS p, concat(p_name, '  by ', p_brand) AS v FROM part), a AS (SELECT p, lower(trim(regexp_replace(v, '\s+', ' ', 'g'))) AS v,
        lower(concat('it says: ', CASE p % 5 WHEN 0 THEN regexp_replace(v, '\s+', ' ', 'g') WHEN 1 THEN substr(concat(regexp_replace(v, '\s+', ' ', 'g'), ' x'), 3, 22) WHEN 2 THEN left(v, 5) WHEN 3 THEN upper(regexp_replace(v, '\s+', ' ', 'g')) ELSE concat(left(regexp_replace(v, '\s+', ' ', 'g'), 12), ' ', substr(regexp_replace(v, '\s+', ' ', 'g'), 13)) END, '.')) AS a FROM q)
    SELECT p, CASE WHEN length(v) <= 20 THEN contains(regexp_replace(a, '\s+', ' ', 'g'), v) ELSE len(list_filter(range(1, length(v) - 18), lambda i: contains(regexp_replace(a, '\s+', ' ', 'g'), substr(v, i, 20)))) > 0 END AS quoted FROM a""")
def quotes_fact(spark, sf_dir):
    """Case, runs of white space and ellipses do not matter; letters do, twenty in a row."""
    v = F.concat("p_name", F.lit("  by "), "p_brand")
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), v.alias("v"), F.regexp_replace(v, r"\s+", " ").alias("one"))
    said = F.when(F.col("p") % 5 == 0, F.col("one")).when(F.col("p") % 5 == 1, F.substring(F.concat("one", F.lit(" x")), 3, 22)).when(F.col("p") % 5 == 2, F.substring("v", 1, 5)).when(F.col("p") % 5 == 3, F.upper("v")).otherwise(
        F.concat(F.substring("one", 1, 12), F.lit("…"), F.substring("one", 13, 1 << 20)))
    return rows.select("p", report.quotes_fact(F.concat(F.lit("It says: "), said, F.lit(".")), F.col("v")).alias("quoted"))


@query("""WITH n AS (SELECT s_nationkey::VARCHAR AS site, s_suppkey AS ord, ['Product', 'Organization', 'Nothing'][s_suppkey % 3 + 1] AS type, list_filter(['image', 'description', 'brand', 'sku', 'logo', 'sameAs', 'address', 'contactPoint'],
        lambda k: (s_suppkey + length(k)) % 2 = 0) AS keys FROM supplier),
    m AS (SELECT site, ord, type, list_filter(CASE type WHEN 'Product' THEN ['image', 'description', 'brand', 'sku'] WHEN 'Organization' THEN ['logo', 'sameAs', 'description', 'address', 'contactPoint'] ELSE [] END, lambda k: NOT list_contains(keys, k)) AS missing FROM n)
    SELECT site, ord, type, array_to_string(missing, ',') AS missing FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ord) AS k FROM m WHERE len(missing) > 0) WHERE k <= 2""")
def recommended_props(spark, sf_dir):
    keys = F.array(*map(F.lit, ("image", "description", "brand", "sku", "logo", "sameAs", "address", "contactPoint")))
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("site"), F.col("s_suppkey").alias("ord"),
                                                F.element_at(F.array(*map(F.lit, ("Product", "Organization", "Nothing"))), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("type"),
                                                F.filter(keys, lambda k: (F.col("s_suppkey") + F.char_length(k)) % 2 == 0).alias("keys"))
    return report.missing_recommended(rows, 2).select("site", "ord", "type", F.array_join("missing", ",").alias("missing"))


@query(f"SELECT s.site, t.token, CASE WHEN (s.first_page + length(t.token)) % 2 = 0 THEN 'probe' ELSE 'policy' END AS action FROM {SITES} s, {_values([(t[0],) for t in V.BOT_TIERS], 'token').replace('AS v', 'AS t')}")
def edge_plan(spark, sf_dir):
    rows = _sites(spark, sf_dir).join(F.broadcast(dim(spark, "bot_tier").select("token")))
    return report.edge_plan(rows.withColumn("root_allowed", (F.col("first_page") + F.char_length("token")) % 2 == 0))


# ---- categories and refusals ----------------------------------------------------------------

_LABELS = ["Cart", "Checkout", "World", "Politics", "Culture", "Sport", "Opinion", "World news and politics of the week", "Something else"]


@query("""WITH q AS (SELECT s_suppkey AS s, s_suppkey % 9 AS pages, s_suppkey % 5 AS prices, s_suppkey % 4 AS k FROM supplier)
    SELECT s AS site, 'ecommerce' AS category, (CASE WHEN prices >= 3 THEN 2 ELSE 0 END + CASE WHEN k = 1 THEN 2 ELSE 0 END)::INT AS score FROM q UNION ALL SELECT s, 'portfolio_personal', CASE WHEN pages <= 5 THEN 2 ELSE 0 END FROM q
    UNION ALL SELECT s, 'publisher_media', CASE k WHEN 2 THEN 4 ELSE 0 END FROM q""")
def made_category_scores(spark, sf_dir):
    """Labels of a shop, of an editorial section (five of its members count as four labels) and too few of them; few pages; several prices."""
    k = F.col("s_suppkey")
    site = F.concat(F.lit("m"), k.cast("string"), F.lit(".test"))
    rows = _t(spark, sf_dir, "supplier").select(site.alias("site"), k)
    chosen = F.when(k % 4 == 1, F.array(F.lit("Cart"), F.lit("Checkout"))).when(k % 4 == 2, F.array(*map(F.lit, _LABELS[2:7]))).when(k % 4 == 3, F.array(F.lit("World"), F.lit("Something else"))).otherwise(F.array().cast("array<string>"))
    none = spark.createDataFrame([], "site string, url string, type string")
    scores = sampling.score_categories(spark, rows.select("site"), rows.select("site", F.explode(chosen).alias("text")), none.select("site", "url"), none.select("site", "type"), rows.select("site", (k % 9).alias("pages"), (k % 5).alias("prices")))
    return scores.where(F.col("category").isin("ecommerce", "portfolio_personal", "publisher_media")).select(F.regexp_extract("site", r"^m(\d+)", 1).cast("bigint").alias("site"), "category", "score")


@query("""WITH q AS (SELECT s_suppkey AS s, s_suppkey % 6 AS k, s_suppkey % 7 = 0 AS down FROM supplier)
    SELECT s AS site, CASE WHEN down OR k IN (0, 1) THEN 'fail' ELSE 'inconclusive' END AS status, CASE WHEN down OR k IN (0, 1) THEN NULL WHEN k = 2 THEN 'audit_user_agent_refused' WHEN k = 3 THEN 'crawler_access_mixed' WHEN k = 4 THEN 'crawler_access_unknown' ELSE 'crawler_access_mixed' END AS reason FROM q""")
def refused_homes(spark, sf_dir):
    """A home page that refused the audit, by what crawlers got: all refused, none, some, none asked, one kept waiting; and home pages that are down."""
    s, k = F.col("s_suppkey"), F.col("s_suppkey") % 6
    rows = _t(spark, sf_dir, "supplier").select(s.alias("site"), s)
    pages = rows.select("site", F.lit("home").alias("role"), F.when(s % 7 == 0, 503).otherwise(F.element_at(F.array(F.lit(401), F.lit(403), F.lit(429)), (s % 3 + 1).cast("int"))).alias("status"))
    answer = lambda status, error=None: F.struct(F.lit("live_answer").alias("tier"), F.lit(status).cast("int").alias("status"), F.lit(error).cast("string").alias("error"))
    asked = F.when(k == 0, F.array(answer(403), answer(429))).when(k == 1, F.array(answer(None, "connection_reset"))).when(k == 2, F.array(answer(200), answer(200))).when(k == 3, F.array(answer(200), answer(403))).when(k == 5, F.array(answer(403), answer(None, "read_timeout")))
    baseline = rows.select("site", F.lit("baseline").alias("tier"), F.lit(403).alias("status"), F.lit(None).cast("string").alias("error"))
    probes = rows.select("site", F.explode(asked).alias("a")).select("site", "a.*").unionByName(baseline)
    results = rows.select("site", F.lit("cr.access.http_error").alias("check_id"), F.lit("fail").alias("status"), F.lit(None).cast("string").alias("reason"), F.array().cast(EVIDENCE).alias("evidence"))
    return checks.split_refusals(results, pages, probes).select("site", "status", "reason")
