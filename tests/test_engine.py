"""Functions and operators of the engine on small inputs with exact expectations."""

from pyspark.sql import functions as F

from webgrain.functions import text as T
from webgrain.functions import url as U
from webgrain.functions import vocab as V
from webgrain.functions.dims import ROWS, dim
from webgrain.operators import checks, facts, grade, html, robots, sampling


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_registry_and_titles_agree():
    ids = [c[0] for c in V.CHECKS]
    assert len(ids) == len(set(ids)) == 61
    assert set(ids) == set(V.POSITIVE_TITLES)


def test_every_dimension_builds(spark):
    for name in ROWS:
        assert dim(spark, name).count() > 0, name


def test_every_pattern_compiles(spark):
    for name in V.PATTERNS:
        one(spark, T.matches(F.lit("some text"), name))


def test_words_keep_marks(spark):
    assert one(spark, T.words(F.lit("für día naïve हिन्दी a_b"))) == ["für", "día", "naïve", "हिन्दी", "a_b"]
    assert one(spark, T.word_count(F.lit(None).cast("string"))) == 0


def test_excerpt_snaps_to_words(spark):
    text = F.lit("The quick brown fox says that we offer a free trial of thirty days to everyone in town")
    assert one(spark, T.excerpt(text, "free_trial", 12, 10)) == "…we offer a free trial of…"
    assert one(spark, T.excerpt(F.lit("nothing here"), "free_trial")) is None


def test_titles_are_cut_at_words(spark):
    long = "word " * 30
    out = one(spark, T.clip_title(F.lit(long)))
    assert len(out) <= 90 and out.endswith("word…")


def test_dates(spark):
    assert str(one(spark, T.parse_date(F.lit("2024-02-29T10:00:00")))) == "2024-02-29"
    assert one(spark, T.parse_date(F.lit("2024-02-30"))) is None
    assert one(spark, T.copyright_years(F.lit("© 2001-2010 x © 2015–present"), F.lit("2024-01-01").cast("date"))) == [2010, 2024]


def test_urls(spark):
    assert one(spark, U.normalize(F.lit("HTTPS://User@Ex.COM:443?a=1#f"))).startswith("https://")
    assert one(spark, U.host(F.lit("https://u:p@WWW.Ex.com:8080/p"))) == "www.ex.com"
    assert one(spark, U.registrable_domain(F.lit("a.b.co.uk"))) == "b.co.uk"
    assert one(spark, U.registrable_domain(F.lit("a.b.example.com"))) == "example.com"
    assert one(spark, U.canonical_key(F.lit("https://www.ex.com/A/"))) == "ex.com/a"
    assert one(spark, U.host(F.lit(None).cast("string"))) == ""


def test_robots_truth_table(spark):
    text = "User-agent: a\nuser-agent: b\nDisallow: /\n\nUser-agent: *\nDisallow: /x*/y$\nAllow: /p\nDisallow: /p\nDisallow: /%7Eme\n"
    agents, rules, _ = robots.parse_robots(spark.createDataFrame([("s", "﻿" + text)], "site string, robots string"))
    asked = [("A", "/", False), ("B", "/q", False), ("c", "/x1/y", False), ("c", "/x1/yz", True), ("c", "/p/q", True), ("c", "/~me", False), ("c", "/", True)]
    got = robots.decide(agents, rules, spark.createDataFrame([("s", t, p) for t, p, _ in asked], "site string, token string, path string")).collect()
    assert {(r.token, r.path): r.allowed for r in got} == {(t, p): ok for t, p, ok in asked}


def test_no_group_allows(spark):
    agents, rules, _ = robots.parse_robots(spark.createDataFrame([("s", "User-agent: x\nDisallow: /")], "site string, robots string"))
    got = robots.decide(agents, rules, spark.createDataFrame([("s", "y", "/"), ("t", "y", "/")], "site string, token string, path string")).collect()
    assert all(r.allowed and r.rule is None for r in got) and len(got) == 2


PAGE = """<html lang="en-GB"><head><title> A  b </title><meta name="Description" content="d"><script>var x = "</p>";</script>
<script type="application/ld+json">{"@graph": [{"@type": "Organization", "name": "N"}]}</script><script type="application/ld+json">{bad</script></head>
<body><header><nav><ul><li><a href="/a#x">A</a><li><a href="https://other.test/">O</a></ul></nav></header><div id="root"></div>
<h1 class="sr-only">Hid</h1><h1>Seen <b>well</b></h1><p>one<p>two <img src="i.png" width="80px"><form><input name="q"></form>
<div class="modal" style="display:none">x y</div><footer>&copy; 2020 N</footer></body></html>"""


def test_document_model():
    doc = html.read_document(PAGE, "https://www.s.test/p/")
    assert (doc["title"], doc["lang"], doc["meta"]) == ("A b", "en-GB", {"description": "d"})
    assert [(x["url"], x["internal"], x["context"], x["in_list"]) for x in doc["links"]] == [("https://www.s.test/a", True, "nav", True), ("https://other.test/", False, "nav", True)]
    assert [(h["text"], h["hidden"]) for h in doc["headings"]] == [("Hid", True), ("Seen well", False)]
    assert doc["empty_roots"] == ["root"] and doc["images"][0]["width"] == 80 and doc["forms"][0]["inputs"][0]["name"] == "q"
    assert [b["error"] is None for b in doc["jsonld"]] == [True, False]
    assert [(n["types"], n["top"]) for n in doc["nodes"]] == [([], False), (["Organization"], True)]
    assert doc["overlays"][0]["hidden"] and doc["overlays"][0]["words"] == 2
    assert doc["body_text"] == "A O Hid Seen well one two x y © 2020 N"


def test_document_model_never_raises():
    for broken in ("", "<", "<a href='x", "</p></p>", "<script>", "<h1><h2></h1>", "\0<p>", "<a href='http://[bad'>x</a>"):
        html.read_document(broken, "not a url")


def test_render_states(spark):
    rows = [(1, "https://a.test/", "<body><noscript>Please enable JavaScript</noscript></body>"), (2, "https://b.test/", '<body><div id="app"></div></body>'),
            (3, "https://c.test/", "<p>" + "word " * 80), (4, "https://d.test/", "<p>few words</p>")]
    docs = html.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.s for r in docs.select("page_id", checks.render_state().alias("s")).collect()} == {1: "gate", 2: "shell", 3: "ok", 4: "none"}


def test_facts_take_the_first_and_guard_it(spark):
    body = "<p>Call 020 7946 0958 or write to me@s.test. From $5 a month.</p>"
    rows = [(1, "https://s.test/", "<p>hello | $9 | menu</p>" + body, "home", 0), (2, "https://s.test/contact", "<a href='mailto:c@s.test?x=1'>m</a>", "contact", 1)]
    docs = html.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string, role string, page_ord int"))
    got = {r.detector: (r.value, r.source) for r in facts.detect(docs, ("email", "phone", "price")).collect()}
    assert got["email"] == ("c@s.test", "link:mailto")
    assert got["phone"] == ("020 7946 0958", "text")
    assert got["price"][0] is None  # the first price stands among menu separators, later ones do not count


def test_addresses(spark):
    yes = ["12 Harbour Street, Leeds", "Hauptstrasse 12", "12 rue des Archives", "Registered office: Foo House LS1 4AP", "India 560001", "〒100-0001"]
    no = ["45000 Requests handled", "finished in 12th place", "version 10.2"]
    rows = spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", facts.address_label(F.col("t")).alias("a")).collect()
    assert [r.t for r in rows if r.a] == yes


def test_guarded_matches(spark):
    """Spans of all matches against the regular expression engine of Python, and guards that let a later match pass."""
    import re
    from webgrain.functions import text as T
    texts = ["Call 020 7946 0958 or 030 1234567, x020 7946 0958y", "020 7946 0958", "", None, "no numbers", "+44 20 1234 5678 é 020 7946 0958 ü 0211 635 5335 end"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.spans(F.col("t"), "phone_text").alias("s"), T.first_span(F.col("t"), "phone_text").alias("f"),
                                                                            T.guarded(F.col("t"), "phone_text", lambda t, s: s["start"] > 10).alias("g")).collect()
    for r in rows:
        want = [(m.start(), m.end(), m[0]) for m in re.finditer(V.PATTERNS["phone_text"][0], r.t or "")]
        assert [tuple(x) for x in r.s] == want and (r.f and tuple(r.f)) == (want[0] if want else None)
        assert (r.g and tuple(r.g)) == next((w for w in want if w[0] > 10), None)
    got = lambda t: spark.range(1).select(facts.text_phone(F.lit(t)), facts.address_label(F.lit(t)), facts.address_excerpt(F.lit(t))).first()
    assert got("order 020 7946 0958, tel. 030 12345678")[0] == "030 12345678" and got("phone us at any time on 020 7946 0958")[0] is None
    assert got("4 x AB1 2CD, 2 x Foo House LS1 4AP.")[1] == "uk_postcode" and got("4 x AB1 2CD.")[1] is None
    assert got("4 x AB1 2CD, and so many other things that nobody can count them, 2 x Foo House LS1 4AP.")[2].endswith("2 x Foo House LS1 4AP.")


def test_severity_order(spark):
    rows = [("s", "cr.access.http_error", "unknown", ["home"], 5, None), ("s", "en.mobile.viewport_missing", "unknown", ["blog"], 5, None),
            ("s", "en.perf.page_weight_heavy", "unknown", ["home"], 5, "low"), ("s", "cr.index.sitemap_missing", "ecommerce", [], 5, None)]
    got = grade.adjust_severity(spark.createDataFrame(rows, "site string, check_id string, category string, roles array<string>, sampled_pages int, confidence string"))
    assert {r.check_id: r.severity for r in got.collect()} == {
        "cr.access.http_error": "critical", "en.mobile.viewport_missing": "medium", "en.perf.page_weight_heavy": "low", "cr.index.sitemap_missing": "medium"}


def finding(check_id, pages=(), evidence=(), rank=3, top=0, **site):
    return {"check_id": check_id, "pages": list(pages), "rank": rank, "top": top, "status": "fail", "home_url": "home", "html_urls": ["home", "u"], "category": "ecommerce",
            "evidence": [{"page": "u", "kind": "computed", "value": v, "location": None, "note": None} for v in evidence]} | site


def folded(*findings):
    return {r["check_id"]: (r["folded_into"], r["fold_row"]) for r in grade.fold_site(list(findings)) if r["folded_into"]}


def test_fold_order_and_inheritance():
    found = [finding("cr.render.js_gate", ["u"], rank=1), finding("fx.identity.og_missing", ["u"], rank=0), finding("en.mobile.viewport_missing", ["u", "v"], rank=1), finding("cr.access.challenge_page", ["u"], rank=4, top=4, status="inconclusive")]
    assert folded(*found[:3]) == {"fx.identity.og_missing": ("cr.render.js_gate", 4)}
    assert folded(*found) == {"cr.render.js_gate": ("cr.access.challenge_page", 1), "fx.identity.og_missing": ("cr.access.challenge_page", 1)}  # row 1 leaves nothing for row 4
    by_id = {r["check_id"]: r for r in grade.fold_site(found[:3])}
    assert by_id["cr.render.js_gate"]["rank"] == 0  # inherited
    assert [e["value"].split(";")[0] for e in by_id["cr.render.js_gate"]["evidence"]] == ["folded=fx.identity.og_missing", "severity_inherited_from=fx.identity.og_missing"]
    assert {r["check_id"]: r["rank"] for r in grade.fold_site(found)}["cr.access.challenge_page"] == 4  # what is open inherits nothing
    capped = {r["check_id"]: r["rank"] for r in grade.fold_site([finding("cr.index.sitemap_missing", rank=3, top=2), finding("cr.index.sitemap_invalid", rank=1)])}
    assert capped["cr.index.sitemap_missing"] == 2


def test_folds_by_provenance():
    nap, fact = "ef.entity.nap_missing_plain_text", "fx.facts.key_fact_missing"
    local = {"category": "local_business"}
    assert folded(finding(nap, **local), finding(fact, evidence=["missing=address,phone"], **local)) == {fact: (nap, 8)}
    assert not folded(finding(nap), finding(fact, evidence=["missing=address,phone"])) and not folded(finding(nap, **local), finding(fact, evidence=["missing=address,price"], **local))
    tiers = [finding(f"cr.robots.{t}") for t in ("index_bot_blocked", "live_answer_bot_blocked")]
    out = {r["check_id"]: r for r in grade.fold_site([finding("cr.robots.blanket_disallow"), *tiers])}
    assert [e["value"].split("note=")[1] for e in out["cr.robots.blanket_disallow"]["evidence"]] == ["affected tiers: index", "affected tiers: index, live_answer"]
    gates = [finding("cr.render.js_gate", ["home"]), finding("cr.render.csr_shell", ["u"]), finding(fact)]
    assert folded(*gates) == {fact: ("cr.render.js_gate", 5)}  # the two together leave no page read
    assert not folded(*[f | {"html_urls": ["home", "u", "v"]} for f in gates])
    assert folded(*[f | {"html_urls": ["home"]} for f in gates]) == {fact: ("cr.render.js_gate", 5)}


def test_a_new_link_or_headline_ends_the_open_one():
    doc = html.read_document("<div><a href=/1>x<a href=/2>y</a></div><a href=/3>z</div> more</a><a href=/4>open", "http://a.test/")
    assert [(x["url"], x["text"]) for x in doc["links"]] == [("http://a.test/2", "y"), ("http://a.test/3", "z more")]
    doc = html.read_document("<div><h1>Title</h2><p>lots of other text</p></div><h2>One<h3>Two</h3></h2><h4>never ended", "http://a.test/")
    assert [(h["tag"], h["text"]) for h in doc["headings"]] == [("h1", "Title"), ("h3", "Two")]
    doc = html.read_document("<h1>A <a href=/1>linked <b>title</b></a> here</h1>", "http://a.test/")
    assert doc["headings"][0]["text"] == "A linked title here" and doc["links"][0]["text"] == "linked title"


def test_structured_data_at_any_depth(spark):
    from webgrain.operators import nodes
    markup = """<script type="application/ld+json">{"@graph": [{"@type": "WebPage", "@id": "#p", "name": "Page", "empty": "", "n": 3, "publisher": {"@type": "School", "name": "S"}, "mentions": [{"@type": "Store", "name": "T"}]},
        {"@type": ["Dentist"], "name": "D"}]}</script><script type="application/ld+json">{"@type": "Organization", "@graph": [{"@type": "Person", "name": "P"}]}</script>
        <script type="application/ld+json">{"@type": "Product", "review": [1], </script><script type="application/ld+json">[]</script>"""
    docs = html.parse_pages(spark.createDataFrame([(1, "https://s.test/", markup)], "page_id long, url string, html string"))
    got = docs.select("nodes", nodes.distinct_types().alias("types"), F.transform(nodes.owners(), lambda n: n["types"][0]).alias("owners"), nodes.values_of("name").alias("names"), nodes.lacking(F.col("nodes")).alias("lacking")).first()
    assert got.types == ["WebPage", "School", "Store", "Dentist", "Organization", "Person"] and got.owners == ["School", "Dentist", "Organization"]
    assert got.names == ["Page", "S", "T", "D", "P"]
    assert [(m.block, m.type, m.as_type, m.missing) for m in got.lacking] == [(0, "Dentist", "LocalBusiness", ["address"]), (1, "Organization", "Organization", ["name", "url"])]
    page = next(n for n in got.nodes if n.types == ["WebPage"])
    assert page.keys == ["@type", "@id", "name", "n", "publisher", "mentions"] and page.id == "#p" and page.top and page.link == 0
    assert [n.link for n in got.nodes if n.types == ["Store"]] == [None]
    leaves = {(r.block, r.path): r.value for r in nodes.jsonld_walk(docs, "page_id").collect()}
    assert leaves[0, "mentions.0.name"] == "T" and leaves[0, "n"] == "3" and leaves[1, "name"] == "P"


def test_greedy_page_pick(spark):
    rows = [("s", "about", 1, "https://s/x", "nav", "k"), ("s", "contact", 1, "https://s/x/", "nav", "k"), ("s", "contact", 2, "https://s/y", "nav", "k")]
    got = sampling.pick_pages(spark.createDataFrame(rows, "site string, role string, rank int, url string, source string, matched string")).collect()
    assert {r.role: r.url for r in got} == {"about": "https://s/x", "contact": "https://s/y"}


def test_link_and_sitemap_checks(spark):
    links = [("a", f"https://h.test/{i}", 403, None, None, None) for i in range(3)] + [("b", "https://h.test/1", 404, None, None, None), ("c", "https://h.test/1", None, "timeout", None, None)]
    got = checks.link_checks(spark.createDataFrame(links, "site string, url string, status int, error string, challenge boolean, skipped string")).collect()
    states = {(r.site, r.check_id): r.status for r in got}
    assert states["a", "en.links.blocked_cluster"] == "inconclusive" and states["a", "en.links.broken_sampled"] == "pass" and states["b", "en.links.broken_sampled"] == "fail"
    maps = checks.sitemap_checks(spark.createDataFrame([("a", "missing"), ("b", "challenge")], "site string, state string")).collect()
    assert {(r.site, r.check_id[9:]): r.status for r in maps} == {("a", "sitemap_missing"): "fail", ("a", "sitemap_invalid"): "pass", ("b", "sitemap_missing"): "inconclusive", ("b", "sitemap_invalid"): "inconclusive"}


def test_edge_checks(spark):
    rows = [("a", "base", "baseline", 200, None, 100), ("a", "Googlebot", "index", 403, None, 0), ("b", "base", "baseline", 200, None, 100), ("b", "Googlebot", "index", None, "timeout", 0), ("c", "base", "baseline", 503, None, 0)]
    got = checks.edge_checks(spark.createDataFrame(rows, "site string, token string, tier string, status int, error string, bytes long"))
    assert {r.site: r.status for r in got.where("check_id = 'cr.access.edge_block'").collect()} == {"a": "fail", "b": "inconclusive", "c": "not_evaluated"}


def test_empty_pages(spark):
    docs = html.parse_pages(spark.createDataFrame([], "page_id long, url string, html string"))
    assert docs.count() == 0


def test_site_categories_use_all_evidence(spark, tmp_path):
    """A made shop, and the scores of all sites against brute force over their documents."""
    import re
    from urllib.parse import urlsplit

    from tests.conftest import SF
    from webgrain import queries
    from webgrain.functions import vocab as V

    page = ('<html><head><script type="application/ld+json">{"@type": "Product", "name": "x"}</script></head><body><nav><a href="/cart">Cart</a>'
            '<a href="/product/1">Shoes</a><a href="/about">About us</a></nav><h1>Shoes</h1></body></html>')
    made = spark.createDataFrame([(10**6, "https://shop.test/", page), (10**6 + 1, "https://shop.test/about", "<html><body><h1>About us</h1></body></html>")],
                                 "page_id bigint, url string, html string")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages.unionByName(made.select([made[c].cast(pages.schema[c].dataType).alias(c) for c in pages.columns])).write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.site, r.category): r.score for r in queries.site_category_scores(spark, str(tmp_path)).collect()}
    assert got["shop.test", "ecommerce"] > 0
    assert {(r.site, r.category) for r in queries.site_categories(spark, str(tmp_path)).collect()} >= {("shop.test", "ecommerce")}
    assert ("shop.test", "about", "https://shop.test/about") in {(r.site, r.role, r.url) for r in queries.page_roles(spark, str(tmp_path)).where("rank = 1").collect()}

    docs = {}
    for d in queries._docs(spark, str(tmp_path)).select("site", "page_id", "url", "links", "nodes", "body_text").collect():
        docs.setdefault(d.site, []).append(d)
    bare = lambda x: " " + re.sub(r"[^\w']+", " ", x) + " "
    domain = lambda h: ".".join(h.split(".")[-2:])
    caps = V.SCORE_CAPS
    for site, own in docs.items():
        home = min(own, key=lambda d: d.page_id)
        links = [x for x in home.links if x.url.startswith(("http://", "https://")) and domain((urlsplit(x.url).hostname or "").lower()) == domain(site)]
        labels = {" ".join(x.text.split()).lower() for x in links}
        labels = {x for x in labels if x and len(x) <= 60 and len(x.split()) <= V.NAV_LABEL_MAX_WORDS}
        paths = {urlsplit(u).path.lower() for u in [x.url for x in links] + [d.url for d in own]}
        types = {t for d in own for n in d.nodes for t in n.types}
        for category, sig in V.CATEGORY_SIGNALS.items():
            hits = {next((k for k in sig["nav"] if x == k or bare(k) in bare(x)), None) for x in labels} - {None}
            cluster = sig.get("nav_cluster")
            score = min(len(hits), caps["nav"])
            members = {next((k for k in cluster["members"] if x == k or bare(k) in bare(x)), None) for x in labels} - {None} if cluster else set()
            if cluster and len(members) >= cluster["min"]:
                score = min(caps["nav"], score + len(members))
            score += 2 * (category == "portfolio_personal" and len({x.url for x in home.links if x.internal}) <= 5)
            score += 2 * (category == "ecommerce" and len(re.findall(V.PATTERNS["price"][0], home.body_text, re.I)) >= 3)
            score += min(sum(any(p in x for x in paths) for p in set(sig["url"])), caps["url"])
            score += caps["tld"] * bool(set(site.split(".")[-2:]) & set(sig["tld"]))
            score += caps["jsonld"] if types & set(sig["jsonld"]) else caps["jsonld_generic"] if types & set(sig.get("jsonld_generic", ())) else 0
            assert got[site, category] == score, (site, category)


def test_titles_notices_and_numbers(spark):
    from webgrain.operators import facts
    from webgrain.functions import text as T
    assert html.read_document("<html><head><title></title></head><body><svg><title>Icon</title></svg><p>x</p>", "http://a.test/")["title"] is None
    day = F.lit("2024-06-01").cast("date")
    years = lambda t: spark.range(1).select(T.copyright_years(F.lit(t), day)).first()[0]
    assert [years(t) for t in ("© Acme Ltd 2019", "Copyright (c) Acme 2018", "© 2015-current", "2015")] == [[2019], [2018], [2024], []]
    phone = spark.range(1).select(facts.text_phone(F.lit("Call 020 7946 0958 or +44 20 1234 5678"))).first()[0]
    assert phone == "020 7946 0958"


def test_audit_without_recordings(spark):
    """What was not recorded is not evaluated, challenge pages and unanswerable questions are informational findings, a report has its words."""
    from webgrain.plans import audit as plan
    text = "<html lang=en><head><title>Acme tools</title></head><body><nav><a href=/a>A</a></nav><h1>Tools that help you build</h1><p>" + "we make tools for people who build things " * 12 + "</p></body></html>"
    pages = spark.createDataFrame([(1, "https://a.test/", text, "home", 0, False), (2, "https://a.test/x", "<html><body>Just a moment</body></html>", "blog", 1, True)],
                                  "page_id int, url string, html string, role string, page_ord int, challenge boolean")
    from webgrain.sources.store import written
    docs = written(html.parse_pages(pages), "docs")
    result = plan.audit(docs, spark.createDataFrame([("a.test", "saas_software")], "site string, category string"), "2024-06-01")
    status = {r.check_id: (r.status, r.reason) for r in result.checks.collect()}
    for check in ("cr.robots.blanket_disallow", "cr.index.sitemap_missing", "cr.access.edge_block", "en.links.broken_sampled", "en.errors.soft_404", "ef.entity.wikidata_not_found"):
        assert status[check] == ("not_evaluated", "not_recorded"), check
    assert status["cr.access.challenge_page"][0] == "inconclusive" and status["or.run.probe_error"][0] == "pass"
    found = {r.check_id: r for r in result.findings.collect()}
    assert found["cr.access.challenge_page"].severity == "info" and "fx.jsonld.missing" in found
    told = plan.report(result, docs, spark.createDataFrame([("a.test", "saas_software")], "site string, category string")).first().report
    assert "summary_file" in [r.name for r in told.recommendations] and len(told.recommendations) <= 8
    assert told.limitations[0].startswith("This report reflects a single point-in-time fetch of 2 sampled pages") and "served HTML only" in told.limitations[-1]
    assert told.narrative.startswith("This audit read 2 pages and ran 61 checks") and "Start with F-" in told.narrative
    assert told.headline.startswith(("1 high finding on the 1 page read. Start with F-001", "No critical or high findings on the 1 page read")) and told.headline.endswith("see Coverage and limitations.")
    assert told.statement.startswith("Concepts covered: A, B, C, D partially (") and "Pages sampled: 2 (blog, home); no page found for: about, contact, pricing, product." in told.statement
    first = told.findings[0]
    assert first.id == "F-001" and first.title and first.evidence and first.suggested_action.summary and first.dedupe_key.startswith(first.check_id + "|")
    notes = {f.check_id: (f.status, f.severity, f.effort) for f in told.findings}
    assert notes["or.simulation.question_unanswerable"] == ("fail", "info", "n/a") and notes["cr.access.challenge_page"] == ("inconclusive", "info", "n/a")
    questions = {q.question: q for q in told.questions}
    assert any(q.startswith("What sets") and questions[q].informational for q in questions) and any("a good fit for" in q for q in questions)
    from webgrain.operators import markdown
    text = markdown.markdown(plan.report(result, docs, spark.createDataFrame([("a.test", "saas_software")], "site string, category string"))).first().markdown
    for part in ("# Audit of a.test", "## Summary", "## Quick wins", f"#### F-001 {first.title}", "*Do this.*", "## What is working", "## Questions and answers", "## Coverage and limitations", "Outside this audit's scope"):
        assert part in text, part
    ready = written(checks.prepare(docs, spark.createDataFrame([("a.test", "saas_software")], "site string, category string")), "ready")
    plan_text = checks.grade_pages(ready, F.lit("2024-06-01").cast("date"))._jdf.queryExecution().executedPlan().toString()
    assert plan_text.count("MapInArrow") == 0 and plan_text.count("Exchange hashpartitioning") == 2  # page checks and site checks
