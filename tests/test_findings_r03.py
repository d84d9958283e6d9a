"""A test for each finding of round 3 that held: each fails on the code before its change."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from tests.conftest import SF
from webgrain import queries, queries_entities, queries_made  # noqa: F401
from webgrain.functions import text as T
from webgrain.operators import checks, grade, html, sampling


def test_page_summary_keeps_references_without_semicolon(spark, tmp_path):
    page = "<html lang='en'><head><title>a &amp; b &amp</title></head><body><h1>x &lt;y&gt; &amp</h1></body></html>"
    spark.createDataFrame([(1, "https://a.test/", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    row = queries.QUERIES["page_summary"](spark, str(tmp_path)).first()
    assert (row.title, row.h1) == ("a & b &amp", "x <y> &amp")
    assert html.read_document(page, "https://a.test/")["title"] == "a & b &"  # elsewhere as browsers read it
    assert spark.range(1).select(html.ended_references(F.lit("&amp &#38 &#x26; & &ab;c &"))).first()[0] == "&amp;amp &amp;#38 &#x26; & &ab;c &"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def made_docs(spark, parts=None):
    page = ("<html lang='en'><head><title>A</title><script type='application/ld+json'>{\"@type\": \"Product\", \"name\": \"a\"}</script></head>"
            "<body><nav><a href='/x'>X</a></nav><h1>A</h1><img src='a.png'>" + "<p>plain words stand here</p>" * 30 + "</body></html>")
    rows = [(i, f"https://s{i % 2}.test/{i}", "home" if i < 2 else "product", page if i % 3 else "<div id=root></div>") for i in range(6)]
    return html.parse_pages(spark.createDataFrame(rows, "p int, url string, role string, html string"), parts=parts)


def test_site_checks_alone_are_those_of_the_whole_grading(spark):
    """checks that nobody asks for are not worked out, and parts that nobody reads do not leave Python."""
    wanted = ("fx.jsonld.missing", "en.lang.attribute_missing", "cr.access.challenge_page")
    sites = spark.createDataFrame([("s0.test", "ecommerce"), ("s1.test", "ecommerce")], "site string, category string")
    day = F.lit("2024-06-01").cast("date")
    every = checks.grade_pages(checks.prepare(made_docs(spark), sites), day).where(F.col("check_id").isin(*wanted))
    few = checks.grade_pages(checks.prepare(made_docs(spark, (*checks.STATE_PARTS, "jsonld")), sites, ()), day, wanted)
    assert sorted(map(str, few.collect())) == sorted(map(str, every.collect())) and few.count() == 6


def test_made_pages_are_parsed_once(spark):
    """F8, F7: the sites of made pages come from their addresses; they were a second parse of all pages."""
    for name in ("made_render_states", "made_page_checks"):
        assert plan_of(queries.QUERIES[name](spark, SF)).count("MapInArrow") == 1, name


def test_audit_status_parses_once(spark):
    """its statuses read a small written table, where every use of them parsed the pages."""
    assert plan_of(queries.QUERIES["audit_status"](spark, SF)).count("MapInArrow") == 0


def test_parts_of_documents_are_as_in_whole_ones(spark):
    whole, part = made_docs(spark), made_docs(spark, ("title", "links", "jsonld", "body_text"))
    assert sorted(map(str, part.collect())) == sorted(map(str, whole.select(part.columns).collect())) and "images" not in part.columns


def test_roles_take_one_shuffle_and_no_copies_of_links(spark):
    """links are not multiplied by roles, phrases are not rewritten for each link, and one shuffle by site serves both windows."""
    links = spark.createDataFrame([("a.test", 0, "https://a.test/x", "About us!", "nav"), ("a.test", 1, "https://a.test/about", "see", "footer"), ("a.test", 2, "https://a.test/kontakt", "Kontakt", "main"),
                                   ("a.test", 3, "https://a.test/zzz", "peoples", "nav")], "site string, ord int, url string, text string, context string")
    found = sampling.role_candidates(links)
    assert {(r.role, r.rank, r.url, r.matched) for r in found.collect()} >= {("contact", 1, "https://a.test/kontakt", "kontakt")}
    assert {r.url for r in found.where("role = 'about'").collect()} == {"https://a.test/x", "https://a.test/about"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("hashpartitioning(site") == 1


def test_names_read_pages_that_were_parsed_once(spark):
    """candidates were worked out twice, and each time the pages were parsed three times."""
    assert plan_of(queries.QUERIES["lookup_names"](spark, SF)).count("MapInArrow") == 0


def test_texts_without_a_match_are_searched_once(spark):
    """the place is looked for first, and what was found is read only where there is a place."""
    rows = spark.createDataFrame([("a free trial here",), ("nothing",), ("",), (None,)], "t string").select(T.first_span(F.col("t"), "free_trial").alias("f"), T.spans(F.col("t"), "free_trial").alias("s")).collect()
    assert [r.f and (r.f.start, r.f.stop, r.f.m) for r in rows] == [(2, 12, "free trial"), None, None, None] and [len(r.s) for r in rows] == [1, 0, 0, 0]
    plan = plan_of(spark.createDataFrame([("x",)], "t string").select(T.first_span(F.col("t"), "free_trial")))
    assert plan.index("CASE WHEN") < plan.index("regexp_extract")


class PlainReader(html.DocumentReader):
    """The reader without patterns of its own for tags."""

    def goahead(self, end):
        left = len(self.rawdata)
        HTMLParser.goahead(self, end)
        self.cut += left - len(self.rawdata)


def plain_document(page, base):
    reader = PlainReader(page, base)
    try:
        reader.feed(page)
        reader.close()
    except Exception as x:  # noqa: BLE001  as read_document()
        reader.doc["parse_error"] = f"{type(x).__name__}: {x}"
    return reader.document()


def test_usual_tags_are_read_by_one_pattern(monkeypatch):
    """F5 to F8: a tag took five searches and its place a count of lines; odd markup is still HTMLParser's."""
    rows = [r'<!DOCTYPE html>', '<html lang="de">', "<p>a &amp; b &lt", '<A HREF="/x">', "</a>", "</A >", "<img src='a.png'/>", "<br / >", "<p hidden>", '<p a="1"b="2">', "<p a = b>", "<script>1 < 2", "</script>", "</ſcript>", "<style>", "</style>",
            "<!-- x -->", "<!--", "<![CDATA[ x ]]>", "<![1", "<?x>", "</>", "</ p>", "<1>", "<p\xa0a='b'>", "<p\x00>", '<div class="modal">', "</div>", "\n", '<a href="/a/../b">', '<a href="//h.test/">', '<a href="/p/q">t', "<h1>x", "</h1>", "<", "<p", '<p a="']
    pick = random.Random(5)
    for base in ("https://a.test/x/", "http://u@A.test:80/q?x#y", "", "ftp://f.test/a"):
        for _ in range(500):
            page = "".join(pick.choice(rows) for _ in range(pick.randint(0, 20)))
            assert html.read_document(page, base) == plain_document(page, base), page
    assert "parse_error" in html.read_document("<![1", "") and html.read_document("<![1", "")["parse_error"]
    asked = []
    monkeypatch.setattr(HTMLParser, "parse_starttag", lambda self, i: asked.append(i) or -1)
    found = html.read_document('<!DOCTYPE html><html lang="en"><body><h1 class="a" hidden>X</h1><img src=\'/a.png\'/><a href="/p">go</a></body></html>', "https://a.test/")
    assert not asked and [x["url"] for x in found["links"]] == ["https://a.test/p"] and found["images"][0]["src"] == "https://a.test/a.png"


def test_pages_hit_are_judged_once_a_site_and_keys_dealt_over_cores(spark):
    """the lists of a site's roles were compared anew for each of its checks, and a file of one row group was one task."""
    rows = [("a", "fx.jsonld.missing", c, r, 3, k) for c in ("ecommerce", "unknown", None) for r in (["home"], ["blog"], ["about", "contact", "home"], [], None) for k in ("low", None)]
    fails = spark.createDataFrame(rows, "site string, check_id string, category string, roles array<string>, sampled_pages int, confidence string")
    late, soon = grade.adjust_severity(fails), grade.adjust_severity(grade.placed(fails))
    assert sorted(map(str, late.collect())) == sorted(map(str, soon.select(late.columns).collect())) and late.count() == len(rows)
    plan = plan_of(queries.QUERIES["impact_priority"](spark, SF))
    assert plan.index("arrays_overlap") > plan.index("check_id") and "RepartitionByExpression [c_custkey" in plan
