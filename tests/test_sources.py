"""Readers of recorded fetches, and the stream of pages."""

from pyspark.sql import functions as F

from webgrain.sources import readers
from webgrain.streaming import pages as stream
from tests.conftest import SF


def log(spark, rows):
    names = "site string, url string, status int, error string, challenge boolean, purpose string, text string"
    return spark.createDataFrame(rows, names).select("*", F.encode("text", "UTF-8").alias("body"), F.lit("2024-01-01").cast("timestamp").alias("fetched_at"))


def test_robots_states(spark):
    rows = [("a", "https://a/robots.txt", 200, None, False, "robots", "User-agent: *"), ("b", "https://b/robots.txt", 404, None, False, "robots", ""), ("c", "https://c/robots.txt", 503, None, False, "robots", "")]
    assert {r.site: r.state for r in readers.robots_of(log(spark, rows)).collect()} == {"a": "ok", "b": "missing", "c": "unreachable"}


def test_sitemaps(spark):
    good = "<urlset><url><loc> https://a/x?a=1&amp;b=2 </loc></url><url><LOC>https://a/y</LOC></url></urlset>"
    rows = [("a", "https://a/news-sitemap.xml", 200, None, False, "sitemap", "junk"), ("a", "https://a/sitemap.xml", 200, None, False, "sitemap", good),
            ("b", "https://b/sitemap.xml", 200, None, False, "sitemap", "<html>"), ("c", "https://c/sitemap.xml", 200, None, False, "sitemap", "https://c/1\nhttps://c/2\n")]
    states, urls = readers.sitemaps_of(log(spark, rows))
    assert {r.site: r.state for r in states.collect()} == {"a": "ok", "b": "invalid", "c": "ok"}
    assert sorted(r.url for r in urls.collect()) == ["https://a/x?a=1&b=2", "https://a/y", "https://c/1", "https://c/2"]


def test_stream_of_pages(spark, tmp_path):
    source = tmp_path / "in"
    spark.read.parquet(f"{SF}/pages.parquet").write.parquet(str(source))
    run = stream.states(stream.read_pages(spark, str(source))).writeStream.format("memory").queryName("states").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("states").count() == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_snapshots(spark, tmp_path):
    (tmp_path / "home.html").write_text("<html>\n<title>a</title>\n</html>\n")
    (tmp_path / "about.html").write_text("<p>\nb")
    rows = readers.read_snapshots(spark, str(tmp_path), "https://a.test/").orderBy("page_ord", "role").collect()
    assert [(r.site, r.url, r.role, r.html) for r in rows] == [("a.test", "https://a.test/", "home", "<html>\n<title>a</title>\n</html>\n"), ("a.test", "https://a.test/about", "about", "<p>\nb")]
