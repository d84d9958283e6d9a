"""Encodings of recorded bodies, robots rules before fetching, pages picked for roles, and the sinks and readers of a run's folder."""

import gzip
import json
import random
import zlib

from pyspark.sql import functions as F

from webgrain.functions import vocab as V
from webgrain.operators import recorded, robots, sampling
from webgrain.sources import readers


def deflated(data: bytes) -> bytes:
    maker = zlib.compressobj(wbits=-zlib.MAX_WBITS)
    return maker.compress(data) + maker.flush()


def test_decompressed(spark):
    text = b"a body " * 500
    rows = [(0, gzip.compress(text), "gzip", text), (1, zlib.compress(text), "deflate", text), (2, deflated(text), "Deflate", text), (3, text, "identity", text), (4, text, None, text),
            (5, text, "gzip", text), (6, gzip.compress(text)[:-20], "x-gzip", gzip.compress(text)[:-20]), (7, None, "gzip", None), (8, b"", "gzip", b""), (9, text, "br", text)]
    df = spark.createDataFrame(rows, "n int, body binary, encoding string, want binary")
    out = df.select("n", "want", recorded.decompressed(F.col("body"), F.col("encoding")).alias("got")).collect()
    assert {r.n: r.got for r in out} == {r.n: r.want for r in out}
    short = df.where("n < 3").select(recorded.decompressed(F.col("body"), F.col("encoding"), 10).alias("got")).collect()
    assert [bytes(r.got) for r in short] == [text[:10]] * 3


def test_fetchable(spark):
    files = spark.createDataFrame([("a.test", "User-agent: *\nDisallow: /no\nAllow: /no/yes")], "site string, robots string")
    agents, rules, _ = robots.parse_robots(files)
    urls = spark.createDataFrame([("a.test", f"https://a.test{p}") for p in ("/", "/no", "/no/x", "/no/yes", "/no")] + [("b.test", "https://b.test/no")], "site string, url string")
    left = recorded.fetchable(urls, agents, rules, "some-bot")
    assert left.columns == ["site", "url"]
    assert sorted(r.url for r in left.collect()) == ["https://a.test/", "https://a.test/no/yes", "https://b.test/no"]


def test_results_of_a_folder(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"probe": "facts", "checks": [{"check_id": "fx.a", "status": "pass"}, {"check_id": "fx.b", "status": "fail", "reason": "x"}]}, indent=1))
    (tmp_path / "a.json").write_text('{"probe": "render", "checks": [')
    (tmp_path / "c.json").write_text(json.dumps({"probe": "render", "checks": [{"check_id": "cr.a", "status": "pass"}]}))
    results, broken = readers.read_results(spark, str(tmp_path), ("render", "facts"))
    assert [(r.probe, r.check_id, r.status, r.reason) for r in results.orderBy("rank", "ord").collect()] == [("render", "cr.a", "pass", None), ("facts", "fx.a", "pass", None), ("facts", "fx.b", "fail", "x")]
    assert [r.file for r in broken.collect()] == ["a.json"]


def test_sinks(spark, tmp_path):
    log = spark.createDataFrame([("a", "https://a/", "page", b"x"), ("a", "https://a/y", "page", b"y"), ("a", "https://a/robots.txt", "robots", b"z"), ("b", "https://b/", "page", None)],
                                "site string, url string, purpose string, body binary")
    readers.write_manifest(log, str(tmp_path / "manifest"))
    made = {r.site: (r.requests, r.by_purpose.asDict() if hasattr(r.by_purpose, "asDict") else r.by_purpose) for r in spark.read.schema("site string, requests bigint, by_purpose map<string,bigint>").json(str(tmp_path / "manifest")).collect()}
    assert made == {"a": (3, {"page": 2, "robots": 1}), "b": (1, {"page": 1})}
    readers.write_snapshots(log, str(tmp_path / "bodies"))
    assert sorted((r.url, bytes(r.body)) for r in spark.read.parquet(str(tmp_path / "bodies")).collect()) == [("https://a/", b"x"), ("https://a/robots.txt", b"z"), ("https://a/y", b"y")]
    readers.write_by_site(spark.createDataFrame([("a", "match"), ("b", None)], "site string, outcome string"), "lookup", str(tmp_path / "lookups"))
    assert sorted(json.loads(r.value)["site"] for r in spark.read.text(str(tmp_path / "lookups")).collect()) == ["a", "b"]


def test_answers_that_are_not_there(spark):
    row = spark.sql("SELECT CAST(NULL AS STRING) AS t")
    t = F.col("t")
    got = row.select(recorded.article_name(t).alias("name"), recorded.article_signals(t, t).alias("article"), recorded.entity_signals(t, t, t, t).alias("entity"), recorded.mention_searches(t, t, t).alias("asked")).first()
    assert got.name is None and got.article.title is None and not got.article.disambiguation and got.article.entries == 0
    assert not got.entity.website_match and got.asked == ['"" reviews', '"" site:linkedin.com']


def test_pages_are_picked_in_turn(spark):
    rng = random.Random(1)
    rows = [(f"s{s}", role, i + 1, f"https://s/{u}" + "/" * (u % 2), "nav", "m") for s in range(60) for role in V.ROLE_ORDER for i, u in enumerate(rng.sample(range(9), rng.randint(0, 8)))]
    got = sampling.pick_pages(spark.createDataFrame(rows, "site string, role string, rank int, url string, source string, matched string"))
    want, taken = {}, set()
    for site, role, _, url, _, _ in sorted(rows, key=lambda r: (r[0], V.ROLE_ORDER.index(r[1]), r[2])):
        if (site, role) not in want and (site, url.rstrip("/")) not in taken:
            want[site, role] = url
            taken.add((site, url.rstrip("/")))
    assert {(r.site, r.role): r.url for r in got.collect()} == want
