"""Sources: recorded fetches, robots files, sitemaps, page snapshots; and the sinks of a report.

Fetching is an ingest job's work; the engine reads what it recorded. All readers go through Spark, so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.functions.url import host, sitemap_rank

#: One row a fetch. `purpose` says what for: page, robots, sitemap, edge, link, missing_page.
FETCH_LOG = """site string, url string, final_url string, redirect_chain array<string>, cross_domain boolean, status int, headers map<string,string>, content_type string,
charset string, is_html boolean, is_text boolean, bytes bigint, truncated boolean, elapsed_ms int, challenge boolean, challenge_vendor string, blocked boolean, skipped string,
error string, fetched_at timestamp, purpose string, body binary"""
BODY_MOST = 2 << 20
SITEMAP_TRIES = 2


def read_fetch_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FETCH_LOG).parquet(path)


def text_of(body: Column) -> Column:
    """The text of a body, which is cut off beyond BODY_MOST bytes; bytes that are no UTF-8 become replacement characters."""
    return F.decode(F.substring(body, 1, BODY_MOST), "UTF-8")


def pages_of(log: DataFrame, role: Column | None = None) -> DataFrame:
    """Recorded pages for parse_pages(): url, html and the answer's columns. role defaults to unknown."""
    own = log.where("purpose = 'page'")
    return own.select("site", "url", "final_url", (F.lit("unknown") if role is None else role).alias("role"), F.row_number().over(_by_url("site", "url")).alias("page_ord"), "status", "headers", "is_html",
                      "challenge", "skipped", "error", text_of(F.col("body")).alias("html"))


def _by_url(site: str, url: str):
    from pyspark.sql import Window as W
    return W.partitionBy(site).orderBy(url)


def robots_of(log: DataFrame) -> DataFrame:
    """(site, state, robots): ok with a text, missing on 4xx, unreachable on 5xx, errors and challenges."""
    own = log.where("purpose = 'robots'")
    state = F.when(F.col("challenge") | F.col("error").isNotNull() | (F.col("status") >= 500), "unreachable").when(F.col("status") >= 400, "missing").otherwise("ok")
    return own.groupBy("site").agg(F.max_by(F.struct(state.alias("state"), text_of(F.col("body")).alias("robots")), "fetched_at").alias("r")).select("site", "r.state", "r.robots")


def sitemap_kind(text: Column) -> Column:
    """urlset, sitemapindex, or null for neither; a list of URLs without markup is a urlset."""
    head = F.lower(F.substring(text, 1, 2000))
    plain = text.rlike(r"(?m)^\s*http") & ~F.substring(text, 1, 200).contains("<")
    return F.when(head.contains("<sitemapindex"), "sitemapindex").when(head.contains("<urlset") | plain, "urlset")


def sitemap_locs(text: Column) -> Column:
    marked = F.transform(F.regexp_extract_all(text, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda u: F.replace(F.regexp_replace(u, r"\s+", ""), F.lit("&amp;"), F.lit("&")))
    lines = F.filter(F.transform(F.split(text, r"[\r\n]+"), F.trim), lambda x: x.startswith("http"))
    return F.when(F.lower(text).contains("<loc>"), marked).when(sitemap_kind(text).isNotNull() & ~text.contains("<"), lines).otherwise(F.array().cast("array<string>"))


def sitemaps_of(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((site, state, url), (site, ord, url)): the state of the first sitemap tried that answers, by rank, and the URLs it lists."""
    from pyspark.sql import Window as W
    own = log.where("purpose = 'sitemap'").withColumn("text", text_of(F.col("body")))
    state = (F.when(F.col("challenge"), "challenge").when(F.col("error").isNotNull() | (F.col("status") >= 500), "unreachable").when(F.col("status") != 200, "missing")
             .when(sitemap_kind(F.col("text")).isNull(), "invalid").otherwise("ok"))
    tried = own.withColumn("n", F.row_number().over(W.partitionBy("site").orderBy(sitemap_rank(F.col("url")), "url"))).where(F.col("n") <= SITEMAP_TRIES).withColumn("state", state)
    best = tried.groupBy("site").agg(F.min_by(F.struct("state", "url", "text"), F.struct(F.col("state") != "ok", F.col("n"))).alias("s")).select("site", "s.*")
    return best.select("site", "state", "url"), best.where("state = 'ok'").select("site", F.posexplode(sitemap_locs(F.col("text"))).alias("ord", "url"))


def edge_probes_of(log: DataFrame, tiers: DataFrame) -> DataFrame:
    """(site, token, tier, status, error, bytes) of answers to other agents; the audit's own answer for the home page is the baseline."""
    token = F.try_element_at("headers", F.lit("x-probe-token"))
    own = log.where("purpose = 'edge'").withColumn("token", token).join(F.broadcast(tiers.select("token", "tier")), "token", "left")
    return own.select("site", "token", F.coalesce("tier", F.lit("baseline")).alias("tier"), "status", "error", "bytes")


def links_of(log: DataFrame) -> DataFrame:
    return log.where("purpose = 'link'").select("site", "url", "status", "error", "challenge", "skipped")


def read_snapshots(spark: SparkSession, path: str, base_url: str) -> DataFrame:
    """Saved pages, one file a role, as (site, url, role, page_ord, html)."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("role"), F.col("value").alias("html"))
    url = F.concat(F.lit(base_url.rstrip("/") + "/"), F.when(F.col("role") == "home", "").otherwise(F.col("role")))
    return files.select(host(url).alias("site"), url.alias("url"), "role", F.when(F.col("role") == "home", 0).otherwise(1).alias("page_ord"), "html")


#: The results that one probe leaves: its name and its checks.
RESULTS = "probe string, site string, checks array<struct<check_id:string,status:string,reason:string>>, _broken string"


def read_results(spark: SparkSession, path: str, order: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """((rank, probe, site, ord, check_id, status, reason), (file)): results of all probes, those in `order` first, and files that are no JSON."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    files = texts.select("file", F.from_json("value", RESULTS, {"columnNameOfCorruptRecord": "_broken"}).alias("r")).select("file", "r.*")
    place = F.array_position(F.array(*map(F.lit, order)).cast("array<string>"), F.col("probe"))
    rank = F.when(place > 0, place).otherwise(len(order) + 1)
    results = files.where("_broken IS NULL").select(rank.alias("rank"), "probe", "site", F.posexplode("checks").alias("ord", "c")).select("rank", "probe", "site", "ord", "c.*")
    return results, files.where("_broken IS NOT NULL").select("file")


def write_manifest(log: DataFrame, path: str) -> None:
    """A site's requests, in all and by purpose, as one object."""
    counts = log.groupBy("site", "purpose").agg(F.count(F.lit(1)).alias("n"))
    by_purpose = F.map_from_entries(F.array_sort(F.collect_list(F.struct("purpose", "n"))))
    counts.groupBy("site").agg(F.sum("n").alias("requests"), by_purpose.alias("by_purpose")).write.json(path)


def write_snapshots(log: DataFrame, path: str) -> None:
    """Bodies as they came, a folder for each purpose; read_fetch_log's columns site, url and body."""
    log.where("body IS NOT NULL").select("site", "url", "purpose", "body").write.partitionBy("purpose").parquet(path)


def write_by_site(rows: DataFrame, name: str, path: str) -> None:
    """Lookups, entities or engagement of a site: one object a row, its columns under `name`."""
    rows.select("site", F.struct(*[c for c in rows.columns if c != "site"]).alias(name)).write.json(path)


def write_report(reports: DataFrame, path: str) -> None:
    """One JSON object a line and site."""
    reports.select("json").write.text(path)


def write_facts(facts: DataFrame, path: str) -> None:
    """A site's facts as one object by fact."""
    rows = facts.groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fact_id", F.struct("required", "status", "value", "page", "source").alias("fact"))))).alias("facts"))
    rows.write.json(path)
