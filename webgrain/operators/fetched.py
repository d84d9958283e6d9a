"""What recorded requests add up to: where redirects lead, and which sitemap a site has.

Redirects are followed by joining urls with the table of recorded hops, one join for each step and no more steps than a fetcher would
take, so a loop ends as too many redirects. Sitemaps are tried in order within a budget of requests; an index costs one more for its
first child.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.functions.url import host, language_edition, registrable_domain, sitemap_rank
from webgrain.operators.recorded import decompressed
from webgrain.sources.readers import sitemap_kind, sitemap_locs

#: Statuses that redirect, steps that are followed, requests that looking for a sitemap may take.
REDIRECTS, MOST_HOPS, SITEMAP_REQUESTS = (301, 302, 303, 307, 308), 5, 2


def absolute(base: Column, location: Column) -> Column:
    """A redirect's target as a full url: full, without scheme, from the root, or beside the base."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    plain = F.trim(location)
    return (F.when(plain.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), plain).when(plain.startswith("//"), F.concat(scheme, F.lit(":"), plain)).when(plain.startswith("/"), F.concat(origin, plain))
            .when(plain.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), plain)).otherwise(F.concat(F.regexp_replace(folder, "([^/])$", "$1/"), plain)))


def final_answers(hops: DataFrame) -> DataFrame:
    """The answer of each url that counts: the first, or after 429 the second. hops: url, attempt (from 0), status, location."""
    firsts = hops.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("attempt", "status", "location"))).alias("a"))
    one, two = F.get("a", F.lit(0)), F.get("a", F.lit(1))
    chosen = F.when((one["status"] == 429) & two.isNotNull(), two).otherwise(one)
    return firsts.select("url", chosen["status"].alias("status"), chosen["location"].alias("location"), (one["status"] == 429).alias("retried"))


def redirect_chains(seeds: DataFrame, hops: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """seeds (url, ...) with final_url, status, chain (urls passed), hops, cross_domain, edition, retried and error.

    hops: final answers as recorded, see final_answers(). error: too_many_redirects, unsupported_scheme, or not_recorded where an answer is missing; status
    is then that of the last answer. edition: the language that the redirect led to without having been asked for.
    """
    answers = final_answers(hops).select(F.col("url").alias("_at"), F.col("status").alias("_status"), F.col("location").alias("_location"), F.col("retried").alias("_retried"))
    none = lambda kind: F.lit(None).cast(kind)
    moved = F.col("_status").isin(*REDIRECTS) & (F.coalesce("_location", F.lit("")) != "")
    rows = seeds.withColumns({"final_url": F.col("url"), "status": none("int"), "chain": F.array().cast("array<string>"), "cross_domain": F.lit(False), "error": none("string"), "retried": F.lit(False), "_open": F.lit(True)})
    for step in range(most + 1):
        met = rows.withColumn("_at", F.when(F.col("_open"), F.col("final_url"))).join(answers, "_at", "left")
        target = absolute(F.col("final_url"), F.col("_location"))
        follow = F.col("_open") & F.coalesce(moved, F.lit(False))
        odd = follow & ~F.lower(target).rlike("^https?://")
        ends = F.lit(step == most)
        rows = met.withColumns({
            "error": F.when(F.col("_open") & F.col("_status").isNull(), "not_recorded").when(follow & ends, "too_many_redirects").when(odd, "unsupported_scheme").otherwise(F.col("error")),
            "status": F.when(F.col("_open"), F.coalesce("_status", "status")).otherwise(F.col("status")), "retried": F.col("retried") | (F.col("_open") & F.coalesce("_retried", F.lit(False))),
            "chain": F.when(follow & ~ends, F.concat("chain", F.array("final_url"))).otherwise(F.col("chain")),
            "cross_domain": F.col("cross_domain") | (follow & ~ends & ~odd & (registrable_domain(host(target)) != registrable_domain(host(F.col("url"))))),
            "_next": F.when(follow & ~ends & ~odd, target).otherwise(F.col("final_url")), "_more": follow & ~ends & ~odd,
        }).drop("final_url", "_open", "_at", "_status", "_location", "_retried").withColumnsRenamed({"_next": "final_url", "_more": "_open"})
    before, after = language_edition(F.col("url")), language_edition(F.col("final_url"))
    edition = F.when(after.isNotNull() & ~after.eqNullSafe(before), after)
    return rows.withColumns({"hops": F.size("chain"), "edition": edition}).drop("_open")


def sitemap_candidates(sites: DataFrame) -> DataFrame:
    """(site, seq, url): sitemaps that robots rules name, site-wide ones first, else the two usual places. sites: site, origin, sitemaps (array, as listed)."""
    listed = F.filter(F.coalesce("sitemaps", F.array().cast("array<string>")), lambda u: F.lower(u).rlike("^https?://"))
    ranked = F.transform(F.array_sort(F.transform(listed, lambda u, i: F.struct(sitemap_rank(u).alias("rank"), i.alias("i"), u.alias("url")))), lambda x: x["url"])
    usual = F.array(*[F.concat("origin", F.lit(f"/{name}.xml")) for name in ("sitemap", "sitemap_index")])
    return sites.select("site", F.posexplode(F.when(F.size(listed) > 0, ranked).otherwise(usual)).alias("seq", "url"))


def sitemap_text(answers: DataFrame) -> Column:
    """The body as text; bytes are unpacked where they are a gzip file."""
    body = F.col("body")
    if dict(answers.dtypes)["body"] != "binary":
        return body
    return F.decode(decompressed(body, F.when(F.substring(body, 1, 2) == F.lit(b"\x1f\x8b"), "gzip")), "UTF-8")


def discover_sitemaps(sites: DataFrame, answers: DataFrame, budget: int = SITEMAP_REQUESTS) -> DataFrame:
    """(site, state, url, urls, child_url, tried): the sitemap of each site as a fetcher with that budget finds it.

    sites: as for sitemap_candidates(). answers: url, status, error, challenge, skipped, body (text, or bytes of a gzip file). state: ok, missing, invalid,
    unreachable, challenge. Candidates are asked in order until one ends the search: a challenge, a list of urls, an index. Of an index the first child
    is read if a request is left. A site has at most `budget` candidates that are asked, so its frontier is one bounded row.
    """
    text = sitemap_text(answers)
    read = answers.select("url", "status", "error", "challenge", "skipped", text.alias("text")).select("url", "status", "error", "challenge", "skipped", sitemap_kind(F.col("text")).alias("kind"), sitemap_locs(F.col("text")).alias("locs"))
    asked = sitemap_candidates(sites).where(F.col("seq") < budget).join(read, "url", "left")
    fine = (F.col("status") == 200) & F.col("skipped").isNull() & F.col("error").isNull() & ~F.coalesce("challenge", F.lit(False))
    state = (F.when(F.col("skipped").isNotNull(), "missing").when(F.coalesce("challenge", F.lit(False)), "challenge").when(F.col("error").isNotNull() | (F.col("status") >= 500), "unreachable")
             .when(fine & F.col("kind").isNull(), "invalid").when(fine, "ok"))
    judged = asked.withColumns({"state": state, "ends": F.coalesce(state.isin("challenge", "ok"), F.lit(False))})
    lists = judged.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("seq", "url", "state", "ends", "kind", "locs"))).alias("c"))
    last = F.coalesce(F.get(F.filter("c", lambda x: x["ends"]), F.lit(0))["seq"], F.element_at("c", -1)["seq"])
    seen = lists.withColumn("c", F.filter("c", lambda x: x["seq"] <= last))
    told = F.try_element_at(F.filter("c", lambda x: x["state"].isNotNull()), F.lit(-1))
    end = F.get(F.filter("c", lambda x: x["ends"] & (x["state"] == "ok")), F.lit(0))
    child = F.when((end["kind"] == "sitemapindex") & (F.size("c") < budget), F.get(end["locs"], F.lit(0)))
    rows = seen.select("site", told["state"].alias("state"), told["url"].alias("url"), F.when(end["kind"] == "urlset", end["locs"]).alias("urls"), child.alias("child_url"), F.transform("c", lambda x: x["url"]).alias("tried"))
    below = rows.join(read.select(F.col("url").alias("child_url"), F.struct("status", F.coalesce("challenge", F.lit(False)).alias("challenge"), "kind", "locs").alias("b")), "child_url", "left")
    opened = (F.col("b.status") == 200) & ~F.col("b.challenge")
    return below.select(
        "site", F.when(opened & ~F.col("b.kind").eqNullSafe(F.lit("urlset")), "invalid").otherwise(F.coalesce("state", F.lit("missing"))).alias("state"), "url",
        F.coalesce(F.when(opened & (F.col("b.kind") == "urlset"), F.col("b.locs")), "urls", F.array().cast("array<string>")).alias("urls"), "child_url",
        F.when(F.col("child_url").isNotNull(), F.concat("tried", F.array("child_url"))).otherwise(F.col("tried")).alias("tried"))
