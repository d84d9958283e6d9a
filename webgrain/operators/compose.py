"""What a report says beside its findings: opportunities, the limits of what was read, and a summary in sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.operators.report import plural

#: Opportunities: name, title, priority, effort, stage, checks whose failure says the same.
RECOMMENDATIONS = [
    ("faq_markup", "Mark the existing questions up as FAQPage structured data", "medium", "low", "extract", ("fx.jsonld.missing", "fx.jsonld.malformed")),
    ("difference", "State in one sentence what sets this brand apart", "medium", "low", "extract", ()),
    ("number", "State at least one concrete number in the site's own words", "medium", "low", "extract", ()),
    ("audience", "Name the audience explicitly on the home page", "medium", "low", "extract", ("fx.facts.key_fact_missing",)),
    ("properties", "Add the recommended properties to the existing structured data", "medium", "low", "extract", ("fx.jsonld.missing", "fx.jsonld.malformed", "fx.jsonld.required_props_missing")),
    ("product_markup", "Add Product and Offer structured data to product pages", "medium", "medium", "extract", ("fx.jsonld.missing",)),
    ("local_markup", "Add LocalBusiness structured data with address, telephone and opening hours", "high", "low", "entity", ("fx.jsonld.missing", "ef.entity.nap_missing_plain_text")),
    ("hours_markup", "Repeat the opening hours as openingHoursSpecification", "medium", "low", "entity", ("fx.jsonld.missing",)),
    ("article_markup", "Publish article dates and bylines as Article structured data", "medium", "medium", "freshness", ("fx.jsonld.missing",)),
    ("price_range", "Publish an indicative price or price range alongside the sales-led pricing", "medium", "medium", "extract", ("fx.facts.key_fact_missing",)),
    ("milestones", "Publish datable milestones on the news surface others can cite", "low", "medium", "corroboration", ("ef.corroboration.press_page_missing",)),
    ("profiles", "Keep the sameAs list current as new authoritative profiles appear", "low", "low", "entity", ()),
    ("deep_pages", "Make every deep page self-contained", "medium", "medium", "engagement", ("en.continuity.h1_title_mismatch", "en.nav.breadcrumbs_missing")),
    ("summary_file", "Consider publishing a plain-text summary of the site at /llms.txt", "low", "low", "extract", ()),
]
MOST_RECOMMENDATIONS = 8
LOCAL_TYPES = ("LocalBusiness", "Restaurant", "Store", "ProfessionalService")
ARTICLE_TYPES = ("Article", "BlogPosting", "NewsArticle")
DEEP_CATEGORIES = ("publisher_media", "ecommerce", "saas_software", "corporate_enterprise")
ADVICE_TYPES = ("FAQPage", "Product", *LOCAL_TYPES, *ARTICLE_TYPES)
ADVICE_FACTS = ("differentiator", "audience", "opening_hours")


def recommend(states: DataFrame, most: int = MOST_RECOMMENDATIONS) -> DataFrame:
    """(site, ord, name, title, priority, effort, stage): opportunities of a site that none of its failures states already, `most` at most, by priority and title.

    states, one row a site: category, passed and failed (arrays of check ids), types (of structured data), gaps (recommended properties
    that are missing, or null), sales_led, facts (map of fact id to status, value, source; empty or null where none was looked for).
    """
    has = lambda column, *values: F.coalesce(F.arrays_overlap(F.col(column), F.array(*map(F.lit, values))), F.lit(False))
    fact = lambda name, field: F.try_element_at(F.col("facts"), F.lit(name))[field]
    present = lambda name: F.coalesce(fact(name, "status") == "present", F.lit(False))
    marked, looked = has("passed", "fx.jsonld.missing"), F.coalesce(F.size("facts") > 0, F.lit(False))
    category = lambda *names: F.coalesce(F.col("category").isin(*names), F.lit(False))
    applies = {
        "faq_markup": has("passed", "fx.content.faq_absent") & ~has("types", "FAQPage"),
        "difference": looked & ~present("differentiator"),
        "number": present("differentiator") & ~F.coalesce(fact("differentiator", "value"), F.lit("")).rlike(r"\d"),
        "audience": looked & ~present("audience"),
        "properties": marked & F.col("gaps").isNotNull(),
        "product_markup": category("ecommerce") & marked & ~has("types", "Product"),
        "local_markup": category("local_business") & marked & ~has("types", *LOCAL_TYPES),
        "hours_markup": category("local_business") & present("opening_hours") & ~F.coalesce(fact("opening_hours", "source"), F.lit("")).contains("jsonld"),
        "article_markup": category("publisher_media", "corporate_enterprise") & has("passed", "ef.freshness.no_visible_dates") & ~has("types", *ARTICLE_TYPES),
        "price_range": category("saas_software") & F.coalesce("sales_led", F.lit(False)),
        "milestones": has("passed", "ef.corroboration.press_page_missing"),
        "profiles": has("passed", "ef.entity.sameas_missing") & has("passed", "ef.entity.sameas_no_authority"),
        "deep_pages": category(*DEEP_CATEGORIES),
        "summary_file": F.lit(True),
    }
    order = {"high": 0, "medium": 1, "low": 2}
    open_ = [F.when(applies[name] & ~(has("failed", *blocked) if blocked else F.lit(False)), F.struct(
        F.lit(order[priority]).alias("k"), F.lit(title).alias("title"), F.lit(name).alias("name"), F.lit(priority).alias("priority"), F.lit(effort).alias("effort"), F.lit(stage).alias("stage")))
        for name, title, priority, effort, stage, blocked in RECOMMENDATIONS]
    kept = F.slice(F.array_sort(F.filter(F.array(*open_), lambda r: r.isNotNull())), 1, most)
    return states.select("site", F.posexplode(kept).alias("n", "r")).select("site", (F.col("n") + 1).alias("ord"), "r.name", "r.title", "r.priority", "r.effort", "r.stage")


def advice_states(sites: DataFrame, results: DataFrame, findings: DataFrame, facts: DataFrame, docs: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """The states that recommend() takes. sites: site, category. facts: resolved facts. gaps: site, type, missing (recommended properties).

    Every array and map has a bounded number of entries: checks of the registry, types and facts that the rules name, three gaps.
    """
    passed = results.where("status = 'pass'").groupBy("site").agg(F.collect_set("check_id").alias("passed"))
    failed = findings.where("severity <> 'info'").groupBy("site").agg(F.collect_set("check_id").alias("failed"))
    types = docs.select("site", F.explode(F.flatten(F.transform("nodes", lambda n: n["types"]))).alias("type")).where(F.col("type").isin(*ADVICE_TYPES)).groupBy("site").agg(F.collect_set("type").alias("types"))
    kept = facts.where(F.col("fact_id").isin(*ADVICE_FACTS)).groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("fact_id", F.struct("status", "value", "source")))).alias("facts"))
    pricing = facts.where("fact_id = 'pricing_or_trial' and status = 'present'").groupBy("site").agg(F.bool_or(F.lower("value").rlike("contact|quote|demo|sales")).alias("sales_led"))
    rows = sites.select("site", "category")
    if gaps is not None:
        thin = gaps.groupBy("site").agg(F.array_join(F.slice(F.array_sort(F.collect_list(F.concat("type", F.lit(": "), F.array_join(F.slice("missing", 1, 4), ", ")))), 1, 3), "; ").alias("gaps"))
        rows = rows.join(thin, "site", "left")
    else:
        rows = rows.withColumn("gaps", F.lit(None).cast("string"))
    for part in (passed, failed, types, kept, pricing):
        rows = rows.join(part, "site", "left")
    return rows


# ---- limits ---------------------------------------------------------------------------------

#: How the first line begins and what one of the others says, as validation demands.
POINT_IN_TIME, SERVED_ONLY = "This report reflects a single point-in-time fetch", "This audit reads served HTML only and does not execute JavaScript or query live assistants."
REASON_LINES = {
    "role_page_not_sampled": "Not checked, as no page that would tell was reached: ",
    "thin_sample": "Left open, as the navigation could not be read: ",
    "chrome_not_rendered": "Left open, as header and footer are filled in by scripts: ",
    "language_not_supported": "Left open, as the phrases behind them are English and the pages are not: ",
}


def limitations(read: DataFrame, results: DataFrame) -> DataFrame:
    """(site, ord, line): what a report cannot tell, in the order in which it says so.

    read, one row a site: pages, roles, edition (language edition that the home page led to, or null), limited and challenged (pages refused as
    too many requests, or answered by a challenge). results: site, check_id, status, reason. Every site has the first and the last line.
    """
    by_reason = results.where(F.col("status").isin("not_evaluated", "inconclusive") & F.col("reason").isin(*REASON_LINES)).groupBy("site").agg(
        *[F.array_join(F.array_sort(F.collect_set(F.when(F.col("reason") == reason, F.col("check_id")))), ", ").alias(reason) for reason in REASON_LINES])
    skipped = lambda n, why: F.when(F.col(n) > 0, F.concat(plural(F.col(n), "page"), F.lit(why)))
    lines = [
        F.concat(F.lit(POINT_IN_TIME + " of "), plural(F.col("pages"), "sampled page"), F.lit("; pages that differ from visit to visit may differ between runs.")),
        F.when((F.size("roles") > 0) & (F.size(F.array_except("roles", F.array(F.lit("home")))) == 0), F.lit("No page but the home page was read, so every finding rests on it alone.")),
        F.when(F.col("edition").isNotNull(), F.concat(F.lit("The home page led to the edition in "), F.col("edition"), F.lit(", which the findings describe."))),
        *[F.when(F.col(reason) != "", F.concat(F.lit(begin), F.col(reason), F.lit("."))) for reason, begin in REASON_LINES.items()],
        skipped("limited", " skipped: too many requests."), skipped("challenged", " answered by a challenge, so their checks are open."), F.lit(SERVED_ONLY)]
    said = F.filter(F.array(*lines), lambda x: x.isNotNull())
    return read.join(by_reason, "site", "left").select("site", F.posexplode(said).alias("n", "line")).select("site", (F.col("n") + 1).alias("ord"), "line")


def narrative(summary: DataFrame, pages: DataFrame, start: DataFrame) -> DataFrame:
    """(site, narrative): four to five sentences from a run's own numbers. summary: as of grade.summary(); pages: site, pages; start: site, id, title of the finding to begin with."""
    named = F.array_join(F.filter(F.array(*[F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in ("critical", "high", "medium", "low")]), lambda x: x.isNotNull()), ", ")
    ran = F.col("pass") + F.col("fail") + F.col("inconclusive") + F.col("not_evaluated")
    sentences = F.array(
        F.concat(F.lit("This audit read "), plural(F.coalesce("pages", F.lit(0)), "page"), F.lit(" and ran "), plural(ran, "check"), F.lit(" on what a fetcher without scripts receives.")),
        F.when(named != "", F.concat(F.lit("It raised "), named, F.lit("."))).otherwise(F.lit("It raised nothing above informational.")),
        F.when(F.col("id").isNotNull(), F.concat(F.lit("Start with "), F.col("id"), F.coalesce(F.concat(F.lit(": "), F.rtrim(F.col("title"), F.lit("."))), F.lit("")), F.lit("."))),
        F.concat(plural(F.col("pass"), "check"), F.lit(" passed.")),
        F.when(F.col("not_evaluated") > 0, F.concat(plural(F.col("not_evaluated"), "check"), F.lit(" had no verdict; those are gaps of the sample and no faults of the site."))))
    return summary.join(pages.select("site", "pages"), "site", "left").join(start.select("site", "id", "title"), "site", "left").select(
        "site", F.array_join(F.filter(sentences, lambda x: x.isNotNull()), " ").alias("narrative"))
