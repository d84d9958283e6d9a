"""The whole audit of a crawl as one plan: pages and recorded answers in, graded findings and a report a site out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.functions import vocab as V
from webgrain.functions.dims import dim
from webgrain.functions.extend import REGISTERED
from webgrain.functions.text import detect_language
from webgrain.operators import checks, compose, facts, gates, grade, robots
from webgrain.operators import evidence as E
from webgrain.operators import report as words
from webgrain.sources.store import written


@dataclass
class Recorded:
    """What was recorded beside the pages. Anything absent leaves its checks not evaluated.

    robots: site, state, robots. sitemaps: site, state. edge_probes: site, token, tier, status, error, bytes. links: site, url, status, error,
    challenge, skipped. missing_pages: parsed answers to random paths. lookups: site, outcome. mentions: site, kind.
    """

    robots: DataFrame | None = None
    sitemaps: DataFrame | None = None
    edge_probes: DataFrame | None = None
    links: DataFrame | None = None
    missing_pages: DataFrame | None = None
    lookups: DataFrame | None = None
    mentions: DataFrame | None = None


@dataclass
class Audit:
    """The results: checks (one row for each site and check), findings (ranked), folded, facts, questions, summary, stages and coverage (of stages and of concepts)."""

    checks: DataFrame
    findings: DataFrame
    folded: DataFrame
    facts: DataFrame
    questions: DataFrame
    summary: DataFrame
    stages: DataFrame
    coverage: DataFrame


def run_checks(docs: DataFrame, sites: DataFrame, as_of: str, recorded: Recorded) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, facts, brands). docs: parsed pages with site, role, page_ord, url; sites: site, category."""
    day = F.lit(as_of).cast("date")
    pages = written(checks.prepare(docs, sites), "pages")
    usable = pages.where("excluded is null")
    detected = written(facts.detect(usable), "detected")
    resolved, brands = facts.resolve(detected, sites), facts.brand(usable, detected)
    parts = [checks.grade_pages(pages, day).withColumn("detail", F.lit(None).cast("string")), checks.fact_check(resolved), checks.name_checks(pages, brands),
             checks.trust_checks(pages, detected), checks.offsite_checks(sites, recorded.mentions)]
    if recorded.robots is not None:
        agents, rules, _ = robots.parse_robots(recorded.robots.where("state = 'ok'"))
        keys = pages.where(F.col("is_key") & (F.col("role") != "home")).select("site", checks.path(F.col("final_url")).alias("path")).where("path <> ''").distinct()
        own = recorded.robots.where("state <> 'unreachable'").select("site")
        grades = robots.grade_tokens(agents, rules, own, dim(docs.sparkSession, "bot_tier"), keys.join(own, "site"))
        star = robots.decide(agents, rules, own.select("site", F.lit("some-other-crawler").alias("token"), F.lit("/").alias("path")))
        parts.append(checks.robots_checks(grades, recorded.robots, star.select("site", "allowed")))
    for table, judge in ((recorded.sitemaps, checks.sitemap_checks), (recorded.edge_probes, checks.edge_checks), (recorded.links, checks.link_checks),
                         (recorded.missing_pages, checks.missing_page_checks), (recorded.lookups, checks.entity_checks)):
        if table is not None:
            parts.append(judge(table))
    parts += [f(pages, sites).select(parts[0].columns) for f in REGISTERED.probes.values()]
    results = parts[0]
    for part in parts[1:]:
        results = results.unionByName(part)
    results = checks.split_refusals(results, pages, recorded.edge_probes)
    return checks.apply_category(grade.never_run(results, sites), sites), resolved, brands


def simulation_check(questions: DataFrame, readable: DataFrame) -> DataFrame:
    """Whether every question that is not merely informational can be answered from the facts: a note where one cannot, open where no page was readable. readable: site."""
    asked = questions.where("not informational").groupBy("site").agg(F.array_sort(F.collect_list(F.when(~F.col("answerable"), F.struct("ord", "question", "missing")))).alias("open"))
    rows = asked.join(readable.select("site", F.lit(True).alias("read")).distinct(), "site", "left")
    some, blind = F.size("open") > 0, F.col("read").isNull()
    told = F.transform("open", lambda q: E.item("computed", F.concat(F.lit("question="), q["question"], F.lit("; missing_facts="), F.array_join(q["missing"], ",")), page="site"))
    none = E.items(E.item("computed", "pages_used=0", page="site"))
    return checks._rows(rows, "or.simulation.question_unanswerable", F.when(some & blind, "not_evaluated").when(some, "fail").otherwise("pass"), F.when(some & blind, "no_readable_pages"),
                        F.when(some & blind, "told"), F.when(blind, none).otherwise(told))


def sampled(docs: DataFrame) -> DataFrame:
    """(site, links, missing_roles, roles, home_url, html_urls, sampled_pages, pages): what the sample of a site's pages holds, one row a site."""
    have = set(docs.columns)
    served = (F.coalesce(F.col("status"), F.lit(200)) == 200 if "status" in have else F.lit(True)) & (~F.coalesce("challenge", F.lit(False)) if "challenge" in have else F.lit(True)) & (
        F.coalesce("is_html", F.lit(True)) if "is_html" in have else F.lit(True))
    address, home = F.col("final_url") if "final_url" in have else F.col("url"), F.col("role") == "home"
    inner = F.size(F.array_distinct(F.transform(F.filter("links", lambda x: x["internal"]), lambda x: x["url"])))
    roles = F.array(*map(F.lit, V.ROLE_ORDER))
    return docs.groupBy("site").agg(
        F.max(F.when(home, inner)).alias("links"), F.array_except(roles, F.collect_set("role")).alias("missing_roles"), F.collect_set("role").alias("roles"), F.max(F.when(home, address)).alias("home_url"),
        F.collect_set(F.when(served, address)).alias("html_urls"), F.count_distinct("url").cast("int").alias("sampled_pages"), F.count_if(served).alias("pages"))


def gate_sample(results: DataFrame, docs: DataFrame, sample: DataFrame) -> DataFrame:
    """results after the gates of language, of chrome that scripts fill in, and of a sample too thin to tell."""
    stopwords = dim(docs.sparkSession, "stopword")
    detected = detect_language(docs, "page_id", "body_text", stopwords).withColumnRenamed("lang", "detected")
    declared = docs.select("site", "page_id", "page_ord", F.nullif(F.lower(F.substring_index(F.trim("lang"), "-", 1)), F.lit("")).alias("declared"))
    homes = docs.where("role = 'home'").groupBy("site").agg(F.max(F.size("empty_chrome")).alias("empty_chrome"), F.max("nav_count").alias("nav_count"), F.max(F.size("external_scripts")).alias("external_scripts"))
    out = gates.language_gate(results, gates.sample_language(declared.join(detected, "page_id", "left")))
    return gates.press_gate(gates.chrome_gate(out, homes), sample.select("site", "links", "missing_roles"))


def grade_results(results: DataFrame, docs: DataFrame, sites: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results of all checks, findings, folded)."""
    spark = docs.sparkSession
    sample = written(sampled(docs), "sample")
    gated = grade.absence_gate(gate_sample(results, docs, sample), dim(spark, "key_page"), docs.select("site", "role"))
    expected = F.broadcast(dim(spark, "key_page").where("role <> 'home'").select("category", "role"))
    unread = sample.select("site", F.explode("missing_roles").alias("role")).join(sites.select("site", "category"), "site").join(expected, ["category", "role"])
    gated = written(gates.scope_facts(gated, gates.fact_gate(resolved, unread)), "gated")
    counts = sample.select("site", "sampled_pages", "home_url", "html_urls")
    graded = grade.adjust_severity(gated.where("status = 'fail'").join(counts, "site"))
    first = F.coalesce(F.get("pages", F.lit(0)), F.lit("site"))
    adjusted = F.when(F.size("adjustments") > 0, E.items(E.item("computed", F.concat(F.lit("adjustments="), F.array_join("adjustments", ",")), page=first))).otherwise(E.none())
    real = ~F.col("severity").isin("low", "info")
    polish = (F.col("check_id") == "fx.jsonld.required_props_missing") & F.forall("evidence", lambda e: ~e["value"].contains("missing="))  # its nodes name themselves
    lone = (F.col("check_id") == "fx.facts.key_fact_missing") & (F.size(F.split("detail", ",")) == 1) & F.col("severity").isin("critical", "high")
    part = (F.col("absence_scope") == "sample") & (F.col("check_id") != "fx.facts.key_fact_missing") & F.col("severity").isin("critical", "high")
    every = (F.col("check_id") == "cr.robots.live_answer_bot_blocked") & F.exists("evidence", lambda e: e["value"].startswith("blocked=all of "))
    graded = graded.withColumns({"severity": F.when(every, "critical").when((F.col("capped") | polish) & real, "low").when(lone | part, "medium").otherwise(F.col("severity")),
                                 "evidence": F.concat("evidence", adjusted)})
    both = graded.unionByName(grade.informational(gated.join(counts, "site")), allowMissingColumns=True)
    kept, folded = grade.fold(written(both, "graded"))
    findings = E.describe(grade.tag(grade.rank_findings(grade.derive(kept))))
    filled = grade.fill_unreported(gated.select("site", "check_id", "status", "reason", "pages").dropDuplicates(["site", "check_id"]), sites)
    return filled, findings, folded


def audit(docs: DataFrame, sites: DataFrame, as_of: str, recorded: Recorded | None = None) -> Audit:
    """docs: parse_pages() with role and page_ord, best read from a written table; sites: site, category and, where someone knows better, category_override; as_of: the day that counts as today.

    Checks, detectors, facts and probes of functions.extend take part.
    """
    if "category_override" in sites.columns:
        sites = sites.withColumn("category", F.coalesce("category_override", "category")).drop("category_override")
    results, resolved, brands = run_checks(docs, sites, as_of, recorded or Recorded())
    asked = grade.simulate(sites.join(brands.select("site", "brand"), "site", "left").fillna({"brand": "the site"}), resolved)
    questions = written(asked.join(words.answers(asked, resolved), ["site", "ord"], "left"), "questions")
    readable = docs.where("word_count > 0").select("site")
    results = results.unionByName(checks.apply_category(simulation_check(questions, readable), sites))
    every, findings, folded = grade_results(written(results, "results"), docs, sites, resolved)
    every, findings = written(every, "checks"), written(findings, "findings")
    stages = words.stage_coverage(every)
    return Audit(every, findings, folded, resolved, questions, grade.summary(findings, every), stages, words.concept_coverage(stages))


def prose(result: Audit, docs: DataFrame, sites: DataFrame) -> list[DataFrame]:
    """Recommendations, limitations and narrative, one row a site each. docs and sites as for audit()."""
    refused = F.count_if(F.col("status") == 429) if "status" in docs.columns else F.lit(0)
    challenged = result.checks.where("check_id = 'cr.access.challenge_page' and status = 'inconclusive'").select("site", F.greatest(F.size("pages"), F.lit(0)).alias("challenged"))
    read = docs.groupBy("site").agg(F.count_distinct("url").alias("pages"), F.collect_set("role").alias("roles"), refused.alias("limited"))
    read = read.join(challenged, "site", "left").fillna({"challenged": 0}).withColumn("edition", F.lit(None).cast("string"))
    listed = lambda rows, *columns: F.transform(F.array_sort(F.collect_list(F.struct("ord", *columns))), rows)
    advice = compose.recommend(compose.advice_states(sites, result.checks, result.findings, result.facts, docs))
    first = grade.start_with(result.findings).join(result.findings.select("site", "check_id", "id", "title"), ["site", "check_id"]).select("site", "id", "title")
    return [advice.groupBy("site").agg(listed(lambda r: r.dropFields("ord"), "name", "title", "priority", "effort", "stage").alias("recommendations")),
            compose.limitations(read, result.checks).groupBy("site").agg(listed(lambda r: r["line"], "line").alias("limitations")), compose.narrative(result.summary, read, first)]


def report(result: Audit, docs: DataFrame | None = None, sites: DataFrame | None = None) -> DataFrame:
    """One row a site: the report as a struct column and as JSON; with docs and sites also recommendations, limitations and narrative."""
    found = result.findings.groupBy("site").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "id", "check_id", "title", "status", "severity", "confidence", "effort", "impact", "priority", F.col("stage").alias("mechanism"), "pages", "evidence_text", "evidence", "why_it_matters", "suggested_action",
        "mode", "concepts", "pipeline", "opportunity_type", "quick_win", "dedupe_key", F.coalesce("absence_scope", F.lit("site")).alias("absence_scope")))).alias("findings"))
    asked = result.questions.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("ord", "question", "informational", "answerable", "answer", "missing"))).alias("questions"))
    first = grade.start_with(result.findings).join(result.findings.select("site", "check_id", "id", "title"), ["site", "check_id"])
    letters = result.coverage.groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("letter", "state")))).alias("coverage"))
    stages = result.stages.groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "state")))).alias("stages"))
    passed = result.checks.where("status = 'pass'").join(F.broadcast(dim(result.checks.sparkSession, "positive_title")), "check_id").join(
        F.broadcast(dim(result.checks.sparkSession, "check_registry").select("check_id", "stage")), "check_id").groupBy("site").agg(F.array_sort(F.collect_list(F.struct("stage", "title", "check_id"))).alias("working"))
    open_ = result.checks.where(F.col("status").isin("not_evaluated", "inconclusive")).select("site", "check_id", F.coalesce("reason", "status").alias("reason"))
    off = F.col("reason") == "not_applicable_for_category"
    gaps = open_.groupBy("site").agg(F.array_sort(F.collect_list(F.when(~off, F.struct("check_id", "reason")))).alias("no_verdict"), F.array_sort(F.collect_list(F.when(off, F.col("check_id")))).alias("not_applicable"))
    merged = result.folded.join(result.findings.select("site", F.col("check_id").alias("folded_into"), "id"), ["site", "folded_into"], "left").groupBy("site").agg(
        F.array_sort(F.collect_list(F.struct("check_id", F.col("id").alias("merged_into"), "fold_row"))).alias("folded"))
    none = "site string, roles array<string>, missing_roles array<string>, pages bigint, requests bigint"
    sample = result.summary.sparkSession.createDataFrame([], none) if docs is None else sampled(docs).select("site", F.array_sort("roles").alias("roles"), "missing_roles", "pages", F.lit(None).cast("bigint").alias("requests"))
    rows = result.summary
    for part in (found, asked, first.select("site", F.col("id").alias("start_with")), letters, stages, passed, gaps, merged,
                 words.headline(result.summary, sample.select("site", "pages"), first.select("site", "id", "title"), result.checks),
                 words.coverage_statement(result.stages, result.coverage, result.checks, sample.drop("pages")), *(prose(result, docs, sites) if docs is not None else ())):
        rows = rows.join(part, "site", "left")
    body = F.struct(*[c for c in rows.columns if c != "site"])
    return rows.select("site", body.alias("report"), F.to_json(body).alias("json"))
