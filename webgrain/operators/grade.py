"""Grading: registry defaults adjusted by rule, gaps filled, findings folded, ranked and summed up."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webgrain.functions import vocab as V
from webgrain.functions.dims import confidence_rank, dim, severity_name, severity_rank
from webgrain.functions.text import clip_title, usable_value
from webgrain.operators.evidence import EVIDENCE

LOW, MEDIUM = 3, 2


def impact(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "high").when(severity == "medium", "medium").otherwise("low")


def priority(severity: Column, confidence: Column) -> Column:
    own = impact(severity)
    return F.when((confidence == "low") & (own == "high"), "medium").when((confidence == "low") & (own == "medium"), "low").otherwise(own)


def placed(fails: DataFrame) -> DataFrame:
    """fails (category, roles, sampled_pages) with what the pages hit say: hit, on_key, on_home, wide. Worked out before checks are joined, it is once a site."""
    keys = F.broadcast(dim(fails.sparkSession, "key_page").groupBy("category").agg(F.collect_set("role").alias("keys")))
    roles, hit = F.coalesce("roles", F.array().cast("array<string>")), F.size("roles") > 0
    known = F.coalesce("keys", F.array(F.lit("home"), F.lit("about"), F.lit("contact")))
    wide = hit & (F.col("sampled_pages") >= 3) & (F.size(F.array_distinct(roles)) >= F.col("sampled_pages"))
    rows = fails.join(keys, "category", "left")
    return rows.withColumns({"hit": hit, "on_key": F.arrays_overlap(roles, known), "on_home": F.array_contains(roles, "home"), "wide": wide}).drop("keys")


def adjust_severity(fails: DataFrame) -> DataFrame:
    """fails: site, check_id, category, roles, sampled_pages, confidence (null: the registry's). Adds the registry's columns, severity and adjustments.

    In this order: the category's override; one level down on pages that are no key pages, critical on home where the check can be;
    one level up when every one of three pages or more is hit; medium at most with low confidence; the largest severity last.
    What placed() adds is added here unless fails has it.
    """
    spark = fails.sparkSession
    # what a check alone decides is worked out over the registry, not over the rows; a check of policy is no defect and stays informational
    registry = dim(spark, "check_registry").withColumns({
        "start": severity_rank(F.col("severity")), "most": severity_rank(F.col("max_severity")), "policy": F.col("severity") == "info",
        "may": (F.col("max_severity") == "critical") & F.col("severity").isin("high", "critical")}).withColumnRenamed("confidence", "usual").drop("severity")
    override = dim(spark, "severity_override").where("severity <> 'not_evaluated'").select("check_id", "category", F.col("severity").alias("override"), severity_rank(F.col("severity")).alias("moved"))
    rows = fails.join(F.broadcast(registry), "check_id").join(F.broadcast(override), ["check_id", "category"], "left")
    rows = rows if "on_key" in fails.columns else placed(rows)
    rows = rows.withColumn("confidence", F.coalesce("confidence", "usual"))
    start, most, to_critical, lowered = F.coalesce("moved", "start"), F.col("most"), F.col("hit") & F.col("on_key") & F.col("on_home") & F.col("may"), F.col("hit") & ~F.col("on_key")
    rows = rows.withColumn("s2", F.when(to_critical, 0).when(lowered, F.least(start + 1, F.lit(LOW))).otherwise(start))
    rows = rows.withColumn("s3", F.when(F.col("wide"), F.greatest(F.col("s2") - 1, F.lit(0), most)).otherwise(F.col("s2")))
    capped = (F.col("confidence") == "low") & (F.col("s3") < MEDIUM)
    rows = rows.withColumn("s5", F.greatest(F.when(capped, F.lit(MEDIUM)).otherwise(F.col("s3")), most))
    said = F.filter(F.array(
        F.when(F.col("override").isNotNull(), F.concat(F.lit("category_override:"), F.col("override"))), F.when(to_critical, F.lit("home_page:critical")),
        F.when(lowered, F.lit("non_key_pages:-1")), F.when(F.col("wide") & (F.col("s3") != F.col("s2")), F.lit("blast_radius:+1")),
        F.when(capped, F.lit("confidence_cap:medium"))), lambda x: x.isNotNull())
    return rows.withColumns({"severity": F.when(F.col("policy"), "info").otherwise(severity_name(F.col("s5"))), "adjustments": F.when(F.col("policy"), F.array().cast("array<string>")).otherwise(said)}).drop(
        "s2", "s3", "s5", "override", "moved", "start", "most", "policy", "may", "usual", "hit", "on_key", "on_home", "wide")


def derive(findings: DataFrame) -> DataFrame:
    """Impact and priority of findings; an informational one is of low impact and priority, and of no effort."""
    if "effort" in findings.columns:
        findings = findings.withColumn("effort", F.when(F.col("severity") == "info", "n/a").otherwise(F.col("effort")))
    return findings.withColumns({"impact": impact(F.col("severity")), "priority": priority(F.col("severity"), F.col("confidence"))})


def latest(results: DataFrame, seq: str = "seq") -> DataFrame:
    """The last result of each site and check."""
    rest = [c for c in results.columns if c not in ("site", "check_id", seq)]
    return results.groupBy("site", "check_id").agg(F.max_by(F.struct(*rest), seq).alias("r")).select("site", "check_id", "r.*")


#: Which recorded answers judge which checks (beginnings of check ids).
RECORDED_CHECKS = {"robots": ("cr.robots.",), "sitemaps": ("cr.index.sitemap_",), "edge_probes": ("cr.access.edge_", "cr.access.ua_"), "links": ("en.links.",),
                   "missing_pages": ("en.errors.",), "lookups": ("ef.entity.wikidata_",)}


def never_run(results: DataFrame, sites: DataFrame) -> DataFrame:
    """results with a row, not evaluated, for each check whose answers were not recorded for a site; a check of a probe that ran stays as it is."""
    probes = [(r[0], probe) for r in V.CHECKS for probe, begins in RECORDED_CHECKS.items() if r[0].startswith(begins)]
    needed = results.sparkSession.createDataFrame(probes, "check_id string, probe string")
    asked = sites.select("site").crossJoin(F.broadcast(needed))
    ran = results.join(F.broadcast(needed), "check_id").select("site", "probe").distinct()
    null = {c: F.lit(None).cast(t) for c, t in results.dtypes if c not in ("site", "check_id", "status", "reason")}
    rows = asked.join(ran, ["site", "probe"], "left_anti").select("site", "check_id", F.lit("not_evaluated").alias("status"), F.lit("not_recorded").alias("reason"))
    return results.unionByName(rows.withColumns(null)) if null else results.unionByName(rows)


def informational(results: DataFrame) -> DataFrame:
    """Results that were left open and are worth telling, as findings: of informational severity, of no effort, with the registry's confidence.

    Told are inconclusive results, lookups that could not run, and questions that nothing could answer as no page was readable.
    """
    registry = F.broadcast(dim(results.sparkSession, "check_registry").select("check_id", "stage", "max_severity", F.col("confidence").alias("usual"), "scope"))
    told = (F.col("status") == "inconclusive") | ((F.col("status") == "not_evaluated") & (F.coalesce("detail", F.lit("")) == "told"))
    rows = results.where(told).join(registry, "check_id").withColumn("effort", F.lit("n/a"))
    return rows.withColumns({"severity": F.lit("info"), "confidence": F.coalesce("confidence", "usual"), "adjustments": F.array().cast("array<string>")}).drop("usual")


def fill_unreported(results: DataFrame, sites: DataFrame, prefix: str = "") -> DataFrame:
    """Every check of the registry for every site; what was not reported has passed."""
    registry = F.broadcast(dim(results.sparkSession, "check_registry").where(F.col("check_id").startswith(prefix)).select("check_id"))
    return sites.select("site").join(registry).join(results, ["site", "check_id"], "left").withColumn("status", F.coalesce("status", F.lit("pass")))


# ---- folding --------------------------------------------------------------------------------

#: Findings that describe one defect: row, primaries, victims (beginnings of ids; "": all), how the two must relate, what the primary notes.
FOLDS = [
    (1, ("cr.access.challenge_page",), ("",), "within", "downstream checks on this page are inconclusive"),
    (2, ("cr.robots.blanket_disallow",), tuple(V.ROBOTS_TIER_NAMES), "any", "affected tiers: "),
    (3, ("cr.access.non_html_seed",), ("",), "home", "home is not an HTML document"),
    (4, ("cr.render.js_gate", "cr.render.csr_shell"), tuple(V.RENDER_SUPPRESSES), "within", "root cause: content is not present in the server response"),
    (5, ("cr.render.js_gate", "cr.render.csr_shell"), ("fx.facts.key_fact_missing",), "unread", "facts cannot be extracted because pages are not rendered server-side"),
    (6, ("fx.jsonld.missing",), ("ef.entity.sameas_missing", "fx.jsonld.no_organization"), "any", "adding Organization JSON-LD with sameAs resolves the folded findings"),
    (6, ("fx.jsonld.missing",), ("ef.entity.name_inconsistent",), "structured", "adding Organization JSON-LD with sameAs resolves the folded findings"),
    (7, ("fx.jsonld.malformed",), ("fx.jsonld.required_props_missing",), "blocks", ""),
    (8, ("ef.entity.nap_missing_plain_text",), ("fx.facts.key_fact_missing",), "nap", "also a category key fact"),
    (9, ("en.links.blocked_cluster",), ("en.links.broken_sampled",), "refused", "reclassified: fetcher blocked, not broken"),
    (10, ("fx.identity.h1_missing_or_multiple",), ("en.continuity.h1_title_mismatch",), "bare", "continuity not evaluable without an H1"),
    (10, ("fx.identity.h1_missing_or_multiple",), ("en.hero.value_prop_unclear",), "headless", "continuity not evaluable without an H1"),
    (11, ("cr.index.sitemap_missing",), ("cr.index.sitemap_invalid",), "any", ""),
    (12, ("ef.entity.wikidata_unavailable",), ("ef.entity.wikidata_ambiguous", "ef.entity.wikidata_not_found"), "any", ""),
]

_STATUS_SEEN = re.compile(r"->\s*(\d{3})")


class SiteFindings:
    """What is left of one site's findings while the rows of FOLDS apply, with what their evidence says."""

    def __init__(self, findings: list[dict]):
        self.live = {f["check_id"]: dict(f, pages=set(f["pages"] or ()), evidence=list(f["evidence"] or ()), notes=[]) for f in findings}
        self.home = next((f["home_url"] for f in findings if f["home_url"]), None)
        self.read = {u for f in findings for u in f["html_urls"] or ()}
        self.category = next((f["category"] for f in findings if f["category"]), None)
        self.gated: set[str] = set()

    def begin(self, row: int) -> None:
        if row == 4:  # both render findings together, before either folds anything
            self.gated = {u for c in ("cr.render.js_gate", "cr.render.csr_shell") if c in self.live for u in self.live[c]["pages"]}

    def computed(self, f: dict, needle: str) -> str:
        return next((e["value"] for e in f["evidence"] if e["kind"] == "computed" and needle in (e["value"] or "")), "")

    def related(self, relation: str, victim: dict, primary: dict) -> bool:
        pages = victim["pages"]
        if relation in ("bare", "headless"):
            absent = {e["page"] for e in primary["evidence"] if e["kind"] == "computed" and re.search(r"\bh1_count=0\b", e["value"] or "")}
            signs = self.computed(victim, "signals=")
            return bool(pages) and pages <= absent and (relation == "bare" or "h1_missing" in signs or "h1_empty" in signs)
        if relation == "unread":
            return bool(self.gated) and (self.read <= self.gated or len(self.read) <= 1) and (not self.home or self.home in primary["pages"])
        if relation == "within":
            return bool(pages) and pages <= primary["pages"]
        if relation == "home":
            return bool(pages) and bool(self.home) and pages <= {self.home}
        if relation == "blocks":
            places = [{e["location"] for e in f["evidence"] if e["location"]} for f in (victim, primary)]
            return pages <= primary["pages"] and not places[0].isdisjoint(places[1])
        if relation == "structured":
            return any("jsonld" in (e["note"] or "").lower() for e in victim["evidence"])
        if relation == "nap":
            told = self.computed(victim, "missing=").split("missing=")[-1].split(";")[0]
            names = {x.strip() for x in told.split(",") if x.strip()}
            return self.category == "local_business" and bool(names) and names <= {"address", "phone"}
        if relation == "refused":
            seen = _STATUS_SEEN.findall(" ".join(e["value"] or "" for e in victim["evidence"]))
            return bool(seen) and set(seen) <= {"403", "429"}
        return True

    def inherit(self, primary: dict, victim: dict, note: str) -> None:
        page = (sorted(primary["pages"]) or ["site"])[0]
        if note and note not in primary["notes"]:
            primary["notes"].append(note)
            primary["evidence"].append({"page": page, "kind": "computed", "value": f"folded={victim['check_id']}; note={note}", "location": None, "note": None})
        worst = max(primary["top"], min(primary["rank"], victim["rank"]))
        if primary["status"] == "fail" and worst < primary["rank"]:
            primary["rank"] = worst
            primary["evidence"].append({"page": page, "kind": "computed", "value": f"severity_inherited_from={victim['check_id']}", "location": None, "note": None})


def fold_site(findings: list[dict]) -> list[dict]:
    """check_id, folded_into and fold_row (of victims), rank (severity) and evidence for the findings of one site."""
    site, gone = SiteFindings(findings), []
    for row, primaries, victims, relation, note in FOLDS:
        site.begin(row)
        for name in primaries:
            if name not in site.live:
                continue
            primary, tiers = site.live[name], []
            for check_id in [c for c in site.live if c != name and c.startswith(victims)]:
                victim = site.live[check_id]
                if not site.related(relation, victim, primary):
                    continue
                del site.live[check_id]
                gone.append({"check_id": check_id, "folded_into": name, "fold_row": row, "rank": victim["rank"], "evidence": victim["evidence"]})
                tiers.append(V.ROBOTS_TIER_NAMES.get(check_id, ""))
                site.inherit(primary, victim, note + ", ".join(tiers) if row == 2 else note)
    return gone + [{"check_id": c, "folded_into": None, "fold_row": None, "rank": f["rank"], "evidence": f["evidence"]} for c, f in site.live.items()]


#: What fold() reads beside check_id, pages, severity and max_severity, where a table has it.
FOLD_COLUMNS = {"status": "string", "evidence": EVIDENCE, "home_url": "string", "html_urls": "array<string>", "category": "string"}
_FOLDED = pa.list_(pa.struct([("check_id", pa.string()), ("folded_into", pa.string()), ("fold_row", pa.int32()), ("rank", pa.int32()),
                              ("evidence", pa.list_(pa.struct([(c, pa.string()) for c in ("page", "kind", "value", "location", "note")])))]))


def fold(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, folded) of findings: site, check_id, pages, severity, max_severity, and where there is any: status (fail), evidence, home_url, html_urls (pages read), category.

    The rows of FOLDS apply in order, each to what the rows before it left. A primary notes in its evidence what was folded into it, and
    one that fails inherits the worst severity of its victims up to its own largest. folded names the primary of each victim. A site has
    a finding a check at most, so its findings are one bounded row.
    """
    have = set(findings.columns)
    rows = findings.withColumns({c: F.lit(None).cast(t) for c, t in FOLD_COLUMNS.items() if c not in have})
    rows = rows.withColumns({"rank": severity_rank(F.col("severity")), "top": severity_rank(F.col("max_severity")), "status": F.coalesce("status", F.lit("fail"))})
    known = ["check_id", "pages", "rank", "top", *FOLD_COLUMNS]

    @F.arrow_udf(f"array<struct<check_id:string,folded_into:string,fold_row:int,rank:int,evidence:{EVIDENCE}>>")
    def verdicts(sites: pa.Array) -> pa.Array:
        return pa.array([fold_site(s) for s in sites.to_pylist()], _FOLDED)

    judged = rows.groupBy("site").agg(F.array_sort(F.collect_list(F.struct(*known))).alias("f")).select("site", F.inline(verdicts("f"))).withColumnsRenamed({"rank": "new_rank", "evidence": "new_evidence"})
    met = rows.join(judged, ["site", "check_id"])
    kept = met.where("folded_into is null").withColumns({"severity": severity_name(F.col("new_rank")), "evidence": F.coalesce("new_evidence", F.array().cast(EVIDENCE))})
    added = {c for c in FOLD_COLUMNS if c not in have} - {"evidence", "status"}
    return kept.drop("rank", "top", "new_rank", "new_evidence", "folded_into", "fold_row", *added), met.where("folded_into is not null").select("site", "check_id", "folded_into", "fold_row")


# ---- order, tags, sums ----------------------------------------------------------------------


def rank_findings(findings: DataFrame) -> DataFrame:
    """rank and id in a site: by severity, confidence, number of pages (most first), check id; informational ones last."""
    order = W.partitionBy("site").orderBy(severity_rank(F.col("severity")), confidence_rank(F.col("confidence")), F.desc(F.size("pages")), "check_id")
    return findings.withColumn("rank", F.row_number().over(order)).withColumn("id", F.format_string("F-%03d", F.col("rank")))


def quick_win(findings: DataFrame) -> Column:
    """Medium and worse, of little effort, not doubtful, and failed (where findings have a status)."""
    failed = F.col("status") == "fail" if "status" in findings.columns else F.lit(True)
    return F.col("severity").isin("critical", "high", "medium") & (F.col("effort") == "low") & (F.col("confidence") != "low") & failed


#: Checks of engagement that are about content.
CONTENT_CHECKS = ("en.hero.", "en.cta.", "en.trust.", "en.continuity.", "en.nav.related_links_missing")


def opportunity(check_id: Column) -> Column:
    """technical or content."""
    begins = lambda *some: F.greatest(*[check_id.startswith(b) for b in some], F.lit(False))
    return F.when(begins("cr.", "or.run.") | (begins("en.") & ~begins(*CONTENT_CHECKS)), "technical").otherwise("content")


def tag(findings: DataFrame) -> DataFrame:
    """mode, concepts and pipeline stage by the check's stage, but for the checks of the run itself; opportunity_type; quick_win."""
    tags = F.broadcast(dim(findings.sparkSession, "stage_tag"))
    asked, own = F.col("check_id").startswith("or.simulation."), F.col("check_id").startswith("or.run.")
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    rows = findings.join(tags, "stage", "left").withColumns({
        "mode": F.when(asked, "invisible").when(own, none).otherwise(F.col("mode")), "pipeline": F.when(asked, "selection").when(own, none).otherwise(F.col("pipeline")),
        "concepts": F.when(asked, F.array(F.lit("B"))).when(own, empty).otherwise(F.coalesce("concepts", empty)), "opportunity_type": opportunity(F.col("check_id"))})
    return rows.withColumn("quick_win", quick_win(findings))


def start_with(findings: DataFrame) -> DataFrame:
    """(site, check_id): the first quick win by rank, else of the failed findings above informational the one of greatest priority, least effort, greatest confidence, first rank."""
    failed = F.col("status") == "fail" if "status" in findings.columns else F.lit(True)
    place = lambda c, *order: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), c), F.lit(0)), F.lit(9))
    derived = priority(F.col("severity"), F.col("confidence"))
    quick = quick_win(findings)
    key = F.struct((~quick).alias("slow"), *[F.when(quick, F.lit(0)).otherwise(k).alias(f"k{i}") for i, k in enumerate((
        place(derived, "high", "medium", "low"), place(F.col("effort"), "low", "medium", "high"), place(F.col("confidence"), "high", "medium", "low")))], F.col("rank"))
    return findings.where((F.col("severity") != "info") & failed).groupBy("site").agg(F.min_by("check_id", key).alias("check_id"))


def summary(findings: DataFrame, results: DataFrame) -> DataFrame:
    """Counts of findings by severity and of checks by status, one row a site."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "info")]
    states = [F.count_if(F.col("status") == s).alias(s) for s in ("pass", "fail", "inconclusive", "not_evaluated")]
    return results.groupBy("site").agg(*states).join(findings.groupBy("site").agg(*counts), "site", "left").fillna(0)


def absence_gate(results: DataFrame, key_pages: DataFrame, read: DataFrame) -> DataFrame:
    """Results of checks that claim an absence, with scope: none of the pages where the thing would be was read: not evaluated; some: a claim about the sample.

    key_pages: category, role. read: site, role. results: site, category, check_id, status.
    """
    rules = F.broadcast(dim(results.sparkSession, "absence_role"))
    expected = results.where("status = 'fail'").join(rules, "check_id").join(F.broadcast(key_pages.select("category", "role").distinct()), ["category", "role"])
    seen = expected.join(read.select("site", "role").distinct().withColumn("seen", F.lit(True)), ["site", "role"], "left").groupBy("site", "check_id").agg(
        F.count(F.lit(1)).alias("expected"), F.count("seen").alias("read"))
    scope = F.when(F.col("expected").isNull() | (F.col("read") == F.col("expected")), F.lit(None)).when(F.col("read") == 0, "role_page_not_sampled").otherwise("sample")
    gated = results.join(seen, ["site", "check_id"], "left").withColumn("absence_scope", scope)
    blind = F.col("absence_scope") == "role_page_not_sampled"
    return gated.withColumns({"status": F.when(blind, "not_evaluated").otherwise(F.col("status")), "reason": F.when(blind, F.col("absence_scope")).otherwise(F.col("reason")),
                              "confidence": F.when(F.col("absence_scope") == "sample", "low").otherwise(F.col("confidence"))}).drop("expected", "read")


#: The two questions that every category gets besides its own.
FIT_QUESTION, DIFFERENCE_QUESTION = "Is {brand} a good fit for %s?", "What sets {brand} apart from alternatives?"


def question_table(spark) -> DataFrame:
    """(category, ord, template, fact_ids, informational) with the two questions that close each list; ord from 0."""
    rows = []
    for category in V.SIMULATION_QUESTIONS:
        own = [(t, list(f), n) for t, f, n in V.SIMULATION_QUESTIONS[category]]
        audience = V.AUDIENCE_PHRASE.get(category, V.AUDIENCE_PHRASE["unknown"])
        own += [(FIT_QUESTION % audience, [V.AUDIENCE_FACT.get(category, "what_it_does")], False), (DIFFERENCE_QUESTION, ["differentiator"], True)]
        rows += [(category, i, t, f, n) for i, (t, f, n) in enumerate(own)]
    return spark.createDataFrame(rows, "category string, ord int, template string, fact_ids array<string>, informational boolean")


def simulate(sites: DataFrame, facts: DataFrame) -> DataFrame:
    """(site, ord, question, fact_ids, informational, answerable, missing): a question is answerable when all its facts are present with values that can be quoted. sites: site, category, brand."""
    asked = sites.join(F.broadcast(question_table(sites.sparkSession)), "category").select(
        "site", "ord", F.replace(F.col("template"), F.lit("{brand}"), F.col("brand")).alias("question"), "fact_ids", "informational", F.explode("fact_ids").alias("fact_id"))
    there = facts.where((F.col("status") == "present") & usable_value(F.col("value"))).select("site", "fact_id", F.lit(True).alias("there"))
    known = asked.join(there, ["site", "fact_id"], "left")
    return known.groupBy("site", "ord", "question", "fact_ids", "informational").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("answerable"),
                                                                                     F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.col("fact_id")))).alias("missing"))


def passed_titles(results: DataFrame) -> DataFrame:
    return results.where("status = 'pass'").join(F.broadcast(dim(results.sparkSession, "positive_title")), "check_id").select("site", "check_id", "title")


def violations(findings: DataFrame) -> DataFrame:
    """(site, check_id, problem) for findings that break a rule: unknown check, severity above the largest, low confidence with high severity, derived columns that do not follow, ranks out of order."""
    registry = F.broadcast(dim(findings.sparkSession, "check_registry").select("check_id", F.col("max_severity").alias("limit"), F.lit(True).alias("listed")))
    by_rank = W.partitionBy("site").orderBy("rank")
    rows = findings.join(registry, "check_id", "left").withColumn("before", F.lag(severity_rank(F.col("severity"))).over(by_rank))
    real = F.col("severity") != "info"
    problems = F.array(
        F.when(F.col("listed").isNull(), "unknown check"), F.when(severity_rank(F.col("severity")) < severity_rank(F.col("limit")), "severity above its largest"),
        F.when((F.col("confidence") == "low") & F.col("severity").isin("critical", "high"), "low confidence with high severity"),
        F.when(real & (F.col("impact") != impact(F.col("severity"))), "impact does not follow"),
        F.when(real & (F.col("priority") != priority(F.col("severity"), F.col("confidence"))), "priority does not follow"),
        F.when(F.col("before") > severity_rank(F.col("severity")), "out of order"), F.when(F.col("id") != F.format_string("F-%03d", F.col("rank")), "id does not follow"),
        F.when(F.col("status").isin("inconclusive", "not_evaluated") & real, "undecided but not informational"))
    return rows.select("site", "check_id", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))


def titled(findings: DataFrame, title: Column) -> DataFrame:
    return findings.withColumn("title", clip_title(title))
