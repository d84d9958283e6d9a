"""What a sample of pages cannot show: results are withdrawn or softened where the pages that would tell were not read, not rendered or not understood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.functions import vocab as V
from webgrain.functions.dims import dim
from webgrain.functions.text import majority
from webgrain.operators import evidence as E

#: Checks that read words, each with the languages whose words it has; how few links or how many unread roles hide a press page.
LANGUAGES_READ = dict.fromkeys(("fx.facts.key_fact_missing", "fx.content.faq_absent", "ef.corroboration.press_page_missing", "en.hero.value_prop_unclear", "en.trust.signals_missing",
                                "en.nav.related_links_missing"), ("en",)) | {"en.cta.missing": ("en", *V.CTA_VOCAB_BY_LANG)}
PRESS_FEW_LINKS, PRESS_MISSING_ROLES = 3, 4


def _withdraw(results: DataFrame, blind, reason: str) -> DataFrame:
    return results.withColumns({"status": F.when(blind, "not_evaluated").otherwise(F.col("status")), "reason": F.when(blind, reason).otherwise(F.col("reason"))})


def sample_language(pages: DataFrame) -> DataFrame:
    """(site, lang): the language of most pages by their words, or where no page's words tell by what they declare; of equals the first. pages: site, page_ord, declared, detected."""
    votes = [majority(pages, "site", c, "page_ord").withColumnRenamed(c, f"by_{c}") for c in ("detected", "declared")]
    return votes[0].join(votes[1], "site", "full").select("site", F.coalesce("by_detected", "by_declared").alias("lang"))


def language_gate(results: DataFrame, languages: DataFrame) -> DataFrame:
    """Failures of checks that read words are withdrawn where a site's language is known and none whose words the check has. languages: site, lang."""
    known = languages.where(F.col("lang").isNotNull()).select("site", F.col("lang").alias("site_lang"))
    unread = F.coalesce(*[F.when(F.col("check_id") == c, ~F.col("site_lang").isin(*read)) for c, read in LANGUAGES_READ.items()], F.lit(False))
    blind = F.coalesce(unread, F.lit(False)) & (F.col("status") == "fail")
    return _withdraw(results.join(known, "site", "left"), blind, "language_not_supported").drop("site_lang")


def chrome_gate(results: DataFrame, homes: DataFrame) -> DataFrame:
    """Failures of checks that read navigation are withdrawn where the home page's header or footer came empty, no nav was served and scripts would fill them. homes: site, empty_chrome, nav_count, external_scripts (numbers)."""
    empty = homes.where("empty_chrome > 0 and nav_count = 0 and external_scripts > 0").select("site", F.lit(True).alias("empty")).distinct()
    blind = F.coalesce("empty", F.lit(False)) & (F.col("status") == "fail") & F.col("check_id").isin(*V.CHROME_DEPENDENT)
    return _withdraw(results.join(empty, "site", "left"), blind, "chrome_rendered_by_javascript").drop("empty")


def press_gate(results: DataFrame, seen: DataFrame) -> DataFrame:
    """A missing press page is left open where no blog page was read and the navigation showed little. seen: site, links (of the home page, null: unknown), missing_roles."""
    hidden = F.array_contains("missing_roles", "blog") & (F.coalesce(F.col("links") <= PRESS_FEW_LINKS, F.lit(False)) | (F.size("missing_roles") >= PRESS_MISSING_ROLES))
    thin = seen.select("site", hidden.alias("thin"))
    blind = F.coalesce("thin", F.lit(False)) & (F.col("status") == "fail") & (F.col("check_id") == "ef.corroboration.press_page_missing")
    return _withdraw(results.join(thin, "site", "left"), blind, "navigation_not_readable").drop("thin")


def scope_facts(results: DataFrame, scoped: DataFrame) -> DataFrame:
    """results whose finding about key facts names only those that the pages read would have stated; with none of them it has no verdict. scoped: fact_gate()."""
    rows = results.join(scoped.select("site", F.col("confirmed").alias("_confirmed"), F.col("unchecked").alias("_unchecked")), "site", "left")
    own = F.coalesce((F.col("check_id") == "fx.facts.key_fact_missing") & (F.col("status") == "fail") & (F.size("_unchecked") > 0), F.lit(False))
    blind = own & (F.size("_confirmed") == 0)
    listed = lambda c: F.array_join(c, ",")
    scope = E.items(E.item("computed", F.concat(F.lit("absence_scope=sample; confirmed_missing="), listed("_confirmed"), F.lit("; not_checked="), listed("_unchecked")), page="site"))
    told = E.items(E.item("computed", F.concat(F.lit("missing="), listed("_confirmed")), page="site"))
    return _withdraw(rows, blind, "role_page_not_sampled").withColumns({
        "detail": F.when(own, listed("_confirmed")).otherwise(F.col("detail")), "evidence": F.when(own, F.concat(told, scope)).otherwise(F.col("evidence")),
        "absence_scope": F.when(own & ~blind, "sample").otherwise(F.col("absence_scope"))}).drop("_confirmed", "_unchecked")


def fact_gate(facts: DataFrame, unread: DataFrame) -> DataFrame:
    """(site, confirmed, unchecked, severity): missing required facts, parted by whether a page that would state them was read.

    A fact is unchecked when a role whose pages state it was not sampled. Confirmed ones alone count for the severity: two and more
    high, one medium, none not evaluated. facts: site, fact_id, status, required. unread: site, role.
    """
    places = F.broadcast(dim(facts.sparkSession, "fact_role").select("fact_id", "role"))
    gone = facts.where(F.col("required") & (F.col("status") != "present")).select("site", "fact_id")
    open_ = gone.join(places, "fact_id").join(unread.select("site", "role").distinct(), ["site", "role"]).select("site", "fact_id", F.lit(True).alias("open")).distinct()
    rows = gone.join(open_, ["site", "fact_id"], "left")
    listed = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("fact_id"))))
    sums = rows.groupBy("site").agg(listed(F.col("open").isNull()).alias("confirmed"), listed(F.col("open")).alias("unchecked"))
    severity = F.when(F.size("confirmed") >= 2, "high").when(F.size("confirmed") == 1, "medium")
    return sums.withColumn("severity", severity)
