"""The words of a report: headline, coverage statement, limitations, answers, and lookups by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.functions import vocab as V
from webgrain.functions.dims import dim
from webgrain.functions.text import let, usable_value


def plural(n: Column, one: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))


#: Reasons that say a gate withdrew a verdict; the letters of concepts and what a full run says of each; how long a quoted run is.
GATE_REASONS = ("role_page_not_sampled", "navigation_not_readable")
LETTER_BASE = {"A": "covered", "B": "covered", "C": "covered", "D": "partial", "E": "out_of_scope", "F": "out_of_scope"}
QUOTED = 20


def headline(summary: DataFrame, read: DataFrame, start: DataFrame, results: DataFrame) -> DataFrame:
    """(site, headline): what was found on how much, where to begin, and what had no verdict.

    summary: site and counts by severity. read: site, pages (read). start: site, id, title of the finding to begin with. results: site, reason, check_id, status.
    """
    gaps = results.groupBy("site").agg(F.count_if(F.col("reason").isin(*GATE_REASONS)).alias("gated"), F.count_if((F.col("check_id") == "or.run.probe_error") & (F.col("status") != "pass")).alias("broken"))
    rows = summary.join(read.select("site", "pages"), "site", "left").join(start, "site", "left").join(gaps, "site", "left").fillna({"pages": 0, "gated": 0, "broken": 0})
    said = lambda *levels: F.array_join(F.array_compact(F.array(*[F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {c}"))) for c in levels])), " and ")
    severe, mild = F.col("critical") + F.col("high"), F.col("medium") + F.col("low")
    pages = F.concat(plural(F.col("pages"), "page"), F.lit(" read"))
    head = F.when(severe > 0, F.concat(said("critical", "high"), F.when(severe == 1, " finding on the ").otherwise(" findings on the "), pages, F.lit("."))).when(
        mild > 0, F.concat(F.lit("No critical or high findings on the "), pages, F.lit("; "), said("medium", "low"), F.lit("."))).otherwise(F.concat(F.lit("No defects on the "), pages, F.lit(".")))
    begin = F.when(F.col("id").isNotNull(), F.concat(F.lit(" Start with "), F.col("id"), F.lit(": "), F.rtrim(F.coalesce("title", F.lit("")), F.lit(".")), F.lit(".")))
    closed = F.when(F.col("gated") > 0, F.concat(F.lit(" "), plural(F.col("gated"), "check"), F.lit(" had no verdict because parts of the site were not reached; see Coverage and limitations.")))
    broken = F.when(F.col("broken") > 0, F.concat(F.lit("The run was incomplete: "), plural(F.col("broken"), "probe"), F.lit(" did not finish. ")))
    return rows.select("site", F.concat(F.coalesce(broken, F.lit("")), head, F.coalesce(begin, F.lit("")), F.coalesce(closed, F.lit(""))).alias("headline"))


def stage_coverage(results: DataFrame) -> DataFrame:
    """(site, stage, state): evaluated, partial (a check had no verdict for another reason than the category) or not_evaluated (none had one)."""
    registry = F.broadcast(dim(results.sparkSession, "check_registry").where("stage <> ''").select("check_id", "stage"))
    judged = F.col("status").isin("pass", "fail")
    open_ = ~judged & (F.coalesce("reason", F.lit("")) != "not_applicable_for_category")
    sums = results.join(registry, "check_id").groupBy("site", "stage").agg(F.bool_or(judged).alias("ran"), F.bool_or(open_).alias("open"))
    every = results.select("site").distinct().join(F.broadcast(dim(results.sparkSession, "stage_tag").select("stage")))
    return every.join(sums, ["site", "stage"], "left").select("site", "stage", F.when(~F.coalesce("ran", F.lit(False)), "not_evaluated").when(F.col("open"), "partial").otherwise("evaluated").alias("state"))


def concept_coverage(stages: DataFrame) -> DataFrame:
    """(site, letter, state) of stage_coverage(): a concept is what its stages are, at best what LETTER_BASE says."""
    spark = stages.sparkSession
    base = F.broadcast(spark.createDataFrame(list(LETTER_BASE.items()), "letter string, base string"))
    met = stages.join(F.broadcast(dim(spark, "concept_stage")), "stage").groupBy("site", "letter").agg(
        F.bool_and(F.col("state") == "not_evaluated").alias("none"), F.bool_and(F.col("state") == "evaluated").alias("full"))
    rows = stages.select("site").distinct().join(base).join(met, ["site", "letter"], "left")
    return rows.select("site", "letter", F.when(F.col("none").isNull() | F.coalesce(F.col("full"), F.lit(False)), F.col("base")).when(F.col("none"), "not_evaluated").otherwise("partial").alias("state"))


def coverage_statement(stages: DataFrame, concepts: DataFrame, results: DataFrame, sample: DataFrame) -> DataFrame:
    """(site, statement). sample: site, roles (of the pages sampled, in order), missing_roles, requests (null: unknown)."""
    order = list(V.STAGE_ORDER)
    of = lambda key, state, known: F.array_join(F.array_compact(F.array(*[F.max(F.when((F.col(key) == k) & (F.col("state") == state), F.lit(k))) for k in known])), ", ")
    by_letter = concepts.groupBy("site").agg(*[of("letter", s, "ABCD").alias(f"l_{s}") for s in ("covered", "partial", "not_evaluated")])
    by_stage = stages.groupBy("site").agg(*[of("stage", s, order).alias(f"s_{s}") for s in ("evaluated", "partial", "not_evaluated")])
    open_ = results.where(F.col("status").isin("not_evaluated", "inconclusive") & (F.coalesce("reason", F.lit("")) != "not_applicable_for_category"))
    why = open_.groupBy("site").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("check_id", F.coalesce("reason", "status").alias("r")))), 1, 3),
                                                             lambda e: F.concat(F.element_at(F.split(e["check_id"], r"\."), -1), F.lit(": "), e["r"])), "; ").alias("why"))
    rows = by_stage.join(by_letter, "site").join(why, "site", "left").join(sample, "site", "left")
    some = lambda c, *text: F.when(F.col(c) != "", F.concat(*text))
    bits = F.array_join(F.array_compact(F.array(
        some("l_covered", F.col("l_covered"), F.lit(" fully")), some("l_partial", F.col("l_partial"), F.lit(" partially"), F.coalesce(F.concat(F.lit(" ("), F.col("why"), F.lit(")")), F.lit(""))),
        some("l_not_evaluated", F.col("l_not_evaluated"), F.lit(" not evaluated")))), "; ")
    lines = [
        F.concat(F.lit("Concepts covered: "), F.when(bits == "", "none").otherwise(bits), F.lit("; E and F out of scope for a site audit, site-side levers reported.")),
        F.concat(F.lit("Stages evaluated: "), F.when(F.col("s_evaluated") == "", "none").otherwise(F.col("s_evaluated")), F.coalesce(some("s_partial", F.lit("; partial: "), F.col("s_partial")), F.lit("")),
                 F.coalesce(some("s_not_evaluated", F.lit("; not evaluated: "), F.col("s_not_evaluated")), F.lit("")), F.lit(".")),
        F.concat(F.lit("Pages sampled: "), F.greatest(F.lit(0), F.coalesce(F.size("roles"), F.lit(0))).cast("string"), F.lit(" ("), F.when(F.coalesce(F.size("roles"), F.lit(0)) < 1, "none").otherwise(F.array_join("roles", ", ", "?")), F.lit(")"),
                 F.when(F.size("missing_roles") > 0, F.concat(F.lit("; no page found for: "), F.array_join("missing_roles", ", "))).otherwise(""), F.lit(".")),
        F.concat(F.lit("Requests made: "), F.coalesce(F.col("requests").cast("string"), F.lit("unknown")), F.lit(".")),
        F.lit("This audit reads what a non-JavaScript fetcher receives; it does not query live assistants or execute scripts.")]
    return rows.select("site", F.concat_ws(" ", *lines).alias("statement"))


def answers(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """(site, ord, answer): the values of all facts that a question asks for, quoted to the letter in its order; null where one is missing or no value to quote.

    questions: site, ord, fact_ids. facts: site, fact_id, status, value.
    """
    asked = questions.select("site", "ord", F.posexplode("fact_ids").alias("k", "fact_id"))
    met = asked.join(facts.where((F.col("status") == "present") & usable_value(F.col("value"))).select("site", "fact_id", F.trim("value").alias("value")), ["site", "fact_id"], "left")
    rows = met.groupBy("site", "ord").agg(F.bool_and(F.col("value").isNotNull()).alias("whole"), F.array_sort(F.collect_list(F.struct("k", "value"))).alias("v"))
    quoted = F.transform("v", lambda x: F.concat(F.lit('"'), x["value"], F.lit('"')))
    rest = F.when(F.size("v") > 1, F.concat(F.lit(" It also states "), F.array_join(F.slice(quoted, 2, 1 << 20), " and "), F.lit("."))).otherwise("")
    return rows.select("site", "ord", F.when(F.col("whole"), F.concat(F.lit("According to the site, "), F.element_at(quoted, 1), F.lit("."), rest)).alias("answer"))


def quotes_fact(answer: Column, value: Column, least: int = QUOTED) -> Column:
    """Whether an answer holds a fact's value, or a run of `least` characters of it, whatever the case, the white space and the ellipses."""
    plain = lambda t: F.lower(F.trim(F.regexp_replace(F.replace(F.coalesce(t, F.lit("")), F.lit("…"), F.lit(" ")), r"(?U)\s+", " ")))

    def held(v: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(v["v"]) - least + 1))
        return F.when(v["v"] == "", False).when(F.char_length(v["v"]) <= least, F.contains(v["a"], v["v"])).otherwise(F.exists(places, lambda i: F.contains(v["a"], F.substring(v["v"], i, F.lit(least)))))
    return let(F.struct(plain(answer).alias("a"), plain(value).alias("v")), held)


def missing_recommended(nodes: DataFrame, most: int = 20) -> DataFrame:
    """(site, type, missing): properties that a kind of structured data should have and a node lacks, `most` rows a site. nodes: site, ord, type, keys."""
    spec = F.broadcast(dim(nodes.sparkSession, "schema_spec").select("type", "recommended"))
    gaps = nodes.join(spec, "type").withColumn("missing", F.array_except("recommended", "keys")).where(F.size("missing") > 0)
    firsts = gaps.groupBy("site").agg(F.slice(F.array_sort(F.collect_list(F.struct("ord", "type", "missing"))), 1, most).alias("g"))
    return firsts.select("site", F.inline("g"))


def edge_plan(grades: DataFrame) -> DataFrame:
    """(site, token, action): tokens that robots rules allow are probed, the others are a matter of policy. grades: site, token, root_allowed."""
    return grades.select("site", "token", F.when(F.col("root_allowed"), "probe").otherwise("policy").alias("action"))
