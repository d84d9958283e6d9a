"""Rules that reports keep, as queries for the rows that break them, and answers from outside merged into a report's questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webgrain.functions.dims import CONFIDENCES, SEVERITIES, dim, severity_rank
from webgrain.operators.grade import quick_win, start_with
from webgrain.operators.report import quotes_fact

#: States of a check, levels, and the longest title.
STATUSES, LEVELS, EFFORTS, TITLE_MOST = ("pass", "fail", "inconclusive", "not_evaluated"), ("high", "medium", "low"), ("low", "medium", "high", "n/a"), 90


def _outside(column: str, allowed: tuple[str, ...]) -> Column:
    return ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))


def _blank(column: str) -> Column:
    return F.trim(F.coalesce(column, F.lit(""))) == ""


def _listed(rows: DataFrame, keys: list[str | Column], problems: list[Column]) -> DataFrame:
    return rows.select(*keys, F.explode(F.filter(F.array(*problems), lambda p: p.isNotNull())).alias("problem"))


def floor_violations(findings: DataFrame, summaries: DataFrame) -> DataFrame:
    """(site, item, problem): the least that any report must hold.

    findings: site, id, title, severity, evidence, action, priority. summaries: site, total and a count a severity. item: the finding's id, `summary` for the counts.
    """
    again = F.count(F.lit(1)).over(W.partitionBy("site", "id")) > 1
    rows = findings.withColumn("again", again)
    own = _listed(rows, ["site", F.coalesce("id", F.lit("?")).alias("item")], [
        F.when(~F.coalesce(F.col("id").rlike(r"^F-\d{3,}$"), F.lit(False)), "id is not F-###"), F.when(F.col("id").isNotNull() & F.col("again"), "id occurs twice"),
        F.when(_blank("title"), "no title"), F.when(_outside("severity", tuple(SEVERITIES)), "unknown severity"), F.when(_blank("evidence"), "no evidence"),
        F.when(_blank("action"), "no action"), F.when(_outside("priority", LEVELS), "unknown priority")])
    actual = findings.groupBy("site").agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES])
    met = summaries.join(actual, "site", "left").fillna(0, ["rows", *[f"n_{s}" for s in SEVERITIES]])
    sums = sum((F.col(s) for s in SEVERITIES[1:]), F.col(SEVERITIES[0]))
    counts = _listed(met, ["site", F.lit("summary").alias("item")], [
        F.when(F.col("total") != sums, "total is not the sum of the severities"), F.when(F.col("total") != F.col("rows"), "total is not the number of findings"),
        *[F.when(F.col(s) != F.col(f"n_{s}"), f"count of {s} is not that of the findings") for s in SEVERITIES]])
    return own.unionByName(counts)


def integrity_violations(findings: DataFrame, folded: DataFrame, passed: DataFrame, stated: DataFrame) -> DataFrame:
    """(site, item, problem): references within a report that do not hold.

    findings: site, id, check_id, severity, confidence, effort, rank, quick_win. folded: site, check_id, folded_into. passed: site, check_id.
    stated: site, start_with (the check to begin with, as the report says). All by joins on site and check.
    """
    kept = findings.select("site", "check_id")
    flags = _listed(findings, ["site", F.col("check_id").alias("item")], [F.when(F.col("quick_win") != quick_win(findings), "quick win contradicts the rule")])
    orphans = folded.join(kept.withColumnRenamed("check_id", "folded_into"), ["site", "folded_into"], "left_anti").select("site", F.col("check_id").alias("item"), F.lit("folded into no finding").alias("problem"))
    both = folded.join(kept, ["site", "check_id"], "left_semi").select("site", F.col("check_id").alias("item"), F.lit("kept and folded").alias("problem"))
    wrong = passed.join(kept, ["site", "check_id"], "left_semi").select("site", F.col("check_id").alias("item"), F.lit("passed and a finding").alias("problem"))
    due = stated.join(start_with(findings).withColumnRenamed("check_id", "due"), "site", "left")
    first = due.where(~F.col("start_with").eqNullSafe(F.col("due"))).select("site", F.coalesce("start_with", F.lit("?")).alias("item"), F.lit("not the finding to start with").alias("problem"))
    return flags.unionByName(orphans).unionByName(both).unionByName(wrong).unionByName(first)


def simulation_violations(questions: DataFrame, facts: DataFrame, findings: DataFrame, final: bool = False) -> DataFrame:
    """(site, ord, problem): answers that do not follow from the facts.

    questions: site, ord, answerable, answer, facts_used, missing, see_finding. facts: site, fact_id, status, value. findings: site, id. final: whether every
    answerable question must have its answer.
    """
    said = F.coalesce("answer", F.lit("")) != ""
    can, used, gaps = F.col("answerable"), F.size(F.coalesce("facts_used", F.array().cast("array<string>"))), F.size(F.coalesce("missing", F.array().cast("array<string>")))
    own = _listed(questions, ["site", "ord"], [
        F.when(~can & said, "answered but not answerable"), F.when(~can & (gaps == 0), "not answerable but nothing is missing"), F.when(can & (gaps > 0), "answerable but facts are missing"),
        F.when(can & said & (used == 0), "answered without facts"), F.when(can & ~said & F.lit(final), "answerable but not answered")])
    cited = questions.where(can & said).select("site", "ord", "answer", F.explode(F.array_distinct("facts_used")).alias("fact_id"))
    met = cited.join(facts.where("status = 'present'").select("site", "fact_id", "value", F.lit(True).alias("there")), ["site", "fact_id"], "left")
    quotes = _listed(met, ["site", "ord"], [F.when(F.col("there").isNull(), F.concat(F.lit("cites a fact that is not present: "), F.col("fact_id"))),
                                            F.when(F.col("there") & ~quotes_fact(F.col("answer"), F.col("value")), F.concat(F.lit("does not quote: "), F.col("fact_id")))])
    astray = questions.where("see_finding is not null").join(findings.select("site", F.col("id").alias("see_finding")), ["site", "see_finding"], "left_anti").select("site", "ord", F.lit("refers to no finding").alias("problem"))
    return own.unionByName(quotes).unionByName(astray)


def result_violations(results: DataFrame, findings: DataFrame) -> DataFrame:
    """(site, check_id, problem): results and findings of one probe that are not well formed.

    results: site, check_id, status, reason. findings: site, check_id, status, severity, confidence, effort, title, evidence.
    """
    registry = F.broadcast(dim(results.sparkSession, "check_registry").select("check_id", F.col("max_severity").alias("limit")))
    open_ = F.col("status").isin("inconclusive", "not_evaluated")
    states = _listed(results.join(registry, "check_id", "left"), ["site", "check_id"], [
        F.when(F.col("limit").isNull(), "unknown check"), F.when(_outside("status", STATUSES), "unknown status"), F.when(open_ & _blank("reason"), "open without a reason")])
    rows = findings.join(registry, "check_id", "left")
    graded = _listed(rows, ["site", "check_id"], [
        F.when(F.col("status") == "pass", "finding of a passed check"), F.when(open_ & (F.col("severity") != "info"), "open but not informational"),
        F.when(_outside("severity", tuple(SEVERITIES)) | _outside("confidence", tuple(CONFIDENCES)) | _outside("effort", EFFORTS), "value out of range"),
        F.when(_blank("evidence") | (F.char_length(F.coalesce("title", F.lit(""))) > TITLE_MOST), "long title or no evidence"),
        F.when((F.col("status") == "fail") & severity_rank(F.col("severity")).between(0, severity_rank(F.col("limit")) - 1), "severity above its largest"),
        F.when(F.col("limit").isNotNull() & (F.col("confidence") == "low") & F.col("severity").isin("critical", "high"), "low confidence with high severity")])
    return states.unionByName(graded)


def merge_answers(questions: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, rejected): answers from outside put in place of a question's own, and those that are not taken, each with its problem.

    questions: site, ord, answerable, answer, facts_used and whatever else. given: site, ord, answer, facts_used (null or empty: the question's stay), one row a question.
    """
    known = given.join(questions.select("site", "ord", "answerable"), ["site", "ord"], "left")
    problem = F.when(F.col("answerable").isNull(), "no such question").when(~F.col("answerable"), "not answerable").when(_blank("answer"), "no answer")
    judged = known.withColumn("problem", problem)
    taken = judged.where("problem is null").select("site", "ord", F.trim("answer").alias("_answer"), F.when(F.size("facts_used") > 0, F.col("facts_used")).alias("_used"))
    merged = questions.join(taken, ["site", "ord"], "left").withColumns({"answer": F.coalesce("_answer", "answer"), "facts_used": F.coalesce("_used", "facts_used")}).drop("_answer", "_used")
    return merged, judged.where("problem is not null").select("site", "ord", "problem")
