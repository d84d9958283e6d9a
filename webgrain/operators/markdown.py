"""A report as Markdown: sections put together from the report's own rows, each left out where it has nothing to say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.functions import vocab as V
from webgrain.functions.dims import SEVERITIES

#: Fixed value: how severities are headed.
LABELS = {"critical": "Critical", "high": "High", "medium": "Medium", "low": "Low", "info": "Informational"}
#: What an audit of served pages cannot see, and what would: (what, why).
NOT_COVERED = [
    ("answers of live assistants", "No assistant is asked; only what it could read is."),
    ("what scripts add in a browser", "Pages are read as served."),
    ("rankings and traffic", "They are not on the site."),
    ("speed as visitors see it", "Counts of bytes and scripts stand in for measurements."),
    ("pages behind a login", "Only what is public is read."),
    ("the truth of statements", "Facts are quoted, not checked."),
]
ITEMS, PAGES = 6, 4


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _lines(*parts: Column) -> Column:
    """Lines that are not null, in order."""
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def _item(e: Column) -> Column:
    return _text(e["kind"], F.coalesce(F.concat(F.lit(" @ "), e["location"]), F.lit("")), ": ", e["value"], F.coalesce(F.concat(F.lit("  ("), e["note"], F.lit(")")), F.lit("")))


def _pages(pages: Column) -> Column:
    shown = F.array_join(F.transform(F.slice(pages, 1, PAGES), lambda p: F.concat(F.lit("`"), p, F.lit("`"))), ", ")
    return F.when(F.coalesce(F.size(pages), F.lit(0)) < 1, "whole site").otherwise(F.concat(shown, F.when(F.size(pages) > PAGES, _text(" and ", F.size(pages) - PAGES, " more")).otherwise("")))


def finding(f: Column) -> Column:
    """One finding's section."""
    act = f["suggested_action"]
    return _lines(
        _text("#### ", f["id"], " ", f["title"]), F.lit(""),
        _text("`", f["check_id"], "` · severity **", f["severity"], "** · confidence ", f["confidence"], " · effort ", f["effort"], " · ", F.when(F.coalesce(f["mechanism"], F.lit("")) == "", "run").otherwise(f["mechanism"]), " · ", _pages(f["pages"])),
        F.lit(""), f["evidence_text"], F.lit(""), F.lit("```"), F.array_join(F.transform(F.slice(f["evidence"], 1, ITEMS), _item), "\n"), F.lit("```"), F.lit(""),
        _text("*Why it matters.* ", f["why_it_matters"]), F.lit(""), _text("*Do this.* ", act["summary"], " ", act["detail"]), F.lit(""),
        _text("Priority **", act["priority"], "** · impact ", act["impact"], " · effort ", act["effort"], F.when(f["quick_win"], " · quick win").otherwise("")), F.lit(""))


def _section(title: str, body: Column, there: Column) -> Column:
    return F.when(there, F.concat(F.lit(f"## {title}\n\n"), body, F.lit("\n")))


def markdown(reports: DataFrame) -> DataFrame:
    """(site, markdown) of the reports of plans.audit.report()."""
    r, have = F.col("report"), set(reports.schema["report"].dataType.names)
    found, some = r["findings"], F.coalesce(F.size(r["findings"]), F.lit(0)) > 0
    n = F.greatest(F.lit(0), F.coalesce(F.size(found), F.lit(0)))
    of = lambda c: F.coalesce(r[c], F.lit(0))
    counts = _text("**", n, F.when(n == 1, " finding** — ").otherwise(" findings** — "), of("critical"), " critical, ", of("high"), " high, ", of("medium"), " medium, ", of("low"), " low, ", of("info"), " informational.")
    ran = of("pass") + of("fail") + of("inconclusive") + of("not_evaluated")
    checks = _text(ran, " checks run: ", of("pass"), " passed, ", of("fail"), " failed, ", of("inconclusive"), " inconclusive, ", of("not_evaluated"), " not evaluated.")
    wins = F.filter(found, lambda f: f["quick_win"])
    first = F.get(F.filter(found, lambda f: f["id"] == r["start_with"]), F.lit(0))
    line = lambda f: _text("- **", f["id"], "** ", f["title"], " — ", f["suggested_action"]["summary"])
    quick = F.when(F.size(wins) > 0, F.concat(F.lit("Low effort, real impact, certain enough to act on today.\n\n"), F.array_join(F.transform(wins, line), "\n"))).otherwise(
        _text("None qualify. Start instead with **", first["id"], "** ", first["title"], " — ", first["suggested_action"]["summary"], " (", first["effort"], " effort, ", first["confidence"], " confidence)."))
    groups = []
    for severity in SEVERITIES:
        own = F.filter(found, lambda f: f["severity"] == severity)  # noqa: B023  used at once
        groups.append(F.when(F.size(own) > 0, F.concat(_text(f"### {LABELS[severity]} (", F.size(own), ")"), F.lit("\n\n"), F.array_join(F.transform(own, finding), "\n"))))
    folded = F.array_join(F.transform(r["folded"], lambda f: _text("- `", f["check_id"], "` — folded into **", F.coalesce(f["merged_into"], F.lit("—")), "**")), "\n")
    stages = []
    for stage in (*V.STAGE_ORDER, ""):
        own = F.filter(r["working"], lambda c: c["stage"] == stage)  # noqa: B023
        stages.append(F.when(F.size(own) > 0, F.concat(F.lit(f"**{stage or 'run'}**\n\n"), F.array_join(F.transform(own, lambda c: _text("- ", c["title"], " (`", c["check_id"], "`)")), "\n"), F.lit("\n"))))
    working = F.concat(_text(F.size(r["working"]), " checks passed.\n\n"), F.array_join(F.array_compact(F.array(*stages)), "\n"))
    reply = lambda q: F.when(q["answerable"], F.coalesce(q["answer"], F.lit("_Answerable, but nothing quotable._"))).otherwise(
        _text("_Not answerable from the site's text. Absent: ", F.array_join(q["missing"], ", "), "._", F.when(q["informational"], " Informational only.").otherwise("")))
    asked = F.array_join(F.transform(r["questions"], lambda q: _text("**", q["question"], "**\n\n", reply(q), "\n")), "\n")
    advice = F.array_join(F.transform(r["recommendations"], lambda a: _text("- **", a["title"], "** (", a["stage"], ", ", a["effort"], " effort, priority ", a["priority"], ")")), "\n") if "recommendations" in have else F.lit(None).cast("string")
    limits = F.array_join(F.transform(r["limitations"], lambda x: F.concat(F.lit("- "), x)), "\n") if "limitations" in have else F.lit(None).cast("string")
    gaps = F.when(F.size(r["no_verdict"]) > 0, F.concat(F.lit("Checks with no verdict: "), F.array_join(F.transform(r["no_verdict"], lambda e: _text("`", e["check_id"], "` (", e["reason"], ")")), ", "), F.lit("\n")))
    off = F.when(F.size(r["not_applicable"]) > 0, F.concat(F.lit("Not applicable to this category: "), F.array_join(F.transform(r["not_applicable"], lambda c: _text("`", c, "`")), ", "), F.lit("\n")))
    outside = F.lit("- Outside this audit's scope: " + "; ".join(what for what, _ in NOT_COVERED) + ".")
    there = lambda c: F.coalesce(F.size(r[c]), F.lit(0)) > 0
    body = _lines(
        _text("# Audit of ", F.col("site"), "\n"), _section("Summary", _lines(r["headline"], F.lit(""), counts, F.lit(""), checks), F.lit(True)),
        _section("What this means", r["narrative"], r["narrative"].isNotNull()) if "narrative" in have else F.lit(None).cast("string"),
        _section("Quick wins", quick, (F.size(wins) > 0) | first.isNotNull()), _section("Findings", F.array_join(F.array_compact(F.array(*groups)), "\n"), some),
        _section("Folded into other findings", folded, there("folded")), _section("What is working", working, there("working")),
        _section("Questions and answers", F.concat(F.lit("What could be answered from the site's own text alone.\n\n"), asked), there("questions")),
        _section("Recommendations", advice, advice != ""), _section("Coverage and limitations", _lines(r["statement"], F.lit(""), gaps, off, limits, outside), F.lit(True)))
    return reports.select("site", body.alias("markdown"))


def non_coverage(spark) -> DataFrame:
    """(ord, what, line): what stays outside an audit of served pages, one row each."""
    return spark.createDataFrame([(i, what, f"Not covered: {what}. {why}") for i, (what, why) in enumerate(NOT_COVERED)], "ord int, what string, line string")
