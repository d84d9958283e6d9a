"""Queries over reports that are made of `part` by a rule on the key: what they say beside findings, and the rules they must keep."""

from __future__ import annotations

from pyspark.sql import functions as F

from webgrain.functions import vocab as V
from webgrain.operators import compose, validate
from webgrain.queries import _t, _values, query

_USED = sorted({c for r in compose.RECOMMENDATIONS for c in r[5]} | {"fx.content.faq_absent", "ef.freshness.no_visible_dates", "ef.entity.sameas_missing", "ef.entity.sameas_no_authority"})
_CATEGORIES = list(V.CATEGORIES)


def _p(spark, sf_dir):
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))


def _strings(*values):
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _state(check: str) -> str:
    """Passed below 3, failed at 3, open at 4."""
    return f"(p * 7 + {_USED.index(check)} * 3) % 5"


def _blocks(blocked: tuple[str, ...]) -> str:
    return "FALSE" if not blocked else "(" + " OR ".join(f"{_state(c)} = 3" for c in blocked) + ")"


_PASS = {c: f"{_state(c)} < 3" for c in _USED}
_DIFF, _AUD = "(p % 11 <> 0 AND p % 3 <> 1)", "(p % 11 <> 0 AND p % 13 < 5)"
_APPLIES = {
    "faq_markup": f"{_PASS['fx.content.faq_absent']} AND p % 3 <> 0", "difference": f"p % 11 <> 0 AND NOT {_DIFF}", "number": f"{_DIFF} AND p % 2 = 1",
    "audience": f"p % 11 <> 0 AND NOT {_AUD}", "properties": f"{_PASS['fx.jsonld.missing']} AND p % 4 <> 1", "product_markup": f"category = 'ecommerce' AND {_PASS['fx.jsonld.missing']} AND p % 4 <> 0",
    "local_markup": f"category = 'local_business' AND {_PASS['fx.jsonld.missing']} AND p % 6 <> 1", "hours_markup": "category = 'local_business' AND p % 11 <> 0 AND (p // 3) % 2 = 1 AND p % 4 <> 1",
    "article_markup": f"category IN ('publisher_media', 'corporate_enterprise') AND {_PASS['ef.freshness.no_visible_dates']} AND p % 7 <> 0",
    "price_range": "category = 'saas_software' AND p % 5 = 0", "milestones": _PASS["ef.corroboration.press_page_missing"],
    "profiles": f"{_PASS['ef.entity.sameas_missing']} AND {_PASS['ef.entity.sameas_no_authority']}",
    "deep_pages": "category IN ('publisher_media', 'ecommerce', 'saas_software', 'corporate_enterprise')", "summary_file": "TRUE",
}


@query(f"WITH q AS (SELECT p_partkey AS p, {_CATEGORIES}[p_partkey % {len(_CATEGORIES)} + 1] AS category FROM part), r AS (" + " UNION ALL ".join(
    f"SELECT p, '{name}' AS name, {('high', 'medium', 'low').index(priority)} AS k, '{title.replace(chr(39), chr(39) * 2)}' AS title FROM q WHERE ({_APPLIES[name]}) AND NOT {_blocks(blocked)}"
    for name, title, priority, _, _, blocked in compose.RECOMMENDATIONS) + "), o AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY k, title) AS n FROM r) SELECT p AS site, n::INT AS ord, name, title FROM o WHERE n <= 8")
def recommendations(spark, sf_dir):
    """The 14 rules, what blocks them, their order and the first eight, over a site for each part."""
    state = {c: (F.col("p") * 7 + i * 3) % 5 for i, c in enumerate(_USED)}
    some = lambda conds: F.filter(F.array(*conds), lambda x: x.isNotNull())
    fact = lambda name, there, value, source: F.when(F.col("p") % 11 != 0, F.struct(F.lit(name), F.struct(F.when(there, "present").otherwise("absent").alias("status"), value.alias("value"), source.alias("source"))))
    p = F.col("p")
    facts = some([fact("differentiator", p % 3 != 1, F.when(p % 2 == 0, "9 lives").otherwise("care"), F.lit("text")), fact("audience", p % 13 < 5, F.lit("all"), F.lit("text")),
                  fact("opening_hours", F.floor(p / 3) % 2 == 1, F.lit("9-5"), F.when(p % 4 == 1, "jsonld:Store").otherwise("text"))])
    rows = _p(spark, sf_dir).select(
        p.alias("site"), F.element_at(_strings(*_CATEGORIES), (p % len(_CATEGORIES) + 1).cast("int")).alias("category"), some([F.when(s < 3, F.lit(c)) for c, s in state.items()]).alias("passed"),
        some([F.when(s == 3, F.lit(c)) for c, s in state.items()]).alias("failed"),
        some([F.when(p % n == k, F.lit(t)) for t, n, k in (("FAQPage", 3, 0), ("Product", 4, 0), ("Store", 6, 1), ("NewsArticle", 7, 0))]).alias("types"),
        F.when(p % 4 != 1, "Product: image").alias("gaps"), (p % 5 == 0).alias("sales_led"), F.map_from_entries(facts).alias("facts"))
    return compose.recommend(rows).select("site", "ord", "name", "title")


def _s(n: str, one: str) -> str:
    return f"concat({n}, ' {one}', CASE WHEN {n} = 1 THEN '' ELSE 's' END)"


@query(f"""WITH q AS (SELECT p_partkey AS p, p_partkey % 4 + 1 AS n, p_partkey % 3 AS l FROM part),
    t AS (SELECT p, list_filter([concat('{compose.POINT_IN_TIME} of ', {_s('n', 'sampled page')}, '; pages that differ from visit to visit may differ between runs.'),
        CASE WHEN n = 1 THEN 'No page but the home page was read, so every finding rests on it alone.' END, CASE WHEN p % 5 = 0 THEN 'The home page led to the edition in de, which the findings describe.' END,
        CASE WHEN p % 2 = 0 THEN '{compose.REASON_LINES["role_page_not_sampled"]}a.x, b.y.' END, CASE WHEN p % 7 = 0 THEN '{compose.REASON_LINES["language_not_supported"]}c.z.' END,
        CASE WHEN l > 0 THEN concat({_s('l', 'page')}, ' skipped: too many requests.') END, CASE WHEN p % 6 = 1 THEN '1 page answered by a challenge, so their checks are open.' END, '{compose.SERVED_ONLY}'], lambda x: x IS NOT NULL) AS s FROM q)
    SELECT p AS site, unnest(range(1, len(s) + 1))::INT AS ord, unnest(s) AS line FROM t""")
def report_limitations(spark, sf_dir):
    p = F.col("p")
    read = _p(spark, sf_dir).select(p.alias("site"), (p % 4 + 1).alias("pages"), F.when(p % 4 == 0, _strings("home")).otherwise(_strings("home", "about")).alias("roles"), F.when(p % 5 == 0, "de").alias("edition"),
                                    (p % 3).alias("limited"), F.when(p % 6 == 1, 1).otherwise(0).alias("challenged"))
    row = lambda check, cond, status, reason: F.when(cond, F.struct(F.lit(check).alias("check_id"), F.lit(status).alias("status"), F.lit(reason).alias("reason")))
    made = F.array(row("b.y", p % 2 == 0, "not_evaluated", "role_page_not_sampled"), row("a.x", p % 2 == 0, "not_evaluated", "role_page_not_sampled"),
                   row("c.z", p % 7 == 0, "inconclusive", "language_not_supported"), row("d.w", p > 0, "fail", "thin_sample"), row("e.v", p > 0, "not_evaluated", "not_recorded"))
    results = _p(spark, sf_dir).select(p.alias("site"), F.explode(F.filter(made, lambda x: x.isNotNull())).alias("r")).select("site", "r.*")
    return compose.limitations(read, results)


@query(f"""WITH q AS (SELECT p_partkey AS p, p_partkey % 3 AS c, p_partkey % 2 AS h, p_partkey % 5 AS m, p_partkey % 7 AS o, p_partkey % 4 AS n FROM part)
    SELECT p AS site, concat('This audit read ', {_s('n', 'page')}, ' and ran ', {_s('(o + c + 2)', 'check')}, ' on what a fetcher without scripts receives. ',
        CASE WHEN c + h + m = 0 THEN 'It raised nothing above informational.' ELSE concat('It raised ', array_to_string(list_filter([CASE WHEN c > 0 THEN concat(c, ' critical') END, CASE WHEN h > 0 THEN concat(h, ' high') END,
        CASE WHEN m > 0 THEN concat(m, ' medium') END], lambda x: x IS NOT NULL), ', '), '.') END, CASE WHEN c > 0 THEN ' Start with F-001: Mend it.' ELSE '' END, ' ', {_s('o', 'check')}, ' passed.',
        CASE WHEN c > 0 THEN concat(' ', {_s('c', 'check')}, ' had no verdict; those are gaps of the sample and no faults of the site.') ELSE '' END) AS narrative FROM q""")
def report_narrative(spark, sf_dir):
    p, none = F.col("p"), F.lit(0)
    rows = _p(spark, sf_dir)
    summary = rows.select(p.alias("site"), (p % 3).alias("critical"), (p % 2).alias("high"), (p % 5).alias("medium"), none.alias("low"), (p % 7).alias("pass"), (none + 2).alias("fail"), none.alias("inconclusive"), (p % 3).alias("not_evaluated"))
    return compose.narrative(summary, rows.where(p % 4 > 0).select(p.alias("site"), (p % 4).alias("pages")), rows.where(p % 3 > 0).select(p.alias("site"), F.lit("F-001").alias("id"), F.lit("Mend it.").alias("title")))


@query("""WITH q AS (SELECT p_partkey // 10 AS site, p_partkey % 10 AS i, p_partkey AS p FROM part), f AS (SELECT site, p, CASE WHEN p % 31 = 0 THEN 'X' WHEN p % 37 = 0 THEN 'F-001' ELSE 'F-' || lpad((i + 1)::VARCHAR, 3, '0') END AS id,
        CASE WHEN p % 19 = 0 THEN 'grave' ELSE ['critical', 'high', 'medium', 'low', 'info'][i % 5 + 1] END AS sev FROM q), n AS (SELECT site, count(*) AS n, count(*) FILTER (sev = 'critical') AS c, count(*) FILTER (sev = 'high') AS h, count(*) FILTER (sev = 'medium') AS m,
        count(*) FILTER (sev = 'low') AS l, count(*) FILTER (sev = 'info') AS i FROM f GROUP BY 1),
    d AS (SELECT site, id, p, sev, count(*) OVER (PARTITION BY site, id) AS k FROM f), g AS (SELECT *, CASE WHEN site % 4 = 1 THEN n + 1 ELSE n END AS t, CASE WHEN site % 6 = 2 THEN h + 1 ELSE h END AS sh FROM n)
    SELECT site, id AS item, 'id is not F-###' AS problem FROM d WHERE p % 31 = 0 UNION ALL SELECT site, id, 'id occurs twice' FROM d WHERE k > 1 UNION ALL SELECT site, id, 'no title' FROM d WHERE p % 17 = 0
    UNION ALL SELECT site, id, 'unknown severity' FROM d WHERE p % 19 = 0 UNION ALL SELECT site, id, 'no evidence' FROM d WHERE p % 23 = 0 UNION ALL SELECT site, id, 'no action' FROM d WHERE p % 29 = 0
    UNION ALL SELECT site, id, 'unknown priority' FROM d WHERE p % 41 = 0 UNION ALL SELECT site, 'summary', 'total is not the sum of the severities' FROM g WHERE t <> c + sh + m + l + i
    UNION ALL SELECT site, 'summary', 'total is not the number of findings' FROM g WHERE t <> n UNION ALL SELECT site, 'summary', 'count of high is not that of the findings' FROM g WHERE sh <> h""")
def validator_floor(spark, sf_dir):
    """Reports of ten findings each, of which the key spoils some."""
    p, i = F.col("p"), F.col("p") % 10
    spoil = lambda n, bad, good: F.when(p % n == 0, F.lit(bad)).otherwise(good)
    found = _p(spark, sf_dir).select(
        F.floor(p / 10).alias("site"), F.when(p % 31 == 0, "X").when(p % 37 == 0, "F-001").otherwise(F.format_string("F-%03d", i + 1)).alias("id"), spoil(17, " ", F.lit("A title")).alias("title"),
        spoil(19, "grave", F.element_at(_strings("critical", "high", "medium", "low", "info"), (i % 5 + 1).cast("int"))).alias("severity"), spoil(23, None, F.lit("seen")).alias("evidence"),
        spoil(29, "", F.lit("do it")).alias("action"), spoil(41, "urgent", F.lit("low")).alias("priority"))
    site = F.col("site")
    counts = found.groupBy("site").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "info")])
    counts = counts.withColumns({"total": F.when(site % 4 == 1, F.col("total") + 1).otherwise(F.col("total")), "high": F.when(site % 6 == 2, F.col("high") + 1).otherwise(F.col("high"))})
    return validate.floor_violations(found, counts)


@query("""WITH q AS (SELECT p_partkey AS p FROM part) SELECT p AS site, 'a' AS item, 'quick win contradicts the rule' AS problem FROM q WHERE p % 3 = 0 UNION ALL SELECT p, 'c', 'folded into no finding' FROM q WHERE p % 4 = 0
    UNION ALL SELECT p, 'b', 'kept and folded' FROM q WHERE p % 5 = 0 UNION ALL SELECT p, 'b', 'passed and a finding' FROM q WHERE p % 7 = 0 UNION ALL SELECT p, CASE WHEN p % 2 = 0 THEN 'b' ELSE '?' END, 'not the finding to start with' FROM q WHERE p % 2 = 0 OR p % 9 = 0""")
def validator_integrity(spark, sf_dir):
    """Two findings a site, a (the quick win to start with) and b, with references that the key spoils."""
    p, rows = F.col("p"), _p(spark, sf_dir)
    own = lambda check, *rest: F.struct(F.lit(check).alias("check_id"), *[x.alias(n) for n, x in zip(("severity", "confidence", "effort", "rank", "quick_win", "id"), rest, strict=True)])
    lit = F.lit
    found = rows.select(p.alias("site"), F.inline(F.array(own("a", lit("high"), lit("high"), lit("low"), lit(1), p % 3 != 0, lit("F-001")), own("b", lit("low"), lit("high"), lit("low"), lit(2), lit(False), lit("F-002")))))
    folded = rows.select(p.alias("site"), F.when(p % 5 == 0, "b").otherwise("c").alias("check_id"), lit("a").alias("folded_into")).unionByName(
        rows.where(p % 4 == 0).select(p.alias("site"), lit("c").alias("check_id"), lit("z").alias("folded_into")))
    passed = rows.select(p.alias("site"), F.when(p % 7 == 0, "b").otherwise("d").alias("check_id"))
    return validate.integrity_violations(found, folded, passed, rows.select(p.alias("site"), F.when(p % 2 == 0, "b").when(p % 9 != 0, "a").alias("start_with")))


@query("""WITH q AS (SELECT p_partkey AS p, p_partkey % 3 <> 0 AS can, p_partkey % 5 <> 0 AS said, p_partkey % 4 = 0 AS gap, p_partkey % 7 = 0 AS bare FROM part), w AS (SELECT p, can, said, gap, bare, p % 2 = 0 AS there, p % 11 <> 0 AS quoted FROM q)
    SELECT p AS site, 1 AS ord, 'answered but not answerable' AS problem FROM w WHERE NOT can AND said UNION ALL SELECT p, 1, 'not answerable but nothing is missing' FROM w WHERE NOT can AND NOT gap
    UNION ALL SELECT p, 1, 'answerable but facts are missing' FROM w WHERE can AND gap UNION ALL SELECT p, 1, 'answered without facts' FROM w WHERE can AND said AND bare UNION ALL SELECT p, 1, 'answerable but not answered' FROM w WHERE can AND NOT said
    UNION ALL SELECT p, 1, 'cites a fact that is not present: phone' FROM w WHERE can AND said AND NOT bare AND NOT there UNION ALL SELECT p, 1, 'does not quote: phone' FROM w WHERE can AND said AND NOT bare AND there AND NOT quoted
    UNION ALL SELECT p, 1, 'refers to no finding' FROM w WHERE p % 13 = 0""")
def validator_simulation(spark, sf_dir):
    p, rows = F.col("p"), _p(spark, sf_dir)
    asked = rows.select(p.alias("site"), F.lit(1).alias("ord"), (p % 3 != 0).alias("answerable"), F.when(p % 5 != 0, F.when(p % 11 != 0, "Call 020 7946.").otherwise("Call us.")).alias("answer"),
                        F.when(p % 7 == 0, _strings()).otherwise(_strings("phone")).alias("facts_used"), F.when(p % 4 == 0, _strings("email")).otherwise(_strings()).alias("missing"),
                        F.when(p % 13 == 0, "F-009").when(p % 2 == 0, "F-001").alias("see_finding"))
    facts = rows.select(p.alias("site"), F.lit("phone").alias("fact_id"), F.when(p % 2 == 0, "present").otherwise("partial").alias("status"), F.lit("020 7946").alias("value"))
    return validate.simulation_violations(asked, facts, rows.select(p.alias("site"), F.lit("F-001").alias("id")), final=True)


_CHECKS = [(i, r[0], r[3]) for i, r in enumerate(V.CHECKS)]


@query(f"""WITH q AS (SELECT p_partkey AS p, CASE WHEN p_partkey % 9 = 0 THEN 'x.y' ELSE c.check_id END AS check_id, CASE WHEN p_partkey % 9 <> 0 THEN c.top END AS top,
        ['pass', 'fail', 'inconclusive', 'not_evaluated', 'odd'][p_partkey % 5 + 1] AS status, ['critical', 'high', 'medium', 'low', 'info', 'grave'][(p_partkey // 5) % 6 + 1] AS sev, CASE WHEN p_partkey % 2 = 0 THEN 'low' ELSE 'high' END AS conf
        FROM part JOIN {_values(_CHECKS, 'k, check_id, top').replace('AS v', 'AS c')} ON c.k = p_partkey % {len(_CHECKS)}), r AS (SELECT *, ['critical', 'high', 'medium', 'low', 'info'] AS s FROM q)
    SELECT p AS site, check_id, 'unknown check' AS problem FROM r WHERE top IS NULL UNION ALL SELECT p, check_id, 'unknown status' FROM r WHERE status = 'odd' UNION ALL SELECT p, check_id, 'open without a reason' FROM r WHERE status IN ('inconclusive', 'not_evaluated') AND p % 7 = 0
    UNION ALL SELECT p, check_id, 'finding of a passed check' FROM r WHERE status = 'pass' UNION ALL SELECT p, check_id, 'open but not informational' FROM r WHERE status IN ('inconclusive', 'not_evaluated') AND sev <> 'info'
    UNION ALL SELECT p, check_id, 'value out of range' FROM r WHERE sev = 'grave' OR p % 17 = 0 UNION ALL SELECT p, check_id, 'long title or no evidence' FROM r WHERE p % 13 = 0 OR p % 19 = 0
    UNION ALL SELECT p, check_id, 'severity above its largest' FROM r WHERE status = 'fail' AND list_position(s, sev) < list_position(s, top) UNION ALL SELECT p, check_id, 'low confidence with high severity' FROM r WHERE top IS NOT NULL AND conf = 'low' AND sev IN ('critical', 'high')""")
def validator_results(spark, sf_dir):
    p = F.col("p")
    known = F.broadcast(spark.createDataFrame([(i, c) for i, c, _ in _CHECKS], "k int, own string"))
    rows = _p(spark, sf_dir).join(known, (p % len(_CHECKS)) == F.col("k")).select(
        "p", p.alias("site"), F.when(p % 9 == 0, "x.y").otherwise(F.col("own")).alias("check_id"), F.element_at(_strings("pass", "fail", "inconclusive", "not_evaluated", "odd"), (p % 5 + 1).cast("int")).alias("status"),
        F.when(p % 7 != 0, "because").alias("reason"), F.element_at(_strings("critical", "high", "medium", "low", "info", "grave"), (F.floor(p / 5) % 6 + 1).cast("int")).alias("severity"),
        F.when(p % 2 == 0, "low").otherwise("high").alias("confidence"), F.when(p % 17 == 0, "none").otherwise("low").alias("effort"), F.when(p % 13 == 0, F.repeat(F.lit("t"), F.lit(91))).otherwise("t").alias("title"),
        F.when(p % 19 != 0, "seen").alias("evidence"))
    return validate.result_violations(rows.select("site", "check_id", "status", "reason"), rows.drop("p", "reason"))


@query("""WITH q AS (SELECT p_partkey AS p, p_partkey % 3 <> 0 AS can FROM part) SELECT p AS site, CASE WHEN can AND p % 2 = 0 AND p % 5 <> 0 THEN concat('given ', p) ELSE 'own' END AS answer, CASE WHEN can AND p % 2 = 0 AND p % 5 <> 0 AND p % 4 = 0 THEN 'b' ELSE 'a' END AS used,
    CASE WHEN p % 2 = 0 THEN CASE WHEN NOT can THEN 'not answerable' WHEN p % 5 = 0 THEN 'no answer' END END AS problem FROM q UNION ALL SELECT -p - 1, NULL, NULL, 'no such question' FROM q WHERE p % 6 = 0""")
def merged_answers(spark, sf_dir):
    """Answers for every other question, some blank, some for questions that cannot be answered or do not exist."""
    p, rows = F.col("p"), _p(spark, sf_dir)
    asked = rows.select(p.alias("site"), F.lit(1).alias("ord"), (p % 3 != 0).alias("answerable"), F.lit("own").alias("answer"), _strings("a").alias("facts_used"))
    text = F.when(p % 5 == 0, "  ").otherwise(F.concat(F.lit(" given "), p.cast("string"), F.lit(" ")))
    given = rows.where(p % 2 == 0).select(p.alias("site"), F.lit(1).alias("ord"), text.alias("answer"), F.when(p % 4 == 0, _strings("b")).alias("facts_used")).unionByName(
        rows.where(p % 6 == 0).select((-p - 1).alias("site"), F.lit(1).alias("ord"), F.lit("x").alias("answer"), F.lit(None).cast("array<string>").alias("facts_used")))
    merged, rejected = validate.merge_answers(asked, given)
    return merged.join(rejected, ["site", "ord"], "full").select("site", "answer", F.array_join("facts_used", ",").alias("used"), "problem")
