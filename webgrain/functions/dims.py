"""The vocabularies as small relations. All are of fixed size and carry `ord` where list order decides."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.functions import vocab as V
from webgrain.functions.extend import REGISTERED

SEVERITIES = ("critical", "high", "medium", "low", "info")
CONFIDENCES = ("high", "medium", "low")
TIERS = ("live_answer", "index", "training_only")


def _listed(table: dict[str, Iterable[str]]) -> list[tuple[str, int, str]]:
    return [(key, i, value) for key, values in table.items() for i, value in enumerate(values)]


def _signals() -> list[tuple[str, str, int, str]]:
    out = []
    for category, kinds in V.CATEGORY_SIGNALS.items():
        for kind, values in kinds.items():
            out += [(category, kind, i, v) for i, v in enumerate(values["members"] if kind == "nav_cluster" else values)]
    return out


def _trust() -> list[tuple[str, str, str]]:
    out = [(c, "any_of", s) for c, signals in V.TRUST_SIGNALS.items() for s in signals]
    return out + [("*", kind, s) for kind, signals in V.TRUST_SIGNALS_DEFAULT.items() for s in signals]


ROWS = {
    "role_keyword": ("role string, ord int, phrase string", lambda: _listed(V.ROLE_KEYWORDS)),
    "role_slug": ("role string, ord int, slug string", lambda: _listed(V.ROLE_SLUGS)),
    "role_sitemap_pattern": ("role string, ord int, pattern string", lambda: _listed(V.ROLE_SITEMAP_PATTERNS)),
    "role": ("role string, ord int", lambda: [(r, i) for i, r in enumerate(V.ROLE_ORDER)]),
    "context_rank": ("context string, rank int", lambda: list(V.CONTEXT_RANK.items())),
    "category": ("category string, ord int", lambda: [(c, i) for i, c in enumerate(V.CATEGORY_ORDER)]),
    "category_signal": ("category string, kind string, ord int, value string", _signals),
    "score_cap": ("kind string, points int", lambda: list(V.SCORE_CAPS.items())),
    "signal_rank": ("kind string, rank int", lambda: list(V.SIGNAL_RANK.items())),
    "key_page": ("category string, ord int, role string", lambda: _listed({c: ["home", *r] for c, r in V.KEY_PAGES.items()})),
    "key_fact": ("category string, ord int, fact_id string", lambda: _listed(V.KEY_FACTS) + [(c, 100 + i, f) for i, (f, (_, categories)) in enumerate(REGISTERED.facts.items()) for c in categories]),
    "fact_role": ("fact_id string, ord int, role string", lambda: _listed(V.FACT_ROLES)),
    "audience_fact": ("category string, fact_id string", lambda: list(V.AUDIENCE_FACT.items())),
    "engagement_cap": ("check_id string, category string, cap string",
                       lambda: [(k, c, v) for k, row in V.ENGAGEMENT_CAPS.items() for c, v in zip(V.ENGAGEMENT_CAP_ORDER, row, strict=True)]),
    "severity_override": ("check_id string, category string, severity string",
                          lambda: [(k, c, s) for k, row in V.SEVERITY_OVERRIDES.items() for c, s in row.items()]),
    "cta": ("category string, ord int, phrase string", lambda: _listed(V.CTA_VOCAB)),
    "cta_lang": ("lang string, ord int, phrase string", lambda: _listed(V.CTA_VOCAB_BY_LANG)),
    "trust_signal": ("category string, kind string, signal string", _trust),
    "sim_question": ("category string, ord int, template string, fact_ids array<string>, informational boolean",
                     lambda: [(c, i, t, list(f), n) for c, rows in V.SIMULATION_QUESTIONS.items() for i, (t, f, n) in enumerate(rows)]),
    "stopword": ("lang string, ord int, word string", lambda: _listed(V.STOPWORDS)),
    "check_registry": ("check_id string, stage string, severity string, max_severity string, confidence string, effort string, scope string, ord int",
                       lambda: [(*row, i) for i, row in enumerate([*V.CHECKS, *((r.check_id, r.stage, r.severity, r.max_severity, r.confidence, r.effort, r.scope) for r in REGISTERED.rows.values())])]),
    "bot_tier": ("token string, operator string, tier string", lambda: list(V.BOT_TIERS)),
    "positive_title": ("check_id string, title string", lambda: list(V.POSITIVE_TITLES.items()) + [(r.check_id, r.passed or r.check_id) for r in REGISTERED.rows.values()]),
    "stage_tag": ("stage string, concepts array<string>, pipeline string, mode string",
                  lambda: [(s, list(V.STAGE_CONCEPTS[s]), V.STAGE_PIPELINE[s], V.STAGE_MODE[s]) for s in V.STAGE_ORDER]),
    "concept_stage": ("letter string, stage string", lambda: [(k, s) for k, stages in V.LETTER_STAGES.items() for s in stages]),
    "absence_role": ("check_id string, role string", lambda: [(k, r) for k, roles in V.ABSENCE_ROLES.items() for r in roles] + [(c.check_id, r) for c in REGISTERED.rows.values() for r in c.absent_on]),
    "second_level": ("suffix string", lambda: [(s,) for s in V.SECOND_LEVEL]),
    "cctld_language": ("tld string, lang string", lambda: list(V.CCTLD_LANGUAGE.items())),
    "schema_spec": ("type string, required array<string>, any_of array<array<string>>, recommended array<string>",
                    lambda: [(t, list(s.get("required", [])), [list(g) for g in s.get("any_of", [])], list(s.get("recommended", []))) for t, s in V.REQUIRED_PROPS.items()]),
}


def dim(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = ROWS[name]
    return spark.createDataFrame(rows(), schema)


def severity_rank(col):
    """0 (critical) to 4 (info)."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), col).cast("int") - 1


def severity_name(rank):
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), (rank + 1).cast("int"))


def confidence_rank(col):
    return F.array_position(F.array(*map(F.lit, CONFIDENCES)), col).cast("int") - 1
