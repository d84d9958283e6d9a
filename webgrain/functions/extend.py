"""What users add to an audit: checks of pages, detectors of facts and whole probes, registered by id.

A check's columns join the one projection over pages that all checks share, its registry row joins the table that grading reads; a
detector's candidates join those of all facts; a probe is a function of the prepared pages and the sites that returns results. What
is registered counts for plans that are built afterwards, and forget() takes it away again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from webgrain.functions import vocab as V


@dataclass(frozen=True)
class CheckRow:
    """A check's row: what grading, folding and reports need to know of it. absent_on: roles whose pages could show the thing, for checks that claim an absence from the site."""
    check_id: str
    stage: str
    severity: str
    max_severity: str
    confidence: str = "medium"
    effort: str = "medium"
    scope: str = "per-page"
    passed: str = ""
    title: str = ""
    action: str = ""
    verify: str = ""
    absent_on: tuple[str, ...] = ()

    def __post_init__(self):
        levels = ("critical", "high", "medium", "low", "info")
        if not re.fullmatch(r"[a-z]{2}\.[a-z][a-z0-9_]*\.[a-z][a-z0-9_]*", self.check_id):
            raise ValueError(f"no check id: {self.check_id}")
        if self.stage not in V.STAGE_ORDER or {self.severity, self.max_severity} - set(levels) or self.confidence not in levels[1:4] or self.effort not in (*levels[1:4], "n/a"):
            raise ValueError(f"{self.check_id}: a value out of range")
        if levels.index(self.severity) < levels.index(self.max_severity):
            raise ValueError(f"{self.check_id}: severity above its largest")


@dataclass(frozen=True)
class Flag:
    """A page check over a prepared page: whether the page is judged, whether it fails, how certainly (null: as the registry says), what it shows."""
    judged: Column
    failed: Column
    confidence: Column | None = None
    evidence: Column | None = None


@dataclass
class Extensions:
    rows: dict[str, CheckRow] = field(default_factory=dict)
    page_checks: dict[str, Callable[[], Flag]] = field(default_factory=dict)
    detectors: dict[str, Callable[[], list[tuple[int, tuple[str, ...], int, str, Column]]]] = field(default_factory=dict)
    facts: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = field(default_factory=dict)
    probes: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = field(default_factory=dict)


REGISTERED = Extensions()


def _row(row: CheckRow) -> None:
    if row.check_id in REGISTERED.rows or any(row.check_id == c[0] for c in V.CHECKS):
        raise ValueError(f"{row.check_id} is registered already")
    REGISTERED.rows[row.check_id] = row


def check(row: CheckRow):
    """Decorates a function without arguments that returns the Flag of a page check."""
    def add(f: Callable[[], Flag]) -> Callable[[], Flag]:
        _row(row)
        REGISTERED.page_checks[row.check_id] = f
        return f
    return add


def detector(name: str):
    """Decorates a function without arguments that returns candidates: (pass, preferred roles, place in the page, source, value) over a page with `text`."""
    def add(f):
        if name in REGISTERED.detectors:
            raise ValueError(f"{name} is registered already")
        REGISTERED.detectors[name] = f
        return f
    return add


def fact(fact_id: str, detectors: Sequence[str], categories: Sequence[str] = ()) -> None:
    """A fact that the first of the detectors to find something states; key fact of the categories."""
    if fact_id in REGISTERED.facts:
        raise ValueError(f"{fact_id} is registered already")
    REGISTERED.facts[fact_id] = tuple(detectors), tuple(categories)


def probe(name: str, rows: Sequence[CheckRow]):
    """Decorates a function of (prepared pages, sites) that returns results of the checks: site, check_id, status, reason, pages, roles, confidence, detail, evidence."""
    def add(f):
        if name in REGISTERED.probes:
            raise ValueError(f"{name} is registered already")
        for row in rows:
            _row(row)
        REGISTERED.probes[name] = f
        return f
    return add


def forget(*names: str) -> None:
    """Take away checks, detectors, facts and probes by their names."""
    for table in vars(REGISTERED).values():
        for name in names:
            table.pop(name, None)
