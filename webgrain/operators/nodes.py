"""Structured data at any depth: the parser walks each block once and keeps every object with its place, every leaf with its path.

nodes: ord, block, depth, top (as high as the block itself), link (steps over keys that name an owner, from a top node; null where
another key lies between), via (the key it hangs from), types, keys (those with a value), id, json.
leaves: ord, block, node (the top node's ord), path (keys and list places joined by dots), key (the nearest one), value.

A type is graded by its nearest known ancestor: itself, LocalBusiness for the kinds of local business, Organization for other kinds
of organization.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.functions import vocab as V
from webgrain.operators.facts import ORG_TYPES, TEXT_KEYS

#: Fixed value: how many owner keys may lie between a top node and the organization.
LINK_DEPTH = 3


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def graded_as(types: Column) -> Column:
    """The type whose properties a node must have: the first of its types that has rules, else its family; null for others."""
    exact = F.get(F.filter(types, lambda t: t.isin(*V.REQUIRED_PROPS)), F.lit(0))
    family = lambda known, name: F.when(F.exists(types, lambda t: t.isin(*known)), name)
    return F.coalesce(exact, family(V.LOCAL_BUSINESS_TYPES, "LocalBusiness"), family(ORG_TYPES, "Organization"))


def _rules() -> Column:
    entries = []
    for kind, spec in V.REQUIRED_PROPS.items():
        groups = F.array(*map(_strings, spec.get("any_of", []))).cast("array<array<string>>")
        entries += [F.lit(kind), F.struct(_strings(spec.get("required", [])).alias("required"), groups.alias("any_of"), _strings(spec.get("recommended", [])).alias("recommended"))]
    return F.create_map(*entries)


def lacking(nodes: Column) -> Column:
    """For each graded top node: block, type (its first own type), as_type, id (or the node's text where it has none), missing, unmet (groups of which it has none, joined by "|")."""
    rules = _rules()

    def of(n: Column) -> Column:
        kind = graded_as(n["types"])
        rule = F.element_at(rules, kind)
        return F.struct(n["block"].alias("block"), F.get(n["types"], F.lit(0)).alias("type"), kind.alias("as_type"), F.coalesce(n["id"], F.substring(n["json"], 1, 500)).alias("id"),
                        F.array_except(rule["required"], n["keys"]).alias("missing"),
                        F.transform(F.filter(rule["any_of"], lambda g: ~F.arrays_overlap(g, n["keys"])), lambda g: F.array_join(g, "|")).alias("unmet"))
    graded = F.filter(nodes, lambda n: n["top"] & graded_as(n["types"]).isNotNull())
    return F.filter(F.transform(graded, of), lambda m: (F.size(m["missing"]) > 0) | (F.size(m["unmet"]) > 0))


def owners(allow_person: Column | None = None) -> Column:
    """The nodes that say who is behind a page: organizations at the top of a block or hanging from one over at most LINK_DEPTH owner keys; persons too where allowed."""
    person = F.lit(False) if allow_person is None else F.coalesce(allow_person, F.lit(False))
    return F.filter("nodes", lambda n: (n["link"] <= LINK_DEPTH) & (F.exists(n["types"], lambda t: t.isin(*ORG_TYPES)) | (person & F.array_contains(n["types"], "Person"))))


def distinct_types() -> Column:
    """All types of a page's nodes, each once, in the order in which they appear."""
    return F.array_distinct(F.flatten(F.transform("nodes", lambda n: n["types"])))


def leaf_strings(keys: tuple[str, ...] = TEXT_KEYS) -> Column:
    """The strings under the keys, at any depth, in order."""
    return F.transform(F.filter("leaves", lambda x: x["key"].isin(*keys)), lambda x: x["value"])


def values_of(key: str) -> Column:
    """All string values of a key, at any depth, in order."""
    return leaf_strings((key,))


def has_key(key: str) -> Column:
    """Whether any object of the page has a value under the key."""
    return F.exists("nodes", lambda n: F.array_contains(n["keys"], key))


def jsonld_walk(docs: DataFrame, *keep: str) -> DataFrame:
    """One row a leaf of the structured data: the kept columns, block, path, key, value."""
    return docs.select(*keep, F.inline("leaves")).select(*keep, "block", "path", "key", "value")


def incomplete_nodes(docs: DataFrame, *keep: str) -> DataFrame:
    """One row a graded top node that lacks properties."""
    return docs.select(*keep, F.inline(lacking(F.col("nodes"))))
