"""URL rules as a sort-merge range join (DataFrame functions only).

A rule is a host and a path prefix. Hosts are reversed label by label, so a rule's host is an
ancestor key and its path prefix p is the interval [p, p + 0xFF) of paths under that key.
Intervals under one key nest or are disjoint; their start and end events, sorted, keep a stack
whose depth is a running sum and whose top after an end is the last start of the same depth.
Pages enter the same sorted order once for each ancestor of their host and take the top.

Distinct (host, path) pairs are judged, then joined back. An ancestor that many pages share is
dealt over as many slots as its share of the points needs, and the events of its rules are
repeated for each slot; the repetition is at most the shuffle partitions in all.

Defined results: a null url or one without "://" has empty host and path; rows that repeat are
all returned; of rules with the same host and path the block stays; where no rule fits, the
verdict is `default` and rule is null; an empty table gives an empty result; further columns
of the input are not read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webgrain.llm.scratch import cut, shuffle_partitions


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first `://`, A-Z lower-cased) and path (then up to `?`, `#` or the end)."""
    full = F.coalesce(url, F.lit(""))
    part = lambda k: F.regexp_extract(full, r"(?s)^.*?://([^/?#]*)([^?#]*)", k)
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def ancestors(host: Column) -> Column:
    """The reversed keys of a host and all its parent domains."""
    labels = F.reverse(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, F.lit(1), k), "."))


def stack_events(rules: DataFrame) -> DataFrame:
    """(key, pos, top): from pos on, up to the next event under key, the innermost active rule is top (null: none)."""
    one = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        reversed_host(F.col("host")).alias("key"), F.encode("path", "UTF-8").alias("lo"),
        F.struct((F.length("host") + F.length("path")).alias("len"), F.length("host").alias("host_len"),
                 F.concat("host", "path").alias("rule"), "verdict").alias("own"))
    events = one.select("key", F.explode(F.array(
        F.struct(F.col("lo").alias("pos"), F.lit(1).alias("step"), "own"),
        F.struct(F.concat("lo", F.lit(b"\xff")).alias("pos"), F.lit(-1).alias("step"), "own"))).alias("e")).select("key", "e.*")
    deep = events.withColumn("depth", F.sum("step").over(W.partitionBy("key").orderBy("pos")))
    top = F.last(F.when(F.col("step") == 1, F.col("own")), ignorenulls=True).over(W.partitionBy("key", "depth").orderBy("pos"))
    return deep.select("key", "pos", F.when(F.col("depth") > 0, top).alias("top"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """pages: id_col, url_col. rules: host, path, verdict. Returns id_col, host, path, rule, verdict."""
    spark = pages.sparkSession
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    points = cut(rows.select("host", "path").distinct().select(
        "host", "path", F.explode(ancestors(F.col("host"))).alias("key")), "url-points")
    events = stack_events(rules)
    share = max(1.0, points.count() / shuffle_partitions(spark))
    slots = cut(events.select("key").distinct().join(points.groupBy("key").count(), "key").select(
        "key", F.ceil(F.col("count") / share).cast("int").alias("slots")), "url-slots")
    placed = points.join(slots, "key").select(
        "key", F.pmod(F.xxhash64("host", "path"), F.col("slots")).cast("int").alias("slot"),
        F.encode("path", "UTF-8").alias("pos"), F.lit(1).alias("kind"), "host", "path")
    dealt = events.join(slots, "key").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), "pos", F.lit(0).alias("kind"),
        F.struct("top").alias("state"))
    sweep = W.partitionBy("key", "slot").orderBy("pos", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    hits = (placed.unionByName(dealt, allowMissingColumns=True)
            .withColumn("active", F.last("state", ignorenulls=True).over(sweep))
            .where((F.col("kind") == 1) & F.col("active.top").isNotNull()))
    best = cut(hits.groupBy("host", "path").agg(F.max("active.top").alias("best")), "url-best")
    return rows.join(best.hint("merge"), ["host", "path"], "left").select(  # as large as there are urls under rules: never broadcast
        id_col, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")
