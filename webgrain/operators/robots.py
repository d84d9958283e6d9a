"""Crawler permissions: robots files as rule tables, longest match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse_robots(files: DataFrame, site: str = "site", text: str = "robots") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(agents, rules, sitemaps) of robots files: consecutive user-agent lines open a group, blank lines do not close it.

    agents: site, group_no, agent. rules: site, group_no, rule_no, allow, pattern. sitemaps: site, ord, url. The group number is a
    running count over the lines of a site.
    """
    lines = files.select(site, F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("line_no", "raw"))
    line = F.trim(F.regexp_replace(F.regexp_replace("raw", "#.*$", ""), "^[\\s﻿]+|\\s+$", ""))
    split = lines.select(site, "line_no", line.alias("line")).where(F.col("line").contains(":")).select(
        site, "line_no", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("key"),
        F.trim(F.expr("substring(line, locate(':', line) + 1)")).alias("value"))
    by_line = W.partitionBy(site).orderBy("line_no")
    agent = F.col("key") == "user-agent"
    opens = agent & ~F.coalesce(F.lag(agent).over(by_line), F.lit(False))
    numbered = split.withColumn("opens", opens).withColumn("group_no", F.sum(F.col("opens").cast("int")).over(by_line))
    agents = numbered.where(agent).select(site, "group_no", F.lower("value").alias("agent")).distinct()
    kind = F.col("key").isin("allow", "disallow") & (F.col("value") != "") & (F.col("group_no") > 0)
    pattern = F.when(F.col("value").rlike("^[/*]"), F.col("value")).otherwise(F.concat(F.lit("/"), F.col("value")))
    rules = numbered.where(kind).select(site, "group_no", F.col("line_no").alias("rule_no"), (F.col("key") == "allow").alias("allow"), pattern.alias("pattern"))
    maps = numbered.where((F.col("key") == "sitemap") & (F.col("value") != "")).select(site, F.col("line_no").alias("ord"), F.col("value").alias("url"))
    return agents, rules, maps


def decoded(path: Column) -> Column:
    return F.when(path.contains("%"), F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)).otherwise(path)


def rule_regex(pattern: Column) -> Column:
    """* matches anything, a final $ the end, everything else itself."""
    anchored = pattern.endswith("$")
    body = decoded(F.when(anchored, F.expr("substring(pattern, 1, length(pattern) - 1)")).otherwise(pattern))
    literal = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(literal, r"\*", ".*"), F.when(anchored, "$").otherwise(""))


def decide(agents: DataFrame, rules: DataFrame, asked: DataFrame, site: str = "site") -> DataFrame:
    """asked: site, token, path. Adds own_group, allowed and rule (null: none matched).

    The first group that names the token governs, else the first for *. Of its rules that match, the longest pattern wins, allow
    on a tie.
    """
    wanted = asked.select(site, "token").distinct()
    named = wanted.join(agents, site).where((F.col("agent") == F.lower("token")) | (F.col("agent") == "*"))
    star = (F.col("agent") == "*") & (F.lower("token") != "*")
    chosen = named.groupBy(site, "token").agg(F.min_by("group_no", F.struct(star, F.col("group_no"))).alias("group_no"), F.bool_or(~star).alias("own_group"))
    governed = asked.join(chosen, [site, "token"], "left")
    matched = governed.join(rules, [site, "group_no"]).where(F.regexp_like(decoded(F.col("path")), rule_regex(F.col("pattern"))))
    length = F.char_length(F.rtrim(F.col("pattern"), F.lit("$")))
    text = F.concat(F.when(F.col("allow"), "Allow: ").otherwise("Disallow: "), F.col("pattern"))
    best = matched.groupBy(site, "token", "path").agg(F.max(F.struct(length.alias("length"), F.col("allow"), text.alias("rule"))).alias("best"))
    return governed.join(best, [site, "token", "path"], "left").select(
        site, "token", "path", F.coalesce("own_group", F.lit(False)).alias("own_group"), F.coalesce("best.allow", F.lit(True)).alias("allowed"), F.col("best.rule").alias("rule"))


def grade_tokens(agents: DataFrame, rules: DataFrame, sites: DataFrame, tiers: DataFrame, key_paths: DataFrame | None = None) -> DataFrame:
    """One row for each site and known crawler: tier, own group, whether / is allowed and by which rule, key paths disallowed."""
    tokens = sites.select("site").join(F.broadcast(tiers))  # the crawlers are a fixed table of twenty rows
    paths = tokens.select("site", "token", F.lit("/").alias("path"))
    if key_paths is not None:
        paths = paths.unionByName(key_paths.join(F.broadcast(tiers.select("token"))).select("site", "token", "path"))
    decided = decide(agents, rules, paths.distinct())
    root = F.col("path") == "/"
    summed = decided.groupBy("site", "token").agg(
        F.bool_or("own_group").alias("own_group"), F.bool_and(F.when(root, F.col("allowed"))).alias("root_allowed"),
        F.max(F.when(root, F.col("rule"))).alias("root_rule"),
        F.array_sort(F.collect_set(F.when(~root & ~F.col("allowed"), F.col("path")))).alias("disallowed_key_paths"))
    return tokens.join(summed, ["site", "token"])
