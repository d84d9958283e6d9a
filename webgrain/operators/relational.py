"""Joins and aggregates that the audit's rules need and Spark has no name for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, at: str, value: str) -> DataFrame:
    """left with `value` of the last right row of the same key at or before each row: one shuffle by key, one sorted sweep, no range join."""
    a = left.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(dict(right.dtypes)[value])})
    b = right.select(on, at, F.lit(0).alias("_side"), F.col(value).alias("_value"))
    swept = W.partitionBy(on).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(f"prev_{value}", F.last(F.when(F.col("_side") == 0, F.col("_value")), ignorenulls=True).over(swept))
    return both.where("_side = 1").drop("_side", "_value")


def nearest_gap(left: DataFrame, right: DataFrame, on: str, at: str) -> DataFrame:
    """left with the smallest distance in seconds to a right row of the same key, before or after; null without one."""
    a, b = left.withColumn("_side", F.lit(1)), right.select(on, at, F.lit(0).alias("_side"))
    order = W.partitionBy(on).orderBy(at, "_side")
    own = F.when(F.col("_side") == 0, F.unix_micros(F.col(at).cast("timestamp")))
    back = F.last(own, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    turned = W.partitionBy(on).orderBy(F.desc(at), "_side").rowsBetween(W.unboundedPreceding, W.currentRow)  # a running value each way, linear in a key's rows
    ahead = F.last(own, ignorenulls=True).over(turned)
    both = a.unionByName(b, allowMissingColumns=True).withColumns({"_back": back, "_ahead": ahead})
    gap = F.least(F.unix_micros(F.col(at).cast("timestamp")) - F.col("_back"), F.col("_ahead") - F.unix_micros(F.col(at).cast("timestamp"))) / 1e6
    return both.where("_side = 1").withColumn("gap_s", gap).drop("_side", "_back", "_ahead")


def top_k(rows: DataFrame, by: str, order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def clusters(rows: DataFrame, by: list[str], least: int) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def contained_pairs(rows: DataFrame, site: str, name: str) -> DataFrame:
    """Pairs of different names of a site neither of which holds the other."""
    a, b = rows.select(site, F.col(name).alias("a")).distinct(), rows.select(site, F.col(name).alias("b")).distinct()
    return a.join(b, site).where((F.col("a") < F.col("b")) & ~F.col("a").contains(F.col("b")) & ~F.col("b").contains(F.col("a")))
