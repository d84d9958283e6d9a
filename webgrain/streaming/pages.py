"""Page checks over a stream of crawled pages: an extension, the batch engine's operators unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.operators.checks import render_state
from webgrain.operators.html import parse_pages


def read_pages(spark: SparkSession, path: str, schema: str = "page_id bigint, url string, html string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def states(pages: DataFrame) -> DataFrame:
    """(page_id, site, url, word_count, state) for each page as it arrives; repeated URLs once."""
    once = pages.dropDuplicates(["url"])
    return parse_pages(once).select("page_id", "site", "url", "word_count", render_state().alias("state"))


def site_counts(pages: DataFrame, seen_at: str, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Pages and thin pages of each site and window; pages that come later than delay are left out, as a watermark does."""
    parsed = parse_pages(pages.withWatermark(seen_at, delay))
    return parsed.groupBy(F.window(seen_at, window), "site").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("word_count") < 60).alias("thin"))
