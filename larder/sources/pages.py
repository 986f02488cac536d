"""Discovered pages: items (url, published_at, title, ord) from feeds and site maps become a list without doubles, newest first."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.urls import canonical_url


def dedupe_by_url(items: DataFrame) -> DataFrame:
    """One row per canonical URL: the first item's URL, and the first date and title that any of its items has.

    Null URLs take no part. All aggregates are partial, so a page that is listed everywhere costs one row per task.
    """
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    rows = items.where("url IS NOT NULL").withColumn("url_key", canonical_url(F.col("url")))
    return rows.groupBy("url_key").agg(first("url"), first("published_at"), first("title"))


def discover(feed: DataFrame, sitemap: DataFrame, since: datetime | None = None, limit: int = 200, wanted: Column | None = None, both: bool = False, unchanged: bool = False) -> DataFrame:
    """The newest pages since a date of those that `wanted`, a condition on url, holds for. Undated pages always pass, and come last.

    The site map counts only if the feed has no wanted page, nor was found unchanged; with both it is always added.
    """
    keep = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    fed = feed.where(keep)
    extra = sitemap.where(keep)
    if unchanged and not both:
        extra = extra.limit(0)
    elif not both:
        extra = extra.join(fed.select(F.lit(True).alias("fed")).limit(1), how="left").where("fed IS NULL").drop("fed")  # with one row at most
    top = fed.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("top"))
    extra = extra.join(top).withColumn("ord", F.col("ord") + F.col("top") + 1).drop("top")  # the feed's come first; with one row
    found = dedupe_by_url(fed.unionByName(extra))
    if since is not None:
        found = found.where(F.col("published_at").isNull() | (F.col("published_at") > F.lit(since)))
    return found.orderBy(F.col("published_at").desc_nulls_last(), "url_key").limit(limit)


def with_validators(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """pages (url and more) with the page_etag and page_last_modified that are stored for their canonical address."""
    known = stored.select(F.col("source_url").alias("__larder_key"), "page_etag", "page_last_modified")
    return pages.withColumn("__larder_key", canonical_url(F.col("url"))).join(known, "__larder_key", "left").drop("__larder_key")
