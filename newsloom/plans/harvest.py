"""Harvest: feed items to deduplicated candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.urls import url_key
from newsloom.operators.dedup import dedupe_by_key
from newsloom.sources.feeds import parse_feed, top_by_feed


def harvest(raw: DataFrame) -> DataFrame:
    """source, discovery_only, title, url, published_at, summary, newest first.

    raw: feed_pos, source, discovery_only, xml: fetched feeds in registry order.
    """
    items = top_by_feed(parse_feed(raw), "feed_pos")
    first = dedupe_by_key(items, url_key(F.col("url")), ["feed_pos", "pos"])
    return first.orderBy(F.col("published_at").desc_nulls_last(), "feed_pos", "pos")
