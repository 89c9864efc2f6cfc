"""Wire: filter, deduplicate by title, cap by source, newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.config import Config
from newsloom.functions.text import terms
from newsloom.functions.urls import host_of, is_https, title_key
from newsloom.operators.dedup import dedupe_by_key
from newsloom.operators.lookup import host_matches
from newsloom.operators.select import top_per_group

LIMIT, PER_SOURCE = 24, 5


def usable(candidates: DataFrame, config: Config) -> DataFrame:
    """https and on topic, by title alone."""
    relevant = F.coalesce("title", F.lit("")).rlike(terms(list(config.relevant_words), list(config.relevant_parts)))
    return candidates.where(is_https(F.col("url")) & relevant)


def wire_items(candidates: DataFrame, config: Config, publishers: DataFrame, blocked: DataFrame, limit: int | None = LIMIT, per_source: int = PER_SOURCE) -> DataFrame:
    """title, url, source, published_at and pos of the wire, in order.

    Filters first, then the first of each title in input order, then at most ``per_source`` of
    each source (a missing one is a source of its own) by time.
    """
    rows = usable(candidates, config).where(~F.coalesce("discovery_only", F.lit(False)) & ~F.coalesce("source", F.lit("")).isin(list(config.excluded_sources)))
    hosted = rows.withColumn("host", host_of(F.col("url")))
    bad = host_matches(hosted, publishers, blocked).where("blocked").select("host")
    clean = hosted.join(bad, "host", "left_anti")
    first = dedupe_by_key(clean.select("pos", "title", "url", "source", "published_at"), title_key(F.col("title")), ["pos"])
    return top_per_group(first, [F.coalesce("source", F.lit(""))], [F.col("published_at").desc_nulls_last(), F.col("pos")], per_source, limit)
