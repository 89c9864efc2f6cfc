"""Scores and confidence of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.config import Patterns, Weights
from newsloom.functions.dates import clamp, recency
from newsloom.functions.urls import is_institutional
from newsloom.operators.cluster import UNDATED
from newsloom.operators.lookup import UNKNOWN_TIER


def publisher_identity(publisher: Column, host: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(publisher, F.lit("")), F.nullif(host, F.lit("")), F.lit("")))


def substance(title: Column, first_party: Column, patterns: Patterns) -> Column:
    """Reporting (a quantity, something happened) against corporate prose, from a neutral half."""
    text = F.coalesce(title, F.lit(""))
    has = lambda p: text.rlike(f"(?i){p}").cast("int")
    return clamp(F.lit(0.5) + 0.25 * has(patterns.quantity) + 0.25 * has(patterns.event) - 0.3 * has(patterns.corporate) - 0.25 * first_party.cast("int"))


def urgency(title: Column, fresh: Column, patterns: Patterns) -> Column:
    """Something broke (1) or shipped (0.6), as far as it is fresh."""
    text = F.coalesce(title, F.lit(""))
    base = F.when(text.rlike(f"(?i){patterns.breaking}"), 1.0).when(text.rlike(f"(?i){patterns.release}"), 0.6).otherwise(0.0)
    return base * clamp(fresh)


def cluster_stats(items: DataFrame, keys: list[str]) -> DataFrame:
    """One row a cluster: publishers, best tier, newest, novelty, best item, confidence of its citable members.

    items: id, pos, title, url, published_at, tier, publisher, host, beat, citable, seen.
    """
    tier = F.coalesce("tier", F.lit(UNKNOWN_TIER))
    who = publisher_identity(F.col("publisher"), F.col("host"))
    at = F.coalesce(F.col("published_at").cast("timestamp"), F.lit(UNDATED).cast("timestamp"))
    rank = F.struct(tier.alias("t"), (-F.unix_micros(at)).alias("a"), F.col("pos"))
    return items.groupBy(*keys).agg(
        F.count("*").alias("n_items"),
        F.count_distinct(who).alias("publishers"),
        F.min(tier).alias("best_tier"),
        F.max("published_at").alias("newest"),
        F.bool_and(~F.col("seen")).alias("novel"),
        F.bool_or("citable").alias("any_citable"),
        F.min_by(F.struct("id", "title", "url"), rank).alias("best"),
        F.min_by(F.when(F.col("citable"), F.struct("id", "title", "url", "published_at")), F.when(F.col("citable"), rank)).alias("best_citable"),
        F.count_distinct(F.when(F.col("citable"), who)).alias("citable_publishers"),
        F.min(F.when(F.col("citable"), tier)).alias("best_citable_tier"),
        F.min("pos").alias("first_pos"),
    )


def score_clusters(stats: DataFrame, now: Column, max_age_hours: float, weights: Weights = Weights(), patterns: Patterns = Patterns()) -> DataFrame:  # noqa: B008
    """stats with the seven terms and their weighted score."""
    first_party = (F.col("publishers") < 2) & (F.col("best_tier") == 1) & ~is_institutional(F.col("best.url"))
    out = (
        stats.withColumn("recency", recency(F.col("newest"), now, max_age_hours))
        .withColumn("corroboration", F.least(F.col("publishers"), F.lit(3)) / 3)
        .withColumn("source_quality", F.greatest(F.lit(0.0), 1 - (F.col("best_tier") - 1) / 3))
        .withColumn("novelty", F.col("novel").cast("int"))
        .withColumn("diversity", F.col("publishers") / F.col("n_items"))
        .withColumn("first_party", first_party)
        .withColumn("substance", substance(F.col("best.title"), F.col("first_party"), patterns))
        .withColumn("urgency", urgency(F.col("best.title"), F.col("recency"), patterns))
    )
    w = weights
    return out.withColumn(
        "score",
        F.col("corroboration") * w.corroboration
        + F.col("substance") * w.substance
        + F.col("urgency") * w.urgency
        + F.col("recency") * w.recency
        + F.col("source_quality") * w.source_quality
        + F.col("novelty") * w.novelty
        + F.col("diversity") * w.publisher_diversity,
    )


def confidence(publishers: Column, best_tier: Column) -> Column:
    """Confirmed by two publishers of which one at least is of the two upper tiers."""
    return F.when((publishers >= 2) & (best_tier <= 2), "confirmed").otherwise("single-source")


def mode_first(items: DataFrame, keys: list[str], value: str, pos: str = "pos") -> DataFrame:
    """Of each group the most frequent value; ties go to the one seen first."""
    n = items.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return n.groupBy(*keys).agg(F.max_by(F.col(value), F.struct("n", -F.col("first"))).alias(value))
