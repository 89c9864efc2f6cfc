"""Digest: candidates to clustered, ranked, capped, source-attributed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.config import Config
from newsloom.functions import text as T
from newsloom.functions.dates import round3
from newsloom.operators import cluster, rank
from newsloom.operators.dedup import corroborators, suffix_collisions
from newsloom.operators.lookup import classify, with_publisher_tier
from newsloom.operators.select import top_per_group
from newsloom.plans.wire import usable
from newsloom.session import settled

MAX_AGE_HOURS, SOURCES = 48, 4


def enrich(candidates: DataFrame, config: Config, beats: DataFrame, publishers: DataFrame, blocked: DataFrame) -> DataFrame:
    """Usable candidates with host, tier, publisher, beat and citable.

    Blocked, unclassified and anonymous aggregator items go. Discovery-only items take the outlet
    their title names; they count for corroboration but are never cited.
    """
    rows = with_publisher_tier(usable(candidates, config), F.col("url"), publishers, blocked).where("not blocked")
    rows = classify(rows, "id", F.concat_ws(" ", "title", "summary"), beats).where("beat is not null")
    via = T.via_publisher(F.col("title"))
    named = F.when(F.col("discovery_only"), via).otherwise(F.col("publisher"))
    return rows.withColumn("publisher", named).withColumn("citable", ~F.col("discovery_only")).where("publisher is not null").drop("blocked")


def clustered(items: DataFrame) -> DataFrame:
    """items with cluster, by one pass over each batch, newest first as harvested."""
    return cluster.cluster_greedy(items, "batch", "id", "title", "published_at", [(-F.unix_micros(F.col("published_at"))).alias("t"), F.col("pos")])


def scored(items: DataFrame, seen: DataFrame, now: Column, config: Config, max_age_hours: float = MAX_AGE_HOURS) -> DataFrame:
    """One row a citable cluster: stats, voted beat, score terms, score, confidence."""
    known = seen.select("url").distinct().withColumn("__seen", F.lit(True))
    marked = items.join(known, "url", "left").withColumn("seen", F.coalesce("__seen", F.lit(False))).drop("__seen")
    stats = rank.cluster_stats(marked, ["batch", "cluster"]).where("any_citable")
    voted = rank.mode_first(marked, ["batch", "cluster"], "beat")
    out = rank.score_clusters(stats.join(voted, ["batch", "cluster"]), now, max_age_hours, config.weights, config.patterns)
    return out.withColumn("confidence", rank.confidence(F.col("citable_publishers"), F.col("best_citable_tier")))


def select_items(ranked: DataFrame, beats: DataFrame, by_batch: bool = True) -> DataFrame:
    """The best clusters of each beat (and batch) up to its cap."""
    caps = beats.select(F.col("id").alias("beat"), F.col("pos").alias("beat_pos"), "digest_quota")
    rows = ranked.join(F.broadcast(caps), "beat")  # a row a section
    group = ["batch", "beat"] if by_batch else ["beat"]
    return top_per_group(rows, group, [F.col("score").desc(), F.col("first_pos")], F.col("digest_quota"))


def project(chosen: DataFrame, items: DataFrame, most_sources: int = SOURCES) -> DataFrame:
    """Digest items: id, slug, title, confidence, score, sources and corroborating names."""
    tier = F.coalesce("tier", F.lit(4))
    at = F.coalesce(F.col("published_at").cast("timestamp"), F.lit(cluster.UNDATED).cast("timestamp"))
    src = F.struct(tier.alias("t"), (-F.unix_micros(at)).alias("a"), "pos", "title", "publisher", "url")
    named = F.struct("pos", F.when(~F.col("citable"), F.col("publisher")).alias("name"))
    parts = items.groupBy("batch", "cluster").agg(F.array_sort(F.collect_list(F.when(F.col("citable"), src))).alias("src"), F.array_sort(F.collect_list(named)).alias("names"))
    joined = chosen.join(parts, ["batch", "cluster"]).withColumn("sources", F.transform(F.slice("src", 1, most_sources), lambda s: F.struct(s["title"], s["publisher"], s["url"], s["t"].alias("tier"))))
    slugged = joined.withColumn("slug", T.digest_slug(F.col("best_citable.title"))).withColumn("id", F.concat_ws("-", F.col("batch").cast("string"), "slug"))
    unique = suffix_collisions(slugged, "id", ["beat_pos", "first_pos"], ["batch"])
    cited = F.transform(F.col("sources"), lambda s: s["publisher"])
    return unique.select(
        "batch",
        "id",
        F.expr("substring(id, 12)").alias("slug"),
        "beat",
        F.col("best_citable.title").alias("title"),
        F.col("best_citable.published_at").alias("published_at"),
        "confidence",
        round3(F.col("score")).alias("score"),
        corroborators(F.transform(F.col("names"), lambda x: x["name"]), cited).alias("corroborated_by"),
        "sources",
    )


def digest(candidates: DataFrame, seen: DataFrame, now: Column, config: Config, beats: DataFrame, publishers: DataFrame, blocked: DataFrame, max_age_hours: float = MAX_AGE_HOURS) -> DataFrame:
    """The whole pipeline; ``now`` is a column over batch (the run date's noon), never the clock."""
    items = settled(clustered(enrich(candidates, config, beats, publishers, blocked)))  # read by scores, votes and sources
    return project(select_items(scored(items, seen, now, config, max_age_hours), beats), items)
