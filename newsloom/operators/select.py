"""Capped selection, neighbours, related rows, prominence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[Column | str], order: list[Column], cap: Column | int, limit: int | None = None) -> DataFrame:
    """The first ``cap`` rows of each group in order, then the first ``limit`` of all."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    kept = ranked.where(F.col("__n") <= cap).drop("__n")
    return kept.orderBy(*order).limit(limit) if limit is not None else kept


def neighbours(df: DataFrame, key: str = "date") -> DataFrame:
    """df with prev and next: the keys beside its own (a row a document, so one sort is enough)."""
    w = Window.orderBy(key)
    return df.withColumn("prev", F.lag(key).over(w)).withColumn("next", F.lead(key).over(w))


def related(stories: DataFrame, most: int = 5) -> DataFrame:
    """date, id, rank, other: for each story others of its edition, those of its beat first, in order.

    The answer always lies among the first ``most`` + 1 of each beat of the edition, so a story meets
    those and not the whole edition.
    """
    first = stories.withColumn("__n", F.row_number().over(Window.partitionBy("date", "beat").orderBy("pos"))).where(F.col("__n") <= most + 1)
    a, b = stories.alias("a"), first.alias("b")
    pairs = a.join(b, (F.col("a.date") == F.col("b.date")) & (F.col("a.id") != F.col("b.id")))
    order = Window.partitionBy("a.date", "a.id").orderBy((F.col("a.beat") == F.col("b.beat")).cast("int").desc(), F.col("b.pos"))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(F.col("a.date").alias("date"), F.col("a.id").alias("id"), "rank", F.col("b.id").alias("other"))


PROMINENCE = {"lead": 0, "top": 1, "standard": 2, "brief": 3}


def front_page(stories: DataFrame) -> DataFrame:
    """stories with is_lead and slot: one lead an edition (the first marked, else the first), briefs apart."""
    level = F.coalesce(*[F.when(F.col("prominence") == k, F.lit(v)) for k, v in PROMINENCE.items()], F.lit(9))
    first = Window.partitionBy("date").orderBy((F.col("prominence") == "lead").desc(), "pos")
    out = stories.withColumn("level", level).withColumn("is_lead", F.row_number().over(first) == 1)
    return out.withColumn("slot", F.when(F.col("is_lead"), "lead").when(F.col("prominence") == "brief", "brief").otherwise("section"))


def chips(names: Column, most: int = 4) -> Column:
    """The first few names and how many more there are."""
    return F.struct(F.slice(names, 1, most).alias("shown"), F.greatest(F.lit(0), F.size(names) - most).alias("more"))
