"""The frames behind pages: one row a page, or a row a line of a list, with everything the page shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import slugify
from newsloom.operators.archive import with_label
from newsloom.operators.order import numbered
from newsloom.operators.select import related


def path(folder: str, name: Column) -> Column:
    """Where a page lies in the site; null where there is no name."""
    return F.concat(F.lit(f"{folder}/"), name.cast("string"), F.lit(".html"))


def story_pages(stories: DataFrame, editions: DataFrame, beats: DataFrame, most: int = 5) -> DataFrame:
    """A row a story: path, section, headline, deck, paragraphs, keypoints, why, published_at, read_minutes, n_sources,
    confidence, doubtful, topics (name, path), citations (title, publisher, url) and also (section, headline, path).

    stories as `validate` takes them; editions: date, generated_at. A story without a body shows its deck, one without a
    time its edition's. doubtful marks any confidence but high. also holds up to ``most`` others of the edition, those of
    the same section first. Null lists are empty; a story whose date has no edition has no time of its own but the story's.
    """
    labelled = with_label(stories, beats)
    short = labelled.select("date", F.col("id").alias("other"), F.struct(F.col("beat_label").alias("section"), "headline", path("story", F.col("id")).alias("path")).alias("line"))
    lines = related(stories.select("date", "id", "beat", "pos"), most).join(short, ["date", "other"])
    also = lines.groupBy("date", "id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines"))  # at most ``most`` a story
    rows = labelled.join(also, ["date", "id"], "left").join(editions.select("date", "generated_at"), "date", "left")
    body = F.coalesce(F.col("body"), F.array().cast("array<string>"))
    names = F.coalesce(F.col("entities"), F.array().cast("array<string>"))
    # slugs need a normaliser, so names are told once each and not by a function of array elements
    slugs = rows.select("date", "id", F.posexplode(names).alias("k", "name")).withColumn("one", F.struct("k", "name", path("entity", slugify(F.col("name"))).alias("path")))
    topics = slugs.groupBy("date", "id").agg(F.array_sort(F.collect_list("one")).alias("topics"))
    rows = rows.join(topics, ["date", "id"], "left")
    nothing = lambda t: F.array().cast(t)
    return rows.select(
        "date",
        "id",
        path("story", F.col("id")).alias("path"),
        F.col("beat_label").alias("section"),
        "headline",
        "deck",
        F.when(F.size(body) > 0, body).otherwise(F.array_compact(F.array("deck"))).alias("paragraphs"),
        F.coalesce("summary", nothing("array<string>")).alias("keypoints"),
        F.nullif("whyItMatters", F.lit("")).alias("why"),
        F.coalesce("publishedAt", "generated_at").alias("published_at"),
        F.col("readMinutes").alias("read_minutes"),
        F.coalesce(F.array_size("sources"), F.lit(0)).alias("n_sources"),
        "confidence",
        F.coalesce(F.col("confidence") != "high", F.lit(False)).alias("doubtful"),
        F.coalesce(F.transform("topics", lambda t: F.struct(t["name"], t["path"])), nothing("array<struct<name:string,path:string>>")).alias("topics"),
        F.coalesce(F.transform("sources", lambda s: F.struct(s["title"], s["publisher"], s["url"])), nothing("array<struct<title:string,publisher:string,url:string>>")).alias("citations"),
        F.coalesce(F.transform("lines", lambda x: x["line"]), nothing("array<struct<section:string,headline:string,path:string>>")).alias("also"),
    )


def topics_page(index: DataFrame) -> DataFrame:
    """place, name, n, last, path: the lines of the list of topics, the most mentioned first, then by name.

    index as `entity_index` gives it. Names that sort alike follow by slug. Places are counted over range partitions.
    """
    return numbered(index, [], [-F.col("n"), F.expr("collate(name, 'UNICODE')"), "slug"], "place").select("place", "name", "n", "last", path("entity", F.col("slug")).alias("path"))


def archive_page(editions: DataFrame, digests: DataFrame, wires: DataFrame) -> DataFrame:
    """A row a date that any of the three has: title, published, and path and number of entries of each, null where it did not run.

    editions: date, title, n; digests and wires: date, n; a row a date each.
    """
    day = F.date_format("date", "yyyy-MM-dd")
    a = editions.select("date", "title", F.lit(True).alias("published"), path("edition", day).alias("edition_path"), F.col("n").alias("stories"))
    b = digests.select("date", path("digest", day).alias("digest_path"), F.col("n").alias("digest_items"))
    c = wires.select("date", path("wire", day).alias("wire_path"), F.col("n").alias("wire_items"))
    rows = a.join(b, "date", "full").join(c, "date", "full")
    return rows.withColumn("published", F.coalesce("published", F.lit(False))).orderBy(F.col("date").desc())
