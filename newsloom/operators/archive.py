"""Roll-ups over editions, digests, wires, entities, feeds and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEAD_AFTER = 8
PASS_TOTAL, PASS_LEAST = 20, 3


def edition_signals(sources: DataFrame) -> DataFrame:
    """date, stories, urls, primary, publishers, beats and the same over all dates (date null).

    sources: date, story, beat, url, publisher, tier: one row a citation. A citation gives a row for its story, URL, publisher
    and beat each, which are made distinct by date; both levels count those, and only the values of a date are told apart again for the whole.
    """
    kinds = ("story", "url", "publisher", "beat")
    none = {k: F.lit(None).cast(sources.schema[k].dataType) for k in kinds}
    each = [F.struct(F.lit(i).alias("kind"), *[(F.col(x) if x == k else none[x]).alias(x) for x in kinds], (F.when(F.col("tier") == 1, 1).otherwise(0) if not i else F.lit(0)).alias("p")) for i, k in enumerate(kinds)]
    values = sources.select("date", F.inline(F.array(*each))).groupBy("date", "kind", *kinds).agg(F.sum("p").alias("p"))
    held = F.when(F.coalesce(*[F.col(k).isNotNull().cast("int") * F.when(F.col("kind") == i, 1) for i, k in enumerate(kinds)]) > 0, F.col("kind"))
    n = lambda i, also=F.lit(True): F.count_if((F.col("held") == i) & also)
    told = values.withColumn("held", held)
    dates = told.groupBy("date").agg(n(0, F.col("date").isNotNull()).alias("stories"), n(1).alias("urls"), F.sum("p").alias("primary_sources"), n(2).alias("publishers"), n(3).alias("beats"))
    whole = told.where("held > 0").groupBy("held", *kinds[1:]).agg(F.lit(1).alias("one")).agg(n(1).alias("urls"), n(2).alias("publishers"), n(3).alias("beats"))
    zero, yes, no = F.lit(0).cast("long"), F.lit(1).cast("tinyint"), F.lit(0).cast("tinyint")
    every = [F.struct("date", no.alias("is_total"), "stories", "urls", "primary_sources", "publishers", "beats"), F.struct(F.lit(None).cast("date").alias("date"), yes.alias("is_total"), "stories", zero.alias("urls"), "primary_sources", zero.alias("publishers"), zero.alias("beats"))]
    rows = dates.select(F.inline(F.array(*every))).unionByName(whole.select(F.lit(None).cast("date").alias("date"), yes.alias("is_total"), zero.alias("stories"), "urls", zero.alias("primary_sources"), "publishers", "beats"))
    found = rows.groupBy("date", "is_total").agg(*[F.sum(c).alias(c) for c in ("stories", "urls", "primary_sources", "publishers", "beats")])
    return found.select("date", "stories", "urls", "primary_sources", "publishers", "beats", "is_total")


def archive(editions: DataFrame, digests: DataFrame, wires: DataFrame) -> DataFrame:
    """One row a date that any of the three has, newest first."""
    a, b, c = (df.groupBy("date").agg(F.sum("n").alias(name)) for df, name in ((editions, "stories"), (digests, "digest_items"), (wires, "wire_items")))
    return a.join(b, "date", "full").join(c, "date", "full").orderBy(F.col("date").desc())


def entity_index(mentions: DataFrame) -> DataFrame:
    """slug, name (as first written), n, last: rows by mentions, then name.

    mentions: slug, name, date, pos.
    """
    out = mentions.groupBy("slug").agg(F.min_by("name", F.struct("date", "pos")).alias("name"), F.count("*").alias("n"), F.max("date").alias("last"))
    return out.orderBy(F.col("n").desc(), F.expr("collate(name, 'UNICODE')"))


def entity_items(mentions: DataFrame, most: int | None = None) -> DataFrame:
    """Each entity's mentions with their rank, newest first."""
    ranked = mentions.withColumn("rank", F.row_number().over(Window.partitionBy("slug").orderBy(F.col("date").desc(), "pos")))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def hot_entities(mentions: DataFrame, editions: int = 5, most: int = 8) -> DataFrame:
    """The most mentioned of the newest editions."""
    dates = mentions.select("date").distinct().orderBy(F.col("date").desc()).limit(editions)
    recent = mentions.join(F.broadcast(dates), "date", "left_semi")  # a handful of dates
    return recent.groupBy("slug").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "slug").limit(most)


def next_number(editions: DataFrame) -> DataFrame:
    return editions.agg((F.coalesce(F.max("number"), F.lit(0)) + 1).alias("next_number"))


def newest_snapshot(wires: DataFrame) -> DataFrame:
    """Of each date the snapshot harvested last."""
    whole = F.struct(*[F.col(c) for c in wires.columns])
    return wires.groupBy("date").agg(F.max_by(whole, F.col("harvested_at")).alias("w")).select("w.*")


def beat_coverage(stories: DataFrame, beats: DataFrame) -> DataFrame:
    """beat, n, quota, min_quota, short (below the floor), under (below the target), for every beat."""
    n = stories.groupBy(F.col("beat").alias("id")).agg(F.count("*").alias("n"))
    out = beats.join(n, "id", "left").select(F.col("id").alias("beat"), F.coalesce("n", F.lit(0)).alias("n"), "quota", "min_quota")
    return out.withColumn("short", F.col("n") < F.col("min_quota")).withColumn("under", F.col("n") < F.col("quota"))


def run_metrics(runs: DataFrame, by: list[str]) -> DataFrame:
    """Feeds, successes, failures, items and whether all failed, for each run."""
    return runs.groupBy(*by).agg(
        F.count("*").alias("feeds"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.sum("n").alias("items"), F.bool_and(~F.col("ok")).alias("all_failed")
    )


def feed_health(runs: DataFrame, dead_after: int = DEAD_AFTER) -> DataFrame:
    """feed, total_runs, consecutive_failures, last_ok, last_error, last_count, dead.

    Only three aggregates a feed: a failure is consecutive if it comes after the last success, so
    no ordered window over a feed's whole history is needed.
    runs: feed, run_at, ok, n, error.
    """
    last = runs.groupBy("feed").agg(
        F.count("*").alias("total_runs"),
        F.max(F.when(F.col("ok"), F.col("run_at"))).alias("last_ok"),
        F.max_by(F.col("error"), F.when(~F.col("ok"), F.col("run_at"))).alias("last_error"),
        F.max_by("n", "run_at").alias("last_count"),
    )
    since = runs.join(last.select("feed", F.col("last_ok").alias("__ok")), "feed").where("not ok and (__ok is null or run_at > __ok)")
    out = last.join(since.groupBy("feed").agg(F.count("*").alias("f")), "feed", "left").withColumn("consecutive_failures", F.coalesce("f", F.lit(0))).drop("f")
    return out.withColumn("dead", F.col("consecutive_failures") >= dead_after)


def feed_history(runs: DataFrame) -> DataFrame:
    """runs with the running totals: runs so far, the current streak of failures, last success and error."""
    w = Window.partitionBy("feed").orderBy("run_at").rowsBetween(Window.unboundedPreceding, 0)
    spell = F.sum(F.col("ok").cast("int")).over(w)
    out = runs.withColumn("total_runs", F.count("*").over(w)).withColumn("spell", spell)
    out = out.withColumn("last_ok", F.last(F.when(F.col("ok"), F.col("run_at")), ignorenulls=True).over(w)).withColumn("last_error", F.last("error", ignorenulls=True).over(w))
    inner = Window.partitionBy("feed", "spell").orderBy("run_at").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("streak", F.sum((~F.col("ok")).cast("int")).over(inner)).drop("spell")


def review(scores: DataFrame, marks: list[str]) -> DataFrame:
    """scores with total, least and passed: a sum high enough and no mark too low."""
    each = F.array(*[F.col(m) for m in marks])
    out = scores.withColumn("total", F.aggregate(each, F.lit(0), lambda a, x: a + x)).withColumn("least", F.array_min(each))
    return out.withColumn("passed", (F.col("total") >= PASS_TOTAL) & (F.col("least") >= PASS_LEAST))


def review_binding(reviews: DataFrame, editions: DataFrame) -> DataFrame:
    """date, state: bound, mismatch, unbound, unreadable or missing, by the hash a review was made on.

    reviews: date, reviewed, sha256, and where files may fail to parse readable.
    """
    joined = editions.join(reviews, "date", "left")
    bad = ~F.coalesce("readable", F.lit(True)) if "readable" in reviews.columns else F.lit(False)
    state = F.when(F.col("reviewed").isNull(), "missing").when(bad, "unreadable").when(F.col("sha256").isNull(), "unbound").when(F.col("sha256") != F.col("hash"), "mismatch").otherwise("bound")
    return joined.select("date", state.alias("state"))


def open_listings(listings: DataFrame, as_of: str) -> DataFrame:
    """Listings whose deadline has not passed, the nearest first."""
    return listings.where(F.col("deadline") >= F.lit(as_of).cast("date")).orderBy("deadline", "name")


def recent_stories(editions: DataFrame, stories: DataFrame, most: int = 3) -> DataFrame:
    """date, number, title, pos, prominence, headline of the newest editions, newest first: what not to repeat."""
    newest = editions.select("date", "number", "title").orderBy(F.col("date").desc()).limit(most)
    rows = stories.select("date", "pos", "prominence", "headline").join(F.broadcast(newest), "date")  # a handful of editions
    return rows.select("date", "number", "title", "pos", "prominence", "headline").orderBy(F.col("date").desc(), "pos")


def with_label(stories: DataFrame, beats: DataFrame, beat: str = "beat") -> DataFrame:
    """stories with beat_label: the section's label, or the raw id where no section has it."""
    known = beats.select(F.col("id").alias(beat), F.col("label").alias("__label"))
    return stories.join(F.broadcast(known), beat, "left").withColumn("beat_label", F.coalesce("__label", beat)).drop("__label")  # a row a section


def first_uses(citations: DataFrame) -> DataFrame:
    """url, first_date, first_id: where a source was first cited.

    citations: url, date, id, pos.
    """
    one = citations.groupBy("url").agg(F.min_by(F.struct("date", "id"), F.struct("date", "pos")).alias("f"))
    return one.select("url", F.col("f.date").alias("first_date"), F.col("f.id").alias("first_id"))


def harvest_envelope(runs: DataFrame, items: DataFrame, by: list[str]) -> DataFrame:
    """feed_count, ok_count, item_count and feeds (feed, ok, count, error) of each run, as its file's head tells them."""
    one = F.struct("feed", "ok", F.col("n").alias("count"), "error")
    told = runs.groupBy(*by).agg(F.count("*").alias("feed_count"), F.count_if("ok").alias("ok_count"), F.array_sort(F.collect_list(one)).alias("feeds"))
    return told.join(items.groupBy(*by).agg(F.count("*").alias("item_count")), by, "left").na.fill(0, ["item_count"])


def manifest(editions: DataFrame, signals: DataFrame, base_url: str) -> DataFrame:
    """A row an edition, newest first: date, number, title, url, data, and its signals.

    editions: date, number, title; signals as `edition_signals` gives them.
    """
    day = F.date_format("date", "yyyy-MM-dd")
    own = signals.where("date is not null").drop("is_total")
    rows = editions.select("date", "number", "title", F.concat(F.lit(f"{base_url}/edition/"), day, F.lit(".html")).alias("url"), F.concat(F.lit(f"{base_url}/generated/"), day, F.lit(".json")).alias("data"))
    return rows.join(own, "date", "left").orderBy(F.col("date").desc())


def manifest_head(editions: DataFrame, stories: DataFrame) -> DataFrame:
    """edition_count, story_count, latest and built_at (the newest edition's time, not the clock)."""
    head = editions.agg(F.count("*").alias("edition_count"), F.max("date").alias("latest"), F.max_by("generated_at", "date").alias("built_at"))
    return head.join(F.broadcast(stories.agg(F.count("*").alias("story_count"))))  # one row each
