"""The test tables in the shape of candidates, feeds, editions and mentions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate a document: its first sentence as title, a page's URL, an event's time."""
    docs, pages, events = (table(spark, sf_dir, t) for t in ("documents", "pages", "events"))
    n = pages.agg((F.max("page_id") + 1).alias("n")).first()["n"]
    rows = docs.withColumn("page_id", F.col("doc_id") % n).join(pages.select("page_id", "url"), "page_id").join(events.select(F.col("event_id").alias("doc_id"), "ts"), "doc_id")
    first = F.regexp_extract("text", r"^[^.\n]+", 0)
    found = F.col("doc_id") % 10 == 0
    return rows.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("pos"),
        F.to_date("ts").alias("batch"),
        "source",
        found.alias("discovery_only"),
        F.when(found, F.concat(first, F.lit(" - Outlet "), (F.col("doc_id") % 7).cast("string"))).otherwise(first).alias("title"),
        "url",
        F.col("ts").cast("timestamp").alias("published_at"),
        F.regexp_extract("text", r"\n([^\n]*)", 1).alias("summary"),
    )


CANDIDATES = r"""
candidates AS (
  SELECT doc_id AS id, doc_id AS pos, CAST(ts AS DATE) AS batch, source, doc_id % 10 = 0 AS discovery_only,
    CASE WHEN doc_id % 10 = 0 THEN regexp_extract(text, '^[^.\n]+') || ' - Outlet ' || CAST(doc_id % 7 AS VARCHAR) ELSE regexp_extract(text, '^[^.\n]+') END AS title,
    url, ts AS published_at, regexp_extract(text, '\n([^\n]*)', 1) AS summary
  FROM documents JOIN pages ON page_id = doc_id % (SELECT max(page_id) + 1 FROM pages) JOIN events ON event_id = doc_id
)"""


def feed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event as a run of its user's feed; errors are failures."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("feed"), F.struct("ts", "event_id").alias("run_at"), (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("n"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), "event_id")).alias("error"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item as a citation in the order that is its story."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(
        F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("story"), F.col("o_orderpriority").alias("beat"), F.col("l_partkey").alias("url"), F.col("l_suppkey").alias("publisher"), F.col("l_linenumber").alias("tier")
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a mention of its customer's nation."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return rows.select(F.lower("n_name").alias("slug"), F.concat("n_name", F.lit("-"), "c_mktsegment").alias("name"), F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("pos"))


MENTIONS = """
mentions AS (
  SELECT lower(n_name) AS slug, n_name || '-' || c_mktsegment AS name, CAST(o_orderdate AS DATE) AS date, o_orderkey AS pos
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def order_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a story of its day."""
    level = F.element_at(F.create_map(*[F.lit(x) for kv in {"0": "lead", "1": "top", "2": "standard", "3": "brief"}.items() for x in kv]), (F.col("o_orderkey") % 4).cast("string"))
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("beat"), level.alias("prominence"))


def edition_stories(spark: SparkSession, sf_dir: str, per_edition: int = 11) -> tuple[DataFrame, DataFrame]:
    """(editions, stories) made of documents: eleven in a row are an edition, pages are their sources."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    n = pages.agg((F.max("page_id") + 1).alias("n")).first()["n"]
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), F.floor(c / per_edition).cast("int"))
    d = docs.withColumn("date", day(F.col("doc_id"))).withColumn("pos", F.col("doc_id") % per_edition)
    d = d.withColumn("headline", F.regexp_extract("text", r"^[^.\n]+", 0)).withColumn("lines", F.split("text", "\n", -1))  # before the join: cut once, and not shuffled for those who need neither
    lines = F.col("lines")
    kind = F.when(F.col("pos") == 0, "lead").when(F.col("pos") < 5, "top").when(F.col("pos") < 7, "standard").otherwise("brief")
    p = pages.select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    src = d.select("doc_id", "date", F.posexplode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))).alias("k", "_")).withColumn("page_id", (F.col("doc_id") * 3 + F.col("k")) % n).join(p, "page_id")
    one = F.struct("k", "title", F.lit("Someone").alias("publisher"), "url", F.timestamp_add("DAY", (F.col("page_id") * 7 % 42 - 38).cast("int"), F.col("date").cast("timestamp")).alias("publishedAt"), (F.col("page_id") % 5).cast("int").alias("tier"))
    src = src.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["title"], x["publisher"], x["url"], x["publishedAt"], x["tier"])).alias("sources"))
    slug = F.concat(F.lit("story-"), (F.col("doc_id") % 97).cast("string"))
    stories = d.join(src, "doc_id").select(
        "date",
        "pos",
        F.concat_ws("-", F.col("date").cast("string"), slug).alias("id"),
        slug.alias("slug"),
        F.element_at(F.array(*map(F.lit, ("north", "south", "east", "west", "nowhere"))), (F.col("doc_id") % 5 + 1).cast("int")).alias("beat"),
        F.lit("Kicker").alias("kicker"),
        "headline",
        lines[0].alias("deck"),
        F.slice(lines, 1, 2).alias("summary"),
        F.when(kind == "brief", F.array().cast("array<string>")).otherwise(lines).alias("body"),
        F.when(F.col("doc_id") % 4 == 0, F.lit(None).cast("string")).otherwise(F.element_at(lines, -1)).alias("whyItMatters"),
        kind.alias("prominence"),
        F.lit(None).cast("timestamp").alias("publishedAt"),
        (F.col("doc_id") % 6 + 1).cast("int").alias("readMinutes"),
        F.element_at(F.array(*map(F.lit, ("high", "medium", "low"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("confidence"),
        F.array("lang").alias("entities"),
        F.array().cast("array<string>").alias("tags"),
        "sources",
    )
    editions = d.groupBy("date").agg(F.min("doc_id").alias("number")).select("date", F.when(F.col("number") % 5 == 0, F.date_add("date", 1)).otherwise(F.col("date")).alias("file_date"), "number")
    return editions, stories
