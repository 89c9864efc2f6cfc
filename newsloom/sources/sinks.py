"""Writers: dated partitions, gates, retention, feeds and maps of the site, pruning, hash locks."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import escape_xml
from newsloom.session import settled

RETENTION_DAYS, RSS_ITEMS = 14, 60


def write_dated(df: DataFrame, path: str, date_col: str = "date") -> None:
    """Replace just the dates that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date_col).parquet(path)


def retained(df: DataFrame, run_date: str, days: int = RETENTION_DAYS, date_col: str = "date") -> DataFrame:
    """Rows at most so many days old."""
    return df.where(F.datediff(F.lit(run_date).cast("date"), F.col(date_col)) <= days)


def expired_dates(df: DataFrame, run_date: str, days: int = RETENTION_DAYS, date_col: str = "date") -> DataFrame:
    """Dates whose partitions are to be dropped."""
    return df.where(F.datediff(F.lit(run_date).cast("date"), F.col(date_col)) > days).select(date_col).distinct()


def prune_dated(spark: SparkSession, path: str, run_date: str, days: int = RETENTION_DAYS, date_col: str = "date") -> list[str]:
    """Drop the partitions of a dated table that are too old; folders not named by a date stay. What was dropped."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    gone = []
    for status in fs.listStatus(root):  # a folder a day
        found = re.fullmatch(rf"{re.escape(date_col)}=(\d{{4}}-\d{{2}}-\d{{2}})", status.getPath().getName())
        if found and (dt.date.fromisoformat(run_date) - dt.date.fromisoformat(found[1])).days > days:
            fs.delete(status.getPath(), True)
            gone.append(found[1])
    return sorted(gone)


class StagedDates:
    """All-or-nothing replacement of the dates of a table.

    Rows are staged below the table, in a folder that readers of the table do not see. Publishing first writes the list of dates
    to be moved, which is the commit; then each date is moved. A write that ends before the list is there leaves nothing but
    staged files, one that ends after it is finished by the next `recover` (which every write begins with), so no date is ever half new.
    """

    def __init__(self, spark: SparkSession, path: str, date_col: str = "date"):
        self.spark, self.path, self.date_col = spark, path.rstrip("/"), date_col
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def stage(self, df: DataFrame) -> str:
        """Write df aside; the name of what is staged."""
        name = uuid.uuid4().hex
        df.write.partitionBy(self.date_col).parquet(f"{self.path}/_staged/{name}")
        return name

    def staged(self, name: str, df: DataFrame) -> DataFrame:
        """What was staged, with df's columns, so that a check sees the very rows that will be published."""
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/_staged/{name}")

    def commit(self, name: str) -> None:
        out = self.fs.create(self._path(f"_staged/{name}.open"), True)
        out.close()
        self.fs.rename(self._path(f"_staged/{name}.open"), self._path(f"_staged/{name}.commit"))
        self._publish(name)

    def abort(self, name: str) -> None:
        self.fs.delete(self._path(f"_staged/{name}"), True)

    def _publish(self, name: str) -> None:
        for date in self._names(f"_staged/{name}"):
            if date.startswith(f"{self.date_col}="):
                self.fs.delete(self._path(date), True)
                if not self.fs.rename(self._path(f"_staged/{name}/{date}"), self._path(date)):
                    raise OSError(f"{date} could not be moved; recover() goes on with it")
        self.fs.delete(self._path(f"_staged/{name}"), True)
        self.fs.delete(self._path(f"_staged/{name}.commit"), False)

    def recover(self) -> list[str]:
        """Finish what was committed, drop what was not; the names of what was finished. One writer a table at a time."""
        names = self._names("_staged")
        done = [n.removesuffix(".commit") for n in names if n.endswith(".commit")]
        for name in done:
            self._publish(name)
        for name in names:
            if not name.endswith(".commit") and name not in done:
                self.fs.delete(self._path(f"_staged/{name}"), True)
        return done


def gated_write(df: DataFrame, violations: DataFrame | Callable[[DataFrame], DataFrame], path: str, date_col: str = "date") -> None:
    """Write all or nothing: any error among the violations stops the write.

    ``violations``: a table, or a function of the staged rows; as a function, df is computed once and what is checked is what is published.
    """
    broken = lambda found: not found.where("severity = 'E'").isEmpty()
    refused = ValueError("the document breaks its rules; nothing was written")
    if not callable(violations) and broken(violations):
        raise refused
    table = StagedDates(df.sparkSession, path, date_col)
    table.recover()
    name = table.stage(df)
    try:
        if callable(violations) and broken(violations(table.staged(name, df))):
            raise refused
    except BaseException:
        table.abort(name)
        raise
    table.commit(name)


def upsert_snapshot(items: DataFrame, path: str, date_col: str = "date") -> bool:
    """Last state by date wins; no items or no date, no write. Whether something was written."""
    dated = settled(items.where(F.col(date_col).isNotNull()).select(date_col, "title", "url", "source", "published_at"))
    if dated.isEmpty():
        return False
    write_dated(dated, path, date_col)
    return True


def rss_items(stories: DataFrame, most: int = RSS_ITEMS) -> DataFrame:
    """The first stories, newest edition first, as RSS item elements."""
    top = stories.orderBy(F.col("date").desc(), "pos").limit(most)
    body = F.concat_ws(" ", "deck", F.concat_ws(" ", "summary"))
    when = F.date_format(F.coalesce("published_at", "generated_at"), "dd MMM yyyy HH:mm:ss 'GMT'")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), escape_xml(c), F.lit(f"</{name}>"))
    return top.select("date", "pos", F.concat(F.lit("<item>"), tag("title", F.col("headline")), tag("link", F.col("url")), tag("pubDate", when), tag("description", body), F.lit("</item>")).alias("xml"))


def sitemap(groups: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """loc, lastmod, changefreq, priority: the union of (loc, lastmod) tables with their settings."""
    out = None
    for df, freq, priority in groups:
        part = df.select("loc", "lastmod", F.lit(freq).alias("changefreq"), F.lit(priority).alias("priority"))
        out = part if out is None else out.unionByName(part)
    return out


#: (page, change frequency, priority) of a site's fixed pages, where its own are not given.
PAGES = [
    ("", "daily", "1.0"), ("archive.html", "daily", "0.6"), ("topics.html", "daily", "0.6"), ("hackathons.html", "weekly", "0.7"),
    ("methodology.html", "monthly", "0.4"), ("legal.html", "yearly", "0.3"), ("terms.html", "yearly", "0.2"), ("privacy.html", "yearly", "0.2"),
]


def site_map(spark: SparkSession, base_url: str, editions: DataFrame, stories: DataFrame, entities: DataFrame, digests: DataFrame, wires: DataFrame, pages: list[tuple[str, str, str]] = PAGES) -> DataFrame:
    """loc, lastmod, changefreq, priority of every page of a site.

    editions, digests, wires: date; stories: path, date; entities: slug, last. The digest's front page is
    there once there is a digest.
    """
    day, none = F.date_format("date", "yyyy-MM-dd"), F.lit(None).cast("date")
    at = lambda df, path, last: df.select(F.concat(F.lit(f"{base_url}/"), path).alias("loc"), last.alias("lastmod"))
    dated = lambda df, folder: at(df, F.concat(F.lit(f"{folder}/"), day, F.lit(".html")), F.col("date"))
    fixed = [(at(spark.range(1), F.lit(page), none), freq, priority) for page, freq, priority in pages]
    fixed.append((at(digests.limit(1), F.lit("digest.html"), none), "hourly", "0.6"))
    entity = at(entities, F.concat(F.lit("entity/"), F.col("slug"), F.lit(".html")), F.col("last"))
    own = [(dated(digests, "digest"), "weekly", "0.4"), (dated(wires, "wire"), "yearly", "0.2"), (entity, "weekly", "0.5"), (dated(editions, "edition"), "monthly", "0.7"), (at(stories, F.col("path"), F.col("date")), "monthly", "0.8")]
    return sitemap(fixed + own)


def orphans(existing: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Outputs that nothing expects any more."""
    return existing.join(expected.select(key), key, "left_anti")


def lock_changes(now: DataFrame, lock: DataFrame, key: str = "id", value: str = "hash") -> DataFrame:
    """key, old, new, state: added, gone, changed or same. A changed row fails a build that may not relock."""
    a, b = now.select(key, F.col(value).alias("new")), lock.select(key, F.col(value).alias("old"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "gone").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return a.join(b, key, "full").select(key, "old", "new", state.alias("state"))
