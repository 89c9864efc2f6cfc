"""Feeds as tables: parsing, the network reader, top items by feed, leads, topic searches."""

from __future__ import annotations

import hashlib
import http.client
import json
import time
import urllib.error
import urllib.request
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from newsloom.functions.dates import normalize_date
from newsloom.functions.text import decode_entities, strip_tags
from newsloom.operators.dedup import dedupe_by_key

PER_FEED, TIMEOUT = 40, 12


def field(block: Column, tag: str) -> Column:
    """The content of a block's first element of that name, or null."""
    close = tag.rsplit(":", 1)[-1]
    got = F.trim(F.regexp_extract(block, rf"(?is)<{tag}(?:[:\s][^>]*)?>(.*?)</{close}>", 1))
    return F.when(got == "", None).otherwise(got)


def link(block: Column) -> Column:
    """An entry's address: the alternate link, else one without a relation, else the first, else RSS text."""
    raw = F.regexp_extract_all(block, F.lit(r"(?is)<link\b([^>]*?)/?>"), F.lit(1))
    value = lambda x, name: F.coalesce(*[F.when(x.rlike(rf"(?is){name}\s*=\s*{q}"), F.regexp_extract(x, rf"(?is){name}\s*=\s*{q}([^{q}]*){q}", 1)) for q in ("\"", "'")])
    links = F.filter(F.transform(raw, lambda x: F.struct(value(x, "href").alias("href"), value(x, "rel").alias("rel"))), lambda x: x["href"].isNotNull())
    pick = lambda keep: F.element_at(F.filter(links, keep), 1)["href"]
    text = field(block, "link")
    some = lambda keep: F.when(F.size(F.filter(links, keep)) > 0, pick(keep))
    return F.coalesce(some(lambda x: x["rel"] == "alternate"), some(lambda x: x["rel"].isNull()), some(lambda x: F.lit(True)), F.when(text.rlike("(?i)^https?://"), text))


def parse_feed(raw: DataFrame, xml_col: str = "xml", summary_chars: int = 320) -> DataFrame:
    """One row an item or entry, in order (pos), with raw's other columns; junk gives no rows.

    References are decoded after tags are gone, so escaped markup stays as text.
    """
    blocks = F.regexp_extract_all(F.coalesce(F.col(xml_col), F.lit("")), F.lit(r"(?is)(<(item|entry)\b.*?</\2>)"), F.lit(1))
    rest = [c for c in raw.columns if c != xml_col]
    rows = raw.select(*rest, F.posexplode(blocks).alias("pos", "block"))
    b = F.col("block")
    date = F.coalesce(*(field(b, t) for t in ("pubDate", "published", "updated", "dc:date")))
    text = F.coalesce(*(field(b, t) for t in ("summary", "description", "content")))
    short = F.substring(decode_entities(strip_tags(text)), 1, summary_chars)
    items = rows.select(
        *rest,
        "pos",
        decode_entities(strip_tags(field(b, "title"))).alias("title"),
        link(b).alias("url"),
        F.when(date.isNotNull(), normalize_date(date)).alias("published_at"),
        F.when(text.isNull() | (short == ""), None).otherwise(short).alias("summary"),
    )
    return items.where("title <> '' and url <> ''")


def top_by_feed(items: DataFrame, feed: str = "source", most: int = PER_FEED) -> DataFrame:
    """The newest items of each feed; undated ones last, ties by place."""
    order = Window.partitionBy(feed).orderBy(F.col("published_at").desc_nulls_last(), "pos")
    return items.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def api_items(rows: DataFrame, base_url: str) -> DataFrame:
    """Rows of a JSON listing (id, createdAt, tags) as items; the summary is the first six tags."""
    return rows.select(
        F.col("id").alias("title"),
        F.concat(F.lit(base_url), F.col("id")).alias("url"),
        F.try_to_timestamp(F.col("createdAt")).alias("published_at"),
        F.array_join(F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 6), ", ").alias("summary"),
    )


def extract_array(c: Column, ddl: str) -> Column:
    """The JSON array between the first [ and the last ] of noisy text, or null."""
    return F.from_json(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)(\[.*\])", 1), f"array<struct<{ddl}>>")


def clean_leads(raw: DataFrame, text_col: str, run_date: str, relevant: str, search_hosts: list[str], order: list[str] = ()) -> DataFrame:
    """Leads from noisy texts: https, relevant, not a search page, one a URL; dated noon, discovery only.

    Of equal URLs the first stays, by the raw rows' ``order`` columns, then the text, then the place in it.
    """
    from newsloom.functions.urls import host_of, is_https

    rank = [F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]
    rows = raw.select(F.struct(*rank, F.col(text_col).alias("__said")).alias("answer"), F.posexplode_outer(extract_array(F.col(text_col), "title:string,url:string,date:string,source:string")).alias("pos", "x")).select("answer", "pos", "x.*")
    day = F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("date")).otherwise(F.lit(run_date))
    good = rows.where(is_https(F.col("url")) & F.col("title").rlike(relevant) & ~host_of(F.col("url")).isin(search_hosts))
    first = dedupe_by_key(good, F.col("url"), ["answer", "pos"])
    return first.select("title", "url", "source", F.to_timestamp(F.concat(day, F.lit(" 12:00:00"))).alias("published_at"), F.lit(True).alias("discovery_only"))


def fetch(url: str, timeout: float = TIMEOUT, etag: str | None = None, modified: str | None = None) -> dict:
    """One feed: ok, xml (None where it has not changed since the given marks), etag, modified, error."""
    out = {"ok": False, "xml": None, "etag": etag, "modified": modified, "error": None}
    try:
        asked = {"User-Agent": "newsloom", "Accept": "application/rss+xml, application/atom+xml, text/xml, */*"}
        asked |= {"If-None-Match": etag} if etag else {}
        asked |= {"If-Modified-Since": modified} if modified else {}
        with urllib.request.urlopen(urllib.request.Request(url, headers=asked), timeout=timeout) as got:
            return out | {"ok": True, "xml": got.read().decode("utf-8", "replace"), "etag": got.headers.get("ETag"), "modified": got.headers.get("Last-Modified")}
    except urllib.error.HTTPError as e:
        return out | {"ok": True} if e.code == 304 else out | {"error": str(e)[:200]}
    except (OSError, ValueError, http.client.HTTPException) as e:
        return out | {"error": str(e)[:200]}


class FeedSource(DataSource):
    """spark.read or readStream.format("feed"): one partition a feed address; a failure is a row with its error."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "source string, url string, ok boolean, xml string, error string"

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802 - named by Spark
        return FeedStreamReader(self.options)


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.names = (options.get("names", "").split("\n") if options.get("names") else []) or self.urls
        self.timeout = float(options.get("timeout", TIMEOUT))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(len(self.urls))]

    def read(self, partition: InputPartition):
        got = fetch(self.urls[partition.value], self.timeout)
        yield self.names[partition.value], self.urls[partition.value], got["ok"], got["xml"], got["error"]


class FeedRound(InputPartition):
    """A feed to be asked: its place in the list, and the slots of the offset before and of this one."""

    def __init__(self, feed: int, last: int | None, slot: int):
        self.feed, self.last, self.slot = feed, last, slot


class FeedStreamReader(DataSourceStreamReader):
    """Feeds asked again and again; a row for each answer that is new, and for each failure.

    The offset holds a slot of the clock for each feed, so it grows whatever was lost, and a feed that is added later is
    new by itself. What a feed answered in a slot is recorded in the shared ``spool`` folder before it is handed on, with the
    marks (ETag, date of change, digest) that the next slot asks with. A batch that is run again reads the record, not the
    feed: it has the same rows. Records before the last committed slot are removed by the task that follows them.
    Where an answer equals the last good one, or the feed says that it has not changed, there is no row.
    A feed is asked by one task a slot; speculative copies of it would ask twice, and the record that was there first counts.
    """

    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.names = (options.get("names", "").split("\n") if options.get("names") else []) or self.urls
        self.timeout, self.spool = float(options.get("timeout", TIMEOUT)), options["spool"].rstrip("/")
        self.seconds, self.now = float(options.get("seconds", 900)), options.get("now")

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        slot = int((float(self.now) if self.now else time.time()) // self.seconds)
        return dict.fromkeys(self.urls, slot)

    def partitions(self, start: dict, end: dict) -> list[FeedRound]:
        at = {u: i for i, u in enumerate(self.urls)}
        return [FeedRound(at[u], start.get(u), slot) for u, slot in end.items() if u in at and slot > start.get(u, slot - 1)]

    def _record(self, files: fs.FileSystem, path: str) -> dict | None:
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with files.open_input_stream(path) as f:
            return json.loads(f.read())

    def read(self, partition: FeedRound):
        url = self.urls[partition.feed]
        files, root = fs.FileSystem.from_uri(self.spool)
        folder = f"{root}/{hashlib.sha256(url.encode()).hexdigest()[:32]}"
        files.create_dir(folder, recursive=True)
        path = f"{folder}/{partition.slot}.json"
        found = self._record(files, path)
        if found is None:
            last = (partition.last is not None and self._record(files, f"{folder}/{partition.last}.json")) or {}
            found = fetch(url, self.timeout, last.get("etag"), last.get("modified"))
            digest = hashlib.sha256(found["xml"].encode()).hexdigest() if found["xml"] is not None else last.get("digest")
            if digest == last.get("digest"):
                found["xml"] = None
            draft = f"{path}.{uuid.uuid4().hex}"
            with files.open_output_stream(draft) as f:
                f.write(json.dumps(found | {"digest": digest}).encode())
            if files.get_file_info(path).type == fs.FileType.NotFound:
                files.move(draft, path)
            else:
                files.delete_file(draft)
                found = self._record(files, path)
        for old in files.get_file_info(fs.FileSelector(folder)):
            slot = old.base_name.split(".")[0]
            if partition.last is not None and slot.isdigit() and int(slot) < partition.last:
                files.delete_file(old.path)
        if found["xml"] is not None or not found["ok"]:
            yield self.names[partition.feed], url, found["ok"], found["xml"], found["error"]


def read_feeds(spark: SparkSession, feeds: list[tuple[str, str]], timeout: float = TIMEOUT) -> DataFrame:
    """All feeds at once, each on its own partition."""
    spark.dataSource.register(FeedSource)
    return spark.read.format("feed").option("urls", "\n".join(u for _, u in feeds)).option("names", "\n".join(n for n, _ in feeds)).option("timeout", str(timeout)).load()


def stream_feeds(spark: SparkSession, feeds: list[tuple[str, str]], spool: str, seconds: float = 900, timeout: float = TIMEOUT, now: float | None = None) -> DataFrame:
    """The answers of all feeds as a stream, each feed asked once in so many seconds; ``now`` stands for the clock."""
    spark.dataSource.register(FeedSource)
    asked = {"urls": "\n".join(u for _, u in feeds), "names": "\n".join(n for n, _ in feeds), "spool": spool, "seconds": seconds, "timeout": timeout}
    return spark.readStream.format("feed").options(**asked, **({} if now is None else {"now": now})).load()
