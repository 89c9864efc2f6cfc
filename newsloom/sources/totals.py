"""Totals of an archive that are kept up to date: a new date costs that date, grand totals are merged.

Distinct counts do not add up, sets do. A dictionary gives each publisher, URL and beat a dense number within its hash bucket, and
a date keeps the numbers it has as bitmaps, one for each 32,768 numbers of a bucket. The bitmaps of all dates
are merged bit by bit and counted, so the distinct counts are exact and no citation is read again.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.order import numbered

KINDS = ("url", "publisher", "beat")
NUMBERS = "value string, number long, kind string, bucket int"
BITS = "date date, kind string, bucket int, page long, bits binary, generation string"
COUNTS = "date date, stories long, primary_sources long, urls long, publishers long, beats long, turn long, generation string"


def bitmaps(placed: DataFrame) -> DataFrame:
    """date, kind, bucket, page, bits from distinct dates and numbers.

    Rows are dealt by page as bits, at most 32,768 to a page: bitmaps begun before the shuffle would be 4 kB for each page
    and task, so that their bytes grow with pages times tasks.
    """
    page = ["date", "kind", "bucket", "page"]
    bits = placed.select(*page[:-1], F.bitmap_bucket_number("number").alias("page"), F.bitmap_bit_position("number").alias("bit"))
    return bits.repartition(*page).groupBy(*page).agg(F.bitmap_construct_agg("bit").alias("bits"))


class ArchiveTotals:
    """Signals of each date and of all dates, below a folder that all executors share. One writer at a time.

    A lost writer does no harm: staged rows are not read again, numbers that no date uses are not counted, values that have no number yet get
    one the next time, and bitmaps count only once their generation's counts, which are written last, are there. Of a date that was
    added more than once the last generation counts. Files are by generation, so many dates at once are few files.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing was added yet
            return self.spark.createDataFrame([], schema)

    def _staged(self, df: DataFrame, name: str, generation: str) -> DataFrame:
        """df computed once, as a table of columns that only the adding of a generation reads."""
        path = f"{self.path}/staged/{generation}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _discard(self, generation: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/staged/{generation}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _bucket(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")

    def add(self, rows: DataFrame) -> None:
        """Replace the dates that rows hold: date, story, beat, url, publisher, tier, one row a citation; rows without a date are left out.

        Null stories, URLs, publishers and beats are not counted, as by a distinct count. Of the dictionary only the buckets that rows hit are read.
        """
        generation = uuid.uuid4().hex
        told = [F.col(k).cast("string").alias(k) for k in KINDS]
        rows = self._staged(rows.where("date is not null").select("date", "story", (F.col("tier") == 1).alias("first"), *told), "rows", generation)
        each = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in KINDS]))
        values = self._staged(rows.select("date", each).where("value is not null").distinct().withColumn("bucket", self._bucket(F.col("value"))), "values", generation)
        hit = [r.bucket for r in values.select("bucket").distinct().collect()]  # at most one row a bucket
        known = self._table("numbers", NUMBERS).where(F.col("bucket").isin(hit))
        asked = values.select("kind", "bucket", "value").distinct()
        new = numbered(asked.join(known, ["kind", "bucket", "value"], "left_anti"), ["kind", "bucket"], ["value"])
        last = known.groupBy("kind", "bucket").agg(F.max("number").alias("last"))
        told = new.join(last, ["kind", "bucket"], "left").select("value", (F.coalesce("last", F.lit(0)) + F.col("n")).alias("number"), "kind", "bucket")
        told = self._staged(told, "told", generation)
        told.repartitionByRange("kind", "bucket", "value").write.mode("append").partitionBy("kind", "bucket").parquet(f"{self.path}/numbers")

        numbers = self._table("numbers", NUMBERS).where(F.col("bucket").isin(hit))
        bitmaps(values.join(numbers, ["kind", "bucket", "value"])).write.parquet(f"{self.path}/bits/generation={generation}")
        plain = rows.groupBy("date", "story").agg(F.count_if("first").alias("p")).groupBy("date").agg(F.count("story").alias("stories"), F.sum("p").alias("primary_sources"))
        sizes = values.groupBy("date").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in KINDS])
        turn = (self._table("counts", COUNTS).agg(F.max("turn").alias("t")).first().t or 0) + 1
        counts = plain.join(sizes, "date", "left").na.fill(0).select("date", "stories", "primary_sources", "urls", "publishers", "beats", F.lit(turn).cast("long").alias("turn"))
        counts.write.parquet(f"{self.path}/counts/generation={generation}")
        self._discard(generation)

    def counts(self) -> DataFrame:
        """The counts of each date, as last added, with their generation."""
        whole = self._table("counts", COUNTS)
        last = whole.groupBy("date").agg(F.max_by(F.struct(*[c for c in whole.columns if c != "date"]), "turn").alias("x"))
        return last.select("date", "x.*")

    def merged(self) -> DataFrame:
        """kind, n: how many values of each kind all dates together have."""
        held = self._table("bits", BITS).join(self.counts().select("date", "generation"), ["date", "generation"], "left_semi")
        pages = held.groupBy("kind", "bucket", "page").agg(F.bitmap_or_agg("bits").alias("bits"))
        return pages.groupBy("kind").agg(F.sum(F.bitmap_count("bits")).alias("n"))

    def signals(self) -> DataFrame:
        """date, stories, sources, urls, primary_sources, publishers, beats, is_total: a row a date, and one of all dates (date null).

        sources adds up the URLs of the dates, urls counts each once. Without any date the totals are 0.
        """
        counts = self.counts()
        dates = counts.select("date", "stories", F.col("urls").alias("sources"), "urls", "primary_sources", "publishers", "beats", F.lit(0).cast("tinyint").alias("is_total"))
        distinct = self.merged().agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"{k}s") for k in KINDS])
        added = counts.agg(*[F.coalesce(F.sum(a), F.lit(0)).alias(b) for a, b in (("stories", "stories"), ("urls", "sources"), ("primary_sources", "primary_sources"))])
        total = added.crossJoin(distinct)  # one row each
        return dates.unionByName(total.select(F.lit(None).cast("date").alias("date"), "stories", "sources", "urls", "primary_sources", "publishers", "beats", F.lit(1).cast("tinyint").alias("is_total")))
