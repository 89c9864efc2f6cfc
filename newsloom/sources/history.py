"""A persisted index of keys seen on earlier dates, so that a new date reads only the files it can hit.

Keys lie by date and hash bucket. A small table holds a Bloom filter of each date's bucket; a date that is added again gets
a new generation of files, and the write of its filters is what makes them count, so a lost driver leaves the
earlier generation in force.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILTERS = "date date, bucket int, generation string, bits map<int,bigint>"


class SeenIndex:
    """Keys (URLs, headline tokens) by the dates that had them, below a folder that all executors share.

    ``bits`` of a filter should be some ten times the keys of a date and bucket; with fewer more files are read, never fewer keys found.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, bits: int = 1 << 15, probes: int = 3):
        self.spark, self.path, self.buckets, self.bits, self.probes = spark, path.rstrip("/"), buckets, bits, probes

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _spots(self, key: Column) -> Column:
        """The places of a key in its bucket's filter."""
        return F.array(*[F.pmod(F.xxhash64(F.lit(i), key), F.lit(self.bits)).cast("int") for i in range(self.probes)])

    def filters(self) -> DataFrame:
        """date, bucket, generation, bits (64 of them to a number)."""
        try:
            return self.spark.read.schema(FILTERS).parquet(f"{self.path}/filters")
        except AnalysisException:  # nothing was added yet
            return self.spark.createDataFrame([], FILTERS)

    def add(self, rows: DataFrame, key: str, date_col: str = "date") -> None:
        """Replace the dates that rows hold; rows without a key or a date are not indexed."""
        generation = uuid.uuid4().hex
        keys = rows.select(F.col(date_col).cast("date").alias("date"), F.col(key).cast("string").alias("key")).where("date is not null and key is not null").distinct()
        folder = f"{self.path}/keys/generation={generation}"
        keys.withColumn("bucket", self._bucket(F.col("key"))).repartition("date", "bucket").write.partitionBy("date", "bucket").parquet(folder)
        try:
            written = self.spark.read.schema("key string, date date, bucket int").parquet(folder)
        except AnalysisException:
            return
        spots = written.select("date", "bucket", F.explode(self._spots(F.col("key"))).alias("spot"))
        words = spots.groupBy("date", "bucket", F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, spot & 63)")).alias("b"))
        bits = words.groupBy("date", "bucket").agg(F.map_from_entries(F.collect_list(F.struct("word", "b"))).alias("bits"))  # at most bits / 64 entries
        out = bits.select("date", "bucket", F.lit(generation).alias("generation"), "bits")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{self.path}/filters")

    def files(self, rows: DataFrame, key: str, before: Column | None = None) -> list[str]:
        """The folders, one a date and bucket, that may hold keys of rows; dates from ``before`` on are left out."""
        asked = rows.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct()
        asked = asked.select(self._bucket(F.col("key")).alias("bucket"), self._spots(F.col("key")).alias("spots"))
        known = self.filters() if before is None else self.filters().where(F.col("date") < before)
        held = F.forall("spots", lambda s: F.coalesce(F.expr("bits")[F.shiftright(s, 6)].bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), s.bitwiseAND(F.lit(63)))) != 0, F.lit(False)))
        hit = asked.join(known, "bucket").where(held).select("date", "bucket", "generation").distinct()
        return sorted(f"{self.path}/keys/generation={r.generation}/date={r.date}/bucket={r.bucket}" for r in hit.collect())  # at most a row a date and bucket

    def lookup(self, rows: DataFrame, key: str, before: Column | None = None) -> DataFrame:
        """key, date: the dates that had keys of rows, as a join with the whole history gives them."""
        folders = self.files(rows, key, before)
        if not folders:
            return self.spark.createDataFrame([], f"{key} string, date date")
        kept = None
        for generation in sorted({f.split("/generation=")[1].split("/")[0] for f in folders}):  # a generation an addition
            base = f"{self.path}/keys/generation={generation}"
            part = self.spark.read.schema("key string, date date, bucket int").option("basePath", base).parquet(*[f for f in folders if f.startswith(base)])
            kept = part if kept is None else kept.unionByName(part)
        asked = rows.select(F.col(key).cast("string").alias(key)).distinct()
        return kept.select(F.col("key").alias(key), "date").join(asked, key, "left_semi")
