"""Date-named JSON documents: editions, digests, wire snapshots."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMED = r"(\d{4}-\d{2}-\d{2})\.json$"
DATE = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def checked_date(text: str) -> str:
    """A date parameter, or ValueError."""
    if not DATE.match(text):
        raise ValueError(f"not a date: {text!r}")
    return text


def read_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """date, doc, raw of every date-named JSON file; a file that does not parse has a null doc."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder).select("value", F.col("_metadata.file_name").alias("file"))
    named = files.where(F.col("file").rlike("^" + NAMED))
    return named.select(
        F.to_date(F.regexp_extract("file", NAMED, 1)).alias("date"),
        F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("doc"),
        F.col("value").alias("raw"),
    )


def newest_first(docs: DataFrame) -> DataFrame:
    return docs.orderBy(F.col("date").desc())


def latest(docs: DataFrame) -> DataFrame:
    """The newest readable document."""
    return docs.where("doc is not null").orderBy(F.col("date").desc()).limit(1)


def before(docs: DataFrame, date: str) -> DataFrame:
    """Readable documents older than a date; with a date-partitioned table only those are read."""
    return docs.where((F.col("date") < F.lit(checked_date(date)).cast("date")) & F.col("doc").isNotNull())
