"""Contiguous shards of near-equal bytes by global prefix sums (DataFrame functions only).

Rows are dealt into ranges of the id, each range is summed on its own, and the running sum of
the few range totals turns local running sums into global ones. A row goes to the shard in
whose equal share of all bytes its middle byte lies, so a cut is off its target by half a
document at most and shards stay contiguous in id order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.base import bytes_of, written

OVERHEAD = 16


def byte_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, rank, shard, slot for every row of docs.

    Size is the text's UTF-8 bytes plus ``overhead``; a null text counts no bytes, a null id sorts
    first. Equal ids are ordered by checksum, then size; wholly equal rows are interchangeable.
    An empty table gives an empty result, and other columns of docs are not read.

    Three passes over a narrow written table (id, size, checksum): range totals, first ranks of
    shards, result. What is broadcast has one row for each range partition or each shard.
    """
    data = bytes_of(F.col(text_col))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(data) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    ranged = written(narrow.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sizes")

    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    base = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("base_bytes"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("base_rows"),
        F.sum("part_bytes").over(every).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.withColumn("upto", F.sum("size").over(inside))
        .withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
        .join(F.broadcast(base), "part")
        .withColumn("rank", F.col("base_rows") + F.col("nth") - 1)
        .withColumn("shard", F.expr(f"cast(((base_bytes + upto) * 2 - size) * {int(n_shards)} div (total * 2) as int)"))
        .select("doc_id", "size", "text_crc32", "rank", "shard")
    )
    first = placed.groupBy("shard").agg(F.min("rank").alias("first_rank"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "rank", "shard", (F.col("rank") - F.col("first_rank")).alias("slot"))
