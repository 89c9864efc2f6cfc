"""Places in an order, and spells of time, without a window over a whole scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import settled


def laid_out(df: DataFrame, scope: list[str], order: list[str | Column], name: str = "n") -> DataFrame:
    """df with ``name``: numbers that ascend in the order, with gaps. Range partitions in sorted order, kept as a checkpoint.

    Rows of equal order share a range partition, so the order should tell most rows apart.
    """
    keys = [*scope, *order]
    ranged = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    return settled(ranged.withColumn("__part", F.spark_partition_id()).withColumn(name, F.monotonically_increasing_id()))


def running_count(df: DataFrame, scope: list[str], order: list[str | Column], flag: Column, name: str = "n") -> DataFrame:
    """df with ``name``: how many rows of its scope up to each row, in order, have the flag.

    Rows are counted within range partitions; a partition starts behind the counts of those before it, of which there is one row each.
    Null is a scope like any other.
    """
    rows = laid_out(df.withColumn("__flag", F.coalesce(flag.cast("int"), F.lit(0))), scope, order, "__at")
    part = [*scope, "__part"]
    counts = rows.groupBy(*part).agg(F.sum("__flag").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*scope).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(part)], F.coalesce(upto, F.lit(0)).alias("__before"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__b{i}")) for i, c in enumerate(part)])
    own = F.sum("__flag").over(Window.partitionBy(*part).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    told = rows.withColumn("__own", own).join(before, same)
    return told.withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).select(*df.columns, name)


def numbered(df: DataFrame, scope: list[str], order: list[str | Column], name: str = "n") -> DataFrame:
    """df with ``name``: 1, 2, ... in the order of each scope, as `running_count` counts."""
    return running_count(df, scope, order, F.lit(True), name)


def spells(df: DataFrame, scope: str, at: str, gap: int, name: str = "spell") -> DataFrame:
    """df with ``name``: a number that changes where rows of a scope are more than ``gap`` apart in ``at`` (an integer).

    Gaps are found within range partitions; over the border of two, the last time is carried on, a row a partition.
    """
    rows = laid_out(df, [scope], [at], "__at")
    part = [scope, "__part"]
    inside = Window.partitionBy(*part).orderBy("__at")
    ends = rows.groupBy(*part).agg(F.min(at).alias("__lo"), F.max(at).alias("__hi"))
    across = Window.partitionBy(scope).orderBy("__part")
    ends = ends.select(*part, (F.col("__lo") - F.lag("__hi").over(across) > gap).alias("__new"))
    cut = rows.withColumn("__gap", F.coalesce((F.col(at) - F.lag(at).over(inside) > gap).cast("int"), F.lit(0)))
    counts = cut.groupBy(*part).agg(F.sum("__gap").alias("__c")).join(ends, part)
    upto = F.sum("__c").over(across.rowsBetween(Window.unboundedPreceding, -1))
    begun = F.sum(F.coalesce(F.col("__new").cast("int"), F.lit(0))).over(across.rowsBetween(Window.unboundedPreceding, 0))
    offsets = counts.select(*part, (F.coalesce(upto, F.lit(0)) + begun).alias("__before"))
    told = cut.withColumn("__own", F.sum("__gap").over(inside)).join(offsets, part)
    return told.withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__own", "__before", "__gap", "__part", "__at")
