"""Keep-first deduplication, id collisions, corroborators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import squash
from newsloom.operators.order import numbered, running_count
from newsloom.session import settled


def dedupe_by_key(df: DataFrame, key: Column, order: list[str | Column]) -> DataFrame:
    """Of each key the first row in order; rows with an empty or null key go.

    A minimum by group with map-side combining, so a key with very many rows costs one row a task.
    """
    rows = df.withColumn("__key", key).where("__key is not null and __key <> ''")
    whole = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    return rows.groupBy("__key").agg(F.min_by(whole, rank).alias("r")).select("r.*")


def append_new(known: DataFrame, leads: DataFrame, key: str = "url") -> DataFrame:
    """Known rows and the leads whose key is not known yet."""
    return known.unionByName(leads.join(known.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def suffix_collisions(df: DataFrame, id_col: str, order: list[str], within: list[str] = ()) -> DataFrame:
    """The nth row of an id gets -n; a suffixed id that is itself taken moves on to the next free number.

    Where no number is taken n itself is free. Else the taken numbers of an id leave gaps: the ith of them (from 0), less i, is
    the first n that it moves on by one. So rows and these marks are laid out together by number, and a row moves on by as
    many marks as come up to it. Numbers and marks are counted over range partitions, so an id with very many rows
    or taken numbers is no task of its own.
    """
    scope = [*within, id_col]
    once = numbered(df, scope, list(order), "__n")
    base, number = F.regexp_extract(id_col, r"^(.*)-\d+$", 1), F.regexp_extract(id_col, r"-([1-9]\d{0,8})$", 1)
    held = df.select(*within, base.alias("__base"), F.nullif(number, F.lit("")).cast("long").alias("__k")).where("__base <> '' and __k >= 2").distinct()
    held = settled(held.withColumnRenamed("__base", id_col).join(df.select(*scope).distinct(), scope, "left_semi"))
    if held.isEmpty():
        moved = once.withColumn("__before", F.lit(0))
    else:
        gaps = numbered(held, scope, ["__k"], "__i").select(*scope, (F.col("__k") - F.col("__i") + 1).alias("__number"), F.lit(0).alias("__side"))
        both = once.withColumn("__number", F.col("__n")).withColumn("__side", F.lit(1)).unionByName(gaps, allowMissingColumns=True)
        moved = running_count(both, scope, ["__number", "__side"], F.col("__side") == 0, "__before").where("__side = 1")
    new = F.when(F.col("__n") == 1, F.col(id_col)).otherwise(F.concat(F.col(id_col), F.lit("-"), (F.col("__n") + F.col("__before")).cast("string")))
    return moved.withColumn(id_col, new).select(*df.columns)


def corroborators(names: Column, cited: Column, most: int = 6) -> Column:
    """Names not cited already, one a squashed form: its first place, its last spelling."""
    held = lambda c: F.exists(cited, lambda q: squash(q).contains(squash(c)) | squash(c).contains(squash(q)))
    fresh = F.filter(names, lambda c: c.isNotNull() & ~held(c))
    forms = F.array_distinct(F.transform(fresh, squash))
    return F.slice(F.transform(forms, lambda k: F.element_at(F.filter(fresh, lambda c: squash(c) == k), -1)), 1, most)
