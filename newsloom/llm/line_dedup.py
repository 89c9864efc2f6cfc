"""Removal of repeated passages of three or more lines.

Every three consecutive non-blank lines of a document form a window. A window that occurs more
than once anywhere keeps its first occurrence (smallest id, then place); at every later one its
three lines are covered, and the union of covered lines is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.base import written

LINES = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def without(parts: Column, gone: Column, glue: str) -> Column:
    """The parts joined again but for those numbered in gone, in time linear in both arrays."""
    left = lambda p: F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), gone), lambda i: F.get(p, i))
    return F.transform(F.array(parts), lambda p: F.when(F.size(p) == 0, "").otherwise(F.array_join(left(p), glue)))[0]  # the lambda binds parts once


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = LINES) -> DataFrame:
    """doc_id, text_key, lines (sorted numbers from 0 of the lines to remove) for documents that lose any.

    Lines are compared without the white space around them; blank ones take no part. Documents of
    fewer than ``width`` non-blank lines have no window. Rows that repeat an id with the same text
    count as one document, so neither is a repeat of the other. Null ids come first in the order.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    line = F.filter(F.transform(lines_of(text), lambda l, i: F.struct(i.alias("i"), F.trim(F.regexp_replace(l, r"[\t\r\x0B\x0C]", " ")).alias("l"))), lambda x: x["l"] != "")
    named = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), line.alias("x"))
    at = F.sequence(F.lit(1), F.size("x") - (width - 1))
    part = lambda k, j: F.element_at("x", k + F.lit(j))
    window = lambda k: F.struct(
        F.xxhash64(*[part(k, j)["l"] for j in range(width)]).alias("h1"),
        F.xxhash64(F.lit(width), *[part(k, j)["l"] for j in reversed(range(width))]).alias("h2"),
        F.array(*[part(k, j)["i"] for j in range(width)]).alias("at"),
    )
    wins = named.where(F.size("x") >= width).select("doc_id", "text_key", F.explode(F.transform(at, window)).alias("w")).select("doc_id", "text_key", "w.h1", "w.h2", "w.at")
    wins = written(wins, "windows")
    place = F.struct("doc_id", "text_key", F.col("at")[0].alias("line"))
    first = wins.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(first, "first-windows")  # a table, so that AQE can split the join at a window of very many rows
    later = wins.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.select("doc_id", "text_key", F.explode("at").alias("line")).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = LINES) -> DataFrame:
    """docs with ``text_col`` without its later repeats, plus __n_lines and __n_removed (in place of such columns of docs).

    Texts without a removal stay as they are to the byte, nulls included. A text that loses every
    line becomes empty. An empty table stays empty.
    """
    gone = covered_lines(docs, id_col, text_col, width).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("lines").alias("__lines"))
    text, removed = docs[text_col], gone["__lines"]
    key = F.xxhash64(F.coalesce(text, F.lit("")))
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]) & (key == gone["__key"]), "left")
    return joined.select(
        *[(F.when(removed.isNull(), text).otherwise(without(lines_of(text), removed, "\n")).alias(c) if c == text_col else docs[c]) for c in docs.columns if c not in ("__n_lines", "__n_removed")],
        F.when(text.isNull(), 0).otherwise(F.size(lines_of(text))).cast("long").alias("__n_lines"),
        F.coalesce(F.size(removed), F.lit(0)).cast("long").alias("__n_removed"),
    )
