"""Source tiers by host and topics by vocabulary."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import class_tokens
from newsloom.functions.urls import host_of, host_suffixes
from newsloom.session import settled

#: Rows of a configuration table up to which it is broadcast.
SMALL = 100_000
UNKNOWN_TIER = 4


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A broadcast hint if a table is known to be small: its rows are counted up to the bound."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def host_matches(hosts: DataFrame, publishers: DataFrame, blocked: DataFrame) -> DataFrame:
    """host, tier, publisher, blocked for each distinct host.

    A publisher matches its own host and all below it; the first in the list wins. The suffix
    condition becomes an equality on the exploded suffixes, so no nested loop is needed.
    """
    each = hosts.select("host").distinct().select("host", F.explode(host_suffixes(F.col("host"))).alias("suffix"))
    book = publishers.select(F.col("host").alias("suffix"), "list_pos", "name", "tier")
    bad = blocked.select(F.col("host").alias("suffix")).distinct().withColumn("bad", F.lit(True))
    met = each.join(small(book), "suffix", "left").join(small(bad), "suffix", "left")
    found = met.groupBy("host").agg(F.min_by(F.struct("name", "tier"), F.col("list_pos")).alias("p"), F.coalesce(F.bool_or("bad"), F.lit(False)).alias("blocked"))
    tier = F.when(F.col("blocked"), None).when(F.col("host") == "", UNKNOWN_TIER).otherwise(F.coalesce("p.tier", F.lit(UNKNOWN_TIER)))
    return found.select("host", tier.alias("tier"), F.coalesce("p.name", "host").alias("publisher"), "blocked")


def with_publisher_tier(df: DataFrame, url: Column, publishers: DataFrame, blocked: DataFrame) -> DataFrame:
    """df with host, tier, publisher and blocked; unknown hosts are tier 4, blocked ones have none."""
    hosted = df.withColumn("host", host_of(url))
    return hosted.join(host_matches(hosted, publishers, blocked), "host", "left")


def _told_apart(beats: DataFrame) -> Column:
    """A number of each id, told apart by a hash: the first seed under which the ids of this table do not collide."""
    ids = beats.select("id").distinct()
    numbers = (F.xxhash64(F.lit(seed), "id") for seed in count())
    return next(x for x in numbers if ids.groupBy(x).count().where("count > 1").isEmpty())


def beat_vocabulary(beats: DataFrame) -> DataFrame:
    """token, beat, pos, vocab_size, distinctive: each beat's words, from its keywords or else its queries.

    A word is distinctive if the keywords of this beat have it and those of no other. The table may be of any size: a word's
    beats are told by the smallest and largest of their numbers, and a beat gets its own single words as one list, so
    a word that all have is no hot key and the rows of the result are not shuffled.
    """
    number = _told_apart(beats)
    once = lambda c: F.explode_outer(F.array(c))  # noqa: E731 - a generator's column is computed once, however often it is used
    none = F.array().cast("array<string>")
    head, rest = class_tokens(F.concat_ws(" ", "label", "blurb")), F.when(F.size("keywords") > 0, none).otherwise(class_tokens(F.concat_ws(" ", "queries")))
    own = settled(beats.select("id", "pos", number.alias("number"), class_tokens(F.concat_ws(" ", "keywords")).alias("own"), F.array_union(head, rest).alias("head")))  # read twice, and texts are cut once
    by_word = own.where("id is not null").select("number", F.explode_outer("own").alias("token")).where("token is not null").groupBy("token").agg(F.min("number").alias("number"), F.max("number").alias("last"))
    single = by_word.where("number = last").groupBy("number").agg(F.collect_list("token").alias("single"))
    words = own.join(single, "number", "left").select("id", "pos", once(F.array_union("own", "head")).alias("tokens"), "own", "single")
    words = words.withColumn("single", once(F.coalesce(F.array_intersect("own", "single"), none)))
    told = lambda c, yes: F.transform(c, lambda w: F.struct(w.alias("token"), F.lit(yes).alias("distinctive")))
    rows = words.select("id", "pos", F.size("tokens").alias("vocab_size"), F.explode_outer(F.concat(told("single", True), told(F.array_except("tokens", "single"), False))).alias("x")).where("x is not null")
    return rows.select("x.token", F.col("id").alias("beat"), "pos", "vocab_size", "x.distinctive")


def classify(df: DataFrame, id_col: str, text: Column, beats: DataFrame, min_overlap: int = 2) -> DataFrame:
    """df with beat: the beat of most overlap against the root of its vocabulary's size, or null.

    The first beat wins ties. It is taken only with that much overlap or with a word no other beat has.
    """
    vocabulary = small(beat_vocabulary(beats))
    tokens = df.select(id_col, F.explode(class_tokens(text)).alias("token"))
    met = tokens.join(vocabulary, "token").groupBy(id_col, "beat", "pos", "vocab_size").agg(F.count("*").alias("overlap"), F.bool_or("distinctive").alias("own"))
    order = F.struct((F.col("overlap") / F.sqrt("vocab_size")).alias("score"), (-F.col("pos")).alias("first"))
    best = met.groupBy(id_col).agg(F.max_by(F.struct("beat", "overlap", "own"), order).alias("b"))
    taken = best.where((F.col("b.overlap") >= min_overlap) | F.col("b.own")).select(id_col, F.col("b.beat").alias("beat"))
    return df.join(taken, id_col, "left")
