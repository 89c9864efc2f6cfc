"""Event clusters of headlines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import cluster_tokens
from newsloom.operators.order import laid_out, numbered, spells
from newsloom.session import settled

SIMILARITY, SHARED, WINDOW_HOURS = 0.32, 2, 60
UNDATED = "2000-01-01"
#: Items of a spell that one task passes over.
ONE_TASK = 50_000


def fold(tokens: list[set[str]], seconds: list[float], similarity: float, shared: int, window: float) -> list[int]:
    """For each item the number of the first cluster it fits, in order of arrival.

    A cluster keeps the union of its tokens and its time span; an inverted index limits the
    clusters to look at to those that share a token.
    """
    words: list[set[str]] = []
    low: list[float] = []
    high: list[float] = []
    index: dict[str, set[int]] = {}
    out = []
    for own, t in zip(tokens, seconds, strict=True):
        found = -1
        for k in sorted(set().union(*(index.get(w, ()) for w in own))) if own else ():
            both = len(own & words[k])
            if both >= shared and both / len(own | words[k]) >= similarity and high[k] - window <= t <= low[k] + window:
                found = k
                break
        if found < 0:
            found = len(words)
            words.append(set())
            low.append(t)
            high.append(t)
        words[found] |= own
        low[found], high[found] = min(low[found], t), max(high[found], t)
        for w in own:
            index.setdefault(w, set()).add(found)
        out.append(found)
    return out


def cluster_greedy(
    df: DataFrame,
    batch: str,
    item: str,
    title: str,
    published: str,
    order: list[str | Column],
    similarity: float = SIMILARITY,
    shared: int = SHARED,
    window_hours: float = WINDOW_HOURS,
    one_task: int = ONE_TASK,
) -> DataFrame:
    """df with cluster (a number within its batch), as one ordered pass over each batch gives it.

    Items farther apart in time than the window cannot share a cluster, so a batch is divided at its longer gaps, exactly.
    Spells of at most ``one_task`` items are passed over by a task each, larger ones by `fold_rounds`; both give the
    same clusters. Missing dates count as the start of 2000, so they meet each other only.
    Clusters are numbered in order of arrival within their batch.
    """
    reach = int(window_hours * 3.6e9)
    at = F.unix_micros(F.coalesce(F.col(published).cast("timestamp"), F.lit(UNDATED).cast("timestamp")))
    narrow = df.select(batch, item, cluster_tokens(F.col(title)).alias("tokens"), at.alias("at"), F.struct(*order).alias("__order"))
    rows = spells(laid_out(narrow, [batch], ["__order"]).drop("__order", "__part"), batch, "at", reach)
    sizes = settled(rows.groupBy(batch, "spell").agg(F.count("*").alias("__size")))
    rows = rows.join(sizes, [batch, "spell"])
    types = dict(df.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        got = fold([set(t) for t in pdf["tokens"]], [a / 1e6 for a in pdf["at"]], similarity, shared, window_hours * 3600)
        first = pdf.groupby(got)["n"].transform("min")
        return pd.DataFrame({batch: pdf[batch], item: pdf[item], "first": first})

    small = rows.where(F.col("__size") <= one_task).drop("__size")
    found = small.groupBy(batch, "spell").applyInPandas(one, f"{batch} {types[batch]}, {item} {types[item]}, first long")
    if not sizes.where(F.col("__size") > one_task).isEmpty():
        large = fold_rounds(rows.where(F.col("__size") > one_task).drop("__size"), [batch, "spell"], similarity, shared, reach)
        found = found.unionByName(large.select(batch, item, F.col("c").alias("first")))
    found = settled(found)
    leaders = numbered(found.select(batch, "first").distinct(), [batch], ["first"], "cluster")
    found = found.join(leaders, [batch, "first"]).select(batch, item, (F.col("cluster") - 1).alias("cluster"))
    return df.join(found, [batch, item])


def fold_rounds(rows: DataFrame, scope: list[str], similarity: float, shared: int, reach: int, told: list[int] | None = None) -> DataFrame:
    """rows (scope, n, tokens, at and others) with c, the n of the first item of the cluster that `fold` puts each in.

    A speculative parallel fold. Every item chooses among the clusters that the round before gives, as they were when it
    came: only members of smaller n count, so a change reaches items of larger n alone. Items whose clusters changed choose again, until nothing
    changes. Then each item has chosen by the final choices of all before it, which is the ordered pass; a round settles at least the first
    unsettled item, and as guesses are mostly right few rounds are needed. ``told`` gets the number of items that chose in each.

    An item shares at least ``similarity`` of its tokens with its cluster, so one of its rarest tokens is among
    them. Its cluster's first item lies within ``reach`` of it, so both are joined by word and slot of time. And a cluster of more than size / similarity tokens takes no item of that size, so of each only the
    tokens that came first are kept, a bounded number. Nothing needs all members of a cluster in one place.
    """
    s = scope
    rows = settled(rows)
    most = rows.agg(F.max(F.size("tokens")).alias("m")).first().m or 0
    cap = int(most / similarity) + 1
    words = rows.select(*s, "n", F.explode("tokens").alias("w"))
    often = words.groupBy(*s, "w").agg(F.count("*").alias("df"))
    ranked = words.join(often, [*s, "w"]).groupBy(*s, "n").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("by"))
    keep = F.size("by") - F.greatest(F.ceil(F.size("by") * similarity - 1e-9).cast("int"), F.lit(max(shared, 1))) + 1
    asks = ranked.where(keep > 0).select(*s, "n", F.explode(F.slice("by", 1, keep)).alias("x")).select(*s, "n", F.col("x.w").alias("w"))
    slot = F.floor(F.col("at") / max(1, reach))
    beside = F.explode(F.array(*[slot + k for k in (-1, 0, 1)])).alias("slot")
    probes = settled(asks.join(rows.select(*s, "n", "at"), [*s, "n"]).select(*s, "n", "w", "at", beside))
    leaders = rows.select(*s, F.col("n").alias("c"), slot.alias("slot"), F.col("at").alias("led"))
    near = F.abs(F.col("at") - F.col("led")) <= reach
    alike = rows.groupBy(*s, "tokens").agg(F.min("n").alias("c"))  # the first guess: equal titles lie together
    now = settled(rows.join(alike, [*s, "tokens"]))
    met = affected = None
    while True:
        occ = settled(now.select(*s, "c", "n", F.explode("tokens").alias("w")).groupBy(*s, "c", "w").agg(F.min("n").alias("first")).join(leaders, [*s, "c"]))
        if met is not None:
            dirty = settled(moved.select(*s, "n", F.explode(F.array("c", "old")).alias("c")).groupBy(*s, "c").agg(F.min("n").alias("since")))  # noqa: F821 - set by the round before
            later = F.col("n") > F.col("since")
            again = probes.join(occ.join(dirty, [*s, "c"]), [*s, "w", "slot"]).where(near & later).select(*s, "n").unionByName(met.join(dirty, [*s, "c"]).where(later).select(*s, "n"))
            affected = settled(again.distinct())
            if told is not None:
                told.append(affected.count())
        asking = probes if affected is None else probes.join(affected, [*s, "n"], "left_semi")
        pairs = settled(asking.join(occ, [*s, "w", "slot"]).where(near & (F.col("first") < F.col("n"))).select(*s, "n", "c").distinct())
        place = Window.partitionBy(*s, "c").orderBy("first", "w")
        early = occ.withColumn("__r", F.row_number().over(place)).where(F.col("__r") <= cap + 1)
        held = early.groupBy(*s, "c").agg(F.collect_list(F.struct("first", "w")).alias("held"))
        span = now.groupBy(*s, "c").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
        seen = pairs.join(rows.select(*s, "n", "tokens", "at"), [*s, "n"]).join(held.join(span, [*s, "c"]), [*s, "c"])
        seen = seen.withColumn("then", F.expr("transform(filter(held, h -> h.first < n), h -> h.w)"))
        both = F.size(F.array_intersect("tokens", "then"))
        fits = (F.size("then") <= cap) & (both >= shared) & (both / (F.size("tokens") + F.size("then") - both) >= similarity)
        fitting = settled(seen.where(fits).select(*s, "n", "c", "at", ((F.col("hi") - reach <= F.col("at")) & (F.col("at") <= F.col("lo") + reach)).alias("sure")))
        good = fitting.where("sure").select(*s, "n", "c").unionByName(_in_time(fitting.where("not sure"), now, s, reach))
        chosen = good.groupBy(*s, "n").agg(F.min("c").alias("__c"))
        told_all = rows.select(*s, "n") if affected is None else affected
        choice = told_all.join(chosen, [*s, "n"], "left").select(*s, "n", F.coalesce("__c", "n").alias("__c"))
        after = settled(now.withColumnRenamed("c", "old").join(choice, [*s, "n"], "left").withColumn("c", F.coalesce("__c", "old")).drop("__c"))
        moved = settled(after.where("c <> old").select(*s, "n", "c", "old"))
        now = after.drop("old")
        met = pairs if met is None else settled(met.join(affected, [*s, "n"], "left_anti").unionByName(pairs))
        if moved.isEmpty():
            return now


def _in_time(doubtful: DataFrame, members: DataFrame, s: list[str], reach: int) -> DataFrame:
    """The (n, c) of which no earlier member lies farther away in time than ``reach``.

    Members are summed up by slots of a 64th of the reach; only a slot that the border divides is looked at member by member.
    """
    slot = F.floor(F.col("at") / max(1, reach // 64))
    told = members.select(*s, "c", slot.alias("slot"), F.col("at").alias("at2"), F.col("n").alias("n2"))
    slots = told.groupBy(*s, "c", "slot").agg(F.min("n2").alias("n2"), F.min("at2").alias("lo"), F.max("at2").alias("hi"))
    over, under = F.col("at") + reach, F.col("at") - reach
    hits = doubtful.join(slots, [*s, "c"]).where((F.col("n2") < F.col("n")) & ((F.col("hi") > over) | (F.col("lo") < under)))
    beyond = (F.col("lo") > over) | (F.col("hi") < under)
    divided = hits.where(~beyond).select(*s, "c", "slot", "n", "at").join(told, [*s, "c", "slot"]).where((F.col("n2") < F.col("n")) & ((F.col("at2") > over) | (F.col("at2") < under)))
    broken = hits.where(beyond).select(*s, "n", "c").unionByName(divided.select(*s, "n", "c"))
    return doubtful.join(broken, [*s, "n", "c"], "left_anti").select(*s, "n", "c")


def similar_pairs(df: DataFrame, batch: str, item: str, title: str, published: str, similarity: float = SIMILARITY, shared: int = SHARED, window_hours: float = WINDOW_HOURS) -> DataFrame:
    """a, b: all pairs of items of one batch alike in title and time (order does not matter).

    Other semantics than `cluster_greedy`, for batches beyond one task. Sets alike by at least s share a token
    among the first n - ceil(s n) + 1 of an order common to the batch (rarest first), so only those propose
    pairs; and pairs lie in the same slot of time or in neighbouring ones, which divides a frequent token.
    """
    reach = int(window_hours * 3.6e9)
    at = F.unix_micros(F.coalesce(F.col(published).cast("timestamp"), F.lit(UNDATED).cast("timestamp")))
    rows = df.select(batch, F.col(item).alias("id"), cluster_tokens(F.col(title)).alias("tokens"), at.alias("at")).where(F.size("tokens") >= shared)
    words = rows.select(batch, "id", "at", "tokens", F.explode("tokens").alias("w"))
    often = words.groupBy(batch, "w").agg(F.count("*").alias("df"))
    ranked = words.join(often, [batch, "w"]).groupBy(batch, "id", "at", "tokens").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("s"))
    keep = F.size("s") - F.ceil(F.size("s") * similarity).cast("int") + 1
    probes = ranked.select(batch, "id", "at", "tokens", F.floor(F.col("at") / max(1, reach)).alias("slot"), F.explode(F.slice("s", 1, keep)).alias("x")).select(batch, "id", "at", "tokens", "slot", F.col("x.w").alias("w"))
    other = probes.select(batch, "w", F.col("id").alias("id2"), F.col("at").alias("at2"), F.col("tokens").alias("tokens2"), F.explode(F.array(*[F.col("slot") + k for k in (-1, 0, 1)])).alias("slot"))
    both = F.size(F.array_intersect("tokens", "tokens2"))
    every = F.size("tokens") + F.size("tokens2") - both
    near = probes.join(other, [batch, "w", "slot"]).where((F.col("id") < F.col("id2")) & (F.abs(F.col("at") - F.col("at2")) <= reach))
    return near.where((both >= shared) & (both / every >= similarity)).select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()
