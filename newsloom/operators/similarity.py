"""Similar headlines and shared runs of words, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import overlap_tokens, word_list
from newsloom.session import settled


def first_restated(docs: DataFrame, id_col: str, title: Column, order: str, at_least: float = 0.6) -> DataFrame:
    """id, at, earlier, earlier_at, similarity: the first earlier headline whose token sets overlap by more than that.

    Equal token sets are compared once: of each set only its first headline can be the first that another restates, so copies
    cost a row each and never a pair. Prefix filter: sets alike by more than s share a token among the first n - ceil(s n) + 1 of a
    common order (rarest first), so only those tokens propose pairs, and hot tokens hardly ever; the places of a pair's
    first common token bound the overlap, so most pairs are dropped before their sets are compared.
    """
    rows = settled(docs.select(F.col(id_col).alias("id"), F.col(order).alias("at"), F.array_sort(overlap_tokens(title)).alias("tokens"))).where("size(tokens) > 0 and id is not null and at is not null")
    sets = settled(rows.groupBy("tokens").agg(F.min(F.struct("at", "id")).alias("first")).withColumn("set", F.monotonically_increasing_id()))
    words = sets.select("set", F.explode("tokens").alias("w"))
    often = words.groupBy("w").agg(F.count("*").alias("df"))
    ranked = words.join(often, "w").groupBy("set").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("s"))
    n = F.size("s")
    probes = sets.join(ranked, "set").select("set", "first", "tokens", n.alias("n"), F.posexplode(F.slice("s", 1, n - F.ceil(n * at_least).cast("int") + 1)).alias("place", "x"))
    probes = probes.select("set", "first", "tokens", "n", (F.col("n") - F.col("place")).alias("rest"), F.col("x.w").alias("w"))
    a, b = probes.alias("a"), probes.alias("b")
    once = F.expr("b.n < a.n or (b.n = a.n and b.set < a.set)")
    enough = (F.col("b.n") > F.col("a.n") * at_least) & (F.least("a.rest", "b.rest") > (F.col("a.n") + F.col("b.n")) * (at_least / (1 + at_least)) - 1e-9)
    both = F.size(F.array_intersect("a.tokens", "b.tokens"))
    alike = a.join(b, (F.col("a.w") == F.col("b.w")) & once & enough).withColumn("similarity", both / (F.col("a.n") + F.col("b.n") - both)).where(F.col("similarity") > at_least)
    link = lambda x, y: F.struct(F.col(f"{x}.set").alias("set"), F.col(f"{y}.first").alias("first"), "similarity")
    links = alike.select(F.inline(F.array(link("a", "b"), link("b", "a")))).unionByName(sets.select("set", "first", F.lit(1.0).alias("similarity")).where(F.lit(at_least < 1)))
    best = links.groupBy("set").agg(F.min(F.struct("first", "similarity")).alias("m"))
    got = rows.join(sets.select("set", "tokens").join(best, "set"), "tokens").where(F.col("m.first") < F.struct("at", "id"))
    return got.select("id", "at", F.col("m.first.id").alias("earlier"), F.col("m.first.at").alias("earlier_at"), "m.similarity")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, also where f uses it for each element of a list."""
    return F.element_at(F.transform(F.array(value), f), 1)


def anchors(df: DataFrame, key: str, text: Column, n: int, g: int, side: str) -> DataFrame:
    """The minimisers of a text: of each n words the run of g words whose hash is least, the first of equals.

    {side}_id, {side}_at, h (the hash of the run), before and after (hashes of all words from the anchor before, and up to
    the one after), {side}_back and {side}_on (hashes of the n - g words to either side, nearest first).
    Words are hashed once; a text of fewer than n words has no anchors.
    """
    hashes = F.transform(word_list(text), lambda w: F.xxhash64(w))
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (g - 1)), lambda i: F.struct(F.xxhash64(*[F.get(w, i + (j - 1)) for j in range(g)]).alias("h"), i.alias("at")))
    window = lambda gs, i: F.least(*[F.get(gs, i + (j - 1)) for j in range(n - g + 1)]) if n > g else F.get(gs, i - 1)
    places = lambda w, gs: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: window(gs, i)["at"]))
    least = lambda w, gs: F.transform(places(w, gs), lambda at: F.get(gs, at - 1))  # noqa: E731 - distinct numbers, as distinct structs would be compared pair by pair

    def told(w: Column, marks: Column) -> Column:
        def one(m: Column, k: Column) -> Column:
            at, prior, following = m["at"], F.when(k > 0, F.get(marks, k - 1)["at"]), F.get(marks, k + 1)["at"]
            back = F.least(at - 1, F.lit(n - g))
            before = F.when(prior.isNotNull(), F.xxhash64(F.slice(w, F.coalesce(prior, at), at - F.coalesce(prior, at))))
            after = F.when(following.isNotNull(), F.xxhash64(F.slice(w, at, F.coalesce(following, at) - at + g)))
            return F.struct(m["h"].alias("h"), at.alias("at"), before.alias("before"), after.alias("after"), F.reverse(F.slice(w, at - back, back)).alias("back"), F.slice(w, at + g, n - g).alias("on"))

        return F.transform(marks, one)

    whole = lambda w: F.when(F.size(w) >= n, _once(_once(grams(w), lambda gs: least(w, gs)), lambda marks: told(w, marks)))
    found = df.select(F.col(key).alias(f"{side}_id"), F.explode_outer(_once(hashes, whole)).alias("x")).where("x is not null")  # the plain form would test the list first, which computes it twice
    return found.select(f"{side}_id", F.col("x.at").alias(f"{side}_at"), "x.h", "x.before", "x.after", F.col("x.back").alias(f"{side}_back"), F.col("x.on").alias(f"{side}_on"))


def _equal_words(a: str, b: str) -> Column:
    """How many words two lists of hashes begin with in common."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def shared_runs(left: DataFrame, right: DataFrame, left_id: str, left_text: Column, right_id: str, right_text: Column, more_than: int = 7) -> DataFrame:
    """left_id, right_id, run_len, run_end: the longest common run of words of each pair beyond ``more_than``.

    A common run of n = more_than + 1 words has the same anchor on both sides, so equal anchors propose the places. Within a longer run the
    anchors follow each other alike on both sides: such a pair neither begins nor ends a run and is not even formed, as
    the kinds of an anchor (its hash and the hashes up to its neighbours) are joined before their places. What is left are the
    ends of runs, whose words reach less than n - g beyond an anchor. So rows come in proportion to runs, not to words, and a
    passage that very many texts share costs a row for each pair that shares it. Words are told apart by 64 bits of hash,
    over at least n words in a row. Of equally long runs the one that ends first on the left counts.
    """
    n = more_than + 1
    g = max(1, n // 2)
    a, b = anchors(left, left_id, left_text, n, g, "left"), anchors(right, right_id, right_text, n, g, "right")
    kind = ["h", "before", "after"]
    a, b = settled(a.join(b.select("h").distinct(), "h", "left_semi")), settled(b)
    kinds = a.select(*kind).distinct().withColumnsRenamed({"before": "lb", "after": "la"}).join(b.select(*kind).distinct().withColumnsRenamed({"before": "rb", "after": "ra"}), "h")
    alike_before, alike_after = (F.coalesce(F.col(f"l{x}") == F.col(f"r{x}"), F.lit(False)) for x in "ba")
    kinds = kinds.withColumn("goes_on", alike_after).where(~(alike_before & alike_after))
    ends = kinds.alias("k").join(a.alias("l"), F.expr("k.h = l.h and k.lb <=> l.before and k.la <=> l.after")).drop("before", "after").select("k.*", "left_id", "left_at", "left_back", "left_on")
    ends = ends.alias("k").join(b.alias("r"), F.expr("k.h = r.h and k.rb <=> r.before and k.ra <=> r.after"))
    ends = ends.select("left_id", "right_id", "left_at", "goes_on", (F.col("left_at") - F.col("right_at")).alias("diag"), (F.col("left_at") - _equal_words("left_back", "right_back")).alias("lo"), (F.col("left_at") + (g - 1) + _equal_words("left_on", "right_on")).alias("hi"))
    w = Window.partitionBy("left_id", "right_id", "diag").orderBy("left_at")
    joined = F.coalesce(F.lag("goes_on").over(w) | (F.col("lo") <= F.lag("hi").over(w) + 1), F.lit(False))
    runs = ends.distinct().withColumn("new", (~joined).cast("int")).withColumn("run", F.sum("new").over(w)).groupBy("left_id", "right_id", "diag", "run").agg((F.max("hi") - F.min("lo") + 1).alias("run_len"), F.max("hi").alias("run_end"))
    runs = runs.where(F.col("run_len") >= n)
    best = runs.groupBy("left_id", "right_id").agg(F.max_by(F.struct("run_len", "run_end"), F.struct("run_len", -F.col("run_end"))).alias("m"))
    return best.select("left_id", "right_id", F.col("m.run_len").cast("long").alias("run_len"), F.col("m.run_end").cast("long").alias("run_end"))
