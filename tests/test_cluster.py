import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import cluster, order


def batch_rows(n, seed, vocabulary=60, hours=400):
    r = random.Random(seed)
    word = lambda: f"w{min(int(r.expovariate(0.08)), vocabulary)}"
    topics = [[word() for _ in range(6)] for _ in range(max(3, n // 12))]
    rows = []
    for i in range(n):
        words = r.choice(topics)[: r.randint(1, 6)] + [word() for _ in range(r.randint(0, 3))] if r.random() < 0.8 else []
        rows.append((i, r.randint(0, n), [*dict.fromkeys(words)], int(r.random() * hours * 3.6e9)))
    return rows


def by_fold(rows, similarity, shared, reach):
    rows = sorted(rows, key=lambda x: (x[1], x[0]))
    got = cluster.fold([set(x[2]) for x in rows], [x[3] / 1e6 for x in rows], similarity, shared, reach / 1e6)
    first = {}
    for g, x in zip(got, rows, strict=True):
        first.setdefault(g, x[0])
    return {x[0]: first[g] for g, x in zip(got, rows, strict=True)}


@pytest.mark.parametrize("n,seed,hours,similarity", [(400, 1, 400, 0.32), (300, 2, 70, 0.32), (250, 3, 4000, 0.5)])
def test_rounds_equal_the_ordered_pass(spark, n, seed, hours, similarity):
    rows = batch_rows(n, seed, hours=hours)
    reach = int(60 * 3.6e9)
    df = spark.createDataFrame([("b", *x) for x in rows], "batch string, id long, pos long, tokens array<string>, at long")
    laid = order.laid_out(df, ["batch"], ["pos", "id"])
    told = []
    out = cluster.fold_rounds(laid.drop("__part"), ["batch"], similarity, 2, reach, told)
    names = {r.n: r.id for r in laid.collect()}
    assert {r.id: names[r.c] for r in out.collect()} == by_fold(rows, similarity, 2, reach)
    assert len(told) < 40 and told[-1] < n  # later rounds ask few items


def test_either_way_gives_the_same_clusters(spark):
    """Two batches, equal titles, missing dates and titles; spells in one task and in rounds."""
    r = random.Random(9)
    words = "flood river dam opens market falls election vote court rules storm coast team wins final rate rise bank".split()
    rows = [(b, i, " ".join(r.choice(words) for _ in range(r.randint(2, 7))) if r.random() < 0.9 else None, None if r.random() < 0.1 else f"2026-01-{r.randint(1, 28):02d} {r.randint(0, 23):02d}:00:00", i) for b in ("x", "y") for i in range(120)]
    df = spark.createDataFrame(rows, "batch string, id long, title string, published string, pos long")
    one, rounds = (cluster.cluster_greedy(df, "batch", "id", "title", "published", ["pos"], one_task=n).select("batch", "id", "cluster").orderBy("batch", "id").collect() for n in (1000, 0))
    assert one == rounds and len({(r.batch, r.cluster) for r in one}) > 10
    assert cluster.cluster_greedy(df.where("false"), "batch", "id", "title", "published", ["pos"], one_task=0).count() == 0


def test_numbers_and_spells_over_range_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") % 3).alias("s"), F.col("id").alias("v"), (F.col("id") + F.when(F.col("id") >= 500, 100).otherwise(0)).alias("at"))
    got = {(r.s, r.v): r.n for r in order.numbered(df, ["s"], ["v"]).collect()}
    assert got == {(i % 3, i): i // 3 + 1 for i in range(1000)}
    cut = {r.v: r.spell for r in order.spells(df, "s", "at", 50).collect()}
    assert all(len({cut[i] for i in part if i % 3 == s}) == 1 for part in (range(500), range(500, 1000)) for s in range(3))
    assert all(cut[s] != cut[600 + s] for s in range(3))
