"""Connected components of a link table, wholly on executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.base import discard, written

EDGE = "u long, v long"
#: Links that one task holds (16 bytes each) and settles at once.
ONE_TASK = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) of the graph with links a-b."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)].copy(), at[len(a) :].copy()
    root = np.arange(len(nodes))
    while True:  # hook the larger root to the smaller, then jump pointers
        rx, ry = root[x], root[y]
        lo, hi = np.minimum(rx, ry), np.maximum(rx, ry)
        open_ = lo != hi
        if not open_.any():
            break
        np.minimum.at(root, hi[open_], lo[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        x, y = x[open_], y[open_]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each partition's links only a spanning star forest, at bounded memory."""
    names = ["u", "v"]
    u = v = np.empty(0, np.int64)
    for batch in batches:
        u = np.concatenate([u, batch.column(0).to_numpy(zero_copy_only=False)])
        v = np.concatenate([v, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(u) > 2_000_000:
            u, v = forest(u, v)
            if len(u) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names)
                u = v = np.empty(0, np.int64)
    u, v = forest(u, v)
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names)


def connected_components(links: DataFrame, a: str = "u", b: str = "v", max_rounds: int = 100, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node of at least one link; component is its smallest node.

    Alternating large and small stars (Kiveris et al., 2014): each round is two aggregations
    with map-side combining and two joins with their results as written tables, so a node with
    very many links is pre-aggregated and AQE can split its join. Each partition's links are first cut down to a spanning
    forest; if no more than ``one_task`` links are left, one task makes them into stars, which needs no rounds.
    Every round's links are a written table, so a lost executor costs one round at most.

    Null ends and links of a node with itself are ignored; repeated links change nothing.
    """
    raw = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now = written(raw.mapInArrow(_contract, EDGE), "links")
    if now.count() <= one_task:
        once = written(now.coalesce(1).mapInArrow(_contract, EDGE), "links")
        discard(now)
        now, max_rounds = once, 0
    sign = None
    for _ in range(max_rounds):
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = written(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
        large = both.join(least, "x").where("y > x and y <> m").select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "links")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        then = written(small.distinct(), "links")
        discard(now, large, least, low)
        now, last = then, sign
        sign = then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == last or not sign[0]:
            break
    else:
        if max_rounds:
            raise RuntimeError(f"components not settled in {max_rounds} rounds")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = out.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._newsloom_path = getattr(now, "_newsloom_path", None)
    return out
