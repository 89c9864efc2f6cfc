"""Near-duplicates by SimHash and a generalised pigeonhole join.

If two fingerprints differ in at most r bits and the bits are divided into groups with thresholds
that satisfy sum(t + 1) = r + 1, some group differs in at most its own t bits (a group with t = -1 is never
probed). Bits that go together over the corpus are put into one group, which leaves the groups
more independent of each other, and the thresholds come from dynamic programming over the
estimated number of candidates and probe rows of each group and threshold.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.base import discard, written
from newsloom.llm.components import connected_components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints under one probe key beyond which they are linked by enumerated midpoints instead.
HOT_KEY = 16_384
#: Cost of a probe row against that of comparing one candidate.
ROW_COST = 4.0


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, repeats included; no words give zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: len(words) - shingle].tolist()]
        hashes = [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    for i in range(0, n, 8192):
        part = np.array(hashes[i : i + 8192], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _fingerprints(it, shingle), "doc_id long, fp long")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, both = 0, np.zeros((BITS, BITS))
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
        n, both = n + len(bits), both + bits.T @ bits
    at = np.arange(BITS * BITS + 1, dtype=np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(both.ravel(), n).astype(np.int64))], ["at", "n"])


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """(fingerprints, how often each two bits are set together) over the whole table: 4,097 numbers."""
    got = distinct.select("fp").mapInArrow(_moments, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(BITS * BITS + 1)
    flat[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, groups: int) -> list[list[int]]:
    """Equal groups, each grown from an unused bit by the bits that go with it most."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    left, out = list(range(BITS)), []
    for size in (len(x) for x in np.array_split(np.arange(BITS), groups)):
        own = [left.pop(0)]
        while len(own) < size:
            best = max(left, key=lambda b: corr[own, b].mean())
            left.remove(best)
            own.append(best)
        out.append(sorted(own))
    return out


def close_share(differ: np.ndarray, most: int) -> np.ndarray:
    """Share of pairs that differ in at most 0..most of independent bits with those chances."""
    dist = np.zeros(len(differ) + 1)
    dist[0] = 1
    for q in differ:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return np.cumsum(dist)[: most + 1]


def allocate(groups: list[list[int]], n: int, both: np.ndarray, radius: int) -> tuple[list[int], float]:
    """Thresholds with sum(t + 1) = radius + 1 of least estimated cost, by dynamic programming."""
    p = np.diag(both) / max(n, 1)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in groups:
        share = close_share(2 * p[bits] * (1 - p[bits]), radius)
        rows = np.cumsum([np.prod([(len(bits) - i) / (i + 1) for i in range(k)]) for k in range(radius + 1)])
        then: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, ts) in best.items():
            for t in range(-1, radius + 1 - spent):
                own = 0.0 if t < 0 else n * n / 2 * share[t] + ROW_COST * n * (1 + rows[t])
                if spent + t + 1 not in then or cost + own < then[spent + t + 1][0]:
                    then[spent + t + 1] = (cost + own, [*ts, t])
        best = then
    return best[radius + 1][1], best[radius + 1][0]


def plan(n: int, both: np.ndarray, radius: int = RADIUS) -> list[tuple[int, list[int]]]:
    """(threshold, bits) of the groups to probe, for the number of groups of least estimated cost."""
    found = []
    for k in range(1, min(8, radius + 2)):
        groups = group_bits(n, both, k)
        ts, cost = allocate(groups, n, both, radius)
        found.append((cost, [(t, g) for t, g in zip(ts, groups, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def _mask(bits: list[int] | tuple[int, ...]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _flips(bits: list[int], most: int) -> Column:
    """All patterns that flip at most so many of the bits."""
    return F.array(*[F.lit(_mask(c)).cast("long") for k in range(most + 1) for c in itertools.combinations(bits, k)])


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, hot_key: int = HOT_KEY) -> DataFrame:
    """(u, v): links whose components are those of all pairs within radius bits.

    distinct: one row a fingerprint, column fp. Pairs come from probing the planned groups; every
    candidate is compared on all bits. Fingerprints that share a probe key with more than
    ``hot_key`` others would meet in a quadratic number of pairs, so these are linked by enumeration,
    at a number of rows in proportion: two of them within 2r - 1 bits of flips meet in a midpoint.
    """
    n, both = bit_statistics(distinct)
    groups = plan(n, both, radius)
    keyed = None
    for k, (_, bits) in enumerate(groups):
        part = distinct.select("fp", F.lit(k).alias("grp"), F.col("fp").bitwiseAND(F.lit(_mask(bits)).cast("long")).alias("key"))
        keyed = part if keyed is None else keyed.unionAll(part)
    crowd = keyed.groupBy("grp", "key").count().where(F.col("count") > hot_key)
    crowd = written(crowd.select("grp", "key"), "hot-keys")
    probes = None
    for k, (t, bits) in enumerate(groups):
        own = F.explode(_flips(bits, t)).alias("flip")
        part = distinct.select("fp", own).select(F.col("fp").alias("probe"), F.lit(k).alias("grp"), F.col("fp").bitwiseXOR(F.col("flip")).bitwiseAND(F.lit(_mask(bits)).cast("long")).alias("key"))
        probes = part if probes is None else probes.unionAll(part)
    if crowd.isEmpty():
        calm, hot = keyed, None
    else:
        calm, hot = keyed.join(crowd, ["grp", "key"], "left_anti"), keyed.join(crowd, ["grp", "key"], "left_semi").select("fp").distinct()
    near = probes.join(calm, ["grp", "key"]).where(F.col("probe") != F.col("fp")).where(_distance(F.col("probe"), F.col("fp")) <= radius)
    links = near.select(F.col("probe").alias("u"), F.col("fp").alias("v"))
    if hot is None:
        return links
    # whoever asks a hot key is close to one of its fingerprints perhaps: it probes the midpoints of the hot ones
    low, high = radius // 2, radius - radius // 2
    mids = hot.select("fp", F.explode(_flips(list(range(BITS)), low)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    hub = mids.groupBy("mid").agg(F.min("fp").alias("hub"))
    askers = written(probes.join(crowd, ["grp", "key"], "left_semi").select(F.col("probe").alias("fp")).distinct(), "askers")
    asks = askers.select("fp", F.explode(_flips(list(range(BITS)), high)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    met = asks.join(hub, "mid").where(F.col("fp") != F.col("hub")).select(F.col("fp").alias("u"), F.col("hub").alias("v"))
    own = mids.join(hub, "mid").where(F.col("fp") != F.col("hub")).select(F.col("fp").alias("u"), F.col("hub").alias("v"))
    return links.unionAll(met).unionAll(own)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, hot_key: int = HOT_KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id for every row of docs.

    component_id is the smallest doc_id among the documents reachable by links, itself included.
    Texts without words (null, empty, blank) have fingerprint zero and link as any other; equal
    fingerprints are one node, so a large group of copies costs one row. Repeated rows count as
    copies; a null id never becomes a component's id unless all its documents have none. An
    empty table gives an empty result.
    """
    known = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = written(known.select("fp").distinct(), "distinct-fingerprints")
    parts = connected_components(fingerprint_links(distinct, radius, hot_key))
    # components are named on one row a fingerprint; both sides of each join are written tables, so that AQE can split a large component
    own = known.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = written(own.join(parts, own["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "fingerprint-components")
    least = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "components")
    told = written(named.join(least, "component").select("fp", "component_id"), "named-fingerprints")
    discard(distinct, parts, named, least)
    return known.join(told, "fp").select("doc_id", "fp", "component_id")
