"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal.

A text is its runs of word characters and runs of other visible characters, in order. Each run
and each pair of neighbours is hashed into a bucket; a bucket's value is its share of the runs
(or pairs) of the text. The score is the logistic function of a sparse dot product, so it needs one
weight vector of fixed size and no other state.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.base import discard, lean, written

BUCKET_BITS = 18
#: Labelled rows at most that the model is fitted on, those of the smallest hashed id.
SAMPLE = 8192
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.002, 0.01
SCALE = 8.0
THRESHOLD = 0.7
#: Pairs of a run with itself, next to each other or one apart, whatever the run.
AGAIN = 0x5A5A5A5A
RUN = re.compile(r"\w+|[^\w\s]+")
REMEMBERED = 200_000
#: Features in a row of the sample.
PART = 1024


class _Hashes(dict):
    def __missing__(self, run: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[run] = h = zlib.crc32(run.encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()


def buckets(text: str | None, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's single runs and of its pairs, in order."""
    runs = RUN.findall(text or "")
    h = np.fromiter(map(_hashes.__getitem__, runs), np.uint64, len(runs))
    shift = np.uint64(64 - bits)
    mix = np.uint64(0x9E3779B97F4A7C15)
    one = (h * mix) >> shift
    pair = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:] + np.uint64(1)
    pair[h[:-1] == h[1:]] = AGAIN
    over = np.full(int((h[:-2] == h[2:]).sum()), AGAIN + 1, np.uint64)
    two = (np.concatenate([pair, over]) * mix) >> shift
    return one.astype(np.int64), two.astype(np.int64)


def features(text: str | None, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their values; the last bucket is the constant."""
    one, two = buckets(text, bits)
    at = np.concatenate([one, two, [1 << bits]])
    value = np.concatenate([np.full(len(one), SCALE / max(1, len(one))), np.full(len(two), SCALE / max(1, len(two))), [1.0]])
    found, inverse = np.unique(at, return_inverse=True)
    return found, np.bincount(inverse, value, len(found))


class Ftrl:
    """FTRL-proximal updates of a logistic regression (McMahan et al., 2013)."""

    def __init__(self, bits: int = BUCKET_BITS):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weight(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weight(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def _featured(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Features of each labelled text, in rows of at most ``PART``."""
    for batch in batches:
        for key, text, y, tie, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at, value = features(text, bits)
            cuts = list(range(0, len(at), PART))
            arrays = [pa.array([v[c : c + PART] for c in cuts], pa.list_(t)) for v, t in ((at, pa.int32()), (value, pa.float32()))]
            same = [pa.array([v] * len(cuts), t) for v, t in ((key, pa.int64()), (tie, pa.int64()), (row, pa.int64()), (y, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(range(len(cuts)), pa.int32()), pa.array([len(cuts)] * len(cuts), pa.int32()), *arrays], ["key", "tie", "row", "y", "part", "parts", "at", "x"])


def _trained(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The weights after all rows, in the order they come; one text's features are held at a time."""
    model, held = Ftrl(bits), []
    for batch in batches:
        y, part, parts = (batch.column(c).to_pylist() for c in ("y", "part", "parts"))
        for i in range(batch.num_rows):
            held = [] if part[i] == 0 else held
            held.append((batch.column("at")[i].values.to_numpy(), batch.column("x")[i].values.to_numpy().astype(np.float64)))
            if len(held) == parts[i]:
                model.update(*(np.concatenate(v) for v in zip(*held, strict=True)), y[i])
    w = model.weight(np.arange(len(model.z)))
    some = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(w[some])], ["at", "w"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BUCKET_BITS, epochs: int = EPOCHS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights from at most ``sample`` labelled documents outside the held-out fold.

    A document with contradicting or null labels is left out, as is one with a null id. Rows that repeat an id all
    count. Without any labelled document (empty tables) the weights are zero and every score is one half.
    Updates follow each other in one task, which streams the sample (once an epoch) and holds one text's features.
    """
    own = labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("q")).where("__id is not null and q is not null").where(fold(F.col("__id")) != 2)
    own = own.groupBy("__id").agg(F.min("q").alias("y"), F.max("q").alias("top")).where("y = top").drop("top")
    own = own.orderBy(F.xxhash64("__id"), "__id").limit(sample)  # one narrow row each, so the bound is small enough to broadcast
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(own), F.col("doc_id") == F.col("__id"))
    rows = rows.select(F.col("doc_id").cast("long").alias("key"), "text", F.col("y").cast("int").alias("y"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    known = written(rows.mapInArrow(lambda it: lean(_featured(it, bits)), "key long, tie long, row long, y int, part int, parts int, at array<int>, x array<float>"), "features")
    order = ["epoch", F.crc32(F.col("key").cast("string").cast("binary")), "key", "tie", "row", "part"]
    all_ = known.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).repartition(1).sortWithinPartitions(*order)
    got = all_.select("y", "part", "parts", "at", "x").mapInArrow(lambda it: _trained(it, bits), "at long, w double").toArrow()  # one row a weight
    out = np.zeros((1 << bits) + 1, np.float32)
    out[got.column("at").to_numpy()] = got.column("w").to_numpy()
    discard(known)
    return out


def _scored(batches: Iterator[pa.RecordBatch], weights, bits: int) -> Iterator[pa.RecordBatch]:
    w = weights.value
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            one, two = buckets(text, bits)
            dot = float(w[-1]) + SCALE * (float(w[one].sum(dtype=np.float64)) / max(1, len(one)) + float(w[two].sum(dtype=np.float64)) / max(1, len(two)))
            out.append(1 / (1 + np.exp(-np.clip(dot, -35, 35))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])


def score(docs: DataFrame, weights: np.ndarray, bits: int = BUCKET_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null and empty texts get the constant's score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 4 bytes a bucket
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    got = rows.mapInArrow(lambda it: lean(_scored(it, shared, bits)), "doc_id long, score double")
    return got.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _kept(batches: Iterator[pa.RecordBatch], weights, bits: int, text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pair = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(batch.schema.get_field_index(text_col))], ["doc_id", "text"])
        scores = next(_scored(iter([pair]), weights, bits)).column(1).to_numpy()
        yield batch.filter(pa.array(scores >= THRESHOLD))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns.

    Each row is judged by its text alone, so ids, nulls in them and repeats do not matter; null and empty texts get
    the constant's score. Without labels every score is one half and no row stays. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col))
    return docs.mapInArrow(lambda it: lean(_kept(it, shared, BUCKET_BITS, text_col)), docs.schema)
