"""Ranked lexical search, score at a time over postings in the order of their exact impact.

A first pass over the documents keeps, for each of them, its length and the query terms that it holds with their
counts; totals and document frequencies follow from that table. A second pass over it goes block by block: the
postings of a block are grouped by term and exact impact, and each item takes the groups of its terms in
descending order of what they add. It stops when what is left of all lists together is less than the k-th best score so
far, so that a document not met yet cannot come in; the documents whose partial score and that rest
reach the k-th best are then completed from their own term lists. The best of each task meet in one ranking an item.

Items are taken in blocks of bounded bytes, so that a task's memory does not grow with their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.base import discard, folded, lean, prepare, row_chunks, written

#: Bytes of item texts that one scan of the documents serves.
ITEM_BYTES = 4 << 20
#: Documents and postings of a block.
BLOCK_DOCS, BLOCK_POSTINGS = 32_768, 4_000_000
#: Postings that are added before the bounds are looked at for the first time; each later step takes twice as many.
FIRST_STEP = 2048

# Fixed values of the scoring rule.
SCALE, TF_PART, LENGTH_PART, BASE, SLOPE = 1_000_000_000, 1000, 12, 100, 25
#: ASCII bytes but letters and digits end a term; A to Z become lower case; all others stay.
FOLD = bytes(c if c > 0x7F or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all terms in order, the row of each); a null text has none."""
    lists = pc.ascii_split_whitespace(folded(texts, FOLD))
    rows = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    some = pc.greater(pc.binary_length(lists.values), 0)
    return lists.values.filter(some), rows[some.to_numpy(zero_copy_only=False)]


@dataclass
class Items:
    """A block of items: their ids, the distinct terms, and for each item the places of its terms there with their counts."""

    ids: pa.Array
    terms: pa.Array
    lists: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: pa.Array, texts: pa.Array) -> Items:
        words, rows = terms(texts)
        coded = words.dictionary_encode()
        size = max(1, len(coded.dictionary))
        keys, times = np.unique(rows * size + coded.indices.to_numpy(), return_counts=True)
        cuts = np.searchsorted(keys // size, np.arange(len(ids) + 1))
        return cls(ids, coded.dictionary, [(keys[a:b] % size, times[a:b].astype(np.int64)) for a, b in zip(cuts, cuts[1:], strict=False)])


def forward(docs: DataFrame, wanted: pa.Array) -> DataFrame:
    """(doc_id, n, terms, counts) of each row: its terms in all, and those of them that are wanted, by their place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in row_chunks(b["text"]):
                part = b.slice(lo, hi - lo)
                words, rows = terms(part["text"])
                coded = words.dictionary_encode()
                place = pc.fill_null(pc.index_in(coded.dictionary, wanted), -1).to_numpy()[coded.indices.to_numpy()]
                size = max(1, len(wanted))
                keys, times = np.unique((rows * size + place)[place >= 0], return_counts=True)
                ends = np.searchsorted(keys // size, np.arange(len(part) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (keys % size, times)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(np.bincount(rows, minlength=len(part)).astype(np.int64)), *lists], ["doc_id", "n", "terms", "counts"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(lambda b: lean(run(b)), "doc_id long, n long, terms array<int>, counts array<int>")


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What one occurrence of the term in an item adds to a document's score."""
    m = BASE - SLOPE + SLOPE * n * documents // length
    return weight * (SCALE * tf // (TF_PART * tf + LENGTH_PART * m))


class Best:
    """The best k (score, doc_id) of each item that a task has met; a null id comes after all others."""

    def __init__(self, items: int, k: int):
        self.k = k
        none = np.zeros(0, np.int64)
        self.found = [(none, none, none.astype(bool))] * items

    def least(self, item: int) -> int:
        """A score that newcomers have to reach, 0 while there is room."""
        scores = self.found[item][0]
        return int(scores[-1]) if len(scores) == self.k else 0

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = (np.concatenate(x) for x in zip(self.found[item], (scores, ids, null), strict=True))
        order = np.lexsort((ids, null, -scores))[: self.k]
        order = order[scores[order] > 0]
        self.found[item] = scores[order], ids[order], null[order]


class Block:
    """The postings of some documents, grouped by term and exact impact, and each document's own list."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, sizes: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        self.ids, self.null, self.term, self.impact = ids, null, term, impact
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        order = np.lexsort((-impact, term))
        self.docs = np.repeat(np.arange(len(ids)), sizes)[order]
        by_term, by_impact = term[order], impact[order]
        new = np.ones(len(order), bool)
        new[1:] = (by_term[1:] != by_term[:-1]) | (by_impact[1:] != by_impact[:-1])
        self.starts = np.append(np.flatnonzero(new), len(order))
        self.value = by_impact[self.starts[:-1]]
        self.of = np.searchsorted(by_term[self.starts[:-1]], np.arange(n_terms + 1))  # a term's groups
        self.scores = np.zeros(len(ids), np.int64)

    def search(self, places: np.ndarray, times: np.ndarray, k: int, least: int, step: int = FIRST_STEP) -> tuple[np.ndarray, np.ndarray]:
        """(documents, whole scores) of all that may be among the best k, given that others have reached ``least``."""
        held = [(np.arange(self.of[t], self.of[t + 1]), q) for t, q in zip(places.tolist(), times.tolist(), strict=True) if self.of[t] < self.of[t + 1]]
        if not held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        groups = np.concatenate([g for g, _ in held])
        lists = np.repeat(np.arange(len(held)), [len(g) for g, _ in held])
        adds = self.value[groups] * np.repeat(np.array([q for _, q in held]), [len(g) for g, _ in held])
        order = np.argsort(-adds, kind="stable")  # impacts descend within a list, so its groups stay in order
        groups, lists, adds = groups[order], lists[order], adds[order]
        sizes = self.starts[groups + 1] - self.starts[groups]
        upto = np.cumsum(sizes)
        partial, at = self.scores, 0
        partial[:] = 0
        while at < len(groups):
            to = min(len(groups), int(np.searchsorted(upto, (upto[at - 1] if at else 0) + step)) + 1)
            size = sizes[at:to]
            where = np.repeat(self.starts[groups[at:to]] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            np.add.at(partial, self.docs[where], np.repeat(adds[at:to], size))
            at, step = to, 2 * step
            rest = 0  # the next group of each list bounds what it still adds to one document
            if at < len(groups):
                _, nexts = np.unique(lists[at:], return_index=True)
                rest = int(adds[at:][nexts].sum())
            reached = max(least, int(np.partition(partial, -k)[-k]) if len(partial) >= k else 0)
            if rest < reached or not rest:
                break
        found = np.flatnonzero((partial > 0) & (partial + rest >= reached))
        if rest:
            many = np.zeros(len(self.of), np.int64)
            many[places] = times
            size = self.ends[found + 1] - self.ends[found]
            where = np.repeat(self.ends[found] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            whole = np.zeros(len(found), np.int64)
            np.add.at(whole, np.repeat(np.arange(len(found)), size), many[self.term[where]] * self.impact[where])
            return found, whole
        return found, partial[found]


def _ranked(rows: DataFrame, items: Items, weight: np.ndarray, documents: int, length: int, k: int, kind: str) -> DataFrame:
    """Each task's best k documents of each item."""
    step = FIRST_STEP

    def search(parts: list[pa.RecordBatch], best: Best) -> None:
        t = pa.Table.from_batches(parts).combine_chunks()
        n, ids, term, tf = t["n"].to_numpy(), t["doc_id"].combine_chunks(), t["terms"].combine_chunks(), t["counts"].combine_chunks()
        sizes = np.diff(term.offsets.to_numpy())
        term, tf = term.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64)
        impact = impacts(weight[term], tf, np.repeat(n, sizes), documents, length)
        block = Block(pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False), sizes, term, impact, len(weight))
        for i, (places, times) in enumerate(items.lists):
            found, scores = block.search(places, times, k, best.least(i), step)
            best.add(i, scores, block.ids[found], block.null[found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, parts, docs, postings = Best(len(items.lists), k), [], 0, 0
        for b in batches:
            parts.append(b)
            docs, postings = docs + len(b), postings + len(b["terms"].flatten())
            if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                search(parts, best)
                parts, docs, postings = [], 0, 0
        if parts:
            search(parts, best)
        for i, (scores, ids, null) in enumerate(best.found):
            if len(scores):
                item = np.full(len(scores), i, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(item), items.ids.take(pa.array(item)), pa.array(ids, mask=null), pa.array(scores)], ["item", "item_id", "doc_id", "score"])

    return rows.mapInArrow(lambda b: lean(run(b)), f"item int, item_id {kind}, doc_id long, score long")


def top_documents(docs: DataFrame, benchmark: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents by score descending, then doc_id; score above 0.

    Each row is a document or an item of its own, also where its id repeats; null ids of documents come last among equal
    scores. Null and empty texts have no terms: such documents count for nothing, such items have no rows. Empty
    tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = dict(benchmark.dtypes)["item_id"]
    asked = benchmark.select("item_id", "text").where("text is not null")
    size = asked.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = -(-size // ITEM_BYTES)
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for nth in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == nth).toArrow().combine_chunks()
        items = Items.of(own["item_id"].combine_chunks(), own["text"].combine_chunks())
        rows = written(forward(docs, items.terms), "forward")
        total = rows.where("n > 0").agg(F.count("n").alias("documents"), F.sum("n").alias("length")).first()
        if total.documents:
            weight = np.zeros(len(items.terms), np.int64)
            for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the block
                weight[r.term] = math.floor(1000 * math.log((2 * total.documents + 2) / (2 * r["count"] + 1)))
            best = written(_ranked(rows, items, weight, total.documents, total.length, k, kind), "best")
            order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            out = out.unionAll(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
        discard(rows)
    return out
