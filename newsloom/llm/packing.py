"""Packing of documents into training windows with lexically related neighbours.

Documents are put in an order in which those that share uncommon words are neighbours, and the order is
cut into shards of about ``SHARD_TOKENS`` tokens. The order is that of a weighted minimum hash: every token of
the vocabulary draws a place once, the earlier the later its number is (an exponential race with the square of the
number as its rate: vocabularies number common pieces first), and a document's key is the first of its tokens; two
documents have the same key with a chance that is their weighted similarity. A second, independent key orders those of equal
first key.

Each shard holds a BM25 inverted index over token ids, weighted by document frequencies of the whole
corpus. The first unused document seeds a window; the index ranks all unused documents of the shard
for it, and they fill the window in that order. The document that crosses the end is cut, and its rest
opens the next window as its seed, so only a shard's last window has padding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.base import lean, written
from newsloom.llm.tokens import encoder, vocabulary_size

WINDOW, SHARD_TOKENS = 4096, 2_000_000
#: Tasks of the packing at most; so the driver keeps track of as many at any size.
MOST_PARTITIONS = 4096
K1, B = 1.2, 0.75
#: Unused share of the indexed documents of a shard below which the postings of the others are dropped.
FORGET = 0.8
KEYS, SEED = 2, 20_240_517
TOKENIZED = "".join(f"k{k} int, " for k in range(KEYS)) + "doc_id long, salt long, n long, ids binary"
PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def races(size: int, keys: int = KEYS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(each token's place in a race, the key of each place) for independent races; keys come in no order, as longer texts win earlier places."""
    rng, out = np.random.default_rng(SEED), []
    for _ in range(keys):
        place = np.empty(size, np.int32)
        place[np.argsort(rng.exponential(size=size) / np.arange(1, size + 1, dtype=np.float64) ** 2, kind="stable")] = np.arange(size, dtype=np.int32)
        out.append((place, rng.permutation(size).astype(np.int32)))
    return out


def _tokenized(batches: Iterator[pa.RecordBatch], path: str, end_id: int, width: str, remembered: int | None) -> Iterator[pa.RecordBatch]:
    enc, size = encoder(path, width, remembered), np.dtype(width).itemsize
    own = races(max(enc.tokenizer.get_vocab_size(), end_id + 1))
    names = [*(f"k{k}" for k in range(len(own))), "doc_id", "salt", "n", "ids"]
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = enc.column(batch.column(1), end_id)
        n = pc.divide(pc.binary_length(ids).cast(pa.int64()), size)
        flat, starts = _tokens(ids, width), np.concatenate([[0], np.cumsum(n.to_numpy())[:-1]])
        keys = [pa.array(key[np.minimum.reduceat(place[flat], starts)]) for place, key in own]
        yield pa.RecordBatch.from_arrays([*keys, batch.column(0), batch.column(2), n, ids], names)


def _frequencies(batches: Iterator[pa.RecordBatch], width: str) -> Iterator[pa.RecordBatch]:
    """Documents of the partition that hold each token."""
    total, last, size = np.zeros(0, np.int64), np.empty(0, np.int32), np.dtype(width).itemsize
    for batch in batches:
        if not batch.num_rows:
            continue
        flat = _tokens(batch.column(0), width)
        if flat.max() >= len(total):
            total = np.concatenate([total, np.zeros(int(flat.max()) + 1 - len(total), np.int64)])
            last = np.empty(len(total), np.int32)
        ends = np.cumsum(pc.binary_length(batch.column(0)).to_numpy()) // size
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            own, place = flat[a:b], np.arange(b - a, dtype=np.int32)
            last[own] = place
            total[own[last[own] == place]] += 1  # one of the places of each token: the one that stayed
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["token", "n"])


def idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    """BM25 weights; terms in half of all documents or more weigh nothing."""
    return np.log(np.maximum((n_docs - df + 0.5) / (df + 0.5), 1.0))


def _tokens(column: pa.Array, width: str) -> np.ndarray:
    """The ids of all rows of a binary column, one after the other."""
    places = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], width)[places[0] // np.dtype(width).itemsize : places[-1] // np.dtype(width).itemsize]


class Index:
    """BM25 postings of one shard."""

    def __init__(self, docs: list[np.ndarray], df: np.ndarray, n_docs: int, mean: float):
        lengths = np.array([len(d) for d in docs], np.int64)
        self.idf, self.n = idf(df, n_docs), len(docs)
        self.asked = np.zeros(len(df), bool)
        ids = np.concatenate(docs) if docs else np.empty(0, np.uint16)
        owner = np.repeat(np.arange(len(docs), dtype=np.int32), lengths)
        useful = (self.idf > 0)[ids]
        ids, owner = ids[useful], owner[useful]
        order = np.argsort(ids, kind="stable")  # by counting for 16-bit ids
        term, doc = ids[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])) if len(term) else np.empty(0, np.int64)
        tf = np.diff(np.append(first, len(term)))
        term, self.doc = term[first], doc[first].astype(np.int64)
        norm = K1 * (1 - B + B * lengths[self.doc] / max(mean, 1e-9))
        self.weight = (self.idf[term] * tf * (K1 + 1) / (tf + norm)).astype(np.float32).astype(np.float64)
        self.start = np.searchsorted(term, np.arange(len(df) + 1))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """The score of every document; those that `forget` was told of get none."""
        self.asked[query] = True
        terms = np.flatnonzero(self.asked)
        self.asked[query] = False
        terms = terms[self.idf[terms] > 0]
        a, b = self.start[terms], self.start[terms + 1]
        some = b > a
        if not some.any():
            return np.zeros(self.n)
        runs = [slice(x, y) for x, y in zip(a[some].tolist(), b[some].tolist(), strict=True)]
        return np.bincount(np.concatenate([self.doc[r] for r in runs]), np.concatenate([self.weight[r] for r in runs]), self.n)

    def forget(self, used: np.ndarray) -> None:
        """Drop the postings of used documents."""
        keep = ~used[self.doc]
        self.start = np.concatenate([[0], np.cumsum(keep)])[self.start]
        self.doc, self.weight = self.doc[keep], self.weight[keep]


def ranked(score: np.ndarray, used: np.ndarray, first: int = 16) -> Iterator[int]:
    """Unused documents by falling score, equal ones in order; the first few without a full sort."""
    open_ = np.flatnonzero(~used)
    s = score[open_]
    if len(s) > 4 * first:
        edge = np.partition(s, len(s) - first)[len(s) - first]
        if edge > 0:
            top = np.flatnonzero(s > edge)
            yield from open_[top[np.argsort(-s[top], kind="stable")]].tolist()
            rest = np.flatnonzero(s <= edge)
            open_, s = open_[rest], s[rest]
    yield from open_[np.argsort(-s, kind="stable")].tolist()


def fill(docs: list[np.ndarray], index: Index, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, window number, offset) of every piece of a shard."""
    used = np.zeros(len(docs), bool)
    out: list[tuple[int, int, int, int, int]] = []
    number, room, low, left, indexed = 0, window, 0, len(docs), len(docs)
    rest: tuple[int, int] | None = None

    def put(doc: int, start: int) -> tuple[int, int] | None:
        """One document into the windows; what crosses the end of a window stays to open the next."""
        nonlocal number, room
        take = min(room, len(docs[doc]) - start)
        out.append((doc, start, take, number, window - room))
        room -= take
        if room == 0:
            number, room = number + 1, window
        return (doc, start + take) if start + take < len(docs[doc]) else None

    while True:
        if rest is None:
            while low < len(docs) and used[low]:
                low += 1
            if low == len(docs):
                return out
            used[low], rest, left = True, (low, 0), left - 1
        seed = rest[0]
        rest = put(*rest)
        if rest is not None or room == window:
            continue
        if left < FORGET * indexed:  # enough postings are of used documents
            index.forget(used)
            indexed = left
        here = number
        for doc in ranked(index.scores(docs[seed]), used):
            used[doc], left = True, left - 1
            rest = put(doc, 0)
            if rest is not None or number != here:
                break


def _packed(batches: Iterator[pa.RecordBatch], df: np.ndarray, n_docs: int, mean: float, window: int, shard_tokens: int, width: str) -> Iterator[pa.RecordBatch]:
    """Pieces of a partition's documents, shard by shard; a partition numbers its sequences from its own number on."""
    names, number, held, size = [c.split()[0] for c in PIECE.split(", ")], 0, [], 0

    def close() -> pa.RecordBatch:
        nonlocal number, held, size
        t = pa.Table.from_batches(held).combine_chunks()
        n = t.column("n").to_numpy()
        ids = _tokens(t.column("ids").chunk(0), width)
        ends = np.cumsum(n)
        docs = [ids[a:b] for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
        rows = fill(docs, Index(docs, df, n_docs, mean), window)
        doc, start, length, nth, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        own = pa.array(doc)
        wide = np.concatenate([docs[d][x : x + y] for d, x, y, _, _ in rows]).astype("<u4")
        places = 4 * np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        cut = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(wide.tobytes())])
        sequence = (int(t.column("part")[0].as_py()) << 32) + number + nth
        number, held, size = number + int(nth[-1]) + 1, [], 0
        return pa.RecordBatch.from_arrays([t.column("doc_id").chunk(0).take(own), pa.array(start), pa.array(length), pa.array(n[doc]), pa.array(sequence), pa.array(offset), cut], names)

    for batch in batches:
        ends = np.cumsum(batch.column(batch.schema.get_field_index("n")).to_numpy())
        a = 0
        while a < batch.num_rows:
            before = int(ends[a - 1]) if a else 0
            b = min(batch.num_rows, int(np.searchsorted(ends, before + shard_tokens - size)) + 1)
            held.append(batch.slice(a, b - a))
            size += int(ends[b - 1]) - before
            a = b
            if size >= shard_tokens:
                yield close()
    if held:
        yield close()


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text", remembered: int | None = None) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary) for every piece of every document.

    Each document is its token ids and the end id; null texts are empty, null ids and repeated rows
    are documents as any other, and equal scores rank by the order of the documents' keys, then of a hash of id and text, so
    a frequent word, source or id spreads. Sequences are full but for the last of each shard; beyond
    ``MOST_PARTITIONS`` shards a task packs several, one after the other. A sequence's number is its
    partition's, times 2**32, plus its place there. An empty table packs to nothing.

    ``remembered`` words a worker keeps their ids (None: as many as `tokens` says).
    Corpus statistics cover all documents: document frequencies (one number for each vocabulary
    entry) go to the driver and back with the tasks.
    """
    width = "<u2" if vocabulary_size(vocabulary) <= 1 << 16 else "<u4"
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), key.alias("salt"))
    known = written(rows.mapInArrow(lambda it: lean(_tokenized(it, vocabulary, end_id, width, remembered)), TOKENIZED), "ids")
    counts = known.select("ids").mapInArrow(lambda it: _frequencies(it, width), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(int(max(counts.column("token").to_pylist(), default=0)) + 1, np.int64)
    df[counts.column("token").to_numpy()] = counts.column("n").to_numpy()
    total = known.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("ids")).first()
    n_docs, mean = total["docs"], total["ids"] / max(1, total["docs"])

    order = [*(f"k{k}" for k in range(KEYS)), "salt", "doc_id"]
    dealt = known.repartitionByRange(min(MOST_PARTITIONS, max(1, math.ceil(total["ids"] / shard_tokens))), *order).sortWithinPartitions(*order)
    dealt = dealt.select("doc_id", "n", "ids", F.spark_partition_id().alias("part"))
    return dealt.mapInArrow(lambda it: lean(_packed(it, df, n_docs, mean, window, shard_tokens, width)), PIECE)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (array<long> of exactly ``window``, padded), n_ids: the windows themselves."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        ids = np.frombuffer(b"".join(pdf["ids"]), "<u4").astype(np.int64)
        full = np.full(window, pad_id, np.int64)
        full[: len(ids)] = ids
        return pd.DataFrame({"sequence_id": [pdf["sequence_id"].iloc[0]], "ids": [full], "n_ids": [len(ids)]})

    return pieces.groupBy("sequence_id").applyInPandas(join, "sequence_id long, ids array<long>, n_ids long")
