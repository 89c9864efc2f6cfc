"""Removal of long byte strings that occur more than once, by a sparse, hash-compared suffix sort.

A byte goes if some string of ``LENGTH`` bytes over it also starts anywhere else in the corpus. Sorting
the suffixes at every byte would move the corpus many times over, so only anchors are sorted: the
``GRAM``-byte string of smallest hash in each window of ``LENGTH`` bytes. The choice depends on the window's
bytes alone, so both occurrences of a repeated window choose the same anchor in the same place.

Anchors of equal hash meet. Those with equal surroundings (all bytes a window over the anchor can
have, by a cryptographic hash of 128 bits) cover each other whole. Of the different surroundings of one anchor
the suffixes to the right, and the reversed prefixes to the left, are sorted by mergesort: prefix
polynomial hashes and binary search give the common extension of two suffixes, hence their order,
in logarithmic time, and neighbours are then compared byte by byte. A window that starts d bytes before
the anchor is repeated iff another occurrence agrees in d bytes to the left and LENGTH - d to the right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.base import bytes_of, discard, written

LENGTH, GRAM = 400, 160
#: Different surroundings of one anchor beyond which its windows are divided by place.
HOT_ANCHOR = 16_384
#: Bytes that are anchored at once, and bits of a place among them (a chunk ends with a piece, so it may be twice as long).
CHUNK, PLACE_BITS = 1 << 20, 22
BASE = 0x9E3779B97F4A7C15
ANCHOR = "doc_id long, text_key long, pos long, anchor long, c1 long, c2 long, before int, after int"
SPAN = "doc_id long, text_key long, s long, e long"
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1024) - 1, b, np.uint64)])) for b in (BASE, inverse)]
    return _powers[0], _powers[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all prefixes along the last axis."""
    p, _ = powers(data.shape[-1])
    out = np.zeros((*data.shape[:-1], data.shape[-1] + 1), np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: data.shape[-1]], axis=-1, out=out[..., 1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours (van Herk, 1992)."""
    n = len(x) - w + 1
    pad = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[: len(x)] = x
    blocks = pad.reshape(-1, w)
    front = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], front[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, ok: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of the windows that start where ok says; ties go to the right."""
    h = prefix_hashes(data)
    _, inverse = powers(len(data))
    n = len(data) - gram + 1
    g = mixed((h[gram:] - h[:n]) * inverse[:n])
    low = np.uint64((1 << PLACE_BITS) - 1)  # the same for all chunks, so that the choice depends on the window alone
    if n > int(low):
        raise ValueError("too many bytes at once")
    value = (g & ~low) | (low - np.arange(n, dtype=np.uint64))
    least = sliding_min(value, length - gram + 1)[ok[: len(data) - length + 1]]
    at = np.unique(low - (least & low)).astype(np.int64)
    return at, g[at]


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Chunks of (document, offset of the piece, bytes); each window of a long text starts in one piece only."""
    chunk: list[tuple[int, int, bytes]] = []
    held = 0
    for i, t in enumerate(texts):
        for p in range(0, len(t) - length + 1, CHUNK):
            piece = t[p : p + CHUNK + length - 1]
            chunk.append((i, p, piece))
            held += len(piece)
            if held >= CHUNK:
                yield chunk
                chunk, held = [], 0
    if chunk:
        yield chunk


def _anchored(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    reach = length - gram
    for batch in batches:
        texts = [x.as_buffer().to_pybytes() for x in batch.column(2)]
        ids, keys = batch.column(0), batch.column(1)
        last = (-1, np.empty(0, np.int64))  # the chunk before: its last document and that one's anchors
        for chunk in _pieces(texts, length):
            data = np.frombuffer(b"".join(x[2] for x in chunk), np.uint8)
            sizes = np.array([len(x[2]) for x in chunk])
            ends = np.cumsum(sizes)
            ok = np.ones(len(data), bool)
            for e in ends.tolist():
                ok[max(0, e - length + 1) : e] = False
            at, g = anchors(data, ok, length, gram)
            own = np.searchsorted(ends, at, side="right")
            doc = np.array([x[0] for x in chunk])[own]
            pos = at - (ends - sizes)[own] + np.array([x[1] for x in chunk])[own]
            # windows on both sides of a seam may choose one anchor: a document (a row) has each place once
            order = np.lexsort((pos, doc))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(doc[order]) != 0) | (np.diff(pos[order]) != 0)
            new &= (doc[order] != last[0]) | ~np.isin(pos[order], last[1])
            doc, pos, g = doc[order[new]], pos[order[new]], g[order[new]]
            i = chunk[-1][0]
            last = (i, np.concatenate([last[1] if last[0] == i else last[1][:0], pos[doc == i]]))
            total = np.array([len(texts[d]) for d in doc], np.int64)
            before, after = np.minimum(pos, reach), np.minimum(total - pos, length)
            digests = b"".join(hashlib.blake2b(b"%d,%d," % (b, a) + texts[d][p - b : p + a], digest_size=16).digest() for d, p, b, a in zip(doc.tolist(), pos.tolist(), before.tolist(), after.tolist(), strict=True))
            c = np.frombuffer(digests, "<i8").reshape(-1, 2)
            pick = pa.array(doc)
            cols = [ids.take(pick), keys.take(pick), pa.array(pos), pa.array(g.view(np.int64)), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "pos", "anchor", "c1", "c2", "before", "after"])


class Suffixes:
    """Rows of bytes, compared by the hashes of their prefixes."""

    def __init__(self, rows: np.ndarray, lengths: np.ndarray):
        self.rows, self.lengths, self.hashes = rows, lengths, prefix_hashes(rows)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of rows i and j, by binary search over prefix hashes."""
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.lengths[i], self.lengths[j])
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.hashes[i, mid] == self.hashes[j, mid]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def byte(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Byte n of row i, or -1 past its end."""
        return np.where(n < self.lengths[i], self.rows[i, np.minimum(n, self.rows.shape[1] - 1)].astype(np.int16), np.int16(-1))

    def before(self, i: np.ndarray, j: np.ndarray, ties: bool) -> np.ndarray:
        """Whether row i sorts before row j; equal rows do if ties says so."""
        n = self.common(i, j)
        a, b = self.byte(i, n), self.byte(j, n)
        return (a < b) | ((a == b) & ties)

    def sort(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Rows in order within each group (group starts and sizes by row): merges of all groups at once."""
        order = np.arange(len(self.rows))
        slot = order - start
        width = 1
        while width < (size.max() if len(size) else 0):
            run = slot // width
            other = np.where(run % 2 == 0, run + 1, run - 1) * width
            act = np.flatnonzero(other < size)
            lo = start[act] + other[act]
            first, stop = lo.copy(), start[act] + np.minimum(other[act] + width, size[act])
            hi, left = stop, (run[act] % 2 == 0)
            while (open_ := lo < hi).any():
                k = np.flatnonzero(open_)
                mid = (lo[k] + hi[k]) >> 1
                less = self.before(order[mid], order[act[k]], ~left[k])
                lo[k] = np.where(less, mid + 1, lo[k])
                hi = hi.copy()
                hi[k] = np.where(less, hi[k], mid)
            to = start[act] + (run[act] // 2) * 2 * width + (slot[act] - run[act] * width) + (lo - first)
            order[to] = order[act]
            width *= 2
        return order

    def neighbours(self, order: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, bytes that each row in order shares with the next of its group), compared byte by byte."""
        out = self._shared(order, start)
        if out is None:  # a hash collision misled the sort: order the bytes themselves
            group = start
            order = np.array(sorted(range(len(order)), key=lambda i: (group[i], self.rows[i, : self.lengths[i]].tobytes())), np.int64)
            out = self._shared(order, start)
        return order, out

    def _shared(self, order: np.ndarray, start: np.ndarray) -> np.ndarray | None:
        out = np.zeros(len(order), np.int64)
        pair = np.flatnonzero(start[order[:-1]] == start[order[1:]]) if len(order) > 1 else np.empty(0, np.int64)
        for i in range(0, len(pair), 8192):
            p = pair[i : i + 8192]
            a, b = order[p], order[p + 1]
            limit = np.minimum(self.lengths[a], self.lengths[b])
            differ = (self.rows[a] != self.rows[b]) | (np.arange(self.rows.shape[1]) >= limit[:, None])
            n = np.where(differ.any(1), differ.argmax(1), self.rows.shape[1])
            out[p] = n
            if (self.byte(a, n) > self.byte(b, n)).any():
                return None
        return out


def _classes(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """By row, a number of its class of rows that agree in so many bytes."""
    cls = np.zeros(len(order), np.int64)
    cls[order[1:]] = np.cumsum(shared[:-1] < depth)
    return cls


def repeated_offsets(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], lens: tuple[np.ndarray, np.ndarray], length: int, reach: int) -> np.ndarray:
    """[rows, reach + 1]: whether another row of the group has the same window d bytes before the anchor.

    left and right: (order, shared with the next) of one group; lens: bytes each row has on each side.
    """
    n = len(left[0])
    cuts = np.unique(np.clip(np.concatenate([[0], length - right[1][:-1], left[1][:-1] + 1, lens[0] + 1, length - lens[1]]), 0, reach + 1))
    out = np.zeros((n, reach + 1), bool)
    for a, b in zip(cuts, [*cuts[1:], reach + 1], strict=True):
        if a > reach:
            break
        own = _classes(left[0], left[1], a) * n + _classes(right[0], right[1], length - a)
        _, inverse, count = np.unique(own, return_inverse=True, return_counts=True)
        hit = (count[inverse] > 1) & (lens[0] >= a) & (lens[1] >= length - a)
        out[hit, a:b] = True
    return out


def _runs(cover: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true values."""
    edge = np.diff(np.pad(cover, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    return row, first, stop - 1


def group_spans(group: np.ndarray, before: np.ndarray, after: np.ndarray, contexts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) windows before the anchor that are repeated within groups (equal numbers in a row)."""
    reach, n = length - gram, len(group)
    rows_l, rows_r = np.zeros((n, reach), np.uint8), np.zeros((n, length), np.uint8)
    for i, c in enumerate(contexts):
        b = int(before[i])
        rows_l[i, :b] = np.frombuffer(c, np.uint8, b)[::-1]
        rows_r[i, : len(c) - b] = np.frombuffer(c, np.uint8, len(c) - b, b)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(first, n))
    start, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    sides = []
    for rows, lens in ((rows_l, before), (rows_r, after)):
        s = Suffixes(rows, lens.astype(np.int64))
        sides.append(s.neighbours(s.sort(start, size), start, size))
    (ol, sl), (orr, sr) = sides
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    two = first[sizes == 2]
    if len(two):  # of two occurrences: one range of windows
        lo, hi = np.maximum(0, length - sr[two]), np.minimum(sl[two], reach)
        t, lo, hi = two[lo <= hi], lo[lo <= hi], hi[lo <= hi]
        found += [(t, lo, hi), (t + 1, lo, hi)]
    for a, k in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        part = slice(a, a + k)
        cover = repeated_offsets((ol[part] - a, sl[part]), (orr[part] - a, sr[part]), (before[part], after[part]), length, reach)
        r, x, y = _runs(cover)
        found.append((r + a, x, y))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _grouped(batches: Iterator[pa.RecordBatch], length: int, gram: int, rows: int = 12_000) -> Iterator[pa.RecordBatch]:
    """Spans from contexts sorted by group; whole groups at a time, some thousands of rows."""
    held: list[pa.RecordBatch] = []

    def work(t: pa.Table) -> pa.RecordBatch:
        key = t.column("grp").to_numpy()
        before, after, pos = (t.column(c).to_numpy().astype(np.int64) for c in ("before", "after", "pos"))
        row, lo, hi = group_spans(key, before, after, t.column("context").to_pylist(), length, gram)
        pick = pa.array(row)
        return pa.RecordBatch.from_arrays([t.column("doc_id").take(pick).combine_chunks(), t.column("text_key").take(pick).combine_chunks(), pa.array(pos[row] - hi), pa.array(pos[row] - lo + length)], ["doc_id", "text_key", "s", "e"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        key = t.column("grp").to_numpy()
        cut = int(np.searchsorted(key == key[-1], True)) if key[0] != key[-1] else 0
        if cut:
            yield work(t.slice(0, cut))
        held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield work(pa.Table.from_batches(held).combine_chunks())


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes around each chosen anchor, from its document."""
    names = ["doc_id", "text_key", "pos", "grp", "before", "after", "context"]
    for batch in batches:
        for i in range(batch.num_rows):
            data = batch.column(2)[i].as_buffer().to_pybytes()
            at = batch.column(3)[i].values
            pos, grp, before, after = (at.field(k) for k in range(4))
            ctx = [data[p - b : p + a] for p, b, a in zip(pos.to_pylist(), before.to_pylist(), after.to_pylist(), strict=True)]
            n = len(ctx)
            own = pa.array(np.zeros(n, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).take(own), batch.column(1).slice(i, 1).take(own), pos, grp, before, after, pa.array(ctx, pa.binary())], names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            data, spans = batch.column(1)[i].as_buffer().to_pybytes(), batch.column(2)[i]
            gone = merged(spans.values.field(0).to_numpy(), spans.values.field(1).to_numpy()) if spans.is_valid else []
            last, kept = 0, []
            for s, e in gone:
                kept.append(data[last:s])
                last = e
            kept.append(data[last:])
            rows.append((len(data), sum(e - s for s, e in gone), len(gone), b"".join(kept)))
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names)


def merged(s: np.ndarray, e: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans; spans that touch are one run."""
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    return list(zip(s[new].tolist(), e[np.append(new[1:] - 1, len(e) - 1)].tolist(), strict=True))


def divided(rows: DataFrame, length: int, gram: int, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows in groups of at most ``hot``, spans): groups beyond it are divided by the window's place.

    Windows that start lo to hi bytes before an anchor all hold the bytes between; rows are grouped by
    these longer strings, each half of the range on its own, until groups are small or a range is
    one window, which is then compared on its bytes.
    """
    reach = length - gram
    now = rows.select("*", F.lit(0).alias("lo"), F.lit(reach).alias("hi"))
    calm = spans = None
    add = lambda a, b: b if a is None else a.unionByName(b)
    while True:
        big = written(now.groupBy("grp").count().where(F.col("count") > hot).select("grp"), "hot-anchors")
        if big.isEmpty():
            return add(calm, now).drop("lo", "hi"), spans
        calm = add(calm, now.join(big, "grp", "left_anti"))
        large = now.join(big, "grp", "left_semi")
        one = large.where("lo = hi").withColumn("window", F.expr(f"substring(context, before - lo + 1, {length})"))
        same = written(one.groupBy("grp", "window").count().where("count > 1").select("grp", "window"), "equal-windows")
        done = one.join(same, ["grp", "window"], "left_semi").select("doc_id", "text_key", (F.col("pos") - F.col("lo")).alias("s"), (F.col("pos") - F.col("lo") + length).alias("e"))
        spans = add(spans, done)
        mid = ((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi").alias("hi"))))
        parts = large.where("lo < hi").withColumn("half", halves).withColumn("lo", F.col("half.lo")).withColumn("hi", F.col("half.hi")).drop("half")
        parts = parts.where((F.col("before") >= F.col("lo")) & (F.col("after") >= length - F.col("hi")))
        core = F.expr(f"substring(context, before - lo + 1, {length} - hi + lo)")
        parts = parts.withColumn("grp", F.xxhash64("grp", "lo", "hi", core))
        alive = parts.groupBy("grp").count().where("count > 1").select("grp")
        now = written(parts.join(alive, "grp", "left_semi"), "divided")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_ANCHOR) -> DataFrame:
    """doc_id, text_key, s, e: spans (overlapping) whose union is every repeated byte.

    docs: doc_id, text_key (tells apart different texts under one id), data (binary).
    """
    long_ = docs.where(F.octet_length("data") >= length)
    known = written(long_.mapInArrow(lambda it: _anchored(it, length, gram), ANCHOR), "anchors")
    # the sides of joins on anchors are written tables, so that AQE can split an anchor of very many rows
    often = written(known.groupBy("anchor").count().where("count > 1").select("anchor"), "frequent-anchors")
    met = written(known.join(often, "anchor", "left_semi"), "met-anchors")
    discard(known, often)

    place = F.struct("doc_id", "text_key", "pos", "before", "after")
    classes = written(met.groupBy("anchor", "c1", "c2").agg(F.count("*").alias("n"), F.min(place).alias("one")), "surroundings")
    # all but the lone ones are repeated whole; joined by place, since a frequent class would be one key
    lone = classes.where("n = 1").select(F.col("one.doc_id").alias("__id"), F.col("one.text_key").alias("__key"), F.col("one.pos").alias("__pos"))
    twice = met.join(lone, met["doc_id"].eqNullSafe(lone["__id"]) & (met["text_key"] == lone["__key"]) & (met["pos"] == lone["__pos"]), "left_anti")
    whole = twice.select("doc_id", "text_key", (F.col("pos") - F.col("before")).alias("s"), (F.col("pos") + F.col("after")).alias("e")).where(F.col("e") - F.col("s") >= length)

    several = written(classes.groupBy("anchor").count().where("count > 1").select("anchor"), "varied-anchors")
    reps = classes.join(several, "anchor", "left_semi").select("one.*", "anchor")
    asked = reps.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("pos", F.col("anchor").alias("grp"), "before", "after")).alias("at"))
    a, b = asked.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "at"), long_.dropDuplicates(["doc_id", "text_key"])
    texts = b.join(a, b["doc_id"].eqNullSafe(a["__id"]) & (b["text_key"] == a["__key"])).select("doc_id", "text_key", "data", "at")
    ctx = written(texts.mapInArrow(_contexts, "doc_id long, text_key long, pos long, grp long, before int, after int, context binary"), "contexts")
    discard(several)
    calm, spans = divided(ctx, length, gram, hot)
    found = calm.repartition("grp").sortWithinPartitions("grp").mapInArrow(lambda it: _grouped(it, length, gram), SPAN)
    out = whole.unionByName(found)
    return out if spans is None else out.unionByName(spans)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes) for every row of docs.

    A null text is empty; texts shorter than ``length`` lose nothing by themselves. Rows that repeat an
    id with the same text are separate documents, so each covers the other. All occurrences go, the
    first too; an empty table stays empty.
    """
    data = bytes_of(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(data).alias("text_key"), data.alias("data"))
    spans = repeated_spans(rows, length, gram, hot).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "spans")
    joined = rows.join(spans, rows["doc_id"].eqNullSafe(spans["__id"]) & (rows["text_key"] == spans["__key"]), "left").select("doc_id", "data", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
