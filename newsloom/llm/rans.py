"""Static range asymmetric numeral coding of token ids in independent interleaved blocks.

A block deals its ids to lanes, id t to lane t mod lanes; every lane is a 64-bit coder state that
sheds 32-bit words into one stream in the order in which a decoder asks for them. All lanes
advance together, so coding is a few array operations for each row of lanes. Every
``CHECKPOINT_ROWS`` rows the block keeps all states and the place in the stream, with a checksum of
the ids up to the next checkpoint: a decoder can start at any checkpoint, and segments of one
block can be decoded in parallel.

Layout of a block, little-endian: magic, n_ids u64, lanes u32, rows per checkpoint u32, segments
u32, words u32, table checksum u32; then for each segment its word offset u32 and ids' crc32 u32;
then states u64 [segments, lanes]; then words u32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"NLR1"
HEAD = struct.Struct("<4sQIIIII")
LOW = np.uint64(1 << 31)
LANES, CHECKPOINT_ROWS = 2048, 128


class Table:
    """Frequencies shared by all blocks, scaled to a power of two; each known id has one at least."""

    def __init__(self, ids: np.ndarray, freqs: np.ndarray, bits: int):
        order = np.argsort(ids)
        self.ids, self.freqs, self.bits = np.asarray(ids, np.uint32)[order], np.asarray(freqs, np.uint64)[order], bits
        if len(ids) and int(self.freqs.sum()) != 1 << bits:
            raise ValueError("frequencies must fill the scale")
        self.cum = np.concatenate([[0], np.cumsum(self.freqs)[:-1]]).astype(np.uint64) if len(ids) else np.empty(0, np.uint64)
        self.crc = zlib.crc32(self.ids.astype("<u4").tobytes() + self.freqs.astype("<u8").tobytes())
        size = int(self.ids.max()) + 1 if len(ids) else 0
        self.place = np.full(size, -1, np.int64)
        self.place[self.ids] = np.arange(len(self.ids))
        self.slots = np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.freqs.astype(np.int64))

    @classmethod
    def from_counts(cls, ids: np.ndarray, counts: np.ndarray) -> Table:
        """Scale counts: proportional shares rounded down, one at least, the rest by largest remainder."""
        ids, counts = np.asarray(ids, np.int64), np.asarray(counts, np.float64)
        if not len(ids):
            return cls(ids, counts, 12)
        order = np.argsort(ids)
        ids, counts = ids[order], counts[order]
        bits = min(24, max(12, int(np.ceil(np.log2(len(ids)))) + 3))
        share = counts / counts.sum() * ((1 << bits) - len(ids))
        freqs = np.floor(share).astype(np.int64) + 1
        left = (1 << bits) - int(freqs.sum())
        rank = np.argsort(-(share - np.floor(share)), kind="stable")
        freqs[rank[:left]] += 1
        return cls(ids, freqs, bits)


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, rows_per_checkpoint: int = CHECKPOINT_ROWS) -> bytes:
    ids = np.asarray(ids, np.uint32)
    n = len(ids)
    while lanes > 1 and lanes * 32 > n:
        lanes //= 2
    rows = -(-n // lanes)
    if n and (int(ids.max()) >= len(table.place) or (table.place[ids] < 0).any()):
        raise ValueError("an id is not in the frequency table")
    at = table.place[ids]
    freq, cum = table.freqs[at], table.cum[at]
    bits, mask32 = np.uint64(table.bits), np.uint64(0xFFFFFFFF)
    shift, top = np.uint64(32), (LOW >> bits) << np.uint64(32)
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    made = 0
    for r in range(rows - 1, -1, -1):
        f, c = freq[r * lanes : (r + 1) * lanes], cum[r * lanes : (r + 1) * lanes]
        y = x[: len(f)]
        full = y >= top * f
        out = (y[full] & mask32).astype("<u4")
        words.append(out)
        made += len(out)
        y[full] >>= shift
        q = y // f
        y[:] = (q << bits) + (y - q * f) + c
        if r % rows_per_checkpoint == 0:
            marks.append((made, x.copy()))
    marks.reverse()
    head = HEAD.pack(MAGIC, n, lanes, rows_per_checkpoint, len(marks), made, table.crc)
    step = lanes * rows_per_checkpoint
    index = b"".join(struct.pack("<II", made - m, zlib.crc32(ids[i * step : (i + 1) * step].astype("<u4").tobytes())) for i, (m, _) in enumerate(marks))
    states = b"".join(s.astype("<u8").tobytes() for _, s in marks)
    return head + index + states + b"".join(w.tobytes() for w in reversed(words))


def header(block: bytes) -> tuple[int, int, int, int, int, int]:
    """n_ids, lanes, rows per checkpoint, segments, words, table checksum."""
    magic, *rest = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block")
    return tuple(rest)


def decode_segment(block: bytes, table: Table, segment: int) -> np.ndarray:
    """The ids between one checkpoint and the next, checked against their checksum."""
    n, lanes, per, segments, n_words, crc = header(block)
    if crc != table.crc:
        raise ValueError("the block was written with another table")
    offset, want = struct.unpack_from("<II", block, HEAD.size + 8 * segment)
    base = HEAD.size + 8 * segments
    x = np.frombuffer(block, "<u8", lanes, base + 8 * lanes * segment).copy()
    words = np.frombuffer(block, "<u4", n_words, base + 8 * lanes * segments)
    bits, low = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    start, stop = segment * per * lanes, min(n, (segment + 1) * per * lanes)
    out = np.empty(stop - start, np.uint32)
    for i in range(0, stop - start, lanes):
        y = x[: min(lanes, stop - start - i)]
        slot = y & low
        at = table.slots[slot]
        out[i : i + len(y)] = table.ids[at]
        y[:] = table.freqs[at] * (y >> bits) + slot - table.cum[at]
        need = np.flatnonzero(y < LOW)
        if len(need):
            y[need] = (y[need] << np.uint64(32)) | words[offset : offset + len(need)].astype(np.uint64)
            offset += len(need)
    if zlib.crc32(out.astype("<u4").tobytes()) != want:
        raise ValueError(f"segment {segment} does not match its checksum")
    return out


def decode(block: bytes, table: Table) -> np.ndarray:
    n, _, _, segments, _, _ = header(block)
    parts = [decode_segment(block, table, i) for i in range(segments)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)
