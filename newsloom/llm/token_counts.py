"""Token counts of whole texts by a finite-state transducer compiled from a sentencepiece BPE vocabulary.

The tokens of a text's prefix end in one token, and a sequence of tokens is what the model gives exactly
if each two neighbours stay apart when their own characters are merged. So the prefix that is one
character longer ends in the only token that fits behind the prefix before it. A state holds what that
needs: every place from which the text so far is the beginning of a piece, the last token up to there
(none where nothing can merge across), and how many tokens fewer there were. A transition by a byte leads to
the next state and is annotated with the tokens it adds, which can be negative, as longer pieces replace shorter ones.
Characters without a piece add their bytes. States and transitions are compiled as texts need them.

Texts are cut into chunks of equal bytes which run side by side, each from a guessed state: where the
machine comes to from some bytes before the chunk. What a chunk does is a map from the state before to the
state after and a count, known for the states tried so far. Maps compose through a prefix scan over all chunks of a
batch; where the state that arrives was not tried, the chunk runs again from it and the scan is
repeated, so the counts are exact whatever the guesses were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.base import lean, prepare, row_chunks

SPACE = "▁"
#: Bytes of a chunk, bytes before it that its guess reads, bytes of texts that run side by side.
CHUNK, BEFORE, TOGETHER = 512, 80, 8 << 20
#: States of a worker's table (a kilobyte each); a table with more is dropped before the next texts.
STATES = 150_000
#: Rounds in which every chunk tries the states that its neighbour may leave; later only those that surely arrive.
GUESSES = 16
#: Longer pieces up to which tokens are told apart by those that do not fit.
EXACT = 30
#: Answers that a worker remembers while it compiles, of each kind.
MEMORY = 1_000_000
_OFFSET = 64
_open: dict[str, Transducer] = {}

def _runs(steps: list[tuple[float, str]], useful: set[str]) -> list[tuple[float, str]]:
    """The symbols in turn, each once, with the worst score since the last other one."""
    out, worst = [(0.0, steps[0][1] if steps[0][1] in useful else "")], np.inf
    for score, symbol in steps[1:]:
        worst = min(worst, score)
        symbol = symbol if symbol in useful else ""
        if symbol != out[-1][1]:
            out.append((worst, symbol))
            worst = np.inf
    return out if worst == np.inf else [*out, (worst, out[-1][1])]


Entry = tuple[str, str | None, int]  # text since that place, token before it, tokens up to there less tokens up to here


class Transducer:
    """Counts of texts; ``step`` is the machine over characters, ``column`` runs its byte table over many texts."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train, kind = model.normalizer_spec, model.trainer_spec, model.SentencePiece
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        if not (plain and train.model_type == train.BPE and train.byte_fallback and not train.treat_whitespace_as_suffix):
            raise ValueError("only BPE vocabularies with byte fallback, a space before the text and no other changes are compiled")
        if any(x.type in (kind.USER_DEFINED, kind.UNUSED) for x in model.pieces):
            raise ValueError("vocabularies with pieces of the user's own are not compiled")
        self.score = {x.piece: x.score for x in model.pieces if x.type == kind.NORMAL}
        self.begun = {p[:i] for p in self.score for i in range(1, len(p))}  # proper beginnings of pieces
        self.pairs = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        if missing := {c for p in self.score for c in p} - self.score.keys():
            raise ValueError(f"characters of pieces that are no pieces: {sorted(missing)[:5]}")
        self.longer: dict[str, list[str]] = {}
        for p in self.score:
            for i in range(1, len(p)):
                self.longer.setdefault(p[:i], []).append(p)
        self._fit: dict[tuple[str, str], bool] = {}
        self._alike: dict[tuple[str, str], str | None] = {}
        self._unfit: dict[tuple[str, tuple[str, ...]], str] = {}
        self.ended = {p[i:] for p in self.score for i in range(1, len(p))}
        self._merges: dict[str, tuple[bool, list[tuple[float, str]], list[tuple[float, str]]]] = {}
        self._kinds: dict[tuple[tuple[float, str], ...], str] = {}
        self.clear()

    def merges(self, piece: str) -> tuple[bool, list[tuple[float, str]], list[tuple[float, str]]]:
        """(whether a piece's characters become that piece; what its last symbol is at first and after merges; the same of the first symbol).

        The best pair merges, the leftmost of equals. A symbol comes with the worst score of the merges since the
        one before; symbols that nothing outside can merge with are empty.
        """
        if piece not in self._merges:
            parts = list(piece)
            tails, heads = [(0.0, piece[-1])], [(0.0, piece[0])]
            while len(parts) > 1:
                best, at = max((self.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best == -np.inf:
                    break
                parts[-at : 2 - at] = ["".join(parts[-at : 2 - at])]
                tails.append((best, parts[-1]))
                heads.append((best, parts[0]))
            self._merges[piece] = len(parts) == 1, _runs(tails, self.begun), _runs(heads, self.ended)
        return self._merges[piece]

    def kind(self, token: str) -> str:
        """The first token met whose last symbols come and go like this one's; what fits behind one fits behind the other."""
        return self._kinds.setdefault(tuple(self.merges(token)[1]), token)

    def fits(self, before: str | None, piece: str) -> bool:
        """Whether both stay as they are beside one another: no pair across their border is ever the best one."""
        if before is None:
            return self.merges(piece)[0]
        known = self._fit.get((before, piece))
        if known is None:
            if len(self._fit) >= MEMORY:
                self._fit.clear()
            known = self._fit[before, piece] = self._apart(before, piece)
        return known

    def _apart(self, before: str, piece: str) -> bool:
        whole, _, right = self.merges(piece)
        if not whole:
            return False
        left, score = self.merges(before)[1], self.score
        i, j, n, m = 0, 0, len(left) - 1, len(right) - 1
        while True:
            across = score.get(left[i][1] + right[j][1], -np.inf) if left[i][1] and right[j][1] else -np.inf
            one, two = left[i + 1][0] if i < n else -np.inf, right[j + 1][0] if j < m else -np.inf
            if i < n and one >= across and one >= two:
                i += 1
            elif two > across:
                j += 1
            else:
                return across == -np.inf

    def alike(self, before: str | None, since: str) -> str | None:
        """The first token met that fits before the same longer pieces with that beginning; none if all of them do."""
        if before is None:
            return None
        key = (before, since)
        if key not in self._alike:
            if len(self._alike) >= MEMORY:
                self._alike.clear()
            tails = {x[1] for x in self.merges(before)[1]} - {""}
            crossing = any(a + since in self.begun or any(a + since[:i] in self.score for i in range(1, len(since) + 1)) for a in tails)
            same = None
            if crossing:
                longer = self.longer[since]
                if len(longer) > EXACT:
                    same = before
                else:
                    unfit = tuple(v for v in longer if not self.fits(before, v))
                    same = self._unfit.setdefault((since, unfit), before) if unfit else None
            self._alike[key] = same
        return self._alike[key]

    def step(self, state: tuple[Entry, ...], c: str) -> tuple[tuple[Entry, ...], int]:
        """(the state after one more character, the tokens that it adds)."""
        if c not in self.score:
            return (("", None, 0),), len(c.encode("utf-8", "surrogatepass"))
        grown, last = [], None
        for since, before, less in state:
            piece = since + c
            if not since and before and before[-1] + c not in self.pairs:
                before = None
            if last is None and piece in self.score and self.fits(before, piece):
                last = piece, less + 1
            if piece in self.begun:
                grown.append((piece, self.alike(before, piece), less))
        token, added = last  # there is always exactly one
        return (("", self.kind(token), 0), *((p, b, less - added) for p, b, less in grown)), added

    def clear(self) -> None:
        """Only the state before a text and the one behind its own space."""
        self.states: list[tuple[tuple[Entry, ...], bytes]] = []
        self.names: dict[tuple[tuple[Entry, ...], bytes], int] = {}
        self.moves = np.full(1024 * 256, -1, np.int32)
        self.fresh = self._name((("", None, 0),), b"")
        first, self.first_count = self.step(self.states[self.fresh][0], SPACE)
        self.first = self._name(first, b"")

    def _name(self, state: tuple[Entry, ...], begun: bytes) -> int:
        key = (state, begun)
        if key not in self.names:
            self.names[key] = len(self.states)
            self.states.append(key)
            if 256 * len(self.states) > len(self.moves):
                self.moves = np.concatenate([self.moves, np.full_like(self.moves, -1)])
        return self.names[key]

    def _compile(self, state: int, byte: int) -> None:
        """One transition: the next state above eight bits of the count, which is shifted to be positive."""
        text, begun = self.states[state]
        added = 0
        if byte >= 0xC0:
            after = self._name(text, bytes([byte]))
        elif byte >= 0x80:  # without a beginning only where a guess starts inside a character
            begun = begun + bytes([byte]) if begun else b""
            if begun and len(begun) == (2 if begun[0] < 0xE0 else 3 if begun[0] < 0xF0 else 4):
                text, added = self.step(text, begun.decode("utf-8", "replace"))
                begun = b""
            after = self._name(text, begun)
        else:
            text, added = self.step(text, SPACE if byte == 0x20 else chr(byte))
            after = self._name(text, b"")
        self.moves[state * 256 + byte] = after << 8 | (added + _OFFSET)

    def _run(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after, tokens added) of each stretch of the bytes, all side by side."""
        order = np.argsort(-size, kind="stable")
        at, lengths, now = at[order].astype(np.int64), size[order], state[order].astype(np.int64)
        count = np.zeros(len(at), np.int64)
        live = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")
        for k in live.tolist():
            where = now[:k] * 256 + data[at[:k]]
            move = self.moves.take(where)
            if move.min() < 0:
                for x in np.unique(where[move < 0]).tolist():
                    self._compile(x >> 8, x & 255)
                move = self.moves.take(where)
            np.right_shift(move, 8, out=now[:k], casting="unsafe")
            count[:k] += move & 255
            at[:k] += 1
        count -= _OFFSET * lengths
        after, counts = np.empty_like(now), np.empty_like(count)
        after[order], counts[order] = now, count
        return after, counts

    def column(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text; null texts are empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        parts = [self._texts(texts.slice(a, b - a)) for a, b in row_chunks(texts, TOGETHER)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def _texts(self, texts: pa.Array) -> np.ndarray:
        if len(self.states) > STATES:
            self.clear()
        texts = texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if ends[0] == ends[-1]:
            return np.zeros(len(texts), np.int64)
        data, sizes = np.frombuffer(texts.buffers()[2], np.uint8), np.diff(ends)
        chunks = -(-sizes // CHUNK)
        text = np.repeat(np.arange(len(texts)), chunks)
        first = np.cumsum(chunks) - chunks
        nth = np.arange(len(text)) - first[text]
        at = ends[:-1][text] + nth * CHUNK
        size = np.minimum(CHUNK, ends[1:][text] - at)
        back = np.minimum(at - ends[:-1][text], BEFORE)
        guess = np.where(back < BEFORE, self.first, self.fresh)
        some = np.flatnonzero(nth)
        guess[some] = self._run(data, (at - back)[some], back[some], guess[some])[0]
        counts = self._composed(data, at, size, guess, nth == 0)
        found = np.bincount(text, counts, len(texts)).astype(np.int64)  # exact in doubles below 2**53
        return found + np.where(sizes > 0, self.first_count, 0)

    def _composed(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, guess: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The count of each chunk from the state that truly arrives at it."""
        after, count = self._run(data, at, size, guess)
        tried, left, counts = [guess], [after], [count]  # of each chunk's map: states before, states after, counts
        rows = np.arange(len(at))
        place = rows - np.maximum.accumulate(np.where(first, rows, 0))
        link = np.full((len(at), 0), -1)  # which of this chunk's states is the one that its neighbour leaves from each of its own
        while True:
            new = len(tried) - 1
            link = np.column_stack([link, np.full(len(at), -1)])
            for i, j in [(i, new) for i in range(new)] + [(new, j) for j in range(new + 1)]:
                same = (tried[j][1:] == left[i][:-1]) & (tried[i][:-1] >= 0) & (link[1:, i] < 0)
                link[1:, i][same] = j
            link[first] = 0
            done, d = link.copy(), 1
            while d < len(done):  # the composition of all maps from the text's beginning
                before = done[:-d]
                onward = np.where(before >= 0, done[rows[d:, None], before], -1)
                done[d:] = np.where(place[d:, None] < d, done[d:], onward)  # a text's own beginning is reached
                d *= 2
            arrived = done[:, 0]
            if (arrived >= 0).all():
                return np.stack(counts)[arrived, rows]
            sure = np.flatnonzero((arrived[1:] < 0) & (arrived[:-1] >= 0)) + 1  # one in each text: its state arrives, but was not tried
            state = np.stack(left)[arrived[sure - 1], sure - 1]
            if len(tried) > GUESSES:
                return self._in_turn(data, at, size, np.stack(tried), np.stack(left), np.stack(counts), arrived, sure)
            more = np.full(len(at), -2)
            more[sure] = state
            texts = np.cumsum(first) - 1
            spread = np.zeros(texts[-1] + 1, np.int64) - 2
            spread[texts[sure]] = state
            later = np.flatnonzero((arrived < 0) & (more < 0))
            later = later[~(np.stack(tried)[:, later] == spread[texts[later]]).any(0)]
            more[later] = spread[texts[later]]  # what arrives at one chunk may well arrive at the others
            for i in range(len(tried)):
                lacks = (more[1:] < 0) & (arrived[1:] < 0) & (link[1:, i] < 0) & (tried[i][:-1] >= 0)
                more[1:][lacks] = left[i][:-1][lacks]
            again = np.flatnonzero(more >= 0)
            after, count = np.full(len(at), -1), np.zeros(len(at), np.int64)
            after[again], count[again] = self._run(data, at[again], size[again], more[again])
            tried.append(more)
            left.append(after)
            counts.append(count)

    def _in_turn(self, data, at, size, tried, left, counts, arrived, sure) -> np.ndarray:  # noqa: ANN001
        """The counts where guesses do not meet what arrives: the texts that are left side by side, chunk by chunk."""
        out = np.where(arrived >= 0, counts[arrived, np.arange(len(at))], 0)
        k, state = sure, left[arrived[sure - 1], sure - 1]
        while len(k):
            known = (tried[:, k] == state).argmax(0)
            after, count = left[known, k], counts[known, k]
            again = np.flatnonzero(tried[known, k] != state)
            after[again], count[again] = self._run(data, at[k[again]], size[k[again]], state[again])
            out[k] = count
            on = (k + 1 < len(at)) & (arrived[np.minimum(k + 1, len(at) - 1)] < 0)
            k, state = k[on] + 1, after[on]
        return out


def transducer(path: str) -> Transducer:
    """The worker's machine for that vocabulary file, with the states it has compiled so far."""
    if path not in _open:
        _open[path] = Transducer(path)
    return _open[path]


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row of docs, whole texts, in one pass without a shuffle.

    Null and empty texts have no bytes and no tokens; rows that repeat and rows without an id are counted
    like all others; other columns are not read. Memory is bounded by the table of states and the longest text.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b["__text"]), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], sizes, pa.array(machine.column(b["__text"]))], ["doc_id", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    read = docs.select("doc_id", F.col("text").alias("__text"))
    return read.mapInArrow(lambda b: lean(run(b)), f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
