"""Token ids of whole texts by the tokenizers library, with memory of pieces seen before.

Both vocabularies split a text before they merge, and some split points can be told from white
space alone: a space or a line end between two other characters always starts a new piece. Columns of
texts are cut there by Arrow, which also finds the distinct pieces; the ids of each are asked of the
library once per worker and kept as bytes, and a take over them gives the ids of all texts. Texts
with unusual white space, or with the string of an added token, go to the library as a whole.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from newsloom.llm.base import row_chunks

# How the two kinds of vocabulary split a text before they merge.
SPACED_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"""

#: Words a worker remembers; a full memory still takes those that a chunk repeats, and starts anew a quarter beyond.
REMEMBERED = 800_000
#: Parts, and pieces of several parts, with other characters than letters that a worker remembers, and characters of the longest.
PARTS, LONGEST = 100_000, 256
#: Bytes of texts that are cut into pieces at once.
CHUNK = 8 << 20
ODD_SPACE = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
CONTROL = re.compile("[\x1c-\x1f]")
#: Starts a piece that has no space before it; texts that hold it are not cut.
BARE = "\x1d"
_open: dict[tuple[str, str], PieceEncoder] = {}


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte.

    Printable Latin-1 bytes stand for themselves, the others take the characters from U+0100 on.
    """
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


def strings(column: pa.Array) -> list[str]:
    """A column of texts without nulls as a list; by way of an object array, which takes a tenth of ``to_pylist``'s time."""
    return column.to_numpy(zero_copy_only=False).tolist()


class PieceEncoder:
    """Texts to ids, as little-endian unsigned integers in bytes (``width``: "<u2" or "<u4")."""

    def __init__(self, path: str, width: str = "<u4", remembered: int | None = None):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.words = Tokenizer(self.model)  # words as they are, not normalised, not split
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spaced = self.tokenizer.normalizer is None  # a piece keeps the space before it
        added = [("(?i:%s)" if t.normalized else "%s") % re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        before_space = ["[ \\n\\t\\r\\x0b\\x0c] "] if self.spaced else []  # white space before a space may be one piece with it
        self.uncut = "|".join([ODD_SPACE, *before_space, *added])
        self.letters = byte_alphabet()
        self.width, self.remembered = np.dtype(width), REMEMBERED if remembered is None else remembered
        self.pack = [struct.Struct(f"<{n}{'H' if self.width.itemsize == 2 else 'I'}").pack for n in range(16)]
        self.lengths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.lengths[i] = len(token.removesuffix(self.model.end_of_word_suffix or ""))
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.mixed: dict[str, bytes] = {}
        self.marks = {c: self._part(c) for c in ".,\n"}
        self.split = regex.compile(SPACED_SPLIT if self.spaced else PLAIN_SPLIT)

    def _packed(self, ids: list[int]) -> bytes:
        return self.pack[len(ids)](*ids) if len(ids) < len(self.pack) else np.array(ids, self.width).tobytes()

    def whole(self, text: str) -> bytes:
        """Straight from the library."""
        return self._packed(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def encode(self, text: str | None) -> bytes:
        """The ids of one text; a null one has none."""
        return self.column(pa.array([text], pa.string()))[0].as_py()

    def column(self, texts: pa.Array, end: int | None = None) -> pa.Array:
        """The ids of each text as binary, with the end id after them if there is one; null texts are empty."""
        texts = pc.fill_null(texts, "")
        parts = [self._chunk(texts.slice(a, b - a), end) for a, b in row_chunks(texts, CHUNK)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    def _chunk(self, texts: pa.Array, end: int | None) -> pa.Array:
        uncut = pc.match_substring_regex(texts, self.uncut)
        if self.spaced:
            lines = pc.if_else(pc.match_substring_regex(texts, r"\n\n|\n\z"), texts, pc.replace_substring(texts, "\n", f" {BARE}\n"))
            lists = pc.split_pattern(pc.if_else(uncut, BARE, pc.binary_join_element_wise(BARE, lines, "")), " ")
        else:
            lists = pc.ascii_split_whitespace(pc.if_else(uncut, BARE, texts))
        pieces, ends = lists.values.dictionary_encode(), lists.offsets.to_numpy()
        parts, table = self._atoms(pieces.dictionary)
        atoms = np.full((len(pieces), parts.shape[1] + 1), -1, np.int32)
        atoms[:, :-1] = parts[pieces.indices.to_numpy()]
        if pc.any(uncut).as_py():
            rows = np.flatnonzero(uncut.to_numpy(zero_copy_only=False))
            atoms[ends[rows], 0] = np.arange(len(table), len(table) + len(rows))
            table += [self.whole(t) for t in strings(texts.take(pa.array(rows)))]
        if end is not None:
            atoms[ends[1:] - 1, -1] = len(table)
            table.append(self._packed([end]))
        flat = atoms.ravel()
        some = flat >= 0
        ends = np.concatenate([[0], np.cumsum(some, dtype=np.int64)])[ends.astype(np.int64) * atoms.shape[1]]
        ids = pa.array(table, pa.binary()).take(pa.array(flat[some]))
        places = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(places[ends].tobytes()), ids.buffers()[2]])

    def _atoms(self, pieces: pa.Array) -> tuple[np.ndarray, list[bytes]]:
        """(up to three places in the table for each distinct piece, -1 for none; the table of ids)."""
        flags = lambda c: c.to_numpy(zero_copy_only=False)
        word = pieces
        if self.spaced:
            bare = pc.starts_with(pieces, BARE)
            word = pc.if_else(bare, pc.utf8_slice_codeunits(word, 1), word)
            line = pc.and_(bare, pc.starts_with(word, "\n"))
            word = pc.if_else(line, pc.utf8_slice_codeunits(word, 1), word)
        stop, comma = pc.ends_with(word, "."), pc.ends_with(word, ",")
        word = pc.if_else(pc.or_(stop, comma), pc.utf8_slice_codeunits(word, 0, -1), word)
        plain = pc.utf8_is_alpha(word)
        if self.spaced:
            word = pc.if_else(bare, word, pc.binary_join_element_wise("", word, " "))
        else:  # beyond Latin-1 letters may have other forms
            plain = pc.and_(plain, pc.invert(pc.match_substring_regex(word, r"[^\x{00}-\x{ff}]")))
            word = pc.utf8_lower(word)
        words = word.filter(plain).dictionary_encode()
        table = [*self.marks.values(), *self._words(words)]
        plain = flags(plain)
        parts = np.full((len(pieces), 3), -1, np.int32)
        parts[plain, 1] = words.indices.to_numpy() + len(self.marks)
        if self.spaced:
            parts[flags(line) & plain, 0] = 2
        parts[flags(stop) & plain, 2] = 0
        parts[flags(comma) & plain, 2] = 1
        rest = np.flatnonzero(~plain)
        parts[rest, 1] = np.arange(len(table), len(table) + len(rest))
        for p in strings(pieces.take(pa.array(rest))):
            ids = self.mixed.get(p)
            if ids is None:
                ids = self._mixed(p[1:] if p[:1] == BARE else " " + p if self.spaced else p)
                if len(p) <= LONGEST:
                    if len(self.mixed) >= PARTS:
                        self.mixed.clear()
                    self.mixed[p] = ids
            table.append(ids)
        return parts, table

    def _words(self, words: pa.DictionaryArray) -> list[bytes]:
        """The ids of the distinct words; those not met before go to the model in one call."""
        names = strings(words.dictionary)
        out: list[bytes | None] = list(map(self.known.get, names))
        new = [i for i, ids in enumerate(out) if ids is None]
        if not new:
            return out
        ids = np.array(self.words.encode_batch_fast([[names[i] for i in new]], is_pretokenized=True, add_special_tokens=False)[0].ids, self.width)
        # a word's tokens spell its bytes, so these tell where the ids of each word end
        spelled, wanted = np.cumsum(self.lengths[ids]), np.cumsum(pc.binary_length(words.dictionary.take(pa.array(new))).to_numpy().astype(np.int64))
        last = np.searchsorted(spelled, wanted)
        if last[-1] != len(ids) - 1 or (spelled[last] != wanted).any():
            raise ValueError("this vocabulary has words that its tokens do not spell")
        data, ends = ids.tobytes(), (self.width.itemsize * (last + 1)).tolist()
        for i, a, b in zip(new, [0, *ends[:-1]], ends, strict=True):
            out[i] = data[a:b]
        if len(self.known) >= self.remembered:
            often = np.bincount(words.indices.to_numpy(), minlength=len(names)) > 1
            new = [i for i in new if often[i]]
            if len(self.known) >= self.remembered + self.remembered // 4:
                self.known.clear()
        self.known.update((names[i], out[i]) for i in new if len(names[i]) <= LONGEST)
        return out

    def _mixed(self, text: str) -> bytes:
        """Split as the vocabulary does and ask the model for each part; beyond Latin-1 the library does it all."""
        if not text:
            return b""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        if CONTROL.search(text):
            return self.whole(text)
        text = text if self.spaced else text.lower()
        parts = self.split.findall(text)
        if "".join(parts) != text:
            return self.whole(text)
        return b"".join(map(self._part, parts))

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = self._packed([t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, part.encode())))])
            if len(part) <= LONGEST:
                if len(self.parts) >= PARTS:
                    self.parts.clear()
                self.parts[part] = ids
        return ids


def encoder(path: str, width: str = "<u4", remembered: int | None = None) -> PieceEncoder:
    """The worker's encoder for that vocabulary file; a word it remembers takes some 200 bytes."""
    if (path, width) not in _open:
        _open[path, width] = PieceEncoder(path, width)
    _open[path, width].remembered = REMEMBERED if remembered is None else remembered
    return _open[path, width]


def vocabulary_size(path: str) -> int:
    return encoder(path).tokenizer.get_vocab_size()
