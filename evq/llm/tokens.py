"""Token ids of whole texts with a tokenizer file, encoding every distinct piece between blanks once.

Both tokenizer files of this kind split a text by a pattern before they merge, and no split crosses a single space or
line feed that stands between two other characters. Such a blank is therefore a safe place to cut before: the ids of a text
are the ids of its cuts in a row, and a worker keeps the ids of cuts it has met. Between a Latin letter and a sign of ASCII
other than the apostrophe is a split too, so that " word", " word," and " word.)" share an entry. The memory is bounded; what
falls out is encoded again. A piece takes a few hundred bytes, so the bound is an argument, for workers that share their
executor with full heaps. Texts are cut, and the ids of their pieces joined, as Arrow columns: Python sees the distinct
pieces of a part alone.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from evq.llm.flat import slices, text_bytes

#: Latin letters of one or two bytes, but for İ: its lower case ends in a combining dot, which is no letter.
LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
LETTER = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)])
SIGN = np.isin(np.arange(256), [x for x in range(0x21, 0x7F) if not chr(x).isalnum() and x != 0x27])
#: Bytes that are blanks of Python's ``str.isspace``, and the blanks of more than one byte.
BLANK = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21)])
WIDE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Pieces that a worker keeps, and the longest that it keeps.
KEPT, LONGEST = 1_200_000, 64


class PieceMemory:
    """Ids (little-endian unsigned 32-bit, as bytes) of pieces; ``encode`` gives those of a list of new ones.

    Once there are more than ``kept``, only the pieces of the latest texts stay, among them nearly all frequent ones.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], kept: int = KEPT):
        self.encode, self.kept, self.known = encode, kept, {}

    def each(self, pieces: list[str]) -> list[bytes]:
        """The ids of every piece; no piece may occur twice."""
        known = self.known
        out = list(map(known.get, pieces))
        new = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(new, self.encode([pieces[k] for k in new]), strict=True):
            out[k] = ids
            if len(pieces[k]) <= LONGEST:
                known[pieces[k]] = ids
        if len(known) > self.kept:
            latest = {p: known[p] for p in pieces if p in known}
            self.known = latest if len(latest) <= self.kept else {}
        return out

    def of(self, texts: list[list[str]]) -> list[bytes]:
        """The joined ids of every text, given as its list of pieces."""
        used = list(set().union(*texts))
        ids = dict(zip(used, self.each(used), strict=True))
        return [b"".join(map(ids.__getitem__, t)) for t in texts]


class Tokenizer:
    """One tokenizer file; special tokens in a text are ordinary text, none are added."""

    def __init__(self, path: str, kept: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Backend

        self.backend = Backend.from_file(path)
        self.backend.encode_special_tokens = True
        self.heads = PieceMemory(self._ids, kept)
        self.rest = PieceMemory(self._rest, kept)
        # Ids that end a word, or else ids that begin one after a blank.
        vocabulary = self.backend.get_vocab()
        self.ends = any(t.endswith("</w>") for t in vocabulary)
        self.marks = np.zeros(max(vocabulary.values()) + 1, bool)
        self.marks[[i for t, i in vocabulary.items() if (t.endswith("</w>") if self.ends else t.startswith(("Ġ", "Ċ")))]] = True

    def _ids(self, pieces: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.backend.encode_batch_fast(pieces, add_special_tokens=False)]

    def _words(self, words: pa.LargeStringArray, together: int = 256) -> list[bytes]:
        """Ids of words of Latin letters after a blank: encoded as lines of words and cut at the marks."""
        data, offsets = text_bytes(words)
        first = np.arange(0, len(words), together)
        lines = strings(data, np.append(offsets[first], len(data))).to_pylist()
        out: list[bytes] = []
        for a, found in zip(first.tolist(), self.backend.encode_batch_fast(lines, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            cuts = np.flatnonzero(self.marks[ids])
            cuts = [0, *(4 * cuts + 4).tolist()] if self.ends else [*(4 * cuts).tolist(), 4 * len(ids)]
            line = words[a:a + together]
            if len(cuts) != len(line) + 1 or cuts[0] or cuts[-1] != 4 * len(ids):
                out += self._ids(line.to_pylist())
                continue
            joined = ids.tobytes()
            out += [joined[i:j] for i, j in pairwise(cuts)]
        return out

    def _rest(self, new: list[str]) -> list[bytes]:
        """Ids of pieces that begin with a blank."""
        pieces = pa.array(new, pa.large_string())
        plain = pc.match_substring_regex(pieces, rf"\A[ \n][{LATIN}]+\z")
        words = iter(self._words(pieces.filter(plain)))
        other = iter(self._ids(pieces.filter(pc.invert(plain)).to_pylist()))
        return [next(words if x else other) for x in plain.to_numpy(zero_copy_only=False).tolist()]

    def _each(self, pieces: pa.LargeStringArray) -> list[bytes]:
        """Ids of distinct pieces."""
        after = pc.match_substring_regex(pieces, r"\A[ \n]")
        rest = iter(self.rest.each(strs(pieces.filter(after))))
        heads = iter(self.heads.each(strs(pieces.filter(pc.invert(after)))))
        return [next(rest if x else heads) for x in after.to_numpy(zero_copy_only=False).tolist()]

    def encode_column(self, column: pa.Array, end: bytes = b"") -> tuple[memoryview, np.ndarray]:
        """(ids of all texts in a row, byte offset of each text and the end); ``end`` follows every text, a null is empty."""
        data, offsets = text_bytes(column)
        starts, bounds = cut(data, offsets, pc.match_substring_regex(column, WIDE))
        pieces = strings(data, np.append(starts, len(data))).dictionary_encode()
        codes = np.insert(pieces.indices.to_numpy(), bounds[1:], len(pieces.dictionary))
        ids = pa.array([*self._each(pieces.dictionary), end], pa.large_binary())
        _, at, joined = ids.take(pa.array(codes)).buffers()
        return memoryview(joined or b"").cast("B"), np.frombuffer(at, np.int64)[bounds + np.arange(len(bounds))]

    def encode(self, texts: list[str]) -> list[bytes]:
        data, bounds = self.encode_column(pa.array(texts, pa.large_string()))
        return [bytes(data[a:b]) for a, b in pairwise(bounds.tolist())]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.LargeStringArray:
    """The strings that ``offsets`` cut out of UTF-8 bytes, without a copy."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))


def strs(values: pa.LargeStringArray) -> list[str]:
    """As ``to_pylist``, without a scalar for every value."""
    return values.to_numpy(zero_copy_only=False).tolist()


def cut(data: np.ndarray, offsets: np.ndarray, wide: pa.BooleanArray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of every piece, number of pieces before each text and the end); an empty text has none.

    A piece begins with its text, with a space or line feed inside it that has no blank beside it, or with a sign after a
    Latin letter. In a text with a blank of several bytes (``wide``) both neighbours of a space must be single bytes.
    """
    size = len(data)
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[(at > 0) & (at < size - 1)]
    left, right = data[at - 1], data[at + 1]
    safe = ~(BLANK[left] | BLANK[right])
    rows = pc.fill_null(wide, False).to_numpy(zero_copy_only=False)
    if rows.any():
        safe &= ~rows[np.searchsorted(offsets, at, side="right") - 1] | ((left < 0x80) & (right < 0x80))
    first = np.zeros(size + 1, bool)
    first[at[safe]] = True
    first[offsets[1:] - 1] = False
    at = np.flatnonzero(SIGN[data[1:]]) + 1
    one, two = data[at - 1], data[np.maximum(at - 2, 0)]
    letter = LETTER[one] | (one >= 0x80) & (two >= 0xC3) & (two <= 0xC8)  # À to ȿ, but for × ÷ İ
    letter &= ~((two == 0xC3) & ((one == 0x97) | (one == 0xB7)) | (two == 0xC4) & (one == 0xB0))
    first[at[letter]] = True
    first[offsets] = True
    starts = np.flatnonzero(first[:size])
    return starts, np.searchsorted(starts, offsets)


@lru_cache(maxsize=2)
def tokenizer(path: str, kept: int = KEPT) -> Tokenizer:
    """One per worker process, file and bound."""
    return Tokenizer(path, kept)


def texts_of(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end row, texts) in parts of at most ``limit`` bytes; a null is an empty text."""
    values = batch.column(column)
    _, offsets = text_bytes(values)
    for i, j in slices(offsets, limit):
        yield i, j, [x or "" for x in values[i:j].to_pylist()]
