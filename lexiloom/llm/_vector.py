"""Vectorised word hashing: whole batches of texts as code-point arrays.

A polynomial prefix hash over all code points of a batch gives the 64-bit hash
of any word, prefix or span by one subtraction and one multiplication, so no
Python loop runs over words.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
SPACE, WORD, OTHER, SINGLE = 0, 1, 2, 3
#: Texts are gathered into batches of about so many code points (a longer text is a batch of its own).
BATCH_CHARS = 1_000_000
#: An Arrow batch is worked through in slices of about so many code points (a longer text is a slice of its own).
PIECE_CHARS = 250_000


@functools.cache
def char_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, lower-case code point and upper-case flag of every code point."""
    kind = np.full(0x110000, OTHER, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    upper = np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum() or c == "_":
            kind[i] = WORD
            if c.isupper():
                upper[i] = True
            low = c.lower()
            if low != c and len(low) == 1:
                lower[i] = ord(low)
        elif c.isspace():
            kind[i] = SPACE
    kind[0x300:0x370] = WORD
    for a, b in ((0x2E80, 0x3000), (0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)):
        kind[a:b] = SINGLE
    return kind, lower, upper


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    out = _powers[0][:n], _powers[1][:n]
    if n > 8 * BATCH_CHARS:  # one very long text: do not keep tables of its size
        _powers[0], _powers[1] = _powers[0][:BATCH_CHARS].copy(), _powers[1][:BATCH_CHARS].copy()
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def batches(texts: list[str], limit: int = BATCH_CHARS):
    """Slices (start, end) of texts with about `limit` code points each."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def release() -> None:
    """Gives freed memory back to the system: a worker lives on between tasks, beside the other one and the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def pieces(batches: Iterator[pa.RecordBatch], texts: Callable[[pa.RecordBatch], pa.Array], limit: int = PIECE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Every row of the batches in order, in slices of about `limit` code points, and each slice's texts (null: empty)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.utf8_length(texts(batch)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        start = 0
        while start < len(ends):
            done = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            piece = batch.slice(start, end - start)
            yield piece, [t or "" for t in texts(piece).to_pylist()]
            start = end
        release()


class Words:
    """The words of a batch: lower-cased 64-bit hashes, code-point spans and each document's word range.

    A word is a run of letters, digits, marks and `_`; ideographs are words of
    their own. With marks=True runs of other signs count as words too.
    """

    def __init__(self, texts: list[str], marks: bool = False):
        kinds, lowers, uppers = char_tables()
        lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kinds[raw]
        code = lowers[raw]
        before = np.empty_like(kind)
        before[0], before[1:] = SPACE, kind[:-1]
        after = np.empty_like(kind)
        after[-1], after[:-1] = SPACE, kind[1:]
        inside = (kind == WORD) | (kind == SINGLE)
        if marks:
            inside |= kind == OTHER
        edge = (kind != before) | (kind == SINGLE)
        tail = (kind != after) | (kind == SINGLE)
        self.start = np.flatnonzero(inside & edge)
        self.end = np.flatnonzero(inside & tail) + 1
        power, inverse = _grow(len(raw))
        value = mix(code.astype(np.uint64) + np.uint64(0x1F123BB5))
        self._sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(value * power, out=self._sums[1:])
        self._inverse = inverse
        self.hash = self.span_hash(self.start, self.end)
        self.kind, self.upper, self.raw = kind, uppers, raw
        self.doc_end = np.cumsum(lens)
        self.doc_start = self.doc_end - lens
        self.first = np.searchsorted(self.start, self.doc_start)  # each document's first word
        self.last = np.searchsorted(self.start, self.doc_end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(np.uint64))

    def prefix_hash(self, length: int) -> np.ndarray:
        """Hash of each word's first `length` code points; 0 where the word is shorter."""
        long = self.end - self.start >= length
        out = np.zeros(len(self.start), np.uint64)
        s = self.start[long]
        out[long] = mix(self.span_hash(s, s + length) + np.uint64(length))
        return out

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first)), self.last - self.first)


def ngram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words; the last n-1 of them cross no end (the result is shorter)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out = (out ^ words[j : len(words) - n + 1 + j]) * np.uint64(0x100000001B3 + 2 * j)
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Each text's sorted set of n-word shingle hashes; a text of 1 to n-1 words has one shingle of all its words."""
    out: list[np.ndarray] = []
    for a, b in batches(texts):
        w = Words(texts[a:b])
        grams = ngram_hash(w.hash, n)
        for f, e in zip(w.first.tolist(), w.last.tolist()):
            if e - f >= n:
                out.append(np.unique(grams[f : e - n + 1]))
            elif e > f:
                out.append(ngram_hash(w.hash[f:e], e - f))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
