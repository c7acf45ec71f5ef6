"""Whole-document byte-level BPE encoding for batches, with character offsets.

Texts are cut into pre-tokens by array operations; each distinct pre-token of a
batch is encoded once by the tokenizer library and kept in a bounded cache, and
the ids of whole documents are gathered from there. As the library does by
default, the strings of added tokens inside a text (`<|endoftext|>`) become those
tokens; what stands between them is cut into pre-tokens on its own.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import unicodedata

import numpy as np

from . import _vector

_SPACE, _LETTER, _NUMBER, _OTHER, _END = 0, 1, 2, 3, 4
#: White_Space of Unicode; fixed values.
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CACHE_WORDS = 300_000


@functools.cache
def _classes() -> np.ndarray:
    out = np.full(0x110000, _OTHER, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        if c == "L":
            out[i] = _LETTER
        elif c == "N":
            out[i] = _NUMBER
    out[_WHITE] = _SPACE
    return out


def _starts(raw: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """True where a pre-token begins (and at every end mark)."""
    n = len(raw)
    st = np.empty(n, bool)
    st[0] = True
    st[1:] = kind[1:] != kind[:-1]
    ends = kind == _END
    st |= ends
    # the last character of a white-space run before other text: a blank joins that text, any other stands alone
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _END))
    st[last] = True
    st[last[raw[last] == 32] + 1] = False
    # contractions: an apostrophe alone, begun as a token of its own, then certain letters
    p = np.flatnonzero((raw == 39) & st)
    p = p[p + 2 < n]  # the slice ends in an end mark, which is no letter
    p = p[(kind[p + 1] == _LETTER)]
    one = np.isin(raw[p + 1], [ord(c) for c in "stmd"])
    a, b = raw[p + 1], raw[p + 2]
    two = ~one & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
    st[p[one | two] + 1] = False
    for chosen, width in ((one, 2), (two, 3)):
        after = p[chosen] + width
        st[after[kind[after] == _LETTER]] = True
    return st


def _merger(path: str):
    """Pre-token -> ids by merge ranks, much faster for single words; None unless the file's ids are in the order of its merges."""
    import tiktoken

    model = json.load(open(path, encoding="utf-8"))["model"]
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made) or model.get("dropout"):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    signs = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(signs[c] for c in t): i for t, i in model["vocab"].items() if all(c in signs for c in t) and (len(t) == 1 or i >= made[0])}
    special = {t: i for t, i in model["vocab"].items() if i > made[-1]}
    ranks = {t: i for t, i in ranks.items() if i not in special.values()}
    return tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    def __init__(self, path: str, spans: bool = True):
        """spans: whether encode can give the character span of every id."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        added = json.load(open(path, encoding="utf-8")).get("added_tokens") or []
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take in what stands beside them are not supported")
        self._added = {t["content"]: t["id"] for t in added}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if added else None
        self._spans = spans
        self._merge = None if spans else _merger(path)
        self._reset()

    def _reset(self) -> None:
        self._slot: dict[str, int] = {}
        self._ids = np.zeros(0, np.uint32)
        self._from, self._to = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self._off, self._len = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _slots(self, words: list[str]) -> np.ndarray:
        if len(self._slot) > CACHE_WORDS:
            self._reset()
        new = [w for w in words if w not in self._slot]
        if new:
            if self._merge:
                ids = [[self._added[w]] if w in self._added else self._merge(w) for w in new]
            else:
                coded = self._tok.encode_batch(new, add_special_tokens=False)
                ids = [c.ids for c in coded]
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            at = len(self._ids)
            self._off = np.concatenate([self._off, at + np.cumsum(lens) - lens])
            self._len = np.concatenate([self._len, lens])
            self._ids = np.concatenate([self._ids, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lens.sum()))])
            if self._spans:
                span = np.array([x for c in coded for x in c.offsets], np.int32).reshape(-1, 2)
                self._from, self._to = np.concatenate([self._from, span[:, 0]]), np.concatenate([self._to, span[:, 1]])
            base = len(self._slot)
            self._slot.update((w, base + k) for k, w in enumerate(new))
        return np.fromiter((self._slot[w] for w in words), np.int64, len(words))

    def encode(self, texts: list[str], spans: bool = False):
        """Yields (first, ids per text flat, bounds[, from, to]) for slices of texts; bounds has len+1 entries.

        from and to are the code-point span of each id within its own text.
        """
        for a, b in _vector.batches(texts):
            # segments: texts, cut at added tokens, which are segments of their own
            part, first_of, added = self._segments(texts[a:b])
            joined = "\n".join(part) + "\n"
            raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            lens = np.fromiter((len(t) + 1 for t in part), np.int64, len(part))
            seg_end = np.cumsum(lens) - 1
            seg_start = seg_end - lens + 1
            kind = _classes()[raw]
            kind[seg_end] = _END
            begins = _starts(raw, kind)
            for k in added:
                begins[seg_start[k] + 1 : seg_end[k]] = False
            st = np.flatnonzero(begins)
            word = kind[st] != _END
            start, end = st[word], np.append(st[1:], len(raw))[word]
            power, inverse = _vector._grow(len(raw))
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_vector.mix(raw.astype(np.uint64) + np.uint64(77)) * power, out=sums[1:])
            key = _vector.mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
            _, first, back = np.unique(key, return_index=True, return_inverse=True)
            slot = self._slots([joined[s:e] for s, e in zip(start[first].tolist(), end[first].tolist())])[back]
            count = self._len[slot]
            before = np.cumsum(count) - count
            take = np.repeat(self._off[slot] - before, count) + np.arange(int(count.sum()))
            doc_start = np.append(seg_start, len(raw))[first_of]
            bounds = np.append(before, count.sum())[np.searchsorted(start, doc_start)]
            ids = self._ids[take]
            if spans:
                # a place in a text: its place in the slice less the text's start and the end marks of earlier segments of the text
                of = np.searchsorted(seg_start, start, side="right") - 1
                doc = np.searchsorted(first_of, of, side="right") - 1
                base = np.repeat(start - doc_start[doc] - (of - first_of[doc]), count)
                yield a, ids, bounds, base + self._from[take], base + self._to[take]
            else:
                yield a, ids, bounds

    def _segments(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[int]]:
        """Segments, the first one of each text (and their number), and which are added tokens."""
        if not self._added or not any(s in t for t in texts for s in self._added):
            return texts, np.arange(len(texts) + 1), []
        part, first_of, added = [], [0], []
        for t in texts:
            for k, s in enumerate(self._cut.split(t)):  # every second one is an added token
                if k % 2:
                    added.append(len(part))
                part.append(s)
            first_of.append(len(part))
        return part, np.array(first_of), added


@functools.lru_cache(maxsize=4)
def encoder(path: str, spans: bool = True) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path, spans)
