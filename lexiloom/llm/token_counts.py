"""Token counts by section: offset-mapped attribution.

Every document is encoded once, as a whole. Sections (here: its lines, each
with the line feed that ends it) tile the text; the character spans of the
tokens are joined to them as intervals, by binary search in the sections'
sorted starts. A token that crosses a boundary goes to one section by rule:
"first" (the one with its first character) or "majority" (the one with most of
its characters, the earlier at a tie). So the counts of a document's sections
add up to its tokens.

Scale: one pass without a shuffle; a worker holds one Arrow batch and a bounded
cache. Defined cases: ids are integers or cast to them; null text counts as empty; an empty text has one empty
section with 0 tokens; repeated rows are counted each; an empty table gives an
empty result; other columns are not read. Very long texts are encoded whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _rows
from ._bpe import encoder

SCHEMA = "doc_id long, section int, start int, end int, n_tokens int, doc_tokens int"
RULES = ("first", "majority")


def attribute(starts: np.ndarray, size: int, begin: np.ndarray, end: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section. starts: sorted section starts, the first 0; begin, end: token spans."""
    at = np.searchsorted(starts, begin, side="right") - 1
    if rule == "majority":
        last = np.searchsorted(starts, np.maximum(end - 1, begin), side="right") - 1
        for i in np.flatnonzero(last > at):
            edges = np.append(starts[at[i] : last[i] + 1], min(size, end[i])).astype(np.int64)
            edges[0] = begin[i]
            at[i] += int(np.argmax(np.diff(edges)))
    return np.bincount(at, minlength=len(starts))


def section_token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "first") -> DataFrame:
    """One row per section: doc_id, section (from 0), start, end (code points), n_tokens, doc_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = batch.column(0)
            for first, _, bounds, begin, end in enc.encode(texts, spans=True):
                cols: list[list] = [[] for _ in range(5)]
                rows = []
                for k in range(len(bounds) - 1):
                    text = texts[first + k]
                    size = len(text)
                    starts = [0]
                    p = text.find("\n")
                    while 0 <= p < size - 1:
                        starts.append(p + 1)
                        p = text.find("\n", p + 1)
                    s = np.array(starts)
                    lo, hi = bounds[k], bounds[k + 1]
                    got = attribute(s, size, begin[lo:hi], end[lo:hi], rule)
                    rows += [first + k] * len(s)
                    for c, v in zip(cols, (np.arange(len(s)), s, np.append(s[1:], size), got, np.full(len(s), hi - lo))):
                        c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), *(pa.array(np.concatenate(c).astype(np.int32)) for c in cols)], ["doc_id", "section", "start", "end", "n_tokens", "doc_tokens"]
                )

    return docs.select(_rows.named(id_col).cast("long").alias("doc_id"), _rows.named(text_col).alias("text")).mapInArrow(run, SCHEMA)
