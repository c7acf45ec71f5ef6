"""Quality: hashed word n-gram logistic regression trained by FTRL.

Words, runs of signs and their shapes (capitals, digits, signs) are hashed as
n-grams into a fixed number of buckets, with a few hashed summaries (repeated
word triples, shares of capitals and signs). The weights are learned with
follow-the-regularised-leader updates over a bounded sample, and a text's
score is the logistic of the sparse dot product of its n-gram shares and them.

Scale: training sees at most `per_class` labelled ids a class, one text of each,
and streams them through one task, in the order of epoch and a hash of the id
(the updates follow one another by definition); it holds the texts of one batch
and the model's state, and only the model, one array of 2**BITS floats, goes to
the driver. Scoring is one pass without a shuffle over whole texts, vectorised
per Arrow batch.

Defined cases: ids are integers or cast to them; null text counts as empty; an
empty text is scored by its summary features alone; without training rows every
score is 0.0 (logistic of -35), with rows of one class only it is the logistic
of 35 or -35; repeated rows are scored each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _rows, _vector
from ._labels import training_sample
from ._store import stage

BITS = 18
PER_CLASS = 3_000
ALPHA, BETA, L1, L2, EPOCHS = 0.2, 1.0, 0.02, 0.5, 3
SCALE = 12.0


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def _bucket(h: np.ndarray, family: int) -> np.ndarray:
    return (_vector.mix(h ^ np.uint64(0x5851F42D4C957F2D * (family + 1) & (2**64 - 1))) >> np.uint64(64 - BITS)).astype(np.int64)


def _grams(texts: list[str]):
    """For a batch: bucket ids, values and the document of each, not summed."""
    w = _vector.Words(texts, marks=True)
    n = len(w.hash)
    doc = w.doc_of_word()
    words = w.last - w.first
    upper = np.append(0, np.cumsum(w.upper[w.raw]))
    digit = np.append(0, np.cumsum((w.raw >= 48) & (w.raw <= 57)))
    size = w.end - w.start
    caps, digits = upper[w.end] - upper[w.start], digit[w.end] - digit[w.start]
    sign = w.kind[w.start] == _vector.OTHER if n else np.zeros(0, bool)
    shape = np.select([sign, digits == size, digits > 0, (caps == size) & (size > 1), w.upper[w.raw[w.start]], caps > 0], [1, 2, 3, 4, 5, 6], 7) if n else np.zeros(0, int)
    shape = (shape * 4 + np.minimum(size, 12) // 4).astype(np.uint64)
    ids, vals, docs = [], [], []
    share = SCALE / np.maximum(1, words)

    def add(h: np.ndarray, k: int, family: int) -> None:
        d = doc[: len(h)]
        ok = d == doc[k - 1 : k - 1 + len(h)]
        ids.append(_bucket(h[ok], family))
        docs.append(d[ok])
        vals.append(share[d[ok]])

    add(w.hash, 1, 0)
    add(_vector.ngram_hash(w.hash, 2), 2, 1)
    for k in (1, 2, 3):
        add(_vector.ngram_hash(shape, k), k, 1 + k)
    # summaries: shares in tenths of repeated word triples, capitals and signs, and the length
    triple = _vector.ngram_hash(w.hash, 3)
    d3 = doc[: len(triple)]
    ok = d3 == doc[2 : 2 + len(triple)]
    order = np.lexsort((triple[ok], d3[ok]))
    t, d = triple[ok][order], d3[ok][order]
    again = np.zeros(len(t), bool)
    again[1:] = (t[1:] == t[:-1]) & (d[1:] == d[:-1])
    m = len(texts)
    for family, hits in ((10, np.bincount(d[again], minlength=m)), (11, np.bincount(doc[(caps == size) & (size > 1)], minlength=m)), (12, np.bincount(doc[sign], minlength=m)), (13, None)):
        level = np.minimum(20, np.log2(words + 1).astype(int)) if hits is None else np.ceil(10 * hits / np.maximum(1, words)).astype(int)
        ids.append(_bucket(level.astype(np.uint64), family))
        docs.append(np.arange(m))
        vals.append(np.full(m, 0.3 if hits is None else 1.0))
    return np.concatenate(ids), np.concatenate(vals), np.concatenate(docs)


class Ftrl:
    """Follow-the-regularised-leader state of a logistic regression; the last weight is the bias. Classes weigh the same."""

    def __init__(self, clean: int, good: int):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        rows = clean + good
        self.weight = (0.5 * rows / max(1, clean), 0.5 * rows / max(1, good))

    def leader(self, i) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2))

    def update(self, y: int, ids: np.ndarray, vals: np.ndarray) -> None:
        """One example: distinct buckets and their values."""
        i, v = np.append(ids, 1 << BITS), np.append(vals, 1.0)
        w = self.leader(i)
        g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * self.weight[y] * v
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        self.z[i] += g - sigma * w
        self.n[i] += g * g


def _examples(texts: list[str]):
    """Buckets and summed values of each text."""
    for a, b in _vector.batches(texts):
        ids, vals, doc = _grams(texts[a:b])
        key, back = np.unique(doc.astype(np.int64) << BITS | ids, return_inverse=True)
        val = np.bincount(back, vals, len(key))
        cut = np.searchsorted(key >> BITS, np.arange(b - a + 1))
        for k in range(b - a):
            own = slice(cut[k], cut[k + 1])
            yield key[own] & ((1 << BITS) - 1), val[own]


def fit(docs: DataFrame, labelled: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", epochs: int = EPOCHS) -> Model:
    """Fits on a bounded sample of labelled rows."""
    sample = stage(training_sample(docs, labelled, label_col, per_class, id_col, text_col), "quality-sample")
    sizes = {int(r[0]): int(r[1]) for r in sample.groupBy("label").count().collect()}  # two rows
    clean, good = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not good:
        return Model(np.zeros(1 << BITS, np.float32), 35.0 if good else -35.0)

    def train(batches):
        state = Ftrl(clean, good)
        for batch in batches:
            for y, (ids, vals) in zip(batch.column(0).to_pylist(), _examples(batch.column(1).to_pylist())):
                state.update(y, ids, vals)
        w = state.leader(slice(None))
        yield pa.RecordBatch.from_arrays([pa.array([w[:-1].astype("<f4").tobytes()], pa.binary()), pa.array([float(w[-1])])], ["weights", "bias"])

    turns = sample.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    ordered = turns.repartition(1).sortWithinPartitions("epoch", F.xxhash64("doc_id", F.lit(7)), "doc_id")  # at most 2 * per_class texts, each `epochs` times
    weights, bias = ordered.select("label", "text").mapInArrow(train, "weights binary, bias double").first()
    return Model(np.frombuffer(weights, "<f4"), bias)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1), predicted."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = []
            for a, b in _vector.batches(texts):
                ids, vals, doc = _grams(texts[a:b])
                z = np.bincount(doc, model.weights[ids] * vals, b - a) + model.bias
                out.append(1 / (1 + np.exp(-np.clip(z, -35, 35))))
            s = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(_rows.named(id_col).cast("long").alias("doc_id"), _rows.named(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
