"""Toxicity: maximum-scoring segments of token log-odds.

Tokens (words and their prefixes, for inflected forms) get the log-odds of
standing in a toxic against a clean labelled document, under an informative
Dirichlet prior from both; only tokens whose likelihood ratio is significant
for the number of tokens tried count, every other word costs a small constant.
A linear-time scan finds all maximal-scoring segments of a text. Extreme-value
statistics of clean documents (lambda from the score distribution, K from the
segments found there) turn a segment's score into an E-value for the length of
its text; the significant segments of a document are summed, and a logistic
curve over that sum gives the document's score.

Scale: the model is fitted on at most `per_class` labelled ids a class, one text
of each (near copies among them count once); it has the significant tokens of
that sample, all of them, and its statistics of clean text are a histogram; scoring
is one pass without a shuffle, whole texts, vectorised per Arrow batch, in time
linear in the words.

Defined cases: ids are integers or cast to them; null text counts as empty; an empty text has no segment and the
lowest score; without toxic training rows all scores are 0; repeated rows are
scored each; an empty table gives an empty result; `without_toxic` keeps all
columns of its input, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _rows, _vector
from ._labels import training_sample
from ._store import stage

PREFIXES = (4, 5, 6)
PER_CLASS = 8_000
#: Segment scores of clean text are counted in steps of 1 / SCORE_STEPS.
SCORE_STEPS = 64
#: Prior documents; log-odds are bounded by LIMIT; share of toxic words in a toxic passage; E-value of a significant segment.
PRIOR, LIMIT, DENSITY, SIGNIFICANT = 50.0, 9.0, 0.15, 0.01


@dataclass
class Model:
    keys: np.ndarray  # sorted token hashes
    scores: np.ndarray
    drift: float
    lam: float
    k: float
    slope: float
    offset: float


def _features(w: _vector.Words) -> list[np.ndarray]:
    return [w.hash, *(w.prefix_hash(n) for n in PREFIXES)]


def _word_scores(w: _vector.Words, keys: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The largest log-odds among each word's tokens; 0 where none counts."""
    out = np.zeros(len(w.hash))
    if len(keys):
        for h in _features(w):
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            np.maximum(out, np.where(keys[at] == h, scores[at], 0.0), out=out)
    return out


def maximal_segments(at: list[int], score: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last position, score) of a sequence that scores `score` at the positions `at` and -drift elsewhere.

    Linear in the positions: where no candidate begins lower, all are final and
    leave the stack; else each candidate keeps the place of the nearest one that
    does, and a later search jumps over what lies between.
    """
    done: list[tuple[int, int, float]] = []
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, total before, total after, nearest candidate that begins lower
    total, previous = 0.0, None
    for p, s in zip(at, score):
        before = total - (drift * (p - previous - 1) if previous is not None else 0.0)
        total, previous = before + s, p
        first, left, right = p, before, total
        j = len(stack) - 1
        while j >= 0 and stack[j][2] >= left:
            j = stack[j][4]
        while j >= 0 and stack[j][3] < right:  # the candidate takes in all from the jth on
            first, _, left, _, lower = stack[j]
            del stack[j:]
            j = lower
        if j < 0:
            done += [(a, b, r - l) for a, b, l, r, _ in stack]
            stack = []
        stack.append((first, p, left, right, j))
    return done + [(a, b, r - l) for a, b, l, r, _ in stack]


def _scan(texts: list[str], keys: np.ndarray, scores: np.ndarray, drift: float):
    """For each text: words, and its maximal segments (start, end code point, score)."""
    for a, b in _vector.batches(texts):
        w = _vector.Words(texts[a:b])
        s = _word_scores(w, keys, scores)
        hot = np.flatnonzero(s > 0)
        lo, hi = np.searchsorted(hot, w.first), np.searchsorted(hot, w.last)
        for k in range(b - a):
            found = []
            if hi[k] > lo[k]:
                own = hot[lo[k] : hi[k]]
                base = int(w.doc_start[k])
                found = [(int(w.start[x]) - base, int(w.end[y]) - base, v) for x, y, v in maximal_segments(own.tolist(), s[own].tolist(), drift)]
            yield int(w.last[k] - w.first[k]), found


def _statistic(n: int, found: list[tuple[int, int, float]], m: Model) -> tuple[float, int, float]:
    """Sum of the significant segments' normalised scores, their number, and the document's p-value."""
    size = math.log(max(m.k * n, 1e-12)) if n else 0.0
    bits = [m.lam * v - size for _, _, v in found]
    top = max(bits, default=None)
    good = [b for b in bits if b >= -math.log(SIGNIFICANT)]
    return sum(good), len(good), 1.0 if top is None else -math.expm1(-math.exp(min(50.0, -top)))


def fit(docs: DataFrame, labelled: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on a bounded sample of labelled rows."""
    sample = stage(training_sample(docs, labelled, label_col, per_class, id_col, text_col), "toxic-sample")

    def copies(batches):
        for batch, texts in _vector.pieces(batches, lambda x: x.column(2)):
            low = [int(s[0]) if len(s) else 0 for s in _vector.shingle_sets(texts, 5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(low, np.uint64).view(np.int64))], ["doc_id", "label", "copy"])

    # one document for each smallest shingle: near copies share theirs
    chosen = sample.mapInArrow(copies, "doc_id long, label int, copy long").groupBy("copy", "label").agg(F.min("doc_id").alias("chosen"))
    train = stage(sample.join(F.broadcast(chosen.select("chosen")), F.col("doc_id") == F.col("chosen"), "left_semi"), "toxic-train")
    sizes = {int(r[0]): int(r[1]) for r in train.groupBy("label").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    drift = -math.log(1 - DENSITY)
    model = Model(np.zeros(0, np.uint64), np.zeros(0), drift, 1.0, 1.0, 0.0, -60.0 if not toxic else math.log((toxic + 0.5) / (clean + 0.5)))
    if not toxic or not clean:
        return model

    def counts(batches):
        for batch, texts in _vector.pieces(batches, lambda x: x.column(2), _vector.BATCH_CHARS):
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in _vector.batches(texts):
                w = _vector.Words(texts[a:b])
                doc = w.doc_of_word()
                keys, docs_ = [], []
                for h in _features(w):
                    on = h != 0
                    keys.append(h[on])
                    docs_.append(doc[on])
                h, d = np.concatenate(keys), np.concatenate(docs_)
                order = np.lexsort((d, h))
                h, d = h[order], d[order]
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                h, t = h[once], label[a:b][d[once]]
                u, first = np.unique(h, return_index=True)
                if len(u):
                    t = np.add.reduceat(t.astype(np.int64), first)
                    n = np.diff(np.append(first, len(h)))
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(t), pa.array(n - t)], ["token", "t", "c"])

    table = stage(train.mapInArrow(counts, "token long, t long, c long").groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("t >= 3"), "toxic-counts")
    tried = max(2, table.count())
    alpha = F.lit(PRIOR) * (F.col("t") + F.col("c")) / float(clean + toxic) + 0.05
    odds = lambda y, n: F.log((F.col(y) + alpha) / (n + PRIOR - F.col(y) - alpha + 1.0))
    both = (F.col("t") + F.col("c")) / float(clean + toxic)
    part = lambda y, n: F.when(F.col(y) > 0, F.col(y) * F.log(F.col(y) / (both * n))).otherwise(0.0)
    ranked = table.withColumn("score", F.least(F.lit(LIMIT), odds("t", float(toxic)) - odds("c", float(clean)))).withColumn("g", 2 * (part("t", float(toxic)) + part("c", float(clean))))
    top = ranked.where((F.col("score") > 1.0) & (F.col("g") >= 2 * math.log(tried))).select("token", "score").collect()  # significant tokens of the bounded sample
    pairs = sorted((int(r[0]) & (2**64 - 1), float(r[1])) for r in top)
    model.keys, model.scores = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs])
    if not pairs:
        return model
    # extreme-value parameters from the clean documents, then the logistic curve
    keys, scores = model.keys, model.scores

    def clean_segments(batches):
        for _, texts in _vector.pieces(batches, lambda x: x.column(0)):
            found = list(_scan(texts, keys, scores, drift))
            steps = [round(v * SCORE_STEPS) for _, own in found for _, _, v in own]
            yield pa.RecordBatch.from_arrays([pa.array([-1, *steps], pa.int64()), pa.array([sum(n for n, _ in found), *([1] * len(steps))], pa.int64())], ["step", "n"])

    # a row for each step of the score that clean segments reach; -1 counts words
    held = train.where("label = 0").select("text").mapInArrow(clean_segments, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
    null_words = sum(int(r[1]) for r in held if r[0] == -1) + 1
    level = np.array([r[0] / SCORE_STEPS for r in held if r[0] >= 0] + [float(np.median(scores))])
    times = np.array([float(r[1]) for r in held if r[0] >= 0] + [1.0])
    share = float(times.sum()) / null_words
    low, high = 1e-6, 60.0
    for _ in range(100):  # lambda: the positive root of E[exp(lambda s)] = 1 over clean text
        mid = (low + high) / 2
        mean = share * float(np.average(np.exp(np.minimum(700.0, mid * level)), weights=times)) + (1 - share) * math.exp(-mid * drift)
        low, high = (mid, high) if mean < 1 else (low, mid)
    model.lam = low
    floor = float(scores.min())
    model.k = max(1e-9, float(times.sum()) / (null_words * math.exp(-low * floor)))

    def totals(batches):
        for batch, texts in _vector.pieces(batches, lambda x: x.column(1)):
            own = [_statistic(n, found, model)[0] for n, found in _scan(texts, keys, scores, drift)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.float64())], ["label", "total"])

    rows = train.select("label", "text").mapInArrow(totals, "label int, total double").collect()  # at most 2 * per_class pairs of numbers
    y, x = np.array([float(r[0]) for r in rows]), np.log1p(np.array([r[1] for r in rows]))
    a, b = 1.0, -1.0
    for _ in range(50):  # Newton steps of a logistic regression in one variable, with a small ridge
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([np.sum((p - y) * x) + 1e-2 * a, np.sum(p - y)])
        v = p * (1 - p) + 1e-9
        h = np.array([[np.sum(v * x * x) + 1e-2, np.sum(v * x)], [np.sum(v * x), np.sum(v)]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    model.slope, model.offset = a, b
    return model


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score, predicted, n_words, segments, p_value, passages (start, end, score of every significant segment)."""
    schema = "doc_id long, score double, predicted int, n_words long, n_segments int, p_value double, passages array<struct<start:int,end:int,score:double>>"

    def run(batches):
        for batch, texts in _vector.pieces(batches, lambda x: x.column(1)):
            out = []
            for n, found in _scan(texts, model.keys, model.scores, model.drift):
                total, count, p = _statistic(n, found, model)
                z = max(-60.0, min(60.0, model.slope * math.log1p(total) + model.offset))
                s = 0.0 if model.offset <= -60 else 1 / (1 + math.exp(-z))
                size = math.log(max(model.k * n, 1e-12)) if n else 0.0
                spans = [{"start": a, "end": b, "score": v} for a, b, v in found if model.lam * v - size >= -math.log(SIGNIFICANT)]
                out.append((s, int(s >= 0.5), n, count, p, spans))
            kinds = (pa.float64(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))
            cols = [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "score", "predicted", "n_words", "n_segments", "p_value", "passages"])

    return docs.select(_rows.named(id_col).cast("long").alias("doc_id"), _rows.named(text_col).alias("text")).mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is not predicted toxic, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch, texts in _vector.pieces(batches, lambda x: x.column(0).field(at)):
            keep = []
            for n, found in _scan(texts, model.keys, model.scores, model.drift):
                keep.append(model.offset <= -60 or model.slope * math.log1p(_statistic(n, found, model)[0]) + model.offset < 0)
            yield batch.filter(pa.array(keep, pa.bool_()))

    rows = _rows.held(docs)
    return _rows.released(rows.mapInArrow(run, rows.schema))
