"""Mixing sources to target weights by soft membership (DataFrame operations only).

A classifier learned from a labelled table gives every document a posterior over
domains: naive Bayes over levels of a few summaries, which are the evidence of its
distinct words and runs of signs for each domain (a word that tells nothing is
judged by its stem) and its shares of capitals, signs and repeats. Nonnegative rates of documents are fitted by projected least squares so
that the expected tokens of each domain, sum(rate * tokens * posterior), match the
targets: a gradient step on the totals moves the rate of every document by its
posteriors times one multiplier a domain, and rates are projected to [0, max_rate].
The gradient and its K x K metric (the Gram matrix of documents at neither bound)
are sums over all documents, so the steps are Newton's, a few passes reach the
optimum, and a rate is always one clipped linear expression of the posteriors.

With an anchor, documents that are most likely of that domain keep rate 1 and the
others are fitted so that each domain's tokens stand to the anchor's as the targets
do. `Fit` reports the shares reached and the residual, the largest miss as a share
of all tokens wanted. Targets that no rates reach give the nearest totals and a
warning.

Scale: one pass over the texts in generated code, map-side combined per document;
model rows are looked up by a broadcast join while there are at most MODEL_ROWS. The
steps run over the written table of posteriors, a few numbers a document; the
driver holds domain totals only.

Tokens are words (runs of letters and digits), unless `tokens_col` names a column
with each row's count.

Defined cases: ids are integers or cast to them; null text counts as empty and has
the prior's posterior, but for its summaries; rows that repeat a doc_id and text
share one rate; a domain without labelled rows has a small prior; of a labelled id in
several rows the text with the smallest digest is learned; without tokens all rates
are 1; an empty table gives an empty result; `mixed` keeps all columns of its input,
whatever their names.
"""

from __future__ import annotations

import functools
import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _rows
from ._labels import sample_ids
from ._store import small, stage

PER_DOMAIN = 4_000
STEM = 5
#: A word counts if its likelihood ratio over the domains is over SIGNIFICANT (chance gives it to one of some 8,000 words)
#: and some domain holds it TELLING times as often as all do: lesser leanings mostly follow a text's length.
SIGNIFICANT, TELLING = 18.0, 3.0
#: Evidence is the sum of telling words' log ratios, in levels of so much.
EVIDENCE_STEP, EVIDENCE_LEVELS = 1.5, 6
MODEL_ROWS = 500_000
#: The pull of rates towards 1 against missed totals; Newton's steps end at MISS of all tokens.
PULL, MISS, PASSES = 1e-6, 1e-9, 200
#: Misses of the targets over this, as a share of the tokens, are told.
TOLERANCE = 1e-3


@dataclass
class Fit:
    totals: list[float]  # expected tokens by domain
    shares: list[float]
    residual: float
    passes: int


# ---- features -------------------------------------------------------------------


def _base(docs: DataFrame, id_col: str, text_col: str, tokens_col: str | None = None) -> DataFrame:
    counted = F.lit(None).cast("long") if tokens_col is None else _rows.named(tokens_col).cast("long")
    return docs.select(_rows.named(id_col).cast("long").alias("doc_id"), F.coalesce(_rows.named(text_col), F.lit("")).alias("text"), counted.alias("counted"))


def _items(base: DataFrame) -> DataFrame:
    """One row per distinct word (in its own case) or run of signs of a row, and one blank a row: doc_id, text_key, counted, words, kinds, signs (numbers of them), item."""
    words = F.split("text", r"[^\p{L}\p{N}]+")
    signs = F.split("text", r"[\p{L}\p{N}\s]+")
    blank = F.array(F.lit(""))
    cut = base.select("doc_id", F.xxhash64("text").alias("text_key"), "counted", words.alias("w"), F.array_remove(signs, "").alias("g"))
    ends = F.when(F.element_at("w", 1) == "", 1).otherwise(0) + F.when((F.size("w") > 1) & (F.element_at("w", -1) == ""), 1).otherwise(0)
    held = cut.select("doc_id", "text_key", "counted", (F.size("w") - ends).cast("long").alias("words"), F.size("g").alias("signs"), F.array_remove(F.array_distinct("w"), "").alias("d"), F.array_distinct("g").alias("g"))
    held = held.select("doc_id", "text_key", "counted", "words", "signs", F.size("d").alias("kinds"), F.concat(blank, "d", "g").alias("items"))
    return held.select("doc_id", "text_key", "counted", "words", "signs", "kinds", F.explode("items").alias("item"))


def _whole(item: Column) -> Column:
    return F.xxhash64(F.lower(item))


def _stem(item: Column) -> Column:
    return F.xxhash64(F.substring(F.lower(item), 1, STEM), F.lit(1))


def _capital(item: Column) -> Column:
    """1 for a word of two or more letters in capitals."""
    return F.when((F.length(item) > 1) & (F.upper(item) == item) & (F.lower(item) != item), 1).otherwise(0)


def _evidence(items: DataFrame, table: DataFrame, k: range) -> DataFrame:
    """One row per (doc_id, text_key): copies, n_tokens, levels (tokens of its summaries).

    Summaries, by level: capitals per kind of word, signs per word, kinds per word, and
    for each domain the evidence of its telling words; the last two by the text's length,
    so that what a text lacks counts as much as it did in texts of its length.
    """
    side = lambda name: table.select(F.col("token").alias(name), *(F.col(f"w{i}").alias(f"{name}{i}") for i in k))
    keyed = items.withColumn("capital", _capital(F.col("item"))).withColumn("own", _whole(F.col("item"))).withColumn("cut", _stem(F.col("item")))
    hits = keyed.join(side("t"), F.col("own") == F.col("t"), "left").join(side("s"), F.col("cut") == F.col("s"), "left")
    blank = F.col("item") == ""
    told = [F.sum(F.when(~blank, F.greatest(F.lit(0.0), F.coalesce(f"t{i}", f"s{i}", F.lit(0.0)))).otherwise(0.0)).alias(f"s{i}") for i in k]
    rows = hits.groupBy("doc_id", "text_key").agg(
        F.sum(F.when(blank, 1).otherwise(0)).cast("long").alias("copies"), F.max(F.coalesce("counted", "words")).alias("n_tokens"), F.max("words").alias("words"),
        F.max("kinds").alias("kinds"), F.max("signs").alias("signs"), F.sum("capital").alias("capitals"), *told,
    )
    words, size = F.col("words"), F.floor(F.log2(F.col("words") + 1)).cast("int")
    level = lambda a, b, steps: F.least(F.lit(80), F.ceil(steps * a / F.greatest(F.lit(1), b))).cast("int")
    shapes = [(level(F.col("capitals") / F.col("copies"), F.col("kinds"), 10), F.lit(-1)), (level(F.col("signs"), words, 5), F.lit(-1)), (level(F.col("kinds"), words, 20), size)]
    shapes += [(F.least(F.lit(EVIDENCE_LEVELS), F.ceil(F.col(f"s{i}") / F.col("copies") / EVIDENCE_STEP)).cast("int"), F.floor(size / 2).cast("int")) for i in k]
    return rows.select("doc_id", "text_key", "copies", "n_tokens", F.array(*(F.xxhash64(a, b, F.lit(j)) for j, (a, b) in enumerate(shapes))).alias("levels"))


# ---- classifier -------------------------------------------------------------------


@dataclass
class Model:
    words: DataFrame  # token, w0, w1, ...: log-likelihood ratio of each domain against all
    levels: DataFrame  # the same for levels of summaries
    log_prior: list[float]


def _weights(counts: DataFrame, n: list[float]) -> DataFrame:
    """counts (token, c0, c1, ...) with w0, w1, ... and g, the likelihood ratio of the token's spread over the domains' documents."""
    rows = max(1.0, sum(n))
    every = sum((F.col(f"c{k}") for k in range(len(n))), F.lit(0.0))
    spread = sum((F.when(F.col(f"c{k}") > 0, F.col(f"c{k}") * F.log(F.col(f"c{k}") * rows / (every * max(1.0, s)))).otherwise(0.0) for k, s in enumerate(n)), F.lit(0.0))
    return counts.select("token", *(F.log((F.col(f"c{k}") + 0.5 * every / rows + 0.1) / (s + 1.0) * rows / every).alias(f"w{k}") for k, s in enumerate(n)), (2 * spread).alias("g"))


def _sample(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str, domain_col: str, per_domain: int) -> DataFrame:
    """doc_id, label, text: of at most per_domain labelled ids of each domain one text; of near copies (one least shingle of five words) one."""
    ids = sample_ids(labelled.select(_rows.named(id_col).alias("doc_id"), _rows.named(domain_col).alias("domain")), "domain", domains, per_domain)
    found = _base(docs, id_col, text_col).join(F.broadcast(ids), F.col("doc_id") == F.col("s_id"))  # at most per_domain ids for each domain
    one = found.groupBy("doc_id", "label").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
    words = F.split(F.lower("text"), r"[^\p{L}\p{N}]+")
    least = F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 4)), lambda i: F.xxhash64(F.slice("w", i, 5))))
    keyed = one.withColumn("w", words).select("doc_id", "label", "text", least.alias("copy"))
    return stage(keyed.groupBy("label", "copy").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("one")).select("one.doc_id", "label", "one.text"), "domain-sample")


def fit_model(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", per_domain: int = PER_DOMAIN) -> Model:
    """Learned from a bounded sample of labelled rows; the priors from all."""
    known = labelled.where(_rows.named(id_col).isNotNull() & _rows.named(domain_col).isin(domains))
    prior = {r[0]: r[1] for r in known.groupBy(_rows.named(id_col).cast("long").alias("i")).agg(F.max(_rows.named(domain_col)).alias("domain")).groupBy("domain").count().collect()}  # a row for each domain
    total = sum(prior.values())
    sample = _sample(docs, labelled, domains, id_col, text_col, domain_col, per_domain)
    size = {r[0]: float(r[1]) for r in sample.groupBy("label").count().collect()}
    n = [size.get(d, 0.0) for d in domains]
    items = _items(sample.select("doc_id", "text", F.lit(None).cast("long").alias("counted")))
    labels = F.broadcast(sample.select(F.col("doc_id").alias("l_id"), "label"))
    counted = lambda rows: rows.join(labels, F.col("doc_id") == F.col("l_id")).groupBy("token").agg(*(F.sum(F.when(F.col("label") == d, 1.0).otherwise(0.0)).alias(f"c{k}") for k, d in enumerate(domains)))
    words = items.where("item <> ''").select("doc_id", F.explode(F.array(_whole(F.col("item")), _stem(F.col("item")))).alias("token")).distinct()
    telling = F.greatest(*(F.col(f"w{k}") for k in range(len(n)))) if len(n) > 1 else F.col("w0")
    table = stage(_weights(counted(words), n).where((F.col("g") > SIGNIFICANT) & (telling > math.log(TELLING))).drop("g"), "domain-words")
    levels = _evidence(items, small(table, MODEL_ROWS), range(len(n))).select("doc_id", F.explode("levels").alias("token"))
    return Model(table, stage(_weights(counted(levels), n).drop("g"), "domain-levels"), [math.log((prior.get(d, 0) + 0.5) / (total + 0.5 * len(n))) for d in domains])


def memberships(docs: DataFrame, model: Model, domains: list[str], id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, text_key, copies, n_tokens, posterior (array by domain)."""
    k = range(len(domains))
    rows = _evidence(_items(_base(docs, id_col, text_col, tokens_col)), small(model.words, MODEL_ROWS), k)
    levels = small(model.levels, MODEL_ROWS)
    for j in range(3 + len(domains)):
        side = levels.select(F.col("token").alias(f"u{j}"), *(F.col(f"w{i}").alias(f"u{j}_{i}") for i in k))
        rows = rows.join(side, F.element_at("levels", j + 1) == F.col(f"u{j}"), "left")
    z = [sum((F.coalesce(f"u{j}_{i}", F.lit(0.0)) for j in range(3 + len(domains))), F.lit(model.log_prior[i])).alias(f"z{i}") for i in k]
    rows = rows.select("doc_id", "text_key", "copies", "n_tokens", *z)
    top = F.greatest(*(F.col(f"z{i}") for i in k)) if len(domains) > 1 else F.col("z0")
    rows = rows.select("doc_id", "text_key", "copies", "n_tokens", *(F.exp(F.col(f"z{i}") - top).alias(f"e{i}") for i in k))
    whole = sum((F.col(f"e{i}") for i in k), F.lit(0.0))
    return rows.withColumn("whole", whole).select("doc_id", "text_key", "copies", "n_tokens", F.array(*(F.col(f"e{i}") / F.col("whole") for i in k)).alias("posterior"))


# ---- rates -------------------------------------------------------------------


def fit_rates(members: DataFrame, targets: list[float], max_rate: float | None = None, anchor: int | None = None) -> tuple[DataFrame, Fit]:
    """members (a written table) with rate, and how near the targets it comes. targets: weights by domain.

    Without an anchor the expected tokens in all stay. The multipliers minimise
    sum(tokens * (rate - 1)^2) / 2 + sum((total - target)^2 / (2 * PULL * size)), over rates in [0, max_rate].
    """
    k = len(targets)
    goal = np.array([t / sum(targets) for t in targets])
    p = [F.element_at("posterior", i + 1) for i in range(k)]
    mass = (F.col("copies") * F.col("n_tokens")).cast("double")
    start = np.array([float(v or 0.0) for v in members.agg(*(F.sum(mass * x) for x in p)).first()])
    if not start.sum():
        return members.withColumn("rate", F.lit(1.0)), Fit([0.0] * k, [0.0] * k, 0.0, 1)
    if anchor is None:
        axes, wanted, fixed = list(range(k)), goal * start.sum(), F.lit(False)
        q = p
    else:
        axes = [i for i in range(k) if i != anchor]
        q, wanted = [p[i] - float(goal[i] / goal[anchor]) * p[anchor] for i in axes], np.zeros(len(axes))
        fixed = F.array_position("posterior", F.array_max("posterior")) == anchor + 1
    m, size = len(axes), np.maximum(start[axes], 1e-9 * start.sum())

    def raw(by: np.ndarray) -> Column:
        return sum((F.lit(float(b)) * x for b, x in zip(by, q)), F.lit(1.0))

    def clipped(c: Column) -> Column:
        low = F.greatest(F.lit(0.0), c)
        return low if max_rate is None else F.least(F.lit(float(max_rate)), low)

    flat = members.select(mass.alias("mass"), *(x.alias(f"q{i}") for i, x in enumerate(q)), *(x.alias(f"p{i}") for i, x in enumerate(p)), fixed.alias("fixed"))

    def at(by: np.ndarray):
        """Objective, gradient, metric and domain totals at these multipliers."""
        x = sum((F.lit(float(b)) * F.col(f"q{i}") for i, b in enumerate(by)), F.lit(1.0))
        rows = flat.withColumn("x", x).withColumn("r", F.when(F.col("fixed"), 1.0).otherwise(clipped(F.col("x"))))
        rows = rows.withColumn("free", F.when(~F.col("fixed") & (F.col("r") == F.col("x")), F.col("mass")).otherwise(0.0))
        # the integral of the rate over x, for a fixed one x itself
        value = F.when(F.col("fixed"), F.col("x")).otherwise(F.col("r") * F.col("x") - F.col("r") * F.col("r") / 2)
        pairs = [(i, j) for i in range(m) for j in range(i + 1)]
        got = rows.agg(
            F.sum(F.col("mass") * value), *(F.sum(F.col("mass") * F.col("r") * F.col(f"q{i}")) for i in range(m)), *(F.sum(F.col("free") * F.col(f"q{i}") * F.col(f"q{j}")) for i, j in pairs),
            *(F.sum(F.col("mass") * F.col("r") * F.col(f"p{i}")) for i in range(k)),
        ).first()
        got = [float(v) for v in got]
        h = np.zeros((m, m))
        for (i, j), v in zip(pairs, got[1 + m :]):
            h[i, j] = h[j, i] = v
        return got[0] - by @ wanted + PULL / 2 * float(by @ (size * by)), np.array(got[1 : 1 + m]) - wanted + PULL * size * by, h + np.diag(PULL * size), np.array(got[1 + m + len(pairs) :])

    by = np.zeros(m)
    value, off, metric, totals = at(by)
    passes = 2
    while np.abs(off).max() > MISS * start.sum():
        step = -np.linalg.solve(metric, off)
        length, slope = 1.0, float(off @ step)
        while True:
            if passes >= PASSES:
                raise RuntimeError(f"the rates have not converged in {PASSES} passes")
            passes += 1
            new = at(by + length * step)
            if new[0] <= value + 1e-4 * length * slope + 1e-12 * abs(value):
                break
            length /= 4
        by, (value, off, metric, totals) = by + length * step, new
    asked = goal * totals.sum() if anchor is None else goal * totals[anchor] / goal[anchor]
    asked = goal * start.sum() if anchor is None else asked
    fit = Fit(totals.tolist(), (totals / max(totals.sum(), 1e-300)).tolist(), float(np.abs(totals - asked).max() / max(asked.sum(), 1e-300)), passes)
    if fit.residual > TOLERANCE:
        warnings.warn(f"no rates reach the targets: shares {[round(s, 4) for s in fit.shares]} are the nearest to {goal.round(4).tolist()}", stacklevel=2)
    return members.withColumn("rate", F.when(fixed, 1.0).otherwise(clipped(raw(by)))), fit


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", tokens_col: str | None = None, max_rate: float | None = None, anchor: str | None = None) -> tuple[DataFrame, Fit]:
    """doc_id, text_key, copies, n_tokens, posterior, rate; and the fit."""
    domains = list(targets)
    model = fit_model(docs, labelled, domains, id_col, text_col, domain_col)
    members = stage(memberships(docs, model, domains, id_col, text_col, tokens_col), "memberships")
    return fit_rates(members, [targets[d] for d in domains], max_rate, None if anchor is None else domains.index(anchor))


def draws(rate: Column, key: Column) -> Column:
    """How often a document is taken: the rate rounded up or down by a fixed hash, so that it holds on average."""
    return F.floor(rate + F.pmod(F.xxhash64(key, F.lit(10)), F.lit(1_000_000)) / 1_000_000.0).cast("long")


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, each row as often as its rate draws it (with max_rate=1: kept or not), with docs' columns."""
    fitted, _ = rates(docs, labelled, targets, id_col, text_col, **options)
    taken = fitted.select(F.col("doc_id").alias("o_id"), F.col("text_key").alias("o_key"), draws(F.col("rate"), F.struct("doc_id", "text_key")).alias("n"))
    odd = stage(taken.where("n <> 1"), "draws")
    rows = _rows.held(docs).withColumn("id", _rows.field(id_col).cast("long")).withColumn("key", F.xxhash64(F.coalesce(_rows.field(text_col), F.lit(""))))
    joined = rows.join(odd, F.col("id").eqNullSafe(F.col("o_id")) & (F.col("key") == F.col("o_key")), "left")
    times = F.coalesce("n", F.lit(1).cast("long"))
    return _rows.released(joined.where(times > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("copy")))
