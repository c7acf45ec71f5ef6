import itertools
import math
import random
import time
import warnings
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import _labels, _vector, mixing, quality, toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words = [rnd.choice("ab cd efg hij klm nop qrs tuv wxy zab".split()) + rnd.choice(["", "er", "ing", "o", "ui"]) for _ in range(rnd.randint(8, 120))]
        toxic, poor = i % 7 == 0, i % 5 == 1
        if toxic:
            for _ in range(rnd.randint(2, 5)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["zorgle", "zorglingen", "brakk"]))
        if poor:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "x"))
        labels.append((i, 0 if poor else 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_passages(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels.where("doc_id < 400"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.scores(docs, model).collect()
    held = [r for r in got if r.doc_id >= 400]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        for p in r.passages:
            assert any(w in text[r.doc_id][p.start : p.end].lower() for w in ("zorgl", "brakk"))
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_segments_against_brute_force():
    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randint(1, 25)
        hot = {i: rnd.choice([1.0, 2.5, 4.0]) for i in range(n) if rnd.random() < 0.3}
        s = [hot.get(i, -0.7) for i in range(n)]
        got = toxicity.maximal_segments(sorted(hot), [hot[i] for i in sorted(hot)], 0.7)

        def best(lo, hi):  # the definition: the best segment, then the same left and right of it
            if lo >= hi:
                return []
            cand = [(sum(s[a : b + 1]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a, hi)]
            top = max(cand)
            return best(lo, top[3]) + [(top[3], top[4], top[0])] + best(top[4] + 1, hi) if top[0] > 0 else []

        assert sum(v for _, _, v in got) == pytest.approx(sum(v for _, _, v in best(0, n)))
        assert max((v for _, _, v in got), default=0) == pytest.approx(max((v for _, _, v in best(0, n)), default=0))


def test_quality_held_out(labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels.where("doc_id < 400"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in quality.scores(docs, model).collect() if r.doc_id >= 400]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    for docs in (odd_docs, no_docs):
        n = docs.count()
        q = quality.scores(docs, quality.fit(docs, labels)).collect()
        t = toxicity.scores(docs, toxicity.fit(docs, labels)).collect()
        assert len(q) == len(t) == n
        assert all(0 <= r.score <= 1 for r in q + t)
    none = labels.where("doc_id = 99")
    assert all(r.score == 0.0 for r in toxicity.scores(odd_docs, toxicity.fit(odd_docs, none)).collect())
    assert quality.scores(odd_docs, quality.fit(odd_docs, none)).count() == odd_docs.count()


def test_segments_take_linear_time():
    def seconds(n):
        at = list(range(0, 20 * n, 20))
        start = time.perf_counter()
        got = toxicity.maximal_segments(at, [2.5] * n, 0.2)
        assert len(got) == n
        return time.perf_counter() - start

    seconds(1000)
    small, large = min(seconds(12_500) for _ in range(3)), min(seconds(100_000) for _ in range(3))
    assert large < 16 * small + 0.05


@pytest.mark.parametrize("seed", range(3))
def test_long_segments_against_brute_force(seed):
    """Each segment is the best of its own span, none can be widened to a better one, and they do not overlap."""
    rnd = random.Random(seed)
    hot = {i: rnd.choice([0.5, 1.0, 3.0]) for i in range(400) if rnd.random() < rnd.choice([0.1, 0.5])}
    s = [hot.get(i, -0.4) for i in range(400)]
    got = sorted(toxicity.maximal_segments(sorted(hot), [hot[i] for i in sorted(hot)], 0.4))

    def split(lo, hi):
        if lo >= hi:
            return []
        sums = [0.0, *itertools.accumulate(s[lo:hi])]
        top, a, b = max(((sums[j] - sums[i], i, j) for i in range(len(sums)) for j in range(i + 1, len(sums))), key=lambda x: (round(x[0], 9), x[1] - x[2]))
        return [*split(lo, lo + a), (lo + a, lo + b - 1), *split(lo + b, hi)] if top > 0 else []

    assert sum(v for _, _, v in got) == pytest.approx(sum(sum(s[a : b + 1]) for a, b in split(0, 400)))
    assert all(b < c for (_, b, _), (c, _, _) in zip(got, got[1:]))


def test_scores_against_a_plain_version(labelled):
    docs, labels = labelled
    m = toxicity.fit(docs, labels.where("doc_id < 400"))
    keys = dict(zip(m.keys.tolist(), m.scores.tolist()))
    for r in toxicity.scores(docs, m).join(docs.select("doc_id", "text"), "doc_id").collect():
        w = _vector.Words([r.text])
        own = [max([0.0, *(keys.get(int(f[i]), 0.0) for f in toxicity._features(w))]) for i in range(len(w.hash))]
        s = [v if v > 0 else -m.drift for v in own]
        found = toxicity.maximal_segments([i for i, v in enumerate(own) if v > 0], [v for v in own if v > 0], m.drift)
        assert all(v == pytest.approx(sum(s[a : b + 1])) for a, b, v in found)
        bits = [m.lam * v - math.log(m.k * len(s)) for _, _, v in found]
        total = sum(b for b in bits if b >= -math.log(toxicity.SIGNIFICANT))
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-60, min(60, m.slope * math.log1p(total) + m.offset)))))
        assert r.n_segments == len(r.passages) == sum(b >= -math.log(toxicity.SIGNIFICANT) for b in bits)


def test_ftrl_against_a_plain_version():
    rnd = random.Random(8)
    rows = [(rnd.random() < 0.3, {rnd.randrange(40): rnd.random() for _ in range(rnd.randint(1, 6))}) for _ in range(200)]
    good = sum(y for y, _ in rows)
    state = quality.Ftrl(len(rows) - good, good)
    z, n = Counter(), Counter()
    bias = 1 << quality.BITS

    def weight(i):
        return 0.0 if abs(z[i]) <= quality.L1 else (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for y, own in rows:
        ids = sorted(own)
        state.update(int(y), np.array(ids), np.array([own[i] for i in ids]))
        x = {**own, bias: 1.0}
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
        cost = 0.5 * len(rows) / (good if y else len(rows) - good)
        for i, v, w in [(i, v, weight(i)) for i, v in x.items()]:
            g = (p - y) * cost * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w
            n[i] += g * g
    assert all(float(state.leader(i)) == pytest.approx(weight(i), abs=1e-9) for i in [*range(40), bias])


def test_quality_scores_are_sparse_dot_products(labelled):
    docs, labels = labelled
    m = quality.fit(docs, labels.where("doc_id < 200"))
    for r in quality.scores(docs, m).join(docs.select("doc_id", "text"), "doc_id").limit(40).collect():
        ((ids, vals),) = quality._examples([r.text])
        assert r.score == pytest.approx(1 / (1 + math.exp(-(float(m.weights[ids] @ vals) + m.bias))), abs=1e-5)


def test_one_text_of_an_id_is_learned(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, None), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (4, 1), (3, None)], "doc_id long, q int")
    got = sorted((r.doc_id, r.label, r.text) for r in _labels.training_sample(docs, labels, "q", 10).collect())
    assert len(got) == 2 and got[0][:2] == (1, 1) and got[1] == (2, 0, "")


def test_mixing_meets_targets(labelled):
    docs, labels = labelled
    domain = F.when(F.col("quality") == 1, "good").otherwise("poor")
    lab = labels.select("doc_id", domain.alias("domain"))
    fitted, fit = mixing.rates(docs, lab, {"good": 0.5, "poor": 0.5})
    rows = fitted.collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 for r in rows)
    tokens = [sum(r.copies * r.n_tokens * r.rate * r.posterior[k] for r in rows) for k in (0, 1)]
    assert tokens[0] / sum(tokens) == pytest.approx(0.5, abs=1e-4) and fit.residual < 1e-4
    assert sum(tokens) == pytest.approx(sum(r.copies * r.n_tokens for r in rows), rel=1e-4)
    kept = mixing.mixed(docs, lab, {"good": 0.98, "poor": 0.02}, max_rate=1.0, anchor="good")
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(ids) == len(set(ids)) and good <= set(ids) and len(ids) < docs.count()


def _members(spark, n=400, seed=3, floor=0.0):
    rnd = np.random.default_rng(seed)
    p = rnd.dirichlet([0.5, 0.3, 0.2], n) * (1 - 3 * floor) + floor
    rows = [(i, 0, int(rnd.integers(1, 3)), int(rnd.integers(0, 200)), x.tolist()) for i, x in enumerate(p)]
    return spark.createDataFrame(rows, "doc_id long, text_key long, copies long, n_tokens long, posterior array<double>"), rows, p


@pytest.mark.parametrize("targets,max_rate", [([0.9, 0.08, 0.02], None), ([0.2, 0.3, 0.5], None), ([0.4, 0.35, 0.25], 1.4)])
def test_rates_equal_a_dense_solution(spark, targets, max_rate):
    """Three domains: the rates of a plain projected-gradient descent on the same objective."""
    members, rows, p = _members(spark)
    mass = np.array([c * n for _, _, c, n, _ in rows], float)
    wanted = np.array(targets) * mass.sum()
    fitted, fit = mixing.fit_rates(members, targets, max_rate)
    got = np.array([r.rate for r in fitted.orderBy("doc_id").collect()])
    assert fit.residual < 1e-4 and np.abs((mass * got) @ p - wanted).max() < 1e-4 * mass.sum()
    # the optimum of sum(mass (r - 1)^2) under the totals: no feasible direction lowers it
    x, high, scale = np.ones(len(mass)), np.inf if max_rate is None else max_rate, (mass @ p)
    by = np.zeros(3)
    for _ in range(60_000):
        x = np.clip(1 + p @ by, 0, high)
        by -= 0.5 * ((mass * x) @ p - wanted) / scale
    assert np.abs(x - got).max() < 2e-3


def test_anchored_documents_keep_rate_one(spark):
    members, rows, p = _members(spark)
    fitted, fit = mixing.fit_rates(members, [0.8, 0.15, 0.05], 1.0, 0)
    got = fitted.orderBy("doc_id").collect()
    assert all(r.rate == 1.0 for r in got if r.posterior[0] == max(r.posterior)) and all(0 <= r.rate <= 1 for r in got)
    tokens = np.array([r.copies * r.n_tokens * r.rate * np.array(r.posterior) for r in got]).sum(0)
    assert fit.shares == pytest.approx((tokens / tokens.sum()).tolist(), abs=1e-9)


def test_targets_out_of_reach_are_told(spark):
    members, rows, p = _members(spark, floor=0.1)  # every document is a tenth of each domain at least
    mass = np.array([c * n for _, _, c, n, _ in rows], float)
    with pytest.warns(UserWarning, match="no rates reach"):
        fitted, fit = mixing.fit_rates(members, [0.9, 0.08, 0.02])
    got = np.array([r.rate for r in fitted.orderBy("doc_id").collect()])
    assert fit.residual > 0.01 and fit.totals == pytest.approx(((mass * got) @ p).tolist(), rel=1e-6)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        mixing.fit_rates(members, [0.5, 0.3, 0.2])


def test_posteriors_against_a_plain_version(spark, labelled):
    """The levels and weights of the model, applied by hand."""
    docs, labels = labelled
    names = ["good", "poor", "toxic"]
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    lab = labels.select("doc_id", domain.alias("domain"))
    model = mixing.fit_model(docs, lab, names)
    words = {r.token: r[1:] for r in model.words.collect()}
    levels = {r.token: r[1:] for r in model.levels.collect()}
    got = {r.doc_id: r for r in mixing.memberships(docs, model, names).collect()}
    hashed = spark.createDataFrame([(w,) for w in sorted({w for r in docs.collect() for w in r.text.replace("!", " ! ").split()})], "item string")
    keys = {r.item: (r.a, r.b) for r in hashed.select("item", mixing._whole(F.col("item")).alias("a"), mixing._stem(F.col("item")).alias("b")).collect()}
    seen = []
    for r in docs.limit(60).collect():
        own = [w.strip("!") for w in r.text.split()]
        kinds, signs = sorted(set(own)), ["!!"] * r.text.count("!!")
        items = kinds + sorted(set(signs))
        evidence = [sum(max(0.0, next((words[k][i] for k in keys.get(x, ()) if k in words), 0.0)) for x in items if x != "!!") for i in range(3)]
        capitals = sum(len(w) > 1 and w.isupper() for w in kinds)
        size = int(math.log2(len(own) + 1))
        shapes = [(min(80, math.ceil(10 * capitals / len(kinds))), -1), (min(80, math.ceil(5 * len(signs) / len(own))), -1), (min(80, math.ceil(20 * len(kinds) / len(own))), size)]
        seen.append((r.doc_id, evidence, shapes, size, bool(signs)))
    flat = [(d, j, a, b) for d, _, shapes, _, _ in seen for j, (a, b) in enumerate(shapes)]
    flat += [(d, 3 + i, min(mixing.EVIDENCE_LEVELS, math.ceil(e / mixing.EVIDENCE_STEP)), size // 2) for d, ev, _, size, signs in seen if not signs for i, e in enumerate(ev)]
    tokens = spark.createDataFrame(flat, "d long, j int, a int, b int").select("d", F.xxhash64("a", "b", "j").alias("t")).collect()
    z = {d: list(model.log_prior) for d, *_ in seen}
    for d, t in tokens:
        z[d] = [x + y for x, y in zip(z[d], levels.get(t, (0.0, 0.0, 0.0)))]
    for d, _, _, _, signs in seen:
        assert got[d].n_tokens == len(docs.where(F.col("doc_id") == d).first().text.split()) or signs
        if not signs:
            top = max(z[d])
            e = [math.exp(x - top) for x in z[d]]
            assert got[d].posterior == pytest.approx([x / sum(e) for x in e], abs=1e-6)


def test_token_counts_can_be_given(labelled):
    docs, labels = labelled
    lab = labels.select("doc_id", F.when(F.col("quality") == 1, "a").otherwise("b").alias("domain"))
    given = docs.withColumn("own count", F.col("doc_id") + 5)
    rows, _ = mixing.rates(given, lab, {"a": 1.0, "b": 1.0}, tokens_col="own count")
    assert all(r.n_tokens == r.doc_id + 5 for r in rows.collect())


def test_mixing_odd_rows(spark, odd_docs, no_docs):
    lab = spark.createDataFrame([(1, "a"), (5, "b"), (None, "a"), (6, None), (7, "other")], "doc_id long, domain string")
    for docs in (odd_docs, no_docs):
        rows = mixing.rates(docs, lab, {"a": 1.0, "b": 2.0})[0].collect()
        assert sum(r.copies for r in rows) == docs.count()
        assert mixing.mixed(docs, lab, {"a": 1.0, "b": 2.0}).columns == docs.columns
    none = mixing.rates(odd_docs, lab.where("domain = 'zz'"), {"a": 1.0, "b": 2.0})[0].collect()
    assert all(r.rate >= 0 for r in none)


def test_clashing_names_pass_unchanged(spark, clashing_docs):
    rows = {r.doc_id: r for r in clashing_docs.collect()}
    lab = spark.createDataFrame([(0, "a"), (3, "b"), (4, "b")], "doc_id long, domain string")
    for out in (mixing.mixed(clashing_docs, lab, {"a": 1.0, "b": 1.0}), toxicity.without_toxic(clashing_docs, toxicity.fit(clashing_docs, lab.selectExpr("doc_id", "int(domain = 'b') as toxic")))):
        assert out.columns == clashing_docs.columns
        assert all(r == rows[r.doc_id] for r in out.collect())
