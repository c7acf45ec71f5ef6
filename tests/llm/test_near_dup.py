import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lexiloom.llm import _components, _vector, near_dup, toxicity


def corpus(spark, n=150, seed=5):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and rnd.random() < 0.6:
            t = list(rnd.choice(texts))
            for _ in range(rnd.choice([0, 1, 2, 3, 8])):
                if t:
                    t[rnd.randrange(len(t))] = rnd.choice(words)
            texts.append(t)
        else:
            texts.append([rnd.choice(words) for _ in range(rnd.choice([3, 5, 60, 120, 200]))])
    return spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("rows,cap", [(256, 400_000), (3, 400_000)])
def test_links_and_classes_against_brute_force(spark, monkeypatch, rows, cap):
    monkeypatch.setattr(near_dup, "CHUNK_ROWS", rows)  # 3: groups are dealt into chunks
    docs = corpus(spark)
    text = {r.doc_id: shingles(r.text) for r in docs.collect()}
    links = {a: {b for b in text if b != a and text[a] and len(text[a] & text[b]) >= 0.8 * len(text[a] | text[b])} for a in text}
    label = {a: a for a in text}
    for _ in text:
        label = {a: min([label[a], *(label[b] for b in links[a])]) for a in text}
    got = near_dup.near_classes(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        assert r.n_links == len(links[r.doc_id]), r
        assert r.class_id == label[r.doc_id]


def test_core_of_a_large_group_against_brute_force(spark, monkeypatch):
    """Copies of one template with few changes, a looser rim, and a second template near the first."""
    monkeypatch.setattr(near_dup, "CHUNK_ROWS", 4)
    rnd = random.Random(31)
    base = [f"w{rnd.randrange(900)}" for _ in range(150)]
    texts = []
    for k in range(90):
        t = list(base)
        for _ in range(rnd.choice([0, 1, 1, 1, 2, 3, 5, 8])):
            t[rnd.randrange(len(t))] = f"x{rnd.randrange(10_000)}"
        if k % 7 == 0:
            t[:4] = ["other", "start", "of", "it"]
        texts.append(" ".join(t))
    texts += texts[:5] + ["unrelated words that stand alone here"] * 2
    sets = [shingles(t) for t in texts]
    links = [{j for j in range(len(sets)) if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in range(len(sets))]
    got = {r.doc_id: r for r in near_dup.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].n_links for i in range(len(texts))] == [len(x) for x in links]
    label = list(range(len(texts)))
    for _ in texts:
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(texts))]
    assert [got[i].class_id for i in range(len(texts))] == label


def test_pair_check_equals_sets():
    rnd = np.random.default_rng(0)
    sets = [np.unique(rnd.integers(0, 60, rnd.integers(1, 40))).astype(np.uint64) for _ in range(40)]
    got = near_dup.linked(sets[:15], sets[15:], 0.4)
    for i in range(15):
        for j in range(25):
            a, b = set(sets[i].tolist()), set(sets[15 + j].tolist())
            assert got[i, j] == (len(a & b) >= 0.4 * len(a | b))


def test_odd_rows(odd_docs, no_docs):
    got = near_dup.near_classes(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[5].class_id == by[6].class_id == by[7].class_id == 5 and by[5].n_links == 2
    assert by[3].n_links == by[4].n_links == 0
    kept = near_dup.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 7 in ids and 5 not in ids and 6 not in ids and {3, 4, None} <= set(ids)
    assert near_dup.near_classes(no_docs).count() == 0


def test_repeated_ids(spark):
    """Repeated rows are copies; an id with two texts stands for both."""
    words = [f"w{i}" for i in range(60)]
    near, other = " ".join(words[:-1] + ["x"]), " ".join(reversed(words))
    docs = spark.createDataFrame([(1, " ".join(words)), (1, " ".join(words)), (2, near), (2, near), (2, other), (3, other + " y")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_links, r.n_set_links) for r in near_dup.near_classes(docs).collect())
    assert got == [(1, 3, 1), (1, 3, 1), (2, 1, 1), (2, 3, 1), (2, 3, 1), (3, 1, 1)]


def test_null_and_repeated_ids_leave_one_row_of_a_class(spark):
    words = [f"w{i}" for i in range(60)]
    text, near = " ".join(words), " ".join(words[:-1] + ["x"])
    twin, twin2, clean = " ".join(reversed(words)), " ".join(reversed(["z"] + words[1:])), " ".join(words[::2])
    many = [(None, f"alone {i} " + " ".join(words[i : i + 9])) for i in range(0, 40, 10)]
    rows = [(1, text), (None, near), (None, clean), (None, twin), (None, twin2), (7, "a b c d e f"), (7, "A b c, d e f"), (7, "g h i j k l"), (8, "m n o p q"), (8, "m n o p q"), (None, ""), (None, None), *many]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, row long")
    kept = sorted((r.row, r.doc_id) for r in near_dup.one_of_each(docs).collect())
    by = {k for k, _ in kept}
    assert len(by) == len(kept)
    assert 0 in by and 1 not in by  # an id goes before a null
    assert {2, 7, 10, 11, 12, 13, 14, 15} <= by  # unique texts, and those without words
    assert [len(by & pair) for pair in ({3, 4}, {5, 6}, {8, 9})] == [1, 1, 1]


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = _components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in got} == label


def test_long_chain_is_one_component(spark):
    n = 3000
    edges = [((i * 7919) % n, ((i + 1) * 7919) % n) for i in range(n - 1)]
    got = _components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(got) == n and {r.root for r in got} == {0}


def test_one_id_with_several_texts(spark):
    w, u = " ".join(f"w{i}" for i in range(40)), " ".join(f"u{i}" for i in range(40))
    keep = lambda rows: sorted(near_dup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert keep([(7, w), (9, w), (7, u)]) == [(7, u), (9, w)]
    assert keep([(7, w), (7, w)]) == [(7, w)]


def test_clashing_names_pass_unchanged(clashing_docs):
    rows = {r.doc_id: r for r in clashing_docs.collect()}
    for docs in (clashing_docs, clashing_docs.unionAll(clashing_docs.where("doc_id = 4"))):
        out = near_dup.one_of_each(docs)
        assert out.columns == docs.columns
        got = out.collect()
        assert sorted(r.doc_id for r in got) == [2, 3, 5, 6, 7] and all(r == rows[r.doc_id] for r in got)


def test_banding_reaches_recall_or_fails():
    for threshold, recall, most in ((0.8, 0.9995, 280), (0.5, 0.99, 280), (0.9, 0.999, 64)):
        bands, rows = near_dup.banding(threshold, recall, most)
        assert bands * rows <= most and 1 - (1 - threshold**rows) ** bands >= recall
    with pytest.raises(ValueError):
        near_dup.banding(0.02, 0.9995, 280)


def test_recall_on_a_whole_table(spark):
    """Every pair of the table's texts at the threshold has a link, held against an inverted index."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    sets = {r.doc_id: s for r, s in zip(rows, _vector.shingle_sets([r.text or "" for r in rows], 5))}
    inverted = {}
    for d, own in sets.items():
        for x in own.tolist():
            inverted.setdefault(x, []).append(d)
    common = {}
    for own in inverted.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                common[a, b] = common.get((a, b), 0) + 1
    links = dict.fromkeys(sets, 0)
    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
    assert {r.doc_id: r.n_links for r in near_dup.near_classes(docs).collect()} == links and sum(links.values()) > 20


def test_words_and_shingles():
    a, b, c = _vector.shingle_sets(["One two, three FOUR five six", "one TWO three four five SIX!", "日本語 x"], 5)
    assert len(a) == 2 and (a == b).all() and len(c) == 1


class Worker:
    """Stands for a table: gives back the function that an operator runs over its Arrow batches."""

    columns = ["doc_id", "text"]

    def __getattr__(self, name):
        return lambda *a: a[0] if name == "mapInArrow" else self

    @property
    def schema(self):
        return None


@pytest.mark.parametrize("operator", ["signatures", "without_toxic"])
def test_memory_of_a_large_batch(spark, monkeypatch, operator):
    """A worker holds a slice of an Arrow batch at a time; every row comes out, in order, as if it were alone."""
    rnd = random.Random(2)
    texts = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(500)) + " bad" * 10 * (i % 3 == 1) for i in range(2000)] + [None, "", "日本語 \U0001f600"]
    if operator == "signatures":
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, "t1": [0] * len(texts), "t2": [0] * len(texts)})
        run = near_dup.signatures(Worker(), 2, 3)
    else:
        rows = pa.StructArray.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
        batch = pa.RecordBatch.from_arrays([rows], ["row"])
        monkeypatch.setattr(toxicity._rows, "held", lambda docs: docs)
        monkeypatch.setattr(toxicity._rows, "released", lambda run: run)
        run = toxicity.without_toxic(Worker(), toxicity.Model(_vector.Words(["bad"]).hash, np.full(1, 2.0), 0.02, 1.0, 0.01, 1.0, -1.0))
    alone = [r for k in (0, 1, 999, 1999, 2000, 2001, 2002) for b in run([batch.slice(k, 1)]) for r in b.to_pylist()]
    tracemalloc.start()
    try:
        got = []
        for out in run([batch]):
            got.append(out.slice(0))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    got = [r for out in got for r in out.to_pylist()]
    assert len(alone) > 1 and [r for r in got if r in alone] == alone
    if operator == "signatures":
        assert [r["doc_id"] for r in got] == list(range(len(texts)))
    else:
        assert [r["row"]["doc_id"] for r in got] == [i for i in range(len(texts)) if i >= 2000 or i % 3 != 1]
    assert peak < 40e6
