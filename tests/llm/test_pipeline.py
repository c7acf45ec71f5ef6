import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def words(rnd, n):
    return [rnd.choice("ka lo mi nu re sa te vo wi xa".split()) + rnd.choice("bab dod fif gug hah".split()) + rnd.choice(["", "er", "ing"]) for _ in range(n)]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder with documents and labels: toxic, poor, exact and near copies, nulls, empties, repeats."""
    rnd = random.Random(21)
    rows, labels = [], []
    for i in range(500):
        own = words(rnd, rnd.randint(30, 120))
        toxic, poor = i % 9 == 0, i % 9 in (1, 2)
        if toxic:
            for _ in range(4):
                own.insert(rnd.randrange(len(own)), rnd.choice(["zorgle", "brakk", "fnord"]))
        text = " ".join(w.upper() + "%%%" for w in own) if poor else " ".join(own)
        rows.append((i, text, "en"))
        labels.append((i, int(not poor), int(toxic)))
    base = {i: t for i, t, _ in rows}
    clean = [i for i in range(3, 500) if i % 9 > 2]
    exact = [(1000 + k, base[i].capitalize(), "en") for k, i in enumerate(clean[:20])]
    near = [(2000 + k, " ".join([*base[i].split()[:-1], "changed"]), "en") for k, i in enumerate(clean[20:40]) if len(base[i].split()) > 60]
    odd = [(3000, None, None), (3001, "", "en"), (None, base[clean[50]] + " more", "en"), (3002, "twice the same row", "en"), (3002, "twice the same row", "en")]
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows + exact + near + odd, "doc_id long, text string, lang string").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def shingles(text):
    w = text.lower().replace("%", " ").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_decisions_against_a_plain_version(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    def ran(name, df):
        out = corpus_pipeline.stage(steps[name](spark, df, planted), "test-stage")
        assert out.columns == docs.columns
        return out

    one = ran("toxicity", docs)
    toxic = {d for d, t in rows(docs) if any(w in (t or "").lower() for w in ("zorgle", "brakk", "fnord"))}
    assert {d for d, _ in rows(docs)} - {d for d, _ in rows(one)} == toxic

    two = ran("exact dedup", one)
    best = {}
    for d, t in rows(one):
        best[(t or "").lower()] = max(best.get((t or "").lower(), -1), -1 if d is None else d)
    assert sorted(-1 if d is None else d for d, _ in rows(two)) == sorted(best.values())

    three = ran("n-gram jaccard join", two)
    own = {d: shingles(t or "") for d, t in rows(two)}
    root = {d: d for d in own}
    order = lambda d: -1 if d is None else d
    for _ in range(4):
        for a in own:
            for b in own:
                if own[a] and own[b] and len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]):
                    root[a] = root[b] = max(root[a], root[b], key=order)
    classes = defaultdict(set)
    for d in own:
        classes[root[d]].add(d)
    assert {d for d, _ in rows(three)} == set(classes)

    four = ran("mixing", three)
    poor = {d for d, t in rows(three) if "%%%" in (t or "")}
    gone = {d for d, _ in rows(three)} - {d for d, _ in rows(four)}
    assert gone and gone <= poor
    size = lambda t: len([w for w in (t or "").replace("%", " ").split()])
    kept = rows(four)
    share = sum(size(t) for d, t in kept if d in poor) / sum(size(t) for _, t in kept)
    assert share == pytest.approx(corpus_pipeline.TARGETS["poor"], abs=0.03)

    pieces = steps["packing"](spark, four, planted).collect()
    assert sorted({order(p.doc_id) for p in pieces}) == sorted(order(d) for d, _ in kept)
    by = defaultdict(int)
    for p in pieces:
        by[p.sequence_id] += p.length
    assert max(by.values()) <= 1024


def test_run_writes_every_stage(spark, planted):
    assert corpus_pipeline.run(spark, planted).where(F.col("length") > 0).count() > 100


def test_empty_documents(spark, planted, tmp_path):
    spark.read.parquet(f"{planted}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{planted}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stage(step(spark, docs, sf_dir), "test-stage")
        assert out.columns == columns, name
        after = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(after) <= before and len(after) == len(set(after))
        before, docs = set(after), out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {p.doc_id for p in pieces} == before
