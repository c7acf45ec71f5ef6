"""What keeps queries in proportion to their input: what is shuffled, what is computed once, what is looked at."""

import re

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import corpus, repetition, syntax
from lexiloom.plans import queries as Q
from lexiloom.sources import lexicons

DATA = "/root/testdata/sf0.001"
HELD = [
    "clause_measures", "contextual_lemmas", "repetition_distribution", "syntax_document_measures", "comparison_sentences", "dependency_depth", "structural_rhythm", "moving_trigram_repetition", "structure_signatures",
    "repetition_annotations", "pos_distribution", "structural_diversity", "lemma_reports", "phonetic_repetition", "lemma_richness_distribution", "structural_repetition",
]


@pytest.mark.parametrize("name", HELD)
def test_words_stay_with_their_document(spark, name):
    """Texts are dealt out by document; nothing else is shuffled but tables that have no documents."""
    plan = Q.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    keys = {tuple(re.findall(r"(\w+)#", k)) for k in re.findall(r"Exchange hashpartitioning\((.*)\)", plan)}
    assert ("doc_id",) in keys
    assert keys <= {("doc_id",), ("lexeme",)}  # families are gathered by lexeme


def test_small_lexicons_have_a_size(spark):
    for table in (lexicons.small_lexicon(spark), lexicons.small_families(spark), lexicons.small_sounds(spark)):
        assert int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 100_000


@pytest.mark.parametrize("name", ["burrows_distance", "burrows_top5", "metrics_long", "singularity", "areas_ascending", "author_profile", "comparison_table", "nested_export", "neighborhood_percentile", "neighborhood_top", "mds_map"])
def test_entities_are_measured_once(spark, name):
    read = Q.QUERIES[name](spark, DATA).inputFiles()
    assert read and not any("documents.parquet" in f for f in read)


def test_uniformity_reads_signatures_once(spark):
    assert any("signatures-" in f for f in Q.QUERIES["uniformity"](spark, DATA).inputFiles())


def test_frames_are_counted_off(spark):
    cases = [(n, pos, w, s) for n in (1, 3, 7, 8, 20, 23) for pos in range(n) for w, s in ((5, 2), (5, 5), (8, 3))]
    df = spark.createDataFrame(cases, "n int, pos int, w int, s int")
    for w, s in ((5, 2), (5, 5), (8, 3)):
        n, pos = F.col("n"), F.col("pos")
        listed = F.filter(T.frame_starts(n, w, s), lambda x: (x <= pos) & (pos < x + w))
        rows = df.where((F.col("w") == w) & (F.col("s") == s)).select(listed.alias("a"), T.frames_between(n, w, s, pos - w + 1, pos).alias("b")).collect()
        assert rows and all(sorted(r.a) == sorted(r.b) for r in rows)


def test_radar_without_wide_measures_has_no_axes(spark, monkeypatch):
    rows = [(e, m, 10.0 + k / 100) for m in Q.CORPUS_METRICS for k, e in enumerate("abcde")]
    monkeypatch.setattr(Q, "entity_long", lambda *_: spark.createDataFrame(rows, "entity string, metric string, value double"))
    assert Q.detail_radar(spark, DATA).count() == 0


def test_podium_ties_go_by_name(spark):
    rows = [("x", f"a{k}", p, k) for k, p in enumerate((0.3, 0.2, 0.1))] + [("x", f"b{k}", p, k) for k, p in enumerate((0.1, 0.2, 0.3))]
    near = spark.createDataFrame(rows, "left string, right string, percentile double, rank int").coalesce(1)
    authors = spark.createDataFrame([(r[1], f"Anne {r[1][0]}") for r in rows], "entity string, author string")
    assert [r.surname for r in corpus.podium(near, F.broadcast(authors)).orderBy("place").collect()] == ["a", "b"]


def test_heads_of_ids_with_gaps(spark):
    df = spark.createDataFrame([([2, 5, 9, 14], [5, 9, 9, 7]), ([3, 4, 5], [4, 9, None]), ([7], [7])], "ids array<long>, heads array<long>")
    assert [r.p for r in df.select(syntax.places(F.col("ids"), F.col("heads")).alias("p")).collect()] == [[1, 2, 2, None], [1, None, None], [0]]


def test_near_pairs_are_counted_within_the_distance(spark):
    words = [(1, p, w) for p, w in enumerate(["fleur", "x", "fleur", "fleurs", "y", "fleur"])]
    rows = repetition.repetition_words(spark.createDataFrame([(d, 6, p, w) for d, p, w in words], "doc_id long, n int, pos int, word string"), lexicons.small_lexicon(spark))
    got = repetition.stylistic_pressure(rows, lexicons.small_families(spark), 2).first()[1]
    # fleur 0-2; fleurs 3 with fleur 2, fleur 5 with fleurs 3 by lemma
    assert abs(got - (1 + 2 * 0.25) / 6) < 1e-12
