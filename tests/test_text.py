"""Segmentation and cleaning on small texts with known answers."""

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T


def run(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = [r[0] for r in df.select("i", f(F.col("text")).alias("v")).orderBy("i").select("v").collect()]
    return out[0] if len(texts) == 1 else out


def test_tokens(spark):
    assert run(spark, T.tokenize, "L’été, J'ai vu: 3 chats_noirs…") == ["l'été", "j'ai", "vu", "3", "chats_noirs"]
    assert run(spark, T.repetition_tokens, "L’été a J'ai") == ["été", "ai"]


def test_sentences(spark):
    assert run(spark, T.split_sentences, "M. Dupont dort. Il rêve! A. B. Martin? oui… non. ") == ["M. Dupont dort.", "Il rêve!", "A. B. Martin?", "oui… non."]
    assert run(spark, T.structure_units, "Yannick,\nJe réponds.") == ["Yannick,", "Je réponds."]


def test_newlines_and_paragraphs(spark):
    assert run(spark, T.normalise_newlines, "un\n\n\n\n deux", "un\r\n\r\n\r\ndeux") == ["un\n\n deux", "un\n\ndeux"]
    assert [len(p) for p in run(spark, T.paragraphs, "Première ligne\nSeconde ligne", "Première\n \nSeconde")] == [1, 2]


def test_front_matter_and_body(spark):
    text = "---\ntitle: \"Un titre: suite\"\nauthor: X\n---\n\nCorps"
    assert run(spark, T.front_matter, text) == {"title": "Un titre: suite", "author": "X"}
    assert run(spark, T.markdown_body, text) == "Corps"
    assert run(spark, T.front_matter, "no block") == {}
    assert run(spark, T.clean_body, "# Préface\nx\n# Un\na\n> q\nb\n## Introduction\ny") == "a\nb"


def test_structure_tokens(spark):
    assert run(spark, T.structure_tokens, "J’ai dit: qu'il... aujourd'hui, oui.") == ["j", "ai", "dit", ":", "qu", "il", "...", "aujourd'hui", ",", "oui", "."]


def test_windows(spark):
    six = "a b c d e f"
    got = run(spark, lambda t: T.paragraph_windows(t, 10, 0.5), f"{six}\n\n{six}\n\n{six} fin")
    assert len(got) == 2 and "fin" not in got[0] and "fin" in got[1]
    assert len(run(spark, lambda t: T.paragraph_windows(t, 10, 0.7), "a b c d e f g h i j\n\nx y z")) == 1
    assert run(spark, lambda t: T.paragraph_windows(t, 10), "court texte") == ["court texte"]
    assert [len(b) for b in run(spark, lambda t: T.byte_windows(t, 10), "é" * 20)] == [10] * 4
    windows = run(spark, lambda t: T.char_windows(t, 10), "Un deux trois. Quatre cinq? Six sept huit neuf")
    assert [(w.start, w.end) for w in windows] == [(0, 14), (14, 27), (27, 46)]
    assert run(spark, lambda t: T.first_window_end(t, 10), "Un deux trois. Quatre", "court", "x" * 30) == [14, 5, 30]


def test_names(spark):
    assert run(spark, T.display_name, "lettre1.md", "_Durand.md", "mon_roman-12.md") == ["Lettre 1", "Durand", "Mon roman 12"]
    assert run(spark, T.slug, "L'Été à Œuvre!") == "l-ete-a-oeuvre"
    assert run(spark, T.ascii_fold, "Ȳžč ŁÓDŹ ǻ ß") == "yzc łodz a ß"
    assert run(spark, T.number_in, "environ 1 234,5 %", "-3.25x", "rien") == [1234.5, -3.25, None]


def test_punctuation(spark):
    n = run(spark, lambda t: F.struct(T.punctuation_count(t).alias("a"), F.size(T.tokenize(t)).alias("b")), "mot, " * 100)
    assert n.a / n.b * 100 == 100
    assert run(spark, T.punctuation_diversity, "aaa", "...", ". , ; : ? ! - ( «")[0] == 0
    assert run(spark, T.syllables, "oiseau", "brr") == [2, 1]
