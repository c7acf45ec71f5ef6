"""Counts, lengths and rhythm of sentences and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def basic_counts(docs: DataFrame) -> DataFrame:
    """One row per document, also for empty texts: counts and mean lengths, computed within the row."""
    words, sents, pars = T.tokenize(F.col("text")), T.split_sentences(F.col("text")), T.paragraphs(F.col("text"))
    held = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).select("doc_id", words.alias("w"), sents.alias("s"), pars.alias("p"))
    return held.select(
        "doc_id", F.size("w").cast("long").alias("word_count"), F.size(F.array_distinct("w")).cast("long").alias("unique_word_count"), F.size("s").cast("long").alias("sentence_count"), F.size("p").cast("long").alias("paragraph_count"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
    )


def sentence_lengths(sents: DataFrame) -> DataFrame:
    """Lengths in characters and words: mean, spread, percentiles, burstiness. sents: doc_id, n, pos, sentence."""
    rows = sents.select("doc_id", "pos", F.length("sentence").alias("len"), F.size(T.tokenize(F.col("sentence"))).alias("words"))
    step = F.abs(F.col("len") - F.lag("len").over(Window.partitionBy("doc_id").orderBy("pos")))
    p = lambda q: F.percentile("len", F.lit(q))
    return rows.withColumn("step", step).groupBy("doc_id").agg(
        F.avg("len").alias("avg_sentence_length"), F.avg("words").alias("avg_sentence_word_count"), p(0.5).alias("median_sentence_length"), p(0.1).alias("sentence_length_p10"), p(0.9).alias("sentence_length_p90"),
        (p(0.9) - p(0.1)).alias("sentence_length_amplitude"), F.stddev_pop("len").alias("sentence_length_std_dev"), F.stddev_pop("words").alias("sentence_word_std_dev"), F.coalesce(F.avg("step") / F.avg("len"), F.lit(0.0)).alias("burstiness"),
    )


def paragraph_lengths(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.explode(T.paragraphs(F.col("text"))).alias("p")).select("doc_id", F.size(T.tokenize(F.col("p"))).alias("words"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraph_count"), F.avg("words").alias("avg_paragraph_length"), F.stddev_pop("words").alias("paragraph_length_std_dev"))


def document_mode(docs: DataFrame) -> DataFrame:
    """The full-document rules: other splitters, percentiles by lower index, punctuation with brackets."""
    text = F.col("text")
    held = docs.select("doc_id", "text", T.document_words(text).alias("w"), T.document_sentences(text).alias("s"), T.document_paragraphs(text).alias("p")).withColumn("l", F.array_sort(F.transform("s", F.length)))
    at = lambda q: F.when(F.size("l") > 0, F.get("l", F.floor(q * (F.size("l") - 1)).cast("int"))).otherwise(0)
    plain = lambda s: F.regexp_count(s, F.lit(r"[\p{L}\p{N}_×÷]+")).cast("double")
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda x, y: x + f(y))
    return held.select(
        "doc_id", F.size("w").cast("long").alias("word_count"), F.size("s").cast("long").alias("sentence_count"), F.size("p").cast("long").alias("paragraph_count"), F.length("text").cast("long").alias("document_char_count"),
        at(0.5).cast("long").alias("median_sentence_length"), at(0.1).cast("long").alias("sentence_length_p10"), at(0.9).cast("long").alias("sentence_length_p90"),
        (total("w", lambda x: F.length(x).cast("double")) / F.greatest(F.size("w"), F.lit(1))).alias("avg_word_length"),
        (total("s", lambda x: F.length(x).cast("double")) / F.greatest(F.size("s"), F.lit(1))).alias("avg_sentence_length"),
        (total("s", plain) / F.greatest(F.size("s"), F.lit(1))).alias("avg_sentence_word_count"),
        (100 * T.punctuation_count(text, True) / F.greatest(F.size("w"), F.lit(1))).alias("punctuation_per_100_words"),
    )


def flesch(docs: DataFrame) -> DataFrame:
    """French Flesch score: 207 - 1.015 words per sentence - 73.6 syllables per word; 0 without words."""
    held = docs.select("doc_id", T.tokenize(F.col("text")).alias("w"), F.size(T.split_sentences(F.col("text"))).alias("s"))
    syllables = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + T.syllables(x))
    return held.select("doc_id", flesch_score(F.size("w"), F.col("s"), syllables).alias("flesch"))


def flesch_score(words: Column, sentences: Column, syllables: Column) -> Column:
    return F.when(words > 0, 207 - 1.015 * (words / F.greatest(F.lit(1), sentences)) - 73.6 * (syllables / words)).otherwise(0.0)


def uniformity(metrics: DataFrame) -> DataFrame:
    """Six signals of uniformity, each 0 to 1, and their mean in percent. Null measures count as 0."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    v = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    amplitude = F.when(v("avg_sentence_length") > 0, v("sentence_length_amplitude") / v("avg_sentence_length")).otherwise(0.0)
    parts = {
        "sentence_amplitude": 1 - clamp(amplitude / 2), "burstiness_uniformity": 1 - clamp(v("burstiness")), "vocabulary_repetition": clamp(v("filtered_repetition_rate")),
        "structure_repetition": clamp(v("structural_repetition_rate")), "structure_similarity": 1 - clamp(v("structural_diversity")), "structure_rhythm": 1 - clamp(v("structural_rhythm")),
    }
    return metrics.select("doc_id", *(c.alias(k) for k, c in parts.items()), F.round(100 * sum(parts.values(), F.lit(0.0)) / 6).alias("uniformity_score"))
