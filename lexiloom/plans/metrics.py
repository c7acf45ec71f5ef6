"""The metric vector: all measures of a document in one row, and its long view."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from ..operators import compress, lexical, repetition, rhythm, structure, syntax, tokens
from ..store import stage


def registry(spark: SparkSession) -> DataFrame:
    """metric, metric_id, windowed, burrows: a small dimension table."""
    rows = [(m, i, m in config.WINDOWED_FIELDS, m in config.BURROWS_FIELDS) for m, i in config.METRIC_IDS.items()]
    return spark.createDataFrame(rows, "metric string, metric_id int, windowed boolean, burrows boolean")


#: The vector's columns, in order.
MEASURES = (
    "document_char_count", "punctuation_per_100_words", "punctuation_diversity", "gzip_compression_ratio", "word_count", "unique_word_count", "sentence_count", "paragraph_count", "flesch", "type_token_ratio", "avg_word_length",
    "avg_sentence_length", "avg_sentence_word_count", "median_sentence_length", "sentence_length_p10", "sentence_length_p90", "sentence_length_amplitude", "sentence_length_std_dev", "sentence_word_std_dev", "burstiness",
    "avg_paragraph_length", "paragraph_length_std_dev", "moving_type_token_ratio", "sentence_start_diversity", "trigram_repetition", "moving_trigram_repetition", "noun_ratio", "verb_ratio", "adjective_ratio", "adverb_ratio",
    "function_word_ratio", "noun_verb_ratio", "lexical_word_count", "unique_lemma_count", "global_lemma_richness", "lexicon_coverage", "hapax_ratio", "lemma_richness", "absolute_repetition_rate", "filtered_repetition_rate",
    "family_repetition_rate", "phonetic_repetition_rate", "stylistic_repetition_rate", "structural_repetition_rate", "structural_rhythm", "structural_diversity", "form_lemma_ratio",
)


def first_window(docs: DataFrame) -> DataFrame:
    """docs cut to their first analysis window."""
    return docs.select("doc_id", T.strip(F.substr("text", F.lit(1), T.first_window_end(F.col("text")))).alias("text"))


def metric_vector(docs: DataFrame, lexicon: DataFrame, families: DataFrame, sounds: DataFrame, parses: DataFrame | None = None, windowed: bool = True) -> DataFrame:
    """One row per document, also for empty texts (zeros); syntax measures are null without parses.

    windowed: some measures see the first analysis window only. docs held together by doc_id
    (files.together) are moved once: each part cuts the texts anew and takes all that it
    tells in one pass, and only the few sentence signatures are written.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    first = first_window(base) if windowed else base
    known = tokens.with_lexicon(tokens.tokens(base), lexicon)
    words = repetition.repetition_words(tokens.repetition_tokens(base), lexicon)
    near = repetition.repetition_words(tokens.repetition_tokens(first), lexicon)
    sigs = stage(structure.signatures(base, lexicon), "signatures")
    starts = F.filter(F.transform(T.split_sentences(F.col("text")), lambda s: F.get(T.tokenize(s), 0)), lambda w: w.isNotNull())
    n = F.regexp_count("text", F.lit(T.WORD))
    inner = base.select(
        "doc_id", F.length("text").cast("long").alias("document_char_count"), F.when(n > 0, T.punctuation_count(F.col("text")) / n * 100).otherwise(0.0).alias("punctuation_per_100_words"),
        T.punctuation_diversity(F.col("text")).alias("punctuation_diversity"), compress.gzip_ratio(F.col("text")).alias("gzip_compression_ratio"),
        F.size(T.split_sentences(F.col("text"))).cast("long").alias("sentence_count"), F.size(T.paragraphs(F.col("text"))).cast("long").alias("paragraph_count"),
    )
    parts = [
        lexical.word_measures(known, {"moving_type_token_ratio": config.TTR_WINDOW, "form_richness": config.LEXICAL_WINDOW}), rhythm.sentence_lengths(tokens.sentences(base)), rhythm.paragraph_lengths(base).drop("paragraph_count"),
        lexical.moving_ttr(tokens.items(base, starts, "word"), "word", config.START_WINDOW, "sentence_start_diversity"), lexical.trigram_measures(tokens.with_lexicon(tokens.tokens(first), lexicon), "lemma"),
        lexical.content_measures(lexical.content_words(known), "lemma_richness", config.LEXICAL_WINDOW), repetition.rate(words, repetition.lexical_flags(words, False), "absolute_repetition_rate"),
        repetition.filtered_rates(near, families, "filtered_repetition_rate", "family_repetition_rate"), repetition.rate(near, repetition.phonetic_flags(near, sounds), "phonetic_repetition_rate"), repetition.stylistic_pressure(near, families),
        structure.structural_repetition(sigs), structure.structural_rhythm(sigs), structure.structural_diversity(sigs),
    ]
    wide = functools.reduce(lambda a, b: a.join(b, "doc_id", "left"), parts, inner)
    wide = wide.withColumn("form_lemma_ratio", F.when(F.col("lemma_richness") > 0, F.col("form_richness") / F.col("lemma_richness")))
    wide = wide.withColumn("flesch", rhythm.flesch_score(F.col("word_count"), F.col("sentence_count"), F.col("syllables"))).fillna(0).select("doc_id", *MEASURES)
    if parses is not None:
        return wide.join(syntax.document_measures(syntax.sentence_measures(parses)), "doc_id", "left")
    return wide


def complete(wide: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """wide, or an error if a required measure is missing or not finite."""
    bad = functools.reduce(lambda a, b: a | b, (F.col(m).isNull() | F.isnan(F.col(m).cast("double")) for m in required))
    return wide.withColumn("doc_id", F.when(bad, F.raise_error(F.concat(F.lit("incomplete measures of document "), F.col("doc_id").cast("string"))).cast("long")).otherwise(F.col("doc_id")))


def comparable(docs: DataFrame, measure, window_words: int | None = None, whole: DataFrame | None = None) -> DataFrame:
    """Measures averaged over paragraph windows of equal size (the shortest document's words unless given).

    measure: docs -> one row per doc_id with numeric columns. whole: doc_id and measures of whole texts
    (counts, gzip ratio, voice, comparisons), which stand in place of the averages of their names.
    """
    size = window_words or int(docs.agg(F.min(F.size(T.tokenize(F.col("text"))))).first()[0] or 1)
    cut = docs.select("doc_id", F.posexplode(T.paragraph_windows(F.col("text"), max(1, size))).alias("w", "text"))
    out = measure(cut.select(F.struct("doc_id", "w").alias("doc_id"), "text"))
    instead = set(whole.columns) if whole is not None else set()
    names = [c for c in out.columns if c != "doc_id" and c not in instead]
    means = out.groupBy(F.col("doc_id.doc_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("windows"), *(F.avg(c).alias(c) for c in names))
    return means if whole is None else means.join(whole, "doc_id", "left")


def with_notes(long: DataFrame, registry: DataFrame, notes: DataFrame) -> DataFrame:
    """long (entity, metric, value) with metric_id and note: a note's id is its metric's. notes: note_id, note."""
    known = registry.select("metric", "metric_id").join(notes.where("note_id is not null").groupBy(F.col("note_id").alias("metric_id")).agg(F.first("note").alias("note")), "metric_id", "left")
    return long.join(known, "metric", "left").select("entity", "metric", "metric_id", "value", "note")
