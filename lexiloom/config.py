"""Constants that the measures depend on."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
ANALYSIS_WINDOW_CHARS = 20_000
REPETITION_PROXIMITY = 300
EXACT_WEIGHT, LEMMA_WEIGHT, FAMILY_WEIGHT = 1.0, 0.25, 0.25
PHONETIC_MIN_SEQUENCE, PHONETIC_MIN_RATIO = 3, 0.6
LEXICAL_WINDOW = 300
TTR_WINDOW = 50
START_WINDOW = 20
TRIGRAM_WINDOW, TRIGRAM_STEP = 200, 50
FINAL_WINDOW_RATIO = 0.7
RELATIVE_DEPS = ("acl:relcl",)
SUBORDINATE_DEPS = ("acl", "advcl", "ccomp", "csubj", "xcomp")
FUNCTION_CATEGORIES = ("conjonction", "déterminant", "interjection", "pronom", "préposition")
FUNCTION_WORDS = ("ne", "pas", "te")
FUNCTION_LEMMAS = ("être", "avoir")
COMPARISON_MARKERS = ("à la manière", "à la façon", "à l'image", "à l'instar")
SUBORDINATORS = (
    "afin", "ainsi", "alors", "bien", "comme", "comment", "lorsque", "parce",
    "pendant", "pourquoi", "puisque", "quand", "que", "quoique", "si", "tandis",
)
SUBJECT_PRONOUNS = ("ça", "elle", "elles", "il", "ils", "je", "j", "nous", "on", "tu", "vous")
ELIDED = {
    "c": "pronom", "d": "préposition", "j": "pronom", "l": "déterminant", "m": "pronom",
    "n": "adverbe", "qu": "conjonction", "s": "pronom", "t": "pronom",
}
ABBREVIATIONS = ("M", "Mme", "Mlle", "Dr", "Pr", "etc", "env", "vol")
PUNCTUATION_FAMILIES = (r"\.", ",", ";", ":", r"\?", "!", "[—–-]", "[()]", '[«»"]', r"…|\.\.\.")
PRELIMINARY_WORDS = ("préface", "avant-propos", "prologue", "prélude", "introduction", "mentions légales", "dédicace", "exergue")
#: The thirty measures that Burrows' distance compares.
BURROWS_FIELDS = (
    "punctuation_per_100_words", "punctuation_diversity", "structural_diversity", "structural_rhythm", "sentence_start_diversity",
    "burstiness", "noun_verb_ratio", "filtered_repetition_rate", "stylistic_repetition_rate", "family_repetition_rate",
    "phonetic_repetition_rate", "absolute_repetition_rate", "function_word_ratio", "trigram_repetition", "moving_trigram_repetition",
    "noun_ratio", "verb_ratio", "adjective_ratio", "adverb_ratio", "gzip_compression_ratio",
    "relative_clause_ratio", "nominal_sentence_ratio", "active_voice_ratio", "metaphorical_comme_ratio", "average_syntactic_depth",
    "form_lemma_ratio", "hapax_ratio", "sentence_word_std_dev", "sentence_length_amplitude", "sentence_length_std_dev",
)
METRIC_IDS = {
    "punctuation_per_100_words": 1, "punctuation_diversity": 2, "structural_diversity": 3, "structural_rhythm": 4, "sentence_start_diversity": 5,
    "burstiness": 6, "noun_verb_ratio": 7, "filtered_repetition_rate": 8, "stylistic_repetition_rate": 9, "family_repetition_rate": 10,
    "phonetic_repetition_rate": 11, "absolute_repetition_rate": 12, "function_word_ratio": 13, "trigram_repetition": 14, "moving_trigram_repetition": 15,
    "noun_ratio": 16, "verb_ratio": 17, "adjective_ratio": 18, "adverb_ratio": 19, "gzip_compression_ratio": 21,
    "relative_clause_ratio": 22, "nominal_sentence_ratio": 23, "active_voice_ratio": 24, "metaphorical_comme_ratio": 25, "average_syntactic_depth": 26,
    "form_lemma_ratio": 27, "hapax_ratio": 28, "word_count": 30, "sentence_count": 31, "paragraph_count": 32,
    "avg_word_length": 33, "avg_sentence_length": 34, "avg_sentence_word_count": 35, "median_sentence_length": 36, "sentence_length_p10": 37,
    "sentence_length_p90": 38, "paragraph_length_std_dev": 39, "document_char_count": 40, "sentence_word_std_dev": 41, "unique_word_count": 42,
    "sentence_length_amplitude": 43, "sentence_length_std_dev": 44, "type_token_ratio": 45, "moving_type_token_ratio": 46, "global_lemma_richness": 47,
    "lemma_richness": 48, "lexicon_coverage": 49, "lexical_word_count": 50, "unique_lemma_count": 51, "avg_paragraph_length": 52,
    "structural_repetition_rate": 53, "relative_clause_count": 54, "subordinate_clause_count": 55, "subordinate_clause_ratio": 56,
    "nominal_sentence_count": 57, "pos_common_noun_ratio": 58, "pos_proper_noun_ratio": 59, "pos_verb_ratio": 60, "pos_adjective_ratio": 61,
    "pos_adverb_ratio": 62, "flesch": 63,
}
# ----------------------------------------------------------------------------

WINDOWED_FIELDS = (
    "filtered_repetition_rate", "stylistic_repetition_rate", "family_repetition_rate", "phonetic_repetition_rate",
    "trigram_repetition", "moving_trigram_repetition", "sentence_word_std_dev",
)
