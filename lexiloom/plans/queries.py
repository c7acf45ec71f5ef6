"""The registered queries over the driver's tables, each with its SQL for the oracle where SQL expresses it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from ..operators import compress, corpus, lexical, repetition, rhythm, structure, syntax, tokens
from ..sources import files, html, lexicons
from ..store import stage
from ..streaming import incremental
from . import metrics, reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name. Measures are rounded a hair above ties, which engines break differently."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace(", 6)", " + 1e-9, 6)")
        return f

    return register


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents for measures that cut texts to rows: dealt out by document once, before they are cut."""
    return files.together(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def _r(df: DataFrame, *names: str) -> DataFrame:
    """Rounds measures, so that sums in another order give the same values."""
    return df.withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in names})


# ---- SQL fragments -----------------------------------------------------------
_W = r"[\p{L}\p{N}_]"
_WS = r"[\s\x{0B}\x{85}\p{Z}]"
_WORDS = rf"list_transform(regexp_extract_all({{0}}, '{_W}+(?:[''’]{_W}+)?'), lambda w: replace(lower(w), '’', ''''))"
_STRIP = rf"regexp_replace(regexp_replace({{0}}, '^{_WS}+', ''), '{_WS}+$', '')"


def _strip(c: str) -> str:
    return _STRIP.replace("{0}", c)


def _sql_words(c: str) -> str:
    return _WORDS.replace('{0}', c)


def _sql_sentences(c: str) -> str:
    for pattern in [rf"(?i)(^|[^\p{{L}}\p{{N}}_])({'|'.join(config.ABBREVIATIONS)})\."] * 2 + [r"(^|[^\p{L}\p{N}_])([A-ZÀ-Ý])\."] * 2:
        c = rf"regexp_replace({c}, '{pattern}', '\1\2․', 'g')"
    cut = rf"string_split(regexp_replace({c}, '([.!?])(?:{_WS}+|$)', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {_strip('replace(s, ' + chr(39) + '․' + chr(39) + ', ' + chr(39) + '.' + chr(39) + ')')}), lambda s: s <> '')"


_DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_TOK = f"{_DOCS}, a AS (SELECT doc_id, {_sql_words('text')} AS w FROM d), tok AS (SELECT doc_id, len(w) AS n, unnest(range(len(w))) AS pos, unnest(w) AS word FROM a)"
_RTOK = f"{_DOCS}, a AS (SELECT doc_id, list_filter({_sql_words(chr(114) + 'egexp_replace(text, ' + chr(39) + '[' + chr(39) * 2 + '’]' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, lambda w: length(w) >= 2) AS w FROM d), tok AS (SELECT doc_id, len(w) AS n, unnest(range(len(w))) AS pos, unnest(w) AS word FROM a)"
_SENT = f"{_DOCS}, b AS (SELECT doc_id, {_sql_sentences('text')} AS s FROM d), sent AS (SELECT doc_id, len(s) AS n, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM b)"


def _values(name: str, cols: str, rows) -> str:
    q = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"{v}::BIGINT" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"{name}({cols}) AS (VALUES {', '.join('(' + ', '.join(map(q, r)) + ')' for r in rows)})"


_LEX = _values("lex", "form, lemma, category", lexicons.FORMS)
_FAM = _values("fam", "lexeme, family", lexicons.FAMILIES)


def _list(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


_FN = f"(word IN ({_list(config.FUNCTION_WORDS)}) OR category IN ({_list(config.FUNCTION_CATEGORIES)}) OR length(word) <= 1)"
_FNL = f"({_FN} OR lemma IN ({_list(config.FUNCTION_WORDS + config.FUNCTION_LEMMAS)}))"
_KNOWN = f"{_TOK}, {_LEX}, kw AS (SELECT tok.*, coalesce(lex.lemma, word) AS lemma, lower(coalesce(lex.category, '')) AS category, lex.form IS NOT NULL AS known FROM tok LEFT JOIN lex ON word = form)"
_RKNOWN = f"{_RTOK}, {_LEX}, kw0 AS (SELECT tok.*, coalesce(lex.lemma, word) AS lemma, lower(coalesce(lex.category, '')) AS category FROM tok LEFT JOIN lex ON word = form), kw AS (SELECT *, {_FNL} AS fn FROM kw0)"


def _sql_ttr(rows: str, item: str, window: int, name: str) -> str:
    return f"""(SELECT doc_id, sum(greatest(0, least(pos, n - least(n, {window})) - greatest(before + 1, pos - least(n, {window}) + 1, 0) + 1)) / max(n - least(n, {window}) + 1) / max(least(n, {window})) AS {name}
      FROM (SELECT *, coalesce(lag(pos) OVER (PARTITION BY doc_id, {item} ORDER BY pos), -1) AS before FROM {rows}) GROUP BY doc_id)"""


# ---- counts and lengths --------------------------------------------------------
@query(f"""WITH {_DOCS}, h AS (SELECT doc_id, {_sql_words('text')} AS w, {_sql_sentences('text')} AS s, list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: {_strip('p')} <> '') AS p FROM d)
SELECT doc_id, len(w) AS word_count, len(list_distinct(w)) AS unique_word_count, len(s) AS sentence_count, len(p) AS paragraph_count, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars FROM h""")
def doc_basic_counts(spark, sf_dir):
    return rhythm.basic_counts(docs(spark, sf_dir))


@query(f"""WITH {_SENT}, r AS (SELECT doc_id, pos, length(sentence) AS len, len({_sql_words('sentence')}) AS words FROM sent),
s AS (SELECT *, abs(len - lag(len) OVER (PARTITION BY doc_id ORDER BY pos)) AS step FROM r)
SELECT doc_id, round(avg(len), 6) AS avg_sentence_length, round(avg(words), 6) AS avg_sentence_word_count, round(quantile_cont(len, 0.5), 6) AS median_sentence_length, round(quantile_cont(len, 0.1), 6) AS sentence_length_p10,
  round(quantile_cont(len, 0.9), 6) AS sentence_length_p90, round(quantile_cont(len, 0.9) - quantile_cont(len, 0.1), 6) AS sentence_length_amplitude, round(stddev_pop(len), 6) AS sentence_length_std_dev, round(stddev_pop(words), 6) AS sentence_word_std_dev,
  round(coalesce(avg(step) / avg(len), 0), 6) AS burstiness FROM s GROUP BY doc_id""")
def sentence_length_stats(spark, sf_dir):
    out = rhythm.sentence_lengths(tokens.sentences(whole(spark, sf_dir)))
    return _r(out, *out.columns[1:])


@query(rf"""WITH {_DOCS}, h AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{{L}}\p{{N}}_×÷]+(?:[''’][\p{{L}}\p{{N}}_×÷]+)?') AS w,
  list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_strip('s')}), lambda s: s <> '') AS s,
  list_filter(regexp_split_to_array(text, '\n\s*\n+'), lambda p: {_strip('p')} <> '') AS p FROM d), l AS (SELECT *, list_sort(list_transform(s, lambda x: length(x))) AS l FROM h)
SELECT doc_id, len(w) AS word_count, len(s) AS sentence_count, len(p) AS paragraph_count, length(text) AS document_char_count,
  coalesce(l[floor(0.5 * (len(l) - 1))::INT + 1], 0) AS median_sentence_length, coalesce(l[floor(0.1 * (len(l) - 1))::INT + 1], 0) AS sentence_length_p10, coalesce(l[floor(0.9 * (len(l) - 1))::INT + 1], 0) AS sentence_length_p90,
  round(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / greatest(len(w), 1), 6) AS avg_word_length, round(coalesce(list_sum(l), 0) / greatest(len(s), 1), 6) AS avg_sentence_length,
  round(coalesce(list_sum(list_transform(s, lambda x: len(regexp_extract_all(x, '[\p{{L}}\p{{N}}_×÷]+')))), 0) / greatest(len(s), 1), 6) AS avg_sentence_word_count,
  round(100 * len(regexp_extract_all(text, '[.,;:!?…—–\-()«»"\[\]]')) / greatest(len(w), 1), 6) AS punctuation_per_100_words FROM l""")
def document_mode_stats(spark, sf_dir):
    return _r(rhythm.document_mode(docs(spark, sf_dir)), "avg_word_length", "avg_sentence_length", "avg_sentence_word_count", "punctuation_per_100_words")


@query(f"""WITH {_DOCS}, p AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: {_strip('p')} <> '')) AS p FROM d), w AS (SELECT doc_id, len({_sql_words('p')}) AS n FROM p)
SELECT doc_id, count(*) AS paragraph_count, round(avg(n), 6) AS avg_paragraph_length, round(stddev_pop(n), 6) AS paragraph_length_std_dev FROM w GROUP BY doc_id""")
def paragraph_stats(spark, sf_dir):
    return _r(rhythm.paragraph_lengths(whole(spark, sf_dir)), "avg_paragraph_length", "paragraph_length_std_dev")


@query(f"""WITH {_DOCS}, c AS (SELECT doc_id, len({_sql_words('text')}) AS n, len(regexp_extract_all(text, '[.,;:!?…—–\\-()«»"]')) AS marks, [{', '.join(f"len(regexp_extract_all(text, '{p}'))" for p in config.PUNCTUATION_FAMILIES)}] AS k FROM d), t AS (SELECT *, list_sum(k) AS total FROM c)
SELECT doc_id, round(CASE WHEN n > 0 THEN marks / n * 100 ELSE 0 END, 6) AS punctuation_per_100_words,
  round(CASE WHEN total > 0 THEN coalesce(list_sum(list_transform(list_filter(k, lambda x: x > 0), lambda x: -x / total * log2(x / total))), 0) / log2(10) ELSE 0 END, 6) AS punctuation_diversity FROM t""")
def punctuation(spark, sf_dir):
    n = F.size(T.tokenize(F.col("text")))
    out = docs(spark, sf_dir).select("doc_id", F.when(n > 0, T.punctuation_count(F.col("text")) / n * 100).otherwise(0.0).alias("punctuation_per_100_words"), T.punctuation_diversity(F.col("text")).alias("punctuation_diversity"))
    return _r(out, "punctuation_per_100_words", "punctuation_diversity")


@query(f"""WITH {_DOCS}, h AS (SELECT doc_id, {_sql_words('text')} AS w, len({_sql_sentences('text')}) AS s FROM d)
SELECT doc_id, round(CASE WHEN len(w) > 0 THEN 207 - 1.015 * (len(w) / greatest(1, s)) - 73.6 * (list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiouyàâäéèêëîïôöùûüÿœ]+'))))) / len(w)) ELSE 0 END, 6) AS flesch FROM h""")
def flesch_fr(spark, sf_dir):
    return _r(rhythm.flesch(docs(spark, sf_dir)), "flesch")


# ---- richness and n-grams ------------------------------------------------------
@query(f"""WITH {_TOK}, byw AS (SELECT doc_id, word, count(*) AS c FROM tok GROUP BY ALL)
SELECT doc_id, sum(c)::BIGINT AS word_count, count(*) AS unique_word_count, round(count(*) / sum(c), 6) AS type_token_ratio, round(sum(c * length(word)) / sum(c), 6) AS avg_word_length FROM byw GROUP BY doc_id""")
def type_token(spark, sf_dir):
    return _r(lexical.type_token(tokens.tokens(whole(spark, sf_dir))), "type_token_ratio", "avg_word_length")


@query(f"WITH {_TOK} SELECT doc_id, round(moving_type_token_ratio, 6) AS moving_type_token_ratio FROM {_sql_ttr('tok', 'word', config.TTR_WINDOW, 'moving_type_token_ratio')}")
def moving_ttr_50(spark, sf_dir):
    return _r(lexical.moving_ttr(tokens.tokens(whole(spark, sf_dir)), "word", config.TTR_WINDOW, "moving_type_token_ratio"), "moving_type_token_ratio")


@query(f"""WITH {_SENT}, f AS (SELECT doc_id, pos, {_sql_words('sentence')}[1] AS word FROM sent), g AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM f WHERE word IS NOT NULL)
SELECT doc_id, round(sentence_start_diversity, 6) AS sentence_start_diversity FROM {_sql_ttr('g', 'word', config.START_WINDOW, 'sentence_start_diversity')}""")
def sentence_start_diversity(spark, sf_dir):
    starts = F.filter(F.transform(T.split_sentences(F.col("text")), lambda s: F.get(T.tokenize(s), 0)), lambda w: w.isNotNull())
    return _r(lexical.moving_ttr(tokens.items(whole(spark, sf_dir), starts, "word"), "word", config.START_WINDOW, "sentence_start_diversity"), "sentence_start_diversity")


_GRAMS = "g AS (SELECT * FROM (SELECT doc_id, n, pos, {0} AS a, lead({0}) OVER w AS b, lead({0}, 2) OVER w AS c FROM {1} WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE pos <= n - 3)"


@query(f"""WITH {_KNOWN}, {_GRAMS.format('lemma', 'kw')}, k AS (SELECT doc_id, a, b, c, count(*) AS k FROM g GROUP BY ALL)
SELECT doc_id, round(avg((k > 1)::INT), 6) AS trigram_repetition FROM k GROUP BY doc_id""")
def trigram_repetition(spark, sf_dir):
    rows = tokens.with_lexicon(tokens.tokens(whole(spark, sf_dir)), lexicons.small_lexicon(spark))
    return _r(lexical.trigram_repetition(rows, "lemma"), "trigram_repetition")


@query(f"""WITH {_KNOWN}, {_GRAMS.format('lemma', 'kw')}, f AS (SELECT *, unnest(list_distinct(list_append(range(0, greatest(0, n - 200) + 1, 50), greatest(0, n - 200)))) AS start FROM g),
k AS (SELECT doc_id, start, a, b, c, count(*) AS k FROM f WHERE start <= pos AND pos <= start + least(n, 200) - 3 GROUP BY ALL), r AS (SELECT doc_id, start, avg((k > 1)::INT) AS r FROM k GROUP BY ALL)
SELECT doc_id, round(avg(r), 6) AS moving_trigram_repetition FROM r GROUP BY doc_id""")
def moving_trigram_repetition(spark, sf_dir):
    rows = tokens.with_lexicon(tokens.tokens(whole(spark, sf_dir)), lexicons.small_lexicon(spark))
    return _r(lexical.moving_trigram_repetition(rows, "lemma"), "moving_trigram_repetition")


@query(f"""WITH {_KNOWN}, r AS (SELECT doc_id, coalesce(avg(starts_with(category, 'nom')::INT) FILTER (WHERE known), 0) AS n, coalesce(avg(starts_with(category, 'verbe')::INT) FILTER (WHERE known), 0) AS v,
  coalesce(avg(starts_with(category, 'adjectif')::INT) FILTER (WHERE known), 0) AS a, coalesce(avg(starts_with(category, 'adverbe')::INT) FILTER (WHERE known), 0) AS b, avg({_FN}::INT) AS f FROM kw GROUP BY doc_id)
SELECT doc_id, round(n, 6) AS noun_ratio, round(v, 6) AS verb_ratio, round(a, 6) AS adjective_ratio, round(b, 6) AS adverb_ratio, round(f, 6) AS function_word_ratio, round(CASE WHEN v > 0 THEN n / v ELSE 0 END, 6) AS noun_verb_ratio FROM r""")
def lexicon_pos_ratios(spark, sf_dir):
    out = lexical.pos_ratios(tokens.with_lexicon(tokens.tokens(whole(spark, sf_dir)), lexicons.small_lexicon(spark)))
    return _r(out, *out.columns[1:])


_CONTENT = f"{_KNOWN}, cw AS (SELECT doc_id, word, lemma, known, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM kw WHERE NOT {_FN})"


def _content(spark, sf_dir):
    return lexical.content_words(tokens.with_lexicon(tokens.tokens(whole(spark, sf_dir)), lexicons.small_lexicon(spark)))


@query(f"""WITH {_CONTENT}, byw AS (SELECT doc_id, lemma, count(*) AS c, sum(known::INT) AS k FROM cw GROUP BY ALL)
SELECT doc_id, sum(c)::BIGINT AS lexical_word_count, count(*) AS unique_lemma_count, round(count(*) / sum(c), 6) AS global_lemma_richness, round(sum(k) / sum(c), 6) AS lexicon_coverage, round(avg((c = 1)::INT), 6) AS hapax_ratio FROM byw GROUP BY doc_id""")
def lemma_richness(spark, sf_dir):
    return _r(lexical.lemma_richness(_content(spark, sf_dir)), "global_lemma_richness", "lexicon_coverage", "hapax_ratio")


@query(f"""WITH {_CONTENT}, m AS {_sql_ttr('cw', 'lemma', config.LEXICAL_WINDOW, 'lemma_richness')}, f AS {_sql_ttr('tok', 'word', config.LEXICAL_WINDOW, 'form_richness')}
SELECT doc_id, round(lemma_richness, 6) AS lemma_richness, round(form_richness / lemma_richness, 6) AS form_lemma_ratio FROM m JOIN f USING (doc_id)""")
def form_lemma_ratio(spark, sf_dir):
    lemmas = lexical.moving_ttr(_content(spark, sf_dir), "lemma", config.LEXICAL_WINDOW, "lemma_richness")
    forms = lexical.moving_ttr(tokens.tokens(whole(spark, sf_dir)), "word", config.LEXICAL_WINDOW, "forms")
    return _r(lemmas.join(forms, "doc_id").select("doc_id", "lemma_richness", (F.col("forms") / F.col("lemma_richness")).alias("form_lemma_ratio")), "lemma_richness", "form_lemma_ratio")


@query(f"""WITH {_CONTENT}, f AS (SELECT *, unnest(list_distinct(list_append(range(0, n - 200 + 1, 50), n - 200))) AS start FROM cw WHERE n >= 200), v AS (SELECT doc_id, start, count(DISTINCT lemma) / 200 AS v FROM f WHERE start <= pos AND pos < start + 200 GROUP BY ALL)
SELECT doc_id, count(*) AS frames, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90 FROM v GROUP BY doc_id""")
def lemma_richness_distribution(spark, sf_dir):
    return _r(lexical.richness_distribution(_content(spark, sf_dir), 200, 50), "mean", "median", "p10", "p90")


# ---- repetition ------------------------------------------------------------------
def _rwords(spark, sf_dir):
    return repetition.repetition_words(tokens.repetition_tokens(whole(spark, sf_dir)), lexicons.small_lexicon(spark))


def _sql_rate(keys: str, name: str) -> str:
    return f"""WITH {_RKNOWN}, {_FAM}, keys AS ({keys}), hit AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, pos, pos - lag(pos) OVER (PARTITION BY doc_id, key ORDER BY pos) AS gap FROM keys) WHERE gap <= 300), h AS (SELECT doc_id, count(*) AS h FROM hit GROUP BY doc_id)
SELECT doc_id, round(coalesce(any_value(h), 0) / count(*), 6) AS {name} FROM kw LEFT JOIN h USING (doc_id) GROUP BY doc_id"""


@query(_sql_rate("SELECT doc_id, pos, lemma AS key FROM kw", "absolute_repetition_rate"))
def absolute_repetition(spark, sf_dir):
    w = _rwords(spark, sf_dir)
    return _r(repetition.rate(w, repetition.lexical_flags(w, False), "absolute_repetition_rate"), "absolute_repetition_rate")


@query(_sql_rate("SELECT doc_id, pos, lemma AS key FROM kw WHERE NOT fn", "filtered_repetition_rate"))
def lexical_repetition(spark, sf_dir):
    w = _rwords(spark, sf_dir)
    return _r(repetition.rate(w, repetition.lexical_flags(w, True), "filtered_repetition_rate"), "filtered_repetition_rate")


@query(_sql_rate("SELECT doc_id, pos, 'L:' || lemma AS key FROM kw WHERE NOT fn UNION ALL SELECT DISTINCT doc_id, pos, 'F:' || family FROM kw JOIN fam ON lemma = lexeme WHERE NOT fn", "family_repetition_rate"))
def family_repetition(spark, sf_dir):
    w = _rwords(spark, sf_dir)
    return _r(repetition.rate(w, repetition.family_flags(w, lexicons.small_families(spark)), "family_repetition_rate"), "family_repetition_rate")


_REL = [(a, b) for a, p in lexicons.SOUNDS for b, q in lexicons.SOUNDS if repetition.phonetically_related(p, q)]


@query(f"""WITH {_RKNOWN}, {_values('rel', 'w1, w2', sorted(set(_REL)))}, k AS (SELECT * FROM kw WHERE NOT fn), hit AS (SELECT DISTINCT a.doc_id, a.pos FROM k a JOIN rel ON a.word = w1 JOIN k b ON b.doc_id = a.doc_id AND b.word = w2 AND b.pos < a.pos AND a.pos - b.pos <= 300),
h AS (SELECT doc_id, count(*) AS h FROM hit GROUP BY doc_id) SELECT doc_id, round(coalesce(any_value(h), 0) / count(*), 6) AS phonetic_repetition_rate FROM kw LEFT JOIN h USING (doc_id) GROUP BY doc_id""")
def phonetic_repetition(spark, sf_dir):
    w = _rwords(spark, sf_dir)
    return _r(repetition.rate(w, repetition.phonetic_flags(w, lexicons.small_sounds(spark)), "phonetic_repetition_rate"), "phonetic_repetition_rate")


@query(f"""WITH {_RKNOWN}, {_FAM}, k AS (SELECT * FROM kw WHERE NOT fn AND category <> 'nom propre'), c AS (SELECT doc_id, count(*) OVER (PARTITION BY doc_id, word ORDER BY pos RANGE BETWEEN 300 PRECEDING AND 1 PRECEDING) AS x,
  count(*) OVER (PARTITION BY doc_id, lemma ORDER BY pos RANGE BETWEEN 300 PRECEDING AND 1 PRECEDING) AS l, count(*) OVER (PARTITION BY doc_id, lemma, word ORDER BY pos RANGE BETWEEN 300 PRECEDING AND 1 PRECEDING) AS lx FROM k),
o AS (SELECT doc_id, sum(x) + 0.25 * sum(l - lx) AS own FROM c GROUP BY doc_id), kf AS (SELECT k.*, family FROM k JOIN fam ON lemma = lexeme),
p AS (SELECT DISTINCT a.doc_id, a.pos AS i, b.pos AS j FROM kf a JOIN kf b ON a.doc_id = b.doc_id AND a.family = b.family AND b.pos < a.pos AND a.pos - b.pos <= 300 AND a.word <> b.word AND a.lemma <> b.lemma), q AS (SELECT doc_id, count(*) AS kin FROM p GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS w FROM kw GROUP BY doc_id) SELECT doc_id, round(least(1.0, (coalesce(own, 0) + 0.25 * coalesce(kin, 0)) / w), 6) AS stylistic_repetition_rate FROM t LEFT JOIN o USING (doc_id) LEFT JOIN q USING (doc_id)""")
def stylistic_repetition(spark, sf_dir):
    return _r(repetition.stylistic_pressure(_rwords(spark, sf_dir), lexicons.small_families(spark)), "stylistic_repetition_rate")


@query(f"""WITH {_RKNOWN}, {_FAM}, keys AS (SELECT doc_id, pos, 'L:' || lemma AS key FROM kw WHERE NOT fn UNION ALL SELECT DISTINCT doc_id, pos, 'F:' || family FROM kw JOIN fam ON lemma = lexeme WHERE NOT fn),
hit AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, pos, pos - lag(pos) OVER w AS back, lead(pos) OVER w - pos AS ahead FROM keys WINDOW w AS (PARTITION BY doc_id, key ORDER BY pos)) WHERE back <= 300 OR ahead <= 300)
SELECT kw.doc_id, count(*) AS words, count(hit.pos) AS repeated, sha256(string_agg(word || '/' || lemma || '/' || (hit.pos IS NOT NULL)::VARCHAR, ' ' ORDER BY kw.pos)) AS annotations_sha256 FROM kw LEFT JOIN hit ON kw.doc_id = hit.doc_id AND kw.pos = hit.pos GROUP BY kw.doc_id""")
def repetition_annotations(spark, sf_dir):
    """Every word's lemma and whether it is repeated, in the order of the text: counts and one digest a document."""
    rows = repetition.annotations(_rwords(spark, sf_dir), lexicons.small_families(spark))
    item = F.struct("pos", F.concat_ws("/", "word", "lemma", F.col("repeated").cast("string")).alias("s"))
    held = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.sum(F.col("repeated").cast("long")).alias("repeated"), F.sort_array(F.collect_list(item)).alias("a"))
    return held.select("doc_id", "words", "repeated", F.sha2(F.array_join("a.s", " "), 256).alias("annotations_sha256"))


_FRAME = "PARTITION BY doc_id, start"


@query(f"""WITH {_RKNOWN}, {_FAM}, {_values('rel', 'w1, w2', sorted(set(_REL)))}, fr AS (SELECT *, unnest(list_distinct(list_append(range(0, n - 300 + 1, 300), n - 300))) AS start FROM kw WHERE n >= 300), f AS MATERIALIZED (SELECT * FROM fr WHERE start <= pos AND pos < start + 300),
fa AS (SELECT doc_id, start, avg((c > 1)::INT) AS absolute FROM (SELECT doc_id, start, row_number() OVER ({_FRAME}, lemma ORDER BY pos) AS c FROM f) GROUP BY ALL), ff AS (SELECT doc_id, start, count(*) / 300 AS filtered FROM (SELECT doc_id, start, row_number() OVER ({_FRAME}, lemma ORDER BY pos) AS c FROM f WHERE NOT fn) WHERE c > 1 GROUP BY ALL),
fk AS (SELECT doc_id, start, pos, 'L:' || lemma AS key FROM f WHERE NOT fn UNION ALL SELECT DISTINCT doc_id, start, pos, 'F:' || family FROM f JOIN fam ON lemma = lexeme WHERE NOT fn), fm AS (SELECT doc_id, start, count(DISTINCT pos) / 300 AS family FROM (SELECT *, row_number() OVER ({_FRAME}, key ORDER BY pos) AS c FROM fk) WHERE c > 1 GROUP BY ALL),
fw AS (SELECT doc_id, start, word, min(pos) AS first FROM f WHERE NOT fn GROUP BY ALL), fp AS (SELECT f.doc_id, f.start, count(DISTINCT f.pos) / 300 AS phonetic FROM f JOIN rel ON f.word = w1 JOIN fw ON fw.doc_id = f.doc_id AND fw.start = f.start AND fw.word = w2 WHERE NOT fn AND fw.first < f.pos GROUP BY ALL)
SELECT doc_id, count(*) AS frames, round(avg(absolute), 6) AS absolute, round(avg(coalesce(filtered, 0)), 6) AS filtered, round(avg(coalesce(family, 0)), 6) AS family, round(avg(coalesce(phonetic, 0)), 6) AS phonetic FROM fa LEFT JOIN ff USING (doc_id, start) LEFT JOIN fm USING (doc_id, start) LEFT JOIN fp USING (doc_id, start) GROUP BY doc_id""")
def repetition_distribution(spark, sf_dir):
    out = repetition.repetition_distribution(tokens.repetition_tokens(whole(spark, sf_dir)), lexicons.small_lexicon(spark), lexicons.small_families(spark), lexicons.small_sounds(spark), 300)
    return _r(out, "absolute", "filtered", "family", "phonetic")


# ---- structure -------------------------------------------------------------------
def _map(rows) -> str:
    return "MAP {" + ", ".join(f"{_list([k])}: {_list([v])}" for k, v in rows) + "}"


_SIG = rf"""{_DOCS}, un AS (SELECT doc_id, flatten(list_transform(list_filter(string_split_regex(text, '\r\n|[\n\r\x{{0B}}\x{{0C}}\x{{1C}}-\x{{1E}}\x{{85}}\x{{2028}}\x{{2029}}]'), lambda l: {_strip('l')} <> ''), lambda l: {_sql_sentences('l')})) AS u FROM d),
us AS (SELECT doc_id, unnest(range(len(u))) AS unit, replace(lower(unnest(u)), '’', '''') AS x FROM un),
tk AS (SELECT doc_id, unit, flatten(list_transform(regexp_extract_all(x, '{_W}+(?:''{_W}+)?|\.\.\.|[…,.!?;:—–()«»"-]'), lambda t: CASE WHEN contains(t, '''') AND string_split(t, '''')[1] IN ({_list(config.ELIDED)}) THEN [string_split(t, '''')[1], substr(t, length(string_split(t, '''')[1]) + 2)] ELSE [t] END)) AS t FROM us),
tc AS (SELECT doc_id, unit, list_transform(t, lambda w: {{'w': w, 'c': lower({_map([(f, c) for f, _, c in lexicons.FORMS])}[w])}}) AS t FROM tk),
tv AS (SELECT *, coalesce(list_max(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN starts_with(coalesce(t[i].c, ''), 'verbe') THEN i ELSE 0 END)), 0) AS last_verb FROM tc),
tr AS (SELECT doc_id, unit, list_filter(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i].w IN (',', '.') THEN t[i].w WHEN NOT regexp_matches(t[i].w, '^{_W}') THEN NULL
  WHEN t[i].w IN ({_list(config.SUBORDINATORS)}) OR (t[i].w = 'pour' AND last_verb > i) THEN 'subordination' WHEN t[i].w IN ({_list(config.SUBJECT_PRONOUNS)}) THEN 'pronom'
  ELSE coalesce({_map(config.ELIDED.items())}[t[i].w], t[i].c, 'inconnu') END), lambda v: v IS NOT NULL) AS c FROM tv),
ts AS (SELECT doc_id, unit, list_transform(c, lambda v: CASE WHEN starts_with(v, 'nom') THEN 'nom' WHEN starts_with(v, 'adjectif') THEN 'adjectif' WHEN starts_with(v, 'verbe') THEN 'verbe' ELSE v END) AS c FROM tr),
fold AS (SELECT doc_id, unit, list_reduce(list_transform(c, lambda v: {{'o': v, 'p': ''}}), lambda a, x: CASE
  WHEN x.o IN (',', '.') THEN {{'o': a.o || x.o, 'p': ''}}
  WHEN x.o IN ('déterminant', 'préposition') OR (x.o = 'pronom' AND a.p = 'pronom') OR (x.o = 'verbe' AND a.p = 'verbe') THEN a
  WHEN x.o = 'nom' AND a.p = 'pronom' THEN {{'o': a.o || 'V', 'p': 'verbe'}}
  ELSE {{'o': a.o || CASE x.o WHEN 'verbe' THEN 'V' WHEN 'subordination' THEN 'P' WHEN 'conjonction' THEN 'J' WHEN 'inconnu' THEN 'I' ELSE 'X' END, 'p': x.o}} END, {{'o': '', 'p': ''}}).o AS k FROM ts WHERE len(c) > 0),
sig AS (SELECT doc_id, unit, coalesce(array_to_string(flatten(list_transform(regexp_extract_all(k, '[^,.]+|[,.]'), lambda g: CASE WHEN g IN (',', '.') THEN [g] ELSE list_transform(regexp_extract_all(g, 'P.*$|J?[^V]*V[^JP]*(?:P.*$|J|$)|.+$'), lambda z: CASE
  WHEN starts_with(z, 'P') THEN 'P' WHEN regexp_replace(z, '^J', '') = '' THEN '' WHEN contains(z, 'V') THEN
    CASE WHEN starts_with(regexp_replace(z, '^J', ''), 'V') THEN '' ELSE 'S' END || 'V' || CASE WHEN regexp_extract(regexp_replace(z, '^J', ''), '^[^V]*V([^JP]*)', 1) <> '' THEN 'C' ELSE '' END || regexp_extract(regexp_replace(z, '^J', ''), '^[^V]*V[^JP]*([JP]?)', 1)
  WHEN regexp_replace(z, '^J', '') = 'I' THEN 'I' ELSE 'C' END) END)), ''), '') AS signature FROM fold WHERE k <> ''),
ok AS (SELECT *, regexp_replace(signature, '[,.]', '', 'g') <> 'I' AS eligible, list_filter(regexp_extract_all(signature, 'P|(?:J[SVCI]*|[SVCI]+)[,.]?'), lambda q: regexp_replace(q, '[,.]', '', 'g') <> 'I') AS subpatterns FROM sig)"""


def _signatures(spark, sf_dir):
    return structure.signatures(whole(spark, sf_dir), lexicons.small_lexicon(spark))


@query(f"""WITH {_SIG} SELECT doc_id, unit, signature, coalesce(array_to_string(list_transform(list_filter(string_split(signature, ''), lambda c: c <> ''), lambda c: {_map(structure.ROLE_NAMES.items())}[c]), ' '), '') AS roles, eligible, coalesce(array_to_string(subpatterns, '|'), '') AS subpatterns FROM ok""")
def structure_signatures(spark, sf_dir):
    sig = F.col("signature")
    return _signatures(spark, sf_dir).select("doc_id", F.col("unit").cast("long").alias("unit"), "signature", structure.role_names(sig).alias("roles"), structure.eligible(sig).alias("eligible"), F.array_join(structure.subpatterns(sig), "|").alias("subpatterns"))


@query(f"""WITH {_SIG}, c AS (SELECT doc_id, signature, count(*) AS c FROM ok WHERE eligible GROUP BY ALL) SELECT doc_id, round(sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c), 6) AS structural_repetition_rate FROM c GROUP BY doc_id""")
def structural_repetition(spark, sf_dir):
    return _r(structure.structural_repetition(_signatures(spark, sf_dir)), "structural_repetition_rate")


@query(f"""WITH {_SIG}, n AS (SELECT doc_id, signature, lead(signature) OVER (PARTITION BY doc_id ORDER BY unit) AS nxt FROM ok WHERE eligible)
SELECT doc_id, round(coalesce(avg(CASE WHEN nxt IS NULL THEN NULL WHEN length(signature || nxt) = 0 THEN 0 ELSE levenshtein(signature, nxt) / greatest(length(signature), length(nxt)) END), 0), 6) AS structural_rhythm FROM n GROUP BY doc_id""")
def structural_rhythm(spark, sf_dir):
    return _r(structure.structural_rhythm(_signatures(spark, sf_dir)), "structural_rhythm")


@query(f"""WITH {_SIG}, p AS (SELECT doc_id, array_to_string(list_sort(subpatterns), '|') AS id, count(*) AS k FROM ok WHERE eligible AND len(subpatterns) > 0 GROUP BY ALL),
i AS (SELECT doc_id, id, k, pat, count(*) AS c FROM (SELECT *, unnest(string_split(id, '|')) AS pat FROM p) GROUP BY ALL), m AS (SELECT doc_id, id, any_value(k) AS k, sum(c) AS m FROM i GROUP BY ALL),
pr AS (SELECT a.doc_id, a.id AS l, b.id AS r, a.k * b.k AS w, a.m AS m, b.m AS n FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.id < b.id),
co AS (SELECT pr.*, pat, c AS x, 0 AS y FROM pr JOIN i ON i.doc_id = pr.doc_id AND i.id = l UNION ALL SELECT pr.*, pat, 0, c FROM pr JOIN i ON i.doc_id = pr.doc_id AND i.id = r),
pp AS (SELECT doc_id, l, r, w, m, n, pat, sum(x) AS x, sum(y) AS y FROM co GROUP BY ALL), di AS (SELECT doc_id, w, (0.75 * 0.5 * sum(abs(x / m - y / n)) + 0.25 * sum(abs(x - y)) / (m + n)) * least(1, sqrt((m + n) / 12)) AS d FROM pp GROUP BY doc_id, l, r, w, m, n),
fa AS (SELECT doc_id, sum(d * w) AS far FROM di GROUP BY doc_id), nn AS (SELECT doc_id, sum(k) AS n FROM p GROUP BY doc_id)
SELECT doc_id, round(CASE WHEN n > 1 THEN coalesce(far, 0) / (n * (n - 1) / 2) ELSE 0 END, 6) AS structural_diversity FROM nn LEFT JOIN fa USING (doc_id)""")
def structural_diversity(spark, sf_dir):
    return _r(structure.structural_diversity(_signatures(spark, sf_dir)), "structural_diversity")


# ---- dependency trees: shallow parses of the documents --------------------------------
_UPOS = " ".join(f"WHEN starts_with(category, '{c}') THEN '{u}'" for c, u in syntax.CATEGORY_UPOS.items())
_PARSED = rf"""{_SENT}, {_LEX}, pt AS (SELECT doc_id, pos AS sent_id, unnest(range(len(t))) AS tok_id, unnest(t) AS text FROM (SELECT doc_id, pos, regexp_extract_all(sentence, '{_W}+[''’]?|[.,!?;:]') AS t FROM sent)),
pl AS (SELECT pt.*, lower(text) AS lower, lex.lemma AS known, lower(lex.category) AS category FROM pt LEFT JOIN lex ON lower(text) = form),
pu AS (SELECT doc_id, sent_id, tok_id, text, lower, coalesce(known, lower) AS lemma, regexp_matches(text, '^[.,!?;:]$') AS is_punct, regexp_matches(text, '^\p{{L}}+$') AS is_alpha,
  CASE WHEN regexp_matches(text, '^[.,!?;:]$') THEN 'PUNCT' WHEN regexp_matches(text, '[''’]$') THEN 'DET' WHEN lower IN ({_list(config.SUBORDINATORS)}) THEN 'SCONJ' WHEN known IN ({_list(config.FUNCTION_LEMMAS)}) THEN 'AUX' {_UPOS} ELSE 'NOUN' END AS upos FROM pl),
pv AS (SELECT *, CASE WHEN upos IN ('VERB', 'AUX') THEN CASE WHEN ends_with(lower, 'é') THEN 'Part' ELSE 'Fin' END END AS verb_form FROM pu),
pw AS (SELECT *, lag(lower) OVER w AS b_lower, lag(upos) OVER w AS b_upos, lead(upos) OVER w AS n_upos, CASE WHEN verb_form = 'Part' AND upos = 'VERB' AND lag(upos) OVER w = 'AUX' THEN 'Pass' END AS voice FROM pv WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY tok_id)),
px AS (SELECT *, lead(voice) OVER w AS n_voice, coalesce(min(tok_id) FILTER (WHERE upos = 'VERB') OVER s, min(tok_id) FILTER (WHERE upos = 'AUX') OVER s, 0) AS root FROM pw WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY tok_id), s AS (PARTITION BY doc_id, sent_id)),
py AS (SELECT *, tok_id = root AS is_root, coalesce(bool_or(tok_id = root AND coalesce(voice = 'Pass', false)) OVER (PARTITION BY doc_id, sent_id), false) AS passive, coalesce(upos = 'VERB' AND b_lower = 'qui' AND tok_id >= 2 AND tok_id <> root, false) AS relative,
  coalesce(upos = 'AUX' AND n_voice = 'Pass' AND tok_id <> root, false) AS carries, coalesce(upos IN ('DET', 'ADP', 'ADJ') AND (n_upos IN ('NOUN', 'PROPN') OR (upos = 'DET' AND n_upos = 'ADJ') OR (upos = 'ADP' AND n_upos = 'DET')) AND tok_id <> root, false) AS leans FROM px),
parses AS MATERIALIZED (SELECT doc_id, sent_id, tok_id, text, lower, lemma, upos, verb_form, voice, is_punct, is_alpha, CASE WHEN is_root THEN tok_id WHEN relative THEN tok_id - 2 WHEN carries OR leans THEN tok_id + 1 ELSE root END AS head_id,
  CASE WHEN is_root THEN 'ROOT' WHEN is_punct THEN 'punct' WHEN relative THEN 'acl:relcl' WHEN carries THEN 'aux:pass' WHEN upos = 'VERB' THEN CASE WHEN b_upos = 'SCONJ' THEN 'advcl' ELSE 'conj' END
  WHEN upos IN ('NOUN', 'PROPN', 'PRON') THEN CASE WHEN tok_id < root THEN CASE WHEN passive THEN 'nsubj:pass' ELSE 'nsubj' END ELSE 'obj' END WHEN upos = 'ADV' THEN 'advmod' WHEN upos = 'DET' THEN 'det' WHEN upos = 'ADP' THEN 'case' WHEN upos = 'ADJ' THEN 'amod' ELSE 'dep' END AS dep FROM py)"""
_DEPTH = "up AS (SELECT doc_id, sent_id, tok_id, head_id AS at, (head_id <> tok_id)::INT AS d FROM parses WHERE NOT is_punct UNION ALL SELECT up.doc_id, up.sent_id, up.tok_id, p.head_id, d + 1 FROM up JOIN parses p ON p.doc_id = up.doc_id AND p.sent_id = up.sent_id AND p.tok_id = up.at WHERE p.head_id <> p.tok_id AND d < 100), dp AS (SELECT p.doc_id, p.sent_id, coalesce(max(d), 0) AS depth FROM (SELECT DISTINCT doc_id, sent_id FROM parses) p LEFT JOIN up USING (doc_id, sent_id) GROUP BY ALL)"
_SYNTAX = rf"""kd AS (SELECT doc_id, sent_id, head_id AS tok_id, bool_or(coalesce(upos = 'AUX' AND verb_form = 'Fin', false)) AS aux, bool_or(dep IN ('aux:pass', 'nsubj:pass')) AS pass FROM parses WHERE head_id <> tok_id GROUP BY ALL),
sy AS (SELECT p.*, coalesce((p.upos = 'VERB' AND (p.verb_form = 'Fin' OR aux)) OR (p.upos = 'AUX' AND p.verb_form = 'Fin' AND p.dep IN ({_list(syntax.CLAUSE_DEPS)})), false) AS pred, coalesce(p.voice = 'Pass', false) OR coalesce(pass, false) AS passive, coalesce(h.upos IN ('VERB', 'AUX') AND h.dep = 'advcl' AND h.tok_id < h.head_id, false) AS circ
  FROM parses p LEFT JOIN kd USING (doc_id, sent_id, tok_id) LEFT JOIN parses h ON h.doc_id = p.doc_id AND h.sent_id = p.sent_id AND h.tok_id = p.head_id),
sm AS (SELECT doc_id, sent_id, bool_or(pred) AND NOT bool_or(pred AND passive) AS active, NOT bool_or(coalesce(upos IN ('VERB', 'AUX') AND verb_form = 'Fin', false)) AS nominal, count(*) FILTER (WHERE dep = 'acl:relcl') AS rel, count(*) FILTER (WHERE dep IN ({_list(config.SUBORDINATE_DEPS)})) AS sub,
  bool_or(lower = 'comme' AND NOT circ) AS comme, replace(replace(string_agg(lower, ' ' ORDER BY tok_id), '’', chr(39)), chr(39) || ' ', chr(39)) AS plain, count(*) FILTER (WHERE upos = 'NOUN') AS a, count(*) FILTER (WHERE upos = 'PROPN') AS b, count(*) FILTER (WHERE upos IN ('VERB', 'AUX')) AS c, count(*) FILTER (WHERE upos = 'ADJ') AS d, count(*) FILTER (WHERE upos = 'ADV') AS e FROM sy GROUP BY ALL),
sn AS (SELECT *, comme OR {" OR ".join(f"contains(plain, {_list([m])})" for m in config.COMPARISON_MARKERS)} AS comparison FROM sm)"""


def _parses(spark, sf_dir):
    return syntax.shallow_parses(whole(spark, sf_dir), lexicons.small_lexicon(spark))


@query(f"WITH RECURSIVE {_PARSED}, {_DEPTH} SELECT doc_id, sent_id, depth::BIGINT AS depth FROM dp")
def dependency_depth(spark, sf_dir):
    return syntax.sentence_measures(_parses(spark, sf_dir)).select("doc_id", "sent_id", "depth")


@query(f"WITH {_PARSED}, {_SYNTAX} SELECT doc_id, sent_id, coalesce(comparison, false) AS comparison FROM sn")
def comparison_sentences(spark, sf_dir):
    """Sentences that compare: `comme` outside an adverbial clause, or a marker."""
    return syntax.sentence_measures(_parses(spark, sf_dir)).select("doc_id", "sent_id", "comparison")


@query(f"""WITH {_PARSED}, {_SYNTAX}
SELECT doc_id, sum(rel)::BIGINT AS relative_clause_count, sum(sub)::BIGINT AS subordinate_clause_count, round(avg(active::INT), 6) AS active_voice_ratio, round(avg(nominal::INT), 6) AS nominal_sentence_ratio FROM sn GROUP BY doc_id""")
def clause_measures(spark, sf_dir):
    out = syntax.document_measures(syntax.sentence_measures(_parses(spark, sf_dir)))
    return _r(out.select("doc_id", "relative_clause_count", "subordinate_clause_count", "active_voice_ratio", "nominal_sentence_ratio"), "active_voice_ratio", "nominal_sentence_ratio")


_SHARES = ", ".join(f"round(CASE WHEN sum(a + b + c + d + e) > 0 THEN sum({x}) / sum(a + b + c + d + e) ELSE 0 END, 6) AS {n}" for x, n in zip("abcde", ("pos_common_noun_ratio", "pos_proper_noun_ratio", "pos_verb_ratio", "pos_adjective_ratio", "pos_adverb_ratio")))


@query(f"""WITH RECURSIVE {_PARSED}, {_DEPTH}, {_SYNTAX} SELECT doc_id, round(avg(depth), 6) AS average_syntactic_depth, sum(rel)::BIGINT AS relative_clause_count, sum(sub)::BIGINT AS subordinate_clause_count,
  round(sum(rel) / count(*), 6) AS relative_clause_ratio, round(sum(sub) / count(*), 6) AS subordinate_clause_ratio, sum(nominal::INT)::BIGINT AS nominal_sentence_count, round(avg(nominal::INT), 6) AS nominal_sentence_ratio,
  round(avg(active::INT), 6) AS active_voice_ratio, round(avg(comparison::INT), 6) AS metaphorical_comme_ratio, {_SHARES} FROM sn JOIN dp USING (doc_id, sent_id) GROUP BY doc_id""")
def syntax_document_measures(spark, sf_dir):
    out = syntax.document_measures(syntax.sentence_measures(_parses(spark, sf_dir)))
    return _r(out, *(c for c in out.columns if c != "doc_id" and not c.endswith("_count")))


@query(f"WITH {_PARSED}, {_SYNTAX} SELECT doc_id, {_SHARES} FROM sn GROUP BY doc_id")
def pos_distribution(spark, sf_dir):
    cols = ["pos_common_noun_ratio", "pos_proper_noun_ratio", "pos_verb_ratio", "pos_adjective_ratio", "pos_adverb_ratio"]
    return _r(syntax.document_measures(syntax.sentence_measures(_parses(spark, sf_dir))).select("doc_id", *cols), *cols)


@query(f"""WITH {_PARSED}, {_values('uc', 'tag, cat', list(syntax.UPOS_CATEGORIES.items()))}, cx AS (SELECT doc_id, lower AS word, lemma, coalesce(cat, lower(upos)) AS category, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id, tok_id) - 1 AS pos FROM parses LEFT JOIN uc ON upos = tag WHERE is_alpha AND length(lower) >= 2),
st AS (SELECT cx.*, lex.lemma AS s_lemma, CASE WHEN starts_with(lower(lex.category), cx.category) THEN lex.lemma WHEN coalesce(nullif(cx.lemma, ''), word) <> word THEN cx.lemma END AS direct FROM cx LEFT JOIN lex ON word = form),
op AS (SELECT DISTINCT word, category FROM st WHERE direct IS NULL AND length(word) > 3), ask AS (SELECT word, category, left(word, n::INT) AS prefix FROM (SELECT *, unnest(range(3, length(word))) AS n FROM op)),
kn AS (SELECT DISTINCT lower(category) AS k, lemma AS k_lemma, left(form, n::INT) AS prefix FROM (SELECT *, unnest(range(3, length(form) + 1)) AS n FROM lex)), gu AS (SELECT word, ask.category, k_lemma AS guess FROM ask JOIN kn USING (prefix) WHERE starts_with(k, ask.category)
  QUALIFY row_number() OVER (PARTITION BY word, ask.category ORDER BY length(prefix) DESC, levenshtein(word, k_lemma), length(k_lemma), k_lemma) = 1)
SELECT doc_id, count(*) AS forms, sha256(string_agg(form || '=' || lemma, ' ' ORDER BY form)) AS lemmas_sha256 FROM (SELECT doc_id, word AS form, arg_max(coalesce(direct, guess, s_lemma, nullif(lemma, ''), word), pos) AS lemma FROM st LEFT JOIN gu USING (word, category) GROUP BY doc_id, word) GROUP BY doc_id""")
def contextual_lemmas(spark, sf_dir):
    """The lemma of every form of a document by its context: a count and one digest a document."""
    rows = lexicons.contextual_lemmas(syntax.contextual_tokens(_parses(spark, sf_dir)), lexicons.small_lexicon(spark))
    line = F.sort_array(F.collect_list(F.struct("form", F.concat_ws("=", "form", "lemma").alias("s"))))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("forms"), line.alias("a")).select("doc_id", "forms", F.sha2(F.array_join("a.s", " "), 256).alias("lemmas_sha256"))


# ---- windows and cleaning ------------------------------------------------------------
@query(rf"""WITH {_DOCS}, e AS (SELECT doc_id, length(text) AS n, CASE WHEN length(text) > 3000 THEN length(regexp_extract(substr(text, 3001), '(?s)^(.*?[.!?…]+["»”’'')\]]*)(?:\s|$)', 1)) END AS gap FROM d)
SELECT doc_id, (CASE WHEN n <= 3000 THEN n WHEN gap > 0 THEN 3000 + gap ELSE n END)::BIGINT AS window_end FROM e""")
def char_window_first(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.first_window_end(F.col("text"), 3000).cast("long").alias("window_end"))


_FOLDED = rf"""{_DOCS}, e AS (SELECT doc_id, text, list_transform(string_split(regexp_replace(text, '([.!?…]+["»”’'')\]]*)(\s|$)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: length(x)) AS l FROM d),
f AS (SELECT doc_id, text, list_reduce(list_transform(l, lambda v: {{'n': v::BIGINT, 's': 0::BIGINT, 'o': []::STRUCT(s BIGINT, e BIGINT)[]}}), lambda a, x: CASE WHEN a.n + x.n - a.s >= 3000 THEN {{'n': a.n + x.n, 's': a.n + x.n, 'o': list_append(a.o, {{'s': a.s, 'e': a.n + x.n}})}} ELSE {{'n': a.n + x.n, 's': a.s, 'o': a.o}} END, {{'n': 0::BIGINT, 's': 0::BIGINT, 'o': []::STRUCT(s BIGINT, e BIGINT)[]}}) AS a FROM e),
g AS (SELECT doc_id, list_filter(list_transform(CASE WHEN a.n > a.s THEN list_append(a.o, {{'s': a.s, 'e': a.n}}) ELSE a.o END, lambda w: {{'s': w.s, 'e': w.e, 'f': {_strip('substr(text, w.s + 1, w.e - w.s)')}}}), lambda w: w.f <> '') AS w FROM f)"""


@query(f"WITH {_FOLDED}, u AS (SELECT doc_id, unnest(range(len(w))) AS window_index, unnest(w) AS w FROM g) SELECT doc_id, window_index, w.s AS start, w.e AS \"end\", sha256(w.f) AS fragment_sha256 FROM u")
def char_windows(spark, sf_dir):
    w = docs(spark, sf_dir).select("doc_id", F.posexplode(T.char_windows(F.col("text"), 3000)).alias("window_index", "w"))
    return w.select("doc_id", *(F.col(c).cast("long").alias(c.split(".")[-1]) for c in ("window_index", "w.start", "w.end")), F.sha2("w.fragment", 256).alias("fragment_sha256"))


_PARAGRAPHS = rf"""{_DOCS}, pp AS (SELECT doc_id, list_transform(list_filter(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda p: {_strip('p')} <> ''), lambda p: {_strip('p')}) AS p FROM d),
pf AS (SELECT doc_id, list_reduce(list_transform(p, lambda v: {{'o': []::VARCHAR[], 'h': [v], 'n': len({_sql_words('v')})::BIGINT}}), lambda a, x: CASE WHEN a.n + x.n >= 200 THEN {{'o': list_append(a.o, array_to_string(list_concat(a.h, x.h), chr(10) || chr(10))), 'h': []::VARCHAR[], 'n': 0::BIGINT}} ELSE {{'o': a.o, 'h': list_concat(a.h, x.h), 'n': a.n + x.n}} END, {{'o': []::VARCHAR[], 'h': []::VARCHAR[], 'n': 0::BIGINT}}) AS a FROM pp),
pg AS (SELECT doc_id, CASE WHEN len(a.h) > 0 AND (a.n >= 200 * {config.FINAL_WINDOW_RATIO} OR len(a.o) = 0) THEN list_append(a.o, array_to_string(a.h, chr(10) || chr(10))) ELSE a.o END AS o FROM pf), pw AS (SELECT doc_id, unnest(range(len(o))) AS window_index, unnest(o) AS w FROM pg)"""


@query(f"WITH {_PARAGRAPHS} SELECT doc_id, window_index, len({_sql_words('w')}) AS words FROM pw")
def paragraph_windows(spark, sf_dir):
    lines = docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    w = lines.select("doc_id", F.posexplode(T.paragraph_windows(F.col("text"), 200)).alias("window_index", "w"))
    return w.select("doc_id", F.col("window_index").cast("long").alias("window_index"), F.size(T.tokenize(F.col("w"))).cast("long").alias("words"))


@query(f"""WITH {_DOCS}, b AS (SELECT doc_id, strlen(text) AS n FROM d), w AS (SELECT doc_id, n, CASE WHEN n < 1000 THEN [n] ELSE list_transform(range(n // 1000), lambda i: 1000::BIGINT) END AS s FROM b), u AS (SELECT doc_id, unnest(range(len(s))) AS window_index, unnest(s) AS bytes FROM w) SELECT doc_id, window_index, bytes FROM u""")
def byte_windows(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(T.byte_windows(F.col("text"), 1000)).alias("window_index", "b")).select("doc_id", F.col("window_index").cast("long").alias("window_index"), F.octet_length("b").cast("long").alias("bytes"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '\n(?:[ \t]*\n){2,}', chr(10) || chr(10), 'g')) AS normalised_sha256 FROM documents""")
def normalised_newlines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(T.normalise_newlines(F.col("text")), 256).alias("normalised_sha256"))


@query("""SELECT doc_id, 'Text ' || doc_id AS title, source AS author, sha256(coalesce(text, '')) AS body_sha256 FROM documents""")
def front_matter(spark, sf_dir):
    """Documents written with a front matter and read back."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marked = d.select("doc_id", F.concat(F.lit("---\ntitle: \"Text "), F.col("doc_id").cast("string"), F.lit("\"\nauthor: "), "source", F.lit("\n---\n"), F.coalesce("text", F.lit(""))).alias("text"))
    m = T.front_matter(F.col("text"))
    return marked.select("doc_id", m["title"].alias("title"), m["author"].alias("author"), F.sha2(T.markdown_body(F.col("text")), 256).alias("body_sha256"))


@query(f"""WITH {_DOCS}, l AS (SELECT doc_id, list_filter(string_split_regex(text, '\\r\\n|[\\n\\r]'), lambda x: NOT regexp_matches(x, '^\\s*#{{1,6}}\\s+\\S') AND NOT regexp_matches(x, '^\\s*>')) AS l FROM d), j AS (SELECT doc_id, array_to_string(l, chr(10)) AS b FROM l) SELECT doc_id, sha256({_strip('b')}) AS clean_sha256 FROM j""")
def clean_body(spark, sf_dir):
    marked = docs(spark, sf_dir).withColumn("text", F.concat(F.lit("# Préface\ndropped\n# Chapitre\n> quote\n"), "text"))
    return marked.select("doc_id", F.sha2(T.clean_body(F.col("text")), 256).alias("clean_sha256"))


@query()
def gzip_ratio(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", compress.gzip_ratio(F.col("text")).alias("gzip_compression_ratio"))


@query()
def gzip_window_ratio(spark, sf_dir):
    return compress.gzip_window_ratio(docs(spark, sf_dir), 4096)


_TAGS = "|".join((*html.BLOCK_TAGS, "hr"))
_SKIPPED = "|".join(f"<{t}\\b[^>]*>.*?(?:</{t}\\s*>|\\z)" for t in html.SKIPPED_ELEMENTS)
_NOT_END = "NOT regexp_matches({0}, '" + html.SENTENCE_END + "')"
_LINE = {k: f"(length({{0}}) BETWEEN {a} AND {b} AND len(string_split({{0}}, ' ')) <= {w} AND contains({{0}}, '{h}') AND {_NOT_END}" + "".join(f" AND NOT starts_with({{0}}, '{n}')" for n in no) + ")" for k, (a, b, w, h, no) in html.LINES.items()}
_LEVEL = " ".join(f"WHEN block = '{t}' THEN '{m}'" for t, m in html.MARKS.items())


@query(rf"""WITH bo AS (SELECT page_id, row_number() OVER () AS row, regexp_replace(regexp_extract(html, '(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)', 1), '(?is)<!--.*?(?:-->|\z)|{_SKIPPED}|<[!?][^>]*>', '', 'g') AS b FROM pages WHERE html IS NOT NULL),
pa AS (SELECT page_id, row, string_split(regexp_replace(b, '(?i)<(/?(?:{_TAGS})[\s/>])', chr(1) || '\1', 'g'), chr(1)) AS p FROM bo), pb AS (SELECT page_id, row, unnest(range(len(p))) AS pos, unnest(p) AS part FROM pa),
pc AS (SELECT *, CASE WHEN pos > 0 AND contains(part, '>') THEN left(part, strpos(part, '>') - 1) ELSE '' END AS head, CASE WHEN pos = 0 THEN part WHEN contains(part, '>') THEN substr(part, strpos(part, '>') + 1) ELSE '' END AS raw FROM pb),
pd AS (SELECT page_id, row, pos, lower(regexp_extract(head, '^/?([A-Za-z0-9]+)', 1)) AS tag, CASE WHEN pos = 0 THEN 'start' WHEN NOT contains(part, '>') THEN 'single' WHEN lower(regexp_extract(head, '^/?([A-Za-z0-9]+)', 1)) = 'hr' THEN 'rule' WHEN starts_with(head, '/') THEN 'close' WHEN ends_with(head, '/') THEN 'single' ELSE 'open' END AS kind, regexp_matches(head, '(?i)\sclass\s*=\s*["'']?[^"''\s]') AS classed,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '(?s)</?[A-Za-z][^>]*(?:>|\z)', '', 'g'), '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g'), '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+', ' ', 'g')) AS text FROM pc),
pe AS (SELECT *, sum(CASE WHEN tag = 'blockquote' THEN CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END ELSE 0 END) OVER w AS s, coalesce(last_value(CASE kind WHEN 'open' THEN tag WHEN 'close' THEN '' END IGNORE NULLS) OVER w, '') AS block, coalesce(lead(kind) OVER o = 'close', false) AS ended FROM pd WINDOW o AS (PARTITION BY row ORDER BY pos), w AS (PARTITION BY row ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pf AS (SELECT *, s > least(0, min(s) OVER w) AS quoted, CASE WHEN kind = 'close' THEN lag(block) OVER o IN ({_list(html.HEADINGS)}) END AS closed FROM pe WINDOW o AS (PARTITION BY row ORDER BY pos), w AS (PARTITION BY row ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pg AS (SELECT *, coalesce(last_value(closed IGNORE NULLS) OVER (PARTITION BY row ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS below FROM pf),
ph AS (SELECT *, coalesce(last_value(CASE kind WHEN 'open' THEN tag = 'p' AND classed AND below WHEN 'close' THEN false END IGNORE NULLS) OVER (PARTITION BY row ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS sub FROM pg),
pi AS (SELECT *, CASE WHEN NOT ended OR block = '' OR (sub AND NOT {_LINE['subtitle'].format('text')}) THEN '' WHEN quoted THEN '>' WHEN sub THEN '##' {_LEVEL} ELSE '' END AS mark FROM ph),
pj AS (SELECT page_id, row, pos, 0 AS k, '---' AS block FROM pi WHERE kind = 'rule' UNION ALL SELECT page_id, row, pos, 1, CASE WHEN text = '*' AND mark = '' THEN '---' WHEN mark = '' THEN text ELSE mark || ' ' || text END FROM pi WHERE text <> '' AND NOT regexp_matches(text, '{html.UNKNOWN}')),
pk AS (SELECT *, coalesce(last_value(CASE WHEN NOT {_LINE['attribution'].format('block')} THEN starts_with(block, '> ') END IGNORE NULLS) OVER (PARTITION BY row ORDER BY pos, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS cited FROM pj),
pl AS (SELECT page_id, row, pos, k, CASE WHEN cited AND {_LINE['attribution'].format('block')} THEN '> ' || block ELSE block END AS block FROM pk), pm AS (SELECT *, lag(block) OVER (PARTITION BY row ORDER BY pos, k) AS last FROM pl)
SELECT page_id, row_number() OVER (PARTITION BY row ORDER BY pos, k) - 1 AS pos, block FROM pm WHERE last IS NULL OR last <> block""")
def html_blocks(spark, sf_dir):
    return html.blocks(files.dealt(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))).select("page_id", F.col("pos").cast("long").alias("pos"), "block")


# ---- corpus analytics: one entity per source -------------------------------------------
CORPUS_METRICS = ["avg_sentence_length", "sentence_length_std_dev", "burstiness", "type_token_ratio", "avg_word_length", "punctuation_per_100_words"]
_CORPUS = f"""{_TOK}, byw AS (SELECT doc_id, word, count(*) AS c FROM tok GROUP BY ALL), tt AS (SELECT doc_id, sum(c) AS words, count(*) / sum(c) AS type_token_ratio, sum(c * length(word)) / sum(c) AS avg_word_length FROM byw GROUP BY doc_id),
b AS (SELECT doc_id, {_sql_sentences('text')} AS s FROM d), sent AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM b), ln AS (SELECT doc_id, pos, length(sentence) AS len FROM sent), st AS (SELECT *, abs(len - lag(len) OVER (PARTITION BY doc_id ORDER BY pos)) AS step FROM ln),
sl AS (SELECT doc_id, avg(len) AS avg_sentence_length, stddev_pop(len) AS sentence_length_std_dev, coalesce(avg(step) / avg(len), 0) AS burstiness FROM st GROUP BY doc_id),
pu AS (SELECT doc_id, len(regexp_extract_all(text, '[.,;:!?…—–\\-()«»"]')) AS marks FROM d),
wide AS (SELECT source AS entity, avg(avg_sentence_length) AS avg_sentence_length, avg(sentence_length_std_dev) AS sentence_length_std_dev, avg(burstiness) AS burstiness, avg(type_token_ratio) AS type_token_ratio, avg(avg_word_length) AS avg_word_length, avg(marks / words * 100) AS punctuation_per_100_words
  FROM documents JOIN tt USING (doc_id) JOIN sl USING (doc_id) JOIN pu USING (doc_id) GROUP BY source),
long AS (UNPIVOT wide ON {', '.join(CORPUS_METRICS)} INTO NAME metric VALUE value)"""
_PAIRS = f"""{_CORPUS}, ms AS (SELECT metric, avg(value) AS m, stddev_pop(value) AS s FROM long GROUP BY metric), z AS (SELECT entity, metric, CASE WHEN s > 1e-12 THEN (value - m) / s END AS z FROM long JOIN ms USING (metric)),
pairs AS (SELECT a.entity AS "left", b.entity AS "right", avg(abs(a.z - b.z)) AS distance FROM z a JOIN z b ON a.metric = b.metric AND a.entity < b.entity GROUP BY ALL), bothways AS (SELECT * FROM pairs UNION ALL SELECT "right", "left", distance FROM pairs)"""


def entity_long(spark, sf_dir) -> DataFrame:
    """entity (source), metric, value: means over a source's documents, written once: what follows reads them several times, and sums in another order would differ in their last digits."""
    held = files.together(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source"))
    n = F.regexp_count("text", F.lit(T.WORD))
    marks = held.where(n > 0).select("doc_id", "source", (T.punctuation_count(F.col("text")) / n * 100).alias("punctuation_per_100_words"))
    wide = lexical.type_token(tokens.tokens(held)).join(rhythm.sentence_lengths(tokens.sentences(held)), "doc_id").join(marks, "doc_id")
    means = stage(wide.groupBy("source").agg(*(F.avg(m).alias(m) for m in CORPUS_METRICS)), "entities")
    return corpus.long_view(means, "source", CORPUS_METRICS)


def _pairs(spark, sf_dir) -> DataFrame:
    return corpus.burrows(entity_long(spark, sf_dir), CORPUS_METRICS)


@query(f"WITH {_CORPUS} SELECT entity, metric, round(value, 6) AS value FROM long")
def metrics_long(spark, sf_dir):
    return _r(entity_long(spark, sf_dir), "value")


@query(f"""WITH {_CORPUS}, q AS (SELECT metric, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY metric), r AS (SELECT long.*, n < 4 OR value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM long JOIN q USING (metric)),
k AS (SELECT metric, count(*) FILTER (WHERE ok) AS k, avg(value) FILTER (WHERE ok) AS m1, stddev_pop(value) FILTER (WHERE ok) AS s1, avg(value) AS m0, stddev_pop(value) AS s0 FROM r GROUP BY metric)
SELECT metric, round(CASE WHEN k < 3 THEN s0 / abs(m0) ELSE s1 / abs(m1) END * 100, 6) AS sigma FROM k""")
def metric_dispersion(spark, sf_dir):
    return _r(corpus.dispersion(entity_long(spark, sf_dir)), "sigma")


@query(f'WITH {_PAIRS} SELECT "left", "right", round(distance, 6) AS distance FROM pairs')
def burrows_distance(spark, sf_dir):
    return _r(_pairs(spark, sf_dir), "distance")


@query(f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY "left" ORDER BY distance, "right") AS rank FROM bothways) SELECT "left", "right", round(distance, 6) AS distance, rank FROM r WHERE rank <= 5""")
def burrows_top5(spark, sf_dir):
    """The five nearest of every source."""
    names = entity_long(spark, sf_dir).select("entity").distinct()
    return _r(corpus.nearest(_pairs(spark, sf_dir), names, names), "distance").withColumn("rank", F.col("rank").cast("long"))


@query(f'WITH {_PAIRS} SELECT "left" AS entity, round(min(distance), 6) AS nearest FROM bothways GROUP BY "left"')
def singularity(spark, sf_dir):
    return _r(corpus.singularity(_pairs(spark, sf_dir)), "nearest")


_NEAR = f"""{_PAIRS}, nb AS (SELECT b."left", b."right", any_value(b.distance) AS distance, 100.0 * count(*) FILTER (WHERE round(p.distance, 12) >= round(b.distance, 12)) / count(*) AS percentile FROM bothways b CROSS JOIN pairs p GROUP BY b."left", b."right"),
nr AS (SELECT *, row_number() OVER (PARTITION BY "left" ORDER BY percentile DESC, distance, "right") AS rank FROM nb)"""


@query(f'WITH {_NEAR} SELECT "left", "right", round(distance, 6) AS distance, round(percentile, 6) AS percentile, rank FROM nr')
def neighborhood_percentile(spark, sf_dir):
    return _r(corpus.neighbourhood(_pairs(spark, sf_dir)), "distance", "percentile").withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_NEAR} SELECT "left", "right", round(distance, 6) AS distance, round(percentile, 6) AS percentile, rank FROM nr WHERE rank <= 3 OR "right" = 'src7'""")
def neighborhood_top(spark, sf_dir):
    """The three nearest of every source, and one source pinned wherever it ranks."""
    pairs = _pairs(spark, sf_dir)
    pinned = corpus.both_ways(pairs).where("right = 'src7'")
    return _r(corpus.neighbourhood(pairs, top=3, pinned=pinned), "distance", "percentile").withColumn("rank", F.col("rank").cast("long"))


RADAR_AXES = [("punctuation_per_100_words", False), ("burstiness", False), ("type_token_ratio", False), ("sentence_length_std_dev", False), ("avg_sentence_length", True)]
_RADAR = f"""{_CORPUS}, {_values('axes', 'o, metric, sgn', [(i, m, -1 if v else 1) for i, (m, v) in enumerate(RADAR_AXES)])}, ms AS (SELECT metric, avg(value) AS m FROM long GROUP BY metric),
rad AS (SELECT entity, metric, o AS axis, greatest(0.05, least(1.0, 0.5 + 1.25 * sgn * (value - m) / abs(m))) AS radius FROM long JOIN axes USING (metric) JOIN ms USING (metric))"""


@query(f"WITH {_RADAR} SELECT entity, metric, axis::BIGINT AS axis, round(radius, 6) AS radius FROM rad")
def radar_profile(spark, sf_dir):
    return _r(corpus.radar(entity_long(spark, sf_dir), RADAR_AXES), "radius").withColumn("axis", F.col("axis").cast("long"))


@query(f"""WITH {_RADAR}, p AS (SELECT entity, radius * coalesce(lead(radius) OVER (PARTITION BY entity ORDER BY axis), first_value(radius) OVER (PARTITION BY entity ORDER BY axis ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS p FROM rad)
SELECT entity, round(abs(sum(p)) * sin(2 * pi() / count(*)) / 2, 6) AS area FROM p GROUP BY entity""")
def radar_area(spark, sf_dir):
    return _r(corpus.polygon_area(corpus.radar(entity_long(spark, sf_dir), RADAR_AXES)), "area")


_SCALED = f"{_CORPUS}, mm AS (SELECT metric, min(value) AS lo, max(value) AS hi FROM long GROUP BY metric), sc AS (SELECT entity, metric, CASE WHEN hi = lo THEN 50.0 ELSE ln(1 + 4 * (value - lo) / (hi - lo)) / ln(5) * 100 END AS scaled FROM long JOIN mm USING (metric))"


@query(f"WITH {_SCALED} SELECT entity, metric, round(scaled, 6) AS scaled FROM sc")
def log_scaled_profile(spark, sf_dir):
    return _r(corpus.scaled(entity_long(spark, sf_dir)), "scaled")


@query(f"""WITH {_SCALED}, o AS (SELECT entity, scaled * coalesce(lead(scaled) OVER w, first_value(scaled) OVER (PARTITION BY entity ORDER BY metric ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS p FROM sc WINDOW w AS (PARTITION BY entity ORDER BY metric)), ar AS (SELECT entity, abs(sum(p)) * sin(2 * pi() / count(*)) / 2 AS area FROM o GROUP BY entity)
SELECT entity, round(area / max(area) OVER () * 100, 6) AS coverage FROM ar""")
def coverage_surface(spark, sf_dir):
    return _r(corpus.coverage(corpus.scaled(entity_long(spark, sf_dir))), "coverage")


@query(f"WITH {_SCALED} SELECT metric, round(greatest(10, min(scaled)), 6) AS low, round(greatest(10, list_sort(list(scaled))[(count(*) - 1) // 2 + 1]), 6) AS median, round(greatest(10, max(scaled)), 6) AS high FROM sc GROUP BY metric")
def profile_limits(spark, sf_dir):
    return _r(corpus.profile_limits(corpus.scaled(entity_long(spark, sf_dir))), "low", "median", "high")


@query(f"WITH {_CORPUS} SELECT substr(entity, 1, 4) AS author, metric, round(min(value), 6) AS low, round(quantile_cont(value, 0.5), 6) AS median, round(max(value), 6) AS high, round(avg(value), 6) AS mean FROM long GROUP BY ALL")
def author_profile(spark, sf_dir):
    long = entity_long(spark, sf_dir)
    authors = long.select("entity", F.substring("entity", 1, 4).alias("author")).distinct()
    return _r(corpus.author_summary(long, authors), "low", "median", "high", "mean")


@query()
def mds_map(spark, sf_dir):
    return corpus.mds(_pairs(spark, sf_dir))


@query(f"""WITH {_CORPUS}, w AS (PIVOT (SELECT metric, entity, round(value, 6) AS v FROM long) ON entity IN ({_list([f"src{k}" for k in range(20)])}) USING first(v) GROUP BY metric) SELECT * FROM w""")
def comparison_table(spark, sf_dir):
    """metric x entity."""
    return reports.compared(_r(entity_long(spark, sf_dir), "value"))


@query()
def metric_vector(spark, sf_dir):
    """The whole vector of every document (no parses: syntax measures are absent)."""
    return metrics.metric_vector(whole(spark, sf_dir), lexicons.small_lexicon(spark), lexicons.small_families(spark), lexicons.small_sounds(spark))


def _raw(name: str) -> str:
    """A registered query's SQL without rounding, as a subquery."""
    return "(" + SQL[name].replace("round(", "(").replace(" + 1e-9, 6)", ")") + ")"


_WINDOWED = rf"d AS (SELECT doc_id, {_strip('substr(text, 1, e)')} AS text FROM (SELECT doc_id, text, CASE WHEN length(text) <= 20000 THEN length(text) WHEN gap > 0 THEN 20000 + gap ELSE length(text) END AS e FROM (SELECT doc_id, coalesce(text, '') AS text, length(regexp_extract(substr(coalesce(text, ''), 20001), '(?s)^(.*?[.!?…]+[\"»”’'')\]]*)(?:\s|$)', 1)) AS gap FROM documents)))"


@query(f"""WITH m AS (SELECT doc_id, coalesce(avg_sentence_length, 0) AS l, coalesce(sentence_length_amplitude, 0) AS a, coalesce(burstiness, 0) AS b, coalesce(filtered_repetition_rate, 0) AS f, coalesce(structural_repetition_rate, 0) AS r, coalesce(structural_diversity, 0) AS d, coalesce(structural_rhythm, 0) AS y FROM (SELECT doc_id FROM documents)
  LEFT JOIN {_raw('sentence_length_stats')} USING (doc_id) LEFT JOIN {_raw('lexical_repetition').replace(_DOCS, _WINDOWED)} USING (doc_id) LEFT JOIN {_raw('structural_repetition')} USING (doc_id) LEFT JOIN {_raw('structural_diversity')} USING (doc_id) LEFT JOIN {_raw('structural_rhythm')} USING (doc_id)),
p AS (SELECT doc_id, 1 - greatest(0, least(1, CASE WHEN l > 0 THEN a / l ELSE 0 END / 2)) AS sentence_amplitude, 1 - greatest(0, least(1, b)) AS burstiness_uniformity, greatest(0, least(1, f)) AS vocabulary_repetition, greatest(0, least(1, r)) AS structure_repetition, 1 - greatest(0, least(1, d)) AS structure_similarity, 1 - greatest(0, least(1, y)) AS structure_rhythm FROM m)
SELECT doc_id, round(sentence_amplitude, 6) AS sentence_amplitude, round(burstiness_uniformity, 6) AS burstiness_uniformity, round(vocabulary_repetition, 6) AS vocabulary_repetition, round(structure_repetition, 6) AS structure_repetition, round(structure_similarity, 6) AS structure_similarity, round(structure_rhythm, 6) AS structure_rhythm,
  round(100 * (sentence_amplitude + burstiness_uniformity + vocabulary_repetition + structure_repetition + structure_similarity + structure_rhythm) / 6) AS uniformity_score FROM p""")
def uniformity(spark, sf_dir):
    """Six signals of uniformity, of those measures only that they need."""
    d, lexicon = whole(spark, sf_dir), lexicons.small_lexicon(spark)
    sigs = stage(structure.signatures(d, lexicon), "signatures")
    near = repetition.repetition_words(tokens.repetition_tokens(metrics.first_window(d)), lexicon)
    parts = [rhythm.sentence_lengths(tokens.sentences(d)), repetition.rate(near, repetition.lexical_flags(near, True), "filtered_repetition_rate"), structure.structural_repetition(sigs), structure.structural_rhythm(sigs), structure.structural_diversity(sigs)]
    out = rhythm.uniformity(functools.reduce(lambda a, b: a.join(b, "doc_id", "left"), parts, d.select("doc_id")))
    return _r(out, *(c for c in out.columns if c not in ("doc_id", "uniformity_score")))


@query(f"""WITH {_DOCS}, r AS (SELECT doc_id, {_sql_words('text')} AS w, {_sql_sentences('text')} AS s FROM d)
SELECT CASE WHEN len(w) >= 1000 THEN 'long' ELSE 'short' END AS kind, count(*) AS documents, sum(len(w))::BIGINT AS words, sum(len(s))::BIGINT AS sentences FROM r GROUP BY ALL""")
def size_classes(spark, sf_dir):
    """Documents, words and sentences by class of length."""
    c = rhythm.basic_counts(docs(spark, sf_dir))
    return c.groupBy(F.when(F.col("word_count") >= 1000, "long").otherwise("short").alias("kind")).agg(F.count(F.lit(1)).alias("documents"), F.sum("word_count").alias("words"), F.sum("sentence_count").alias("sentences"))


@query(f"""WITH {_TOK}, byw AS (SELECT conv_id, role, text FROM conversations), c AS (SELECT CASE WHEN lower(role) = 'assistant' THEN 'assistant' ELSE 'human' END AS side, {_sql_words("coalesce(text, '')")} AS w FROM byw)
SELECT side, count(*) AS turns, sum(len(w))::BIGINT AS words FROM c GROUP BY side""".replace(f"WITH {_TOK}, byw", "WITH byw"))
def sides(spark, sf_dir):
    """Machine and human turns of conversations."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.when(F.lower("role") == "assistant", "assistant").otherwise("human").alias("side"), F.size(T.tokenize(F.coalesce("text", F.lit("")))).alias("n"))
    return c.groupBy("side").agg(F.count(F.lit(1)).alias("turns"), F.sum("n").alias("words"))


_COMPARED = ["avg_sentence_length", "avg_sentence_word_count", "median_sentence_length", "sentence_length_p10", "sentence_length_p90", "sentence_length_amplitude", "sentence_length_std_dev", "sentence_word_std_dev", "burstiness"]


@query(f"""WITH {_PARAGRAPHS}, ws AS (SELECT doc_id, window_index, {_sql_sentences('w')} AS s FROM pw), wx AS (SELECT doc_id, window_index, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM ws), wr AS (SELECT doc_id, window_index, pos, length(sentence) AS len, len({_sql_words('sentence')}) AS words FROM wx),
wt AS (SELECT *, abs(len - lag(len) OVER (PARTITION BY doc_id, window_index ORDER BY pos)) AS step FROM wr), wm AS (SELECT doc_id, window_index, avg(len) AS avg_sentence_length, avg(words) AS avg_sentence_word_count, quantile_cont(len, 0.5) AS median_sentence_length, quantile_cont(len, 0.1) AS sentence_length_p10, quantile_cont(len, 0.9) AS sentence_length_p90,
  quantile_cont(len, 0.9) - quantile_cont(len, 0.1) AS sentence_length_amplitude, stddev_pop(len) AS sentence_length_std_dev, stddev_pop(words) AS sentence_word_std_dev, coalesce(avg(step) / avg(len), 0) AS burstiness FROM wt GROUP BY ALL)
SELECT doc_id, count(*) AS windows, {", ".join(f"round(avg({c}), 6) AS {c}" for c in _COMPARED)}, any_value(len({_sql_words("text")})) AS word_count, any_value(len({_sql_sentences("text")})) AS sentence_count FROM wm JOIN (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM d) USING (doc_id) GROUP BY doc_id""")
def comparable_windows(spark, sf_dir):
    """Sentence measures averaged over paragraph windows of equal size, beside counts of the whole text."""
    lines = docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    whole = rhythm.basic_counts(lines).select("doc_id", "word_count", "sentence_count")
    return _r(metrics.comparable(lines, lambda d: rhythm.sentence_lengths(tokens.sentences(d)), 200, whole), *_COMPARED)


@query(f"""WITH {_CORPUS}, q AS (SELECT metric, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY metric), r AS (SELECT long.*, n < 4 OR value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM long JOIN q USING (metric)),
k AS (SELECT metric, count(*) FILTER (WHERE ok) AS k, avg(value) FILTER (WHERE ok) AS m1, stddev_pop(value) FILTER (WHERE ok) AS s1, avg(value) AS m0, stddev_pop(value) AS s0 FROM r GROUP BY metric),
ax AS (SELECT metric, m0 AS m, row_number() OVER (ORDER BY metric) - 1 AS axis FROM k WHERE CASE WHEN k < 3 THEN s0 / abs(m0) ELSE s1 / abs(m1) END * 100 >= 10)
SELECT entity, metric, axis, round(greatest(0.05, least(1.0, 0.5 + 1.25 * (value - m) / abs(m))), 6) AS radius FROM long JOIN ax USING (metric)""")
def detail_radar(spark, sf_dir):
    """Radar of the measures whose dispersion reaches ten percent."""
    long = entity_long(spark, sf_dir)
    wide = [r.metric for r in corpus.dispersion(long).where("sigma >= 10").orderBy("metric").collect()]  # one row per measure
    return _r(corpus.radar(long.where(F.col("metric").isin(wide)), [(m, False) for m in wide] or RADAR_AXES), "radius").withColumn("axis", F.col("axis").cast("long"))


@query(f"""WITH {_NEAR}, m AS (SELECT "left", substr("right", 1, 4) AS surname, count(*) AS works, avg(percentile) AS percentile FROM nr WHERE rank <= 5 GROUP BY ALL)
SELECT "left", surname, works, round(percentile, 6) AS percentile, row_number() OVER (PARTITION BY "left" ORDER BY round(percentile, 9) DESC, surname) AS place FROM m""")
def author_podium(spark, sf_dir):
    n = corpus.neighbourhood(_pairs(spark, sf_dir))
    authors = n.select(F.col("left").alias("entity")).distinct().withColumn("author", F.concat(F.lit("Anne "), F.substring("entity", 1, 4)))
    return _r(corpus.podium(n, authors), "percentile").withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {_CORPUS}, m AS (SELECT entity, string_agg('"' || metric || '":' || round(value, 6)::VARCHAR, ',' ORDER BY metric) AS m FROM long GROUP BY entity)
SELECT substr(entity, 1, 4) AS author, '{{"author":"' || substr(entity, 1, 4) || '","works":[' || string_agg('{{"title":"' || entity || '","metrics":{{' || m || '}}}}', ',' ORDER BY entity) || ']}}' AS json FROM m GROUP BY 1""")
def nested_export(spark, sf_dir):
    long = _r(entity_long(spark, sf_dir), "value")
    works = long.select("entity", F.substring("entity", 1, 4).alias("author"), F.col("entity").alias("title")).distinct()
    return reports.nested_json(long, works)


# ---- incremental and authors --------------------------------------------------------------
@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0")
def changed_documents(spark, sf_dir):
    """Documents whose digest or version differs from the recorded state (every third is recorded, the even ones of these under an old version)."""
    current = incremental.digests(docs(spark, sf_dir))
    state = current.where("doc_id % 3 = 0").select("doc_id", "sha256", F.when(F.col("doc_id") % 2 == 0, "v0").otherwise("v1").alias("version"))
    return incremental.changed(current, state, "v1").select("doc_id", "sha256")


@query("""WITH a AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'Ann ' || source ELSE source || ' Ann' END AS author, min(doc_id) AS seen FROM documents GROUP BY 1), b AS (SELECT a.author, a.seen, o.author AS turned, o.seen AS os FROM a LEFT JOIN a o ON o.author = string_split(a.author, ' ')[2] || ' ' || string_split(a.author, ' ')[1])
SELECT author, CASE WHEN os < seen THEN turned ELSE author END AS canonical FROM b""")
def canonical_authors(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Ann "), "source")).otherwise(F.concat("source", F.lit(" Ann")))
    return corpus.canonical_authors(d.select(name.alias("author"), F.col("doc_id").alias("seen")))


@query("""WITH h AS (SELECT floor(doc_id / 65536) AS r, doc_id, sha256(coalesce(text, '')) AS s FROM documents), g AS (SELECT r, sha256(string_agg(coalesce(doc_id::VARCHAR, '') || chr(0) || s || chr(0), '' ORDER BY doc_id NULLS FIRST, s)) AS g FROM h GROUP BY r) SELECT sha256(string_agg(g, '' ORDER BY r NULLS FIRST)) AS fingerprint FROM g""")
def corpus_fingerprint(spark, sf_dir):
    return incremental.fingerprint(docs(spark, sf_dir))


# ---- metadata, orders and updates: tables derived from the documents -------------------------
_BOOKS = """bk AS (SELECT doc_id, source || '_nr-' || doc_id || '.md' AS file, CASE doc_id % 5 WHEN 0 THEN '19' || lpad((doc_id % 90 + 10)::VARCHAR, 2, '0') || '-03-01' WHEN 1 THEN '2999' WHEN 2 THEN 'n.d.' WHEN 3 THEN '' END AS date,
  CASE WHEN doc_id % 2 = 0 THEN 'Tous droits réservés, Éditions X, ' || (1400 + doc_id % 700) || ' et ' || (1900 + doc_id % 90) || '. 10 % et 5 %.' ELSE 'sans date 1950' END AS note, CASE WHEN doc_id % 7 = 0 THEN 'IA' ELSE source END AS author, left(coalesce(text, ''), 40) AS title FROM documents)"""


def _books(spark, sf_dir) -> DataFrame:
    """doc_id, file, date, note, author, title: what a library would tell of each document."""
    d, k = spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("doc_id")
    date = F.when(k % 5 == 0, F.concat(F.lit("19"), F.lpad((k % 90 + 10).cast("string"), 2, "0"), F.lit("-03-01"))).when(k % 5 == 1, "2999").when(k % 5 == 2, "n.d.").when(k % 5 == 3, "")
    said = F.concat(F.lit("Tous droits réservés, Éditions X, "), (1400 + k % 700).cast("string"), F.lit(" et "), (1900 + k % 90).cast("string"), F.lit(". 10 % et 5 %."))
    return d.select("doc_id", F.concat("source", F.lit("_nr-"), k.cast("string"), F.lit(".md")).alias("file"), date.alias("date"), F.when(k % 2 == 0, said).otherwise("sans date 1950").alias("note"), F.when(k % 7 == 0, "IA").otherwise(F.col("source")).alias("author"), F.substr(F.coalesce("text", F.lit("")), F.lit(1), F.lit(40)).alias("title"))


_YEAR = r"CASE WHEN TRY_CAST(left(date, 4) AS INT) BETWEEN 1500 AND 2100 THEN TRY_CAST(left(date, 4) AS INT) ELSE TRY_CAST(nullif(regexp_extract(note, '(?is)(?:©|copyright|droits réservés).{0,180}?\b((?:1[5-9]|20)\d\d)\b', 1), '') AS INT) END"


@query(f"WITH {_BOOKS} SELECT doc_id, coalesce(({_YEAR})::VARCHAR, '') AS year FROM bk")
def publication_years(spark, sf_dir):
    """From the date, else from the text beside a copyright sign."""
    return _books(spark, sf_dir).select("doc_id", F.coalesce(T.publication_year(F.col("date"), F.col("note")).cast("string"), F.lit("")).alias("year"))


@query(f"WITH {_BOOKS} SELECT doc_id, replace(note, ' %', chr(160) || '%') AS note FROM bk")
def percent_typography(spark, sf_dir):
    return _books(spark, sf_dir).select("doc_id", T.percent_typography(F.col("note")).alias("note"))


_FOLD = "replace(replace(translate(lower({0}), 'àâäáãéèêëíîïìóôöòõúùûüçñÿ', 'aaaaaeeeeiiiiooooouuuucny'), 'œ', 'oe'), 'æ', 'ae')"


@query(f"""WITH {_BOOKS}, n AS (SELECT *, trim(regexp_replace(regexp_replace(file, '\\.[A-Za-z0-9]+$', ''), '[_-]+', ' ', 'g')) AS s FROM bk), m AS (SELECT *, regexp_replace(s, '(\\p{{L}})(\\d)', '\\1 \\2', 'g') AS s2 FROM n)
SELECT doc_id, upper(left(s2, 1)) || substr(s2, 2) AS name, trim(regexp_replace({_FOLD.format('title')}, '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM m""")
def display_names(spark, sf_dir):
    """Names shown for files, and slugs of titles."""
    return _books(spark, sf_dir).select("doc_id", T.display_name(F.col("file")).alias("name"), T.slug(F.col("title")).alias("slug"))


@query(f"""WITH {_BOOKS}, o AS (SELECT file, '18' || lpad((doc_id % 100)::VARCHAR, 2, '0') AS o_date, CASE WHEN doc_id % 6 = 0 THEN 'Titre ' || doc_id END AS o_title FROM bk WHERE doc_id % 3 = 0), y AS (SELECT {_FOLD.format("'Éd ' || author")} AS ak, {_FOLD.format('title')} AS tk, min(1700 + doc_id % 50)::INT AS y FROM bk GROUP BY ALL)
SELECT bk.file, coalesce(o_title, nullif(title, '')) AS title, coalesce(TRY_CAST(left(o_date, 4) AS INT), {_YEAR}, y) AS year FROM bk LEFT JOIN o USING (file) LEFT JOIN y ON ak = {_FOLD.format("'Éd ' || author")} AND tk = {_FOLD.format('coalesce(o_title, title)')} WHERE title <> ''""")
def metadata_precedence(spark, sf_dir):
    """Titles and years: overrides go before a book's own date, that before its text, that before looked-up years."""
    b = _books(spark, sf_dir).withColumn("author", F.concat(F.lit("Éd "), "author"))
    k = F.col("doc_id")
    o = b.where(k % 3 == 0).select(F.col("file").alias("file_key"), F.concat(F.lit("18"), F.lpad((k % 100).cast("string"), 2, "0")).alias("date"), F.when(k % 6 == 0, F.concat(F.lit("Titre "), k.cast("string"))).alias("title"))
    y = b.select(T.ascii_fold(F.col("author")).alias("author_key"), T.ascii_fold(F.col("title")).alias("title_key"), (1700 + k % 50).cast("string").alias("year"))
    rows = files.with_metadata(b.where("title <> ''").select(F.col("file").alias("file_key"), "title", "author", F.col("date").alias("publication_date"), F.col("note").alias("text")), o, y)
    return rows.select(F.col("file_key").alias("file"), "title", "year")


@query(f"""WITH {_BOOKS}, w AS (SELECT author, CASE WHEN author = 'IA' THEN 'IA — ' || author ELSE author END AS name FROM bk GROUP BY author) SELECT author, name, row_number() OVER (ORDER BY author <> 'IA', lower(name), author) AS n FROM w""")
def machine_first(spark, sf_dir):
    """Authors as comparisons order them: machines first, then by name."""
    works = _books(spark, sf_dir).select("author").distinct().select(F.col("author").alias("entity"), F.col("author").alias("title"), "author")
    return reports.in_order(works).select("author", reports.shown_name(F.col("title"), F.col("author")).alias("name"), F.col("n").cast("long").alias("n"))


@query(f"""WITH {_BOOKS}, r AS (SELECT file, lower(trim(author)) AS a, coalesce(regexp_extract(date, '^(\\d{{4}})', 1), '') AS y FROM bk), s AS (SELECT *, row_number() OVER w AS n, lag(a) OVER w AS p FROM r WINDOW w AS (ORDER BY a, CASE WHEN y = '' THEN '9999' ELSE y END, lower(file), file))
SELECT n, CASE WHEN p <> a THEN chr(10) ELSE '' END || file || ': {{date: "' || y || '"}}' AS line FROM s""")
def registry_order(spark, sf_dir):
    """The publication registry's lines, for books that have no entry yet."""
    b = _books(spark, sf_dir).select(F.col("file").alias("file_key"), "author", F.col("date").alias("publication_date"))
    none = b.limit(0).select("file_key", F.lit("").alias("date"), F.lit("").alias("title"))
    return files.registry_lines(none, b).withColumn("n", F.col("n").cast("long"))


@query(f"""WITH {_SCALED}, {_BOOKS}, dt AS (SELECT source AS entity, max(date) AS date FROM bk JOIN documents USING (doc_id) WHERE doc_id % 5 = 0 GROUP BY source) SELECT entity, strftime(date::DATE, '%Y-%m-%d') AS published, metric, round(scaled, 6) AS scaled FROM sc JOIN dt USING (entity)""")
def evolution(spark, sf_dir):
    """Scaled measures of dated works."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    works = _books(spark, sf_dir).where("doc_id % 5 = 0").join(d, "doc_id").groupBy(F.col("source").alias("entity")).agg(F.max("date").alias("publication_date"))
    out = reports.evolution(corpus.scaled(entity_long(spark, sf_dir)), works)
    return _r(out.withColumn("published", F.date_format("published", "yyyy-MM-dd")), "scaled")


@query(f"""WITH {_DOCS}, w AS (SELECT doc_id, count(*) AS c FROM d GROUP BY doc_id), v AS (SELECT doc_id, (doc_id % 10) / 10.0 AS s, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 0.25 END AS r, 0.5 AS u, (doc_id % 3) / 4.0 AS nr, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE 0.5 END AS vr FROM w)
SELECT doc_id, round(1 - s, 6) AS stylistic_repetition_rate, round(coalesce(r, 0) + u, 6) AS relative_clause_ratio, round(CASE WHEN vr <> 0 THEN nr / vr ELSE 0 END, 6) AS noun_verb_ratio FROM v""")
def web_view(spark, sf_dir):
    """The view that the explorer compares, over made-up measures of every document."""
    k = F.col("doc_id")
    wide = docs(spark, sf_dir).select("doc_id", ((k % 10) / 10.0).alias("stylistic_repetition_rate"), F.when(k % 4 != 0, 0.25).alias("relative_clause_ratio"), F.lit(0.5).alias("subordinate_clause_ratio"), ((k % 3) / 4.0).alias("noun_ratio"), F.when(k % 6 == 0, 0.0).otherwise(0.5).alias("verb_ratio"), F.lit(None).cast("double").alias("noun_verb_ratio"))
    names = ["stylistic_repetition_rate", "relative_clause_ratio", "noun_verb_ratio"]
    return _r(corpus.web_view(wide).select("doc_id", *names), *names)


@query(f"WITH {_FOLDED}, u AS (SELECT doc_id, unnest(range(len(w))) AS window_index, unnest(w) AS w FROM g) SELECT doc_id AS book_id, min(window_index) AS window_index, arg_min(length(w.f), window_index) AS chars FROM u GROUP BY doc_id")
def first_analysis(spark, sf_dir):
    """The first analysed window of every document."""
    w = docs(spark, sf_dir).select(F.col("doc_id").alias("book_id"), F.posexplode(T.char_windows(F.col("text"), 3000)).alias("window_index", "w"))
    rows = w.select("book_id", F.col("window_index").cast("long").alias("window_index"), F.length("w.fragment").cast("long").alias("chars"))
    return files.first_windows(rows)


@query("""WITH o AS (SELECT doc_id, 1.0::DOUBLE AS m FROM documents WHERE doc_id % 2 = 0), f AS (SELECT doc_id, 2.0::DOUBLE AS m FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0), c AS (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id, m FROM o WHERE doc_id NOT IN (SELECT doc_id FROM f) AND doc_id IN (SELECT doc_id FROM c) UNION ALL SELECT doc_id, m FROM f""")
def merged_analyses(spark, sf_dir):
    """Analyses after an update: fresh ones replace old ones, those of vanished documents (every fifth) go."""
    ids = docs(spark, sf_dir).select("doc_id")
    old, fresh = ids.where("doc_id % 2 = 0").withColumn("m", F.lit(1.0)), ids.where("doc_id % 3 = 0 and doc_id % 5 <> 0").withColumn("m", F.lit(2.0))
    return incremental.merged(old, fresh, ids.where("doc_id % 5 <> 0"))


@query("""WITH c AS (SELECT doc_id AS line, CASE WHEN doc_id % 4 = 0 THEN 'Lemme' || doc_id ELSE ' ' END AS lemma, CASE WHEN doc_id % 4 = 0 THEN 'nom' END AS category, ' Forme' || (doc_id % 60) || ' ' AS form FROM documents),
f AS (SELECT line, lower(last_value(nullif(trim(lemma), '') IGNORE NULLS) OVER w) AS lemma, last_value(category IGNORE NULLS) OVER w AS category, lower(trim(form)) AS form FROM c WINDOW w AS (ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT form, arg_min(lemma, line) AS lemma, arg_min(category, line) AS category FROM f WHERE lemma IS NOT NULL GROUP BY form""")
def lexicon_fill_down(spark, sf_dir):
    """A lexicon whose lemma stands only on the first of its lines."""
    k = F.col("doc_id")
    rows = docs(spark, sf_dir).select(k.alias("line"), F.when(k % 4 == 0, F.concat(F.lit("Lemme"), k.cast("string"))).otherwise(" ").alias("lemma"), F.when(k % 4 == 0, "nom").alias("category"), F.concat(F.lit(" Forme"), (k % 60).cast("string"), F.lit(" ")).alias("form"))
    return lexicons.fill_down(rows)


@query(f"WITH {_TOK}, t AS (SELECT doc_id, count(*) AS n, count(DISTINCT word) AS k FROM tok GROUP BY doc_id) SELECT doc_id, round(1 - k / n, 6) AS generic_repetition FROM t")
def generic_repetition(spark, sf_dir):
    """One less the type-token ratio."""
    t = lexical.type_token(tokens.tokens(whole(spark, sf_dir)))
    return _r(t.select("doc_id", (1 - F.col("type_token_ratio")).alias("generic_repetition")), "generic_repetition")


@query(f"""WITH {_RADAR}, p AS (SELECT entity, radius * coalesce(lead(radius) OVER (PARTITION BY entity ORDER BY axis), first_value(radius) OVER (PARTITION BY entity ORDER BY axis ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS p FROM rad),
ars AS (SELECT entity, abs(sum(p)) * sin(2 * pi() / count(*)) / 2 AS area FROM p GROUP BY entity) SELECT entity, round(area, 6) AS area, row_number() OVER (ORDER BY round(area, 9), entity) AS place FROM ars""")
def areas_ascending(spark, sf_dir):
    """Sources by radar area, the smallest first."""
    area = corpus.polygon_area(corpus.radar(entity_long(spark, sf_dir), RADAR_AXES))
    return _r(corpus.ascending(area, "area"), "area").withColumn("place", F.col("place").cast("long"))


@query(f"WITH {_CORPUS}, {_values('reg', 'metric, metric_id', list(config.METRIC_IDS.items()))} SELECT entity, metric, metric_id, round(value, 6) AS value, 'Note ' || metric_id AS note FROM long LEFT JOIN reg USING (metric)")
def measures_with_notes(spark, sf_dir):
    """Measures with their public ids and notes."""
    registry = metrics.registry(spark)
    notes = registry.select(F.col("metric_id").alias("note_id"), F.concat(F.lit("Note "), F.col("metric_id").cast("string")).alias("note"))
    return _r(metrics.with_notes(entity_long(spark, sf_dir), registry, notes), "value").withColumn("metric_id", F.col("metric_id").cast("long"))


@query(f"""WITH {_RKNOWN}, {_FAM}, keys AS (SELECT doc_id, pos, 'L:' || lemma AS key FROM kw WHERE NOT fn UNION ALL SELECT DISTINCT doc_id, pos, 'F:' || family FROM kw JOIN fam ON lemma = lexeme WHERE NOT fn),
hit AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, pos, pos - lag(pos) OVER w AS back, lead(pos) OVER w - pos AS ahead FROM keys WINDOW w AS (PARTITION BY doc_id, key ORDER BY pos)) WHERE back <= 300 OR ahead <= 300),
sh AS (SELECT kw.doc_id, list(CASE WHEN hit.pos IS NOT NULL THEN '**' || lemma || '**' ELSE lemma END ORDER BY kw.pos) AS l FROM kw LEFT JOIN hit ON kw.doc_id = hit.doc_id AND kw.pos = hit.pos GROUP BY kw.doc_id),
gp AS (SELECT doc_id, string_split_regex(text, '{_W}{{2,}}') AS g FROM d) SELECT doc_id, sha256(array_to_string(list_transform(g, lambda x, i: x || coalesce(l[i], '')), '')) AS report_sha256 FROM gp LEFT JOIN sh USING (doc_id)""")
def lemma_reports(spark, sf_dir):
    """Each text with its words as lemmas, repeated ones in bold."""
    notes = repetition.annotations(_rwords(spark, sf_dir), lexicons.small_families(spark))
    return reports.lemma_report(whole(spark, sf_dir), notes).select("doc_id", F.sha2("report", 256).alias("report_sha256"))


@query(f"""WITH {_BOOKS} SELECT doc_id, coalesce(replace(nullif(regexp_extract(translate(note || doc_id || ',5', ' ' || chr(160), ''), '-?\\d+(?:[.,]\\d+)?'), ''), ',', '.')::DOUBLE, -1) AS value FROM bk""")
def numbers_in_texts(spark, sf_dir):
    """The first number of a note."""
    b = _books(spark, sf_dir)
    return b.select("doc_id", F.coalesce(T.number_in(F.concat("note", F.col("doc_id").cast("string"), F.lit(",5"))), F.lit(-1.0)).alias("value"))
