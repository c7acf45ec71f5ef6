"""Row tables that the measures share: tokens, sentences, and words joined to a lexicon."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T


def items(docs: DataFrame, array: Column, name: str) -> DataFrame:
    """doc_id, n (items of the document), pos (from 0), item. Measures take ids that are not null and do not repeat; `keyed` gives such to any table."""
    held = docs.select("doc_id", array.alias("a")).select("doc_id", F.size("a").alias("n"), "a")
    return numbered(held, F.col("a"), "pos", name, "doc_id", "n")


def numbered(rows: DataFrame, array: Column, pos: str, name: str, *keep: str) -> DataFrame:
    """The columns to keep, pos (from 0), item. The array is computed once a row: a plain posexplode is filtered by its size first, which computes it again."""
    held = rows.select(*keep, array.alias("_items"))
    return held.select(*keep, F.posexplode_outer("_items").alias(pos, name)).where(F.col(pos).isNotNull())


def tokens(docs: DataFrame) -> DataFrame:
    return _words(docs, T.WORD)


def repetition_tokens(docs: DataFrame) -> DataFrame:
    return _words(docs, T.LONG_WORD)


def _words(docs: DataFrame, pattern: str) -> DataFrame:
    """What T.tokenize and T.repetition_tokens give, lower-cased once they are rows: functions over arrays are interpreted."""
    return items(docs, F.regexp_extract_all("text", F.lit(pattern), 0), "word").withColumn("word", T.lowered(F.col("word")))


def sentences(docs: DataFrame) -> DataFrame:
    return items(docs, T.split_sentences(F.col("text")), "sentence")


@dataclass(frozen=True)
class FunctionWords:
    """What counts as a function word: words, categories and lemmas; kept words never do."""

    words: tuple[str, ...] = config.FUNCTION_WORDS
    categories: tuple[str, ...] = config.FUNCTION_CATEGORIES
    lemmas: tuple[str, ...] = config.FUNCTION_LEMMAS
    kept: tuple[str, ...] = ()

    @staticmethod
    def of(table: DataFrame) -> FunctionWords:
        """From kind (mot, catégorie, lemme, garder) and value: a configuration file's rows, which the driver holds."""
        held: dict[str, list[str]] = {"mot": [], "catégorie": [], "lemme": [], "garder": []}
        for kind, value in table.select("kind", "value").distinct().orderBy("kind", "value").collect():
            held[kind].append(value)
        return FunctionWords(*(tuple(held[k]) for k in ("mot", "catégorie", "lemme", "garder")))


DEFAULT = FunctionWords()


def is_function_word(word: Column, category: Column, lemma: Column | None = None, rules: FunctionWords = DEFAULT) -> Column:
    """Categories, listed words and one-letter words; the lemma counts where it is given."""
    out = word.isin(*rules.words) | F.lower(category).isin(*rules.categories) | (F.length(word) <= 1)
    if lemma is not None:
        out = out | lemma.isin(*rules.words, *rules.lemmas)
    return out & ~word.isin(*rules.kept) if rules.kept else out


def with_lexicon(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """words with lemma (the word itself where unknown), category ('' where unknown) and known.

    lexicon: form, lemma, category. The planner broadcasts it while its size
    allows and shuffles by word beyond that.
    """
    joined = words.join(lexicon.select(F.col("form").alias("word"), F.col("lemma").alias("l"), F.col("category").alias("c")), "word", "left")
    return joined.withColumn("known", F.col("l").isNotNull()).withColumn("lemma", F.coalesce("l", "word")).withColumn("category", F.lower(F.coalesce("c", F.lit("")))).drop("l", "c")


def keyed(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """docs with doc_id replaced by a digest of its row (as text), one row for each: for tables whose ids are null or repeat. `id` keeps the old one, `copies` counts rows that are equal."""
    key = F.sha2(F.to_json(F.struct(*columns)), 256)
    return docs.groupBy(key.alias("key"), *columns).agg(F.count(F.lit(1)).alias("copies")).select(F.col("key").alias("doc_id"), F.col(columns[0]).alias("id"), *columns[1:], "copies")
