"""Lexical richness, ratios and n-gram repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from .tokens import DEFAULT, FunctionWords, is_function_word, numbered


def moving_ttr(rows: DataFrame, item: str, window: int, name: str) -> DataFrame:
    """Mean share of distinct items over all frames of `window` consecutive items.

    Each item counts for the frames in which it is the first of its kind, so one
    lag replaces the frames: linear in the number of items. rows: doc_id, n, pos, item.
    """
    counted = rows.withColumn("before", before(item))
    return counted.groupBy("doc_id").agg(mean_share(window).alias(name))


def before(item: str) -> Column:
    """The position of the last equal item, -1 for the first of its kind."""
    return F.coalesce(F.lag("pos").over(Window.partitionBy("doc_id", item).orderBy("pos")), F.lit(-1))


def mean_share(window: int) -> Column:
    """Aggregate of n, pos and before: moving_ttr of a document."""
    w = F.least(F.col("n"), F.lit(window))
    first = F.least(F.col("pos"), F.col("n") - w) - F.greatest(F.col("before") + 1, F.col("pos") - w + 1, F.lit(0)) + 1
    size = F.least(F.max("n"), F.lit(window))
    return F.sum(F.greatest(F.lit(0), first).cast("long")) / (F.max("n") - size + 1) / size


def word_measures(known: DataFrame, moving: dict[str, int], rules: FunctionWords = DEFAULT) -> DataFrame:
    """What type_token, moving_ttr (name -> window) and pos_ratios tell of words with a lexicon's columns, and their syllables, in one pass."""
    rows, new = known.withColumn("before", before("word")), F.col("before") == -1
    n = F.count(F.lit(1))
    out = rows.groupBy("doc_id").agg(
        n.alias("word_count"), F.count_if(new).alias("unique_word_count"), (F.count_if(new) / n).alias("type_token_ratio"), (F.sum(F.length("word")) / n).alias("avg_word_length"),
        *(mean_share(window).alias(name) for name, window in moving.items()), *_pos_shares(rules), F.sum(T.syllables(F.col("word"))).alias("syllables"),
    )
    return _noun_verb(out)


def content_measures(content: DataFrame, name: str, window: int) -> DataFrame:
    """What lemma_richness and moving_ttr over lemmas (name) tell, in one pass."""
    after = F.lead("pos").over(Window.partitionBy("doc_id", "lemma").orderBy("pos"))
    rows, new, n = content.withColumns({"before": before("lemma"), "after": after}), F.col("before") == -1, F.count(F.lit(1))
    return rows.groupBy("doc_id").agg(
        n.alias("lexical_word_count"), F.count_if(new).alias("unique_lemma_count"), (F.count_if(new) / n).alias("global_lemma_richness"), (F.sum(F.col("known").cast("long")) / n).alias("lexicon_coverage"),
        (F.count_if(new & F.col("after").isNull()) / F.count_if(new)).alias("hapax_ratio"), mean_share(window).alias(name),
    )


def type_token(rows: DataFrame) -> DataFrame:
    """word_count, unique_word_count, type_token_ratio, avg_word_length: two-level aggregation."""
    by_word = rows.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("c"))
    return by_word.groupBy("doc_id").agg(
        F.sum("c").alias("word_count"), F.count(F.lit(1)).alias("unique_word_count"), (F.count(F.lit(1)) / F.sum("c")).alias("type_token_ratio"), (F.sum(F.col("c") * F.length("word")) / F.sum("c")).alias("avg_word_length")
    )


def trigrams(rows: DataFrame, item: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("pos")
    out = rows.select("doc_id", "n", "pos", F.col(item).alias("a"), F.lead(item, 1).over(order).alias("b"), F.lead(item, 2).over(order).alias("c"))
    return out.where("pos <= n - 3")


def trigram_repetition(rows: DataFrame, item: str, name: str = "trigram_repetition") -> DataFrame:
    """Share of distinct trigrams that occur more than once."""
    grams = trigrams(rows, item).groupBy("doc_id", "a", "b", "c").agg(F.count(F.lit(1)).alias("k"))
    return grams.groupBy("doc_id").agg(F.avg((F.col("k") > 1).cast("double")).alias(name))


def moving_trigram_repetition(rows: DataFrame, item: str, window: int = config.TRIGRAM_WINDOW, step: int = config.TRIGRAM_STEP, name: str = "moving_trigram_repetition") -> DataFrame:
    return trigram_measures(rows, item, window, step, name).drop("trigram_repetition")


def trigram_measures(rows: DataFrame, item: str, window: int = config.TRIGRAM_WINDOW, step: int = config.TRIGRAM_STEP, name: str = "moving_trigram_repetition") -> DataFrame:
    """Mean trigram repetition over frames, and over the whole; the last frame ends at the last item.

    A trigram counts for the frames in which it is the first of its kind, as one that occurs
    again where its next occurrence is in the frame, too.
    """
    size = F.least(F.col("n"), F.lit(window))
    alike = Window.partitionBy("doc_id", "a", "b", "c").orderBy("pos")
    rows = trigrams(rows, item).select("doc_id", "n", "pos", F.coalesce(F.lag("pos").over(alike), F.lit(-1)).alias("before"), F.lead("pos").over(alike).alias("after"))
    first = T.frames_between(F.col("n"), window, step, F.greatest(F.col("pos") - size + 3, F.col("before") + 1), F.col("pos"))
    whole = F.lit(-1)  # stands for a frame of the whole document
    first = F.concat(first, F.when(F.col("before") == -1, F.array(whole)).otherwise(F.array().cast("array<int>")))
    framed = numbered(rows, first, "frame", "start", "doc_id", "n", "after")
    again = F.coalesce((F.col("start") == whole) & F.col("after").isNotNull() | (F.col("after") <= F.col("start") + size - 3), F.lit(False))
    frames = framed.groupBy("doc_id", "start").agg(F.avg(again.cast("double")).alias("r"))
    return frames.groupBy("doc_id").agg(F.avg(F.when(F.col("start") != whole, F.col("r"))).alias(name), F.max(F.when(F.col("start") == whole, F.col("r"))).alias("trigram_repetition"))


def pos_ratios(known: DataFrame, rules: FunctionWords = DEFAULT) -> DataFrame:
    """Shares of noun, verb, adjective and adverb forms among words that the lexicon knows; function words among all."""
    return _noun_verb(known.groupBy("doc_id").agg(*_pos_shares(rules)))


def _pos_shares(rules: FunctionWords) -> list[Column]:
    share = lambda p: F.coalesce(F.avg(F.when(F.col("known"), F.startswith(F.col("category"), F.lit(p)).cast("double"))), F.lit(0.0))
    function = F.avg(is_function_word(F.col("word"), F.col("category"), rules=rules).cast("double")).alias("function_word_ratio")
    return [share("nom").alias("noun_ratio"), share("verbe").alias("verb_ratio"), share("adjectif").alias("adjective_ratio"), share("adverbe").alias("adverb_ratio"), function]


def _noun_verb(shares: DataFrame) -> DataFrame:
    return shares.withColumn("noun_verb_ratio", F.when(F.col("verb_ratio") > 0, F.col("noun_ratio") / F.col("verb_ratio")).otherwise(0.0))


def content_words(known: DataFrame, rules: FunctionWords = DEFAULT) -> DataFrame:
    """Words that are no function words, renumbered: doc_id, n, pos, word, lemma, known."""
    kept = known.where(~is_function_word(F.col("word"), F.col("category"), rules=rules))
    own = Window.partitionBy("doc_id")
    return kept.select("doc_id", "word", "lemma", "known", (F.row_number().over(own.orderBy("pos")) - 1).alias("pos"), F.count(F.lit(1)).over(own).cast("int").alias("n"))


def lemma_richness(content: DataFrame) -> DataFrame:
    """lexical_word_count, unique_lemma_count, global_lemma_richness, lexicon_coverage, hapax_ratio."""
    by = content.groupBy("doc_id", "lemma").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("known").cast("long")).alias("k"))
    return by.groupBy("doc_id").agg(
        F.sum("c").alias("lexical_word_count"), F.count(F.lit(1)).alias("unique_lemma_count"), (F.count(F.lit(1)) / F.sum("c")).alias("global_lemma_richness"),
        (F.sum("k") / F.sum("c")).alias("lexicon_coverage"), F.avg((F.col("c") == 1).cast("double")).alias("hapax_ratio"),
    )


def richness_distribution(content: DataFrame, window: int, step: int | None = None) -> DataFrame:
    """Share of distinct lemmas by frame: count, mean, median, p10, p90 (documents shorter than a frame have no row)."""
    step = step or max(1, window // 4)
    before = F.coalesce(F.lag("pos").over(Window.partitionBy("doc_id", "lemma").orderBy("pos")), F.lit(-1))
    rows = content.where(F.col("n") >= window).withColumn("before", before)
    first = T.frames_between(F.col("n"), window, step, F.greatest(F.col("pos") - window + 1, F.col("before") + 1), F.col("pos"))
    frames = numbered(rows, first, "frame", "start", "doc_id").groupBy("doc_id", "start").agg((F.count(F.lit(1)) / window).alias("v"))
    return frames.groupBy("doc_id").agg(F.count(F.lit(1)).alias("frames"), F.avg("v").alias("mean"), *(F.percentile("v", F.lit(q)).alias(n) for n, q in (("median", 0.5), ("p10", 0.1), ("p90", 0.9))))
