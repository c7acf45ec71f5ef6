"""Lexicons as input tables: inflected forms, families and pronunciations, and their readers."""

from __future__ import annotations

import io
import unicodedata
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..store import small, stage


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """NFC, which no built-in gives; on lexicons only."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normal_form(c: Column) -> Column:
    """Trimmed, composed, lower-cased."""
    return F.lower(composed(F.trim(c)))


def fill_down(rows: DataFrame) -> DataFrame:
    """rows: line, lemma, category, form (lemma and category blank where they repeat). First (form) wins.

    One lexicon file is one ordered list, so the fill runs over a single window;
    its size is the lexicon's, not the corpus's.
    """
    order = Window.partitionBy(F.lit(1)).orderBy("line")
    has = F.trim(F.coalesce("lemma", F.lit(""))) != ""
    filled = rows.select(
        "line", F.last(F.when(has, normal_form(F.col("lemma"))), ignorenulls=True).over(order).alias("lemma"), F.last(F.when(has, F.trim("category")), ignorenulls=True).over(order).alias("category"), normal_form(F.col("form")).alias("form")
    ).where("lemma is not null and form <> ''")
    rank = F.row_number().over(Window.partitionBy("form").orderBy("line"))
    return filled.withColumn("r", rank).where("r = 1").select("form", "lemma", "category")


def _forms(lines: DataFrame) -> DataFrame:
    """lines: line, value. The data begin after the row with GRAPHIE in the 1st and 10th column."""
    cells = lines.select("line", F.split(F.regexp_replace("value", "^\ufeff", ""), ";", -1).alias("c"))
    start = cells.where((F.get("c", 0) == "GRAPHIE") & (F.get("c", 9) == "GRAPHIE")).agg(F.min("line").alias("s"))
    data = cells.join(F.broadcast(start), F.col("line") > F.col("s")).where(F.size("c") > 9)  # start has one row
    return fill_down(data.select("line", F.get("c", 0).alias("lemma"), F.get("c", 2).alias("category"), F.get("c", 9).alias("form")))


def read_forms(spark: SparkSession, path: str) -> DataFrame:
    """form, lemma, category of a `;` table."""
    return _forms(spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value"))


def read_zipped_forms(spark: SparkSession, path: str, member: str) -> DataFrame:
    """The same of one member of a zip archive, which one task unpacks line by line."""

    def unpack(batches):
        for batch in batches:
            for (content,) in zip(batch["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive, io.TextIOWrapper(archive.open(member), "utf-8-sig") as text:
                    held: list[str] = []
                    done = 0
                    for line in text:
                        held.append(line.rstrip("\r\n"))
                        if len(held) == 50_000:
                            yield pd.DataFrame({"line": range(done, done + len(held)), "value": held})
                            done, held = done + len(held), []
                    yield pd.DataFrame({"line": range(done, done + len(held)), "value": held})

    return _forms(spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "line long, value string"))


def tagged(value: Column) -> Column:
    """map tag -> values of `tag:a|b;tag:c`, equal tags joined."""
    parts = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ";"), lambda s: F.struct(F.substring_index(s, ":", 1).alias("k"), F.filter(F.split(F.substr(s, F.instr(s, ":") + 1), r"\|"), lambda v: v != "").alias("v"), F.contains(s, F.lit(":")).alias("ok"))), lambda p: p["ok"])
    keys = F.array_distinct(F.transform(parts, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.flatten(F.transform(F.filter(parts, lambda p: p["k"] == k), lambda p: p["v"])))))


def families(lexemes: DataFrame) -> DataFrame:
    """lexeme, family. lexemes: graphie, fid, para_orth, para_phon."""
    return lexemes.select(normal_form(F.col("graphie")).alias("lexeme"), F.trim("fid").alias("family")).where("lexeme <> '' and family <> ''").distinct()


def pronunciations(lexemes: DataFrame) -> DataFrame:
    """form, phonetic: written and spoken forms of equal tags, in parallel."""
    held = lexemes.select(tagged(F.col("para_orth")).alias("o"), tagged(F.col("para_phon")).alias("p"))
    both = held.select(F.explode(F.array_intersect(F.map_keys("o"), F.map_keys("p"))).alias("k"), "o", "p")
    zipped = both.select(F.explode(F.zip_with(F.element_at("o", F.col("k")), F.element_at("p", F.col("k")), lambda a, b: F.struct(a.alias("f"), b.alias("s")))).alias("z"))
    return zipped.where("z.f is not null and z.s is not null").select(normal_form(F.col("z.f")).alias("form"), F.col("z.s").alias("phonetic")).distinct()


def read_lexemes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)


#: Guessed lemmas up to which they are sent to every task.
GUESSES = 100_000


def contextual_lemmas(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id, form, lemma: context first. words: doc_id, pos, word, lemma (suggested), category.

    A stored lemma of the context's category, else a suggestion that differs
    from the form, else the closest lemma among forms that share the longest
    prefix (three letters at least), else what is stored, suggested or the form.
    The last context of a form counts for all of it. What is guessed does not depend on the
    document, so guesses are found first and written; at most GUESSES of them are broadcast.
    """
    stored = lexicon.select(F.col("form").alias("word"), F.col("lemma").alias("s_lemma"), F.lower("category").alias("s_category"))
    rows = words.withColumn("category", F.lower("category")).join(stored, "word", "left")
    direct = F.when(F.startswith("s_category", F.col("category")), F.col("s_lemma")).when(F.coalesce(F.nullif("lemma", F.lit("")), "word") != F.col("word"), F.col("lemma"))
    rows = rows.withColumn("direct", direct)
    open_ = rows.where("direct is null").select("word", "category").distinct()
    cut = lambda c, top: F.explode(F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), top)), lambda n: F.substr(c, F.lit(1), n)))
    asked = open_.where(F.length("word") > 3).withColumn("prefix", cut(F.col("word"), F.length("word") - 1))
    known = lexicon.where(F.length("form") >= 3).select(F.lower("category").alias("k"), F.col("lemma").alias("k_lemma"), cut(F.col("form"), F.length("form")).alias("prefix")).distinct()
    near = asked.join(known, "prefix").where(F.startswith("k", F.col("category")))
    best = F.row_number().over(Window.partitionBy("word", "category").orderBy(F.desc(F.length("prefix")), F.levenshtein("word", "k_lemma"), F.length("k_lemma"), "k_lemma"))
    guessed = small(stage(near.withColumn("r", best).where("r = 1").select("word", "category", F.col("k_lemma").alias("guess")), "guesses"), GUESSES)
    done = rows.join(guessed, ["word", "category"], "left").withColumn("out", F.coalesce("direct", "guess", "s_lemma", F.nullif("lemma", F.lit("")), "word"))
    return done.groupBy("doc_id", F.col("word").alias("form")).agg(F.max_by("out", "pos").alias("lemma"))


# --- fixed values: a small French lexicon for tests and demonstrations ----------
FORMS = (
    ("le", "le", "déterminant"), ("la", "le", "déterminant"), ("les", "le", "déterminant"), ("un", "un", "déterminant"), ("une", "un", "déterminant"), ("des", "un", "déterminant"),
    ("de", "de", "préposition"), ("du", "de", "préposition"), ("en", "en", "préposition"), ("par", "par", "préposition"), ("pour", "pour", "préposition"), ("sur", "sur", "préposition"), ("dans", "dans", "préposition"),
    ("et", "et", "conjonction"), ("que", "que", "conjonction"), ("ou", "ou", "conjonction"), ("mais", "mais", "conjonction"),
    ("il", "il", "pronom"), ("elle", "elle", "pronom"), ("se", "se", "pronom"), ("qui", "qui", "pronom"), ("je", "je", "pronom"), ("tu", "tu", "pronom"),
    ("est", "être", "verbe"), ("a", "avoir", "verbe"), ("être", "être", "verbe"), ("avoir", "avoir", "verbe"),
    ("eau", "eau", "nom commun"), ("eaux", "eau", "nom commun"), ("tion", "tion", "nom commun"), ("ment", "mentir", "verbe"), ("mente", "mentir", "verbe"), ("eux", "eux", "pronom"),
    ("an", "an", "nom commun"), ("pa", "pa", "nom commun"), ("paris", "paris", "nom propre"), ("vi", "vivre", "verbe"), ("re", "re", "adverbe"), ("ch", "cher", "adjectif"), ("ier", "ier", "adjectif"),
    ("ne", "ne", "adverbe"), ("pas", "pas", "adverbe"), ("au", "à", "préposition"), ("ai", "avoir", "verbe"), ("oi", "oie", "nom commun"), ("enan", "an", "nom commun"), ("tre", "tre", "adjectif"), ("çon", "çon", "nom commun"),
    ("fleur", "fleur", "nom commun"), ("fleurs", "fleur", "nom commun"), ("arbre", "arbre", "nom commun"), ("chante", "chanter", "verbe"), ("mange", "manger", "verbe"), ("rigole", "rigole", "nom commun"), ("lève", "lever", "verbe"),
    ("chant", "chant", "nom commun"), ("fais", "faire", "verbe"), ("effort", "effort", "nom commun"), ("réponse", "réponse", "nom commun"), ("question", "question", "nom commun"), ("posé", "poser", "verbe"),
    ("marche", "marcher", "verbe"), ("marches", "marcher", "verbe"), ("marchent", "marcher", "verbe"),
)
FAMILIES = (("eau", "f1"), ("oie", "f1"), ("an", "f2"), ("vivre", "f2"), ("mentir", "f3"), ("tion", "f3"), ("chanter", "f4"), ("chant", "f4"))
SOUNDS = (("eau", "o"), ("eaux", "o"), ("tion", "sjɔ̃"), ("ment", "mɑ̃t"), ("mente", "mɑ̃tə"), ("fleur", "flœʁ"), ("fleurs", "flœʁ"), ("effort", "efɔʁ"), ("marche", "maʁʃ"), ("marchent", "maʁʃ"), ("chante", "ʃɑ̃tə"), ("chant", "ʃɑ̃"))
# ----------------------------------------------------------------------------


def _sized(spark: SparkSession, rows: tuple[tuple[str, ...], ...], *names: str) -> DataFrame:
    """A table whose size the planner knows; one of Python rows counts as larger than any other table and is never broadcast."""
    return spark.createDataFrame(pa.table({n: pa.array(c, pa.string()) for n, c in zip(names, zip(*rows))}))


def small_lexicon(spark: SparkSession) -> DataFrame:
    return _sized(spark, FORMS, "form", "lemma", "category")


def small_families(spark: SparkSession) -> DataFrame:
    return _sized(spark, FAMILIES, "lexeme", "family")


def small_sounds(spark: SparkSession) -> DataFrame:
    return _sized(spark, SOUNDS, "form", "phonetic")
