"""Readers of texts and of the small configuration files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


#: A single file up to so many bytes is dealt out before it is worked on.
ONE_TASK_BYTES = 64 << 20


#: Bytes, by the planner's estimate, that one task takes of documents that are held together.
TOGETHER_BYTES = 1 << 20


def _bytes(table: DataFrame) -> int:
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(table: DataFrame) -> DataFrame:
    """A table of one small file, which one task would read and work through, dealt out to all cores; any other table as it is."""
    if _bytes(table) > ONE_TASK_BYTES or len(table.inputFiles()) != 1:
        return table
    return table.repartition(2 * table.sparkSession.sparkContext.defaultParallelism)


def together(table: DataFrame, key: str = "doc_id") -> DataFrame:
    """table dealt out by key in parts whose rows a task can sort in memory once they are cut to words.

    Aggregates, windows and joins by this key alone need no further shuffle, so that a
    document's text is moved instead of its words, which are several times as large.
    """
    return table.repartition(max(2 * table.sparkSession.sparkContext.defaultParallelism, _bytes(table) // TOGETHER_BYTES), key)


def read_markdown(spark: SparkSession, *paths: str) -> DataFrame:
    """path, text (normalised line ends), meta (front matter), body: one row per *.md file below the paths."""
    raw = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(list(paths), wholetext=True)
    text = T.normalise_newlines(F.col("value"))
    rows = raw.select(F.col("_metadata.file_path").alias("path"), text.alias("text")).dropDuplicates(["path"])
    return rows.select("path", "text", T.front_matter(F.col("text")).alias("meta"), T.markdown_body(F.col("text")).alias("body"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """key, value of `key: value` lines (site settings, palettes, kinds of function words)."""
    return _lines(spark, path).where("contains(line, ':')").select(F.trim(F.substring_index("line", ":", 1)).alias("key"), F.btrim(F.trim(F.substr("line", F.instr("line", ":") + 1)), F.lit('"')).alias("value"))


def read_function_words(spark: SparkSession, path: str) -> DataFrame:
    """kind (mot, lemme, catégorie, garder), value (lower case, straight apostrophes); another kind is an error."""
    known = F.col("key").isin("mot", "lemme", "catégorie", "garder")
    return read_pairs(spark, path).select(F.when(known, F.col("key")).otherwise(F.raise_error(F.concat(F.lit("unknown kind: "), "key"))).alias("kind"), F.replace(F.lower("value"), F.lit("’"), F.lit("'")).alias("value"))


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.replace(F.lower("line"), F.lit("’"), F.lit("'")).alias("phrase"))


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """file_key, date, title from `key: {date: "…", title: "…"}` or `key: date`."""
    field = lambda n: F.nullif(F.regexp_extract("value", rf'{n}:\s*"?([^",}}]*)"?', 1), F.lit(""))
    nested = F.startswith("value", F.lit("{"))
    return read_pairs(spark, path).select(F.col("key").alias("file_key"), F.when(nested, field("date")).otherwise(F.nullif("value", F.lit(""))).alias("date"), F.when(nested, field("title")).alias("title"))


def with_metadata(books: DataFrame, overrides: DataFrame, years: DataFrame) -> DataFrame:
    """books (file_key, title, author, publication_date, text) with title and year by precedence: overrides, own front matter, text, looked-up years (author_key, title_key, year)."""
    o = overrides.select("file_key", F.col("date").alias("o_date"), F.col("title").alias("o_title"))
    y = years.select("author_key", "title_key", F.col("year").alias("y_year")).groupBy("author_key", "title_key").agg(F.min("y_year").alias("y_year"))
    rows = books.join(o, "file_key", "left").withColumn("author_key", T.ascii_fold(F.col("author"))).withColumn("title_key", T.ascii_fold(F.coalesce("o_title", "title"))).join(y, ["author_key", "title_key"], "left")
    year = F.coalesce(T.publication_year(F.col("o_date"), F.lit("")), T.publication_year(F.col("publication_date"), F.col("text")), F.col("y_year").cast("int"))
    return rows.select("file_key", F.coalesce("o_title", F.nullif("title", F.lit("")), T.display_name(F.col("file_key"))).alias("title"), "author", year.alias("year"), "text")


def first_windows(analyses: DataFrame) -> DataFrame:
    """The first analysis of each book."""
    return analyses.groupBy("book_id").agg(F.min_by(F.struct(*[c for c in analyses.columns if c != "book_id"]), "window_index").alias("a")).select("book_id", "a.*")


# ---- configuration files: small tables that the driver may hold -----------------------
def read_site(spark: SparkSession, path: str) -> DataFrame:
    """key, n, value: `key: value` lines (n 0), and the items of lists below a `key:` line (`- item`, n from 1). A list's items follow its key."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    rows = rows.select("at", F.regexp_replace("line", r"\s+#.*$|^#.*$", "").alias("line")).where("trim(line) <> ''")
    item = F.regexp_extract("line", r"""^\s*-\s*["']?(.*?)["']?\s*$""", 1)
    is_item = F.rlike("line", F.lit(r"^\s*-\s"))
    key = F.when(~is_item, F.trim(F.substring_index("line", ":", 1)))
    own = F.btrim(F.trim(F.substr("line", F.instr("line", ":") + 1)), F.lit("\"'"))
    file = Window.partitionBy(F.lit(1)).orderBy("at")  # one configuration file is one ordered list
    held = rows.withColumn("key", F.last(key, True).over(file)).withColumn("is_item", is_item).withColumn("item", F.when(is_item, item).otherwise(own))
    n = F.sum(F.col("is_item").cast("int")).over(Window.partitionBy("key").orderBy("at"))
    return held.select("key", n.cast("int").alias("n"), F.col("item").alias("value")).where("value <> ''")


NOTE_HEADING = r"^# (.*?)\s*$"


def read_notes(spark: SparkSession, path: str, window_label: str = "") -> DataFrame:
    """note_id (null without `#n`), heading (without marks), note: sections under `# heading #id` lines, without comments. `{windows}` stands for the window's label."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.replace("value", F.lit("{windows}"), F.lit(window_label)), r"(?s)<!--.*?-->", "").alias("t"))
    parts = text.select(F.explode(F.split("t", r"(?m)^(?=# )")).alias("s")).where("startswith(s, '# ')")
    head, body = F.substring_index("s", "\n", 1), F.when(F.contains("s", F.lit("\n")), F.substr("s", F.instr("s", "\n") + 1)).otherwise("")
    ident = F.regexp_extract(head, r"#(\d+)(?:\s|$)", 1)
    lines = F.filter(F.transform(F.split(body, "\n"), F.trim), lambda x: x != "")
    name = F.replace(F.regexp_replace(F.regexp_replace(head, NOTE_HEADING, "$1"), r"(?:\s+#\w+)+\s*$", ""), F.lit("**"), F.lit(""))
    return parts.select(F.when(ident != "", ident.cast("int")).alias("note_id"), F.trim(name).alias("heading"), F.array_join(lines, " ").alias("note"))


def registry_lines(entries: DataFrame, books: DataFrame) -> DataFrame:
    """n, line: the publication registry in order: by author, date (unknown ones last), title and key, a blank line between authors.

    entries: file_key, date, title as read_overrides gives them; books: file_key, author, publication_date. A book without an entry gets one with its year.
    """
    year = F.regexp_extract(F.coalesce("publication_date", F.lit("")), r"^(\d{4})", 1)
    new = books.join(entries.select("file_key"), "file_key", "left_anti").select("file_key", year.alias("date"), F.lit(None).cast("string").alias("title"))
    whole = entries.select("file_key", "date", "title").unionByName(new).join(books.select("file_key", "author").dropDuplicates(["file_key"]), "file_key", "left")
    date = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("date", F.lit("")), r"^(\d{4})", 1), F.lit("")), F.lit(""))
    rows = whole.select("file_key", date.alias("date"), "title", F.lower(F.trim(F.coalesce("author", F.lit("")))).alias("a"))
    order = Window.partitionBy(F.lit(1)).orderBy("a", F.when(F.col("date") == "", "9999").otherwise(F.col("date")), F.lower(F.coalesce("title", "file_key")), "file_key")  # one file, one line a book
    more = F.when(F.col("title").isNotNull(), F.concat(F.lit(', title: "'), "title", F.lit('"'))).otherwise("")
    line = F.concat(F.when(F.lag("a").over(order) != F.col("a"), "\n").otherwise(""), "file_key", F.lit(': {date: "'), "date", F.lit('"'), more, F.lit("}"))
    return rows.select(F.row_number().over(order).alias("n"), line.alias("line"))
