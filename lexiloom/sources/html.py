"""XHTML to readable blocks as a relational plan.

A body is split at its block tags into runs of text. What a tag does to the runs
after it (the open block, quotes around it, whether a heading was just closed)
is read off windows over the tags of one document; what becomes of a run follows
from the declared tables below. Only the names of entities need Python, in Arrow
batches.

Defined cases: rows need no ids and may repeat; a null markup, or one without a
body, has no blocks; an unclosed body, comment or skipped element ends with the
markup, an unfinished tag at the end is left out.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values -------------------------------------------------------------
BLOCK_TAGS = ("p", "div", "section", "article", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "li", "br")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SKIPPED_ELEMENTS = ("script", "style", "svg", "nav")
#: tag -> mark before its text
MARKS = {"h1": "#", "h2": "#", "h3": "##", "h4": "##"}
#: kind of line -> least and most characters, most words, what it holds, what it does not begin with; none of them ends a sentence
LINES = {"subtitle": (1, 120, 15, "", ()), "attribution": (3, 120, 1000, ",", ("#", ">", "---"))}
SENTENCE_END = "[.!?;:]$"
UNKNOWN = r"(?i)^inconnu\s*\(e\)\s*$"
BREAKS = {"*": "---"}
# ------------------------------------------------------------------------------
_CUT = "\u0001"
_SPACES = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+"


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or "&" not in t else html.unescape(t))


def line_is(kind: str, text: Column) -> Column:
    """Whether a line is short and open enough to be a `kind` of LINES."""
    least, most, words, held, not_first = LINES[kind]
    out = F.length(text).between(least, most) & (F.size(F.split(text, " ")) <= words) & F.contains(text, F.lit(held)) & ~F.rlike(text, F.lit(SENTENCE_END))
    for start in not_first:
        out = out & ~F.startswith(text, F.lit(start))
    return out


def body_of(markup: Column) -> Column:
    """The body without comments, declarations and skipped elements."""
    body = F.regexp_extract(F.replace(markup, F.lit(_CUT), F.lit("")), r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)", 1)
    skipped = "|".join(SKIPPED_ELEMENTS)
    return F.regexp_replace(body, rf"(?is)<!--.*?(?:-->|\z)|<({skipped})\b[^>]*(?<!/)>.*?(?:</\1\s*>|\z)|<[!?][^>]*>", "")


def runs(rows: DataFrame, markup: str, keys: list[str]) -> DataFrame:
    """keys, row, pos, tag, kind (start, open, close, single, rule), classed, text: the run of text after each block tag."""
    tags = "|".join((*BLOCK_TAGS, "hr"))
    cut = F.regexp_replace(body_of(F.col(markup)), rf"(?i)<(/?(?:{tags})[\s/>])", f"{_CUT}$1")
    parts = rows.select(*keys, F.monotonically_increasing_id().alias("row"), F.split(cut, _CUT).alias("parts")).where("parts is not null")
    parts = parts.select(*keys, "row", F.posexplode("parts").alias("pos", "part"))
    at = F.instr("part", ">")
    head = F.when(F.col("pos") > 0, F.substr("part", F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise("")
    text = F.when(F.col("pos") == 0, F.col("part")).when(at > 0, F.substr("part", at + 1)).otherwise("")
    tag = F.lower(F.regexp_extract(head, r"^/?([A-Za-z0-9]+)", 1))
    kind = F.when(F.col("pos") == 0, "start").when(at == 0, "single").when(tag == "hr", "rule").when(F.startswith(head, F.lit("/")), "close").when(F.endswith(head, F.lit("/")), "single").otherwise("open")
    bare = F.regexp_replace(text, r"(?s)</?[A-Za-z][^>]*(?:>|\z)", "")
    out = parts.select(*keys, "row", "pos", tag.alias("tag"), kind.alias("kind"), F.rlike(head, F.lit(r"""(?i)\sclass\s*=\s*["']?[^"'\s]""")).alias("classed"), bare.alias("text"))
    return out.withColumn("text", F.trim(F.regexp_replace(unescaped("text"), _SPACES, " ")))


def typed(found: DataFrame) -> DataFrame:
    """runs with mark: what stands before the run's text, by the block that is open there. A run that no end tag closes has none."""
    order = Window.partitionBy("row").orderBy("pos")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("tag") == "blockquote", F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1)).otherwise(0)
    block = F.when(F.col("kind") == "open", F.col("tag")).when(F.col("kind") == "close", F.lit(""))
    rows = found.withColumn("sum", F.sum(F.coalesce(change, F.lit(0))).over(so_far)).withColumn("block", F.coalesce(F.last(block, True).over(so_far), F.lit("")))
    rows = rows.withColumn("quoted", F.col("sum") > F.least(F.lit(0), F.min("sum").over(so_far)))  # an end tag too many closes nothing
    closed = F.when(F.col("kind") == "close", F.lag("block").over(order).isin(*HEADINGS))
    rows = rows.withColumn("closed", closed).withColumn("below", F.coalesce(F.last("closed", True).over(before), F.lit(False)))
    opened = F.when(F.col("kind") == "open", (F.col("tag") == "p") & F.col("classed") & F.col("below")).when(F.col("kind") == "close", F.lit(False))
    rows = rows.withColumn("sub", F.coalesce(F.last(opened, True).over(so_far), F.lit(False))).withColumn("ended", F.coalesce(F.lead("kind").over(order) == "close", F.lit(False)))
    level = F.lit("")
    for name, mark in MARKS.items():
        level = F.when(F.col("block") == name, mark).otherwise(level)
    mark = F.when(~F.col("ended") | (F.col("block") == "") | (F.col("sub") & ~line_is("subtitle", F.col("text"))), "").when(F.col("quoted"), ">").when(F.col("sub"), "##").otherwise(level)
    return rows.withColumn("mark", mark)


def blocks(rows: DataFrame, markup: str = "html", keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keys, row (one for each input row), pos (from 0), block: headings as # and ##, quotes as >, rules as ---; no repeats in a row."""
    keys = list(keys)
    marked = typed(runs(rows, markup, keys))
    line = F.when(F.col("text") == "", None).when(F.rlike("text", F.lit(UNKNOWN)), None).when(F.col("mark") == "", F.col("text")).otherwise(F.concat_ws(" ", "mark", "text"))
    both = F.filter(F.array(F.when(F.col("kind") == "rule", "---"), line), lambda x: x.isNotNull())
    one = marked.select(*keys, "row", "pos", F.posexplode(both).alias("k", "block"))
    for text, instead in BREAKS.items():
        one = one.withColumn("block", F.when(F.col("block") == text, instead).otherwise(F.col("block")))
    order = Window.partitionBy("row").orderBy("pos", "k")
    # lines like an attribution belong to the quote that the nearest other line before them is
    other = F.when(~line_is("attribution", F.col("block")), F.startswith("block", F.lit("> ")))
    one = one.withColumn("cited", F.coalesce(F.last(other, True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    one = one.withColumn("block", F.when(F.col("cited") & line_is("attribution", F.col("block")), F.concat(F.lit("> "), "block")).otherwise(F.col("block")))
    kept = one.withColumn("last", F.lag("block").over(order)).where("last is null or last <> block")
    return kept.withColumn("pos", F.row_number().over(order) - 1).select(*keys, "row", "pos", "block")
