"""EPUB archives to Markdown.

Python only opens the archive and lists what is in it: metadata elements, the
reading order with each document's markup, and every table of contents. All
choices (metadata, where the narrative begins, which documents and headings
stay) are Column functions over those lists, and markup becomes blocks by the
relational plan of `html`.

Defined cases: an archive that cannot be read gives a row with `error` and empty
fields; members that are missing from it are left out; of several tables of
contents the older kind counts where it has entries.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import text as T
from . import html

# --- fixed values -------------------------------------------------------------
SKIPPED_DOCUMENTS = ("cover", "titlepage", "toc", "nav", "copyright", "imprint", "colophon")
FRONT_LABELS = ("couverture", "page de titre", "titre", "copyright", "du même auteur", "avertissement", "avant-propos", "mentions légales", "table des matières")
BOUNDARY_LABELS = ("préface", "avant-propos", "avertissement", "mentions légales", "dédicace", "exergue")
NUMBERED_LABEL = r"(?i)\A(?:(?:chapitre\s+)?\d+[.)]\s|\s-\s\d+\s-\s)"
CHAPTER_HEADING = r"(?i)^#+\s*(?:(?:chapitre|partie|chapter)\s+)?(?:\d+|[ivxlcdm]+)\s*$"
GENRES = ("roman", "novel", "fiction", "thriller", "essai", "poésie", "poesie", "science-fiction")
GIVEN_NAMES = (
    "thierry", "jean", "marie", "pierre", "paul", "michel", "philippe", "françois", "francois", "christophe", "sophie", "isabelle",
    "anne", "claude", "nicolas", "olivier", "yannick", "laurent", "jacques",
)
TWO_CAPITALISED = r"^[A-ZÀ-ÖØ-Ý][\p{L}\p{N}_'’-]+\s+[A-ZÀ-ÖØ-Ý][\p{L}\p{N}_'’-]+$"
NCX, EVENT = "application/x-dtbncx+xml", "{http://www.idpf.org/2007/opf}event"
# ------------------------------------------------------------------------------
_S, _I = StringType(), IntegerType()


def _records(**fields) -> ArrayType:
    return ArrayType(StructType([StructField(n, t) for n, t in fields.items()]))


LISTS = StructType([
    StructField("error", _S), StructField("fields", _records(name=_S, text=_S, event=_S)), StructField("spine", ArrayType(_S)),
    StructField("documents", _records(at=_I, name=_S, html=_S)), StructField("toc", _records(rank=_I, target=_S, label=_S)),
])


# ---- the archive ---------------------------------------------------------------


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _said(e: ElementTree.Element) -> str:
    return " ".join("".join(e.itertext()).split())


class _Links(HTMLParser):
    """(href, label) of every link."""

    def __init__(self, markup: str):
        super().__init__()
        self.found: list[list[str]] = []
        self._open = False
        self.feed(markup)

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (href := dict(attrs).get("href")):
            self.found.append([href, ""])
            self._open = True

    def handle_endtag(self, tag):
        self._open = self._open and tag != "a"

    def handle_data(self, data):
        if self._open:
            self.found[-1][1] += data


def _entries(kind: str, markup: str) -> list[list[str]]:
    if kind != NCX:
        return [[href, " ".join(label.split())] for href, label in _Links(markup).found]
    out = []
    for point in ElementTree.fromstring(markup).iter():
        if _local(point.tag) == "navpoint":
            own = {_local(c.tag): c for c in reversed(point)}
            if "content" in own and own["content"].get("src"):
                out.append([own["content"].get("src"), _said(own["navlabel"]) if "navlabel" in own else ""])
    return out


def listed(data: bytes) -> dict:
    """What an archive holds, without any choice."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        read = lambda name: book.read(name).decode("utf-8", "replace")
        package_at = next(e.get("full-path", "") for e in ElementTree.fromstring(book.read("META-INF/container.xml")).iter() if _local(e.tag) == "rootfile")
        package = list(ElementTree.fromstring(book.read(package_at)).iter())
        beside = lambda base, href: posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(href.partition("#")[0])))
        items = {e.get("id"): e for e in package if _local(e.tag) == "item" and e.get("id") and e.get("href")}
        spine = [beside(package_at, items[e.get("idref")].get("href")) for e in package if _local(e.tag) == "itemref" and e.get("idref") in items]
        toc = []
        for e in items.values():
            kind, at = e.get("media-type", ""), beside(package_at, e.get("href"))
            if (kind == NCX or "nav" in e.get("properties", "").split()) and at in names:
                toc += [{"rank": int(kind != NCX), "target": beside(at, href), "label": label} for href, label in _entries(kind, read(at))]
        return {
            "error": None, "spine": spine, "toc": toc,
            "fields": [{"name": _local(e.tag), "text": _said(e), "event": e.get(EVENT) or e.get("event") or ""} for e in package if _local(e.tag) not in ("package", "metadata", "manifest", "spine", "item", "itemref")],
            "documents": [{"at": k, "name": n, "html": read(n)} for k, n in enumerate(spine) if n in names],
        }


@F.pandas_udf(LISTS)
def _listed(content: pd.Series) -> pd.DataFrame:
    out = []
    for c in content:
        try:
            out.append(listed(bytes(c)))
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, OSError, NotImplementedError, RuntimeError) as e:
            out.append({"error": f"{type(e).__name__}: {e}", "fields": [], "spine": [], "documents": [], "toc": []})
    return pd.DataFrame(out, columns=["error", "fields", "spine", "documents", "toc"])


# ---- choices over the lists -----------------------------------------------------


def _first(items: Column) -> Column:
    return F.coalesce(F.get(items, F.lit(0)), F.lit(""))


def _named(fields: Column, *names: str) -> Column:
    return F.transform(F.filter(fields, lambda f: f["name"].isin(*names) & (f["text"] != "")), lambda f: f["text"])


def metadata(fields: Column) -> Column:
    """struct<title, author, author_firstname, author_lastname, publisher, genre, publication_date> of the package's elements."""
    title, creator = _first(_named(fields, "title")), _first(_named(fields, "creator", "author"))
    # a creator with a year beside a title of two names: the two stand in each other's place
    swapped = F.rlike(creator, F.lit(r"\b\d{2,4}\b")) & F.rlike(title, F.lit(TWO_CAPITALISED))
    title, creator = F.when(swapped, creator).otherwise(title), F.when(swapped, title).otherwise(creator)
    words = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    comma, plain = F.instr(creator, ","), words(creator)
    turned = (F.size(plain) >= 2) & ~F.lower(F.get(plain, F.lit(0))).isin(*GIVEN_NAMES) & F.lower(F.get(plain, F.lit(1))).isin(*GIVEN_NAMES)
    names = F.when(comma > 0, F.concat(words(F.substr(creator, comma + 1)), words(F.substr(creator, F.lit(1), comma - 1)))).when(turned, F.concat(F.slice(plain, 2, F.size(plain)), F.slice(plain, 1, 1))).otherwise(plain)
    kinds = _named(fields, "type", "genre")
    known = F.filter(F.transform(F.flatten(F.transform(F.concat(kinds, _named(fields, "subject")), words)), lambda w: F.btrim(w, F.lit(" ,;:"))), lambda w: F.lower(w).isin(*GENRES))
    dates = F.filter(fields, lambda f: (f["name"] == "date") & (f["text"] != ""))
    published = F.transform(F.filter(dates, lambda f: F.lower(f["event"]) == "publication"), lambda f: f["text"])
    date = F.coalesce(F.get(published, F.lit(0)), F.get(dates, F.lit(0))["text"], F.lit(""))
    return F.struct(
        title.alias("title"), F.array_join(names, " ").alias("author"), F.array_join(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))), " ").alias("author_firstname"),
        F.coalesce(F.get(names, F.size(names) - 1), F.lit("")).alias("author_lastname"), _first(_named(fields, "publisher")).alias("publisher"),
        F.when(F.size(known) > 0, F.get(known, F.lit(0))).otherwise(_first(kinds)).alias("genre"), F.substring_index(date, "T", 1).alias("publication_date"),
    )


def contents(toc: Column) -> Column:
    """One table of contents, in its order; the first label of a target counts."""
    rank = F.array_min(F.transform(toc, lambda e: e["rank"]))
    own = F.filter(toc, lambda e: e["rank"] == rank)
    targets = F.transform(own, lambda e: e["target"])
    return F.filter(own, lambda e, i: F.array_position(targets, e["target"]) == i + 1)


def _holds(label: Column, words: tuple[str, ...]) -> Column:
    return F.rlike(F.lower(label), F.lit("|".join(words)))


def narrative(entries: Column, title: Column) -> Column:
    """The entries of the narrative: from the first after a boundary (a preface, a notice) that is not front matter, else from the first that is not; of these the numbered ones, if any."""
    front = F.transform(entries, lambda e: (F.lower(F.trim(e["label"])) == F.lower(F.trim(title))) | _holds(e["label"], FRONT_LABELS))
    bound = F.transform(entries, lambda e: _holds(e["label"], BOUNDARY_LABELS))
    seen = F.array_position(bound, F.lit(True))
    after = F.transform(front, lambda f, i: (seen > 0) & (i + 1 > seen) & ~f & ~F.get(bound, i))
    start = F.greatest(F.lit(1), F.coalesce(F.nullif(F.array_position(after, F.lit(True)), F.lit(0)), F.array_position(front, F.lit(False)))).cast("int")
    rest = F.slice(entries, start, F.size(entries))
    numbered = F.filter(rest, lambda e: F.rlike(F.trim(e["label"]), F.lit(NUMBERED_LABEL)))
    return F.when(F.size(numbered) > 0, numbered).otherwise(rest)


def _drop_while(items: Column, cond) -> Column:
    stop = F.array_position(F.transform(items, lambda x: F.coalesce(cond(x), F.lit(False))), F.lit(False)).cast("int")
    return F.when(stop == 0, F.slice(items, 1, 0)).otherwise(F.slice(items, stop, F.size(items)))


def _drop_if(items: Column, cond) -> Column:
    return F.when((F.size(items) > 0) & F.coalesce(cond(F.get(items, F.lit(0))), F.lit(False)), F.slice(items, 2, F.size(items))).otherwise(items)


def headed(own: Column, label: Column, title: Column, stem: Column) -> Column:
    """A labelled document's blocks under its label, without headings that say the same."""
    same = lambda *names: lambda x: F.lower(F.trim(x)).isin(*(F.lower(F.trim(n)) for n in names))
    heading = lambda x: F.startswith(x, F.lit("#"))
    out = _drop_if(_drop_while(own, same(stem, F.replace(stem, F.lit("_"), F.lit(" ")), title)), heading)
    said = lambda x: F.lower(F.trim(F.regexp_replace(x, r"^#+\s*", "")))
    out = _drop_if(out, lambda x: heading(x) & (said(x) != "") & F.contains(F.lower(label), said(x)))
    out = _drop_if(out, lambda x: F.rlike(x, F.lit(r"^#+\s*\d+[.)]?$")))
    parts = F.transform(F.split(F.lower(label), r"\s+-\s+"), F.trim)
    out = _drop_while(out, lambda x: same(title, label)(x) | F.array_contains(parts, F.lower(F.trim(x))))
    return F.concat(F.array(F.concat(F.lit("# "), label)), out)


def assembled(blocks: Column, entries: Column, title: Column) -> Column:
    """A book's blocks: no lines that only say the title, no repeats, from the first chapter where there is no table of contents, and under the table's first label."""
    kept = F.filter(blocks, lambda b: F.lower(F.trim(b)) != F.lower(F.trim(title)))
    place = lambda items, cond: F.array_position(F.transform(items, cond), F.lit(True)).cast("int")
    start = F.coalesce(F.nullif(place(kept, lambda b: F.rlike(F.trim(b), F.lit(CHAPTER_HEADING))), F.lit(0)), F.greatest(F.lit(1), place(kept, lambda b: F.startswith(b, F.lit("#")))))
    whole = F.when(F.size(entries) == 0, F.slice(kept, start, F.greatest(F.size(kept), F.lit(1)))).otherwise(kept)
    once = F.filter(whole, lambda b, i: (i == 0) | (F.trim(b) != F.trim(F.coalesce(F.get(whole, i - 1), F.lit("")))))
    label = F.trim(F.coalesce(F.get(entries, F.lit(0))["label"], F.lit("")))
    first = place(once, lambda b: F.startswith(b, F.lit("#")))
    line = F.concat(F.lit("# "), label)
    under = F.when(first == 0, F.concat(F.array(line), once)).otherwise(F.transform(once, lambda b, i: F.when(i + 1 == first, line).otherwise(b)))
    return F.when((label != "") & (F.size(once) > 0), under).otherwise(once)


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """path, error, meta, toc (labels), text (Markdown): one row per *.epub file below the path."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path)
    books = raw.select("path", _listed("content").alias("e")).select("path", "e.*").withColumn("meta", metadata(F.col("fields"))).withColumn("toc", contents(F.col("toc")))
    books = books.withColumn("story", narrative(F.col("toc"), F.col("meta.title")))
    targets = F.transform("story", lambda e: e["target"])
    starts = F.filter(F.transform(targets, lambda t: F.array_position("spine", t)), lambda p: p > 0)
    books = books.withColumn("start", F.coalesce(F.array_min(starts), F.lit(1)) - 1)
    stem = F.regexp_replace(F.element_at(F.split("d.name", "/"), -1), r"\.[^.]*$", "")
    docs = books.select("path", "meta", "story", "start", F.explode("documents").alias("d")).where(F.col("d.at") >= F.col("start"))
    docs = docs.withColumn("stem", stem).where(~F.rlike(F.lower("stem"), F.lit("|".join(SKIPPED_DOCUMENTS))))
    labels = F.filter("story", lambda e: e["target"] == F.col("d.name"))
    docs = docs.select("path", "meta.title", "stem", F.col("d.at").alias("at"), F.trim(F.coalesce(F.get(F.transform(labels, lambda e: e["label"]), F.lit(0)), F.lit(""))).alias("label"), F.col("d.html").alias("html"))
    lines = html.blocks(docs, "html", ("path", "at", "title", "stem", "label"))
    own = lines.groupBy("path", "at", "title", "stem", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]).alias("own"))
    own = own.withColumn("own", F.when(F.col("label") != "", headed(F.col("own"), F.col("label"), F.col("title"), F.col("stem"))).otherwise(F.col("own")))
    text = own.groupBy("path").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "own"))), lambda x: x["own"])).alias("blocks"))
    whole = books.drop("documents", "fields", "spine").join(text, "path", "left").withColumn("blocks", F.coalesce("blocks", F.array().cast("array<string>")))
    return whole.select("path", "error", "meta", F.transform("toc", lambda e: e["label"]).alias("toc"), F.array_join(assembled(F.col("blocks"), F.col("story"), F.col("meta.title")), "\n\n").alias("text"))


def as_markdown(books: DataFrame) -> DataFrame:
    """name (a slug with .md), text: the file of every book, its front matter and its narrative. A date outside 1500 to 2100 gives way to the year beside a copyright sign."""
    m = F.col("meta")
    year = T.publication_year(m["publication_date"], F.col("text"))
    dated = F.when(T.publication_year(m["publication_date"], F.lit("")).isNotNull(), m["publication_date"]).otherwise(F.coalesce(year.cast("string"), F.lit("")))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" ")), F.lit('"'))
    stem = T.slug(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""))
    fields = [F.concat(F.lit(f"{n}: "), quoted(dated if n == "publication_date" else m[n])) for n in ("title", "author", "author_firstname", "author_lastname", "publisher", "genre", "publication_date")]
    fields += [F.concat(F.lit("size: "), F.length("text").cast("string")), F.concat(F.lit("source: "), quoted(F.concat(stem, F.lit(".epub"))))]
    content = F.concat(F.lit("---\n"), F.concat_ws("\n", *fields), F.lit("\n---\n\n"), F.col("text"), F.lit("\n"))
    return books.where("error is null").select(F.concat(stem, F.lit(".md")).alias("name"), content.alias("text"))
