"""Segmentation and cleaning as Column functions: no shuffle, no Python workers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

W = r"[\p{L}\p{N}_]"
WORD = rf"{W}+(?:['’]{W}+)?"
LONG_WORD = rf"{W}{{2,}}|\x{{130}}"  # two letters or more once lower-cased; only U+0130 becomes two
WHITE = r"[\s\x{85}\p{Z}]"
_STOP = "․"  # stands for a full stop that ends no sentence


def tokenize(text: Column) -> Column:
    """Lower-cased words; one inner apostrophe joins two parts."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), 0), lowered)


def lowered(word: Column) -> Column:
    return F.replace(F.lower(word), F.lit("’"), F.lit("'"))


def repetition_tokens(text: Column) -> Column:
    """Words of two letters or more, apostrophes separating."""
    return F.filter(tokenize(F.regexp_replace(text, "['’]", " ")), lambda w: F.length(w) >= 2)


def split_sentences(text: Column) -> Column:
    """Sentences end at . ! ? before white space or the end; abbreviations and single capitals do not end one."""
    short = rf"(?i)(?<![\p{{L}}\p{{N}}_])({'|'.join(config.ABBREVIATIONS)})\."
    capital = r"(?<![\p{L}\p{N}_])([A-ZÀ-Ý])\."
    for pattern in (short, capital):
        text = F.regexp_replace(text, pattern, "$1" + _STOP)
    parts = F.split(text, rf"(?<=[.!?])(?:{WHITE}+|$)", -1)
    return F.filter(F.transform(parts, lambda s: strip(F.replace(s, F.lit(_STOP), F.lit(".")))), lambda s: s != "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+\z", "")


def structure_units(text: Column) -> Column:
    """Sentences of each line."""
    lines = F.filter(F.split(text, r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]", -1), lambda s: strip(s) != "")
    return F.flatten(F.transform(lines, split_sentences))


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n\s*\n", -1), lambda s: strip(s) != "")


def structure_tokens(sentence: Column) -> Column:
    """Words, `...` and single marks; elided prefixes stand alone."""
    return F.flatten(F.transform(structure_marks(sentence), elided_apart))


def structure_marks(sentence: Column) -> Column:
    """Words with their elided prefixes, `...` and single marks."""
    return F.regexp_extract_all(F.replace(F.lower(sentence), F.lit("’"), F.lit("'")), F.lit(rf"{W}+(?:'{W}+)?|\.\.\.|[…,.!?;:—–()«»\"-]"), 0)


def elided_apart(t: Column) -> Column:
    head = F.substring_index(t, "'", 1)
    rest = F.substr(t, F.length(head) + 2)
    return F.when(F.contains(t, F.lit("'")) & head.isin(*config.ELIDED) & (rest != ""), F.array(head, rest)).otherwise(F.array(t))


def document_words(text: Column) -> Column:
    """The document mode's words (× and ÷ count as letters)."""
    w = r"[\p{L}\p{N}_×÷]"
    return F.regexp_extract_all(text, F.lit(rf"{w}+(?:['’]{w}+)?"), 0)


def document_sentences(text: Column) -> Column:
    """The document mode's sentences: no abbreviations."""
    return F.filter(F.transform(F.split(text, rf"(?<=[.!?]){WHITE}+", -1), strip), lambda s: s != "")


def document_paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n\s*\n+", -1), lambda s: strip(s) != "")


def syllables(word: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(F.lower(word), F.lit("[aeiouyàâäéèêëîïôöùûüÿœ]+")))


def punctuation_count(text: Column, document_mode: bool = False) -> Column:
    marks = r"[.,;:!?…—–\-()«»\"\[\]]" if document_mode else r"[.,;:!?…—–\-()«»\"]"
    return F.regexp_count(text, F.lit(marks))


def punctuation_diversity(text: Column) -> Column:
    """Normalised entropy of ten families of marks."""
    counts = F.array(*(F.regexp_count(text, F.lit(p)).cast("double") for p in config.PUNCTUATION_FAMILIES))
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    entropy = F.transform(F.array(F.struct(counts.alias("c"), total.alias("t"))), lambda s: F.aggregate(s["c"], F.lit(0.0), lambda a, c: a - F.when(c > 0, c / s["t"] * F.log2(c / s["t"])).otherwise(0.0)))[0]
    return F.when(total > 0, entropy / F.log2(F.lit(float(len(config.PUNCTUATION_FAMILIES))))).otherwise(0.0)


def normalise_newlines(text: Column) -> Column:
    text = F.regexp_replace(text, "\r\n?", "\n")
    return F.regexp_replace(text, r"\n(?:[ \t]*\n){2,}", "\n\n")


def front_matter(text: Column) -> Column:
    """map<string,string> of a leading block between `---` lines; empty where there is none."""
    block = F.regexp_extract(text, r"(?s)\A---(.*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda s: F.contains(s, F.lit(":")))
    pairs = F.transform(lines, lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)).alias("k"), F.btrim(F.trim(F.substr(s, F.instr(s, ":") + 1)), F.lit('"')).alias("v")))
    last = F.filter(pairs, lambda p: p["k"] != "")
    keys = F.array_distinct(F.transform(last, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(last, lambda p: p["k"] == k), -1)["v"])))


def markdown_body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---.*?\n---\n*", "")


def clean_body(text: Column) -> Column:
    """Drops headings, quotes and everything under a preliminary heading: the text is cut before each heading, and a section stays or goes as a whole."""
    heading = r"[ \t\x{0B}\f]*#{1,6}[ \t\x{0B}\f]+\S"
    sections = F.split(F.regexp_replace(text, "\r\n?", "\n"), rf"(?m)^(?={heading})", -1)
    headed = lambda s: F.rlike(s, F.lit(rf"\A{heading}"))
    kept = F.filter(sections, lambda s: ~headed(s) | ~F.rlike(F.lower(F.substring_index(s, "\n", 1)), F.lit("|".join(config.PRELIMINARY_WORDS))))
    below = F.transform(kept, lambda s: F.when(headed(s), F.when(F.contains(s, F.lit("\n")), F.substr(s, F.instr(s, "\n") + 1)).otherwise("")).otherwise(s))
    return strip(F.regexp_replace(F.array_join(below, ""), r"(?m)^[ \t\x{0B}\f]*>.*(?:\n|\z)", ""))


def publication_year(date: Column, text: Column) -> Column:
    """The date's year if it is one of 1500 to 2100, else the first year after a copyright sign."""
    year = F.try_to_number(F.substring(date, 1, 4), F.lit("9999")).cast("int")
    found = F.regexp_extract(text, r"(?is)(?:©|copyright|droits réservés).{0,180}?\b((?:1[5-9]|20)\d\d)\b", 1)
    return F.when(year.between(1500, 2100), year).otherwise(F.when(found != "", found.cast("int")))


def percent_typography(text: Column) -> Column:
    return F.replace(text, F.lit(" %"), F.lit(" %"))


def _folds() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letters that Unicode decomposes them to."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250) if chr(c).islower()]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def ascii_fold(text: Column) -> Column:
    """Lower-cased, Latin letters without their marks; œ and æ as two letters."""
    out = F.translate(F.lower(text), *_folds())
    return F.replace(F.replace(out, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))


def number_in(text: Column) -> Column:
    """The first number of a text: blanks between digits do not count, and a comma is a decimal point; null without one."""
    plain = F.translate(text, " \u00a0\u202f", "")
    return F.replace(F.nullif(F.regexp_extract(plain, r"-?\d+(?:[.,]\d+)?", 0), F.lit("")), F.lit(","), F.lit(".")).cast("double")


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(ascii_fold(text), "[^a-z0-9]+", "-"), F.lit("-"))


def display_name(stem: Column) -> Column:
    """File stem to title: blanks for _ and -, digits apart, first letter capital."""
    s = F.trim(F.regexp_replace(F.regexp_replace(stem, r"\.[A-Za-z0-9]+$", ""), "[_-]+", " "))
    s = F.regexp_replace(s, r"(?<=\p{L})(?=\d)", " ")
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))


def first_window_end(text: Column, size: int = config.ANALYSIS_WINDOW_CHARS) -> Column:
    """Code points of the first analysis window: size, extended to the next end of a sentence (else the whole text)."""
    tail = F.substr(text, F.lit(size + 1))
    gap = F.length(F.regexp_extract(tail, r"(?s)\A(.*?[.!?…]+[\"»”’')\]]*)(?:\s|\z)", 1))
    return F.when(F.length(text) <= size, F.length(text)).when(gap > 0, size + gap).otherwise(F.length(text))


def char_windows(text: Column, size: int = config.ANALYSIS_WINDOW_CHARS) -> Column:
    """array<struct<start,end,fragment>>: contiguous windows that end at sentence ends; blank ones are dropped."""
    ends = F.regexp_extract_all(text, F.lit(r"(?s).*?(?:[.!?…]+[\"»”’')\]]*(?=\s|\z)|\z)"), 0)

    def step(acc: Column, s: Column) -> Column:
        size_now = acc["n"] + F.length(s)
        close = size_now - acc["start"] >= size
        out = F.when(close, F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), size_now.alias("end"))))).otherwise(acc["out"])
        return F.struct(size_now.alias("n"), F.when(close, size_now).otherwise(acc["start"]).alias("start"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("start"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    done = F.aggregate(ends, zero, step, lambda a: F.when(a["n"] > a["start"], F.concat(a["out"], F.array(F.struct(a["start"].alias("start"), a["n"].alias("end"))))).otherwise(a["out"]))
    cut = F.transform(done, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), strip(F.substr(text, w["start"] + 1, w["end"] - w["start"])).alias("fragment")))
    return F.filter(cut, lambda w: w["fragment"] != "")


def paragraph_windows(text: Column, size: int, final_ratio: float = config.FINAL_WINDOW_RATIO) -> Column:
    """array<string>: whole paragraphs gathered to at least `size` words; a short last window stays if it is large enough or the only one."""
    parts = F.transform(paragraphs(text), lambda p: F.struct(strip(p).alias("p"), F.size(tokenize(p)).alias("n")))

    def step(acc: Column, x: Column) -> Column:
        held, n = F.concat(acc["held"], F.array(x["p"])), acc["n"] + x["n"]
        full = n >= size
        none = F.array().cast("array<string>")
        return F.struct(F.when(full, F.concat(acc["out"], F.array(F.array_join(held, "\n\n")))).otherwise(acc["out"]).alias("out"), F.when(full, none).otherwise(held).alias("held"), F.when(full, 0).otherwise(n).alias("n"))

    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("out"), empty.alias("held"), F.lit(0).alias("n"))
    return F.aggregate(parts, start, step, lambda a: F.when((F.size(a["held"]) > 0) & ((a["n"] >= size * final_ratio) | (F.size(a["out"]) == 0)), F.concat(a["out"], F.array(F.array_join(a["held"], "\n\n")))).otherwise(a["out"]))


def byte_windows(text: Column, size: int) -> Column:
    """array<binary>: full blocks of UTF-8; the rest only if there is no full block."""
    data = F.encode(text, "UTF-8")
    blocks = F.floor(F.octet_length(data) / size).cast("int")
    return F.when(blocks == 0, F.array(data)).otherwise(F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.substr(data, i * size + 1, F.lit(size))))


def frame_starts(n: Column, window: int, step: int) -> Column:
    """Starts of sliding frames over n items, every `step`, and the last possible one; one start of 0 where n <= window."""
    last = F.greatest(F.lit(0), n - window)
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last.cast("int"), F.lit(step)), F.array(last.cast("int"))))


def frames_between(n: Column, window: int, step: int, low: Column, high: Column) -> Column:
    """Those of frame_starts that are low to high: counted off, so that an item costs its own frames and not all of its document's."""
    last = F.greatest(F.lit(0), n - window).cast("int")
    first = (F.ceil(F.greatest(F.lit(0), low) / step) * step).cast("int")
    top = (F.floor(F.least(high, last) / step) * step).cast("int")
    none = F.array().cast("array<int>")
    even = F.when(first <= top, F.sequence(first, top, F.lit(step))).otherwise(none)
    return F.concat(even, F.when((last % step != 0) & (low <= last) & (last <= high), F.array(last)).otherwise(none))
