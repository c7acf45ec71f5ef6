"""Thin renderers over finished, small frames: tables, JSON, SVG."""

from __future__ import annotations

import json
import math
from html import escape

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def number(value: object, digits: int = 3) -> str:
    if value is None:
        return "—"
    return f"{value:.{digits}f}".rstrip("0").rstrip(".") if isinstance(value, float) else str(value)


def markdown_table(headers: list[str], rows: list[list[object]]) -> str:
    lines = [headers, ["---", *["---:"] * (len(headers) - 1)], *([number(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def compared(long: DataFrame, entities: list[str] | None = None) -> DataFrame:
    """metric x entity, for all entities or the chosen ones. long has one row per metric and entity."""
    return long.groupBy("metric").pivot("entity", *([entities] if entities else [])).agg(F.first("value"))


def comparison(long: DataFrame, dispersion: DataFrame, entities: list[str]) -> str:
    """Markdown: metric x entity with the dispersion. long has one row per metric and entity."""
    table = compared(long.where(F.col("entity").isin(entities)), entities).join(dispersion, "metric", "left").orderBy("metric")
    return markdown_table(["Mesure", *entities, "σ %"], [list(r) for r in table.collect()])


def profiles(summary: DataFrame) -> str:
    """Markdown per author of low, median and high."""
    out, last = [], None
    for r in summary.orderBy("author", "metric").collect():
        if r.author != last:
            out.append(f"\n## {r.author}\n\n| Mesure | Minimum | Médiane | Maximum |\n| --- | ---: | ---: | ---: |")
            last = r.author
        out.append(f"| {r.metric} | {number(r.low)} | {number(r.median)} | {number(r.high)} |")
    return "\n".join(out).strip()


def nested_json(long: DataFrame, works: DataFrame) -> DataFrame:
    """One JSON row per author: works with their metrics. works: entity, author, title."""
    metrics = long.groupBy("entity").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    rows = works.join(metrics, "entity").groupBy("author").agg(F.array_sort(F.collect_list(F.struct("title", "metrics")), lambda a, b: F.when(a["title"] < b["title"], -1).when(a["title"] > b["title"], 1).otherwise(0)).alias("works"))
    return rows.select("author", F.to_json(F.struct("author", "works")).alias("json"))


def web_payload(long: DataFrame, works: DataFrame, registry: DataFrame) -> str:
    """The explorer's JSON: books with metrics by public id."""
    ids = {r.metric: f"mesure_{r.metric_id}" for r in registry.collect()}
    books: dict[str, dict] = {r.entity: {"title": r.title, "author": r.author, "stats": {}} for r in works.orderBy(F.lower("title")).collect()}
    for r in long.collect():
        if r.entity in books and r.metric in ids:
            if r.value is not None and not math.isfinite(r.value):
                raise ValueError(f"{r.entity}: {r.metric} is not finite")
            books[r.entity]["stats"][ids[r.metric]] = r.value
    return json.dumps({"books": list(books.values())}, ensure_ascii=False)


def radar_svg(radii: DataFrame, size: int = 400) -> str:
    """One polygon per entity from entity, axis, metric, radius."""
    held: dict[str, list] = {}
    for r in radii.orderBy("entity", "axis").collect():
        held.setdefault(r.entity, []).append((r.metric, r.radius))
    c, scale, shapes = size / 2, size * 0.4, []
    for k, (name, axes) in enumerate(held.items()):
        angle = [2 * math.pi * i / len(axes) - math.pi / 2 for i in range(len(axes))]
        points = " ".join(f"{c + scale * v * math.cos(a):.1f},{c + scale * v * math.sin(a):.1f}" for a, (_, v) in zip(angle, axes))
        shapes.append(f'<polygon points="{points}" fill="none" stroke="hsl({47 * k % 360},60%,45%)"><title>{escape(name)}</title></polygon>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {size} {size}">{"".join(shapes)}</svg>'


def bars_svg(values: list[tuple[str, float]], width: int = 600) -> str:
    """Horizontal bars, ascending."""
    top = max((v for _, v in values), default=0) or 1
    rows = [f'<text x="4" y="{24 * i + 17}">{escape(n)}</text><rect x="160" y="{24 * i + 4}" width="{(width - 170) * v / top:.1f}" height="16"/>' for i, (n, v) in enumerate(sorted(values, key=lambda x: x[1]))]
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {24 * len(values) + 8}">{"".join(rows)}</svg>'


def structure_report(signatures: DataFrame) -> str:
    """Markdown of unit, roles and eligibility (frames of one document)."""
    return markdown_table(["#", "Structure", "Admissible"], [[r.unit + 1, r.roles, "oui" if r.eligible else "non"] for r in signatures.orderBy("unit").collect()])


def evolution(scaled: DataFrame, works: DataFrame) -> DataFrame:
    """Dated works in order: entity, published, metric, scaled. works: entity, publication_date."""
    date = F.coalesce(F.try_to_date("publication_date"), F.try_to_date(F.substring("publication_date", 1, 4), "yyyy"))
    return scaled.join(works.select("entity", date.alias("published")), "entity").where("published is not null").orderBy("published", "entity", "metric")


# ---- sources in the order of comparisons ---------------------------------------------
def machine_made(author: Column, role: Column | None = None) -> Column:
    """Whether a text is a machine's: its author is `IA`, or its role `assistant`."""
    by = F.coalesce(F.lower(F.trim(author)) == "ia", F.lit(False))
    return by if role is None else by | F.coalesce(F.lower(role) == "assistant", F.lit(False))


def shown_name(title: Column, author: Column) -> Column:
    """The title, marked where a machine wrote it."""
    return F.when(machine_made(author) & ~F.startswith(title, F.lit("IA — ")), F.concat(F.lit("IA — "), title)).otherwise(title)


def in_order(works: DataFrame) -> DataFrame:
    """works (entity, title, author) with n: machines' texts first, then by the name shown."""
    order = Window.partitionBy(F.lit(1)).orderBy(~machine_made(F.col("author")), F.lower(shown_name(F.col("title"), F.col("author"))), "entity")  # one row a work
    return works.withColumn("n", F.row_number().over(order))


# ---- reports of one text ---------------------------------------------------------------
POS_LABELS = {"pos_common_noun_ratio": "Noms communs", "pos_proper_noun_ratio": "Noms propres", "pos_verb_ratio": "Verbes", "pos_adjective_ratio": "Adjectifs", "pos_adverb_ratio": "Adverbes"}


def text_report(name: str, noted: DataFrame, important: list[str]) -> str:
    """Markdown of one text's measures (metric, value, note; one row a measure): the important ones, the details, parts of speech, and the notes that they refer to."""
    rows = {r.metric: r for r in noted.orderBy("metric").collect()}
    order = [m for m in important if m in rows] + sorted(m for m in rows if m not in important and m not in POS_LABELS)
    numbers = {m: k + 1 for k, m in enumerate(m for m in order if rows[m].note)}
    line = lambda m: [f"{m}[^{numbers[m]}]" if m in numbers else m, rows[m].value]
    first, rest = [line(m) for m in order if m in important], [line(m) for m in order if m not in important]
    shares = [[label, f"{rows[m].value * 100:.1f} %" if m in rows and rows[m].value is not None else None] for m, label in POS_LABELS.items()]
    parts = [f"# Statistiques — {name}", "## Synthèse", markdown_table(["Mesure", "Valeur"], first), "## Détails", markdown_table(["Mesure", "Valeur"], rest)]
    parts += ["## Répartition grammaticale", markdown_table(["Catégorie", "Part"], shares), "\n".join(f"[^{k}]: {rows[m].note}" for m, k in numbers.items())]
    return "\n\n".join(p for p in parts if p)


def lemma_report(docs: DataFrame, annotations: DataFrame) -> DataFrame:
    """doc_id, report: each text with its words as lemmas, repeated ones in bold. annotations: doc_id, pos, lemma, repeated, of words of two letters or more."""
    shown = F.when(F.col("repeated"), F.concat(F.lit("**"), "lemma", F.lit("**"))).otherwise(F.col("lemma"))
    words = annotations.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", shown.alias("s")))).alias("words")).select("doc_id", F.col("words.s").alias("words"))
    gaps = docs.select("doc_id", F.split("text", rf"{T.W}{{2,}}", -1).alias("gaps")).join(words, "doc_id", "left")
    said = F.zip_with("gaps", "words", lambda g, s: F.concat(g, F.coalesce(s, F.lit(""))))
    said = F.when(F.col("words").isNull(), F.col("gaps")).otherwise(said)
    return gaps.select("doc_id", F.array_join(said, "").alias("report"))


def pies_svg(shares: DataFrame, size: int = 240) -> str:
    """One pie per entity of its parts of speech: entity and the five ratios (one row a work)."""
    rows = shares.orderBy("entity").collect()
    out = []
    for k, r in enumerate(rows):
        x, y, radius, turn = size * (k % 3) + size / 2, size * (k // 3) + size / 2 + 12, size * 0.36, -math.pi / 2
        out.append(f'<text x="{x}" y="{y - radius - 8:.0f}" text-anchor="middle">{escape(r.entity)}</text>')
        for n, m in enumerate(POS_LABELS):
            share = r[m] or 0.0
            end = turn + 2 * math.pi * min(share, 0.99999)
            a, b = ((x + radius * math.cos(t), y + radius * math.sin(t)) for t in (turn, end))
            out.append(f'<path d="M{x} {y}L{a[0]:.2f} {a[1]:.2f}A{radius:.1f} {radius:.1f} 0 {int(share > 0.5)} 1 {b[0]:.2f} {b[1]:.2f}Z" fill="hsl({70 * n},50%,50%)"><title>{POS_LABELS[m]} {share * 100:.0f} %</title></path>')
            turn = end
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {3 * size} {size * (len(rows) + 2) // 3 + 24}">{"".join(out)}</svg>'


def read_payload(spark: SparkSession, path: str, registry: DataFrame) -> DataFrame:
    """entity (title), author, metric, value of the explorer's JSON."""
    book = "struct<title:string,author:string,stats:map<string,double>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<books:array<{book}>>")["books"]).alias("b"))
    cells = rows.select(F.col("b.title").alias("entity"), "b.author", F.explode("b.stats").alias("key", "value"))
    return cells.join(registry.select("metric", F.concat(F.lit("mesure_"), F.col("metric_id").cast("string")).alias("key")), "key").select("entity", "author", "metric", "value")
