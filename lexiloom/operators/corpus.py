"""Corpus analytics over a long table of measures: entity, metric, value.

Statistics per metric are aggregates joined back on the metric. Distances carry
each entity's z-scores as one array, so that a pair is one row. Comparing all
pairs is quadratic in entities by definition (books or authors, not tokens).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config


def long_view(wide: DataFrame, entity: str, metrics: list[str]) -> DataFrame:
    return wide.select(F.col(entity).alias("entity"), *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot("entity", metrics, "metric", "value")


def dispersion(long: DataFrame) -> DataFrame:
    """metric, sigma: population deviation in percent of the mean, without Tukey outliers where that leaves three values; null for a mean of 0."""
    known = long.where("value is not null and not isnan(value)")
    q = known.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.percentile("value", F.lit(0.25)).alias("q1"), F.percentile("value", F.lit(0.75)).alias("q3"))
    inside = F.col("value").between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    rows = known.join(q, "metric").withColumn("inside", (F.col("n") < 4) | inside)
    kept = lambda f, c: f(F.when(c, F.col("value")))
    out = rows.groupBy("metric").agg(F.count(F.when(F.col("inside"), 1)).alias("k"), kept(F.avg, F.col("inside")).alias("m1"), kept(F.stddev_pop, F.col("inside")).alias("s1"), F.avg("value").alias("m0"), F.stddev_pop("value").alias("s0"))
    few = F.col("k") < 3
    mean, sd = F.when(few, F.col("m0")).otherwise(F.col("m1")), F.when(few, F.col("s0")).otherwise(F.col("s1"))
    return out.select("metric", F.when(mean != 0, sd / F.abs(mean) * 100).alias("sigma"))


def zscores(long: DataFrame, metrics: list[str]) -> DataFrame:
    """entity, z: z-scores over the corpus (population deviation), null for missing or constant measures."""
    stats = long.where("value is not null").groupBy("metric").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = long.where(F.col("metric").isin(metrics)).join(stats, "metric", "left").withColumn("z", F.when(F.col("s") > 1e-12, (F.col("value") - F.col("m")) / F.col("s")))
    return z.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("metric", "z"))).alias("by")).select("entity", F.array(*(F.element_at("by", F.lit(m)) for m in metrics)).alias("z"))


def delta(a: Column, b: Column) -> Column:
    """Mean absolute difference over the measures that both have."""
    parts = F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d.isNotNull())
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, d: s + d) / F.size(parts))


def burrows(long: DataFrame, metrics: list[str] | None = None, block: int = 2000) -> DataFrame:
    """left, right (left < right), distance, for all pairs of entities.

    The pairs are the result, so their number is what it is; entities are dealt into blocks of
    about `block`, and a task meets two blocks at a time by an equi join.
    """
    z = zscores(long, list(metrics or config.BURROWS_FIELDS))
    blocks = max(1, -(-long.select("entity").distinct().count() // block))
    dealt = z.withColumn("own", F.pmod(F.xxhash64("entity"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = dealt.select("entity", "z", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    a, b = met.alias("a"), met.alias("b")
    once = (F.col("a.own") != F.col("b.own")) | (F.col("a.i") == F.col("a.j"))
    pairs = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))).where((F.col("a.entity") < F.col("b.entity")) & once)
    return pairs.select(F.col("a.entity").alias("left"), F.col("b.entity").alias("right"), delta(F.col("a.z"), F.col("b.z")).alias("distance"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("right").alias("left"), F.col("left").alias("right"), "distance"))


def nearest(pairs: DataFrame, sources: DataFrame, targets: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest targets (entity) of every source (entity), by distance and name."""
    chosen = both_ways(pairs).join(sources.select(F.col("entity").alias("left")), "left").join(targets.select(F.col("entity").alias("right")), "right")
    rank = F.row_number().over(Window.partitionBy("left").orderBy("distance", "right"))
    return chosen.withColumn("rank", rank).where(F.col("rank") <= k).select("left", "right", "distance", "rank")


def singularity(pairs: DataFrame) -> DataFrame:
    return both_ways(pairs).groupBy("left").agg(F.min("distance").alias("nearest")).withColumnRenamed("left", "entity")


RANGES = 4096


def shares_at_least(values: DataFrame) -> DataFrame:
    """values: d, c (how often). Adds percentile: the share, in percent, of all that are at least d.

    A histogram of RANGES ranges gives what lies above a range; the running count is taken
    within each range, so that no task sorts all values.
    """
    low, high, total = values.agg(F.min("d"), F.max("d"), F.sum("c")).first()  # three numbers
    width = ((high or 0.0) - (low or 0.0)) / RANGES or 1.0
    ranged = values.withColumn("range", F.least(F.lit(RANGES - 1), F.floor((F.col("d") - F.lit(low or 0.0)) / F.lit(width)).cast("int")))
    counts = ranged.groupBy("range").agg(F.sum("c").alias("n"))  # at most RANGES rows
    above = counts.select("range", (F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy(F.desc("range"))) - F.col("n")).alias("above"))
    own = F.sum("c").over(Window.partitionBy("range").orderBy(F.desc("d")).rangeBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("own", own).join(F.broadcast(above), "range").select("d", (100.0 * (F.col("above") + F.col("own")) / F.lit(total or 1)).alias("percentile"))


def neighbourhood(pairs: DataFrame, corpus_pairs: DataFrame | None = None, top: int | None = None, pinned: DataFrame | None = None) -> DataFrame:
    """left, right, distance, percentile (share of corpus pairs at least as far, in percent), rank.

    top: only the first so many of every left stay, and the rows of `pinned` (left, right), wherever they rank.
    """
    reference = (corpus_pairs or pairs).select(F.round("distance", 12).alias("d")).where("d is not null").groupBy("d").agg(F.count(F.lit(1)).alias("c"))
    rows = both_ways(pairs).withColumn("d", F.round("distance", 12)).join(shares_at_least(reference), "d")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("left").orderBy(F.desc("percentile"), "distance", "right"))).select("left", "right", "distance", "percentile", "rank")
    if top is None:
        return rows
    if pinned is None:
        return rows.where(F.col("rank") <= top)
    marked = rows.join(pinned.select("left", "right").distinct().withColumn("pin", F.lit(True)), ["left", "right"], "left")
    return marked.where((F.col("rank") <= top) | F.col("pin")).drop("pin")


def podium(neighbours: DataFrame, authors: DataFrame, k: int = 5) -> DataFrame:
    """Per entity: authors (last word of the name) among its k nearest, by mean percentile. authors: entity, author."""
    surname = F.element_at(F.split(F.trim("author"), r"\s+"), -1)
    top = neighbours.where(F.col("rank") <= k).join(authors.select(F.col("entity").alias("right"), surname.alias("surname")), "right")
    means = top.groupBy("left", "surname").agg(F.count(F.lit(1)).alias("works"), F.avg("percentile").alias("percentile"))
    return means.withColumn("place", F.row_number().over(Window.partitionBy("left").orderBy(F.desc(F.round("percentile", 9)), "surname")))  # means of equal shares differ in their last digits


def radar(long: DataFrame, axes: list[tuple[str, bool]]) -> DataFrame:
    """entity, axis, metric, radius: 0.05 to 1 around the corpus mean; axes: (metric, inverse); an axis with a missing value or mean 0 is left out."""
    order = F.create_map(*(F.lit(x) for i, (m, _) in enumerate(axes) for x in (m, i)))
    sign = F.create_map(*(F.lit(x) for m, inverse in axes for x in (m, -1.0 if inverse else 1.0)))
    own = long.where(F.col("metric").isin([m for m, _ in axes]))
    stats = own.groupBy("metric").agg(F.avg("value").alias("m"), F.count("value").alias("k"), F.count(F.lit(1)).alias("n")).where("k = n and m <> 0")
    off = F.element_at(sign, F.col("metric")) * (F.col("value") - F.col("m")) / F.abs("m")
    rows = own.join(stats, "metric").select("entity", "metric", F.element_at(order, F.col("metric")).alias("o"), F.greatest(F.lit(0.05), F.least(F.lit(1.0), 0.5 + 1.25 * off)).alias("radius"))
    return rows.withColumn("axis", F.row_number().over(Window.partitionBy("entity").orderBy("o")) - 1).drop("o")


def polygon_area(radii: DataFrame, radius: str = "radius") -> DataFrame:
    """Area of each entity's polygon on evenly spread axes (0 below three)."""
    order = Window.partitionBy("entity").orderBy("axis")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = F.coalesce(F.lead(radius).over(order), F.first(radius).over(whole))
    rows = radii.select("entity", (F.col(radius) * nxt).alias("p"))
    n = F.count(F.lit(1))
    return rows.groupBy("entity").agg(F.when(n >= 3, F.abs(F.sum("p")) * F.sin(2 * F.pi() / n) / 2).otherwise(0.0).alias("area"))


def ascending(rows: DataFrame, value: str) -> DataFrame:
    """rows (entity, value) with place: the smallest value first, names at a tie."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.round(value, 9), "entity")))  # one row an entity


def scaled(long: DataFrame, flipped: tuple[str, ...] = ()) -> DataFrame:
    """entity, metric, scaled: corpus minimum to maximum, log-curved to 0..100; 50 for a constant measure."""
    known = long.where("value is not null")
    stats = known.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("k"))
    rel = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    rel = F.when(F.col("metric").isin(*flipped), 1 - rel).otherwise(rel) if flipped else rel
    out = F.when((F.col("k") < 2) | (F.col("hi") == F.col("lo")), 50.0).otherwise(F.log1p(4 * rel) / F.log1p(F.lit(4.0)) * 100)
    return known.join(stats, "metric").select("entity", "metric", out.alias("scaled"))


def coverage(scaled_rows: DataFrame) -> DataFrame:
    """entity, coverage: polygon area of scaled values, the largest being 100."""
    axis = F.row_number().over(Window.partitionBy("entity").orderBy("metric")) - 1
    area = polygon_area(scaled_rows.withColumn("axis", axis), "scaled")
    top = F.broadcast(area.agg(F.max("area").alias("top")))  # one row
    return area.crossJoin(top).select("entity", F.when(F.col("top") > 0, F.col("area") / F.col("top") * 100).otherwise(0.0).alias("coverage"))


def author_summary(long: DataFrame, authors: DataFrame) -> DataFrame:
    """author, metric, low, median, high, mean. authors: entity, author."""
    rows = long.where("value is not null").join(authors, "entity")
    return rows.groupBy("author", "metric").agg(F.min("value").alias("low"), F.percentile("value", F.lit(0.5)).alias("median"), F.max("value").alias("high"), F.avg("value").alias("mean"))


def profile_limits(scaled_rows: DataFrame) -> DataFrame:
    """metric, low, median (the lower one), high of scaled values, at least 10."""
    lower = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY scaled)")
    at = lambda c: F.greatest(F.lit(10.0), c)
    return scaled_rows.groupBy("metric").agg(at(F.min("scaled")).alias("low"), at(lower).alias("median"), at(F.max("scaled")).alias("high"))


def web_view(wide: DataFrame) -> DataFrame:
    """The view that the explorer compares: 1 - pressure, relative and subordinate clauses together, noun/verb ratio filled in."""
    out = wide
    if "stylistic_repetition_rate" in wide.columns:
        out = out.withColumn("stylistic_repetition_rate", 1 - F.coalesce("stylistic_repetition_rate", F.lit(0.0)))
    if {"relative_clause_ratio", "subordinate_clause_ratio"} <= set(wide.columns):
        out = out.withColumn("relative_clause_ratio", F.coalesce("relative_clause_ratio", F.lit(0.0)) + F.coalesce("subordinate_clause_ratio", F.lit(0.0)))
    if {"noun_verb_ratio", "noun_ratio", "verb_ratio"} <= set(wide.columns):
        out = out.withColumn("noun_verb_ratio", F.coalesce("noun_verb_ratio", F.when(F.coalesce("verb_ratio", F.lit(0.0)) != 0, F.coalesce("noun_ratio", F.lit(0.0)) / F.col("verb_ratio")).otherwise(0.0)))
    return out


MAP_ENTITIES = 5_000


def mds(pairs: DataFrame) -> DataFrame:
    """entity, x, y, stress, medoid: classical scaling of all distances, by one task: the matrix is dense by definition. More than MAP_ENTITIES entities are refused."""
    n = pairs.select(F.explode(F.array("left", "right")).alias("e")).distinct().count()
    if n > MAP_ENTITIES:
        raise ValueError(f"a map of {n} entities: choose {MAP_ENTITIES} or fewer")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["left"]) | set(pdf["right"]))
        at = {n: i for i, n in enumerate(names)}
        d = np.zeros((len(names), len(names)))
        for a, b, v in zip(pdf["left"], pdf["right"], pdf["distance"]):
            d[at[a], at[b]] = d[at[b], at[a]] = 0.0 if v is None or np.isnan(v) else v
        j = np.eye(len(names)) - 1 / len(names)
        val, vec = np.linalg.eigh(-0.5 * j @ (d**2) @ j)
        pick = np.argsort(val)[::-1][:2]
        xy = vec[:, pick] * np.sqrt(np.maximum(val[pick], 0))
        xy = xy * np.where(np.sum(xy**3, axis=0) < 0, -1.0, 1.0)  # a sign that does not depend on the solver
        proj = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
        upper = np.triu_indices(len(names), 1)
        total = (d[upper] ** 2).sum()
        stress = float(np.sqrt(((d[upper] - proj[upper]) ** 2).sum() / total)) if total else 0.0
        medoid = int(np.argmin(proj.sum(1)))
        return pd.DataFrame({"entity": names, "x": xy[:, 0], "y": xy[:, 1] if xy.shape[1] > 1 else 0.0, "stress": stress, "medoid": [i == medoid for i in range(len(names))]})

    return pairs.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(lambda pdf: run(pdf), "entity string, x double, y double, stress double, medoid boolean")


def canonical_authors(authors: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """author, canonical: two-word names that reverse each other become the preferred or first seen form. authors: author, seen (order)."""
    first = authors.where(F.trim("author") != "").groupBy(F.trim("author").alias("author")).agg(F.min("seen").alias("seen"))
    parts = F.split("author", r"\s+")
    turned = F.when(F.size(parts) == 2, F.concat_ws(" ", F.reverse(parts)))
    rows = first.withColumn("turned", turned)
    other = first.select(F.col("author").alias("turned"), F.col("seen").alias("other_seen"))
    rows = rows.join(other, "turned", "left")
    earlier = F.coalesce(F.col("other_seen") < F.col("seen"), F.lit(False))
    choice = F.when(earlier, F.col("turned")).otherwise(F.col("author"))
    if preferred is not None:
        p = preferred.select(F.col("author").alias("p")).distinct()
        rows = rows.join(p.withColumnRenamed("p", "p1"), F.col("author") == F.col("p1"), "left").join(p.withColumnRenamed("p", "p2"), F.col("turned") == F.col("p2"), "left")
        choice = F.when(F.col("p1").isNotNull(), F.col("author")).when(F.col("p2").isNotNull(), F.col("turned")).otherwise(choice)
    return rows.select("author", choice.alias("canonical"))
