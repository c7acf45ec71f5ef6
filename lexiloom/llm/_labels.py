"""Bounded, deterministic training samples of labelled rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _rows


def sample_ids(labelled: DataFrame, label_col: str, labels: list, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """s_id, label: at most per_class ids of each label, in the order of a hash of the id; an id of several labels counts by the largest."""
    known = labelled.where(_rows.named(id_col).isNotNull() & _rows.named(label_col).isin(labels))
    one = known.groupBy(_rows.named(id_col).cast("long").alias("s_id")).agg(F.max(_rows.named(label_col)).alias("label"))
    parts = [one.where(F.col("label") == v).orderBy(F.xxhash64("s_id"), F.col("s_id")).limit(per_class) for v in labels]
    return functools.reduce(DataFrame.unionByName, parts)


def training_sample(docs: DataFrame, labelled: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, label (0/1), text of at most per_class labelled ids of each class.

    Rows without an id or label do not count; of an id that stands in several
    rows the text with the smallest digest counts, so that there are at most
    2 * per_class rows. The ids, as many, are broadcast.
    """
    ids = sample_ids(labelled.select(_rows.named(id_col).alias("doc_id"), _rows.named(label_col).cast("int").alias("label")), "label", [0, 1], per_class)
    rows = docs.select(_rows.named(id_col).cast("long").alias("doc_id"), F.coalesce(_rows.named(text_col), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("s_id"))
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
