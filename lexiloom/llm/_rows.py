"""The user's rows as one struct column, so that no name of an operator's own can meet a name of the user's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def held(docs: DataFrame) -> DataFrame:
    """docs as one column, `row`."""
    return docs.select(F.struct(*(named(c) for c in docs.columns)).alias("row"))


def field(name: str) -> Column:
    return F.col("row").getField(name)


def one_of(rows: DataFrame, *keys: str) -> DataFrame:
    """One of the rows that share the keys: that with the smallest digest of its whole content, whatever the order of the input. Rows combine before the shuffle."""
    return rows.groupBy(*keys).agg(F.min_by("row", F.sha2(F.to_json(F.struct("row")), 256)).alias("row")).select("row")


def released(rows: DataFrame) -> DataFrame:
    """The user's columns again."""
    return rows.select("row.*")
