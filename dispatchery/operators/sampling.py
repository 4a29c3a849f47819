"""Seeded, repeatable selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchery.functions.hashing import scatter


def hash_sample(df: DataFrame, id_col: str, size: int, seed: int = 0) -> DataFrame:
    """The first `size` rows by seeded scatter of the id, then id."""
    return df.withColumn("scatter", scatter(F.col(id_col), seed)).orderBy("scatter", id_col).limit(size)


def stratified_sample(
    stories: DataFrame, keys: list[str], id_col: str, published: Column, size: int, seed: int | Column = 0
) -> DataFrame:
    """`size` rows per group: the published first, then a seeded draw; a draw among the published
    where they alone exceed the size. The planner limits each group before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("_out"), F.asc("_h"), F.asc(id_col))
    return (
        stories.withColumn("_out", published).withColumn("_h", scatter(F.col(id_col), seed))
        .withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= size)
        .drop("_out", "_h", "_k")
    )
