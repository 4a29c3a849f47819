"""Positions inside groups that may be very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of one bucket beyond which its ties are cut; one row in EVERY, chosen by its hash, is a possible border.
HOT, EVERY, CUTS = 1 << 18, 1 << 12, 255


def numbered(
    df: DataFrame, keys: list[str], order: list[Column], bucket: list[Column], name: str = "position",
    ties: list[Column] | None = None, hot: int = HOT, every: int = EVERY,
) -> DataFrame:
    """`row_number` per `keys`, in levels so that one hot group spreads over many tasks.

    `bucket` holds coarse columns that sort the same way as a prefix of `order`: rows are numbered
    inside (keys, bucket), and each bucket starts where the counts of the buckets before it end.
    The bucket counts are combined map-side; only those are windowed per group.

    `ties` holds columns that, ascending and nulls first, sort a bucket's rows as `order` does. With
    them a bucket of more than `hot` rows, such as one date that a third of all rows share, is cut at
    borders drawn from its own rows. Borders move no position, they only part the work; being chosen
    by hash, a task that runs again draws the same ones.
    """
    names = [f"_b{i}" for i in range(len(bucket))]
    split = df.withColumns(dict(zip(names, bucket)))
    if ties:
        split = _cut_ties(split.withColumn("_tie", F.struct(*ties)), keys + names, hot, every)
        names.append("_cut")
    counts = split.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *keys, *names, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    joined = split.alias("l").join(starts.alias("r"), on=_same(keys + names))
    return joined.select(
        "l.*", (F.col("r._start") + F.row_number().over(
            Window.partitionBy(*[F.col(f"l.{c}") for c in keys + names]).orderBy(*order)
        )).alias(name)
    ).drop(*names)


def _same(columns: list[str]) -> list[Column]:
    return [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns]


def _cut_ties(split: DataFrame, group: list[str], hot: int, every: int) -> DataFrame:
    """`split` without `_tie`, with `_cut`: how many borders of its bucket a row lies beyond, 0 in buckets that are not hot."""
    drawn = F.sort_array(F.collect_list(F.when(F.pmod(F.xxhash64("_tie"), F.lit(every)) == 0, F.col("_tie"))))
    borders = (
        split.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), drawn.alias("_drawn")).where(F.col("_n") > hot)
        .withColumn("_step", F.ceil(F.size("_drawn") / F.lit(CUTS)))
        .select(*group, F.filter("_drawn", lambda _, i: i % F.col("_step") == 0).alias("_borders"))
    )
    beyond = F.size(F.filter("r._borders", lambda border: border < F.col("l._tie")))
    return split.alias("l").join(borders.alias("r"), _same(group), "left").select(
        "l.*", F.when(F.col("r._borders").isNotNull(), beyond).otherwise(F.lit(0)).alias("_cut")
    ).drop("_tie")


def latest(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """The row of each key that is greatest by `order`; combined map-side, so hot keys are safe."""
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*columns), order).alias("_row")
    ).select(*keys, "_row.*")


def earliest(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*columns), order).alias("_row")
    ).select(*keys, "_row.*")
