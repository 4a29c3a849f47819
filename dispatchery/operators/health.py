"""Source health and daily budgets from logs in time order.

A hot source can hold a third of a log, so every running value is taken in two levels: inside
(source, hour) buckets, and over the few bucket totals of each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchery import constants as K


def poll_states(polls: DataFrame) -> DataFrame:
    """Each poll with `streak` (failures in a row up to it) and `kept_etag` (last one sent).

    The streak is the running count of failures less that count at the last success.
    """
    split = polls.withColumn("_hour", F.date_trunc("hour", "ts"))
    inside = Window.partitionBy("source_id", "_hour").orderBy("ts", "poll_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    failed = (~F.col("ok")).cast("bigint")
    rows = split.withColumn("_fails", F.sum(failed).over(inside)).withColumns({
        "_base": F.last(F.when(F.col("ok"), F.col("_fails")), ignorenulls=True).over(inside),
        "_etag": F.last("etag", ignorenulls=True).over(inside),
    })
    at = F.struct("ts", "poll_id")
    hours = rows.groupBy("source_id", "_hour").agg(
        F.max("_fails").alias("h_fails"),
        F.max("_base").alias("h_base"),
        F.max_by("_etag", at).alias("h_etag"),
    )
    before = Window.partitionBy("source_id").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = hours.withColumn("in_fails", F.coalesce(F.sum("h_fails").over(before), F.lit(0))).withColumns({
        "in_base": F.last(F.col("in_fails") + F.col("h_base"), ignorenulls=True).over(before),
        "in_etag": F.last("h_etag", ignorenulls=True).over(before),
    }).select("source_id", "_hour", "in_fails", "in_base", "in_etag")
    base = F.coalesce(F.col("in_fails") + F.col("_base"), F.col("in_base"), F.lit(0))
    return rows.join(carried, ["source_id", "_hour"]).select(
        *polls.columns,
        (F.col("in_fails") + F.col("_fails") - base).alias("streak"),
        F.coalesce("_etag", "in_etag").alias("kept_etag"),
    )


def source_health(states: DataFrame, limit: int = K.MAX_FAILURES) -> DataFrame:
    """Per source: polls, failures, items, worst and current streak, validator, enabled."""
    at = F.struct("ts", "poll_id")
    return states.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("polls"),
        F.count_if(~F.col("ok")).alias("failures"),
        F.count_if("unchanged").alias("unchanged"),
        F.coalesce(F.sum(F.when(F.col("ok") & ~F.col("unchanged"), F.col("items"))), F.lit(0)).alias("items"),
        F.max("streak").alias("worst_streak"),
        F.max_by("streak", at).alias("streak"),
        F.max_by("kept_etag", at).alias("etag"),
        F.max("ts").alias("last_polled_at"),
    ).withColumn("enabled", F.col("worst_streak") < limit)


def batch_health(polls: DataFrame) -> DataFrame:
    """What a batch of polls adds to each source's state, in a form that states can be joined with.

    `lead_failures` are those before the batch's first success (all, where it has none).
    """
    states = poll_states(polls)
    first = polls.where("ok").groupBy("source_id").agg(F.min(F.struct("ts", "poll_id")).alias("_first_ok"))
    health = source_health(states)
    lead = polls.join(first, "source_id", "left").where(
        F.col("_first_ok").isNull() | (F.struct("ts", "poll_id") < F.col("_first_ok"))
    ).groupBy("source_id").agg(F.count_if(~F.col("ok")).alias("lead_failures"))
    succeeded = first.select("source_id", F.lit(True).alias("succeeded"))
    return health.drop("enabled").join(lead, "source_id", "left").join(succeeded, "source_id", "left").na.fill(
        {"lead_failures": 0, "succeeded": False}
    )


def merge_health(state: DataFrame, batch: DataFrame, limit: int = K.MAX_FAILURES) -> DataFrame:
    """Stored health with one more batch of later polls taken in."""
    counts = ("polls", "failures", "unchanged", "items")
    s = state.select("source_id", *[F.col(c).alias(f"s_{c}") for c in state.columns if c != "source_id"])
    joined = s.join(batch, "source_id", "full")
    zero = F.lit(0)
    carried = F.coalesce("s_streak", zero)
    lead_streak = F.when(F.col("lead_failures") > 0, carried + F.col("lead_failures")).otherwise(zero)
    streak = (
        F.when(F.col("polls").isNull(), F.col("s_streak"))
        .when(F.col("succeeded"), F.col("streak")).otherwise(carried + F.col("streak"))
    )
    worst = F.greatest(F.coalesce("s_worst_streak", zero), F.coalesce("worst_streak", zero), F.coalesce(lead_streak, zero))
    return joined.select(
        "source_id",
        *[(F.coalesce(f"s_{c}", zero) + F.coalesce(c, zero)).alias(c) for c in counts],
        worst.alias("worst_streak"), streak.alias("streak"),
        F.coalesce("etag", "s_etag").alias("etag"),
        F.greatest("last_polled_at", "s_last_polled_at").alias("last_polled_at"),
        (worst < limit).alias("enabled"),
    )


def reenable(state: DataFrame, ids: DataFrame) -> DataFrame:
    """Switching a source back on clears its strikes."""
    chosen = ids.select("source_id", F.lit(True).alias("_on"))
    on = F.coalesce("_on", F.lit(False))
    return state.join(chosen, "source_id", "left").withColumns({
        "streak": F.when(on, F.lit(0)).otherwise(F.col("streak")),
        "worst_streak": F.when(on, F.lit(0)).otherwise(F.col("worst_streak")),
        "enabled": F.when(on, F.lit(True)).otherwise(F.col("enabled")),
    }).drop("_on")


def collect_stats(polls: DataFrame) -> DataFrame:
    return polls.agg(
        F.count_distinct("source_id").alias("sources"),
        F.coalesce(F.sum(F.when(F.col("ok") & ~F.col("unchanged"), F.col("items"))), F.lit(0)).alias("seen"),
        F.count_if("unchanged").alias("unchanged"), F.count_if(~F.col("ok")).alias("failed"),
    )


def granted(requests: DataFrame, at: Column, id_col: str, cap: int | Column = K.SEARCH_DAILY_CAP) -> DataFrame:
    """Requests with `day` and `granted`: the first `cap` of a UTC day, in arrival order.

    Only the `cap` rows that open a day are numbered: the planner limits every task's share of a
    day before the shuffle. Each day's last granted arrival is then compared with every request.
    """
    dated = requests.withColumn("day", F.date_format(at, "yyyy-MM-dd")).withColumn(
        "_at", F.struct(at.alias("t"), F.col(id_col).alias("i"))
    )
    order = Window.partitionBy("day").orderBy("_at")
    last = (
        dated.select("day", "_at").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= cap)
        .groupBy("day").agg(F.max("_at").alias("_last"))
    )
    return dated.join(last, "day", "left").withColumn(
        "granted", F.coalesce(F.col("_at") <= F.col("_last"), F.lit(False))
    ).drop("_at", "_last")
