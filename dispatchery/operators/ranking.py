"""Several readings of a day, aggregated into one published order.

`picks` has the group keys plus (pass, position, summary_id, tier, reason); `keys` names the group,
such as ["day"] or ["day", "version"]. A reading keeps at most `top_n` stories, so a group holds at
most passes * top_n rows whatever the size of the pool behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchery import constants as K
from dispatchery.functions.hashing import scatter
from dispatchery.functions.text import literal_array, present, strip
from dispatchery.operators.numbering import numbered
from dispatchery.session import cut


def band(position: Column) -> Column:
    """A place in an order, as the tier it would have been."""
    return (
        F.when(position == 1, "lead")
        .when(position <= 4, "major")
        .when(position <= 9, "notable")
        .otherwise("brief")
    )


def tier_rank(tier: Column) -> Column:
    """0 for the strongest tier, 3 for the weakest."""
    return F.array_position(literal_array(K.TIERS), tier).cast("int") - 1


def survivor_order() -> list[Column]:
    """Heaviest source first, then earliest published, then id."""
    return [F.desc("weight"), F.asc_nulls_last("published_at"), F.asc("article_id")]


def survivor_ties() -> list[Column]:
    """The same order inside a weight and either dated or undated rows, as `numbered` takes ties."""
    return [F.col("published_at"), F.col("article_id")]


def day_pool(
    summaries: DataFrame, articles: DataFrame, sources: DataFrame, published: DataFrame,
    now: Column, language: str = "en", max_age_days: int = K.MAX_AGE_DAYS,
) -> DataFrame:
    """Every (day, summary) a day's bulletin may draw on, for each day in `published`' calendar.

    `summaries` carries the `day` asked about; `published` is (summary_id, day) of what is out. A
    summary out on another day is recognised by its first and last published day, so no pair of
    days is ever joined.
    """
    elsewhere = published.groupBy("summary_id").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )
    stamp = F.coalesce(F.col("published_at"), F.col("fetched_at"))
    return (
        summaries.where((F.col("language") == language) & F.col("relevant"))
        .join(
            articles.where(F.col("dup_of").isNull()).select(
                F.col("id").alias("article_id"), "source_id", "published_at", "fetched_at"
            ),
            "article_id",
        )
        .where(F.col("fetched_at") >= now - F.make_dt_interval(F.lit(max_age_days)))
        .join(sources.select(F.col("id").alias("source_id"), "name", "weight"), "source_id")
        .join(elsewhere, "summary_id", "left")
        .where(
            F.col("first_day").isNull()
            | ((F.col("first_day") == F.col("day")) & (F.col("last_day") == F.col("day")))
        )
        .select(
            "day", "summary_id", "article_id", F.col("name").alias("source"), "weight",
            "title_local", "summary", "why_it_matters", "importance", "kind", "published_at",
            ((F.unix_micros(now) - F.unix_micros(stamp)) / F.lit(3.6e9)).alias("age_hours"),
        )
    )


def arrangements(pool: DataFrame, keys: list[str], seed: int, passes: int = K.RANK_PASSES) -> DataFrame:
    """(keys, pass, ordinal, summary_id): pass 1 in survivor order, the rest scattered by seed.

    A pool has no size limit, so every numbering goes through buckets.
    """
    first = numbered(
        pool, keys, survivor_order(),
        [-F.col("weight"), F.col("published_at").isNull(), F.date_trunc("hour", "published_at")],
        "ordinal", survivor_ties(),
    ).select(*keys, F.lit(1).alias("pass"), "ordinal", "summary_id")
    shuffled = (
        pool.select(*keys, "summary_id")
        .withColumn("pass", F.explode(F.sequence(F.lit(2), F.lit(passes))))
        .withColumn("_h", scatter(F.col("summary_id") + 1, F.col("pass") + seed))
    )
    rest = numbered(
        shuffled, [*keys, "pass"], [F.asc("_h"), F.asc("summary_id")],
        [F.floor(F.col("_h") / 1000)], "ordinal",
    ).select(*keys, "pass", "ordinal", "summary_id")
    return first.unionByName(rest)


def valid_picks(
    answers: DataFrame, arranged: DataFrame, keys: list[str], top_n: int = K.TOP_N
) -> DataFrame:
    """Answers (keys, pass, nth, number, tier, reason) as picks of stories.

    Numbers outside the table are dropped by the join, a repeated number counts where it came
    first, and the first `top_n` that remain are kept.
    """
    group = [*keys, "pass"]
    first = answers.groupBy(*group, "number").agg(
        F.min_by(F.struct("nth", "tier", "reason"), "nth").alias("pick")
    )
    table = arranged.select(*group, F.col("ordinal").alias("number"), "summary_id")
    matched = first.join(table, [*group, "number"])
    order = Window.partitionBy(*group).orderBy("pick.nth")
    return (
        matched.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= top_n)
        .select(
            *group, "position", "summary_id", "pick.tier", strip(F.col("pick.reason")).alias("reason")
        )
    )


def borda(picks: DataFrame, keys: list[str], quorum: int = K.QUORUM) -> DataFrame:
    """(keys, summary_id, score, seen, best, position): points per place, kept by quorum."""
    # A group is a few short readings, so one shuffle by its keys serves both counts, the scores and
    # the order.
    sized = picks.withColumn(
        "passes", F.size(F.collect_set("pass").over(Window.partitionBy(*keys)))
    ).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(*keys, "pass")))
    scored = (
        sized.groupBy(*keys, "summary_id")
        .agg(
            F.sum(F.col("size") - F.col("position") + 1).alias("score"),
            F.count(F.lit(1)).alias("seen"),
            F.min("position").alias("best"),
            F.max("passes").alias("passes"),
        )
        .where(F.col("seen") >= F.least(F.col("passes"), F.lit(quorum)))
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("best"), F.asc("summary_id"))
    return scored.drop("passes").withColumn("position", F.row_number().over(order))


def majority_tiers(picks: DataFrame, order: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, summary_id, position, tier): most votes, ties to the weaker, one lead a group."""
    votes = picks.groupBy(*keys, "summary_id", "tier").agg(F.count(F.lit(1)).alias("votes"))
    chosen = votes.groupBy(*keys, "summary_id").agg(
        F.max_by("tier", F.struct("votes", tier_rank(F.col("tier")))).alias("voted")
    )
    placed = order.select(*keys, "summary_id", "position").join(chosen, [*keys, "summary_id"])
    leads = F.sum((F.col("voted") == "lead").cast("int")).over(
        Window.partitionBy(*keys).orderBy("position")
    )
    return placed.withColumn("_leads", leads).select(
        *keys, "summary_id", "position",
        F.when((F.col("voted") == "lead") & (F.col("_leads") > 1), "major")
        .otherwise(F.col("voted")).alias("tier"),
    )


def first_reasons(picks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, summary_id, reason): the reason of the earliest reading that gave one."""
    return (
        picks.where(present(F.col("reason")))
        .groupBy(*keys, "summary_id")
        .agg(F.min_by("reason", "pass").alias("reason"))
    )


def best_notes(picks: DataFrame, notes: DataFrame, order: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, editor_note): from the reading that overlaps the published set most."""
    overlap = (
        picks.select(*keys, "pass", "summary_id")
        .join(order.select(*keys, "summary_id", F.lit(1).alias("hit")), [*keys, "summary_id"], "left")
        .groupBy(*keys, "pass")
        .agg(F.count("hit").alias("overlap"))
    )
    return (
        overlap.join(notes, [*keys, "pass"])
        .groupBy(*keys)
        .agg(F.max_by("note", F.struct("overlap", -F.col("pass"))).alias("editor_note"))
    )


def pass_pairs(picks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pass_a, pass_b, tau, jaccard) for every pair of readings of a group.

    A reading is an array of at most `top_n` ids, so tau counts its pairs inside one row.
    """
    orders = picks.groupBy(*keys, "pass").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "summary_id"))),
            lambda s: s["summary_id"],
        ).alias("ids")
    )
    left = orders.select(*keys, F.col("pass").alias("pass_a"), F.col("ids").alias("a"))
    right = orders.select(*keys, F.col("pass").alias("pass_b"), F.col("ids").alias("b"))
    paired = left.join(right, keys).where(F.col("pass_a") < F.col("pass_b"))
    places = F.transform(
        F.filter("a", lambda x: F.array_contains(F.col("b"), x)),
        lambda x: F.array_position(F.col("b"), x),
    )
    paired = paired.withColumn("places", places).withColumn("n", F.size("places"))
    kept_order = F.aggregate(
        F.transform(
            F.col("places"),
            lambda x, i: F.size(
                F.filter(F.slice(F.col("places"), i + 2, F.col("n")), lambda y: y > x)
            ),
        ),
        F.lit(0),
        lambda total, x: total + x,
    )
    pairs = F.col("n") * (F.col("n") - 1) / F.lit(2.0)
    union = F.size(F.array_union("a", "b"))
    return paired.select(
        *keys, "pass_a", "pass_b",
        F.when(F.col("n") < 2, F.lit(0.0))
        .otherwise((2 * kept_order - pairs) / F.when(F.col("n") < 2, 1.0).otherwise(pairs))
        .alias("tau"),
        F.when(union == 0, F.lit(1.0))
        .otherwise(F.size(F.array_intersect("a", "b")) / F.nullif(union, F.lit(0)))
        .alias("jaccard"),
    )


def expected_jaccard(kept: Column, pool: Column) -> Column:
    """What two random selections of `kept` from `pool` share."""
    least = F.least(kept, pool)
    return F.when((pool <= 0) | (kept <= 0), F.lit(0.0)).otherwise(
        least / F.nullif(2 * pool - least, F.lit(0))
    )


def corrected_jaccard(observed: Column, kept: Column, pool: Column) -> Column:
    """Rescaled so that chance is 0 and identity is 1."""
    chance = expected_jaccard(kept, pool)
    return F.when(chance >= 1.0, F.lit(1.0)).otherwise(
        (observed - chance) / F.nullif(F.lit(1.0) - chance, F.lit(0.0))
    )


def agreement(picks: DataFrame, pools: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tau, jaccard, kept, pool, agreement); agreement is null below two readings."""
    sizes = (
        picks.groupBy(*keys, "pass").agg(F.count(F.lit(1)).alias("size"))
        .groupBy(*keys)
        .agg(F.bround(F.avg("size")).cast("bigint").alias("kept"))
    )
    means = pass_pairs(picks, keys).groupBy(*keys).agg(
        F.avg("tau").alias("tau"), F.avg("jaccard").alias("jaccard")
    )
    return (
        sizes.join(pools, keys).join(means, keys, "left")
        .withColumn(
            "agreement",
            F.when(
                F.col("tau").isNotNull(),
                F.least(
                    F.col("tau"), corrected_jaccard(F.col("jaccard"), F.col("kept"), F.col("pool"))
                ),
            ),
        )
        .select(*keys, "tau", "jaccard", "kept", "pool", "agreement")
    )


def fallback(pool: DataFrame, keys: list[str], top_n: int = K.TOP_N) -> DataFrame:
    """Importance, then weight, then survivor order; the top `top_n` of each group."""
    order = Window.partitionBy(*keys).orderBy(
        F.desc("importance"), F.desc("weight"), F.asc_nulls_last("published_at"), F.asc("article_id")
    )
    placed = pool.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top_n)
    return placed.select(*keys, "summary_id", "position", band(F.col("position")).alias("tier"))


def aggregate(
    picks: DataFrame, notes: DataFrame, pools: DataFrame, keys: list[str], top_n: int = K.TOP_N
) -> tuple[DataFrame, DataFrame]:
    """The published items of each group, and one row per group with note and agreement."""
    order = borda(picks, keys).where(F.col("position") <= top_n)
    items = majority_tiers(picks, order, keys).join(
        first_reasons(picks, keys), [*keys, "summary_id"], "left"
    )
    days = agreement(picks, pools, keys).join(best_notes(picks, notes, order, keys), keys, "left")
    return items, days


def rank_days(
    pool: DataFrame, arranged: DataFrame, answers: DataFrame, notes: DataFrame, keys: list[str],
    top_n: int = K.TOP_N,
) -> tuple[DataFrame, DataFrame]:
    """The whole ranking of each group: answers checked against their own table, then aggregated.

    A group none of whose answers can be used gets the fallback order: without reasons, note or
    agreement, and with `readings` 0.
    """
    # At most `top_n` rows a reading, read by every part of the aggregate.
    picks = cut(valid_picks(answers, arranged, keys, top_n))
    sizes = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("pool"))
    items, days = aggregate(picks, notes, sizes, keys, top_n)
    readings = picks.groupBy(*keys).agg(F.count_distinct("pass").alias("readings"))
    unread = pool.join(readings, keys, "left_anti")
    spare = fallback(unread, keys, top_n).withColumn("reason", F.lit(None).cast("string"))
    described = sizes.join(readings, keys, "left").na.fill(0, ["readings"]).join(
        days.select(*keys, "editor_note", "agreement"), keys, "left"
    )
    return items.unionByName(spare), described
