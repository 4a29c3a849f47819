"""Checks of what was published, over one row per story.

A story has `bulletin_id` (or any group key), summary, why_it_matters, title_local, tags, key_fact,
importance, position, body_numerals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchery import constants as K
from dispatchery.functions.numerals import claimed_values, claims_of, numeral_values, values_of
from dispatchery.functions.numerals import figures as figures_in
from dispatchery.functions.text import (
    capitalised_tokens, content_tokens, first_chars, literal_array, parse_tags, present, word_count,
)


def body_facts(articles: DataFrame, body_chars: int | None = None) -> DataFrame:
    """(article_id, title, body_source, body_numerals, body_capitalised): all that a check needs of an article.

    Bodies are read whole, or to `body_chars` where the summariser saw no more. The table is narrow, so one that
    is written once serves every check; an article without a body has no figures and no names."""
    seen = first_chars(F.coalesce(F.col("body_text"), F.lit("")), body_chars)
    return articles.select(
        F.col("id").alias("article_id"), "title", "body_source",
        numeral_values(seen).alias("body_numerals"), capitalised_tokens(seen).alias("body_capitalised"),
    )


def with_facts(stories: DataFrame, facts: DataFrame) -> DataFrame:
    """Stories with their tags parsed and the facts of their bodies beside them."""
    return stories.withColumn("tags", parse_tags(F.col("tags_json"))).join(facts, "article_id")


def story_rows(stories: DataFrame, articles: DataFrame, body_chars: int | None = None) -> DataFrame:
    """Stories with what a check needs of their bodies: figures and capitalised words."""
    return with_facts(stories, body_facts(articles, body_chars))


def share(count: Column, of: Column) -> Column:
    """0.0 for an empty group."""
    return F.when(of > 0, count / F.nullif(of, F.lit(0))).otherwise(F.lit(0.0))


def rate(count: Column, of: Column) -> Column:
    """Null for an empty denominator."""
    return count / F.nullif(of, F.lit(0))


def prose() -> Column:
    return F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("why_it_matters", F.lit("")))


def over_budget(field: str) -> Column:
    return word_count(F.col(field)) > K.WORD_BUDGETS[field]


def fact_kept() -> Column:
    written = content_tokens(
        F.concat_ws(" ", F.coalesce("title_local", F.lit("")), F.coalesce("summary", F.lit("")))
    )
    return F.arrays_overlap(content_tokens(F.col("key_fact")), written)


def invented(claims: Column | None = None) -> Column:
    """Figures a story claims that its body does not hold; empty where the body has none."""
    claims = claimed_values(prose()) if claims is None else claims
    return F.when(
        F.size("body_numerals") > 0, F.array_except(claims, F.col("body_numerals"))
    ).otherwise(F.array().cast("array<string>"))


def word_budget(stories: DataFrame, keys: list[str]) -> DataFrame:
    n = F.count(F.lit(1))
    return stories.groupBy(*keys).agg(
        n.alias("n"),
        *[F.count_if(over_budget(f)).alias(f"{f}_over") for f in K.WORD_BUDGETS],
        *[share(F.count_if(over_budget(f)), n).alias(f"{f}_share") for f in K.WORD_BUDGETS],
    )


def content_marks(stories: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` and what the content floor found in each story; as with `story_marks`, none of it depends on the bulletin."""
    return stories.select(
        *keep,
        present(F.col("key_fact")).alias("fact"),
        F.coalesce(fact_kept(), F.lit(False)).alias("kept"),
        (F.size("body_numerals") > 0).alias("figured"),
        F.arrays_overlap(numeral_values(prose()), F.col("body_numerals")).alias("recalled"),
    )


def content_of(marks: DataFrame, keys: list[str]) -> DataFrame:
    """The content floor of groups of marked stories."""
    n, facts, figured = F.count(F.lit(1)), F.count_if("fact"), F.count_if("figured")
    return marks.groupBy(*keys).agg(
        n.alias("n"),
        share(facts, n).alias("key_fact_share"),
        rate(F.count_if(F.col("fact") & F.col("kept")), facts).alias("key_fact_kept"),
        figured.alias("n_with_numerals"),
        rate(F.count_if(F.col("figured") & F.col("recalled")), figured).alias("numeral_recall"),
    )


def content_floor(stories: DataFrame, keys: list[str]) -> DataFrame:
    return content_of(content_marks(stories, keys), keys)


def ungrounded_numerals(stories: DataFrame, keys: list[str]) -> DataFrame:
    return stories.withColumn("numerals", invented()).where(F.size("numerals") > 0).select(
        *keys, "article_id", "numerals"
    )


def tag_uses(stories: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tag, uses), combined map-side."""
    return stories.select(*keys, F.explode("tags").alias("tag")).groupBy(*keys, "tag").agg(
        F.count(F.lit(1)).alias("uses")
    )


def tag_vocabulary(stories: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct tags, the share used once, and the share of uses inside the vocabulary."""
    uses = F.sum("uses")
    distinct = F.count(F.lit(1))
    known = F.coalesce(F.sum(F.when(F.col("tag").isin(*K.TAG_VOCABULARY), F.col("uses"))), F.lit(0))
    found = tag_uses(stories, keys).groupBy(*keys).agg(
        distinct.alias("distinct"),
        share(F.count_if(F.col("uses") == 1), distinct).alias("singleton_share"),
        share(known, uses).alias("in_vocabulary_share"),
    )
    return found


def top_tags(stories: DataFrame, keys: list[str], top: int = K.TOP_TAGS) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("uses"), F.asc("tag"))
    return tag_uses(stories, keys).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def importance_distribution(stories: DataFrame, keys: list[str]) -> DataFrame:
    return stories.groupBy(*keys).agg(
        *[F.avg((F.col("importance") == k).cast("double")).alias(f"share_{k}") for k in range(1, 6)]
    )


def story_marks(stories: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, article_id, tags and what the checks found in each story: its prose stays behind.

    None of it depends on the bulletin, so marks may be taken of summaries before they meet the bulletins of
    their day: two versions of a day then share one reading of the prose."""
    return stories.withColumn("_figures", figures_in(prose())).select(
        *keep, "article_id", "tags", invented(claims_of(F.col("_figures"))).alias("_invented"),
        present(F.col("key_fact")).alias("_fact"), F.coalesce(fact_kept(), F.lit(False)).alias("_kept"),
        (F.size("body_numerals") > 0).alias("_figured"),
        F.arrays_overlap(values_of(F.col("_figures")), F.col("body_numerals")).alias("_recalled"),
        *[over_budget(f).alias(f"_{f}") for f in K.WORD_BUDGETS],
    )


def figures(marks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, article_id, numerals): the invented figures of marked stories, a row a story that has any."""
    return marks.where(F.size("_invented") > 0).select(*keys, "article_id", F.col("_invented").alias("numerals"))


def checks_of(marks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, checks): every check of a group of marked stories (with `position`) as one nested record."""
    n = F.count(F.lit(1))
    facts, figured = F.count_if("_fact"), F.count_if("_figured")
    main = marks.groupBy(*keys).agg(
        n.alias("n"),
        F.count("position").alias("n_published"),
        F.struct(
            *[F.count_if(f"_{f}").alias(f"{f}_over") for f in K.WORD_BUDGETS],
            *[share(F.count_if(f"_{f}"), n).alias(f"{f}_share") for f in K.WORD_BUDGETS],
        ).alias("budget"),
        F.struct(
            share(facts, n).alias("key_fact_share"),
            rate(F.count_if(F.col("_fact") & F.col("_kept")), facts).alias("key_fact_kept"),
            figured.alias("n_with_numerals"),
            rate(F.count_if(F.col("_figured") & F.col("_recalled")), figured).alias("numeral_recall"),
        ).alias("content"),
        # How many stories hold an invented figure; the figures themselves are rows of `figures`.
        F.count_if(F.size("_invented") > 0).alias("ungrounded"),
    )
    tags = tag_vocabulary(marks, keys).select(
        *keys, F.struct("distinct", "singleton_share", "in_vocabulary_share").alias("tags")
    )
    empty = F.struct(
        F.lit(0).cast("bigint").alias("distinct"), F.lit(0.0).alias("singleton_share"),
        F.lit(0.0).alias("in_vocabulary_share"),
    )
    return main.join(tags, keys, "left").select(
        *keys,
        F.struct(
            "n", "n_published", "budget", "content", "ungrounded", F.coalesce("tags", empty).alias("tags")
        ).alias("checks"),
    )


def published_checks(stories: DataFrame, keys: list[str]) -> DataFrame:
    """Every check of a group as one nested `checks` record, for storing with a bulletin."""
    return checks_of(story_marks(stories, [*keys, "position"]), keys)


def stored_or_computed(bulletins: DataFrame, stored: DataFrame, marks: DataFrame) -> DataFrame:
    """(bulletin_id, checks, at_publish): checks frozen at publication where a bulletin has them, else computed.

    `stored` is (bulletin_id, checks). Only `marks` (bulletin_id, position, marks) of bulletins without stored
    checks are aggregated; a bulletin without either is absent.
    """
    wanted = bulletins.select("bulletin_id")
    frozen = stored.select("bulletin_id", "checks").where(F.col("checks").isNotNull()).join(wanted, "bulletin_id", "left_semi")
    missing = wanted.join(frozen, "bulletin_id", "left_anti")
    computed = checks_of(marks.join(missing, "bulletin_id", "left_semi"), ["bulletin_id"])
    return frozen.withColumn("at_publish", F.lit(True)).unionByName(computed.withColumn("at_publish", F.lit(False)))


def judge_detail(outcomes: DataFrame) -> DataFrame:
    """The detail a judgement row carries: its claim, its error, or a pass nobody can vouch for."""
    vague = F.col("passed") & ~F.coalesce(F.col("body_source").isin("feed", "fetch"), F.lit(False))
    return outcomes.withColumn(
        "detail",
        F.coalesce(
            F.when(present(F.col("claim")), F.col("claim")),
            F.when(present(F.col("error")), F.col("error")),
            F.when(vague, F.lit(K.UNATTRIBUTED)),
        ),
    )


def judge_tallies(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    return outcomes.groupBy(*keys).agg(
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.count_if(F.col("passed").isNull()).alias("unparsed"),
    )


def calibration(labelled: DataFrame, judged: DataFrame) -> DataFrame:
    """Wrong labels against judgements: only `wrong_fact` is judged, the rest are counted apart."""
    paired = labelled.where("verdict = 'wrong'").join(judged.select("summary_id", "passed"), "summary_id", "left")
    fact = F.coalesce(F.col("reason") == "wrong_fact", F.lit(False))
    return paired.agg(
        F.count_if(fact & (F.col("passed") == F.lit(False))).alias("caught"),
        F.count_if(fact & F.col("passed")).alias("missed"),
        F.count_if(fact & F.col("passed").isNull()).alias("unparsed"),
        F.count_if(~fact).alias("other_reason"),
    )


MEASURES = (
    "n", "failures", "summary_over", "why_it_matters_over", "title_local_over", "key_fact_share",
    "key_fact_kept", "numeral_recall", "ungrounded", "distinct_tags", "singleton_share",
    "in_vocabulary_share", "tokens_in", "tokens_out", "est_cost_usd",
)


def compare_sides(stories: DataFrame, spend: DataFrame) -> DataFrame:
    """(measure, a, b): every check of two sets of answers side by side, no winner named.

    `stories` and `spend` carry `side` in ('a', 'b').
    """
    checks = published_checks(stories, ["side"]).join(spend, "side", "full")
    c = "checks.{}"
    flat = checks.select(
        "side", F.col(c.format("n")).alias("n"), "failures",
        *[F.col(f"checks.budget.{f}_over").alias(f"{f}_over") for f in K.WORD_BUDGETS],
        F.col("checks.content.key_fact_share").alias("key_fact_share"),
        F.col("checks.content.key_fact_kept").alias("key_fact_kept"),
        F.col("checks.content.numeral_recall").alias("numeral_recall"),
        F.col("checks.ungrounded").alias("ungrounded"),
        F.col("checks.tags.distinct").alias("distinct_tags"),
        F.col("checks.tags.singleton_share").alias("singleton_share"),
        F.col("checks.tags.in_vocabulary_share").alias("in_vocabulary_share"),
        "tokens_in", "tokens_out", "est_cost_usd",
    )
    long = flat.select("side", F.explode(F.create_map(
        *[x for m in MEASURES for x in (F.lit(m), F.col(m).cast("double"))])).alias("measure", "value"))
    return long.groupBy("measure").pivot("side", ["a", "b"]).agg(F.first("value", ignorenulls=True))


def report_rows(
    bulletins: DataFrame, checks: DataFrame, verdicts: DataFrame, since: Column
) -> DataFrame:
    """One row per bulletin of the window; `repeats` marks measurements an earlier row already has."""
    rows = (
        bulletins.where(F.col("created_at") >= since)
        .select(F.col("id").alias("bulletin_id"), "day", "version", "language", "agreement", "created_at")
        .join(checks, "bulletin_id").join(verdicts, "bulletin_id", "left")
        .na.fill(0, ["wrong", *K.REASONS])
    )
    print_ = F.sha2(F.to_json(F.struct("checks", "agreement", "wrong", *K.REASONS)), 256)
    hashed = rows.withColumn("fingerprint", print_)
    first = hashed.groupBy("fingerprint").agg(F.min(F.struct("created_at", "bulletin_id")).alias("_first"))
    return hashed.join(first, "fingerprint").withColumn(
        "repeats", F.col("_first.bulletin_id") != F.col("bulletin_id")
    ).drop("_first")
