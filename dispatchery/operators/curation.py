"""What is new, what is due and what has a body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchery import constants as K
from dispatchery.functions.text import is_usable, is_version_title, present, strip, tidy_body, tidy_tags


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def within_horizon(published: Column, now: Column, max_age_days: int = K.MAX_AGE_DAYS) -> Column:
    """Undated items count as current."""
    return published.isNull() | (published >= now - days(max_age_days))


def candidates(
    articles: DataFrame, summaries: DataFrame, now: Column, max_age_days: int = K.MAX_AGE_DAYS
) -> DataFrame:
    """Articles to summarise: no duplicate, fetched in the horizon, without a summary."""
    done = summaries.select(F.col("article_id").alias("id"))
    return articles.where(
        F.col("dup_of").isNull() & (F.col("fetched_at") >= now - days(max_age_days))
    ).join(done, "id", "left_anti")


def reference_articles(
    articles: DataFrame, todo: DataFrame, now: Column, lookback_hours: int = K.LOOKBACK_HOURS
) -> DataFrame:
    """Recent titled articles that are no duplicates and no candidates themselves."""
    recent = articles.where(
        F.col("dup_of").isNull()
        & (F.col("fetched_at") >= now - F.make_dt_interval(F.lit(0), F.lit(lookback_hours)))
        & (F.coalesce(F.col("title"), F.lit("")) != "")
    )
    return recent.join(todo.select("id"), "id", "left_anti")


def insert_if_absent(
    batch: DataFrame, store: DataFrame, keys: list[str], arrival: Column
) -> DataFrame:
    """Rows of `batch` whose key the store lacks; inside the batch the first arrival wins.

    The first of each key comes from an aggregate that combines map-side, so one key repeated in a
    third of the batch costs a row per task.
    """
    columns = [c for c in batch.columns if c not in keys]
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*columns), arrival).alias("_row"))
    return first.select(*keys, "_row.*").join(store.select(*keys), keys, "left_anti").select(batch.columns)


def collected(items: DataFrame, store: DataFrame, now: Column) -> DataFrame:
    """New articles of a batch: inside the horizon, then one per canonical URL."""
    fresh = items.where(within_horizon(F.col("published_at"), now))
    return insert_if_absent(fresh, store, ["url_canonical"], F.struct("arrived_at", "source_id", "url"))


def choose_bodies(
    articles: DataFrame, feed_texts: DataFrame, page_texts: DataFrame, sources: DataFrame,
    searched: DataFrame,
) -> DataFrame:
    """Body, provenance and extra text per article, as cheaply as each one allows.

    A usable feed text wins; then a usable page text; then the longer of the two. Text found by a
    search keeps its own column, for sources heavy enough and titles worth searching.
    """
    joined = (
        articles.select("id", "source_id", "title")
        .join(feed_texts.select("id", "feed_text"), "id", "left")
        .join(page_texts.select("id", "page_text"), "id", "left")
        .join(searched.select("id", "found_text"), "id", "left")
        .join(sources.select(F.col("id").alias("source_id"), "weight"), "source_id")
    )
    feed = F.coalesce("feed_text", F.lit(""))
    page = F.coalesce("page_text", F.lit(""))
    tier = (
        F.when(is_usable(feed), "feed").when(is_usable(page), "fetch")
        .when(F.length(page) > F.length(feed), "fetch").when(feed != "", "feed")
    )
    settled = is_usable(feed) | is_usable(page)
    searchable = ~settled & (F.col("weight") >= K.SEARCH_MIN_WEIGHT) & ~is_version_title(F.col("title"))
    return joined.select(
        "id",
        F.when(tier == "feed", feed).when(tier == "fetch", page).alias("body_text"),
        tier.alias("body_source"),
        F.when(searchable & present(F.col("found_text")), F.col("found_text")).alias("extra_text"),
        F.when(is_usable(feed), "from_feed").when(is_usable(page), "fetched")
        .when(searchable & present(F.col("found_text")), "searched").otherwise("still_empty")
        .alias("outcome"),
        searchable.alias("searchable"),
    )


def enrich_stats(chosen: DataFrame) -> DataFrame:
    outcomes = ("from_feed", "fetched", "searched", "still_empty")
    return chosen.agg(
        F.count(F.lit(1)).alias("examined"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in outcomes],
    )


def validate_drafts(drafts: DataFrame) -> DataFrame:
    """Drafts with tidied tags and `accepted`: scores, vocabularies and prose in order."""
    ok = (
        F.coalesce(F.col("importance").between(1, 5), F.lit(False))
        & F.coalesce(F.col("kind").isin(*K.KINDS), F.lit(False))
        & present(F.col("title_local")) & present(F.col("summary")) & present(F.col("why_it_matters"))
    )
    return drafts.withColumn("tags", tidy_tags(F.col("tags"))).withColumn("accepted", ok)


def eligible_corpus(articles: DataFrame) -> DataFrame:
    """Articles a frozen corpus may hold: a real body of known origin, no duplicate."""
    return articles.where(
        (F.length("body_text") > K.MIN_BODY_CHARS)
        & F.col("body_source").isin("feed", "fetch")
        & F.col("dup_of").isNull()
    )


def unattributed(articles: DataFrame, summaries: DataFrame) -> DataFrame:
    done = summaries.select(F.col("article_id").alias("id"))
    return articles.where(F.col("body_source") == "unknown").join(done, "id", "left_semi")


def repair_set(articles: DataFrame, summaries: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(article_id, why): bodies nobody can vouch for, and summaries called wrong in a fact."""
    vague = unattributed(articles, summaries).select(F.col("id").alias("article_id"), F.lit("unknown").alias("why"))
    wrong = verdicts.where("verdict = 'wrong' AND reason = 'wrong_fact'").select(F.col("summary_id").alias("id")).join(
        summaries.select("id", "article_id"), "id"
    ).select("article_id", F.lit("wrong_fact").alias("why"))
    return vague.unionByName(wrong).groupBy("article_id").agg(F.min("why").alias("why"))


def fallback_text(html: Column) -> Column:
    """The tag-strip reading of a fragment."""
    return tidy_body(F.regexp_replace(F.coalesce(strip(html), F.lit("")), "<[^>]+>", " "))
