"""Read queries over the published archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchery import constants as K
from dispatchery.functions.calendar import local_day
from dispatchery.functions.hashing import content_hash
from dispatchery.functions.text import literal_array, parse_tags, present
from dispatchery.operators.numbering import latest, numbered


def star(summaries: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Summary x article x source. The planner broadcasts sources when their size allows."""
    a = articles.select(
        F.col("id").alias("article_id"), F.col("url").alias("article_url"), "title",
        "published_at", "fetched_at", "body_text", "body_source",
    )
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"), "weight")
    return summaries.join(a, "article_id").join(s, "source_id")


def with_verdict(stories: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Left outer to the reader's call, of which only `wrong` counts."""
    wrong = verdicts.where(F.col("verdict") == "wrong").select(
        F.col("summary_id").alias("id"), "verdict",
        F.col("reason").alias("verdict_reason"), F.col("note").alias("verdict_note"),
    )
    return stories.join(wrong, "id", "left")


def day_stories(bulletins: DataFrame, items: DataFrame, summaries: DataFrame) -> DataFrame:
    """(bulletin_id, position, tier, reason, summary columns): a bulletin's items and the rest of
    what its local day summarised, in its language.

    The interval test is an equi-join on the local day. Items from other days come in by their own
    join, so neither side needs an `or` condition.
    """
    b = bulletins.select(F.col("id").alias("bulletin_id"), F.col("day").alias("_day"), "language")
    i = items.select("bulletin_id", F.col("summary_id").alias("id"), "position", "tier", "reason")
    of_day = (
        summaries.join(b.withColumnRenamed("_day", "day"), ["day", "language"])
        .join(i, ["bulletin_id", "id"], "left")
    )
    from_elsewhere = (
        i.join(b, "bulletin_id").join(summaries, ["id", "language"])
        .where(F.col("day") != F.col("_day")).drop("_day")
    )
    return of_day.unionByName(from_elsewhere)


def rest_of_day(bulletins: DataFrame, items: DataFrame, summaries: DataFrame) -> DataFrame:
    """(bulletin_id, summary columns): the day's relevant summaries a bulletin left out."""
    b = bulletins.select(
        F.col("id").alias("bulletin_id"), "day", F.col("language").alias("_own"), "bilingual"
    )
    admitted = (F.col("language") == "en") | (~F.col("bilingual") & (F.col("language") == F.col("_own")))
    taken = items.select("bulletin_id", F.col("summary_id").alias("id"))
    return (
        summaries.where("relevant").join(b, "day").where(admitted)
        .join(taken, ["bulletin_id", "id"], "left_anti").drop("_own", "bilingual")
    )


def reading_order(stories: DataFrame) -> DataFrame:
    """Published stories by position, then the rest by importance and id; adds `place`."""
    return numbered(
        stories, ["bulletin_id"],
        [F.asc_nulls_last("position"), F.desc("importance"), F.asc("id")],
        [
            F.coalesce(F.col("position").cast("bigint"), F.lit(2**40)), -F.col("importance"),
            F.floor(F.col("id") / 4096),
        ],
        "place",
    )


def ordered_rest(rest: DataFrame) -> DataFrame:
    return numbered(
        rest, ["bulletin_id"], [F.desc("importance"), F.asc("id")],
        [-F.col("importance"), F.floor(F.col("id") / 4096)], "place",
    )


def home_bulletins(items: DataFrame, bulletins: DataFrame) -> DataFrame:
    """(summary_id, bulletin_id): the newest bulletin that holds a summary."""
    b = bulletins.select(F.col("id").alias("bulletin_id"), "day", "version")
    return items.select("summary_id", "bulletin_id").join(b, "bulletin_id").groupBy("summary_id").agg(
        F.max_by("bulletin_id", F.struct("day", "version")).alias("bulletin_id")
    )


def previous_headlines(
    bulletins: DataFrame, items: DataFrame, summaries: DataFrame, limit: int = K.PREVIOUS_HEADLINES
) -> DataFrame:
    """(day, language, place, title_local): what the last bulletin before each day led with."""
    last = bulletins.groupBy("day", "language").agg(F.max_by("id", "version").alias("last_id"))
    before = Window.partitionBy("language").orderBy("day")
    earlier = last.select(
        "day", "language", F.lag("last_id").over(before).alias("bulletin_id")
    ).where(F.col("bulletin_id").isNotNull())
    order = Window.partitionBy("bulletin_id").orderBy("position")
    led = items.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return (
        earlier.join(led.select("bulletin_id", "place", "summary_id"), "bulletin_id")
        .join(summaries.select(F.col("id").alias("summary_id"), "title_local"), "summary_id")
        .select("day", "language", "place", "summary_id", "title_local")
    )


def current_bulletins(bulletins: DataFrame, by_day: bool = True) -> DataFrame:
    """The newest version of each day, or of the whole archive."""
    keys = ["day"] if by_day else []
    order = F.struct("day", "version", "id")
    return bulletins.groupBy(*keys).agg(F.max_by("id", order).alias("bulletin_id"))


def superseded(bulletins: DataFrame) -> DataFrame:
    """(bulletin_id, superseded_by): the newest version of the same day and language, if newer."""
    newest = bulletins.groupBy("day", "language").agg(
        F.max(F.struct("version", "id")).alias("newest")
    )
    return bulletins.join(newest, ["day", "language"]).select(
        F.col("id").alias("bulletin_id"),
        F.when(F.col("newest.version") > F.col("version"), F.col("newest.id")).alias("superseded_by"),
    )


def resolve(bulletins: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, bulletin_id) for refs `latest`, an id, a day or `day:language`."""
    keys = F.array(
        F.lit("latest"), F.col("id").cast("string"), F.col("day"),
        F.concat(F.col("day"), F.lit(":"), F.col("language")),
    )
    lookup = bulletins.select("id", "day", "version", F.explode(keys).alias("ref")).groupBy("ref").agg(
        F.max_by("id", F.struct("day", "version", "id")).alias("bulletin_id")
    )
    return refs.join(lookup, "ref", "left")


def page(df: DataFrame, order: list[Column], limit: int | None, default: int) -> DataFrame:
    """The first rows by `order`, with place, exact total, more and next_limit beside each."""
    size = default if limit is None or limit < 1 else limit
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    top = df.orderBy(*order).limit(size)
    # At most `size` rows are left, so one task can number them.
    shown = top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    return shown.withColumn("total", total).withColumns({
        "more": F.col("total") > size,
        "next_limit": F.greatest(F.lit(2 * size), F.least(F.col("total"), F.lit(size)) + 1),
    })


def articles_per_source(sources: DataFrame, articles: DataFrame) -> DataFrame:
    counts = articles.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n_articles"))
    return sources.join(counts, "id", "left").withColumn(
        "n_articles", F.coalesce("n_articles", F.lit(0))
    )


def verdict_counts(stories: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Wrong calls per bulletin: one column a reason, unlisted reasons in the total only."""
    wrong = verdicts.where(F.col("verdict") == "wrong").select(
        F.col("summary_id").alias("id"), F.col("reason").alias("why")
    )
    scoped = stories.select("bulletin_id", "id").join(wrong, "id")
    return scoped.groupBy("bulletin_id").agg(
        F.count(F.lit(1)).alias("wrong"),
        *[F.count_if(F.col("why") == r).alias(r) for r in K.REASONS],
    )


def activity(runs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """(day, stories, cost) for the last local days, zero-filled."""
    today = F.to_date(F.from_utc_timestamp(now, K.ZONE))
    per_day = runs.where(F.col("started_at") >= now - F.expr("interval 30 days")).groupBy(
        local_day(F.col("started_at")).alias("day")
    ).agg(F.sum("n_summarized").alias("stories"), F.sum("est_cost_usd").alias("cost"))
    span = runs.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("d")
    ).select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    return span.join(per_day, "day", "left").select(
        "day", F.coalesce("stories", F.lit(0)).alias("stories"), F.coalesce("cost", F.lit(0.0)).alias("cost")
    )


def spend(runs: DataFrame, now: Column) -> DataFrame:
    """One row: cost of today, of seven local days and of thirty times 24 hours."""
    today = F.to_date(F.from_utc_timestamp(now, K.ZONE))
    day = F.to_date(F.from_utc_timestamp("started_at", K.ZONE))
    return runs.where(F.col("started_at") >= now - F.expr("interval 30 days")).agg(
        F.coalesce(F.sum(F.when(day == today, F.col("est_cost_usd"))), F.lit(0.0)).alias("cost_today"),
        F.coalesce(
            F.sum(F.when(day.between(F.date_sub(today, 6), today), F.col("est_cost_usd"))), F.lit(0.0)
        ).alias("cost_week"),
        F.coalesce(F.sum("est_cost_usd"), F.lit(0.0)).alias("cost_month"),
    )


def tag_counts(published: DataFrame, rest: DataFrame) -> DataFrame:
    """(bulletin_id, tag, published, visible) from one pass over both scopes.

    A story counts a tag once; malformed tag lists hold none.
    """
    scoped = published.select("bulletin_id", "tags_json", F.lit(True).alias("out")).unionByName(
        rest.select("bulletin_id", "tags_json", F.lit(False).alias("out"))
    )
    return (
        scoped.select("bulletin_id", "out", F.explode(F.array_distinct(parse_tags(F.col("tags_json")))).alias("tag"))
        .groupBy("bulletin_id", "tag")
        .agg(F.count_if("out").alias("published"), F.count(F.lit(1)).alias("visible"))
    )


def impact_bands(stories: DataFrame, key: str) -> DataFrame:
    return stories.groupBy(key).agg(
        F.count_if(F.col("importance") >= 4).alias("high"),
        F.count_if(F.col("importance") == 3).alias("mid"),
        F.count_if(F.col("importance") < 3).alias("low"),
    )


def valid_translations(summaries: DataFrame, translations: DataFrame) -> DataFrame:
    """Translations whose stored hash is the prose they stand for, with no blank field."""
    t = translations.where(F.col("language") == "tr").select(
        F.col("summary_id").alias("id"), "canonical_hash",
        *[F.col(c).alias(f"{c}_tr") for c in ("title_local", "summary", "why_it_matters")],
    )
    fresh = F.col("canonical_hash") == content_hash(
        F.col("title_local"), F.col("summary"), F.col("why_it_matters")
    )
    full = present(F.col("title_local_tr")) & present(F.col("summary_tr")) & present(F.col("why_it_matters_tr"))
    return summaries.select("id", "title_local", "summary", "why_it_matters").join(t, "id").where(
        fresh & full
    ).select("id", "title_local_tr", "summary_tr", "why_it_matters_tr")


def project_language(stories: DataFrame, valid: DataFrame, language: str) -> DataFrame:
    """Stories as a page in `language` shows them, and the language each field is really in.

    `stories` has `legacy`, and `reason`/`reason_tr` of the item. A translation is used only on a
    Turkish page, for English prose that is not legacy.
    """
    joined = stories.join(valid, "id", "left")
    open_ = F.lit(language == "tr") & ~F.col("legacy")
    swap = open_ & (F.col("language") == "en") & F.col("summary_tr").isNotNull()
    reason_swap = open_ & present(F.col("reason_tr"))
    prose = F.when(swap, F.lit("tr")).otherwise(F.col("language"))
    return joined.withColumns({
        "prose_language": prose,
        "language_label": F.col("legacy") | (prose != language),
        "shown_title": F.when(swap, F.col("title_local_tr")).otherwise(F.col("title_local")),
        "shown_summary": F.when(swap, F.col("summary_tr")).otherwise(F.col("summary")),
        "shown_why": F.when(swap, F.col("why_it_matters_tr")).otherwise(F.col("why_it_matters")),
        "shown_reason": F.when(reason_swap, F.col("reason_tr")).otherwise(F.col("reason")),
        "reason_language": F.when(reason_swap, F.lit("tr")).otherwise(F.col("language")),
    })


def project_note(bulletins: DataFrame, language: str) -> DataFrame:
    """(bulletin_id, note, note_language): the note a page in `language` shows."""
    turkish = F.lit(language == "tr") & F.col("bilingual") & present(F.col("editor_note_tr"))
    return bulletins.select(
        F.col("id").alias("bulletin_id"),
        F.when(turkish, F.col("editor_note_tr")).otherwise(F.col("editor_note")).alias("note"),
        F.when(turkish, "tr").when(F.col("bilingual"), "en").otherwise(F.col("language")).alias("note_language"),
    )


def tagged(stories: DataFrame, tag: str) -> DataFrame:
    return stories.where(F.array_contains(parse_tags(F.col("tags_json")), tag))


def display_step(tier: Column, importance: Column) -> Column:
    steps = F.create_map(*[F.lit(x) for kv in K.TIER_STEPS.items() for x in kv])
    return F.coalesce(F.element_at(steps, tier), importance)


def legacy_states(items: DataFrame, bulletins: DataFrame) -> DataFrame:
    """(summary_id, in_legacy, in_bilingual): which kinds of bulletin ever held a summary."""
    b = bulletins.select(F.col("id").alias("bulletin_id"), "bilingual")
    return items.join(b, "bulletin_id").groupBy("summary_id").agg(
        F.bool_or(~F.col("bilingual")).alias("in_legacy"), F.bool_or("bilingual").alias("in_bilingual")
    )


def legacy_ids(items: DataFrame, bulletins: DataFrame) -> DataFrame:
    """Summaries held by a single-language bulletin and by no bilingual one."""
    return legacy_states(items, bulletins).where("in_legacy AND NOT in_bilingual").select("summary_id")


def first_seen_union(parts: list[DataFrame], key: str, place: str) -> DataFrame:
    """An ordered union that keeps the first occurrence of each key; earlier parts come first."""
    ranked = [p.select(key, F.struct(F.lit(i).alias("part"), F.col(place).alias("place")).alias("at")) for i, p in enumerate(parts)]
    whole = ranked[0]
    for other in ranked[1:]:
        whole = whole.unionByName(other)
    return whole.groupBy(key).agg(F.min("at").alias("at"))


def latest_judgements(results: DataFrame) -> DataFrame:
    """The last grounding judgement of each summary."""
    return latest(
        results.where(F.col("kind") == "grounding"), ["summary_id"], F.struct("created_at", "id"),
        ["id", "created_at", "passed", "detail", "model"],
    )


def findings(results: DataFrame) -> DataFrame:
    """Latest judgements that failed and name a claim."""
    return latest_judgements(results).where(
        (F.col("passed") == F.lit(False)) & present(F.col("detail"))
    )
