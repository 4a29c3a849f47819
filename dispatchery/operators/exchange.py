"""Frozen corpora, recorded bulletins, and archive slices that move between archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchery import constants as K
from dispatchery.functions.calendar import seconds_between
from dispatchery.functions.text import first_chars
from dispatchery.operators.curation import eligible_corpus
from dispatchery.operators.numbering import numbered
from dispatchery.operators.reading import reading_order
from dispatchery.operators.sampling import hash_sample
from dispatchery.session import cut

CORPUS_SCHEMA = (
    "article_id bigint, source string, title string, url string, published string, body string, extra string"
)


RECORD_SCHEMA = 1


def freeze_corpus(
    articles: DataFrame, sources: DataFrame, size: int = 40, seed: int = 0,
    body_chars: int | None = None, extra_chars: int | None = None,
) -> DataFrame:
    """Lines of a corpus: a seeded sample of articles with real bodies, as a summariser sees them."""
    drawn = hash_sample(eligible_corpus(articles), "id", size, seed)
    named = drawn.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id")
    return named.select(
        F.col("id").alias("article_id"), "source", "title", "url",
        F.coalesce(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit("unknown")).alias("published"),
        first_chars(F.col("body_text"), body_chars).alias("body"),
        first_chars(F.coalesce("extra_text", F.lit("")), extra_chars).alias("extra"),
    )


def record_bulletins(bulletins: DataFrame, stories: DataFrame, duplicates: DataFrame, top_n: int = K.TOP_N) -> DataFrame:
    """(bulletin_id, part, place, body): a bulletin as JSON lines.

    One line for the header, one a story in reading order, one a duplicate pair: a day of any size
    is written by many tasks, and a reader orders by (part, place). No body text is recorded, only the
    figures and names found in it. `bulletins` carries model_summarize and model_rank, `stories` source, weight and facts;
    a field that is null is written as null.
    """
    def line(*columns):
        return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("body")

    header = bulletins.select(
        F.col("id").alias("bulletin_id"), F.lit("header").alias("part"), F.lit(0).cast("bigint").alias("place"),
        line(F.lit(RECORD_SCHEMA).alias("schema"), F.col("id").alias("bulletin_id"), "day", "version", "language", "agreement",
             F.unix_seconds("created_at").alias("published_at"), "run_id", "model_summarize", "model_rank",
             F.lit(top_n).alias("top_n"), "editor_note"),
    )
    story = reading_order(stories).select(
        "bulletin_id", F.lit("story").alias("part"), F.col("place").cast("bigint").alias("place"),
        line("article_id", "source", "weight", "title", "title_local", "summary", "why_it_matters", "tags", "importance", "key_fact",
             "relevant", "kind", "position", "tier", "reason", F.array_sort("body_numerals").alias("body_numerals"),
             F.array_sort("body_capitalised").alias("body_capitalised"), "body_source"),
    )
    of_story = stories.select("bulletin_id", F.col("article_id").alias("dup_of"))
    pair = duplicates.join(of_story, "dup_of").select(
        "bulletin_id", F.lit("duplicate").alias("part"), F.col("article_id").alias("place"),
        line("article_id", "dup_of", "title", "dup_of_title"),
    )
    return header.unionByName(story).unionByName(pair)


def _offset(name: str, anchor: Column) -> Column:
    return F.when(F.col(name).isNotNull(), seconds_between(F.col(name), anchor)).alias(name)


def _written(ids: DataFrame, key: str) -> DataFrame:
    """A set of ids, written once and parted by `key`, so that several joins by it read it without a shuffle."""
    return cut(ids.repartition(key))


def export_slice(tables: dict[str, DataFrame], bulletins: int = 3) -> dict[str, DataFrame]:
    """The newest bulletins and the rows they need, with times as seconds from the newest publication.

    `tables` has bulletins, items, summaries, translations, articles, sources, runs, run_steps,
    verdicts, eval_results. What decides about rows is written once, parted by id: the chosen
    bulletins, their items, and the ids of the slice's summaries and articles. Each table is then cut by a
    semi-join with one of these, so no table is derived again for another one's sake.
    """
    chosen = cut(tables["bulletins"].orderBy(F.desc("day"), F.desc("version")).limit(bulletins))
    anchor = chosen.agg(F.max("created_at").alias("t")).scalar()
    newest_day = chosen.agg(F.max("day").alias("d")).scalar()
    bulletin_ids = chosen.select(F.col("id").alias("bulletin_id"))
    items = cut(tables["items"].join(bulletin_ids, "bulletin_id", "left_semi"))
    days = chosen.select("day").distinct().withColumn("_of_day", F.lit(True))
    out = items.select(F.col("summary_id").alias("id")).distinct().withColumn("_out", F.lit(True))
    spoken = tables["summaries"].join(chosen.select("language").distinct(), "language", "left_semi")
    held = _written(
        spoken.select("id", "article_id", "day").join(days, "day", "left").join(out, "id", "left")
        .where("_of_day OR _out").select("id", "article_id"), "id",
    )
    summaries = tables["summaries"].join(held.select("id"), "id", "left_semi")
    ids = held.select(F.col("id").alias("summary_id"))
    of_held = held.select(F.col("article_id").alias("id")).distinct()
    origin = _written(tables["articles"].select("id", "source_id").join(of_held, "id", "left_semi"), "id")
    articles = tables["articles"].join(origin.select("id"), "id", "left_semi")
    sources = tables["sources"].join(origin.select(F.col("source_id").alias("id")).distinct(), "id", "left_semi")
    run_ids = chosen.select("run_id")
    runs = tables["runs"].join(run_ids.withColumnRenamed("run_id", "id"), "id", "left_semi")
    steps = tables["run_steps"].join(run_ids, "run_id", "left_semi")

    def shifted(df: DataFrame, *times: str) -> DataFrame:
        return df.select(*[_offset(c, anchor) if c in times else F.col(c) for c in df.columns])

    return {
        "sources": sources,
        "articles": shifted(articles.drop("body_text"), "published_at", "fetched_at"),
        "summaries": shifted(summaries, "created_at"),
        "translations": tables["translations"].join(ids, "summary_id", "left_semi"),
        "runs": shifted(runs, "started_at", "finished_at"),
        "run_steps": shifted(steps, "started_at", "finished_at"),
        "bulletins": shifted(
            chosen.withColumn("day_offset", F.datediff(F.to_date("day"), F.to_date(newest_day))).drop("day"),
            "created_at",
        ),
        "items": items,
        "verdicts": shifted(tables["verdicts"].join(ids, "summary_id", "left_semi"), "created_at"),
        "eval_results": shifted(
            tables["eval_results"].join(bulletin_ids, "bulletin_id", "left_semi"), "created_at"
        ),
    }


def new_ids(rows: DataFrame, existing: DataFrame, id_col: str = "id") -> DataFrame:
    """(old_id, new_id): ids that go on from the greatest stored one, in the order of the old ids."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    placed = numbered(
        rows.select(F.col(id_col).alias("old_id"), F.lit(0).alias("_all")), ["_all"], [F.asc("old_id")],
        [F.floor(F.col("old_id") / 65536)], "n",
    )
    return placed.select("old_id", (F.col("n") + top).alias("new_id"))


def import_slice(
    data: dict[str, DataFrame], existing: dict[str, DataFrame], anchor: Column
) -> dict[str, DataFrame]:
    """Rows of a slice as they enter another archive: new ids, sources matched by url, times rebased.

    `existing` has sources, articles, summaries, runs and bulletins of the receiving archive. The
    maps from old to new ids are written once, parted by the old id.
    """
    known = data["sources"].select("id", "url").join(
        existing["sources"].select("url", F.col("id").alias("_stored")), "url", "left"
    )
    fresh = known.where("_stored IS NULL")

    def renamed(rows: DataFrame, stored: DataFrame) -> DataFrame:
        return _written(new_ids(rows.select("id"), stored), "old_id")

    source_ids = _written(new_ids(fresh, existing["sources"]).withColumn("fresh", F.lit(True)).unionByName(
        known.where("_stored IS NOT NULL").select(
            F.col("id").alias("old_id"), F.col("_stored").alias("new_id"), F.lit(False).alias("fresh"))
    ), "old_id")
    article_ids = renamed(data["articles"], existing["articles"])
    summary_ids = renamed(data["summaries"], existing["summaries"])
    bulletin_ids = renamed(data["bulletins"], existing["bulletins"])
    run_ids = renamed(data["runs"], existing["runs"])

    def remap(df: DataFrame, column: str, ids: DataFrame, how: str = "inner") -> DataFrame:
        mapping = ids.select(F.col("old_id").alias(column), F.col("new_id").alias("_new"))
        return df.join(mapping, column, how).withColumn(column, F.col("_new")).drop("_new")

    def rebased(df: DataFrame, *times: str) -> DataFrame:
        moved = {
            c: F.timestamp_micros(F.unix_micros(anchor) + F.round(F.col(c) * 1_000_000).cast("bigint"))
            for c in times
        }
        return df.withColumns(moved)

    today = F.to_date(F.from_utc_timestamp(anchor, K.ZONE))
    articles = remap(remap(data["articles"], "id", article_ids), "source_id", source_ids)
    bulletins = remap(remap(data["bulletins"], "id", bulletin_ids), "run_id", run_ids, "left").withColumn(
        "day", F.date_format(F.date_add(today, F.col("day_offset")), "yyyy-MM-dd")
    ).drop("day_offset")
    return {
        "sources": remap(data["sources"], "id", source_ids.where("fresh")),
        # A mark whose target is not in the slice is dropped.
        "articles": rebased(remap(articles, "dup_of", article_ids, "left"), "published_at", "fetched_at"),
        "summaries": rebased(
            remap(remap(data["summaries"], "id", summary_ids), "article_id", article_ids), "created_at"
        ),
        "translations": remap(data["translations"], "summary_id", summary_ids),
        "runs": rebased(remap(data["runs"], "id", run_ids), "started_at", "finished_at"),
        "run_steps": rebased(remap(data["run_steps"], "run_id", run_ids), "started_at", "finished_at"),
        "bulletins": rebased(bulletins, "created_at"),
        "items": remap(remap(data["items"], "bulletin_id", bulletin_ids), "summary_id", summary_ids),
        "verdicts": rebased(remap(data["verdicts"], "summary_id", summary_ids), "created_at"),
        "eval_results": rebased(
            remap(remap(data["eval_results"], "summary_id", summary_ids, "left"), "bulletin_id", bulletin_ids, "left"),
            "created_at",
        ),
    }


def refuse_unless_empty(bulletins: DataFrame, force: bool = False) -> None:
    """Two archives in one cannot be told apart again, so a filled one is refused."""
    if not force and not bulletins.isEmpty():
        raise ValueError("the archive already holds bulletins")
