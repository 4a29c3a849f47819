"""Upserts, versions and snapshots as DataFrames: each returns the table to store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchery import constants as K
from dispatchery.functions.calendar import local_day
from dispatchery.functions.text import present, strip
from dispatchery.operators.curation import days, insert_if_absent
from dispatchery.operators.numbering import numbered
from dispatchery.operators.ranking import band
from dispatchery.session import cut


def sync_sources(sources: DataFrame, feeds: DataFrame) -> DataFrame:
    """Feeds to insert: those whose url is new. What is stored is never overwritten."""
    return insert_if_absent(feeds, sources, ["url"], F.struct("name"))


def upsert_verdicts(store: DataFrame, edits: DataFrame) -> DataFrame:
    """One verdict per summary after edits (summary_id, seq, reason, note, created_at).

    An edit that leaves reason or note out keeps the older value; a blank note clears it.
    """
    folded = edits.groupBy("summary_id").agg(
        F.max_by(F.when(F.col("reason").isNotNull(), F.col("reason")),
                 F.when(F.col("reason").isNotNull(), F.col("seq"))).alias("e_reason"),
        F.max_by(F.col("note"), F.when(F.col("note").isNotNull(), F.col("seq"))).alias("e_note"),
        F.max_by("created_at", "seq").alias("e_at"),
    )
    s = store.select("summary_id", F.col("reason").alias("s_reason"), F.col("note").alias("s_note"),
                     F.col("created_at").alias("s_at"), F.col("verdict").alias("s_verdict"))
    edited = F.col("e_at").isNotNull()
    note = F.when(F.col("e_note").isNotNull(), F.when(present(F.col("e_note")), strip(F.col("e_note")))).otherwise(F.col("s_note"))
    return s.join(folded, "summary_id", "full").select(
        "summary_id",
        F.when(edited, F.lit("wrong")).otherwise(F.col("s_verdict")).alias("verdict"),
        F.coalesce("e_reason", "s_reason").alias("reason"),
        note.alias("note"),
        F.coalesce("e_at", "s_at").alias("created_at"),
    )


def refresh_translations(store: DataFrame, fresh: DataFrame, summaries_hash: DataFrame) -> DataFrame:
    """The translation cache: a row is replaced where its hash is no longer its summary's."""
    columns = [c for c in store.columns if c != "summary_id"]
    s = store.select("summary_id", F.struct(*columns).alias("old"))
    f = fresh.select("summary_id", F.struct(*columns).alias("new"))
    joined = s.join(f, "summary_id", "full").join(summaries_hash, "summary_id", "left")
    keep = F.col("old").isNotNull() & (F.col("new").isNull() | F.coalesce(F.col("old.canonical_hash") == F.col("content_hash"), F.lit(False)))
    return joined.select("summary_id", F.when(keep, F.col("old")).otherwise(F.col("new")).alias("row")).select("summary_id", "row.*")


def next_versions(bulletins: DataFrame, ranked: DataFrame) -> DataFrame:
    """(day, language, version) to publish: one above the newest. Days without items are absent."""
    last = bulletins.groupBy("day", "language").agg(F.max("version").alias("_last"))
    wanted = ranked.select("day", "language").distinct()
    return wanted.join(last, ["day", "language"], "left").select(
        "day", "language", (F.coalesce("_last", F.lit(0)) + 1).alias("version")
    )


def publish(
    bulletins: DataFrame, ranked: DataFrame, heads: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Bulletin and item rows to append for (day, language, summary_id, position, ...) in `ranked`.

    `heads` has (day, language, editor_note, editor_note_tr, agreement, run_id). Ids go on from the
    newest stored one, in order of day and language: one row a published day.
    """
    top = bulletins.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    order = Window.partitionBy(F.lit(0)).orderBy("day", "language")
    new = next_versions(bulletins, ranked).join(heads, ["day", "language"]).withColumn(
        "id", F.row_number().over(order) + top
    ).withColumns({"bilingual": F.lit(True), "created_at": now})
    items = ranked.join(new.select("day", "language", F.col("id").alias("bulletin_id")), ["day", "language"]).select(
        "bulletin_id", "summary_id", "position", "tier",
        F.when(present(F.col("reason")), strip(F.col("reason"))).alias("reason"),
        F.when(present(F.col("reason_tr")), strip(F.col("reason_tr"))).alias("reason_tr"),
    )
    return new, items


def publication_gaps(
    ranked: DataFrame, heads: DataFrame, summaries: DataFrame, valid: DataFrame, keys: tuple[str, ...] = ("day", "language")
) -> DataFrame:
    """(keys, summary_id, gap): what stops a ranking from being published. Empty is good."""
    prose = summaries.select(
        F.col("id").alias("summary_id"), F.col("language").alias("written_in"),
        (present(F.col("title_local")) & present(F.col("summary")) & present(F.col("why_it_matters"))).alias("full"),
    )
    translated = valid.select(F.col("id").alias("summary_id"), F.lit(True).alias("translated"))
    rows = ranked.join(prose, "summary_id", "left").join(translated, "summary_id", "left")
    gap = (
        F.when(F.coalesce(F.col("written_in") != "en", F.lit(True)), "no english summary")
        .when(~F.col("full"), "blank prose")
        .when(F.col("translated").isNull(), "no valid translation")
        .when(present(F.col("reason")) & ~present(F.col("reason_tr")), "reason not translated")
        .when(~present(F.col("reason")) & present(F.col("reason_tr")), "translated reason of none")
    )
    of_items = rows.select(*keys, "summary_id", gap.alias("gap")).where(F.col("gap").isNotNull())
    note = (
        F.when(~present(F.col("editor_note")), "no editor note")
        .when(~present(F.col("editor_note_tr")), "editor note not translated")
    )
    of_heads = heads.join(ranked.select(*keys).distinct(), list(keys), "left_semi").select(
        *keys, F.lit(None).cast("bigint").alias("summary_id"), note.alias("gap")
    ).where(F.col("gap").isNotNull())
    return of_items.unionByName(of_heads)


def coverage_gaps(requested: DataFrame, returned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): ids not covered exactly once. Counting both sides compares them as multisets."""
    both = requested.select(*keys, F.lit(1).alias("d")).unionByName(returned.select(*keys, F.lit(-1).alias("d")))
    off = both.groupBy(*keys).agg(F.sum("d").alias("d")).where("d <> 0")
    return off.select(*keys, F.when(F.col("d") > 0, "missing").otherwise("extra").alias("side"))


def prune(
    articles: DataFrame, summaries: DataFrame, now: Column, max_age_days: int = K.MAX_AGE_DAYS, runs: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(kept, dead): articles past the horizon without a summary go; marks that point at them clear.

    With `runs`, both refuse to be read while one of them is running: the check is part of their plans, so a
    write that would delete fails in its tasks and leaves what is stored as it is.
    """
    if runs is not None:
        articles = articles.where(F.assert_true(in_flight(runs).agg(F.count(F.lit(1))).scalar() == 0, F.lit(BUSY)).isNull())
    done = summaries.select(F.col("article_id").alias("id"))
    dead = articles.where(F.col("fetched_at") < now - days(max_age_days)).join(done, "id", "left_anti").select("id")
    gone = dead.select(F.col("id").alias("dup_of"), F.lit(True).alias("_gone"))
    kept = (
        articles.join(dead, "id", "left_anti").join(gone, "dup_of", "left")
        .withColumn("dup_of", F.when(F.col("_gone").isNull(), F.col("dup_of")))
        .select(articles.columns)
    )
    return kept, dead


BUSY = "a run is in flight; nothing is pruned before it ends"


def in_flight(runs: DataFrame) -> DataFrame:
    """Running runs; a prune is refused while there is one."""
    return runs.where(F.col("status") == "running")


def set_weights(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """Sources with `changed`: parsable weights of 0.5 to 2.0 that differ are taken over.

    The last edit of a source by `seq` counts.
    """
    parsed = edits.withColumn("w", F.bround(F.trim("raw").try_cast("double"), 1)).where(F.col("w").between(0.5, 2.0))
    last = parsed.groupBy("id").agg(F.max_by("w", "seq").alias("w"))
    changed = F.coalesce(F.col("w") != F.col("weight"), F.lit(False))
    return sources.join(last, "id", "left").withColumn("changed", changed).withColumn(
        "weight", F.when(F.col("changed"), F.col("w")).otherwise(F.col("weight"))
    ).drop("w")


def rewritten(summaries: DataFrame, drafts: DataFrame, translations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries with repaired rows in place, and the translations that still stand."""
    columns = [c for c in drafts.columns if c not in ("article_id", "language")]
    d = drafts.select("article_id", "language", F.struct(*columns).alias("_new"))
    joined = summaries.join(d, ["article_id", "language"], "left")
    # A repaired row is replaced whole: a field the draft left empty becomes empty.
    swapped = joined.withColumns({
        c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in columns
    }).select(summaries.columns)
    hit = summaries.where("language = 'en'").join(drafts.select("article_id", "language"), ["article_id", "language"], "left_semi")
    stand = translations.join(hit.select(F.col("id").alias("summary_id")), "summary_id", "left_anti")
    return swapped, stand


def duplicate_summaries(summaries: DataFrame) -> DataFrame:
    """(article_id, language, n) with more than one summary; a rebuild is refused while any is left."""
    return summaries.groupBy("article_id", "language").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def rebuild_bulletins(runs: DataFrame, ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bulletins and items from ranked history.

    `runs` (run_id, language, started_at) that wrote summaries; `ranked` (run_id, summary_id, rank).
    Versions count up inside a local day and language; ids follow the start of the runs.
    """
    # Each numbering reads its rows several times, so the one before is not left for it to repeat.
    dated = cut(numbered(
        cut(runs.withColumn("day", local_day(F.col("started_at")))), ["day", "language"],
        [F.asc("started_at"), F.asc("run_id")], [F.date_trunc("minute", "started_at")],
        "version", [F.col("started_at"), F.col("run_id")],
    ))
    numbered_runs = cut(numbered(
        dated.withColumn("_all", F.lit(0)), ["_all"], [F.asc("started_at"), F.asc("run_id")],
        [F.date_trunc("hour", "started_at")], "id", [F.col("started_at"), F.col("run_id")],
    ).drop("_all"))
    places = numbered(
        ranked.where(F.col("rank").isNotNull()), ["run_id"], [F.asc("rank"), F.asc("summary_id")],
        [F.floor(F.col("rank") / 1024)], "position", [F.col("rank"), F.col("summary_id")],
    )
    items = places.join(numbered_runs.select("run_id", F.col("id").alias("bulletin_id")), "run_id").select(
        "bulletin_id", "summary_id", "position", band(F.col("position")).alias("tier")
    )
    return numbered_runs.select("id", "day", "language", "version", "run_id", "started_at"), items


def rekey_results(results: DataFrame, bulletins: DataFrame) -> DataFrame:
    """Measurements keyed by run get the newest bulletin of their run."""
    newest = bulletins.groupBy("run_id").agg(F.max_by("id", "version").alias("bulletin_id"))
    return results.join(newest, "run_id", "left")


def backfill_kind(runs: DataFrame, retired: str = "manual", now_called: str = "digest") -> DataFrame:
    return runs.withColumn("kind", F.when(F.col("kind") == retired, now_called).otherwise(F.col("kind")))


def backfill_provenance(articles: DataFrame) -> DataFrame:
    """`unknown` where a body already exists and nothing says where it came from."""
    bare = F.col("body_source").isNull() & F.col("body_text").isNotNull() & (F.col("body_text") != "")
    return articles.withColumn("body_source", F.when(bare, "unknown").otherwise(F.col("body_source")))
