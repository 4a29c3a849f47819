"""What runs publish: the ranking of each as the next version of its day, the checks of that day, and the run's own row.

A run names a day and a language. Inputs are keyed by `run_id`: `ranked` (summary_id, position, tier, reason, reason_tr),
`heads` (day, language, editor_note, editor_note_tr, agreement, model_rank), and what the run was charged. Many runs are
published at once; two runs of one day become two versions in the order of their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchery.functions.money import cost
from dispatchery.functions.text import present, strip
from dispatchery.operators import quality, reading
from dispatchery.operators.ledger import run_ledger
from dispatchery.operators.numbering import numbered
from dispatchery.operators.sinks import publication_gaps
from dispatchery.session import cut

SHOWN_ERRORS = 20
PARTS = ("bulletins", "items", "checks", "figures", "runs")


def next_bulletins(bulletins: DataFrame, ranked: DataFrame, heads: DataFrame, calls: DataFrame, now: Column) -> DataFrame:
    """The bulletin row of each run that ranked anything; ids and versions go on from the stored ones.

    A bulletin costs its ranking alone: translations and summaries are charged to the run and to their own rows.
    """
    top = bulletins.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    last = bulletins.groupBy("day", "language").agg(F.max("version").alias("_last"))
    spent = calls.where("node = 'rank'").groupBy("run_id").agg(
        F.sum(cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out"))).alias("est_cost_usd"))
    of_day = Window.partitionBy("day", "language").orderBy("run_id")
    rows = (
        heads.join(ranked.select("run_id").distinct(), "run_id", "left_semi")
        .join(last, ["day", "language"], "left").join(spent, "run_id", "left").na.fill(0.0, ["est_cost_usd"])
        .withColumn("version", (F.coalesce("_last", F.lit(0)) + F.row_number().over(of_day)).cast("int"))
    )
    # The day is the bucket, so ids are counted inside days and only the days' counts meet in one task.
    return numbered(rows, [], [F.asc("language"), F.asc("version")], [F.col("day")], "_n").select(
        (F.col("_n") + top).cast("bigint").alias("id"), "day", "language", "version", strip(F.col("editor_note")).alias("editor_note"),
        strip(F.col("editor_note_tr")).alias("editor_note_tr"), F.lit(True).alias("bilingual"), "model_rank", "agreement",
        "est_cost_usd", "run_id", now.alias("created_at"),
    )


def bulletin_items(new: DataFrame, ranked: DataFrame) -> DataFrame:
    """The items of new bulletins; blank reasons are stored as null."""
    def kept(name):
        return F.when(present(F.col(name)), strip(F.col(name))).alias(name)

    return ranked.join(new.select("run_id", F.col("id").alias("bulletin_id")), "run_id").select(
        "bulletin_id", "summary_id", "position", "tier", kept("reason"), kept("reason_tr"))


def run_rows(
    runs: DataFrame, payloads: DataFrame, failures: DataFrame, calls: DataFrame, errors: DataFrame, now: Column
) -> DataFrame:
    """The closed row of each run (run_id, n_collected, n_new): its bill, its first errors by `seq`, its status.

    A run without any charge is closed with zeros. Every error makes a run partial; twenty are shown.
    """
    bill = run_ledger(payloads, failures, calls, errors.select("run_id", "error")).drop("status")
    first = Window.partitionBy("run_id").orderBy("seq", "error")
    shown = errors.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= SHOWN_ERRORS).groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("_k", "error"))).alias("_shown"))
    text = F.array_join(F.col("_shown.error"), "\n")
    return runs.join(bill, "run_id", "left").join(shown, "run_id", "left").na.fill(
        0, ["n_collected", "n_new", "n_summarized", "tokens_in", "tokens_out", "est_cost_usd"]
    ).select(
        "run_id", "n_collected", "n_new", "n_summarized", "tokens_in", "tokens_out", "est_cost_usd",
        F.when(F.length(text) > 0, text).alias("error"),
        F.when(F.col("_shown").isNotNull(), "partial").otherwise("ok").alias("status"), now.alias("finished_at"),
    )


def prepare(
    stored: dict[str, DataFrame], runs: DataFrame, ranked: DataFrame, heads: DataFrame, summaries: DataFrame, valid: DataFrame,
    facts: DataFrame, payloads: DataFrame, failures: DataFrame, calls: DataFrame, errors: DataFrame, now: Column,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables to store by name in PARTS, gaps of refused runs).

    A run whose row is stored already is left out, so running it again changes nothing. A run with a gap is
    refused whole: no bulletin, no items and no row, and it may be tried again. A run that ranked nothing only
    closes its row: an empty version would take the reader's bulletin away.
    """
    fresh = runs.join(stored["runs"].select("run_id"), "run_id", "left_anti")

    def of(df, ids):
        return df.join(ids.select("run_id"), "run_id", "left_semi")

    gaps = cut(publication_gaps(of(ranked, fresh), of(heads, fresh), summaries, valid, ("run_id",)))
    open_ = cut(fresh.join(gaps.select("run_id").distinct(), "run_id", "left_anti"))
    mine = of(ranked, open_)
    # A row a run: cut, so that every table below sees the same ids.
    new = cut(next_bulletins(stored["bulletins"], mine, of(heads, open_), calls, now))
    items = bulletin_items(new, mine)
    # Summaries a new bulletin can hold are marked once, however many versions of a day are published.
    held = summaries.join(new.select("day", "language").distinct(), ["day", "language"], "left_semi").select("id").unionByName(
        items.select(F.col("summary_id").alias("id"))).distinct()
    marks = quality.story_marks(
        quality.with_facts(summaries.join(held, "id", "left_semi"), facts), ["id", "day", "language"])
    stories = reading.day_stories(new, items, marks)
    tables = {
        "bulletins": new,
        "items": items,
        "checks": quality.checks_of(stories, ["bulletin_id"]),
        "figures": quality.figures(stories, ["bulletin_id"]),
        "runs": run_rows(open_, *[of(t, open_) for t in (payloads, failures, calls, errors)], now),
    }
    return tables, gaps
