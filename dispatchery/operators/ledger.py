"""Runs, steps, tokens and money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchery import constants as K
from dispatchery.functions.calendar import seconds_between
from dispatchery.functions.money import cost, digest_cost
from dispatchery.operators.numbering import latest


def run_ledger(payloads: DataFrame, failures: DataFrame, calls: DataFrame, errors: DataFrame) -> DataFrame:
    """What each run paid for.

    `payloads` (run_id, summary_id, seq, model, tokens_in, tokens_out): the last payload of a
    summary counts. `failures` and `calls` (run_id, model, tokens_in, tokens_out): failed branches,
    and ranking or translation calls at their own models. `errors` (run_id, error).
    """
    paid = latest(payloads, ["run_id", "summary_id"], F.col("seq"), ["model", "tokens_in", "tokens_out"])
    charge = ["run_id", "model", "tokens_in", "tokens_out", "summary"]
    whole = (
        paid.withColumn("summary", F.lit(1)).select(charge)
        .unionByName(failures.withColumn("summary", F.lit(0)).select(charge))
        .unionByName(calls.withColumn("summary", F.lit(0)).select(charge))
    )
    totals = whole.groupBy("run_id").agg(
        F.sum("summary").cast("bigint").alias("n_summarized"),
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.sum(cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out"))).alias("est_cost_usd"),
    )
    broken = errors.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_errors"))
    return totals.join(broken, "run_id", "left").withColumn(
        "status", F.when(F.col("n_errors") > 0, "partial").otherwise("ok")
    ).drop("n_errors")


def fan_out_steps(candidates: DataFrame, payloads: DataFrame, failures: DataFrame) -> DataFrame:
    """The summarise step of each run: candidates in, distinct summaries out, all tokens."""
    n_in = candidates.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_in"))
    both = payloads.select("run_id", "summary_id", "tokens_in", "tokens_out").unionByName(
        failures.select("run_id", F.lit(None).cast("bigint").alias("summary_id"), "tokens_in", "tokens_out")
    )
    out = both.groupBy("run_id").agg(
        F.count_distinct("summary_id").alias("n_out"),
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
    )
    filled = n_in.join(out, "run_id", "left").na.fill(0, ["n_out", "tokens_in", "tokens_out"])
    return filled.withColumn("status", F.when(F.col("n_out") < F.col("n_in"), "partial").otherwise("ok"))


def paid_rollup(steps: DataFrame) -> DataFrame:
    """Per run, what its paid steps add up to."""
    return steps.where(F.col("model") != "").groupBy("run_id").agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.sum("est_cost_usd").alias("est_cost_usd"),
        F.coalesce(F.sum(F.when(F.col("node") == "summarize", F.col("n_out"))), F.lit(0)).alias("n_summarized"),
    )


def close_orphans(runs: DataFrame, steps: DataFrame, now: Column) -> DataFrame:
    """Runs left `running` by a dead process become errors that keep their paid work."""
    open_ = F.col("status") == "running"
    paid = paid_rollup(steps).select(
        F.col("run_id").alias("id"),
        *[F.col(c).alias(f"_{c}") for c in ("tokens_in", "tokens_out", "est_cost_usd", "n_summarized")],
    )
    joined = runs.join(paid, "id", "left")
    swap = {
        c: F.when(open_, F.coalesce(F.col(f"_{c}"), F.lit(0))).otherwise(F.col(c))
        for c in ("tokens_in", "tokens_out", "est_cost_usd", "n_summarized")
    }
    return joined.withColumns({
        **swap,
        "error": F.when(open_, F.lit("process ended before the run did")).otherwise(F.col("error")),
        "finished_at": F.when(open_, now).otherwise(F.col("finished_at")),
        "status": F.when(open_, F.lit("error")).otherwise(F.col("status")),
    }).select(runs.columns)


def fan_out_spans(steps: DataFrame) -> DataFrame:
    """(run_id, started_at, finished_at): from the end of enrich to the start of rank."""
    node = F.col("node")
    return steps.where(node.isin("enrich", "rank")).groupBy("run_id").agg(
        F.max(F.when(node == "enrich", F.col("finished_at"))).alias("span_start"),
        F.max(F.when(node == "rank", F.col("started_at"))).alias("span_end"),
    ).where(F.col("span_start").isNotNull() & F.col("span_end").isNotNull())


def models_used(runs: DataFrame, steps: DataFrame, default: str = K.DEFAULT_MODEL) -> DataFrame:
    """(id, model_summarize, model_rank): the run row, else its newest step, else the default."""
    node, when = F.col("node"), F.struct("started_at", "stage")
    ran = steps.where((F.col("model") != "") & node.isin("summarize", "rank")).groupBy("run_id").agg(
        F.max_by(F.when(node == "summarize", F.col("model")), F.when(node == "summarize", when)).alias("_s"),
        F.max_by(F.when(node == "rank", F.col("model")), F.when(node == "rank", when)).alias("_r"),
    ).withColumnRenamed("run_id", "id")
    return runs.join(ran, "id", "left").select(
        "id",
        F.coalesce("model_summarize", "_s", F.lit(default)).alias("model_summarize"),
        F.coalesce("model_rank", "_r", F.lit(default)).alias("model_rank"),
    )


def run_history(runs: DataFrame) -> DataFrame:
    """One row: the newest finished digest, the newest good one."""
    digest = runs.where(F.col("kind") == "digest")
    order = F.struct("started_at", "id")
    done, good = F.col("status") != "running", F.col("status").isin("ok", "partial")
    return digest.agg(
        F.max_by("id", F.when(done, order)).alias("last_finished"),
        F.max(F.when(good, F.col("started_at"))).alias("last_success_at"),
    )


def last_poll(polls: DataFrame, sources: DataFrame) -> DataFrame:
    """The newest poll of any enabled source."""
    on = sources.where("enabled").select(F.col("id").alias("source_id"))
    return polls.join(on, "source_id", "left_semi").agg(F.max("ts").alias("last_collect_at"))


def run_advice(
    runs: DataFrame, now: Column, running: bool = False, blocked: bool = False,
    hours: int = K.SUGGEST_AFTER_HOURS,
) -> DataFrame:
    """One row: whether a press is worth making, and when it will be."""
    due = F.col("last_success_at") + F.make_dt_interval(F.lit(0), F.lit(hours))
    left = seconds_between(F.col("due_at"), now)
    state = (
        F.when(F.lit(running), "running").when(F.lit(blocked), "blocked")
        .when(F.col("last_success_at").isNull(), "never").when(left > 0, "waiting").otherwise("due")
    )
    return run_history(runs).withColumn("due_at", due).select(
        state.alias("state"), "last_finished", "last_success_at", "due_at", left.alias("seconds_left")
    )


def step_shares(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Each step's share of its run's wall clock, and its place by start. A run has a few steps."""
    wall = runs.select(
        F.col("id").alias("run_id"), seconds_between(F.col("finished_at"), F.col("started_at")).alias("wall")
    )
    took = seconds_between(F.col("finished_at"), F.col("started_at"))
    order = Window.partitionBy("run_id").orderBy("started_at", "stage")
    return steps.withColumn("seconds", took).withColumn("place", F.row_number().over(order)).join(
        wall, "run_id"
    ).select(
        "run_id", "node", "place", "seconds",
        F.when(F.col("wall") > 0, F.col("seconds") / F.nullif("wall", F.lit(0.0))).otherwise(F.lit(0.0)).alias("share"),
    )


def cost_gate(
    candidates: DataFrame, pool: DataFrame, summarize_model: str, rank_model: str,
    ceiling: float = K.COST_CEILING, top_n: int = K.TOP_N,
) -> DataFrame:
    """One row: the estimate of a press and whether it is refused; a ceiling of 0 never refuses."""
    n = candidates.agg(F.count(F.lit(1)).alias("n")).scalar()
    row = pool.agg(F.count(F.lit(1)).alias("in_pool")).select(
        n.alias("candidates"), (F.col("in_pool") + n).alias("pool")
    )
    row = row.withColumn("selected", F.least(F.lit(top_n), F.col("pool")).cast("bigint"))
    return row.withColumn(
        "estimate",
        digest_cost(F.col("candidates"), F.col("pool"), F.col("selected"), F.lit(summarize_model), F.lit(rank_model)),
    ).withColumn("refused", (F.lit(ceiling) > 0) & (F.col("pool") > 0) & (F.col("estimate") > ceiling))
