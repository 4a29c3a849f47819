"""Queries over runs, steps, tokens and money."""

from __future__ import annotations

from pyspark.sql import functions as F

from dispatchery import constants as K
from dispatchery.functions.money import cost, digest_cost, prompt_tokens, usage
from dispatchery.functions.text import note_parts
from dispatchery.operators import curation, ledger
from dispatchery.plans.reading import pool, r6
from dispatchery.plans.registry import query
from dispatchery.plans.views_sql import cost_sql, price_sql
from dispatchery.sources.archive import MODELS, pick


def payloads(a):
    seq = F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    return a.table("lineitem").select(
        F.col("l_orderkey").alias("run_id"), (F.col("l_suppkey") % 5).alias("summary_id"), seq.alias("seq"),
        pick(MODELS, F.col("l_partkey") % 5).alias("model"),
        (F.col("l_quantity") * 100).cast("bigint").alias("tokens_in"),
        (F.col("l_quantity") * 10).cast("bigint").alias("tokens_out"))


PAYLOADS = """
    SELECT l_orderkey AS run_id, l_suppkey % 5 AS summary_id, l_partkey, l_suppkey, l_shipdate, l_quantity,
      l_extendedprice,
      ['gpt-6-luna', 'gpt-5.6-luna', 'gpt-5.6-terra', 'gpt-5.6-sol', 'gpt-6-astra'][CAST(l_partkey % 5 AS INT) + 1] AS model,
      CAST(l_quantity * 100 AS BIGINT) AS tokens_in, CAST(l_quantity * 10 AS BIGINT) AS tokens_out FROM lineitem"""
PAID = f"""
    SELECT run_id, model, tokens_in, tokens_out, 1 AS summary FROM (SELECT *, row_number() OVER (
      PARTITION BY run_id, summary_id ORDER BY l_partkey DESC, l_suppkey DESC, l_shipdate DESC, l_quantity DESC,
      l_extendedprice DESC) AS k FROM ({PAYLOADS}) p) q WHERE k = 1"""


@query("a8_run_ledger", f"""
    SELECT run_id, CAST(sum(summary) AS BIGINT) AS n_summarized, CAST(sum(tokens_in) AS BIGINT) AS tokens_in,
      CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
      round(sum({cost_sql("model", "tokens_in", "tokens_out")}), 6) AS est_cost_usd,
      CASE WHEN bool_or(run_id IN (SELECT id FROM runs WHERE status = 'partial')) THEN 'partial' ELSE 'ok' END AS status
    FROM ({PAID} UNION ALL
      SELECT run_id, model, tokens_in, tokens_out, 0 FROM run_steps WHERE node = 'enrich'
      UNION ALL SELECT run_id, model, tokens_in, tokens_out, 0 FROM run_steps WHERE node IN ('rank', 'translate')) z
    GROUP BY run_id""")
def a8(a):
    steps = a.run_steps
    errors = a.runs.where("status = 'partial'").select(F.col("id").alias("run_id"), F.lit("feed").alias("error"))
    return ledger.run_ledger(
        payloads(a), steps.where("node = 'enrich'"), steps.where("node IN ('rank', 'translate')"), errors,
    ).withColumn("est_cost_usd", r6("est_cost_usd"))


@query("a9_fan_out_step", f"""
    SELECT run_id, n_in, coalesce(n_out, 0) AS n_out, coalesce(tokens_in, 0) AS tokens_in,
      coalesce(tokens_out, 0) AS tokens_out, CASE WHEN coalesce(n_out, 0) < n_in THEN 'partial' ELSE 'ok' END AS status
    FROM (SELECT run_id, count(*) AS n_in FROM run_steps GROUP BY run_id) c
    LEFT JOIN (SELECT run_id, count(DISTINCT summary_id) AS n_out, CAST(sum(tokens_in) AS BIGINT) AS tokens_in,
        CAST(sum(tokens_out) AS BIGINT) AS tokens_out
      FROM (SELECT run_id, summary_id, tokens_in, tokens_out FROM ({PAYLOADS}) p UNION ALL
        SELECT run_id, NULL, tokens_in, tokens_out FROM run_steps WHERE node = 'enrich') u GROUP BY run_id) o
      USING (run_id)""")
def a9(a):
    return ledger.fan_out_steps(a.run_steps.select("run_id"), payloads(a), a.run_steps.where("node = 'enrich'"))


@query("a10_paid_rollup", """
    SELECT run_id, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
      round(sum(est_cost_usd), 6) AS est_cost_usd,
      CAST(coalesce(sum(n_out) FILTER (node = 'summarize'), 0) AS BIGINT) AS n_summarized
    FROM run_steps WHERE model <> '' GROUP BY run_id""")
def a10(a):
    return ledger.paid_rollup(a.run_steps).withColumn("est_cost_usd", r6("est_cost_usd"))


ORPHAN_NOW = "(SELECT max(started_at) FROM runs)"


@query("a10_close_orphans", f"""
    SELECT r.id, CASE WHEN r.status = 'error' THEN 'error' ELSE r.status END AS status,
      CASE WHEN r.status = 'error' THEN coalesce(p.tokens_in, 0) ELSE 0 END AS tokens_in,
      CASE WHEN r.status = 'error' THEN coalesce(p.n_summarized, 0) ELSE r.n_summarized END AS n_summarized,
      CASE WHEN r.status = 'error' THEN 'process ended before the run did' END AS error,
      CAST(epoch(CASE WHEN r.status = 'error' THEN {ORPHAN_NOW} ELSE r.finished_at END) AS BIGINT) AS finished
    FROM runs r LEFT JOIN (SELECT run_id, CAST(sum(tokens_in) AS BIGINT) AS tokens_in,
        CAST(coalesce(sum(n_out) FILTER (node = 'summarize'), 0) AS BIGINT) AS n_summarized
      FROM run_steps WHERE model <> '' GROUP BY run_id) p ON p.run_id = r.id""")
def a10_orphans(a):
    open_ = a.runs.withColumn("status", F.when(F.col("status") == "error", "running").otherwise(F.col("status")))
    rows = open_.withColumns({"tokens_in": F.lit(0).cast("bigint"), "tokens_out": F.lit(0).cast("bigint"),
                              "error": F.lit(None).cast("string")})
    now = a.runs.agg(F.max("started_at").alias("t")).scalar()
    return ledger.close_orphans(rows, a.run_steps, now).select(
        "id", "status", "tokens_in", "n_summarized", "error", F.unix_seconds("finished_at").alias("finished"))


@query("j15_fan_out_span", """
    SELECT run_id, CAST(epoch(max(finished_at) FILTER (node = 'enrich')) AS BIGINT) AS span_start,
      CAST(epoch(max(started_at) FILTER (node = 'rank')) AS BIGINT) AS span_end
    FROM run_steps GROUP BY run_id HAVING span_start IS NOT NULL AND span_end IS NOT NULL""")
def j15(a):
    return ledger.fan_out_spans(a.run_steps).select(
        "run_id", F.unix_seconds("span_start").alias("span_start"), F.unix_seconds("span_end").alias("span_end"))


MODELS_RUN = """
    SELECT r.id, coalesce(CASE WHEN r.id % 3 = 0 THEN 'gpt-5.6-sol' END, s.model, 'gpt-6-luna') AS model_summarize,
      coalesce(k.model, 'gpt-6-luna') AS model_rank
    FROM runs r
    LEFT JOIN (SELECT run_id, arg_max(model, started_at) AS model FROM run_steps
      WHERE model <> '' AND node = 'summarize' GROUP BY run_id) s ON s.run_id = r.id
    LEFT JOIN (SELECT run_id, arg_max(model, started_at) AS model FROM run_steps
      WHERE model <> '' AND node = 'rank' GROUP BY run_id) k ON k.run_id = r.id"""


@query("j16_models_used", MODELS_RUN)
def j16(a):
    runs = a.runs.select("id", F.when(F.col("id") % 3 == 0, "gpt-5.6-sol").alias("model_summarize"),
                         F.lit(None).cast("string").alias("model_rank"))
    return ledger.models_used(runs, a.run_steps)


@query("w7_run_history", """
    SELECT (SELECT id FROM runs WHERE kind = 'digest' AND status <> 'running' ORDER BY started_at DESC, id DESC LIMIT 1)
        AS last_finished,
      (SELECT CAST(epoch(max(started_at)) AS BIGINT) FROM runs WHERE kind = 'digest' AND status IN ('ok', 'partial'))
        AS last_success_at""")
def w7(a):
    return ledger.run_history(a.runs).select("last_finished", F.unix_seconds("last_success_at").alias("last_success_at"))


@query("w7_last_poll", """
    SELECT CAST(epoch_us(max(ts)) AS BIGINT) AS last_collect_at FROM poll_log
    WHERE source_id IN (SELECT id FROM sources WHERE enabled)""")
def w7_poll(a):
    return ledger.last_poll(a.poll_log, a.sources).select(F.unix_micros("last_collect_at").alias("last_collect_at"))


@query("w10_step_shares", """
    SELECT s.run_id, s.node, row_number() OVER (PARTITION BY s.run_id ORDER BY s.started_at, s.stage) AS place,
      CASE WHEN epoch(r.finished_at - r.started_at) > 0 THEN
        round(epoch(s.finished_at - s.started_at) / epoch(r.finished_at - r.started_at), 6) ELSE 0.0 END AS share
    FROM run_steps s JOIN runs r ON r.id = s.run_id""")
def w10(a):
    return ledger.step_shares(a.runs, a.run_steps).select("run_id", "node", "place", r6("share").alias("share"))


@query("p19_run_advice", f"""
    SELECT CASE WHEN last_success IS NULL THEN 'never' WHEN last_success + INTERVAL 24 HOUR > {ORPHAN_NOW} THEN 'waiting'
      ELSE 'due' END AS state, CAST(epoch(last_success + INTERVAL 24 HOUR) AS BIGINT) AS due_at,
      CAST(epoch(last_success + INTERVAL 24 HOUR - {ORPHAN_NOW}) AS BIGINT) AS seconds_left
    FROM (SELECT max(started_at) FILTER (status IN ('ok', 'partial')) AS last_success FROM runs WHERE kind = 'digest') q""")
def p19(a):
    now = a.runs.agg(F.max("started_at").alias("t")).scalar()
    return ledger.run_advice(a.runs, now).select(
        "state", F.unix_seconds("due_at").alias("due_at"), F.col("seconds_left").cast("bigint").alias("seconds_left"))


@query("p20_cost_gate", f"""
    SELECT candidates, pool, selected, round(estimate, 6) AS estimate, estimate > 1.0 AS refused FROM (
      SELECT *, {cost_sql("'gpt-5.6-sol'", "candidates * 1438", "candidates * 513")}
        + {cost_sql("'gpt-6-luna'", "pool * 3 * 172", "pool * 3 * 105")}
        + CASE WHEN selected > 0 THEN {cost_sql("'gpt-5.6-sol'", "selected * 900 + 1800", "selected * 900 + 1000")} ELSE 0 END
        AS estimate
      FROM (SELECT c AS candidates, c + p AS pool, least(15, c + p) AS selected FROM (
        SELECT (SELECT count(*) FROM articles WHERE id NOT IN (SELECT article_id FROM summaries)) AS c,
          (SELECT count(*) FROM summaries WHERE relevant) AS p) x) y) z""")
def p20(a):
    todo = a.articles.join(a.summaries.select(F.col("article_id").alias("id")), "id", "left_anti")
    gate = ledger.cost_gate(todo, a.summaries.where("relevant"), "gpt-5.6-sol", "gpt-6-luna")
    return gate.withColumn("estimate", r6("estimate"))


@query("f9_price_lookup", f"""
    SELECT id, round({price_sql("model || '-x'", 0)}, 6) AS price_in, round({price_sql("substr(model, 1, 7)", 1)}, 6) AS other,
      round(est_cost_usd, 8) AS est_cost_usd FROM summaries""")
def f9(a):
    from dispatchery.functions.money import price
    longer = F.concat(F.col("model"), F.lit("-x"))
    return a.summaries.select("id", price(longer, 0).alias("price_in"),
                              price(F.substring("model", 1, 7), 1).alias("other"),
                              # Whole tokens at prices of two decimals: exact at eight places, so no ties.
                              F.round("est_cost_usd", 8).alias("est_cost_usd"))


@query("f10_token_estimate", f"""
    SELECT role, CAST(sum(tokens) AS BIGINT) AS tokens_in, count(*) * 80 AS tokens_out,
      round({cost_sql("'gpt-6-luna'", "sum(tokens)", "count(*) * 80")}, 6) AS est_cost_usd
    FROM messages GROUP BY role""")
def f10(a):
    n_in, n_out = F.sum(prompt_tokens(F.col("text"))), F.count(F.lit(1)) * K.JUDGE_OUTPUT_TOKENS
    return a.messages.groupBy("role").agg(
        n_in.alias("tokens_in"), n_out.alias("tokens_out"),
        F.round(cost(F.lit("gpt-6-luna"), n_in, n_out), 6).alias("est_cost_usd"))


@query("f11_usage", """
    SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 AND turn % 2 = 0 THEN turn + 1 ELSE tokens END AS tokens_in,
      CASE WHEN conv_id % 3 = 0 AND turn % 2 = 0 THEN 7 ELSE turn END AS tokens_out FROM messages""")
def f11(a):
    legacy = (F.col("conv_id") % 3 == 0) & (F.col("turn") % 2 == 0)
    modern = F.struct(
        F.when(legacy, F.lit(0)).otherwise(F.col("tokens")).alias("input_tokens"),
        F.when(legacy, F.lit(0)).otherwise(F.col("turn")).alias("output_tokens"))
    older = F.struct(F.struct(
        F.when(legacy, F.col("turn") + 1).otherwise(F.lit(0)).alias("prompt_tokens"),
        F.when(legacy, F.lit(7)).otherwise(F.lit(0)).alias("completion_tokens")).alias("token_usage"))
    message = F.to_json(F.struct(modern.alias("usage_metadata"), older.alias("response_metadata")))
    read = usage(message)
    return a.messages.select("conv_id", "turn", read["tokens_in"].alias("tokens_in"), read["tokens_out"].alias("tokens_out"))


@query("f12_digest_estimate", f"""
    SELECT day, count(*) AS candidates, round({cost_sql("'gpt-6-luna'", "count(*) * 1438", "count(*) * 513")}
      + {cost_sql("'gpt-5.6-terra'", "count(*) * 2 * 3 * 172", "count(*) * 2 * 3 * 105")}
      + {cost_sql("'gpt-6-luna'", "least(15, count(*) * 2) * 900 + 1800", "least(15, count(*) * 2) * 900 + 1000")}, 6) AS estimate
    FROM summaries GROUP BY day""")
def f12(a):
    counts = a.summaries.groupBy("day").agg(F.count(F.lit(1)).alias("candidates"))
    n = F.col("candidates")
    return counts.select("day", "candidates", F.round(digest_cost(
        n, n * 2, F.least(F.lit(15), n * 2), F.lit("gpt-6-luna"), F.lit("gpt-5.6-terra")), 6).alias("estimate"))


@query("f14_step_note", """
    SELECT run_id, stage, CASE WHEN run_id % 4 = 0 THEN 'timeout {x}' END AS plain,
      CASE WHEN run_id % 4 <> 0 AND run_id % 4 <> 1 THEN node END AS key,
      CASE WHEN run_id % 4 <> 0 AND run_id % 4 <> 1 THEN CAST(n_out AS VARCHAR) END AS dropped FROM run_steps""")
def f14(a):
    structured = F.to_json(F.struct(F.col("node").alias("k"), F.col("n_out").alias("dropped")))
    detail = (F.when(F.col("run_id") % 4 == 0, "timeout {x}").when(F.col("run_id") % 4 == 1, "{broken")
              .otherwise(structured))
    parts = note_parts(F.col("detail"))
    return a.run_steps.withColumn("detail", detail).select(
        "run_id", "stage", F.when(~F.startswith("detail", F.lit("{")), F.col("detail")).alias("plain"),
        F.element_at(parts, "k").alias("key"), F.element_at(parts, "dropped").alias("dropped"))
