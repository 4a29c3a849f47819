"""Queries of the ranking flow, for all days at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from dispatchery import constants as K
from dispatchery.functions.hashing import scatter
from dispatchery.operators import ranking
from dispatchery.plans.reading import pool, r6
from dispatchery.plans.registry import query
from dispatchery.plans.views_sql import BAND, TIER_RANK, scatter_sql
from dispatchery.session import cut

KEYS = ["day", "version"]
WHOLE = 100_000  # days: the pool of every day, whatever its age


@query("a11_borda", "SELECT day, version, summary_id, score, seen, best, position FROM borda")
def a11(a):
    return ranking.borda(a.versioned_readings, KEYS)


@query("w4_positions", "SELECT day, version, summary_id, position FROM borda")
def w4(a):
    return ranking.borda(a.versioned_readings, KEYS).select(*KEYS, "summary_id", "position")


@query("w5_tier_bands", f"SELECT day, version, summary_id, {BAND.format('position')} AS tier FROM borda")
def w5(a):
    return ranking.borda(a.versioned_readings, KEYS).select(
        *KEYS, "summary_id", ranking.band(F.col("position")).alias("tier"))


@query("a12_majority_tier", "SELECT day, version, summary_id, position, tier FROM tiers")
def a12(a):
    picks = a.versioned_readings
    return ranking.majority_tiers(picks, ranking.borda(picks, KEYS), KEYS)


@query("a13_reasons", "SELECT day, version, summary_id, reason FROM reasons")
def a13(a):
    return ranking.first_reasons(a.versioned_readings, KEYS)


@query("a13_editor_note", "SELECT day, version, editor_note FROM best_notes")
def a13_note(a):
    picks = a.versioned_readings
    published = ranking.borda(picks, KEYS).where(F.col("position") <= K.TOP_N)
    return ranking.best_notes(picks, a.notes, published, KEYS)


@query("a14_kendall_tau", """
    SELECT day, version, pass_a, pass_b, round(tau, 6) AS tau, round(jaccard, 6) AS jaccard FROM pass_pairs""")
def a14(a):
    return ranking.pass_pairs(a.versioned_readings, KEYS).select(
        *KEYS, "pass_a", "pass_b", r6("tau").alias("tau"), r6("jaccard").alias("jaccard"))


@query("a15_agreement", """
    SELECT day, version, round(tau, 6) AS tau, round(jaccard, 6) AS jaccard, kept, pool,
      round(agreement, 6) AS agreement FROM agreements""")
def a15(a):
    return ranking.agreement(a.versioned_readings, a.pools, KEYS).select(
        *KEYS, r6("tau").alias("tau"), r6("jaccard").alias("jaccard"), "kept", "pool",
        r6("agreement").alias("agreement"))


POOL_ALL = """
    SELECT s.day, s.id AS summary_id, s.id AS article_id, src.weight, s.importance, s.kind, a.published_at
    FROM summaries s JOIN marked_articles a ON a.id = s.article_id JOIN sources src ON src.id = a.source_id
    WHERE s.relevant AND a.dup_of IS NULL
      AND NOT EXISTS (SELECT 1 FROM items i JOIN bulletins b ON b.id = i.bulletin_id
        WHERE i.summary_id = s.id AND b.day <> s.day)"""
ARRANGED = f"""
    SELECT day, 1 AS pass, row_number() OVER (PARTITION BY day
      ORDER BY weight DESC, published_at ASC NULLS LAST, article_id) AS ordinal, summary_id FROM ({POOL_ALL}) q
    UNION ALL
    SELECT day, pass, row_number() OVER (PARTITION BY day, pass
      ORDER BY {scatter_sql("summary_id + 1", "pass + 11")}, summary_id), summary_id
    FROM ({POOL_ALL}) q, (SELECT unnest([2, 3]) AS pass) p"""


@query("w6_arrangements", ARRANGED)
def w6(a):
    return ranking.arrangements(pool(a, WHOLE), ["day"], 11)


ANSWERS = f"""
    SELECT day, pass, ({scatter_sql("summary_id", "pass + 7")}) * 2 AS nth, ordinal AS number FROM ({ARRANGED}) z
    UNION ALL
    SELECT day, pass, ({scatter_sql("summary_id", "pass + 7")}) * 2 + 1, ordinal + 1 FROM ({ARRANGED}) z"""


@query("p15_valid_picks", f"""
    SELECT day, pass, summary_id, position FROM (
      SELECT f.day, f.pass, t.summary_id, row_number() OVER (PARTITION BY f.day, f.pass ORDER BY nth) AS position
      FROM (SELECT day, pass, number, min(nth) AS nth FROM ({ANSWERS}) y GROUP BY day, pass, number) f
      JOIN ({ARRANGED}) t ON t.day = f.day AND t.pass = f.pass AND t.ordinal = f.number) w
    WHERE position <= 5""")
def p15(a):
    arranged = ranking.arrangements(pool(a, WHOLE), ["day"], 11)
    at = scatter(F.col("summary_id"), F.col("pass") + 7) * 2
    answers = arranged.select(
        "day", "pass", F.explode(F.array(
            F.struct(at.alias("nth"), F.col("ordinal").alias("number")),
            F.struct((at + 1).alias("nth"), (F.col("ordinal") + 1).alias("number")))).alias("p"),
        F.lit("brief").alias("tier"), F.lit(" x ").alias("reason"),
    ).select("day", "pass", "p.nth", "p.number", "tier", "reason")
    return ranking.valid_picks(answers, arranged, ["day"], 5).select("day", "pass", "summary_id", "position")


@query("l5_fallback", f"""
    SELECT day, summary_id, position, {BAND.format("position")} AS tier FROM (
      SELECT day, summary_id, row_number() OVER (PARTITION BY day
        ORDER BY importance DESC, weight DESC, published_at ASC NULLS LAST, article_id) AS position
      FROM ({POOL_ALL}) q) z WHERE position <= 15""")
def l5(a):
    return ranking.fallback(pool(a, WHOLE), ["day"])


@query("k2_day_ranking", f"""
    SELECT t.day, t.summary_id, t.position, t.tier, r.reason, n.editor_note, round(g.agreement, 6) AS agreement
    FROM tiers t LEFT JOIN reasons r USING (day, version, summary_id)
    JOIN agreements g USING (day, version) LEFT JOIN best_notes n USING (day, version)
    WHERE version = 2 AND position <= {K.TOP_N}""")
def k2(a):
    notes = a.readings.select("day", "pass").distinct().withColumn(
        "note", F.concat(F.lit("note "), F.col("day"), F.lit("/"), F.col("pass").cast("string")))
    pools = a.summaries.where("relevant").groupBy("day").agg(F.count(F.lit(1)).alias("pool"))
    items, days = ranking.aggregate(a.readings, notes, pools, ["day"])
    return items.join(days.select("day", "editor_note", "agreement"), "day").select(
        "day", "summary_id", "position", "tier", "reason", "editor_note", r6("agreement").alias("agreement"))


UNUSABLE = "CAST(right(day, 2) AS INT) % 4 = 0"
FLOW_ANSWERS = f"""
    SELECT day, pass, ({scatter_sql("summary_id", "pass + 7")}) * 1000000 + ordinal AS nth,
      ordinal + CASE WHEN {UNUSABLE} THEN 1000000000 WHEN ordinal % 3 = 0 THEN 1 ELSE 0 END AS number,
      CASE WHEN summary_id % 9 = 0 THEN 'lead' WHEN (summary_id + pass) % 3 = 0 THEN 'notable' ELSE 'major' END AS tier,
      CASE WHEN (summary_id + pass) % 4 = 0 THEN ' ' ELSE ' for ' || summary_id || '.' || pass END AS reason
    FROM arranged"""


@query("k2_whole_flow", f"""
    SELECT * FROM (WITH pooled AS MATERIALIZED ({POOL_ALL}), arranged AS MATERIALIZED ({ARRANGED}),
    picked AS MATERIALIZED (
      SELECT * FROM (
        SELECT f.day, f.pass, t.summary_id, f.tier, trim(f.reason) AS reason,
          row_number() OVER (PARTITION BY f.day, f.pass ORDER BY f.nth) AS position
        FROM (SELECT day, pass, number, min(nth) AS nth, arg_min(tier, nth) AS tier, arg_min(reason, nth) AS reason
          FROM ({FLOW_ANSWERS}) y GROUP BY day, pass, number) f
        JOIN arranged t ON t.day = f.day AND t.pass = f.pass AND t.ordinal = f.number) w
      WHERE position <= {K.TOP_N}),
    lengths AS (SELECT day, pass, count(*) AS size FROM picked GROUP BY day, pass),
    points AS (
      SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, best, summary_id) AS position
      FROM (SELECT day, summary_id, sum(size - position + 1) AS score, count(*) AS seen, min(position) AS best
        FROM picked JOIN lengths USING (day, pass) GROUP BY day, summary_id) s
      WHERE seen >= (SELECT least(count(*), 2) FROM lengths z WHERE z.day = s.day)),
    votes AS (
      SELECT day, summary_id, tier AS voted, row_number() OVER (PARTITION BY day, summary_id
        ORDER BY count(*) DESC, {TIER_RANK.format("tier")} DESC) AS k
      FROM picked GROUP BY day, summary_id, tier),
    placed AS (
      SELECT day, summary_id, position, CASE WHEN voted = 'lead' AND sum(CASE WHEN voted = 'lead' THEN 1 ELSE 0 END)
          OVER (PARTITION BY day ORDER BY position) > 1 THEN 'major' ELSE voted END AS tier
      FROM points JOIN votes USING (day, summary_id) WHERE k = 1),
    said AS (SELECT day, summary_id, arg_min(reason, pass) AS reason FROM picked WHERE reason <> '' GROUP BY day, summary_id),
    heads AS (
      SELECT day, note AS editor_note FROM (
        SELECT p.day, p.pass, 'note ' || p.day || '/' || p.pass AS note,
          row_number() OVER (PARTITION BY p.day ORDER BY count(b.summary_id) DESC, p.pass) AS k
        FROM picked p LEFT JOIN points b ON b.day = p.day AND b.summary_id = p.summary_id AND b.position <= {K.TOP_N}
        GROUP BY p.day, p.pass) q WHERE k = 1)
    SELECT day, summary_id, position, tier, reason, editor_note,
      (SELECT count(*) FROM lengths z WHERE z.day = placed.day) AS readings
    FROM placed LEFT JOIN said USING (day, summary_id) LEFT JOIN heads USING (day) WHERE position <= {K.TOP_N}
    UNION ALL
    SELECT day, summary_id, position, {BAND.format("position")}, NULL, NULL, 0 FROM (
      SELECT day, summary_id, row_number() OVER (PARTITION BY day
        ORDER BY importance DESC, weight DESC, published_at ASC NULLS LAST, article_id) AS position
      FROM pooled WHERE day NOT IN (SELECT day FROM picked)) z WHERE position <= {K.TOP_N}) flow""")
def k2_flow(a):
    """Pool, arrangements, answers, aggregate; every fourth day of a month has no usable answer."""
    stories = pool(a, WHOLE)
    arranged = cut(ranking.arrangements(stories, ["day"], 11))
    i, off = F.col("summary_id"), F.col("summary_id") + F.col("pass")
    answers = arranged.select(
        "day", "pass", (scatter(i, F.col("pass") + 7) * 1000000 + F.col("ordinal")).alias("nth"),
        (F.col("ordinal") + F.when(F.expr(UNUSABLE), 1000000000).when(F.col("ordinal") % 3 == 0, 1).otherwise(0)).alias("number"),
        F.when(i % 9 == 0, "lead").when(off % 3 == 0, "notable").otherwise("major").alias("tier"),
        F.when(off % 4 == 0, " ").otherwise(F.concat(F.lit(" for "), i.cast("string"), F.lit("."), F.col("pass").cast("string"))).alias("reason"))
    notes = arranged.select("day", "pass").distinct().withColumn(
        "note", F.concat(F.lit("note "), F.col("day"), F.lit("/"), F.col("pass").cast("string")))
    items, days = ranking.rank_days(stories, arranged, answers, notes, ["day"])
    return items.join(days.select("day", "editor_note", "readings"), "day").select(
        "day", "summary_id", "position", "tier", "reason", "editor_note", "readings")
