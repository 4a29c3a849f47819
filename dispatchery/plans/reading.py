"""Queries of the dashboard's reading pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from dispatchery.functions.calendar import day_end, day_start, relative_age
from dispatchery.functions.text import present
from dispatchery.operators import ranking, reading
from dispatchery.operators.numbering import numbered
from dispatchery.plans.registry import query
from dispatchery.plans.views_sql import DAY

R6 = "round({}, 6)"
LATER = "(SELECT max(started_at) FROM runs)"


def r6(col):
    return F.round(col, 6)


@query("a2_articles_per_source", """
    SELECT s.id, s.name, s.enabled, s.weight, count(a.id) AS n_articles,
      row_number() OVER (ORDER BY s.enabled DESC, s.name) AS place
    FROM sources s LEFT JOIN articles a ON a.source_id = s.id
    GROUP BY s.id, s.name, s.enabled, s.weight""")
def a2(a):
    rows = reading.articles_per_source(a.sources, a.articles)
    placed = numbered(rows.withColumn("_all", F.lit(0)), ["_all"], [F.desc("enabled"), F.asc("name")],
                      [~F.col("enabled"), F.substring("name", 1, 6)], "place")
    return placed.select("id", "name", "enabled", "weight", "n_articles", "place")


@query("a1_counts", """
    SELECT (SELECT count(*) FROM bulletins) AS archive,
      (SELECT count(*) FROM sources WHERE enabled) AS enabled_sources,
      (SELECT count(*) FROM articles) AS articles, (SELECT count(*) FROM summaries) AS summaries,
      (SELECT count(*) FROM items) AS items, (SELECT count(*) FROM verdicts) AS verdicts,
      (SELECT count(*) FROM articles WHERE id NOT IN (SELECT article_id FROM summaries)) AS candidates""")
def a1(a):
    def n(df):
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()
    todo = a.articles.join(a.summaries.select(F.col("article_id").alias("id")), "id", "left_anti")
    return a.spark.range(1).select(
        n(a.bulletins).alias("archive"), n(a.sources.where("enabled")).alias("enabled_sources"),
        n(a.articles).alias("articles"), n(a.summaries).alias("summaries"), n(a.items).alias("items"),
        n(a.verdicts).alias("verdicts"), n(todo).alias("candidates"),
    )


@query("a1_items_per_bulletin", "SELECT bulletin_id, count(*) AS n FROM items GROUP BY bulletin_id")
def a1_items(a):
    return a.items.groupBy("bulletin_id").agg(F.count(F.lit(1)).alias("n"))


@query("j1_story_star", """
    SELECT s.id, src.name AS source, src.weight, a.url AS article_url, s.title_local, s.importance
    FROM summaries s JOIN articles a ON a.id = s.article_id JOIN sources src ON src.id = a.source_id""")
def j1(a):
    return reading.star(a.summaries, a.articles, a.sources).select(
        "id", "source", "weight", "article_url", "title_local", "importance")


@query("j2_story_verdict", """
    SELECT s.id, v.verdict, v.reason AS verdict_reason, v.note AS verdict_note
    FROM summaries s LEFT JOIN verdicts v ON v.summary_id = s.id AND v.verdict = 'wrong'""")
def j2(a):
    return reading.with_verdict(a.summaries.select("id"), a.verdicts)


DAY_STORIES = """
    SELECT b.id AS bulletin_id, s.id, i.position, i.tier, s.importance, s.relevant
    FROM bulletins b JOIN summaries s ON s.language = b.language
    LEFT JOIN items i ON i.bulletin_id = b.id AND i.summary_id = s.id
    WHERE i.summary_id IS NOT NULL OR s.day = b.day"""


@query("j3_day_stories", DAY_STORIES)
def j3(a):
    return reading.day_stories(a.bulletins, a.items, a.summaries).select(
        "bulletin_id", "id", "position", "tier", "importance", "relevant")


@query("j4_unsummarised", """
    SELECT id, source_id FROM articles a
    WHERE NOT EXISTS (SELECT 1 FROM summaries s WHERE s.article_id = a.id)""")
def j4(a):
    done = a.summaries.select(F.col("article_id").alias("id"))
    return a.articles.select("id", "source_id").join(done, "id", "left_anti")


POOL_SQL = """
    SELECT s.day, s.id AS summary_id, src.name AS source, src.weight, s.importance, s.kind,
      round(epoch(c.now - coalesce(a.published_at, a.fetched_at)) / 3600.0, 6) AS age_hours
    FROM summaries s JOIN marked_articles a ON a.id = s.article_id
    JOIN sources src ON src.id = a.source_id, clock c
    WHERE s.language = 'en' AND s.relevant AND a.dup_of IS NULL
      AND a.fetched_at >= c.now - to_days({days})
      AND NOT EXISTS (SELECT 1 FROM items i JOIN bulletins b ON b.id = i.bulletin_id
        WHERE i.summary_id = s.id AND b.day <> s.day)"""


def published(a):
    return a.items.select("summary_id", "bulletin_id").join(
        a.bulletins.select(F.col("id").alias("bulletin_id"), "day"), "bulletin_id").select("summary_id", "day")


def pool(a, days=7):
    asked = a.summaries.withColumnRenamed("id", "summary_id").drop("source_id")
    return ranking.day_pool(
        asked, a.marked_articles, a.sources, published(a), a.now.scalar(), max_age_days=days)


@query("p11_day_pool", POOL_SQL.format(days=7))
def p11(a):
    return pool(a).select("day", "summary_id", "source", "weight", "importance", "kind", r6("age_hours").alias("age_hours"))


@query("j5_published_elsewhere", """
    SELECT d.day, s.id AS summary_id FROM (SELECT DISTINCT day FROM bulletins) d JOIN summaries s
      ON s.day = d.day
    WHERE NOT EXISTS (SELECT 1 FROM items i JOIN bulletins b ON b.id = i.bulletin_id
      WHERE i.summary_id = s.id AND b.day <> d.day)""")
def j5(a):
    bounds = published(a).groupBy("summary_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    asked = a.summaries.select("day", F.col("id").alias("summary_id")).join(
        a.bulletins.select("day").distinct(), "day", "left_semi")
    return asked.join(bounds, "summary_id", "left").where(
        F.col("lo").isNull() | ((F.col("lo") == F.col("day")) & (F.col("hi") == F.col("day")))
    ).select("day", "summary_id")


REST = """
    SELECT b.id AS bulletin_id, s.id, s.importance
    FROM bulletins b JOIN summaries s ON s.day = b.day
    WHERE s.relevant AND (s.language = 'en' OR (NOT b.bilingual AND s.language = b.language))
      AND NOT EXISTS (SELECT 1 FROM items i WHERE i.bulletin_id = b.id AND i.summary_id = s.id)"""


@query("j6_rest_of_day", REST)
def j6(a):
    return reading.rest_of_day(a.bulletins, a.items, a.summaries).select("bulletin_id", "id", "importance")


@query("j7_unattributed", """
    SELECT id FROM articles a WHERE body_source = 'unknown'
      AND EXISTS (SELECT 1 FROM summaries s WHERE s.article_id = a.id)""")
def j7(a):
    return a.articles.where("body_source = 'unknown'").select("id").join(
        a.summaries.select(F.col("article_id").alias("id")), "id", "left_semi")


@query("j8_reference_titles", """
    SELECT id, title FROM marked_articles, clock
    WHERE fetched_at >= now - INTERVAL 72 HOUR AND dup_of IS NULL AND title <> ''
      AND id NOT IN (SELECT a.id FROM marked_articles a, clock c WHERE a.dup_of IS NULL
        AND a.fetched_at >= c.now - INTERVAL 7 DAY AND a.id NOT IN (SELECT article_id FROM summaries))""")
def j8(a):
    from dispatchery.operators import curation
    now = a.now.scalar()
    todo = curation.candidates(a.marked_articles, a.summaries, now)
    return curation.reference_articles(a.marked_articles, todo, now).select("id", "title")


@query("j11_duplicate_titles", """
    SELECT d.id AS article_id, d.dup_of, d.title, s.title AS dup_of_title
    FROM marked_articles d JOIN articles s ON s.id = d.dup_of""")
def j11(a):
    kept = a.articles.select(F.col("id").alias("dup_of"), F.col("title").alias("dup_of_title"))
    return a.marked_articles.where("dup_of IS NOT NULL").select(
        F.col("id").alias("article_id"), "dup_of", "title").join(kept, "dup_of").select(
        "article_id", "dup_of", "title", "dup_of_title")


@query("j12_home_bulletin", """
    SELECT s.id AS summary_id, h.bulletin_id FROM summaries s LEFT JOIN (
      SELECT summary_id, bulletin_id, row_number() OVER (PARTITION BY summary_id
        ORDER BY day DESC, version DESC) AS k
      FROM items i JOIN bulletins b ON b.id = i.bulletin_id) h ON h.summary_id = s.id AND h.k = 1""")
def j12(a):
    return a.summaries.select(F.col("id").alias("summary_id")).join(
        reading.home_bulletins(a.items, a.bulletins), "summary_id", "left")


@query("j13_previous_headlines", """
    SELECT d.day, d.language, place, l.summary_id, s.title_local
    FROM (SELECT day, language, lag(last_id) OVER (PARTITION BY language ORDER BY day) AS prev
      FROM (SELECT day, language, arg_max(id, version) AS last_id FROM bulletins GROUP BY day, language) q) d
    JOIN (SELECT bulletin_id, summary_id, row_number() OVER (PARTITION BY bulletin_id ORDER BY position) AS place
      FROM items) l ON l.bulletin_id = d.prev AND place <= 8
    JOIN summaries s ON s.id = l.summary_id""")
def j13(a):
    return reading.previous_headlines(a.bulletins, a.items, a.summaries)


@query("j14_day_bounds", f"""
    SELECT day, count(*) AS n, CAST(epoch(CAST(day AS TIMESTAMP) - INTERVAL 3 HOUR) AS BIGINT) AS starts,
      CAST(epoch(CAST(day AS TIMESTAMP) + INTERVAL 21 HOUR) AS BIGINT) AS ends,
      CAST(epoch(min(fetched_at)) AS BIGINT) AS first_at
    FROM (SELECT {DAY.format("fetched_at")} AS day, fetched_at FROM articles) q GROUP BY day""")
def j14(a):
    from dispatchery.functions.calendar import local_day
    days = a.articles.select(local_day(F.col("fetched_at")).alias("day"), "fetched_at").groupBy("day").agg(
        F.count(F.lit(1)).alias("n"), F.min("fetched_at").alias("first_at"))
    return days.select("day", "n", F.unix_seconds(day_start(F.col("day"))).alias("starts"),
                       F.unix_seconds(day_end(F.col("day"))).alias("ends"),
                       F.unix_seconds("first_at").alias("first_at"))


@query("w1_current_bulletin", """
    SELECT day, id AS bulletin_id FROM bulletins b WHERE (version, id) =
      (SELECT (version, id) FROM bulletins c WHERE c.day = b.day ORDER BY version DESC, id DESC LIMIT 1)
    UNION ALL SELECT 'latest', (SELECT id FROM bulletins ORDER BY day DESC, version DESC, id DESC LIMIT 1)""")
def w1(a):
    newest = reading.current_bulletins(a.bulletins, by_day=False)
    return reading.current_bulletins(a.bulletins).unionByName(newest.select(F.lit("latest").alias("day"), "bulletin_id"))


@query("w2_superseded", """
    SELECT b.id AS bulletin_id, CASE WHEN n.version > b.version THEN n.id END AS superseded_by
    FROM bulletins b JOIN (SELECT day, language, arg_max(id, version) AS id, max(version) AS version
      FROM bulletins GROUP BY day, language) n USING (day, language)""")
def w2(a):
    return reading.superseded(a.bulletins)


@query("w3_latest_judgement", """
    SELECT summary_id, id AS eval_id, CAST(epoch(created_at) AS BIGINT) AS judged_at, detail AS claim, model,
      row_number() OVER (ORDER BY created_at DESC, id DESC) AS place
    FROM (SELECT *, row_number() OVER (PARTITION BY summary_id ORDER BY created_at DESC, id DESC) AS k
      FROM eval_results WHERE kind = 'grounding') q
    WHERE k = 1 AND passed = false AND trim(coalesce(detail, '')) <> ''""")
def w3(a):
    rows = reading.findings(a.eval_results).withColumn("_all", F.lit(0))
    placed = numbered(rows, ["_all"], [F.desc("created_at"), F.desc("id")],
                      [-F.unix_seconds(F.date_trunc("day", "created_at"))], "place",
                      [-F.unix_micros("created_at"), -F.col("id")])
    return placed.select("summary_id", F.col("id").alias("eval_id"), F.unix_seconds("created_at").alias("judged_at"),
                         F.col("detail").alias("claim"), "model", "place")


@query("l1_survivor_order", f"""
    SELECT a.id AS article_id, {DAY.format("a.fetched_at")} AS day,
      row_number() OVER (PARTITION BY {DAY.format("a.fetched_at")}
        ORDER BY s.weight DESC, a.published_at ASC NULLS LAST, a.id) AS place
    FROM articles a JOIN sources s ON s.id = a.source_id""")
def l1(a):
    from dispatchery.functions.calendar import local_day
    rows = a.articles.select(F.col("id").alias("article_id"), "source_id", "published_at",
                             local_day(F.col("fetched_at")).alias("day")).join(
        a.sources.select(F.col("id").alias("source_id"), "weight"), "source_id")
    return numbered(rows, ["day"], ranking.survivor_order(),
                    [-F.col("weight"), F.col("published_at").isNull(), F.date_trunc("hour", "published_at")],
                    "place", ranking.survivor_ties()).select("article_id", "day", "place")


@query("l2_reading_order", f"""
    SELECT bulletin_id, id, position, row_number() OVER (PARTITION BY bulletin_id
      ORDER BY position ASC NULLS LAST, importance DESC, id) AS place FROM ({DAY_STORIES}) q""")
def l2(a):
    stories = reading.day_stories(a.bulletins, a.items, a.summaries).select(
        "bulletin_id", "id", "position", "importance")
    return reading.reading_order(stories).select("bulletin_id", "id", "position", "place")


@query("l2_ranked_order", """
    SELECT bulletin_id, string_agg(CAST(summary_id AS VARCHAR), ',' ORDER BY position) AS ids
    FROM items GROUP BY bulletin_id""")
def l2_ranked(a):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("position", "summary_id"))),
                      lambda s: s["summary_id"].cast("string"))
    return a.items.groupBy("bulletin_id").agg(F.array_join(ids, ",").alias("ids"))


@query("l3_bulletin_list", """
    SELECT i.bulletin_id, i.position AS place, s.id, src.name AS source, i.tier, v.reason AS verdict_reason,
      CASE i.tier WHEN 'lead' THEN 5 WHEN 'major' THEN 4 WHEN 'notable' THEN 3 WHEN 'brief' THEN 2
        ELSE s.importance END AS step
    FROM items i JOIN summaries s ON s.id = i.summary_id JOIN sources src ON src.id = s.source_id
    LEFT JOIN verdicts v ON v.summary_id = s.id""")
def l3(a):
    held = a.items.select("bulletin_id", F.col("position").alias("place"), F.col("summary_id").alias("id"), "tier")
    stories = reading.with_verdict(reading.star(a.summaries, a.articles, a.sources), a.verdicts)
    return stories.join(held, "id").select(
        "bulletin_id", "place", "id", "source", "tier", "verdict_reason",
        reading.display_step(F.col("tier"), F.col("importance")).alias("step"))


@query("l3_rest_list", f"""
    SELECT bulletin_id, id, row_number() OVER (PARTITION BY bulletin_id ORDER BY importance DESC, id) AS place
    FROM ({REST}) q""")
def l3_rest(a):
    rest = reading.rest_of_day(a.bulletins, a.items, a.summaries).select("bulletin_id", "id", "importance")
    return reading.ordered_rest(rest).select("bulletin_id", "id", "place")


@query("l4_recent_runs", """
    SELECT id, kind, status, CAST(epoch(started_at) AS BIGINT) AS started, place, total, total > 12 AS more,
      greatest(24, least(total, 12) + 1) AS next_limit
    FROM (SELECT *, row_number() OVER (ORDER BY started_at DESC, id DESC) AS place,
      (SELECT count(*) FROM runs) AS total FROM runs) q WHERE place <= 12""")
def l4(a):
    shown = reading.page(a.runs, [F.desc("started_at"), F.desc("id")], None, 12)
    return shown.select("id", "kind", "status", F.unix_seconds("started_at").alias("started"), "place", "total",
                        "more", "next_limit")


@query("l4_bulletins_page", """
    SELECT id, day, version, place, total, total > 30 AS more, greatest(60, least(total, 30) + 1) AS next_limit
    FROM (SELECT *, row_number() OVER (ORDER BY day DESC, version DESC, id DESC) AS place,
      (SELECT count(*) FROM bulletins) AS total FROM bulletins) q WHERE place <= 30""")
def l4_bulletins(a):
    shown = reading.page(a.bulletins, [F.desc("day"), F.desc("version"), F.desc("id")], None, 30)
    return shown.select("id", "day", "version", "place", "total", "more", "next_limit")


@query("l8_resolve", """
    SELECT ref, CASE WHEN ref = 'latest' THEN (SELECT id FROM bulletins ORDER BY day DESC, version DESC, id DESC LIMIT 1)
      WHEN ref NOT LIKE '%-%' THEN (SELECT id FROM bulletins b WHERE CAST(b.id AS VARCHAR) = ref)
      ELSE (SELECT id FROM bulletins b WHERE b.day = split_part(ref, ':', 1)
        AND (ref NOT LIKE '%:%' OR b.language = split_part(ref, ':', 2))
        ORDER BY version DESC, id DESC LIMIT 1) END AS bulletin_id
    FROM (SELECT 'latest' AS ref UNION SELECT day FROM bulletins UNION SELECT day || ':en' FROM bulletins
      UNION SELECT day || ':tr' FROM bulletins UNION SELECT CAST(id AS VARCHAR) FROM bulletins) q""")
def l8(a):
    refs = a.bulletins.select(F.explode(F.array(
        F.lit("latest"), "day", F.concat("day", F.lit(":en")), F.concat("day", F.lit(":tr")),
        F.col("id").cast("string"))).alias("ref")).distinct()
    return reading.resolve(a.bulletins, refs)


@query("l9_labelled_stories", """
    SELECT v.summary_id, h.bulletin_id, CAST(epoch(v.created_at) AS BIGINT) AS decided_at, src.name AS source,
      v.reason, v.note, row_number() OVER (ORDER BY v.created_at DESC, v.summary_id) AS place,
      (SELECT count(*) FROM verdicts WHERE verdict = 'wrong') AS total
    FROM verdicts v JOIN summaries s ON s.id = v.summary_id JOIN sources src ON src.id = s.source_id
    LEFT JOIN (SELECT summary_id, arg_max(bulletin_id, b.day || '/' || b.version) AS bulletin_id
      FROM items i JOIN bulletins b ON b.id = i.bulletin_id GROUP BY summary_id) h ON h.summary_id = v.summary_id
    WHERE v.verdict = 'wrong' QUALIFY place <= 200""")
def l9(a):
    wrong = a.verdicts.where("verdict = 'wrong'")
    stories = wrong.join(
        a.summaries.select(F.col("id").alias("summary_id"), "source_id"), "summary_id").join(
        a.sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id")
    shown = reading.page(stories, [F.desc("created_at"), F.asc("summary_id")], None, 200)
    return shown.join(reading.home_bulletins(a.items, a.bulletins), "summary_id", "left").select(
        "summary_id", "bulletin_id", F.unix_seconds("created_at").alias("decided_at"), "source", "reason", "note",
        "place", "total")


@query("a3_verdict_counts", f"""
    SELECT bulletin_id, count(*) AS wrong, count(*) FILTER (v.reason = 'wrong_fact') AS wrong_fact,
      count(*) FILTER (v.reason = 'not_news') AS not_news, count(*) FILTER (v.reason = 'duplicate') AS duplicate,
      count(*) FILTER (v.reason = 'wrong_place') AS wrong_place
    FROM ({DAY_STORIES}) q JOIN verdicts v ON v.summary_id = q.id WHERE v.verdict = 'wrong' GROUP BY bulletin_id""")
def a3(a):
    return reading.verdict_counts(reading.day_stories(a.bulletins, a.items, a.summaries), a.verdicts)


@query("a4_spend_window", f"""
    SELECT (SELECT count(*) FROM runs WHERE kind = 'digest' AND started_at >= {LATER} - INTERVAL 30 DAY) AS product_runs,
      round((SELECT coalesce(sum(est_cost_usd), 0) FROM runs WHERE kind = 'digest'
        AND started_at >= {LATER} - INTERVAL 30 DAY), 6) AS product_cost,
      round((SELECT coalesce(sum(est_cost_usd), 0) FROM eval_results
        WHERE created_at >= (SELECT max(created_at) FROM eval_results) - INTERVAL 30 DAY), 6) AS eval_cost""")
def a4(a):
    last_run = a.runs.agg(F.max("started_at").alias("t")).scalar()
    last_eval = a.eval_results.agg(F.max("created_at").alias("t")).scalar()
    month = F.expr("interval 30 days")
    product = a.runs.where((F.col("kind") == "digest") & (F.col("started_at") >= last_run - month))
    judged = a.eval_results.where(F.col("created_at") >= last_eval - month)
    total = F.round(F.coalesce(F.sum("est_cost_usd"), F.lit(0.0)), 6)
    return a.spark.range(1).select(
        product.agg(F.count(F.lit(1)).alias("n")).scalar().alias("product_runs"),
        product.agg(total.alias("c")).scalar().alias("product_cost"),
        judged.agg(total.alias("c")).scalar().alias("eval_cost"))


@query("a5_activity", f"""
    SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(stories, 0) AS stories, round(coalesce(cost, 0), 6) AS cost
    FROM (SELECT unnest(generate_series(CAST({LATER} + INTERVAL 3 HOUR AS DATE) - INTERVAL 6 DAY,
        CAST({LATER} + INTERVAL 3 HOUR AS DATE), INTERVAL 1 DAY)) AS d) x
    LEFT JOIN (SELECT {DAY.format("started_at")} AS day, CAST(sum(n_summarized) AS BIGINT) AS stories,
        sum(est_cost_usd) AS cost
      FROM runs WHERE started_at >= {LATER} - INTERVAL 30 DAY GROUP BY 1) r ON r.day = strftime(d, '%Y-%m-%d')""")
def a5(a):
    now = a.runs.agg(F.max("started_at").alias("t")).scalar()
    return reading.activity(a.runs, now).select("day", "stories", r6("cost").alias("cost"))


@query("a5_spend", f"""
    SELECT round(coalesce(sum(est_cost_usd) FILTER (d = t), 0), 6) AS cost_today,
      round(coalesce(sum(est_cost_usd) FILTER (d BETWEEN t - 6 AND t), 0), 6) AS cost_week,
      round(coalesce(sum(est_cost_usd), 0), 6) AS cost_month
    FROM (SELECT est_cost_usd, CAST(started_at + INTERVAL 3 HOUR AS DATE) AS d,
      CAST({LATER} + INTERVAL 3 HOUR AS DATE) AS t
      FROM runs WHERE started_at >= {LATER} - INTERVAL 30 DAY) q""")
def a5_spend(a):
    now = a.runs.agg(F.max("started_at").alias("t")).scalar()
    return reading.spend(a.runs, now).select(*[r6(c).alias(c) for c in ("cost_today", "cost_week", "cost_month")])


TAG_SQL = """
    SELECT bulletin_id, tag, count(*) FILTER (out) AS published, count(*) AS visible
    FROM (SELECT DISTINCT bulletin_id, id, out, unnest(CAST(tags_json AS JSON)::VARCHAR[]) AS tag FROM (
      SELECT i.bulletin_id, s.id, true AS out, s.tags_json FROM items i JOIN summaries s ON s.id = i.summary_id
      UNION ALL
      SELECT r.bulletin_id, s.id, false, s.tags_json FROM ({rest}) r JOIN summaries s ON s.id = r.id) q) t
    GROUP BY bulletin_id, tag"""


@query("a6_tag_counts", f"""
    SELECT *, row_number() OVER (PARTITION BY bulletin_id ORDER BY visible DESC, tag) AS place
    FROM ({TAG_SQL.format(rest=REST)}) z""")
def a6(a):
    held = a.items.select("bulletin_id", F.col("summary_id").alias("id")).join(
        a.summaries.select("id", "tags_json"), "id")
    rest = reading.rest_of_day(a.bulletins, a.items, a.summaries)
    return numbered(reading.tag_counts(held, rest), ["bulletin_id"], [F.desc("visible"), F.asc("tag")],
                    [-F.col("visible"), F.substring("tag", 1, 2)], "place").select(
        "bulletin_id", "tag", "published", "visible", "place")


@query("a7_impact_bands", """
    SELECT bulletin_id, count(*) FILTER (importance >= 4) AS high, count(*) FILTER (importance = 3) AS mid,
      count(*) FILTER (importance < 3) AS low
    FROM items i JOIN summaries s ON s.id = i.summary_id GROUP BY bulletin_id""")
def a7(a):
    held = a.items.select("bulletin_id", F.col("summary_id").alias("id")).join(
        a.summaries.select("id", "importance"), "id")
    return reading.impact_bands(held, "bulletin_id")


@query("a24_verdict_progress", """
    SELECT (SELECT count(*) FROM verdicts WHERE verdict = 'wrong') AS wrong,
      (SELECT count(*) FROM summaries) AS total""")
def a24(a):
    return a.spark.range(1).select(
        a.verdicts.where("verdict = 'wrong'").agg(F.count(F.lit(1)).alias("n")).scalar().alias("wrong"),
        a.summaries.agg(F.count(F.lit(1)).alias("n")).scalar().alias("total"))


VALID = """
    SELECT s.id, t.title_local AS title_local_tr, t.summary AS summary_tr
    FROM summaries s JOIN translations t ON t.summary_id = s.id
    WHERE t.language = 'tr'
      AND t.canonical_hash = sha256(CAST(to_json([s.title_local, s.summary, s.why_it_matters]) AS VARCHAR))
      AND trim(t.title_local) <> '' AND trim(t.summary) <> '' AND trim(t.why_it_matters) <> ''"""


@query("p12_valid_translation", f"SELECT id, title_local_tr, summary_tr FROM ({VALID}) q")
def p12(a):
    return reading.valid_translations(a.summaries, a.translations).select("id", "title_local_tr", "summary_tr")


@query("p13_language_projection", f"""
    SELECT i.bulletin_id, s.id,
      CASE WHEN b.bilingual AND v.id IS NOT NULL THEN 'tr' ELSE s.language END AS prose_language,
      NOT b.bilingual OR v.id IS NULL AS language_label,
      CASE WHEN b.bilingual AND v.id IS NOT NULL THEN v.title_local_tr ELSE s.title_local END AS shown_title,
      CASE WHEN b.bilingual AND trim(coalesce(i.reason_tr, '')) <> '' THEN i.reason_tr ELSE i.reason END AS shown_reason,
      CASE WHEN b.bilingual AND trim(coalesce(i.reason_tr, '')) <> '' THEN 'tr' ELSE s.language END AS reason_language
    FROM items i JOIN bulletins b ON b.id = i.bulletin_id JOIN summaries s ON s.id = i.summary_id
    LEFT JOIN ({VALID}) v ON v.id = s.id""")
def p13(a):
    held = a.items.select("bulletin_id", F.col("summary_id").alias("id"), "reason", "reason_tr").join(
        a.bulletins.select(F.col("id").alias("bulletin_id"), (~F.col("bilingual")).alias("legacy")), "bulletin_id")
    stories = a.summaries.join(held, "id")
    return reading.project_language(stories, reading.valid_translations(a.summaries, a.translations), "tr").select(
        "bulletin_id", "id", "prose_language", "language_label", "shown_title", "shown_reason", "reason_language")


@query("p13_editor_note", """
    SELECT id AS bulletin_id, CASE WHEN bilingual AND trim(coalesce(editor_note_tr, '')) <> '' THEN editor_note_tr
        ELSE editor_note END AS note,
      CASE WHEN bilingual AND trim(coalesce(editor_note_tr, '')) <> '' THEN 'tr' WHEN bilingual THEN 'en'
        ELSE language END AS note_language
    FROM bulletins""")
def p13_note(a):
    return reading.project_note(a.bulletins, "tr")


@query("p14_tag_filter", """
    SELECT id, tags_json FROM summaries WHERE list_contains(CAST(tags_json AS JSON)::VARCHAR[], 't3')""")
def p14(a):
    return reading.tagged(a.summaries, "t3").select("id", "tags_json")


@query("f15_display_step", """
    SELECT i.bulletin_id, i.summary_id, CASE i.tier WHEN 'lead' THEN 5 WHEN 'major' THEN 4 WHEN 'notable' THEN 3
      WHEN 'brief' THEN 2 ELSE s.importance END AS step
    FROM items i JOIN summaries s ON s.id = i.summary_id""")
def f15(a):
    return a.items.join(a.summaries.select(F.col("id").alias("summary_id"), "importance"), "summary_id").select(
        "bulletin_id", "summary_id", reading.display_step(F.col("tier"), F.col("importance")).alias("step"))


@query("u1_first_seen_union", """
    SELECT summary_id, arg_min(part, part) AS part, arg_min(place, part) AS place FROM (
      SELECT summary_id, 0 AS part, min(position) AS place FROM items GROUP BY summary_id
      UNION ALL SELECT id, 1, id FROM summaries WHERE relevant) q GROUP BY summary_id""")
def u1(a):
    first = a.items.groupBy("summary_id").agg(F.min("position").cast("bigint").alias("place"))
    second = a.summaries.where("relevant").select(F.col("id").alias("summary_id"), F.col("id").alias("place"))
    return reading.first_seen_union([first, second], "summary_id", "place").select("summary_id", "at.part", "at.place")


@query("u2_visible_set", f"""
    SELECT bulletin_id, summary_id FROM items UNION SELECT bulletin_id, id FROM ({REST}) q""")
def u2(a):
    rest = reading.rest_of_day(a.bulletins, a.items, a.summaries).select("bulletin_id", F.col("id").alias("summary_id"))
    return a.items.select("bulletin_id", "summary_id").unionByName(rest).distinct()


@query("u3_legacy_ids", """
    SELECT summary_id FROM items JOIN bulletins b ON b.id = bulletin_id WHERE NOT bilingual
    EXCEPT SELECT summary_id FROM items JOIN bulletins b ON b.id = bulletin_id WHERE bilingual""")
def u3(a):
    return reading.legacy_ids(a.items, a.bulletins)


@query("f8_ages", """
    SELECT id, CASE WHEN published_at IS NULL THEN '' WHEN h < 1 THEN 'just now' WHEN h < 24 THEN h || 'h'
      ELSE (h // 24) || 'd' END AS age
    FROM (SELECT id, published_at, CAST(floor(epoch(now - published_at) / 3600.0) AS BIGINT) AS h
      FROM articles, clock) q""")
def f8(a):
    return a.articles.select("id", relative_age(a.now.scalar(), F.col("published_at")).alias("age"))
