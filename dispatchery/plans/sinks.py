"""Queries of the sinks: what each would store."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchery import constants as K
from dispatchery.functions.hashing import content_hash
from dispatchery.functions.urls import canonical_url
from dispatchery.operators import curation, exchange, ledger, publication, quality, ranking, reading, sinks
from dispatchery.plans.columns import LINKS, pages_and_links
from dispatchery.plans.ledger import MODELS_RUN
from dispatchery.plans.reading import DAY_STORIES, VALID, r6
from dispatchery.plans.registry import ORACLES, query
from dispatchery.plans.views_sql import BAND, DAY
from dispatchery.session import cut, ensure_checkpoint_dir
from dispatchery.sources.archive import MODELS
from dispatchery.sources.publications import Publications
from dispatchery.sources.store import read_lines, write_lines


@query("s3_seed_sync", "SELECT url, name, weight FROM sources WHERE id % 2 = 1")
def s3(a):
    stored = a.sources.where("id % 2 = 0")
    feeds = a.sources.select("url", "name", "weight")
    return sinks.sync_sources(stored, feeds.unionByName(feeds)).select("url", "name", "weight")


KEYED = ORACLES["p1_canonical_url"]


@query("s4_insert_if_absent", f"""
    WITH keyed AS ({KEYED})
    SELECT key, min(page_id * 10 + form) AS first_at FROM keyed
    WHERE key NOT IN (SELECT key FROM keyed WHERE page_id % 5 = 0 AND form = 0) GROUP BY key""")
def s4(a):
    links = pages_and_links(a).select(canonical_url(F.col("link")).alias("key"), "page_id", "form")
    store = links.where("page_id % 5 = 0 AND form = 0").select("key")
    return curation.insert_if_absent(links, store, ["key"], F.struct("page_id", "form")).select(
        "key", (F.col("page_id") * 10 + F.col("form")).alias("first_at"))


@query("s5_upsert_verdicts", """
    WITH edits AS (
      SELECT doc_id AS summary_id, 1 AS seq, CASE WHEN doc_id % 2 = 0 THEN 'duplicate' END AS reason,
        CASE doc_id % 3 WHEN 0 THEN ' first ' WHEN 1 THEN NULL ELSE '' END AS note FROM labels WHERE doc_id % 4 <> 3
      UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 6 = 0 THEN 'not_news' END, CASE WHEN doc_id % 9 = 0 THEN '  ' END FROM labels
        WHERE doc_id % 4 <> 3),
    folded AS (SELECT summary_id, arg_max(reason, seq) FILTER (reason IS NOT NULL) AS reason,
        arg_max(note, seq) FILTER (note IS NOT NULL) AS note, bool_or(note IS NOT NULL) AS has_note FROM edits GROUP BY summary_id)
    SELECT coalesce(v.summary_id, f.summary_id) AS summary_id, 'wrong' AS verdict, coalesce(f.reason, v.reason) AS reason,
      CASE WHEN f.has_note THEN nullif(trim(f.note), '') ELSE v.note END AS note
    FROM verdicts v FULL OUTER JOIN folded f ON f.summary_id = v.summary_id""")
def s5(a):
    i = F.col("doc_id")
    rows = a.table("labels").where("doc_id % 4 <> 3")
    none = F.lit(None).cast("string")
    first = rows.select(i.alias("summary_id"), F.lit(1).alias("seq"), F.when(i % 2 == 0, "duplicate").alias("reason"),
                        F.when(i % 3 == 0, " first ").when(i % 3 == 1, none).otherwise("").alias("note"))
    second = rows.select(i.alias("summary_id"), F.lit(2).alias("seq"), F.when(i % 6 == 0, "not_news").alias("reason"),
                         F.when(i % 9 == 0, "  ").alias("note"))
    edits = first.unionByName(second).withColumn("created_at", F.current_timestamp())
    return sinks.upsert_verdicts(a.verdicts, edits).select("summary_id", "verdict", "reason", "note")


@query("s5_translation_cache", """
    SELECT summary_id, CASE WHEN summary_id % 10 = 0 OR summary_id % 2 = 1 THEN 'NEW ' || s.title_local ELSE t.title_local END AS title_local
    FROM (SELECT id AS summary_id FROM summaries) x JOIN summaries s ON s.id = x.summary_id
    LEFT JOIN translations t USING (summary_id)""")
def s5_cache(a):
    fresh = a.summaries.select(
        F.col("id").alias("summary_id"), F.lit("tr").alias("language"), F.concat(F.lit("NEW "), "title_local").alias("title_local"),
        "summary", "why_it_matters", content_hash(F.col("title_local"), F.col("summary"), F.col("why_it_matters")).alias("canonical_hash"))
    hashes = fresh.select("summary_id", F.col("canonical_hash").alias("content_hash"))
    return sinks.refresh_translations(a.translations, fresh, hashes).select("summary_id", "title_local")


def ranked(a):
    """Today's ranking of every day: the newest stored order, re-published."""
    newest = reading.current_bulletins(a.bulletins).select("bulletin_id")
    held = a.items.join(newest, "bulletin_id", "left_semi").join(
        a.bulletins.select(F.col("id").alias("bulletin_id"), "day", "language"), "bulletin_id")
    return held.drop("bulletin_id")


def heads(a):
    return a.bulletins.where("version = 2").select(
        "day", "language", "editor_note", "editor_note_tr", "agreement", "run_id")


@query("s6_publish", """
    SELECT b.day, 3 AS version, (SELECT max(id) FROM bulletins) + dense_rank() OVER (ORDER BY b.day) AS bulletin_id,
      i.summary_id, i.position, i.tier, i.reason
    FROM items i JOIN bulletins b ON b.id = i.bulletin_id WHERE b.version = 2""")
def s6(a):
    new, items = sinks.publish(a.bulletins, ranked(a), heads(a), F.current_timestamp())
    return items.join(new.select(F.col("id").alias("bulletin_id"), "day", "version"), "bulletin_id").select(
        "day", "version", "bulletin_id", "summary_id", "position", "tier", "reason")


@query("p17_publication_gaps", f"""
    SELECT b.day, i.summary_id, CASE WHEN trim(s.why_it_matters) = '' THEN 'blank prose' WHEN v.id IS NULL THEN 'no valid translation'
      WHEN trim(coalesce(i.reason, '')) <> '' AND trim(coalesce(i.reason_tr, '')) = '' THEN 'reason not translated' END AS gap
    FROM items i JOIN bulletins b ON b.id = i.bulletin_id JOIN summaries s ON s.id = i.summary_id
    LEFT JOIN ({VALID}) v ON v.id = s.id WHERE b.version = 2 AND gap IS NOT NULL""")
def p17(a):
    valid = reading.valid_translations(a.summaries, a.translations)
    return sinks.publication_gaps(ranked(a), heads(a), a.summaries, valid).select("day", "summary_id", "gap")


@query("u5_coverage_gaps", """
    SELECT summary_id, CASE WHEN n_req > n_ret THEN 'missing' ELSE 'extra' END AS side FROM (
      SELECT summary_id, count(*) FILTER (k = 1) AS n_req, count(*) FILTER (k = 2) AS n_ret FROM (
        SELECT id AS summary_id, 1 AS k FROM summaries UNION ALL SELECT id, 2 FROM summaries WHERE id % 7 <> 0
        UNION ALL SELECT id, 2 FROM summaries WHERE id % 11 = 0) q GROUP BY summary_id) z WHERE n_req <> n_ret""")
def u5(a):
    ids = a.summaries.select(F.col("id").alias("summary_id"))
    returned = ids.where("summary_id % 7 <> 0").unionByName(ids.where("summary_id % 11 = 0"))
    return sinks.coverage_gaps(ids, returned, ["summary_id"])


DEAD = """
    SELECT id FROM articles, clock WHERE fetched_at < now - INTERVAL 7 DAY AND id NOT IN (SELECT article_id FROM summaries)"""


@query("s7_prune", f"""
    SELECT id, title, CASE WHEN dup_of NOT IN ({DEAD}) THEN dup_of END AS dup_of
    FROM marked_articles WHERE id NOT IN ({DEAD})""")
def s7(a):
    kept, _ = sinks.prune(a.marked_articles, a.summaries, a.now.scalar(), runs=a.runs)
    return kept.select("id", "title", "dup_of")


@query("s7_prune_dry_run", f"SELECT count(*) AS dead FROM ({DEAD}) q")
def s7_dry(a):
    _, dead = sinks.prune(a.marked_articles, a.summaries, a.now.scalar(), runs=a.runs)
    return dead.agg(F.count(F.lit(1)).alias("dead"))


RAW = "CASE id % 4 WHEN 0 THEN ' 1.24 ' WHEN 1 THEN 'heavy' WHEN 2 THEN '2.6' ELSE CAST(weight AS VARCHAR) END"


@query("s8_weight_edits", """
    SELECT id, CASE WHEN id % 4 = 0 THEN CAST(1.2 AS DOUBLE) ELSE weight END AS weight, id % 4 = 0 AND weight <> 1.2 AS changed FROM sources""")
def s8(a):
    i = F.col("id")
    raw = F.when(i % 4 == 0, " 1.24 ").when(i % 4 == 1, "heavy").when(i % 4 == 2, "2.6").otherwise(F.col("weight").cast("string"))
    edits = a.sources.select("id", F.lit(1).alias("seq"), raw.alias("raw"))
    return sinks.set_weights(a.sources, edits).select("id", "weight", "changed")


@query("s9_frozen_corpus", """
    SELECT a.id AS article_id, s.name AS source, md5(a.body_text) AS body, length(a.title) AS title_chars
    FROM (SELECT *, ((id % 1000003) * ((2654435761 + 2 * 104729) % 1000003)) % 1000003 AS h FROM marked_articles
      WHERE length(body_text) > 400 AND body_source IN ('feed', 'fetch') AND dup_of IS NULL ORDER BY h, id LIMIT 40) a
    JOIN sources s ON s.id = a.source_id""")
def s9(a):
    """Through JSON lines and back."""
    lines = exchange.freeze_corpus(a.marked_articles.withColumn("extra_text", F.lit(None).cast("string")), a.sources, 40, 2)
    path = f"{ensure_checkpoint_dir(a.spark)}/corpus-{uuid.uuid4().hex}"
    write_lines(lines, path)
    return read_lines(a.spark, path, exchange.CORPUS_SCHEMA).select(
        "article_id", "source", F.md5("body").alias("body"), F.length("title").alias("title_chars"))


@query("s10_record_bulletin", f"""
    SELECT bulletin_id, 'story' AS part, row_number() OVER (PARTITION BY bulletin_id ORDER BY position ASC NULLS LAST, importance DESC, id) AS place,
      id AS article_id FROM ({DAY_STORIES}) q
    UNION ALL SELECT q.bulletin_id, 'duplicate', m.id, m.id FROM ({DAY_STORIES}) q JOIN marked_articles m ON m.dup_of = q.id
    UNION ALL SELECT id, 'header', 0, NULL FROM bulletins""")
def s10(a):
    return record(a).select("bulletin_id", "part", "place", F.get_json_object("body", "$.article_id").cast("bigint").alias("article_id"))


def record(a):
    """Every bulletin as recorded lines: with the models of its run, and facts and source of each story."""
    runs = a.runs.select("id", F.when(F.col("id") % 3 == 0, MODELS[3]).alias("model_summarize"), F.lit(None).cast("string").alias("model_rank"))
    models = ledger.models_used(runs, a.run_steps).withColumnRenamed("id", "run_id")
    known = F.col("model_rank").isNotNull()
    headed = a.bulletins.join(models, "run_id", "left").withColumns({
        "run_id": F.when(known, F.col("run_id")),
        **{c: F.coalesce(c, F.lit(K.DEFAULT_MODEL)) for c in ("model_summarize", "model_rank")}})
    named = a.sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"), "weight")
    stories = quality.with_facts(reading.day_stories(a.bulletins, a.items, a.summaries), a.facts).join(named, "source_id")
    kept = a.articles.select(F.col("id").alias("dup_of"), F.col("title").alias("dup_of_title"))
    pairs = a.marked_articles.where("dup_of IS NOT NULL").select(F.col("id").alias("article_id"), "dup_of", "title").join(kept, "dup_of")
    return exchange.record_bulletins(headed, stories, pairs)


@query("s10_record_headers", f"""
    SELECT b.id AS bulletin_id, b.day, b.version, b.language, round(b.agreement, 6) AS agreement, m.id AS run_id, b.editor_note,
      CAST(epoch(b.created_at) AS BIGINT) AS published_at, coalesce(m.model_summarize, 'gpt-6-luna') AS model_summarize,
      coalesce(m.model_rank, 'gpt-6-luna') AS model_rank, 15 AS top_n
    FROM bulletins b LEFT JOIN ({MODELS_RUN}) m ON m.id = b.run_id""")
def s10_headers(a):
    read = "day string, version int, language string, agreement double, run_id bigint, editor_note string, published_at bigint, " \
           "model_summarize string, model_rank string, top_n int"
    return record(a).where("part = 'header'").select("bulletin_id", F.from_json("body", read).alias("h")).select(
        "bulletin_id", "h.*").withColumn("agreement", r6("agreement"))


@query("s10_record_fields", f"""
    SELECT q.bulletin_id, s.article_id, o.name AS source, o.weight, a.title, s.title_local, md5(s.summary) AS summary,
      md5(s.why_it_matters) AS why_it_matters, s.tags_json AS tags, s.importance, s.key_fact, s.relevant, s.kind, q.position, i.tier, i.reason,
      a.body_source
    FROM ({DAY_STORIES}) q JOIN summaries s ON s.id = q.id JOIN articles a ON a.id = s.article_id JOIN sources o ON o.id = s.source_id
    LEFT JOIN items i ON i.bulletin_id = q.bulletin_id AND i.summary_id = q.id""")
def s10_fields(a):
    read = "article_id bigint, source string, weight double, title string, title_local string, summary string, why_it_matters string, " \
           "tags array<string>, importance int, key_fact string, relevant boolean, kind string, position int, tier string, reason string, " \
           "body_source string"
    return record(a).where("part = 'story'").select("bulletin_id", F.from_json("body", read).alias("s")).select("bulletin_id", "s.*").withColumns(
        {"summary": F.md5("summary"), "why_it_matters": F.md5("why_it_matters"), "tags": F.to_json("tags")})


def slice_tables(a):
    keyed = a.eval_results.join(reading.home_bulletins(a.items, a.bulletins), "summary_id", "left")
    return {
        "bulletins": a.bulletins, "items": a.items, "summaries": a.summaries, "translations": a.translations,
        "articles": a.marked_articles, "sources": a.sources, "runs": a.runs, "run_steps": a.run_steps,
        "verdicts": a.verdicts, "eval_results": keyed}


CHOSEN = "(SELECT * FROM bulletins ORDER BY day DESC, version DESC LIMIT 3)"
SLICE = f"""
    SELECT s.* FROM summaries s WHERE s.day IN (SELECT day FROM {CHOSEN} c)
      OR s.id IN (SELECT summary_id FROM items WHERE bulletin_id IN (SELECT id FROM {CHOSEN} c))"""
ANCHOR = f"(SELECT max(created_at) FROM {CHOSEN} c)"


@query("s11_export_slice", f"""
    SELECT 'bulletins' AS part, id, round(epoch(created_at - {ANCHOR}), 6) AS at FROM {CHOSEN} c
    UNION ALL SELECT 'summaries', id, round(epoch(created_at - {ANCHOR}), 6) FROM ({SLICE}) s
    UNION ALL SELECT 'articles', id, round(epoch(published_at - {ANCHOR}), 6) FROM articles WHERE id IN (SELECT article_id FROM ({SLICE}) s)
    UNION ALL SELECT 'sources', id, NULL FROM sources WHERE id IN (SELECT source_id FROM ({SLICE}) s)
    UNION ALL SELECT 'items', summary_id * 10000 + bulletin_id, NULL FROM items WHERE bulletin_id IN (SELECT id FROM {CHOSEN} c)
    UNION ALL SELECT 'translations', summary_id, NULL FROM translations WHERE summary_id IN (SELECT id FROM ({SLICE}) s)
    UNION ALL SELECT 'runs', id, round(epoch(started_at - {ANCHOR}), 6) FROM runs WHERE id IN (SELECT run_id FROM {CHOSEN} c)
    UNION ALL SELECT 'run_steps', run_id * 10 + stage, round(epoch(started_at - {ANCHOR}), 6) FROM run_steps WHERE run_id IN (SELECT run_id FROM {CHOSEN} c)
    UNION ALL SELECT 'verdicts', summary_id, round(epoch(created_at - {ANCHOR}), 6) FROM verdicts WHERE summary_id IN (SELECT id FROM ({SLICE}) s)
    UNION ALL SELECT 'eval_results', e.id, round(epoch(e.created_at - {ANCHOR}), 6) FROM eval_results e JOIN (
      SELECT summary_id, arg_max(bulletin_id, b.day || '/' || b.version) AS home FROM items i JOIN bulletins b ON b.id = i.bulletin_id
      GROUP BY summary_id) h ON h.summary_id = e.summary_id WHERE home IN (SELECT id FROM {CHOSEN} c)""")
def s11(a):
    got = exchange.export_slice(slice_tables(a))
    none = F.lit(None).cast("double")
    keys = {
        "bulletins": (F.col("id"), F.col("created_at")), "summaries": (F.col("id"), F.col("created_at")),
        "articles": (F.col("id"), F.col("published_at")), "sources": (F.col("id"), none),
        "items": (F.col("summary_id") * 10000 + F.col("bulletin_id"), none), "translations": (F.col("summary_id"), none),
        "runs": (F.col("id"), F.col("started_at")), "run_steps": (F.col("run_id") * 10 + F.col("stage"), F.col("started_at")),
        "verdicts": (F.col("summary_id"), F.col("created_at")), "eval_results": (F.col("id"), F.col("created_at"))}
    parts = [got[p].select(F.lit(p).alias("part"), k.alias("id"), F.round(t, 6).alias("at")) for p, (k, t) in keys.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query("s12_import_slice", f"""
    WITH s AS ({SLICE}), arts AS (SELECT * FROM marked_articles WHERE id IN (SELECT article_id FROM s)),
      amap AS (SELECT id AS old, (SELECT max(id) FROM articles) + row_number() OVER (ORDER BY id) AS new FROM arts)
    SELECT n.new AS id, a.source_id, d.new AS dup_of, CAST(epoch(TIMESTAMP '2025-06-01 09:00:00' + (a.fetched_at - {ANCHOR})) AS BIGINT) AS fetched
    FROM arts a JOIN amap n ON n.old = a.id LEFT JOIN amap d ON d.old = a.dup_of""")
def s12(a):
    """A slice taken into the archive it came from: sources match, everything else gets new ids."""
    data = exchange.export_slice(slice_tables(a))
    anchor = F.to_timestamp(F.lit("2025-06-01 09:00:00"))
    got = exchange.import_slice(data, {"sources": a.sources, "articles": a.articles, "summaries": a.summaries,
                                       "runs": a.runs, "bulletins": a.bulletins}, anchor)
    return got["articles"].select("id", "source_id", "dup_of", F.unix_seconds("fetched_at").alias("fetched"))


@query("s12_import_items", f"""
    WITH s AS ({SLICE}), smap AS (SELECT id AS old, (SELECT max(id) FROM summaries) + row_number() OVER (ORDER BY id) AS new FROM s),
      bmap AS (SELECT id AS old, (SELECT max(id) FROM bulletins) + row_number() OVER (ORDER BY id) AS new, day FROM {CHOSEN} c)
    SELECT b.new AS bulletin_id, m.new AS summary_id, i.position,
      strftime(DATE '2025-06-01' + CAST(date_diff('day', (SELECT max(CAST(day AS DATE)) FROM bmap), CAST(b.day AS DATE)) AS INT), '%Y-%m-%d') AS day
    FROM items i JOIN bmap b ON b.old = i.bulletin_id JOIN smap m ON m.old = i.summary_id""")
def s12_items(a):
    data = exchange.export_slice(slice_tables(a))
    anchor = F.to_timestamp(F.lit("2025-06-01 09:00:00"))
    got = exchange.import_slice(data, {"sources": a.sources, "articles": a.articles, "summaries": a.summaries,
                                       "runs": a.runs, "bulletins": a.bulletins}, anchor)
    return got["items"].join(got["bulletins"].select(F.col("id").alias("bulletin_id"), "day"), "bulletin_id").select(
        "bulletin_id", "summary_id", "position", "day")


MOVED = f"CAST(epoch(TIMESTAMP '2025-06-01 09:00:00' + ({{}} - {ANCHOR})) AS BIGINT)"


@query("s12_import_rows", f"""
    WITH s AS ({SLICE}),
      amap AS (SELECT id AS old, (SELECT max(id) FROM articles) + row_number() OVER (ORDER BY id) AS new FROM marked_articles
        WHERE id IN (SELECT article_id FROM s)),
      smap AS (SELECT id AS old, (SELECT max(id) FROM summaries) + row_number() OVER (ORDER BY id) AS new FROM s),
      bmap AS (SELECT id AS old, (SELECT max(id) FROM bulletins) + row_number() OVER (ORDER BY id) AS new FROM {CHOSEN} c),
      rmap AS (SELECT id AS old, (SELECT max(id) FROM runs) + row_number() OVER (ORDER BY id) AS new FROM runs
        WHERE id IN (SELECT run_id FROM {CHOSEN} c)),
      homes AS (SELECT summary_id, arg_max(bulletin_id, b.day || '/' || b.version) AS home FROM items i JOIN bulletins b ON b.id = i.bulletin_id
        GROUP BY summary_id)
    SELECT 'summaries' AS part, m.new AS id, n.new AS ref, {MOVED.format("s.created_at")} AS at, md5(s.summary) AS held
      FROM s JOIN smap m ON m.old = s.id JOIN amap n ON n.old = s.article_id
    UNION ALL SELECT 'translations', m.new, NULL, NULL, md5(t.summary) FROM translations t JOIN smap m ON m.old = t.summary_id
    UNION ALL SELECT 'bulletins', m.new, r.new, {MOVED.format("b.created_at")}, b.language
      FROM {CHOSEN} b JOIN bmap m ON m.old = b.id LEFT JOIN rmap r ON r.old = b.run_id
    UNION ALL SELECT 'runs', m.new, NULL, {MOVED.format("r.started_at")}, r.kind FROM runs r JOIN rmap m ON m.old = r.id
    UNION ALL SELECT 'run_steps', m.new, t.stage, {MOVED.format("t.started_at")}, t.node FROM run_steps t JOIN rmap m ON m.old = t.run_id
    UNION ALL SELECT 'verdicts', m.new, NULL, {MOVED.format("v.created_at")}, v.reason FROM verdicts v JOIN smap m ON m.old = v.summary_id
    UNION ALL SELECT 'eval_results', m.new, b.new, {MOVED.format("e.created_at")}, e.kind
      FROM eval_results e JOIN homes h ON h.summary_id = e.summary_id JOIN bmap b ON b.old = h.home LEFT JOIN smap m ON m.old = e.summary_id""")
def s12_rows(a):
    """Every other table of a slice with its new ids, what they point at, its moved time and one field of its content."""
    data = exchange.export_slice(slice_tables(a))
    got = exchange.import_slice(data, {"sources": a.sources, "articles": a.articles, "summaries": a.summaries, "runs": a.runs,
                                       "bulletins": a.bulletins}, F.to_timestamp(F.lit("2025-06-01 09:00:00")))
    none = F.lit(None)
    shown = {"summaries": ("id", "article_id", "created_at", F.md5("summary")), "translations": ("summary_id", none, none, F.md5("summary")),
             "bulletins": ("id", "run_id", "created_at", F.col("language")), "runs": ("id", none, "started_at", F.col("kind")),
             "run_steps": ("run_id", "stage", "started_at", F.col("node")), "verdicts": ("summary_id", none, "created_at", F.col("reason")),
             "eval_results": ("summary_id", "bulletin_id", "created_at", F.col("kind"))}

    def column(c):
        return F.col(c) if isinstance(c, str) else c

    parts = [got[part].select(F.lit(part).alias("part"), column(i).cast("bigint").alias("id"), column(ref).cast("bigint").alias("ref"),
                              F.unix_seconds(column(at).cast("timestamp")).alias("at"), held.alias("held"))
             for part, (i, ref, at, held) in shown.items()]
    return reduce(DataFrame.unionByName, parts)


HISTORY = "SELECT run_id, stage AS summary_id, CASE WHEN n_out % 4 <> 0 THEN n_out END AS rank FROM run_steps"


@query("s13_rebuild", f"""
    WITH r AS (SELECT id AS run_id, started_at, {DAY.format("started_at")} AS day,
        row_number() OVER (ORDER BY started_at, id) AS id,
        row_number() OVER (PARTITION BY {DAY.format("started_at")} ORDER BY started_at, id) AS version
      FROM runs WHERE id IN (SELECT run_id FROM run_steps))
    SELECT r.id AS bulletin_id, r.day, r.version, h.summary_id, position, {BAND.format("position")} AS tier
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rank, summary_id) AS position FROM ({HISTORY}) x WHERE rank IS NOT NULL) h
    JOIN r USING (run_id)""")
def s13(a):
    # The steps are read by every level of the numbering, so they are told from their repeats once.
    history = cut(a.run_steps.select("run_id", F.col("stage").alias("summary_id"),
                                     F.when(F.col("n_out") % 4 != 0, F.col("n_out")).alias("rank")))
    runs = a.runs.join(history.select(F.col("run_id").alias("id")), "id", "left_semi").select(
        F.col("id").alias("run_id"), F.lit("en").alias("language"), "started_at")
    bulletins, items = sinks.rebuild_bulletins(runs, history)
    return items.join(bulletins.select(F.col("id").alias("bulletin_id"), "day", "version"), "bulletin_id").select(
        "bulletin_id", "day", "version", "summary_id", "position", "tier")


@query("s13_duplicate_summaries", """
    SELECT article_id, language, count(*) AS n FROM (SELECT article_id, language FROM summaries
      UNION ALL SELECT article_id, language FROM summaries WHERE id % 50 = 0) q GROUP BY 1, 2 HAVING count(*) > 1""")
def s13_duplicates(a):
    both = a.summaries.select("id", "article_id", "language")
    return sinks.duplicate_summaries(both.unionByName(both.where("id % 50 = 0")))


@query("s13_rekey_results", """
    SELECT e.id, b.id AS bulletin_id FROM eval_results e LEFT JOIN (SELECT run_id, arg_max(id, version) AS id FROM bulletins GROUP BY run_id) b
      ON b.run_id = e.summary_id % 80""")
def s13_rekey(a):
    keyed = a.eval_results.withColumn("run_id", F.col("summary_id") % 80)
    return sinks.rekey_results(keyed, a.bulletins).select("id", "bulletin_id")


@query("s14_backfills", """
    SELECT id, 'unknown' AS body_source FROM articles WHERE id % 3 = 2 AND body_text <> ''
    UNION ALL SELECT id, body_source FROM articles WHERE id % 3 <> 2""")
def s14(a):
    bare = a.articles.withColumn("body_source", F.when(F.col("id") % 3 != 2, F.col("body_source")))
    return sinks.backfill_provenance(bare).select("id", "body_source")


@query("s14_retired_kind", "SELECT id, CASE WHEN kind = 'digest' OR id % 9 = 0 THEN 'digest' ELSE kind END AS kind FROM runs")
def s14_kind(a):
    old = a.runs.withColumn("kind", F.when(F.col("id") % 9 == 0, "manual").otherwise(F.col("kind")))
    return sinks.backfill_kind(old).select("id", "kind")


@query("k6_rewritten_translations", """
    SELECT summary_id FROM translations WHERE summary_id NOT IN (
      SELECT id FROM summaries WHERE language = 'en' AND article_id IN (SELECT id FROM articles WHERE body_source = 'unknown'))""")
def k6_rewritten(a):
    todo = curation.unattributed(a.articles, a.summaries).select(F.col("id").alias("article_id"))
    drafts = a.summaries.join(todo, "article_id", "left_semi").select(
        "article_id", "language", F.concat(F.lit("again "), "title_local").alias("title_local"), "key_fact")
    _, stand = sinks.rewritten(a.summaries, drafts, a.translations)
    return stand.select("summary_id")


def rehearsal(a):
    """Runs over the archive: one a day, with retried answers, failed branches, calls and errors.

    Every fourth summary was answered twice, of which the later answer counts; those with id % 13 = 0 failed once
    before; a day's readings and translations were calls. A story with id % 97 = 0 has no translation, so the run
    that picked it is refused.
    """
    def run_of(day):
        return (F.lit(1_000_000) + F.datediff(F.to_date(day), F.lit("2024-01-01").cast("date"))).cast("bigint").alias("run_id")

    notes = a.readings.select("day", "pass").distinct().withColumn("note", F.concat(F.lit("note "), F.col("day")))
    pools = a.summaries.where("relevant").groupBy("day").agg(F.count(F.lit(1)).alias("pool"))
    # Each stage is written before the next one reads it: a lost job restarts from the last table.
    items, days = (cut(t) for t in ranking.aggregate(a.readings, notes, pools, ["day"]))
    i, day = F.col("id"), F.col("day")
    answers = a.summaries.withColumn("seq", F.explode(F.when(i % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    failed = a.summaries.where(i % 13 == 0)
    readings = a.readings.groupBy("day", "pass").agg((F.count(F.lit(1)) * 100).alias("tokens_in")).select(
        run_of(day), F.lit("rank").alias("node"), F.lit(MODELS[1]).alias("model"), "tokens_in", F.col("pass").cast("bigint").alias("tokens_out"))
    translated = items.select(
        run_of(day), F.lit("translate").alias("node"), F.lit(MODELS[2]).alias("model"), F.lit(300).cast("bigint").alias("tokens_in"),
        F.lit(200).cast("bigint").alias("tokens_out"))
    return {
        "runs": a.summaries.groupBy("day").agg(F.count(F.lit(1)).alias("n_new")).select(
            run_of(day), (F.col("n_new") + 5).alias("n_collected"), "n_new"),
        "ranked": items.select(run_of(day), "summary_id", "position", "tier", "reason",
                               F.concat(F.lit("TR "), F.col("reason")).alias("reason_tr")),
        "heads": days.select(run_of(day), "day", F.lit("en").alias("language"), "editor_note",
                             F.concat(F.lit("TR "), F.col("editor_note")).alias("editor_note_tr"), "agreement",
                             F.lit(MODELS[1]).alias("model_rank")),
        "summaries": a.summaries,
        "valid": a.summaries.where(i % 97 != 0).select(
            "id", *[F.concat(F.lit("TR "), F.col(c)).alias(f"{c}_tr") for c in ("title_local", "summary", "why_it_matters")]),
        "facts": a.facts,
        "payloads": answers.select(run_of(day), i.alias("summary_id"), "seq", "model", (F.col("tokens_in") + F.col("seq")).alias("tokens_in"),
                                   "tokens_out"),
        "failures": failed.select(run_of(day), "model", "tokens_in", F.lit(0).cast("bigint").alias("tokens_out")),
        "calls": readings.unionByName(translated),
        "errors": failed.select(run_of(day), i.alias("seq"), F.concat(F.lit("no answer for "), i.cast("string")).alias("error")),
    }


RUN_SCHEMA = "run_id bigint"


@query("k4_publish_flow")
def k4(a):
    """Rank every day, refuse the runs with gaps, store the rest with their checks and bills, and read them back.

    What is stored is committed at once, and a second run over the same ids adds nothing.
    """
    now, given = a.now.scalar(), rehearsal(a)
    held = {"bulletins": a.bulletins, "runs": a.spark.createDataFrame([], RUN_SCHEMA)}
    shelf = Publications(a.spark, f"{ensure_checkpoint_dir(a.spark)}/press-{uuid.uuid4().hex}")
    tables, gaps = publication.prepare(held, **given, now=now)
    shelf.commit("press", tables, optional=("checks", "figures"))
    stored = {name: shelf.read(name, tables[name].schema) for name in publication.PARTS}
    held = {"bulletins": a.bulletins.select("id", "day", "language", "version").unionByName(
        stored["bulletins"].select("id", "day", "language", "version")), "runs": stored["runs"]}
    again, _ = publication.prepare(held, **given, now=now)
    shelf.commit("again", again, optional=("checks", "figures"))
    stored = {name: shelf.read(name, tables[name].schema) for name in publication.PARTS}
    n_items = stored["items"].groupBy("bulletin_id").agg(F.count(F.lit(1)).alias("n_items"))
    invented = stored["figures"].groupBy("bulletin_id").agg(F.sum(F.size("numerals")).alias("n_invented"))
    published = (
        stored["bulletins"].withColumnRenamed("id", "bulletin_id").withColumnRenamed("est_cost_usd", "rank_cost")
        .join(n_items, "bulletin_id").join(stored["checks"], "bulletin_id", "left").join(invented, "bulletin_id", "left")
        .select("run_id", "bulletin_id", "day", "version", "agreement", "rank_cost", "n_items", "checks", "n_invented")
    )
    refused = gaps.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_gaps"))
    return given["runs"].select("run_id").join(stored["runs"], "run_id", "left").join(published, "run_id", "left").join(
        refused, "run_id", "left").select(
        "run_id", "bulletin_id", "day", "version", r6("agreement").alias("agreement"), "n_items",
        F.col("checks.n").alias("n"), F.col("checks.n_published").alias("n_published"), F.col("checks.ungrounded").alias("ungrounded"),
        F.coalesce("n_invented", F.lit(0)).alias("n_invented"), F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"),
        "n_collected", "n_new", "n_summarized", "tokens_in", "tokens_out", r6("est_cost_usd").alias("est_cost_usd"),
        r6("rank_cost").alias("rank_cost"), "status", F.length("error").alias("error_chars"))
