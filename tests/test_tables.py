"""Sinks, stores, feeds, pages, search and health on small tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dispatchery.operators import curation, exchange, health, ledger, reading, search, sinks
from dispatchery.sources.feeds import parse_feeds
from dispatchery.sources.pages import extract_pages, readable_text
from dispatchery.sources.store import Store

T0 = dt.datetime(2024, 1, 1)


def hours(n):
    return T0 + dt.timedelta(hours=n)


def test_insert_if_absent_takes_the_first_of_a_hot_key(spark):
    batch = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    store = spark.createDataFrame([("1",), ("2",)], "k string")
    got = {r["k"]: r["id"] for r in curation.insert_if_absent(batch, store, ["k"], F.struct("id")).collect()}
    assert got["hot"] == 0 and "1" not in got and len(got) == 1 + sum(1 for i in range(1000) if i % 3) - 2


def test_store_snapshots_and_reruns(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id bigint")
    schema = frame(1).schema
    ids = lambda: sorted(r["id"] for r in store.read("t", schema).collect())
    assert ids() == []
    store.append("t", frame(1, 2), "0")
    store.append("t", frame(3), "1")
    store.append("t", frame(3, 4), "1")
    assert ids() == [1, 2, 3, 4]
    assert sorted(r["id"] for r in store.read_without("t", schema, "1").collect()) == [1, 2]
    store.replace("t", frame(9))
    assert ids() == [9]


def test_prune_clears_marks(spark):
    rows = [(1, hours(0), None), (2, hours(0), None), (3, hours(400), 1), (4, hours(0), 1), (5, hours(400), 2)]
    articles = spark.createDataFrame(rows, "id bigint, fetched_at timestamp, dup_of bigint")
    kept, dead = sinks.prune(articles, spark.createDataFrame([(2,)], "article_id bigint"), F.lit(hours(400)))
    assert {r["id"]: r["dup_of"] for r in kept.collect()} == {2: None, 3: None, 5: 2}
    assert {r["id"] for r in dead.collect()} == {1, 4}


def test_publish_counts_versions_and_skips_empty_days(spark):
    bulletins = spark.createDataFrame([(7, "2024-01-01", "en", 1), (8, "2024-01-01", "en", 2)], "id bigint, day string, language string, version int")
    ranked = spark.createDataFrame([("2024-01-01", "en", 11, 1, "lead", " r ", ""), ("2024-01-02", "en", 12, 1, "lead", "", "")],
                                   "day string, language string, summary_id bigint, position int, tier string, reason string, reason_tr string")
    heads = spark.createDataFrame([(d, "en", "n", "t", 0.5, 1) for d in ("2024-01-01", "2024-01-02", "2024-01-03")],
                                  "day string, language string, editor_note string, editor_note_tr string, agreement double, run_id bigint")
    new, items = sinks.publish(bulletins, ranked, heads, F.lit(T0))
    assert {(r["id"], r["day"], r["version"]) for r in new.collect()} == {(9, "2024-01-01", 3), (10, "2024-01-02", 1)}
    assert {(r["bulletin_id"], r["summary_id"], r["reason"], r["reason_tr"]) for r in items.collect()} == {(9, 11, "r", None), (10, 12, None, None)}


def test_weights(spark):
    sources = spark.createDataFrame([(i, 1.0) for i in range(1, 6)], "id bigint, weight double")
    edits = spark.createDataFrame([(1, 1, "1.24"), (2, 1, "x"), (3, 1, "2.1"), (4, 1, "1.0"), (5, 1, "0.7"), (5, 2, ""), (9, 1, "1.5")], "id bigint, seq int, raw string")
    got = {r["id"]: (r["weight"], r["changed"]) for r in sinks.set_weights(sources, edits).collect()}
    assert got == {1: (1.2, True), 2: (1.0, False), 3: (1.0, False), 4: (1.0, False), 5: (0.7, True)}


def test_repair_replaces_the_whole_row(spark):
    summaries = spark.createDataFrame([(1, 10, "en", "a", "fact"), (2, 11, "en", "b", "keep")], "id bigint, article_id bigint, language string, title_local string, key_fact string")
    drafts = spark.createDataFrame([(10, "en", "new", None)], "article_id bigint, language string, title_local string, key_fact string")
    rows, stand = sinks.rewritten(summaries, drafts, spark.createDataFrame([(1,), (2,)], "summary_id bigint"))
    assert {r["id"]: (r["title_local"], r["key_fact"]) for r in rows.collect()} == {1: ("new", None), 2: ("b", "keep")}
    assert [r["summary_id"] for r in stand.collect()] == [2]


def test_import_refuses_a_filled_archive(spark):
    filled = spark.range(1)
    with pytest.raises(ValueError):
        exchange.refuse_unless_empty(filled)
    exchange.refuse_unless_empty(filled, force=True)


def test_feed_forms(spark):
    rss = """<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>
      <item><title> A &amp; B </title><link>http://www.example.com/a/?utm_source=x</link><pubDate>Tue, 02 Jan 2024 10:00:00 +0300</pubDate>
        <description>short</description><content:encoded>longer body</content:encoded></item>
      <item><title>No link</title></item><item><link>https://example.com/untitled</link></item></channel></rss>"""
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">C</title><link rel="self" href="https://example.com/self"/>
      <link href="https://example.com/c"/><updated>2024-01-03T01:02:03Z</updated><summary>s</summary></entry></feed>"""
    rows = [(1, 1, T0, rss), (2, 2, T0, atom), (3, 3, T0, "not xml <"), (4, 4, T0, "")]
    got = parse_feeds(spark.createDataFrame(rows, "payload_id bigint, source_id bigint, arrived_at timestamp, payload string"))
    out = {r["title"]: (r["url_canonical"], r["published_at"], r["body_text"]) for r in got.collect()}
    assert out == {
        "A & B": ("https://example.com/a", dt.datetime(2024, 1, 2, 7, 0), "longer body"),
        "C": ("https://example.com/c", dt.datetime(2024, 1, 3, 1, 2, 3), "s"),
    }


def test_page_text(spark):
    page = """<html><head><title>T</title><style>x{}</style></head><body><nav>menu</nav><div class="ad big">buy</div>
      <article><h1>Head</h1><p>First <b>bold</b>&amp; more.</p><script>var a="<p>no</p>"</script><div class="comments">me too</div><p>Second.</p></article>
      <footer>foot</footer></body></html>"""
    assert readable_text(page) == "Head\nFirst bold& more.\nSecond."
    rows = [(1, "u", page), (2, "u", "<nav>only menu</nav>"), (3, "u", "plain  words"), (4, "u", None)]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {1: "Head\nFirst bold& more.\nSecond.", 2: "only menu", 3: "plain words", 4: ""}


SUMMARIES = [
    (1, "GPT-5 Ankara'da", "the model modelleri open source", "x", hours(1)),
    (2, "Éclair news", "model model model", "gpt 6 then 5", hours(2)),
    (3, "Other", "gpt 5 mini and models", "y", hours(3)),
]


def test_search_prefixes_phrases_and_accents(spark):
    summaries = spark.createDataFrame(SUMMARIES, "id bigint, title_local string, summary string, why_it_matters string, created_at timestamp")
    index, sizes = search.postings(summaries), search.lengths(summaries)
    none = spark.createDataFrame([], "summary_id bigint, language string, title_local string, summary string, why_it_matters string, canonical_hash string")
    ids = lambda raw: [r["summary_id"] for r in search.search(index, sizes, summaries, none, raw).orderBy("place").collect()]
    assert search.parse('a"b - GPT-5') == [["a"], ["b"], ["gpt", "5"]]
    assert sorted(ids("model")) == [1, 2, 3]
    assert ids("eclair") == [2] and ids("ECLÀ") == [2]
    assert sorted(ids("gpt-5")) == [1, 3]
    assert ids("gpt-5 mini") == [3] and ids("absent") == [] and ids(" - ") == []


def test_translation_hits_follow_index_hits(spark):
    from dispatchery.functions.hashing import content_hash

    summaries = spark.createDataFrame([(*s[:4], "en", s[4]) for s in SUMMARIES],
                                      "id bigint, title_local string, summary string, why_it_matters string, language string, created_at timestamp")
    t = summaries.select(F.col("id").alias("summary_id"), F.lit("tr").alias("language"), F.lit("Éclair 100%_x").alias("title_local"),
                         F.lit("s").alias("summary"), F.lit("w").alias("why_it_matters"),
                         F.when(F.col("id") == 3, "stale").otherwise(content_hash(F.col("title_local"), F.col("summary"), F.col("why_it_matters"))).alias("canonical_hash"))
    index, sizes = search.postings(summaries), search.lengths(summaries)
    rows = search.search(index, sizes, summaries, t, "éclair", "tr", 1)
    assert [(r["summary_id"], r["total"]) for r in rows.collect()] == [(2, 2)]
    # `%` and `_` stand for themselves; both valid translations hold them, the newer comes first.
    assert [r["summary_id"] for r in search.search(index, sizes, summaries, t, "100%_", "tr").orderBy("place").collect()] == [2, 1]
    assert search.search(index, sizes, summaries, t, "100_%", "tr").count() == 0


def polls(spark, log):
    rows = [(i, s, hours(h), ok, False, 1, e) for i, (s, h, ok, e) in enumerate(log)]
    return spark.createDataFrame(rows, "poll_id bigint, source_id bigint, ts timestamp, ok boolean, unchanged boolean, items bigint, etag string")


def test_streaks_and_merging_batches(spark):
    import random

    rng = random.Random(2)
    log = [(rng.choice([1, 1, 1, 2, 3]), h / 3, rng.random() < 0.4, rng.choice([None, "e%d" % h])) for h in range(160)]
    whole = health.source_health(health.poll_states(polls(spark, log)))
    streak, worst = {}, {}
    for s, _, ok, _ in log:
        streak[s] = 0 if ok else streak.get(s, 0) + 1
        worst[s] = max(worst.get(s, 0), streak[s])
    got = {r["source_id"]: r for r in whole.collect()}
    assert {s: (r["streak"], r["worst_streak"]) for s, r in got.items()} == {s: (streak[s], worst[s]) for s in streak}
    every = polls(spark, log)
    state = health.merge_health(
        health.source_health(health.poll_states(every.where("poll_id < 50"))), health.batch_health(every.where("poll_id >= 50 AND poll_id < 53")))
    state = health.merge_health(state, health.batch_health(every.where("poll_id >= 53")))
    columns = ["source_id", "polls", "failures", "items", "worst_streak", "streak", "etag", "enabled"]
    key = lambda df: sorted(map(tuple, df.select(columns).collect()))
    assert key(state) == key(whole)
    again = health.reenable(whole, spark.createDataFrame([(1,)], "source_id bigint"))
    assert next(r for r in again.collect() if r["source_id"] == 1)["enabled"]


def test_advice(spark):
    runs = spark.createDataFrame([(1, "digest", "ok", hours(0)), (2, "digest", "error", hours(5)), (3, "collect", "ok", hours(9))],
                                 "id bigint, kind string, status string, started_at timestamp")
    state = lambda now, **kw: ledger.run_advice(runs, F.lit(now), **kw).first()["state"]
    assert (state(hours(23)), state(hours(25)), state(hours(1), running=True), state(hours(1), blocked=True)) == ("waiting", "due", "running", "blocked")
    assert ledger.run_advice(runs.where("status = 'error'"), F.lit(hours(1))).first()["state"] == "never"


def test_malformed_tags_are_skipped(spark):
    published = spark.createDataFrame([(1, '["a","a","b"]'), (1, "oops")], "bulletin_id bigint, tags_json string")
    rest = spark.createDataFrame([(1, '["b"]')], "bulletin_id bigint, tags_json string")
    got = {(r["tag"], r["published"], r["visible"]) for r in reading.tag_counts(published, rest).collect()}
    assert got == {("a", 1, 1), ("b", 1, 2)}


def test_daily_grants(spark):
    rows = spark.range(100).select("id", F.timestamp_seconds(F.col("id") * 3600).alias("at"))
    got = health.granted(rows, F.col("at"), "id", 3)
    assert [r["id"] for r in got.where("granted").orderBy("id").collect()] == [d * 24 + i for d in range(5) for i in range(3)]
    assert got.count() == 100


def test_prune_is_refused_while_a_run_is_running(spark, tmp_path):
    from dispatchery.operators import sinks

    articles = spark.createDataFrame([(1, hours(0), None), (2, hours(399), 1)], "id bigint, fetched_at timestamp, dup_of bigint")
    none = spark.createDataFrame([], "article_id bigint")
    for status, refused in (("ok", False), ("running", True), (None, False)):
        runs = spark.createDataFrame([(1, "ok"), (2, status)], "id bigint, status string")
        kept, dead = sinks.prune(articles, none, F.lit(hours(400)), runs=runs)
        target = str(tmp_path / f"kept-{status}")
        if refused:
            for df in (kept, dead):
                with pytest.raises(Exception, match="in flight"):
                    df.write.mode("overwrite").parquet(target)
            assert not list((tmp_path / f"kept-{status}").glob("*.parquet"))
        else:
            kept.write.parquet(target)
            assert [r["id"] for r in spark.read.parquet(target).collect()] == [2] and [r["id"] for r in dead.collect()] == [1]


def test_a_term_in_many_texts_fills_several_files(spark, tmp_path):
    n = F.col("id")
    rows = spark.range(4000).select(
        "id", F.when(n % 5 < 2, "hot").otherwise(F.concat(F.lit("w"), n)).alias("title_local"),
        F.lit("").alias("summary"), F.lit("").alias("why_it_matters"))
    path = str(tmp_path / "index")
    # So few rows would be gathered into one task again; a large index isn't.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        search.write_index(rows, path, "a")
        search.write_index(rows, path, "a")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    index, sizes = search.read_index(spark, path)
    hot = index.where("term = 'hot'")
    files = hot.groupBy(F.input_file_name()).count().collect()
    assert hot.count() == 1600 and len(files) > 1 and max(f["count"] for f in files) < 1600
    hits = search.matches(index, search.parse("hot"))
    assert hits.count() == 1600 and sizes.count() == 4000
    # A row group knows its least and greatest term, so most files are left out of a search for one prefix.
    in_order = index.select(F.input_file_name().alias("f"), "term").groupBy("f").agg(F.min("term").alias("lo"), F.max("term").alias("hi"))
    assert in_order.where("lo <= 'w39' AND hi >= 'w39'").count() < in_order.count()


def test_postings_tasks_grow_with_the_prose(spark, monkeypatch):
    """No task holds the postings of more than a fixed amount of prose, whatever the cores; counts stay the same."""
    from dispatchery.operators import search

    rows = spark.createDataFrame([(i, f"word{i % 3}", "word0 again", "again") for i in range(40)], "id bigint, title_local string, summary string, why_it_matters string")
    expected = {("again", 80, 40), ("word0", 54, 40), ("word1", 13, 13), ("word2", 13, 13)}
    monkeypatch.setattr(search, "PROSE", 25)
    assert search.tasks(rows) == 34 and search.dealt(rows).rdd.getNumPartitions() == 34
    assert {tuple(r) for r in search.uses(rows).collect()} == expected


def test_rebuild_reads_its_history_once(spark, archive):
    """Every level of the numbering reads the steps and runs again, so they are written before; no level goes back to the tables."""
    from dispatchery.plans import load

    plan = load().queries["s13_rebuild"](spark, archive.folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation [" not in plan
