"""Checks of published stories on small sets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dispatchery import constants as K
from dispatchery.operators import quality, sampling

SCHEMA = (
    "bulletin_id bigint, article_id bigint, title_local string, summary string, why_it_matters string, tags array<string>,"
    " importance int, key_fact string, position int, body_numerals array<string>"
)


@pytest.fixture(scope="module")
def stories(spark):
    rows = [
        (1, 1, "Luna ships", "It costs 500 now. " + "w " * 60, "why", ["ai", "models"], 5, "Luna 5.6", 1, ["100", "2010"]),
        (1, 2, "t " * 11, "In 2010 it began", "y " * 21, ["ai", "odd"], 3, "Absent thing", 2, ["2010"]),
        (1, 3, "Plain", "no figures", "none", [], 1, " ", None, []),
        (2, 4, "Round", "13 milyar dolar", "", ["x"], 2, None, None, ["12900000000", "12.9"]),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def one(df, bulletin=1):
    return next(r for r in df.collect() if r["bulletin_id"] == bulletin)


def test_word_budget(stories):
    row = one(quality.word_budget(stories, ["bulletin_id"]))
    assert (row["n"], row["summary_over"], row["why_it_matters_over"], row["title_local_over"]) == (3, 1, 1, 1)
    assert row["summary_share"] == pytest.approx(1 / 3)


def test_content_floor(stories):
    row = one(quality.content_floor(stories, ["bulletin_id"]))
    assert row["key_fact_share"] == pytest.approx(2 / 3)
    assert row["key_fact_kept"] == pytest.approx(1 / 2)
    assert (row["n_with_numerals"], row["numeral_recall"]) == (2, 0.5)
    other = one(quality.content_floor(stories, ["bulletin_id"]), 2)
    assert other["key_fact_share"] == 0.0 and other["key_fact_kept"] is None and other["numeral_recall"] == 0.0


def test_ungrounded(stories):
    got = {r["article_id"]: r["numerals"] for r in quality.ungrounded_numerals(stories, ["bulletin_id"]).collect()}
    assert got == {1: ["500"], 4: ["13000000000"]}


def test_figures_far_into_a_body(spark):
    filler = "plain words " * 800
    articles = spark.createDataFrame([(1, "t", "feed", filler + "for 4100 crowns")], "id bigint, title string, body_source string, body_text string")
    story = spark.createDataFrame([(1, 1, "It cost 4100 crowns", "", "[]")], "bulletin_id bigint, article_id bigint, summary string, why_it_matters string, tags_json string")
    assert quality.story_rows(story, articles).first()["body_numerals"] == ["4100"]
    assert quality.ungrounded_numerals(quality.story_rows(story, articles), ["bulletin_id"]).collect() == []
    assert quality.story_rows(story, articles, 5000).first()["body_numerals"] == []


def test_tags_and_importance(stories):
    row = one(quality.tag_vocabulary(stories, ["bulletin_id"]))
    assert (row["distinct"], row["singleton_share"], row["in_vocabulary_share"]) == (3, pytest.approx(2 / 3), pytest.approx(1 / 4))
    top = [(r["tag"], r["uses"]) for r in quality.top_tags(stories, ["bulletin_id"], 2).where("bulletin_id = 1").orderBy("place").collect()]
    assert top == [("ai", 2), ("models", 1)]
    shares = one(quality.importance_distribution(stories, ["bulletin_id"]))
    assert [shares[f"share_{k}"] for k in range(1, 6)] == [pytest.approx(x) for x in (1 / 3, 0, 1 / 3, 0, 1 / 3)]


def test_published_checks_hold_the_single_checks(stories):
    checks = one(quality.published_checks(stories, ["bulletin_id"]))["checks"]
    assert (checks["n"], checks["n_published"], checks["ungrounded"]) == (3, 2, 1)
    assert checks["budget"]["summary_over"] == 1 and checks["tags"]["distinct"] == 3
    assert checks["content"]["key_fact_kept"] == 0.5


def test_frozen_checks_win(spark, stories):
    computed = quality.published_checks(stories, ["bulletin_id"])
    frozen = computed.where("bulletin_id = 1").withColumn("checks", F.col("checks").withField("n", F.lit(99).cast("bigint")))
    blank = computed.where("bulletin_id = 2").withColumn("checks", F.when(F.lit(False), F.col("checks")))
    asked = spark.createDataFrame([(1,), (2,), (3,)], "bulletin_id bigint")
    marks = quality.story_marks(stories, ["bulletin_id", "position"])
    got = quality.stored_or_computed(asked, frozen.unionByName(blank), marks).collect()
    assert {r["bulletin_id"]: (r["checks"]["n"], r["at_publish"]) for r in got} == {1: (99, True), 2: (1, False)}


def test_figures_of_marked_stories(stories):
    marks = quality.story_marks(stories, ["bulletin_id"])
    got = {(r["bulletin_id"], r["article_id"]): r["numerals"] for r in quality.figures(marks, ["bulletin_id"]).collect()}
    assert got == {(1, 1): ["500"], (2, 4): ["13000000000"]}


def test_sides_beside_each_other(spark, stories):
    sides = stories.withColumn("side", F.when(F.col("bulletin_id") == 1, "a").otherwise("b"))
    spend = spark.createDataFrame([("a", 0, 10, 20, 0.5), ("b", 3, 1, 2, 0.25)],
                                  "side string, failures bigint, tokens_in bigint, tokens_out bigint, est_cost_usd double")
    got = {r["measure"]: (r["a"], r["b"]) for r in quality.compare_sides(sides, spend).collect()}
    half = pytest.approx(0.5)
    assert got == {
        "n": (3, 1), "failures": (0, 3), "summary_over": (1, 0), "why_it_matters_over": (1, 0), "title_local_over": (1, 0),
        "key_fact_share": (pytest.approx(2 / 3), 0), "key_fact_kept": (half, None), "numeral_recall": (half, 0), "ungrounded": (1, 1),
        "distinct_tags": (3, 1), "singleton_share": (pytest.approx(2 / 3), 1), "in_vocabulary_share": (pytest.approx(1 / 4), 0),
        "tokens_in": (10, 1), "tokens_out": (20, 2), "est_cost_usd": (half, pytest.approx(0.25))}


def test_sides_where_one_answered_nothing(spark, stories):
    only = stories.withColumn("side", F.lit("a"))
    spend = spark.createDataFrame([("a", 0, 1, 1, 0.0), ("b", 4, 7, 0, 0.1)],
                                  "side string, failures bigint, tokens_in bigint, tokens_out bigint, est_cost_usd double")
    got = {r["measure"]: (r["a"], r["b"]) for r in quality.compare_sides(only, spend).collect()}
    assert got["n"] == (4, None) and got["failures"] == (0, 4) and got["tokens_in"] == (1, 7)


def test_report_marks_repeats_inside_the_window(spark, stories):
    import datetime as dt
    day = lambda n: dt.datetime(2024, 1, n)
    bulletins = spark.createDataFrame(
        [(1, "2024-01-01", 1, "en", 0.5, day(1)), (2, "2024-01-20", 1, "en", 0.5, day(20)), (3, "2024-01-20", 2, "en", 0.5, day(21)),
         (4, "2024-01-21", 1, "en", 0.5, day(22)), (5, "2024-01-22", 1, "en", 0.5, day(22))],
        "id bigint, day string, version int, language string, agreement double, created_at timestamp")
    second = stories.where("bulletin_id = 2").drop("bulletin_id")
    same = second.crossJoin(spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "bulletin_id bigint"))
    # Bulletins 2, 3 and 5 measure alike, 4 has a wrong call; 1 is alike too, but older than the window.
    checks = quality.published_checks(same, ["bulletin_id"])
    calls = spark.createDataFrame([(4, 1, 1, 0, 0, 0)], "bulletin_id bigint, wrong bigint, " + ", ".join(f"{r} bigint" for r in K.REASONS))
    rows = quality.report_rows(bulletins, checks, calls, F.lit(day(15))).collect()
    assert {r["bulletin_id"]: (r["wrong"], r["repeats"]) for r in rows} == {
        2: (0, False), 3: (0, True), 4: (1, False), 5: (0, True)}


def test_calibration(spark):
    labelled = spark.createDataFrame(
        [(1, "wrong", "wrong_fact"), (2, "wrong", "wrong_fact"), (3, "wrong", "wrong_fact"), (4, "wrong", "duplicate"), (5, "wrong", None), (6, "ok", None)],
        "summary_id bigint, verdict string, reason string")
    judged = spark.createDataFrame([(1, False), (2, True), (3, None), (4, True)], "summary_id bigint, passed boolean")
    assert tuple(quality.calibration(labelled, judged).first()) == (1, 1, 1, 2)


def test_judge_details(spark):
    rows = [(1, False, "claim", None, "feed"), (2, None, None, "unparsable output", "feed"), (3, True, None, None, "unknown"), (4, True, None, None, "fetch")]
    got = quality.judge_detail(spark.createDataFrame(rows, "id int, passed boolean, claim string, error string, body_source string"))
    assert [r["detail"] for r in got.orderBy("id").collect()] == ["claim", "unparsable output", K.UNATTRIBUTED, None]


def test_samples_repeat_and_prefer_published(spark):
    rows = spark.range(200).select((F.col("id") % 2).alias("g"), "id", (F.col("id") < 6).alias("out"))
    draw = lambda seed, size: {(r["g"], r["id"]) for r in sampling.stratified_sample(rows, ["g"], "id", F.col("out"), size, seed).collect()}
    assert draw(1, 5) == draw(1, 5) != draw(2, 5)
    assert {(i % 2, i) for i in range(6)} <= draw(1, 5) and len(draw(1, 5)) == 10
    assert all(i < 6 for _, i in draw(1, 2)) and len(draw(1, 2)) == 4


@pytest.mark.parametrize("name", ["a17_content_floor", "a21_stored_or_computed"])
def test_prose_is_read_once(spark, archive, name):
    """What a check found in a summary is written before the bulletins of its day meet it; nothing after reads prose again."""
    from dispatchery.plans import load

    plan = load().queries[name](spark, archive.folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan
