"""Aggregating readings, on small orders."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from dispatchery.operators import ranking
from dispatchery.operators.numbering import _cut_ties, numbered


def picks_of(spark, days):
    """{day: [[ids], ...]} as picks; tiers and reasons from the place."""
    rows = []
    for day, orders in days.items():
        for p, order in enumerate(orders, 1):
            for i, item in enumerate(order, 1):
                rows.append((day, p, i, item, "lead" if i == 1 else "brief", f"r{p}" if (item + p) % 2 else ""))
    return spark.createDataFrame(rows, "day string, pass int, position int, summary_id bigint, tier string, reason string")


def plain_borda(orders, quorum=2):
    score, seen, best = {}, {}, {}
    for order in orders:
        for i, x in enumerate(order):
            score[x] = score.get(x, 0) + len(order) - i
            seen[x] = seen.get(x, 0) + 1
            best[x] = min(best.get(x, i), i)
    kept = [x for x in score if seen[x] >= min(quorum, len(orders))]
    return sorted(kept, key=lambda x: (-score[x], best[x], x))


def plain_tau(a, b):
    shared = [x for x in a if x in b]
    if len(shared) < 2:
        return 0.0
    signs = [1 if b.index(x) < b.index(y) else -1 for x, y in itertools.combinations(shared, 2)]
    return sum(signs) / len(signs)


CASES = {
    "kept": [[1, 2], [1, 2], [3, 4]], "tie": [[7, 5], [5, 7]], "one": [[4, 3, 2]],
    "apart": [[1, 2], [3, 4]], "same": [[1, 2, 3]] * 3, "reverse": [[1, 2, 3], [3, 2, 1]],
}


def random_cases():
    rng = random.Random(5)
    return {f"r{i}": [rng.sample(range(1, 12), rng.randint(1, 8)) for _ in range(3)] for i in range(15)}


def test_borda(spark):
    cases = {**CASES, **random_cases()}
    got = ranking.borda(picks_of(spark, cases), ["day"]).collect()
    for day, orders in cases.items():
        mine = [r["summary_id"] for r in sorted((r for r in got if r["day"] == day), key=lambda r: r["position"])]
        assert mine == plain_borda(orders), day


def test_tau_and_jaccard(spark):
    cases = {**CASES, **random_cases()}
    got = {(r["day"], r["pass_a"], r["pass_b"]): r for r in ranking.pass_pairs(picks_of(spark, cases), ["day"]).collect()}
    for day, orders in cases.items():
        for i, j in itertools.combinations(range(len(orders)), 2):
            a, b = orders[i], orders[j]
            row = got[(day, i + 1, j + 1)]
            assert row["tau"] == pytest.approx(plain_tau(a, b)), day
            assert row["jaccard"] == pytest.approx(len(set(a) & set(b)) / len(set(a) | set(b)))


def test_agreement(spark):
    pools = spark.createDataFrame([(d, 6) for d in CASES], "day string, pool bigint")
    got = {r["day"]: r for r in ranking.agreement(picks_of(spark, CASES), pools, ["day"]).collect()}
    assert got["one"]["agreement"] is None
    assert got["same"]["agreement"] == pytest.approx(1.0)
    assert got["reverse"]["agreement"] == pytest.approx(-1.0)
    kept, pool, observed = 2, 6, 0.0
    chance = kept / (2 * pool - kept)
    assert got["apart"]["agreement"] == pytest.approx(min(0.0, (observed - chance) / (1 - chance)))


def test_expected_jaccard(spark):
    row = spark.range(1).select(
        ranking.expected_jaccard(F.lit(15), F.lit(27)).alias("a"), ranking.expected_jaccard(F.lit(0), F.lit(5)).alias("b"),
        ranking.corrected_jaccard(F.lit(1.0), F.lit(9), F.lit(5)).alias("c")).first()
    assert round(row["a"], 3) == 0.385 and row["b"] == 0.0 and row["c"] == 1.0


def test_tiers_reasons_and_note(spark):
    rows = [
        ("d", 1, 1, 1, "lead", ""), ("d", 1, 2, 2, "lead", "b1"), ("d", 1, 3, 3, "major", ""),
        ("d", 2, 1, 1, "lead", "a2"), ("d", 2, 2, 2, "lead", "b2"), ("d", 2, 3, 3, "brief", " "),
    ]
    picks = spark.createDataFrame(rows, "day string, pass int, position int, summary_id bigint, tier string, reason string")
    notes = spark.createDataFrame([("d", 1, "first"), ("d", 2, "second")], "day string, pass int, note string")
    pools = spark.createDataFrame([("d", 5)], "day string, pool bigint")
    items, days = ranking.aggregate(picks, notes, pools, ["day"])
    got = {r["summary_id"]: (r["position"], r["tier"], r["reason"]) for r in items.collect()}
    assert got == {1: (1, "lead", "a2"), 2: (2, "major", "b1"), 3: (3, "brief", None)}
    assert days.first()["editor_note"] == "first"


def test_valid_picks(spark):
    arranged = spark.createDataFrame([("d", 1, o, 100 + o) for o in range(1, 5)], "day string, pass int, ordinal int, summary_id bigint")
    answers = spark.createDataFrame(
        [("d", 1, n, number, "brief", " r ") for n, number in enumerate([9, 2, 2, 0, 4, 1, 3])],
        "day string, pass int, nth int, number int, tier string, reason string")
    got = ranking.valid_picks(answers, arranged, ["day"], 3).orderBy("position").collect()
    assert [(r["position"], r["summary_id"], r["reason"]) for r in got] == [(1, 102, "r"), (2, 104, "r"), (3, 101, "r")]


def test_numbering_equals_row_number_with_a_hot_group(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"),
        (F.col("id") * 7919 % 13).alias("w"), "id")
    rows = rows.withColumn("w", F.when(F.col("w") == 5, None).otherwise(F.col("w")))
    got = numbered(rows, ["g"], [F.asc_nulls_last("w"), F.asc("id")], [F.coalesce("w", F.lit(99)), F.floor(F.col("id") / 64)])
    from pyspark.sql import Window

    plain = rows.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy(F.asc_nulls_last("w"), F.asc("id"))))
    key = lambda df: {(r["g"], r["id"]): r["position"] for r in df.collect()}
    assert key(got) == key(plain)


def test_ties_of_one_value_are_cut_over_many_tasks(spark):
    """40 % of a day's rows without a time and 30 % at midnight: each hot bucket is cut, positions are those of one window."""
    from pyspark.sql import Window

    at = F.when(F.col("id") % 10 < 4, None).when(F.col("id") % 10 < 7, F.lit("2025-03-01 00:00:00")).otherwise(
        F.concat(F.lit("2025-03-01 0"), (F.col("id") % 7).cast("string"), F.lit(":10:00"))).cast("timestamp")
    rows = spark.range(6000).select((F.col("id") * 7919 % 6007).alias("article_id"), at.alias("published_at"), F.lit(1.0).alias("weight"),
                                    F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise("d").alias("day"))
    bucket = [-F.col("weight"), F.col("published_at").isNull(), F.date_trunc("hour", "published_at")]
    got = numbered(rows, ["day"], ranking.survivor_order(), bucket, "place", ranking.survivor_ties(), hot=200, every=8)
    plain = rows.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(*ranking.survivor_order())))
    key = lambda df: sorted((r["day"] or "", r["place"], r["article_id"]) for r in df.collect())
    assert key(got) == key(plain) and got.columns == plain.select(rows.columns + ["place"]).columns
    split = rows.withColumns({f"_b{i}": c for i, c in enumerate(bucket)}).withColumn("_tie", F.struct(*ranking.survivor_ties()))
    parts = _cut_ties(split, ["day", "_b0", "_b1", "_b2"], 200, 8).groupBy("day", "_b0", "_b1", "_b2", "_cut").count()
    # Buckets of up to 200 rows stay whole; of those above (the largest has over 2000) no part is large.
    assert parts.agg(F.max("count").alias("n")).first()["n"] <= 200
    assert parts.where("_cut > 0").agg(F.max("count").alias("n")).first()["n"] <= 80
    assert numbered(rows.limit(0), ["day"], ranking.survivor_order(), bucket, "place", ranking.survivor_ties()).count() == 0
