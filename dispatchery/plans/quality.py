"""Queries of the quality layer."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dispatchery import constants as K
from dispatchery.functions.numerals import numeral_values
from dispatchery.functions.text import capitalised_tokens, content_tokens
from dispatchery.operators import quality, reading, sampling
from dispatchery.plans.reading import DAY_STORIES, r6
from dispatchery.plans.registry import query
from dispatchery.plans.views_sql import quoted, scatter_sql
from dispatchery.session import cut, ensure_checkpoint_dir, spread
from dispatchery.sources.publications import Publications

KEY = ["bulletin_id"]


def words_sql(col: str) -> str:
    squeezed = f"trim(regexp_replace({col}, '[\\s\\p{{Z}}]+', ' ', 'g'))"
    return f"(CASE WHEN {squeezed} = '' THEN 0 ELSE len(string_split({squeezed}, ' ')) END)"


def tokens_sql(col: str) -> str:
    found = f"list_distinct(regexp_extract_all(lower({col}), '[\\p{{L}}\\p{{N}}_'']+'))"
    return f"list_filter({found}, lambda x: length(x) > 2 AND NOT list_contains([{quoted(K.STOPWORDS)}], x))"


# The engines' regexes differ: this one looks at no character before or after a match, so the character before is taken into it.
GAP = "[ \\t\\n\\x0B\\f\\r]?"
FIGURE = f"(?:^|[^\\p{{L}}\\p{{N}}_.])([0-9]+(?:[.,][0-9]+)*)(?:{GAP}%?{GAP}([\\p{{L}}_][\\p{{L}}\\p{{N}}_]*))?"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def spelled_sql(value: str) -> str:
    """A figure's one spelling: no fraction where there is none, else up to six places."""
    return f"(CASE WHEN {value} = floor({value}) THEN coalesce(CAST(TRY_CAST({value} AS DECIMAL(38, 0)) AS VARCHAR), CAST({value} AS VARCHAR)) ELSE CAST(round({value}, 6) AS VARCHAR) END)"


def figures_sql(rows: str, key: str, text: str) -> str:
    """(key, bare, scaled), one row a figure of the texts in `rows`."""
    scale = " ".join(f"WHEN '{word}' THEN {float(factor)!r}" for word, factor in K.SCALES.items())
    return f"""
      SELECT {key}, {spelled_sql("v")} AS bare, {spelled_sql("v * factor")} AS scaled FROM (
        SELECT {key}, CAST(CASE WHEN regexp_matches(raw, '^[0-9]+([.,][0-9]{{3}})*$') THEN replace(replace(raw, '.', ''), ',', '')
            ELSE replace(replace(regexp_extract(raw, '^(.*)[.,][0-9]+$', 1), '.', ''), ',', '') || '.' || regexp_extract(raw, '([0-9]+)$', 1) END
            AS DOUBLE) AS v, CASE translate(word, '{UPPER}', '{UPPER.lower()}') {scale} END AS factor
        FROM (SELECT {key}, unnest(regexp_extract_all({text}, '{FIGURE}', 1)) AS raw, unnest(regexp_extract_all({text}, '{FIGURE}', 2)) AS word
          FROM {rows}) found)"""


def values_sql(rows: str, key: str, text: str) -> str:
    """(key, vals): the figures of each text that has any, bare and scaled."""
    return f"""SELECT {key}, list_distinct(list_filter(flatten(list([bare, scaled])), lambda x: x IS NOT NULL)) AS vals
      FROM ({figures_sql(rows, key, text)}) g GROUP BY {key}"""


def marked_summaries(a, mark=quality.story_marks):
    """What a check found in each summary: narrow, and written once, so that prose is read once however many bulletins and joins use it."""
    return cut(mark(quality.with_facts(spread(a.summaries), a.facts), ["id", "day", "language"]))


def marks(a, bulletins=None, marked=None):
    """Marked stories of bulletins; a summary is marked once, not once a bulletin that shows it."""
    marked = marked_summaries(a) if marked is None else marked
    return reading.day_stories(a.bulletins if bulletins is None else bulletins, a.items, marked)


def light(a):
    """Stories without anything read from bodies."""
    from dispatchery.functions.text import parse_tags
    return reading.day_stories(a.bulletins, a.items, spread(a.summaries)).withColumn("tags", parse_tags(F.col("tags_json")))


BODIES = "SELECT id, coalesce(body_text, '') AS body_text FROM articles"
FULL = f"SELECT q.bulletin_id, q.position, s.* FROM ({DAY_STORIES}) q JOIN summaries s ON s.id = q.id"


@query("f1_numeral_values", f"""
    SELECT b.id, coalesce(array_to_string(list_sort(list_distinct(list_filter(flatten(list([f.bare, f.scaled])), lambda x: x IS NOT NULL))), ','), '')
      AS numerals
    FROM ({BODIES}) b LEFT JOIN ({figures_sql(f"({BODIES}) b", "id", "body_text")}) f ON f.id = b.id GROUP BY b.id""")
def f1(a):
    """The figures of every whole text."""
    return a.bodies.select("id", F.array_join(numeral_values(F.col("body_text")), ",").alias("numerals"))


@query("f2_capitalised_tokens", f"""
    SELECT id, array_to_string(list_sort(list_distinct(
      regexp_extract_all(body_text, '(?:^|[^\\p{{L}}\\p{{N}}_])([A-ZÇĞİÖŞÜ][\\p{{L}}\\p{{N}}_\\-'']+)', 1))), ' ') AS names FROM ({BODIES}) b""")
def f2(a):
    return a.bodies.select("id", F.array_join(capitalised_tokens(F.col("body_text")), " ").alias("names"))


@query("f3_content_tokens", f"""
    SELECT id, list_aggregate(list_sort({tokens_sql("body_text")}), 'string_agg', ' ') AS tokens FROM articles
    WHERE len({tokens_sql("body_text")}) > 0""")
def f3(a):
    found = content_tokens(F.col("body_text"))
    return a.bodies.select("id", F.array_sort(found).alias("t")).where(F.size("t") > 0).select(
        "id", F.array_join("t", " ").alias("tokens"))


@query("f4_parse_tags", """
    SELECT id, CASE WHEN id % 5 = 0 THEN 0 ELSE 3 END AS n, CASE WHEN id % 5 <> 0 THEN source_tag END AS second
    FROM (SELECT id, 'src' || source_id AS source_tag FROM summaries) q""")
def f4(a):
    from dispatchery.functions.text import parse_tags
    broken = F.when(F.col("id") % 5 == 0, F.lit("[oops")).otherwise(F.col("tags_json"))
    return a.summaries.select("id", parse_tags(broken).alias("t")).select(
        "id", F.size("t").alias("n"), F.get("t", F.lit(1)).alias("second"))


@query("a16_word_budget", f"""
    SELECT bulletin_id, count(*) AS n, count(*) FILTER ({words_sql("summary")} > 55) AS summary_over,
      count(*) FILTER ({words_sql("why_it_matters")} > 20) AS why_it_matters_over,
      count(*) FILTER ({words_sql("title_local")} > 10) AS title_local_over,
      round(count(*) FILTER ({words_sql("summary")} > 55) / CAST(count(*) AS DOUBLE), 6) AS summary_share,
      round(count(*) FILTER ({words_sql("why_it_matters")} > 20) / CAST(count(*) AS DOUBLE), 6) AS why_it_matters_share,
      round(count(*) FILTER ({words_sql("title_local")} > 10) / CAST(count(*) AS DOUBLE), 6) AS title_local_share
    FROM ({FULL}) q GROUP BY bulletin_id""")
def a16(a):
    found = quality.word_budget(light(a), KEY)
    return found.select("bulletin_id", "n", "summary_over", "why_it_matters_over", "title_local_over",
                        *[r6(f"{f}_share").alias(f"{f}_share") for f in K.WORD_BUDGETS])


FACT_SHARES = f"""round(count(*) FILTER (trim(coalesce(key_fact, '')) <> '') / CAST(count(*) AS DOUBLE), 6) AS key_fact_share,
      round(count(*) FILTER (trim(coalesce(key_fact, '')) <> '' AND list_has_any({tokens_sql("key_fact")},
        {tokens_sql("title_local || ' ' || summary")}))
        / CAST(nullif(count(*) FILTER (trim(coalesce(key_fact, '')) <> ''), 0) AS DOUBLE), 6) AS key_fact_kept"""
PROSE = "SELECT id, coalesce(summary, '') || ' ' || coalesce(why_it_matters, '') AS prose FROM summaries"


@query("a17_content_floor", f"""
    WITH b AS ({values_sql(f"({BODIES}) t", "id", "body_text")}), p AS ({values_sql(f"({PROSE}) t", "id", "prose")})
    SELECT bulletin_id, count(*) AS n, {FACT_SHARES}, count(b.vals) AS n_with_numerals,
      round(count(*) FILTER (list_has_any(p.vals, b.vals)) / CAST(nullif(count(b.vals), 0) AS DOUBLE), 6) AS numeral_recall
    FROM ({FULL}) q LEFT JOIN b ON b.id = q.article_id LEFT JOIN p ON p.id = q.id GROUP BY bulletin_id""")
def a17(a):
    marked = marked_summaries(a, quality.content_marks)
    found = quality.content_of(reading.day_stories(a.bulletins, a.items, marked), KEY)
    return found.select("bulletin_id", "n", r6("key_fact_share").alias("key_fact_share"),
                        r6("key_fact_kept").alias("key_fact_kept"), "n_with_numerals",
                        r6("numeral_recall").alias("numeral_recall"))


@query("a17_key_facts", f"""
    SELECT bulletin_id, {FACT_SHARES}
    FROM ({FULL}) q GROUP BY bulletin_id""")
def a17_facts(a):
    empty = light(a).withColumn("body_numerals", F.array().cast("array<string>"))
    return quality.content_floor(empty, KEY).select(
        "bulletin_id", r6("key_fact_share").alias("key_fact_share"), r6("key_fact_kept").alias("key_fact_kept"))


DRESSED = """SELECT id, coalesce(summary || ' Fiyat ' || CAST(id AS VARCHAR) || ' milyon.', '') || ' ' || coalesce(why_it_matters, '') AS prose
    FROM summaries"""
PRICED = """SELECT id, coalesce(body_text || ' It cost $' || CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) ELSE '7' END || ' million.', '') AS body
    FROM articles"""


@query("a18_ungrounded_numerals", f"""
    WITH b AS ({values_sql(f"({PRICED}) t", "id", "body")}),
      p AS (SELECT id, list_distinct(list(coalesce(scaled, bare))) AS claimed FROM ({figures_sql(f"({DRESSED}) t", "id", "prose")}) g GROUP BY id)
    SELECT bulletin_id, article_id, array_to_string(list_sort(made), ',') AS numerals FROM (
      SELECT q.bulletin_id, q.article_id, list_filter(p.claimed, lambda x: NOT list_contains(b.vals, x)) AS made
      FROM ({FULL}) q JOIN b ON b.id = q.article_id JOIN p ON p.id = q.id) m WHERE len(made) > 0""")
def a18(a):
    """Every story with a figure added to its summary that only every other body holds."""
    n = F.col("id").cast("string")
    bodies = a.bodies.withColumn("body_text", F.concat(
        F.col("body_text"), F.lit(" It cost $"), F.when(F.col("id") % 2 == 0, n).otherwise(F.lit("7")), F.lit(" million.")))
    dressed = reading.day_stories(a.bulletins, a.items, a.summaries).withColumn(
        "summary", F.concat(F.col("summary"), F.lit(" Fiyat "), n, F.lit(" milyon.")))
    rows = quality.story_rows(dressed, bodies)
    return quality.ungrounded_numerals(rows, KEY).withColumn("numerals", F.array_join(F.array_sort("numerals"), ","))


USES = f"""
    SELECT bulletin_id, tag, count(*) AS uses FROM (
      SELECT bulletin_id, unnest(CAST(tags_json AS JSON)::VARCHAR[]) AS tag FROM ({FULL}) q) t GROUP BY bulletin_id, tag"""


@query("a19_tag_vocabulary", f"""
    SELECT bulletin_id, count(*) AS "distinct", round(count(*) FILTER (uses = 1) / CAST(count(*) AS DOUBLE), 6) AS singleton_share,
      round(coalesce(sum(uses) FILTER (tag IN ({quoted(K.TAG_VOCABULARY)})), 0) / CAST(sum(uses) AS DOUBLE), 6) AS in_vocabulary_share
    FROM ({USES}) u GROUP BY bulletin_id""")
def a19(a):
    return quality.tag_vocabulary(light(a), KEY).select(
        "bulletin_id", "distinct", r6("singleton_share").alias("singleton_share"),
        r6("in_vocabulary_share").alias("in_vocabulary_share"))


@query("a19_top_tags", f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bulletin_id ORDER BY uses DESC, tag) AS place
      FROM ({USES}) u) z WHERE place <= 10""")
def a19_top(a):
    return quality.top_tags(light(a), KEY)


@query("a20_importance_distribution", f"""
    SELECT bulletin_id, {", ".join(f"round(avg(CASE WHEN importance = {k} THEN 1.0 ELSE 0.0 END), 6) AS share_{k}" for k in range(1, 6))}
    FROM ({FULL}) q GROUP BY bulletin_id""")
def a20(a):
    found = quality.importance_distribution(light(a), KEY)
    return found.select("bulletin_id", *[r6(f"share_{k}").alias(f"share_{k}") for k in range(1, 6)])


def flat_checks(checks, *more):
    c = "checks.{}"
    return checks.select(
        "bulletin_id", *more, F.col(c.format("n")).alias("n"), F.col(c.format("n_published")).alias("n_published"),
        *[F.col(f"checks.budget.{f}_over").alias(f"{f}_over") for f in K.WORD_BUDGETS],
        *[r6(f"checks.content.{f}").alias(f) for f in ("key_fact_share", "key_fact_kept", "numeral_recall")],
        F.col("checks.ungrounded").alias("ungrounded"), F.col("checks.tags.distinct").alias("distinct_tags"),
        r6("checks.tags.singleton_share").alias("singleton_share"))


@query("a21_published_checks")
def a21(a):
    return flat_checks(quality.checks_of(marks(a), KEY))


@query("a21_stored_or_computed")
def a21_stored(a):
    """The checks of even bulletins are frozen in a publication first; those of the others are computed."""
    marked = marked_summaries(a)
    even = quality.checks_of(marks(a, a.bulletins.where("id % 2 = 0"), marked), KEY)
    shelf = Publications(a.spark, f"{ensure_checkpoint_dir(a.spark)}/frozen-{uuid.uuid4().hex}")
    shelf.commit("even", {"checks": even})
    wanted = a.bulletins.select(F.col("id").alias("bulletin_id"))
    both = quality.stored_or_computed(wanted, shelf.read("checks", even.schema), marks(a, marked=marked))
    return flat_checks(both, "at_publish")


@query("a22_judge_tallies", """
    SELECT model, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed,
      count(*) FILTER (passed IS NULL) AS unparsed FROM eval_results GROUP BY model""")
def a22(a):
    return quality.judge_tallies(a.eval_results, ["model"])


@query("a22_judge_detail", f"""
    SELECT e.id, CASE WHEN e.id % 5 <> 0 AND e.detail IS NOT NULL THEN e.detail
      WHEN e.passed IS NULL THEN 'unparsable output'
      WHEN e.passed AND a.body_source NOT IN ('feed', 'fetch') THEN '{K.UNATTRIBUTED}' END AS detail
    FROM eval_results e JOIN articles a ON a.id = e.summary_id""")
def a22_detail(a):
    outcomes = a.eval_results.select(
        "id", F.col("summary_id").alias("_a"), "passed", F.when(F.col("id") % 5 != 0, F.col("detail")).alias("claim"),
        F.when(F.col("passed").isNull(), "unparsable output").alias("error"),
    ).join(a.articles.select(F.col("id").alias("_a"), "body_source"), "_a")
    return quality.judge_detail(outcomes).select("id", "detail")


@query("a23_calibration", """
    SELECT count(*) FILTER (v.reason = 'wrong_fact' AND j.passed = false) AS caught,
      count(*) FILTER (v.reason = 'wrong_fact' AND j.passed) AS missed,
      count(*) FILTER (v.reason = 'wrong_fact' AND j.passed IS NULL) AS unparsed,
      count(*) FILTER (v.reason <> 'wrong_fact' OR v.reason IS NULL) AS other_reason
    FROM verdicts v JOIN summaries s ON s.id = v.summary_id JOIN articles a ON a.id = s.article_id
    LEFT JOIN (SELECT summary_id, passed FROM (SELECT *, row_number() OVER (PARTITION BY summary_id
      ORDER BY created_at DESC, id DESC) AS k FROM eval_results) q WHERE k = 1) j ON j.summary_id = s.id
    WHERE v.verdict = 'wrong' AND a.body_text IS NOT NULL""")
def a23(a):
    bodied = a.articles.where(F.col("body_text").isNotNull()).select(F.col("id").alias("article_id"))
    labelled = a.verdicts.join(
        a.summaries.select(F.col("id").alias("summary_id"), "article_id"), "summary_id").join(bodied, "article_id", "left_semi")
    return quality.calibration(labelled, reading.latest_judgements(a.eval_results))


@query("a25_compare_sides")
def a25(a):
    """The stored summaries against their first sentences alone, over every article that has one."""
    sides = a.summaries.withColumn("side", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumns({
        "summary": F.when(F.col("side") == "a", F.col("summary")).otherwise(F.regexp_extract("summary", r"^[^.]*", 0)),
        "position": F.lit(None).cast("int")})
    answered = quality.with_facts(sides.where("side = 'a' OR id % 13 <> 0"), a.facts)
    spent = sides.groupBy("side").agg(
        F.count_if((F.col("side") == "b") & (F.col("id") % 13 == 0)).alias("failures"),
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.sum("est_cost_usd").alias("est_cost_usd"))
    return quality.compare_sides(answered, spent).select("measure", r6("a").alias("a"), r6("b").alias("b"))


def report(a):
    since = a.bulletins.agg((F.max("created_at") - F.expr("interval 30 days")).alias("t")).scalar()
    # The window comes first: nothing of an older bulletin is read.
    shown = a.bulletins.where(F.col("created_at") >= since)
    checks = quality.checks_of(marks(a, shown), KEY)
    counts = reading.verdict_counts(reading.day_stories(shown, a.items, a.summaries.select("id", "day", "language")), a.verdicts)
    return quality.report_rows(shown, checks, counts, since)


@query("a27_report_rows")
def a27(a):
    return report(a).select(
        "bulletin_id", "day", "version", r6("agreement").alias("agreement"), F.col("checks.n").alias("n"),
        F.col("checks.n_published").alias("n_published"), "wrong", *K.REASONS, "repeats")


@query("k5_quality_report")
def k5(a):
    """Every report row with its spend beside it."""
    from dispatchery.plans.reading import a4
    spent = a4(a)
    values = [spent.select(c).scalar().alias(c) for c in ("product_runs", "product_cost", "eval_cost")]
    return report(a).select(
        "bulletin_id", "day", "version", r6("agreement").alias("agreement"), F.col("checks.n").alias("n"),
        F.col("checks.n_published").alias("n_published"), F.col("checks.ungrounded").alias("ungrounded"),
        r6("checks.content.key_fact_kept").alias("key_fact_kept"), "wrong", "repeats", *values)


@query("l6_hash_sample", f"""
    SELECT id, {scatter_sql("id", "3")} AS scatter FROM marked_articles
    WHERE length(body_text) > 400 AND body_source IN ('feed', 'fetch') AND dup_of IS NULL
    ORDER BY scatter, id LIMIT 40""")
def l6(a):
    from dispatchery.operators.curation import eligible_corpus
    return sampling.hash_sample(eligible_corpus(a.marked_articles), "id", 40, 3).select("id", "scatter")


@query("l7_stratified_sample", f"""
    SELECT bulletin_id, id FROM (SELECT bulletin_id, id, row_number() OVER (PARTITION BY bulletin_id
      ORDER BY position IS NOT NULL DESC, {scatter_sql("id", "5")}, id) AS k FROM ({DAY_STORIES}) q) z WHERE k <= 12""")
def l7(a):
    rows = reading.day_stories(a.bulletins, a.items, a.summaries).select("bulletin_id", "id", "position")
    return sampling.stratified_sample(rows, KEY, "id", F.col("position").isNotNull(), 12, 5).select("bulletin_id", "id")
