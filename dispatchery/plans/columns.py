"""Queries of the column functions: URLs, titles, bodies, hashes, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from dispatchery import constants as K
from dispatchery.functions import prompts, text, titles, urls
from dispatchery.functions.calendar import age_label, local_day
from dispatchery.functions.hashing import content_hash, prompt_version
from dispatchery.functions.money import prompt_tokens
from dispatchery.operators import curation, ranking, reading
from dispatchery.plans.reading import pool
from dispatchery.plans.registry import query
from dispatchery.plans.views_sql import DAY, quoted

PREFIXES = "|".join(K.TRACKING_PREFIXES)
KEYS = "|".join(K.TRACKING_KEYS)
MIRRORS = "|".join(K.MIRROR_LABELS)


def pages_and_links(a):
    """Page addresses, and the same with decorations, as links a feed might carry."""
    extra = F.array(
        F.col("url"), F.concat(F.lit(" "), F.col("url"), F.lit("/ ")),
        F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("?b=1&utm_medium=x&a=&spm=2&A=%7Eq#frag")))
    return a.pages.select("page_id", F.posexplode(extra).alias("form", "link"))


LINKS = """
    SELECT page_id, 0 AS form, url AS link FROM pages
    UNION ALL SELECT page_id, 1, ' ' || url || '/ ' FROM pages
    UNION ALL SELECT page_id, 2, regexp_replace(url, '[?#].*$', '') || '?b=1&utm_medium=x&a=&spm=2&A=%7Eq#frag' FROM pages"""


@query("p1_canonical_url", f"""
    SELECT page_id, form, 'https://' || regexp_replace(host, '^({MIRRORS})\\.', '')
      || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END
      AS key
    FROM (SELECT page_id, form, lower(regexp_extract(u, '^[a-z]+://([^/?#]*)', 1)) AS host,
        regexp_replace(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
        list_transform(list_filter(string_split(regexp_extract(u, '\\?([^#]*)', 1), '&'),
          lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '^(({PREFIXES}).*|{KEYS})$')),
          lambda p: replace(CASE WHEN p LIKE '%=%' THEN p ELSE p || '=' END, '%7E', '~')) AS kept
      FROM (SELECT page_id, form, trim(link) AS u FROM ({LINKS}) l) x) y""")
def p1(a):
    return pages_and_links(a).select("page_id", "form", urls.canonical_url(F.col("link")).alias("key"))


@query("p2_blocked_hosts", f"""
    SELECT page_id, link FROM (
      SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://www.reddit.com/r/' || page_id WHEN 1 THEN 'https://old.reddit.com/' || page_id
        WHEN 2 THEN 'https://hnrss.org/x' ELSE url END AS link FROM pages) q
    WHERE regexp_replace(regexp_replace(lower(regexp_extract(link, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', ''), '^old\\.', '')
      NOT IN ({quoted(K.BLOCKED_HOSTS)})""")
def p2(a):
    n = F.col("page_id").cast("string")
    link = (F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://www.reddit.com/r/"), n))
            .when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://old.reddit.com/"), n))
            .when(F.col("page_id") % 4 == 2, F.lit("https://hnrss.org/x")).otherwise(F.col("url")))
    return a.pages.select("page_id", link.alias("link")).where(~urls.is_blocked(F.col("link")))


@query("p3_age_horizon", """
    SELECT id FROM articles, clock WHERE published_at IS NULL OR published_at >= now - INTERVAL 7 DAY""")
def p3(a):
    return a.articles.where(curation.within_horizon(F.col("published_at"), a.now.scalar())).select("id")


HEADS = """
    SELECT id, CASE id % 4 WHEN 0 THEN title WHEN 1 THEN 'Show HN: ' || title WHEN 2 THEN title || ' - The Paper'
      ELSE '&#8216;' || title || '&#8217; &amp; more | Some Outlet' END AS title FROM articles"""
NORMAL = f"""
    SELECT id, trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(
        replace(replace(replace(title, '&#8216;', chr(8216)), '&#8217;', chr(8217)), '&amp;', '&'),
        '(?i)^[\\s\\p{{Z}}]*({"|".join(K.TITLE_PREFIXES)})[\\s\\p{{Z}}]*:[\\s\\p{{Z}}]*', ''),
        '[\\s\\p{{Z}}]+[|–—-][\\s\\p{{Z}}]+[\\p{{L}}\\p{{N}}_ .''&]{{2,30}}$', '')),
        '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')) AS title FROM ({HEADS}) h"""


def heads(a):
    t, i = F.col("title"), F.col("id")
    dressed = (F.when(i % 4 == 0, t).when(i % 4 == 1, F.concat(F.lit("Show HN: "), t))
               .when(i % 4 == 2, F.concat(t, F.lit(" - The Paper")))
               .otherwise(F.concat(F.lit("&#8216;"), t, F.lit("&#8217; &amp; more | Some Outlet"))))
    return a.articles.select("id", dressed.alias("title"))


@query("p4_normal_title", NORMAL)
def p4(a):
    return heads(a).select("id", titles.normalize_title(F.col("title")).alias("title"))


@query("p5_short_titles", f"""
    SELECT id, len(list_filter(string_split(title, ' '), lambda t: t <> '')) < 4 AS short FROM ({NORMAL}) n""")
def p5(a):
    return heads(a).select("id", titles.is_short_title(titles.normalize_title(F.col("title"))).alias("short"))


NEGATED = f"""
    SELECT id, title || CASE id % 5 WHEN 1 THEN ' 5' WHEN 2 THEN ' not 5 6' WHEN 3 THEN ' 5 7' ELSE '' END AS title FROM ({NORMAL}) n"""
NUMS = "list_distinct(list_filter(string_split({}, ' '), lambda t: regexp_matches(t, '\\p{{Nd}}')))"
NEGS = "list_sort(list_distinct(list_filter(string_split({}, ' '), lambda t: list_contains([" + quoted(K.NEGATIONS) + "], t))))"


@query("p6_contradictions", f"""
    SELECT x.id, (len(list_filter({NUMS.format("x.title")}, lambda t: NOT list_contains({NUMS.format("y.title")}, t))) > 0
      AND len(list_filter({NUMS.format("y.title")}, lambda t: NOT list_contains({NUMS.format("x.title")}, t))) > 0)
      OR {NEGS.format("x.title")} <> {NEGS.format("y.title")} AS vetoed
    FROM ({NEGATED}) x JOIN ({NEGATED}) y ON y.id = x.id + 1""")
def p6(a):
    tail = F.when(F.col("id") % 5 == 1, " 5").when(F.col("id") % 5 == 2, " not 5 6").when(F.col("id") % 5 == 3, " 5 7").otherwise("")
    normal = heads(a).select("id", F.concat(titles.normalize_title(F.col("title")), tail).alias("title"))
    after = normal.select((F.col("id") - 1).alias("id"), F.col("title").alias("next_title"))
    return normal.join(after, "id").select("id", titles.contradicts(F.col("title"), F.col("next_title")).alias("vetoed"))


@query("u4_array_sets", f"""
    SELECT x.id, len(list_intersect(list_distinct(string_split(x.title, ' ')), list_distinct(string_split(y.title, ' ')))) AS shared,
      len(list_filter(list_distinct(string_split(x.title, ' ')), lambda t: NOT list_contains(string_split(y.title, ' '), t))) AS only_first
    FROM ({NORMAL}) x JOIN ({NORMAL}) y ON y.id = x.id + 1 WHERE x.title <> '' AND y.title <> ''""")
def u4(a):
    normal = heads(a).select("id", titles.normalize_title(F.col("title")).alias("t")).where("t <> ''").select(
        "id", F.split("t", " ").alias("t"))
    after = normal.select((F.col("id") - 1).alias("id"), F.col("t").alias("u"))
    return normal.join(after, "id").select("id", F.size(F.array_intersect("t", "u")).alias("shared"),
                                           F.size(F.array_except("t", "u")).alias("only_first"))


@query("p7_usable_bodies", """
    SELECT id, length(b) >= 400 AND NOT (length(b) < 800 AND b LIKE '%...') AS usable FROM (
      SELECT id, regexp_replace(CASE WHEN id % 3 = 0 THEN body_text || '...  ' ELSE body_text END,
        '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS b FROM articles) q""")
def p7(a):
    body = F.when(F.col("id") % 3 == 0, F.concat(F.col("body_text"), F.lit("...  "))).otherwise(F.col("body_text"))
    return a.articles.select("id", text.is_usable(body).alias("usable"))


VERSIONED = "CASE id % 3 WHEN 0 THEN 'lib-' || id || ' v0.' || id || '.1-rc' WHEN 1 THEN 'Python 3.' || id || ' released' ELSE title END"


@query("p8_version_titles", f"""
    SELECT id, regexp_matches({VERSIONED}, '^[^\\s\\p{{Z}}][^\\n]{{0,60}}?[\\s\\p{{Z}}]+v?\\p{{Nd}}+\\.\\p{{Nd}}+(\\.\\p{{Nd}}+)*[\\p{{L}}\\p{{N}}_.\\-]*$')
      AS version_title FROM articles""")
def p8(a):
    n = F.col("id").cast("string")
    title = (F.when(F.col("id") % 3 == 0, F.concat(F.lit("lib-"), n, F.lit(" v0."), n, F.lit(".1-rc")))
             .when(F.col("id") % 3 == 1, F.concat(F.lit("Python 3."), n, F.lit(" released"))).otherwise(F.col("title")))
    return a.articles.select("id", text.is_version_title(title).alias("version_title"))


SQUEEZE = "regexp_replace(regexp_replace({}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
TIDY = "regexp_replace(" + SQUEEZE + ", '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def sided_bodies(a):
    """Feed text for two of three articles, a page text for two of five, a search hit for all."""
    art = a.bodies
    feed = art.where("id % 3 <> 0").select("id", text.tidy_body(F.col("body_text")).alias("feed_text"))
    page = art.where("id % 5 < 2").select("id", text.tidy_body(F.concat(F.col("body_text"), F.lit(" "), F.col("title"))).alias("page_text"))
    hit = art.select("id", F.concat(F.lit("hit "), F.col("title")).alias("found_text"))
    return curation.choose_bodies(art, feed, page, a.sources, hit)


OK = "(length({0}) >= 400 AND NOT (length({0}) < 800 AND regexp_matches({0}, '(…|\\.\\.\\.|\\[…\\]|\\[\\.\\.\\.\\]|\\(\\.\\.\\.\\)|\\[Read more\\])$')))"
BODIES = f"""
    SELECT id, CASE WHEN {OK.format("f")} THEN 'feed' WHEN {OK.format("p")} THEN 'fetch' WHEN length(p) > length(f) THEN 'fetch'
        WHEN f <> '' THEN 'feed' END AS body_source,
      NOT ({OK.format("f")} OR {OK.format("p")}) AND weight >= 1.0
        AND NOT regexp_matches(title, '^[^\\s\\p{{Z}}][^\\n]{{0,60}}?[\\s\\p{{Z}}]+v?\\p{{Nd}}+\\.\\p{{Nd}}+(\\.\\p{{Nd}}+)*[\\p{{L}}\\p{{N}}_.\\-]*$')
        AS searchable, f, p
    FROM (SELECT a.id, a.title, s.weight,
        CASE WHEN a.id % 3 <> 0 THEN {TIDY.format("body_text")} ELSE '' END AS f,
        CASE WHEN a.id % 5 < 2 THEN {TIDY.format("body_text || ' ' || title")} ELSE '' END AS p
      FROM articles a JOIN sources s ON s.id = a.source_id) q"""


@query("p9_body_choice", f"""
    SELECT id, body_source, CASE body_source WHEN 'feed' THEN md5(f) WHEN 'fetch' THEN md5(p) END AS body, searchable FROM ({BODIES}) b""")
def p9(a):
    return sided_bodies(a).select("id", "body_source", F.md5("body_text").alias("body"), "searchable")


@query("a26_enrich_stats", f"""
    SELECT count(*) AS examined, count(*) FILTER ({OK.format("f")}) AS from_feed,
      count(*) FILTER (NOT {OK.format("f")} AND {OK.format("p")}) AS fetched, count(*) FILTER (searchable) AS searched,
      count(*) FILTER (NOT {OK.format("f")} AND NOT {OK.format("p")} AND NOT searchable) AS still_empty FROM ({BODIES}) b""")
def a26_enrich(a):
    return curation.enrich_stats(sided_bodies(a))


@query("p10_candidates", """
    SELECT id FROM marked_articles a, clock WHERE dup_of IS NULL AND fetched_at >= now - INTERVAL 7 DAY
      AND NOT EXISTS (SELECT 1 FROM summaries s WHERE s.article_id = a.id)""")
def p10(a):
    return curation.candidates(a.marked_articles, a.summaries, a.now.scalar()).select("id")


DRAFT_TAGS = "[' ' || upper(tag) || ' ', tag, 'Open Source', '', 'x', 'y', 'z']"


@query("p16_draft_validation", f"""
    SELECT id, importance BETWEEN 1 AND 5 AND kind IN ({quoted(K.KINDS)}) AND trim(why_it_matters) <> '' AS accepted,
      lower(tag) || ',open-source,x,y,z' AS tags
    FROM (SELECT id, CAST(importance + CASE WHEN id % 7 = 0 THEN 3 ELSE 0 END AS INT) AS importance,
      CASE WHEN id % 8 = 0 THEN 'gossip' ELSE kind END AS kind, why_it_matters, 'src' || source_id AS tag FROM summaries) q""")
def p16(a):
    tag = F.concat(F.lit("src"), F.col("source_id").cast("string"))
    drafts = a.summaries.select(
        "id", "title_local", "summary", "why_it_matters",
        (F.col("importance") + F.when(F.col("id") % 7 == 0, 3).otherwise(0)).alias("importance"),
        F.when(F.col("id") % 8 == 0, "gossip").otherwise(F.col("kind")).alias("kind"),
        F.array(F.concat(F.lit(" "), F.upper(tag), F.lit(" ")), tag, F.lit("Open Source"), F.lit(""), F.lit("x"),
                F.lit("y"), F.lit("z")).alias("tags"))
    return curation.validate_drafts(drafts).select("id", "accepted", F.array_join("tags", ",").alias("tags"))


@query("p18_corpus", """
    SELECT id FROM marked_articles WHERE length(body_text) > 400 AND body_source IN ('feed', 'fetch') AND dup_of IS NULL""")
def p18(a):
    return curation.eligible_corpus(a.marked_articles).select("id")


@query("k6_repair_set", f"""
    SELECT article_id, min(why) AS why FROM (
      SELECT id AS article_id, 'unknown' AS why FROM articles WHERE body_source = 'unknown' AND id IN (SELECT article_id FROM summaries)
      UNION ALL SELECT s.article_id, 'wrong_fact' FROM verdicts v JOIN summaries s ON s.id = v.summary_id
        WHERE v.verdict = 'wrong' AND v.reason = 'wrong_fact') q GROUP BY article_id""")
def k6(a):
    return curation.repair_set(a.articles, a.summaries, a.verdicts)


@query("f5_content_hash", """
    SELECT id, sha256(CAST(to_json([title_local, summary, why_it_matters]) AS VARCHAR)) AS content_hash FROM summaries""")
def f5(a):
    return a.summaries.select("id", content_hash(F.col("title_local"), F.col("summary"), F.col("why_it_matters")).alias("content_hash"))


@query("f6_prompt_version", "SELECT conv_id, turn, substr(sha256(text), 1, 12) AS version FROM conversations")
def f6(a):
    return a.messages.select("conv_id", "turn", prompt_version(F.col("text")).alias("version"))


@query("f7_local_days", f"""
    SELECT id, {DAY.format("fetched_at")} AS fetched_day, {DAY.format("published_at")} AS published_day FROM articles""")
def f7(a):
    return a.articles.select("id", local_day(F.col("fetched_at")).alias("fetched_day"),
                             local_day(F.col("published_at")).alias("published_day"))


@query("f8_age_labels", """
    SELECT id, CASE WHEN h IS NULL THEN 'age unknown' WHEN h < 1 THEN 'under an hour old'
      WHEN h < 48 THEN CAST(round_even(h, 0) AS BIGINT) || 'h old' ELSE CAST(round_even(h / 24, 0) AS BIGINT) || 'd old' END AS age
    FROM (SELECT id, epoch(now - published_at) / 3600.0 AS h FROM articles, clock) q""")
def f8_labels(a):
    from dispatchery.functions.calendar import age_hours
    return a.articles.select("id", age_label(age_hours(a.now.scalar(), F.col("published_at"))).alias("age"))


BODY_CUT = f"CASE WHEN body_text = '' THEN '{K.NO_BODY}' ELSE body_text END"


@query("f13_summary_prompt", f"""
    SELECT a.id, md5('Read ' || s.name || ' / ' || title || ' / ' || a.url || ' / ' || {BODY_CUT}
      || CASE WHEN a.id % 4 = 0 THEN chr(10) || chr(10) || '{K.WEB_CONTEXT_MARKER}' || chr(10) || body_text ELSE '' END) AS prompt
    FROM articles a JOIN sources s ON s.id = a.source_id WHERE a.id % 4 <> 0 OR trim(body_text) <> ''""")
def f13(a):
    rows = a.articles.join(a.sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id")
    rows = rows.withColumn("extra_text", F.when(F.col("id") % 4 == 0, F.col("body_text")))
    return rows.select("id", F.md5(prompts.fill(
        "Read {source} / {title} / {url} / {body}{extra}", prompts.summary_fields())).alias("prompt"))


@query("f13_judge_tokens", """
    SELECT s.id, (length('Source: ' || src.name || chr(10) || 'Title: ' || a.title || chr(10) || chr(10) || 'Article text:' || chr(10)
      || a.body_text || chr(10) || chr(10) || '---' || chr(10) || 'Summary:' || chr(10) || s.summary || chr(10) || chr(10)
      || 'Why it matters:' || chr(10) || s.why_it_matters)) // 4 AS tokens
    FROM summaries s JOIN articles a ON a.id = s.article_id JOIN sources src ON src.id = a.source_id""")
def f13_judge(a):
    rows = reading.star(a.summaries, a.articles, a.sources)
    return rows.select("id", prompt_tokens(prompts.judge_text()).alias("tokens"))


@query("f13_candidate_lines", """
    SELECT day, summary_id, md5(ordinal || '. [' || name || ' · weight ' || printf('%.1f', weight) || ' · ' || kind || ' · '
      || CASE WHEN h < 1 THEN 'under an hour old' WHEN h < 48 THEN CAST(round_even(h, 0) AS BIGINT) || 'h old'
           ELSE CAST(round_even(h / 24, 0) AS BIGINT) || 'd old' END
      || ' · importance ' || importance || '] ' || title_local || chr(10) || '   ' || summary || chr(10) || '   Why it matters: ' || why_it_matters) AS line
    FROM (SELECT s.day, s.id AS summary_id, src.name, src.weight, s.kind, s.importance, s.title_local, s.summary, s.why_it_matters,
        epoch(c.now - coalesce(a.published_at, a.fetched_at)) / 3600.0 AS h,
        row_number() OVER (PARTITION BY s.day ORDER BY src.weight DESC, a.published_at ASC NULLS LAST, a.id) AS ordinal
      FROM summaries s JOIN marked_articles a ON a.id = s.article_id JOIN sources src ON src.id = a.source_id, clock c
      WHERE s.relevant AND a.dup_of IS NULL AND NOT EXISTS (SELECT 1 FROM items i JOIN bulletins b ON b.id = i.bulletin_id
        WHERE i.summary_id = s.id AND b.day <> s.day)) q""")
def f13_lines(a):
    everything = pool(a, 100_000)
    first = ranking.arrangements(everything, ["day"], 0, 2).where("pass = 1").select("day", "ordinal", "summary_id")
    return everything.join(first, ["day", "summary_id"]).select(
        "day", "summary_id", F.md5(prompts.candidate_line()).alias("line"))


@query("f13_previous_block", """
    SELECT day, language, chr(10) || chr(10) || 'PREVIOUSLY PUBLISHED (context, not candidates):' || chr(10)
      || string_agg('- ' || title_local, chr(10) ORDER BY place) AS block
    FROM (SELECT d.day, d.language, place, s.title_local
      FROM (SELECT day, language, lag(last_id) OVER (PARTITION BY language ORDER BY day) AS prev
        FROM (SELECT day, language, arg_max(id, version) AS last_id FROM bulletins GROUP BY day, language) q) d
      JOIN (SELECT bulletin_id, summary_id, row_number() OVER (PARTITION BY bulletin_id ORDER BY position) AS place
        FROM items) l ON l.bulletin_id = d.prev AND place <= 8
      JOIN summaries s ON s.id = l.summary_id) z GROUP BY day, language""")
def f13_previous(a):
    return prompts.previous_blocks(reading.previous_headlines(a.bulletins, a.items, a.summaries))


@query("f16_paragraphs", """
    SELECT conv_id, turn, len(b) AS n, array_to_string(b, '|') AS blocks FROM (
      SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(trim(t), '\\n\\s*\\n'),
        lambda p: trim(regexp_replace(p, '[\\s\\p{Z}]+', ' ', 'g'))), lambda p: p <> '') AS b
      FROM (SELECT conv_id, turn, replace(text, chr(10), chr(10) || ' ' || chr(10)) AS t FROM conversations) q) z""")
def f16(a):
    blocks = text.paragraphs(F.replace(F.col("text"), F.lit("\n"), F.lit("\n \n")))
    return a.messages.select("conv_id", "turn", blocks.alias("b")).select(
        "conv_id", "turn", F.size("b").alias("n"), F.array_join("b", "|").alias("blocks"))
