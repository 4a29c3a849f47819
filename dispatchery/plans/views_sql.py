"""The archive's views once more, as SQL text for the checking engine."""

from __future__ import annotations

import re

from dispatchery import constants as K


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def scatter_sql(i: str, seed: str) -> str:
    return (
        f"((({i}) % {K.HASH_MODULUS}) * (({K.HASH_BASE} + ({seed}) * {K.HASH_SEED_STEP})"
        f" % {K.HASH_MODULUS})) % {K.HASH_MODULUS}"
    )


def price_sql(model: str, side: int) -> str:
    cases = " ".join(f"WHEN starts_with({model}, '{p}') THEN {v[side]}" for p, v in K.PRICES.items())
    return f"CAST(CASE {cases} ELSE {K.DEAREST_PRICE[side]} END AS DOUBLE)"


def cost_sql(model: str, tin: str, tout: str) -> str:
    return f"((({tin}) * {price_sql(model, 0)} + ({tout}) * {price_sql(model, 1)}) / 1000000.0)"


MODEL_LIST = quoted(K.PRICES)
DAY = "strftime({} + INTERVAL 3 HOUR, '%Y-%m-%d')"
BAND = (
    "(CASE WHEN {0} = 1 THEN 'lead' WHEN {0} <= 4 THEN 'major'"
    " WHEN {0} <= 9 THEN 'notable' ELSE 'brief' END)"
)
TIER_RANK = "(list_position([" + quoted(K.TIERS) + "], {}) - 1)"

VIEWS: dict[str, str] = {
    "docs": """
        SELECT *, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS n,
          TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 41) AS fetched,
          regexp_extract(text, '^[^.\\n]*') AS head
        FROM documents""",
    "sources": """
        SELECT DISTINCT n AS id, 'src' || n AS name, round(CAST(0.5 + (n % 16) * 0.1 AS DOUBLE), 1) AS weight,
          (n % 10) <> 9 AS enabled, 'https://src' || n || '.example.com/feed' AS url
        FROM docs""",
    "articles": """
        SELECT doc_id AS id, n AS source_id, head AS title,
          CASE WHEN doc_id % 17 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 37) END
            AS published_at,
          fetched AS fetched_at, text AS body_text,
          ['feed', 'fetch', 'unknown'][CAST(doc_id % 3 AS INT) + 1] AS body_source,
          'https://' || source || '.example.com/' || doc_id AS url
        FROM docs""",
    "marked_articles": """
        SELECT a.*, CASE WHEN f.first_id < a.id THEN f.first_id END AS dup_of
        FROM articles a JOIN (SELECT title, min(id) AS first_id FROM articles GROUP BY title) f
          USING (title)""",
    "clock": "SELECT max(fetched_at) AS now FROM articles",
    "summaries": f"""
        SELECT d.doc_id AS id, d.doc_id AS article_id, d.n AS source_id, 'en' AS language,
          head AS title_local, regexp_extract(text, '^[^\\n]*') AS summary,
          regexp_replace(text, '^[^\\n]*\\n?', '') AS why_it_matters,
          '["' || lang || '","' || source || '","t' || (d.doc_id % 7) || '"]' AS tags_json,
          CAST(d.doc_id % 5 + 1 AS INT) AS importance, quality = 1 AS relevant,
          [{quoted(K.KINDS)}][CAST(d.doc_id % 6 AS INT) + 1] AS kind,
          nullif(regexp_extract(text, '[\\p{{L}}\\p{{N}}_]{{7,}}'), '') AS key_fact,
          fetched + INTERVAL 5 MINUTE AS created_at,
          {DAY.format("(fetched + INTERVAL 5 MINUTE)")} AS day,
          n_chars // 4 AS tokens_in, least(n_chars // 4, 513) AS tokens_out,
          [{MODEL_LIST}][CAST(d.doc_id % 5 AS INT) + 1] AS model,
          {cost_sql(f"[{MODEL_LIST}][CAST(d.doc_id % 5 AS INT) + 1]", "n_chars // 4", "least(n_chars // 4, 513)")}
            AS est_cost_usd
        FROM docs d JOIN labels USING (doc_id)""",
    "translations": """
        SELECT id AS summary_id, 'tr' AS language, 'TR ' || title_local AS title_local,
          'TR ' || summary AS summary, 'TR ' || why_it_matters AS why_it_matters,
          CASE WHEN id % 10 = 0 THEN sha256(title_local)
            ELSE sha256(CAST(to_json([title_local, summary, why_it_matters]) AS VARCHAR)) END
            AS canonical_hash
        FROM summaries WHERE id % 2 = 0""",
    "verdicts": f"""
        SELECT doc_id AS summary_id, 'wrong' AS verdict,
          [{quoted(K.REASONS)}][CAST(doc_id % 4 AS INT) + 1] AS reason,
          CASE WHEN doc_id % 3 = 0 THEN 'note ' || doc_id END AS note,
          TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 43) AS created_at
        FROM labels WHERE toxic = 1""",
    "eval_results": f"""
        SELECT doc_id * 2 + r AS id, doc_id AS summary_id, 'grounding' AS kind,
          CASE WHEN doc_id % 11 <> 0 THEN (quality = 1) = (r = 1) END AS passed,
          CASE WHEN doc_id % 11 <> 0 AND (quality = 1) = (r = 1) THEN NULL ELSE 'claim ' || doc_id END
            AS detail,
          [{MODEL_LIST}][CAST((doc_id + r) % 5 AS INT) + 1] AS model,
          TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 47 + r * 60) AS created_at,
          CAST(r * 0.0004 AS DOUBLE) AS est_cost_usd
        FROM labels, (SELECT unnest([1, 2]) AS r) WHERE r = 1 OR doc_id % 2 = 0""",
    "readings": f"""
        SELECT day, pass, position, summary_id,
          CASE WHEN pass < 3 THEN {BAND.format("position")}
            ELSE [{quoted(K.TIERS)}][CAST(least({TIER_RANK.format(BAND.format("position"))} + 1, 3) AS INT) + 1]
          END AS tier,
          CASE WHEN (summary_id + pass) % 4 = 0 THEN '' ELSE 'because ' || summary_id || '.' || pass END
            AS reason
        FROM (SELECT day, pass, id AS summary_id,
            row_number() OVER (PARTITION BY day, pass
              ORDER BY importance * 200000 + {scatter_sql("id", "pass")} DESC, id) AS position
          FROM summaries, (SELECT unnest([1, 2, 3]) AS pass) WHERE relevant) q
        WHERE position <= {K.TOP_N}""",
    "versioned_readings": """
        SELECT r.*, version FROM readings r, (SELECT unnest([1, 2]) AS version) v
        WHERE pass < 3 OR version = 2""",
    "notes": """
        SELECT DISTINCT day, version, pass, 'note ' || day || '/' || pass AS note
        FROM versioned_readings""",
    "pools": """
        SELECT day, version, pool
        FROM (SELECT day, count(*) AS pool FROM summaries WHERE relevant GROUP BY day) p,
          (SELECT unnest([1, 2]) AS version) v""",
    "sizes": """
        SELECT day, version, pass, count(*) AS size FROM versioned_readings
        GROUP BY day, version, pass""",
    "borda": """
        SELECT *, row_number() OVER (PARTITION BY day, version ORDER BY score DESC, best, summary_id)
          AS position
        FROM (SELECT day, version, summary_id, CAST(sum(size - position + 1) AS BIGINT) AS score,
            count(*) AS seen, min(position) AS best
          FROM versioned_readings JOIN sizes USING (day, version, pass)
          GROUP BY day, version, summary_id) s
        WHERE seen >= (SELECT least(count(*), 2) FROM sizes z
          WHERE z.day = s.day AND z.version = s.version)""",
    "tiers": f"""
        SELECT day, version, summary_id, position,
          CASE WHEN voted = 'lead' AND sum(CASE WHEN voted = 'lead' THEN 1 ELSE 0 END)
              OVER (PARTITION BY day, version ORDER BY position) > 1 THEN 'major' ELSE voted END AS tier
        FROM borda JOIN (
          SELECT day, version, summary_id, tier AS voted,
            row_number() OVER (PARTITION BY day, version, summary_id
              ORDER BY count(*) DESC, {TIER_RANK.format("tier")} DESC) AS k
          FROM versioned_readings GROUP BY day, version, summary_id, tier) t
        USING (day, version, summary_id) WHERE k = 1""",
    "reasons": """
        SELECT day, version, summary_id, arg_min(reason, pass) AS reason
        FROM versioned_readings WHERE trim(reason) <> '' GROUP BY day, version, summary_id""",
    "best_notes": f"""
        SELECT day, version, note AS editor_note FROM (
          SELECT n.day, n.version, n.pass, note,
            row_number() OVER (PARTITION BY n.day, n.version ORDER BY count(b.summary_id) DESC, n.pass) AS k
          FROM notes n JOIN versioned_readings r USING (day, version, pass)
          LEFT JOIN borda b ON b.day = r.day AND b.version = r.version AND b.summary_id = r.summary_id
            AND b.position <= {K.TOP_N}
          GROUP BY n.day, n.version, n.pass, note) q
        WHERE k = 1""",
    "pass_pairs": """
        SELECT day, version, pass_a, pass_b,
          CASE WHEN n < 2 THEN CAST(0 AS DOUBLE) ELSE (2.0 * coalesce(kept, 0) - n * (n - 1) / 2.0) / (n * (n - 1) / 2.0) END
            AS tau,
          CAST(n AS DOUBLE) / (size_a + size_b - n) AS jaccard
        FROM (
          SELECT za.day, za.version, za.pass AS pass_a, zb.pass AS pass_b, za.size AS size_a,
            zb.size AS size_b,
            (SELECT count(*) FROM versioned_readings x JOIN versioned_readings y
              ON x.day = y.day AND x.version = y.version AND x.summary_id = y.summary_id
              WHERE x.day = za.day AND x.version = za.version AND x.pass = za.pass AND y.pass = zb.pass) AS n,
            (SELECT count(*) FROM shared s JOIN shared t ON s.day = t.day AND s.version = t.version
              AND s.pass_a = t.pass_a AND s.pass_b = t.pass_b AND s.pos_a < t.pos_a AND s.pos_b < t.pos_b
              WHERE s.day = za.day AND s.version = za.version AND s.pass_a = za.pass AND s.pass_b = zb.pass)
              AS kept
          FROM sizes za JOIN sizes zb ON za.day = zb.day AND za.version = zb.version AND za.pass < zb.pass) q""",
    "shared": """
        SELECT x.day, x.version, x.pass AS pass_a, y.pass AS pass_b, x.position AS pos_a,
          y.position AS pos_b, x.summary_id
        FROM versioned_readings x JOIN versioned_readings y
          ON x.day = y.day AND x.version = y.version AND x.summary_id = y.summary_id AND x.pass < y.pass""",
    "agreements": """
        SELECT day, version, tau, jaccard, kept, pool,
          CASE WHEN tau IS NOT NULL THEN least(tau,
            CASE WHEN chance >= 1.0 THEN 1.0 ELSE (jaccard - chance) / nullif(1.0 - chance, 0) END) END
            AS agreement
        FROM (
          SELECT *, CAST(least(kept, pool) AS DOUBLE) / nullif(2 * pool - least(kept, pool), 0) AS chance
          FROM (SELECT day, version, CAST(round_even(avg(size), 0) AS BIGINT) AS kept FROM sizes
              GROUP BY day, version) k
            JOIN pools USING (day, version)
            LEFT JOIN (SELECT day, version, avg(tau) AS tau, avg(jaccard) AS jaccard FROM pass_pairs
              GROUP BY day, version) m USING (day, version)) q""",
    "bulletins": f"""
        SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(day AS DATE)) * 10 + version AS BIGINT) AS id,
          day, 'en' AS language, version, editor_note,
          CASE WHEN version = 2 THEN 'TR ' || editor_note END AS editor_note_tr,
          version = 2 AND date_diff('day', DATE '2024-01-01', CAST(day AS DATE)) % 3 <> 0 AS bilingual,
          agreement,
          CAST(date_diff('day', DATE '2024-01-01', CAST(day AS DATE)) * 2 + version AS BIGINT) AS run_id,
          CAST(day AS TIMESTAMP) + INTERVAL 21 HOUR + to_hours(version) AS created_at
        FROM agreements LEFT JOIN best_notes USING (day, version)""",
    "items": f"""
        SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(day AS DATE)) * 10 + version AS BIGINT)
            AS bulletin_id,
          summary_id, position, tier, reason,
          CASE WHEN summary_id % 2 = 0 THEN 'TR ' || reason END AS reason_tr
        FROM tiers LEFT JOIN reasons USING (day, version, summary_id) WHERE position <= {K.TOP_N}""",
    "runs": """
        SELECT o_orderkey AS id,
          CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'digest' ELSE 'collect' END AS kind,
          CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'partial' ELSE 'error' END AS status,
          o_orderdate AS started_at, o_orderdate + to_seconds(o_custkey % 600) AS finished_at,
          o_custkey % 100 AS n_summarized, o_totalprice / 1000000.0 AS est_cost_usd
        FROM orders""",
    "run_steps": f"""
        SELECT *, CASE WHEN model = '' THEN 0.0 ELSE {cost_sql("model", "tokens_in", "tokens_out")} END
          AS est_cost_usd
        FROM (SELECT l_orderkey AS run_id, l_linenumber AS stage,
            ['collect', 'dedupe', 'enrich', 'summarize', 'rank', 'translate', 'persist'][l_linenumber] AS node,
            CASE l_returnflag WHEN 'A' THEN 'gpt-6-luna' WHEN 'N' THEN 'gpt-5.6-luna' ELSE '' END AS model,
            CAST(l_quantity * 100 AS BIGINT) AS tokens_in, CAST(l_quantity * 10 AS BIGINT) AS tokens_out,
            l_partkey % 50 AS n_out, l_shipdate AS started_at,
            l_shipdate + to_seconds(l_suppkey % 300) AS finished_at
          FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
              ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_returnflag) AS k
            FROM lineitem) q WHERE k = 1) s""",
    "poll_log": """
        SELECT event_id AS poll_id, user_id AS source_id, ts, event_type <> 'error' AS ok,
          event_type = 'view' AS unchanged, CAST(floor(value) AS BIGINT) AS items,
          CASE WHEN event_type <> 'view' THEN json_extract_string(props, '$.k') END AS etag
        FROM events""",
    "messages": """
        SELECT conv_id, turn, role, text, length(text) // 4 AS tokens FROM conversations""",
}


def with_views(sql: str) -> str:
    """`sql` with the views it names, and the ones those name, put in front."""
    needed: dict[str, None] = {}

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                needed[name] = None

    visit(sql)
    if not needed:
        return sql
    body = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in needed)
    joined = sql.strip()
    if joined.upper().startswith("WITH "):
        return f"WITH {body},\n{joined[5:]}"
    return f"WITH {body}\n{joined}"
