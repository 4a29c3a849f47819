"""DuckDB SQL for the rows of queries that SQL can state."""

from __future__ import annotations


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes, for code points below 2048; the polynomial bit by bit."""
    octets = (
        f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::UBIGINT] "
        "ELSE [(192 + unicode(c) // 64)::UBIGINT, (128 + unicode(c) % 64)::UBIGINT] END))"
    )
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda r, z: xor(r // 2, (r % 2) * 3988292384::UBIGINT))"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {octets}), lambda a, b: {bits}), 4294967295::UBIGINT)"


SPELLING = f"""
WITH RECURSIVE found AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS i, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{6,}}')) AS run FROM documents
), runs AS (
  SELECT i, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM found GROUP BY ALL
), hashed AS (
  SELECT run, n, {crc32("i || ':' || run")} AS h FROM runs
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
  FROM hashed
), vocabulary AS (
  SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM vocabulary
), cut AS (
  SELECT word, n, pos, left(word, pos - 1) || substr(word, pos + 1) AS rest FROM places
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.pos = b.pos AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT cut.word, v.word, v.n FROM cut JOIN vocabulary v ON cut.rest = v.word
  UNION SELECT v.word, cut.word, cut.n FROM cut JOIN vocabulary v ON cut.rest = v.word
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near
), formed AS (
  SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near,
         CASE WHEN r.other_n >= 5 * v.n THEN r.other END AS form, CASE WHEN r.other_n >= 5 * v.n THEN r.other_n END AS form_n
  FROM vocabulary v LEFT JOIN ranked r ON r.word = v.word AND r.place = 1
), chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL
)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e USING (word)
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


def _tree(name: str, start: str) -> str:
    """SQL of a recursive table: the nodes of all trees, every two becoming one a level up."""
    return f"""{name} AS (
  SELECT 0 AS level, tree, pos, size, node FROM {start}
  UNION ALL
  SELECT any_value(level) + 1, tree, pos // 2, any_value(size + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM {name} WHERE size > 1 GROUP BY tree, pos // 2
)"""


def _climb(name: str, start: str, nodes: str) -> str:
    """SQL of a recursive table: rows going up from a leaf, with the siblings so far and the node folded so far."""
    return f"""{name} AS (
  SELECT row_no, tree, 0 AS level, pos, size, proof, folded FROM {start}
  UNION ALL
  SELECT p.row_no, p.tree, p.level + 1, p.pos // 2, (p.size + 1) // 2, p.proof || coalesce(s.node, ''),
         sha256(CASE WHEN s.node IS NULL THEN p.folded WHEN p.pos % 2 = 0 THEN p.folded || s.node ELSE s.node || p.folded END)
  FROM {name} p LEFT JOIN {nodes} s ON s.level = p.level AND s.tree = p.tree AND s.pos = xor(p.pos, 1) WHERE p.size > 1
)"""


MERKLE = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf("n_chars")} AS leaf,
         CASE WHEN n_chars IS NOT NULL AND doc_id IS NOT NULL AND {crc32("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("(n_chars::HUGEINT + 1)")} END AS changed
  FROM documents
), numbered AS (
  SELECT *, row_number() OVER () AS row_no, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size
  FROM hashed
), leaves AS (
  SELECT tree, pos, size, leaf AS node FROM numbered
), {_tree("nodes", "leaves")}, subroots AS (
  SELECT tree AS name, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE size = 1
), crowns AS (
  SELECT '' AS tree, pos, size, subroot AS node FROM subroots
), {_tree("forest", "crowns")}, starts AS (
  SELECT row_no, tree, pos, size, '' AS proof, coalesce(changed, leaf) AS folded FROM numbered
), {_climb("paths", "starts", "nodes")}, halfway AS (
  SELECT p.row_no, '' AS tree, s.pos, s.size, p.proof, p.folded FROM paths p JOIN subroots s ON s.name = p.tree WHERE p.size = 1
), {_climb("upper", "halfway", "forest")}, root AS (
  SELECT node AS root FROM forest WHERE size = 1
)
SELECT n.doc_id, n.leaf, s.subroot, r.root, sha256(u.proof) AS proof_sha256, u.folded AS folded_root, u.folded = r.root AS verified
FROM numbered n JOIN upper u ON u.row_no = n.row_no AND u.size = 1 JOIN subroots s ON s.name = n.tree CROSS JOIN root r
"""
