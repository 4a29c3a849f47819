"""A Merkle manifest of documents: a tree a language, a tree over their roots, and every row's proof.

Leaves are numbered by one range sort. Every level of a tree is one equijoin of its nodes with
themselves: a node's sibling has its index with the last bit turned (XOR 1), and nodes in slot zero
emit the parents. Proofs come from above: a level's nodes join the paths of their parents, so a row
meets as many paths as it has parents, not one sibling table a level. Column expressions only.

Levels are written, since each is read by both sides of the next join: a lost executor costs the
level it worked on. Keys of all joins are unique, so no language is too large for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchery.llm.runs import Run

#: Levels of the way down that are planned together before the paths are written.
STRIDE = 6


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of texts, one behind the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes before it, `-` for null, so that neighbours can't be confused."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _hex(digest_bytes: Column) -> Column:
    return F.lower(F.hex(digest_bytes))


def _parent(left: Column, right: Column) -> Column:
    return F.unhex(digest(_hex(left), F.coalesce(_hex(right), F.lit(""))))


def leaves(docs: DataFrame, every: int = 7) -> DataFrame:
    """(doc_id, tree, leaf, changed): the digest of each row, and of the row as tampering leaves it where it does.

    Tampering adds 1 to n_chars of the rows whose CRC-32 of the decimal doc_id `every` divides; rows
    with a null in either column stay as they are. `tree` is `=` and the language, empty for null,
    which sorts first.
    """
    row_id, count = F.col("doc_id").cast("long"), F.col("n_chars").cast("long")
    before = [field(row_id), field(F.col("source")), field(F.col("lang"))]
    after = field(F.col("text"))
    # As a decimal, so that the greatest long has a successor.
    more = field(count.cast("decimal(20,0)") + F.lit(1).cast("decimal(20,0)"))
    hit = (F.crc32(row_id.cast("string").cast("binary")) % every == 0) & count.isNotNull()
    return docs.select(
        row_id.alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        F.unhex(digest(*before, field(count), after)).alias("leaf"),
        F.when(hit, F.unhex(digest(*before, more, after))).alias("changed"),
    )


def in_order(run: Run, df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """`df` with `at`, the row's place in its tree by `order` (from 0, nulls first), and `size`, the tree's rows.

    One range sort; rows that are equal in all of `order` are parted by where they were read, so that no
    number of copies meets in one task. A range's rows are counted a tree, and only these counts are summed up.
    """
    salted = run.keep(df.withColumn("_read", F.monotonically_increasing_id()))
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order, "_read")]
    placed = run.keep(salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_read").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy(tree, part).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_rows"))
    whole, before = Window.partitionBy(tree), Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(tree, "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_low")).alias("_shift"), F.sum("_rows").over(whole).alias("size"))
    numbered = placed.withColumn("_part", part).join(starts, [tree, "_part"])
    return run.keep(numbered.withColumn("at", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift"))


def levels(run: Run, nodes: DataFrame) -> list[DataFrame]:
    """The levels of all trees from the leaves up, as (tree, at, size, node, sibling, ...): trees of one node are in the level where they end.

    `nodes` holds (tree, at, size, node) and what else the leaves are to keep.
    """
    out = []
    most = nodes.agg(F.max("size")).first()[0] or 0
    for _ in range((most - 1).bit_length() + 1 if most else 0):
        mirror = nodes.select("tree", F.col("at").bitwiseXOR(F.lit(1)).alias("at"), F.col("node").alias("sibling"))
        level = run.keep(nodes.join(mirror, ["tree", "at"], "left"))
        out.append(level)
        nodes = level.filter((F.col("size") > 1) & (F.col("at") % 2 == 0)).select(
            "tree", F.shiftright("at", 1).alias("at"), F.shiftright(F.col("size") + 1, 1).alias("size"), _parent(F.col("node"), F.col("sibling")).alias("node")
        )
    return out


def tops(run: Run, tree_levels: list[DataFrame]) -> DataFrame:
    """(tree, level, top): the last node of every tree and the level it is in."""
    each = [level.filter("size = 1").select("tree", F.lit(k).alias("level"), F.col("node").alias("top")) for k, level in enumerate(tree_levels)]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return run.keep(out)


def _step(level: DataFrame, above: DataFrame, keep: list[str]) -> DataFrame:
    """Nodes below the nodes of `above`, with their paths: (turns, siblings) from the node to the top."""
    turn = F.when(F.col("sibling").isNull(), "-").when(F.col("at") % 2 == 0, "r").otherwise("l")
    upper = above.select("tree", F.col("at").alias("_up"), F.col("turns").alias("_turns"), F.col("siblings").alias("_siblings"), "top")
    below = level.filter("size > 1").withColumn("_up", F.shiftright("at", 1)).join(upper, ["tree", "_up"])
    path = F.concat(F.coalesce(F.col("sibling"), F.unhex(F.lit(""))), F.col("_siblings"))
    return below.select(*keep, F.concat(turn, F.col("_turns")).alias("turns"), path.alias("siblings"), "top")


def paths(run: Run, tree_levels: list[DataFrame], ends: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns of every leaf with `turns`, `siblings` and `top`.

    `ends` holds (tree, level, top, turns, siblings): what is above each tree's top. `turns` says a
    level where the sibling is (l, r, or - for none) and `siblings` are the 32-byte digests that there are.
    """
    def ending(k: int) -> DataFrame:
        return ends.filter(F.col("level") == k)

    above = None
    for k in range(len(tree_levels) - 1, 0, -1):
        here = ending(k).select("tree", F.lit(0).cast("long").alias("at"), "turns", "siblings", "top")
        above = here if above is None else here.unionByName(_step(tree_levels[k], above, ["tree", "at"]))
        if k % STRIDE == 0:
            above = run.keep(above)
    lone = tree_levels[0].filter("size = 1").join(ending(0).drop("level"), "tree").select(*keep, "turns", "siblings", "top")
    return lone if above is None else lone.unionByName(_step(tree_levels[0], above, keep))


def fold(leaf: Column, turns: Column, siblings: Column) -> Column:
    """The root that a leaf (hexadecimal text) and its path lead to."""
    start = F.struct(leaf.alias("node"), F.lit(0).alias("used"))

    def climb(a: Column, turn: Column) -> Column:
        beside = _hex(F.substring(siblings, a["used"] + 1, 32))
        node = F.when(turn == "l", digest(beside, a["node"])).when(turn == "r", digest(a["node"], beside)).otherwise(digest(a["node"]))
        return F.struct(node.alias("node"), (a["used"] + F.when(turn == "-", 0).otherwise(32)).alias("used"))

    climbed = F.aggregate(F.split(turns, ""), start, climb, lambda a: a["node"])
    return F.when(F.length(turns) == 0, leaf).otherwise(climbed)


def manifest(docs: DataFrame, every: int = 7) -> DataFrame:
    """Every row's leaf, the roots it is under, the digest of its proof and whether its row, as tampering leaves it, still proves.

    Null columns are written `-`; null texts too, empty ones `0:`. Rows without a language have a tree of
    their own, first among the trees. In a tree rows ascend by doc_id, null first, rows of one doc_id by
    their leaf, and rows equal in both can change places without another result. A lone row's leaf is its
    subroot, and a lone subroot the root, with a proof of no siblings. Other columns are not part of a
    leaf and may have any name; an empty table gives no rows.
    """
    run = Run(docs.sparkSession, "merkle")
    rows = in_order(run, leaves(docs, every), "tree", ["doc_id", "leaf"]).withColumnRenamed("leaf", "node")
    inner = levels(run, rows)
    if not inner:
        return _report(rows.select("doc_id", F.col("node").alias("leaf"), "changed", F.lit("").alias("turns"), F.unhex(F.lit("")).alias("siblings"), F.col("node").alias("top")), "")
    subroots = tops(run, inner)
    # One tree over the subroots: its leaves are the trees below.
    forest = in_order(run, subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "level", F.col("top").alias("node")), "tree", ["name"])
    outer = levels(run, forest)
    crown = tops(run, outer)
    top = crown.select(_hex(F.col("top"))).first()[0]
    over = crown.select("tree", "level", "top", F.lit("").alias("turns"), F.unhex(F.lit("")).alias("siblings"))
    # `level` of a forest leaf is the level its own tree ends in; rename it while the forest's own levels are walked.
    outer[0] = outer[0].withColumnRenamed("level", "ends")
    ends = run.keep(paths(run, outer, over, ["name", "ends", "node"]).select(
        F.col("name").alias("tree"), F.col("ends").alias("level"), F.col("node").alias("top"), "turns", "siblings"))
    inner[0] = inner[0].withColumnRenamed("node", "leaf")
    return _report(paths(run, inner, ends, ["doc_id", "leaf", "changed"]), top)


def _report(rows: DataFrame, root: str) -> DataFrame:
    folded = rows.withColumn("folded_root", fold(_hex(F.coalesce("changed", "leaf")), F.col("turns"), F.col("siblings")))
    return folded.select(
        "doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("top")).alias("subroot"), F.lit(root).alias("root"),
        digest(_hex(F.col("siblings"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"),
    )
