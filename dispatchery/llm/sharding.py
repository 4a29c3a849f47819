"""Resharding by minimum-cost flow: from the bytes of old shards and the capacities of new ones, the fewest bytes move.

The flow is solved over shards (a transport problem of old times new shards). What moves are blocks:
a row larger than a block is one of its own, all others are dealt to the blocks of their old shard by
a hash of the row. There are BLOCKS blocks a new shard and at most as many large rows, whatever the
table's size, so the driver sees a bounded list of sizes and every task a bounded list of places.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchery.llm.runs import Run
from dispatchery.operators.numbering import numbered

SHARDS = 8
#: Blocks a new shard: sizes come out equal up to about one block.
BLOCKS = 1024


def capacities(total: int, shards: int) -> list[int]:
    """`total` in equal parts, the first ones greater by one where it doesn't divide."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def cheapest_flow(supply: list[int], room: list[int], cost: list[list[int]] | None = None) -> np.ndarray:
    """Units from each old to each new shard at the least total cost; without `cost`, staying is free and moving costs 1 a unit.

    Successive cheapest paths over the residual graph. The sums of `supply` and `room` must be equal.
    """
    if sum(supply) != sum(room):
        raise ValueError("old sizes and new capacities differ in sum")
    m, n = len(supply), len(room)
    if cost is None:
        cost = [[int(i != j) for j in range(n)] for i in range(m)]
    flow, left, free = np.zeros((m, n), dtype=object), list(supply), list(room)
    height = [0] * (m + n)
    while any(left):
        reach: list[float] = [float("inf")] * (m + n)
        came = [-1] * (m + n)
        queue = [(0, i) for i in range(m) if left[i]]
        for _, i in queue:
            reach[i] = 0
        heapq.heapify(queue)
        while queue:
            d, v = heapq.heappop(queue)
            if d > reach[v]:
                continue
            if v < m:
                edges = [(m + j, cost[v][j]) for j in range(n)]
            else:
                edges = [(i, -cost[i][v - m]) for i in range(m) if flow[i][v - m]]
            for w, c in edges:
                far = d + c + height[v] - height[w]
                if far < reach[w]:
                    reach[w], came[w] = far, v
                    heapq.heappush(queue, (far, w))
        end = min((m + j for j in range(n) if free[j]), key=lambda v: reach[v] + height[v])
        height = [h + min(r, reach[end]) for h, r in zip(height, reach)]
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        path.reverse()
        back = [flow[b][a - m] for a, b in zip(path, path[1:]) if a >= m]
        units = min([left[path[0]], free[end - m], *back])
        for a, b in zip(path, path[1:]):
            if a < m:
                flow[a][b - m] += units
            else:
                flow[b][a - m] -= units
        left[path[0]] -= units
        free[end - m] -= units
    return flow


def place(old: np.ndarray, sizes: np.ndarray, flow: np.ndarray, room: list[int]) -> np.ndarray:
    """The new shard of every block: large blocks first, each where its old shard's flow has most left, then moves that level the shards.

    A move takes the block nearest to half the gap from the fullest to the emptiest shard and makes the
    gap smaller, so it ends; of equal blocks one that is away from home moves. A shard that holds nothing smaller than
    the gap gives no more.
    """
    rest, target = flow.astype(np.int64), np.zeros(len(sizes), dtype=np.int64)
    for b in np.argsort(-sizes, kind="stable"):
        left = rest[old[b]]
        target[b] = int(np.argmax(left))
        left[target[b]] -= sizes[b]
    over = np.bincount(target, weights=sizes, minlength=len(room)).astype(np.int64) - np.array(room, dtype=np.int64)
    giving = np.ones(len(room), dtype=bool)
    while giving.any():
        full, empty = int(np.argmax(np.where(giving, over, np.iinfo(np.int64).min))), int(np.argmin(over))
        gap = over[full] - over[empty]
        there = np.flatnonzero((target == full) & (sizes < gap))
        if not len(there):
            # It holds nothing small enough; the shards after it may.
            giving[full] = False
            continue
        off = np.abs(2 * sizes[there] - gap)
        near = there[off == off.min()]
        away = near[old[near] != full]
        b = away[0] if len(away) else near[0]
        target[b] = empty
        over[full] -= sizes[b]
        over[empty] += sizes[b]
    return target


def _block(ident: Column, old: Column, size: Column, unit: int, total: Column) -> Column:
    """A row's block in its old shard: itself if larger than `unit`, else one of the shard's own by hash, below zero."""
    count = F.greatest(F.ceil(total / F.lit(unit)), F.lit(1))
    return F.when(size > unit, ident).otherwise(-1 - F.pmod(F.xxhash64(ident), count))


def moves(rows: DataFrame, room: list[int] | int = SHARDS, cost: list[list[int]] | None = None, blocks: int = BLOCKS) -> DataFrame:
    """`rows` (ident, old, size, ...) with `shard`, the new one.

    `ident` is a long at or above zero that stays with its row, `old` counts from 0, `room` holds the new
    capacities or only their number. The driver gets one row an old shard, then one a block; the blocks'
    places go to all tasks.
    """
    old_sizes = {r["old"]: int(r["bytes"]) for r in rows.groupBy("old").agg(F.sum("size").alias("bytes")).collect()}
    supply = [old_sizes.get(i, 0) for i in range(max(old_sizes, default=0) + 1)]
    total = sum(supply)
    room = capacities(total, room) if isinstance(room, int) else list(room)
    unit = max(total // (blocks * len(room)), 1)
    named = F.create_map(*[F.lit(x) for pair in enumerate(supply) for x in pair])
    keyed = rows.withColumn("block", _block(F.col("ident"), F.col("old"), F.col("size"), unit, named[F.col("old")]))
    found = keyed.groupBy("old", "block").agg(F.sum("size").alias("bytes")).orderBy("old", "block").collect()
    old, sizes = (np.array([r[c] for r in found], dtype=np.int64) for c in ("old", "bytes"))
    target = place(old, sizes, cheapest_flow(supply, room, cost), room) if found else []
    spark = rows.sparkSession
    places = spark.createDataFrame([(r["old"], r["block"], int(t)) for r, t in zip(found, target)], "old int, block long, shard int")
    return keyed.join(F.broadcast(places), ["old", "block"]).drop("block")


def shards(docs: DataFrame, old: Column, count: int = SHARDS) -> DataFrame:
    """Every document's new shard by bytes, its place there, size and checksum, and the shard it comes from.

    A document weighs the UTF-8 bytes of its text and one more; a null text has none and checksum 0.
    `old` gives its present shard, from 0. Sizes of new shards are equal up to about a thousandth, or, in small
    tables, as far as single documents allow. Null doc_ids and repeated rows are rows like others; equal
    texts may be parted. Which of two blocks of one size moves is settled by where they were read, so the
    places depend on how the table is split; other columns may have any name; an empty table gives no rows.
    """
    run = Run(docs.sparkSession, "shards")
    text = F.col("text").cast("string")
    rows = run.keep(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), old.cast("int").alias("old"), F.monotonically_increasing_id().alias("ident"),
    ))
    placed = moves(rows, count)
    # Rows of one shard are numbered in stretches as they were read, at most 2^20 rows each.
    slots = numbered(placed, ["shard"], [F.col("ident")], [F.shiftright("ident", 20)], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") - 1).cast("long").alias("slot"),
                        F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))


def by_source(count: int = SHARDS) -> Column:
    """A layout to start from: whole sources a shard, uneven where one source is large."""
    return F.pmod(F.xxhash64(F.col("source").cast("string")), F.lit(count)).cast("int")


def reshard_files(spark: SparkSession, folder: str, room: list[int] | int, size: Column, cost: list[list[int]] | None = None) -> list[int]:
    """Move rows between the `shard=<i>` folders of a Parquet table and return the shards that were rewritten.

    Only shards that lose or gain rows are read in full and written again: first to the shared run
    folder, then over their old files, so that an interrupted call can be repeated from that copy. A row is
    named by its file and its place there. `size` is a row's weight.
    """
    table = spark.read.parquet(folder)
    ident = F.xxhash64("_metadata.file_path", "_metadata.row_index").bitwiseAND(F.lit((1 << 63) - 1))
    rows = table.select("*", ident.alias("ident"), F.col("shard").cast("int").alias("old"), size.cast("long").alias("size"))
    planned = moves(rows.drop("shard"), room, cost)
    changes = planned.filter("old <> shard").select(F.explode(F.array("old", "shard")).alias("shard")).distinct().orderBy("shard")
    changed = [r[0] for r in changes.collect()]
    if changed:
        touched = planned.filter(F.col("old").isin(changed)).select(*[c for c in table.columns if c != "shard"], "shard")
        staged = Run(spark, "reshard").keep(touched)
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(folder)
        filled = {r[0] for r in staged.select("shard").distinct().collect()}
        for gone in set(changed) - filled:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/shard={gone}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return changed
