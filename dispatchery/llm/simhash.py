"""SimHash near-duplicates with vantage points.

Fingerprints are partitioned by Hamming distance to vantage points, in one tree for each of several
equal parts of the bits; a pair within the radius is within a share of it in at least one part. The triangle
bound keeps a search out of a shard whose points are all too far away, and where a point is within that
share of a boundary it also visits the shard across it, so every pair is met in some shard. Inside a shard
the same bound, over all bits, cuts the points into rings around two pivots, and only neighbouring rings are compared.
A shard returns links to its local components' smallest members, never all its pairs; components
across shards are joined by repeated minimum labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchery.llm.runs import Run
from dispatchery.llm.words import chunks

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Distinct fingerprints a shard should hold; the number of levels of vantage points follows from it.
SHARD = 2000
#: Fingerprints the vantage points are chosen from. It bounds what the driver reads; every fingerprint is indexed.
SAMPLE = 20_000
#: Equal parts of the 64 bits, each with a tree of its own. A pair within RADIUS is within RADIUS // PARTS in one of them: with four
#: parts and a RADIUS of 3 that is 0, so boundaries have no overlap and copies stay at four however deep the trees are.
#: One tree over all bits makes 2.1, 4.4 and 9.7 copies at 16,000, 128,000 and a million random fingerprints.
PARTS = 4
#: Placed fingerprints a task should compare.
TASK = 40_000
_SLICE = 1 << 15


def fingerprint(text: bytes) -> int:
    """A bit is 1 if it is set in over half of the hashes of the text's shingles; a text without words has 0."""
    words = text.lower().split()  # of bytes: A-Z, and the six white space bytes
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))) or [b" ".join(words)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(shingles), _SLICE):
        part = shingles[i : i + _SLICE]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[Column] | None = None) -> DataFrame:
    """The rows' `keep` columns (doc_id unless given) and `fp`, the fingerprint as a signed 64-bit integer."""
    narrow = docs.select(*(keep or [F.col("doc_id").cast("long").alias("doc_id")]), F.col("text").cast("string").alias("__text"))
    schema = narrow.drop("__text").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, texts = batch.drop_columns(["__text"]), batch.column("__text").to_pylist()
            for first, held in chunks(texts):
                marks = np.fromiter(map(fingerprint, held), np.uint64, len(held)).view(np.int64)
                part = rest.slice(first, len(held))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(marks)], [*part.schema.names, "fp"])

    return narrow.mapInArrow(run, schema)


def part_of(marks: np.ndarray, part: int, parts: int) -> np.ndarray:
    """The bits of one of `parts` equal parts of each fingerprint, as numbers."""
    width = 64 // parts
    return (marks >> np.uint64(width * part)) & np.uint64((1 << width) - 1)


def vantage_points(sample: np.ndarray, levels: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and splitting distances of a full binary tree of so many levels, in heap order, from a sample."""
    points, radii = np.zeros((1 << levels) - 1, np.uint64), np.zeros((1 << levels) - 1, np.int64)
    groups = [np.sort(sample)]
    for node in range(len(points)):
        own = groups[node]
        if len(own) == 0:
            own = groups[node] = groups[(node - 1) // 2] if node else np.zeros(1, np.uint64)
        # Of a few spread members and the two distances about the median: few members near the boundary, two like halves.
        best = None
        for point in own[:: max(1, len(own) // 8)][:8]:
            distance = np.bitwise_count(own ^ point).astype(np.int64)
            for radius in (int(np.median(distance)), int(np.median(distance)) + 1):
                near = float(np.mean((distance >= radius) & (distance < radius + reach))) + abs(float(np.mean(distance < radius)) - 0.5)
                if best is None or near < best[0]:
                    best = (near, point, radius, distance < radius)
        points[node], radii[node] = best[1], best[2]
        groups += [own[best[3]], own[~best[3]]]
    return points, radii


def shards_of(
    marks: np.ndarray, trees: list[tuple[np.ndarray, np.ndarray]], levels: int, reach: int
) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) of every shard a fingerprint belongs to or visits: one tree for each part of the bits.

    Two fingerprints within RADIUS differ by at most RADIUS // parts bits in some part (the reach). In that
    part's tree, if a boundary parts them, the outer one lies less than the reach beyond it and goes to
    both sides; so some shard sees both members of every pair.
    """
    found_rows, found_nodes = [], []
    for part, (points, radii) in enumerate(trees):
        own = part_of(marks, part, len(trees))
        rows, nodes = np.arange(len(marks)), np.zeros(len(marks), np.int64)
        for _ in range(levels):
            distance = np.bitwise_count(own[rows] ^ points[nodes]).astype(np.int64)
            inner = distance < radii[nodes] + reach
            outer = distance >= radii[nodes]
            rows, nodes = np.concatenate((rows[inner], rows[outer])), np.concatenate((2 * nodes[inner] + 1, 2 * nodes[outer] + 2))
        found_rows.append(rows)
        found_nodes.append(nodes * len(trees) + part)
    return np.concatenate(found_rows), np.concatenate(found_nodes)


def local_links(marks: np.ndarray) -> np.ndarray:
    """For each of some distinct fingerprints the place of the first member of its component among them."""
    parent = np.arange(len(marks))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # Rings around a pivot: by the triangle bound a partner lies at most RADIUS rings away.
    ring = np.bitwise_count(marks ^ marks[0]).astype(np.int64) if len(marks) else np.zeros(0, np.int64)
    second = np.bitwise_count(marks ^ marks[int(np.argmax(ring))]).astype(np.int64) if len(marks) else ring
    order = np.lexsort((second, ring))
    ring, second, ranked = ring[order], second[order], marks[order]
    edges = np.searchsorted(ring, np.arange(66 + RADIUS))
    for i in range(len(ranked)):
        stop = int(edges[ring[i] + RADIUS + 1])
        ahead = slice(i + 1, stop)
        near = np.flatnonzero(np.abs(second[ahead] - second[i]) <= RADIUS) + i + 1
        near = near[np.bitwise_count(ranked[near] ^ ranked[i]) <= RADIUS]
        for j in near:
            a, b = find(int(order[i])), find(int(order[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
    return np.fromiter((find(i) for i in range(len(marks))), np.int64, len(marks))


def near_links(distinct: DataFrame, shard: int = SHARD) -> DataFrame:
    """(a, b): links that join any two of the distinct fingerprints `fp` within RADIUS, one per point and shard at most."""
    total = distinct.count()
    parts = PARTS if total > shard else 1
    # A part of so many bits is hardly cut by more levels than that; beyond them shards grow.
    levels = min(max(0, int(np.ceil(np.log2(max(1, total / shard))))), 64 // parts - 2)
    reach = RADIUS // parts
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE) if levels else distinct.limit(0)
    seen = np.array([r[0] for r in sample.collect()], np.int64).view(np.uint64)
    trees = [vantage_points(part_of(seen, part, parts), levels, reach) for part in range(parts)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(0).to_numpy(zero_copy_only=False)
            rows, nodes = shards_of(marks.view(np.uint64), trees, levels, reach)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(marks[rows])], ["shard", "fp"])

    def link(group: pd.DataFrame) -> pd.DataFrame:
        marks = np.sort(group["fp"].to_numpy())
        roots = local_links(marks.view(np.uint64))
        moved = roots != np.arange(len(marks))
        return pd.DataFrame({"a": marks[roots[moved]], "b": marks[moved]})

    placed = distinct.select("fp").mapInArrow(place, "shard long, fp long")
    tasks = 1 + total * parts // TASK
    return placed.repartition(tasks, "shard").groupBy("shard").applyInPandas(link, "a long, b long")


def components(links: DataFrame, run: Run) -> DataFrame:
    """(fp, root): the smallest member each linked point can reach. Rounds of minimum labels with a jump, until none changes."""
    edges = run.keep(links.union(links.select("b", "a")).distinct().toDF("a", "b"))
    labels = run.keep(edges.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("root")).select("fp", F.least("fp", "root").alias("root")))
    while True:
        heard = edges.join(labels.withColumnRenamed("fp", "b"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("root").alias("heard"))
        jump = labels.select(F.col("fp").alias("root"), F.col("root").alias("far"))
        step = labels.join(heard, "fp", "left").join(jump, "root", "left")
        fresh = run.keep(step.select("fp", F.least("root", "heard", "far").alias("root"), (F.least("root", "heard", "far") < F.col("root")).alias("moved")))
        run.drop(labels)
        labels = fresh.select("fp", "root")
        if fresh.where("moved").isEmpty():
            return labels


def classes(marked: DataFrame, run: Run, shard: int = SHARD) -> DataFrame:
    """(fp, root, component_id): the component of each distinct fingerprint of (doc_id, fp), and the smallest doc_id in it."""
    distinct = run.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(distinct, shard), run)
    known = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return run.keep(known.join(smallest, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """Every document's fingerprint (16 hex digits) and component_id, the smallest doc_id its links reach.

    A null or empty text has fingerprint 0 and links like any other. A document without doc_id gets
    a row too, but lends its component no id (null if there is no other). Repeated rows each get a
    row, other columns are ignored, an empty table gives no rows.
    """
    run = Run(docs.sparkSession, "simhash")
    marked = run.keep(fingerprints(docs))
    found = classes(marked, run, shard)
    return marked.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """The rows of `docs`, one of each component: that with the smallest doc_id, and of several such the one least by its fingerprint and text.

    Rows without doc_id stay only in components that have none, one for each.
    """
    run = Run(docs.sparkSession, "simhash-keep")
    marked = run.keep(fingerprints(docs, [F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("digest")]))
    found = classes(marked, run, shard)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("best")
    best = marked.join(found, "fp").groupBy("root").agg(first)
    chosen = run.keep(best.select(F.coalesce(F.col("best.doc_id").cast("string"), F.lit("none")).alias("__id"), F.col("best.digest").alias("__digest")).distinct())
    row = docs.select(
        F.struct("*").alias("__row"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("none")).alias("__id"),
        F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("__digest"),
    )
    kept = row.join(chosen, ["__id", "__digest"], "left_semi")
    return kept.groupBy("__id", "__digest").agg(F.first("__row").alias("__row")).select("__row.*")
