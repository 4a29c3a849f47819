"""Sharding, spelling variants and the Merkle manifest against plain Python, on given rows and on awkward ones."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, node string, word string, at int"


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(5)
    base = ["variant", "Überraschung", "spelling", "Häufigkeit"]
    texts = [None, "", " ", "one", "variant " * 3000, "\U0001f600 Überraschung-spelling" * 50, "x" * 70000, "spelling " * 7, "spelling " * 7]
    for _ in range(200):
        w = rng.choice(base)
        i, kind = rng.randrange(len(w)), rng.randrange(4)
        c = rng.choice("aeéßX")
        texts.append(" ".join([[w, w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]][kind]] * rng.randrange(1, 9)))
    rows = [(i if i % 9 else None, t, ["en", None, "de", "", "é"][i % 5] if i > 3 else "lone", None if i % 4 else "s", None if i % 6 == 0 else len(t or ""), "x", "y", "z", 1)
            for i, t in enumerate(texts)]
    rows += rows[40:60] * 3 + [(7, "same", "en", "s", 2**63 - 1, "x", "y", "z", 1)] * 40
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def plain_rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# Merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(nodes):
    """(root, siblings of every leaf in order with their side)."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, p in enumerate(places):
            if p ^ 1 < len(nodes):
                paths[leaf].append((nodes[p ^ 1], p % 2))
            else:
                paths[leaf].append(None)
        nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        places = [p // 2 for p in places]
    return nodes[0], paths


def manifest_of(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    marked = []
    for r in rows:
        hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        marked.append((r[0], r[2], leaf_of(r), leaf_of((*r[:3], r[3] + 1, r[4])) if hit else leaf_of(r)))
    langs = sorted({m[1] for m in marked}, key=lambda x: (x is not None, (x or "").encode()))
    per = {x: sorted((m for m in marked if m[1] == x), key=lambda m: (m[0] is not None, m[0] or 0, m[2])) for x in langs}
    trees = {x: tree_of([m[2] for m in ms]) for x, ms in per.items()}
    root, upper = tree_of([trees[x][0] for x in langs])
    out = []
    for x, above in zip(langs, upper):
        for m, path in zip(per[x], trees[x][1]):
            node = m[3]
            for step in path + above:
                node = sha(node) if step is None else sha(step[0], node) if step[1] else sha(node, step[0])
            out.append((m[0], m[2], trees[x][0], root, sha(*(s[0] for s in path + above if s)), node, node == root))
    return out


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("which", ["awkward", "given"])
def test_manifest(which, request):
    from dispatchery.llm.merkle import manifest

    df = request.getfixturevalue(which)
    got = plain_rows(manifest(df), *MANIFEST)
    want = manifest_of(plain_rows(df, "doc_id", "source", "lang", "n_chars", "text"))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    from dispatchery.llm.merkle import manifest

    rows = spark.createDataFrame([(1, "t", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = manifest(rows).first()
    leaf = leaf_of((1, None, None, None, "t"))
    assert (got.leaf, got.subroot, got.root, got.folded_root, got.proof_sha256, got.verified) == (leaf,) * 4 + (sha(), True)
    empty = manifest(rows.filter("false"))
    assert empty.columns == list(MANIFEST) and empty.count() == 0


# Spelling


def cut_word(doc_id, run):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
    return low if h % 199 else low[: h % len(low)] + low[h % len(low) + 1 :]


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_of(rows):
    n = Counter()
    for doc_id, text in rows:
        n.update(cut_word(doc_id, m) for m in re.findall("[A-Za-zÀ-ÿ]+", text or ""))
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if n[b] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return [(w, form.get(w), root(w), c, len(near[w]), n[form[w]] if w in form else None) for w, c in n.items()]


@pytest.mark.parametrize("which", ["awkward", "given"])
def test_variants(which, request):
    from dispatchery.llm.spelling import variants

    df = request.getfixturevalue(which)
    got = plain_rows(variants(df), "word", "form", "root", "n", "n_near", "form_n")
    want = variants_of(plain_rows(df, "doc_id", "text"))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[1] for r in got)


@pytest.mark.parametrize("limit", [3, 40])
def test_links_of_groups_cut_small(spark, limit):
    """Groups of a few words are cut down to windows of one letter and lose no pair and count none twice."""
    from dispatchery.llm.runs import Run
    from dispatchery.llm.spelling import links

    rng = random.Random(limit)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice([6, 6, 7, 7, 8]))) for _ in range(260)} | {"a" * 6, "a" * 7, "a" * 8, "b" * 900, "b" * 901, "b" * 450 + "c" + "b" * 450}
    n = {w: rng.randrange(5, 9) for w in words}
    got = links(Run(spark, "t"), spark.createDataFrame(list(n.items()), "word string, n long"), limit=limit).collect()
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    want = {w: (len(v), min(v, key=lambda x: (-n[x], x))) for w, v in near.items() if v}
    assert {r.word: (r.n_near, r.form) for r in got} == want and len(got) == len(want)


def test_roots_follow_chains(spark):
    from dispatchery.llm.runs import Run
    from dispatchery.llm.spelling import roots

    chain = [(str(i), str(i + 1)) for i in range(13)] + [("x", "5")]
    got = {r.word: r.root for r in roots(Run(spark, "t"), spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "13" for w, _ in chain}


# Sharding


def cost_of(flow, cost):
    return int(sum(flow[i][j] * cost[i][j] for i in range(len(cost)) for j in range(len(cost[0]))))


def best_cost(supply, room, cost):
    """The least cost over all integer plans, row by row."""
    if not supply:
        return 0
    options = []
    for split in itertools.product(*(range(min(supply[0], r) + 1) for r in room)):
        if sum(split) == supply[0]:
            options.append(sum(s * c for s, c in zip(split, cost[0])) + best_cost(supply[1:], [r - s for r, s in zip(room, split)], cost[1:]))
    return min(options, default=10**9)


def test_flow_is_cheapest():
    from dispatchery.llm.sharding import cheapest_flow

    rng = random.Random(11)
    for _ in range(60):
        m, n = rng.randrange(1, 4), rng.randrange(1, 4)
        supply = [rng.randrange(5) for _ in range(m)]
        room = [0] * n
        for _ in range(sum(supply)):
            room[rng.randrange(n)] += 1
        cost = [[rng.randrange(6) for _ in range(n)] for _ in range(m)]
        flow = cheapest_flow(supply, room, cost)
        assert [sum(r) for r in flow] == supply and [sum(c) for c in zip(*flow)] == room and (flow >= 0).all()
        assert cost_of(flow, cost) == best_cost(supply, room, cost)
    free = cheapest_flow([10, 0, 5], [5, 5, 5])
    assert free[0][0] == 5 and free[2][2] == 5 and free[0][1] == 5
    with pytest.raises(ValueError):
        cheapest_flow([1], [2])


@pytest.mark.parametrize("which", ["awkward", "given"])
def test_shards(which, request):
    from dispatchery.llm.sharding import by_source, shards

    df = request.getfixturevalue(which)
    got = shards(df, by_source()).collect()
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in plain_rows(df, "doc_id", "text")]
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == sorted(want, key=repr)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    total, load = sum(w[1] for w in want), Counter()
    for r in got:
        load[r.shard] += r["size"]
        assert 0 <= r.shard < 8
    for s in load:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    # Documents larger than a shard's share have one to themselves; the others share what is left evenly.
    huge = sum(w[1] > total / 8 for w in want)
    rest = sorted(load.values())[: 8 - huge]
    assert max(rest) - min(rest) <= (20 if which == "awkward" else total / 8 * 0.02)


def test_few_bytes_move(given):
    """What moves is the flow's least amount, but for a block a shard."""
    from dispatchery.llm.sharding import by_source, shards

    got = shards(given, by_source()).collect()
    old = Counter()
    for r in got:
        old[r.old_shard] += r["size"]
    total = sum(old.values())
    least = sum(max(old[i] - total // 8, 0) for i in range(8))
    assert sum(r["size"] for r in got if r.shard != r.old_shard) <= least + 8 * max(r["size"] for r in got)


def test_equal_rows_spread(spark):
    from dispatchery.llm.sharding import shards

    rows = spark.createDataFrame([(1, "copy")] * 4000 + [(None, None)] * 800, "doc_id long, text string").repartition(4)
    got = shards(rows, F.lit(3)).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(got) == 8 and max(r.b for r in got) - min(r.b for r in got) <= 5
    assert shards(rows.filter("false"), F.lit(0)).count() == 0


def test_files_are_rewritten_where_affected(spark, tmp_path):
    from dispatchery.llm.sharding import reshard_files

    folder = str(tmp_path / "table")
    rows = spark.range(3000).select("id", F.concat(F.lit("v"), "id").alias("v"), F.when(F.col("id") < 2000, 0).when(F.col("id") < 2100, 1).when(F.col("id") < 2750, 2).otherwise(3).alias("shard"))
    rows.write.partitionBy("shard").parquet(folder)
    kept = {p.name for p in (tmp_path / "table" / "shard=2").glob("*.parquet")}
    changed = reshard_files(spark, folder, [1500, 850, 650, 0], F.lit(1))
    after = {r["id"]: r["shard"] for r in spark.read.parquet(folder).collect()}
    assert changed == [0, 1, 3] and kept == {p.name for p in (tmp_path / "table" / "shard=2").glob("*.parquet")}
    assert len(after) == 3000 and Counter(after.values()) == {0: 1500, 1: 850, 2: 650}
    assert sum(after[i] == 0 for i in range(2000)) == 1500 and all(after[i] == 1 for i in range(2000, 2100))
    assert not (tmp_path / "table" / "shard=3").exists()
    assert reshard_files(spark, folder, [1500, 850, 650], F.lit(1)) == []


def test_place_levels_without_losing_blocks():
    from dispatchery.llm.sharding import capacities, cheapest_flow, place

    rng = np.random.default_rng(3)
    sizes, old = rng.integers(1, 400, 900), rng.integers(0, 3, 900)
    room = capacities(int(sizes.sum()), 5)
    supply = [int(sizes[old == i].sum()) for i in range(3)]
    target = place(old, sizes, cheapest_flow(supply, room), room)
    load = np.bincount(target, weights=sizes, minlength=5)
    assert load.sum() == sizes.sum() and load.max() - load.min() <= 2
