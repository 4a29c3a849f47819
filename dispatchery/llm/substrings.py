"""Removal of repeated substrings by super-k-mers.

Every window of words has a minimiser, the run of words with the least hash inside it. Consecutive
windows with the same minimiser travel as one packed string to the minimiser's bucket, where
sorting the windows of equal minimisers counts them exactly. Places of repeated windows go back to
their texts. Equal strings of a task travel once, with a weight; a minimiser of very many strings
sends single windows to buckets of their own hash instead, so no bucket holds a large share.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchery.llm.words import Words, chunks, gram_hashes

WINDOW, MINIMISER = 35, 5
#: Bytes of text a bucket stands for, counters of frequent minimisers a task keeps, bytes of packed strings a task holds before it sends them.
BUCKET_BYTES, COUNTERS, FLUSH_BYTES = 1 << 21, 1024, 1 << 25
#: A minimiser of more runs than this, and than a quarter of a bucket's share, sends single windows.
FREQUENT = 200
_LOW = np.uint64(0xFFFFFFFF)


class Runs:
    """Super-k-mers of a list of texts: first and last window, minimiser, and its distance in words from the first window."""

    def __init__(self, words: Words, window: int = WINDOW, size: int = MINIMISER):
        n = len(words)
        many = n - size + 1
        self.first = np.zeros(0, np.int64)
        self.last, self.mini = self.first, np.zeros(0, np.uint64)
        if n < window:
            return
        mers = gram_hashes(words.hashes(), size, np.arange(many))
        # Upper half hash, lower half place, so the least is the leftmost of equal hashes.
        ranked = (mers & ~_LOW) | np.arange(many, dtype=np.uint64)
        span, reach, least = window - size + 1, 1, ranked
        while 2 * reach <= span:
            least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
        least = np.minimum(least[: many - span + 1], least[span - reach : span - reach + many - span + 1])
        place = (least & _LOW).astype(np.int64)
        starts = np.flatnonzero(words.text[: n - window + 1] == words.text[window - 1 :])
        if not len(starts):
            return
        begins = np.ones(len(starts), bool)
        begins[1:] = (place[starts[1:]] != place[starts[:-1]]) | (starts[1:] != starts[:-1] + 1)
        edge = np.flatnonzero(begins)
        self.first, self.last = starts[edge], starts[np.append(edge[1:], len(starts)) - 1]
        self.mini = mers[place[self.first]]


def packed(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of the buffer joined by single spaces, and where each begins and ends there."""
    sizes = words.ends - words.starts
    ends = np.cumsum(sizes + 1) - 1
    return b" ".join(words.raw.split()), ends - sizes, ends


def frequent(docs: DataFrame, window: int, size: int) -> DataFrame:
    """(mini, n): counters of frequent minimisers by task, and under null the number of runs; a count is short by at most runs / COUNTERS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            for _, held in chunks(batch.column(0).to_pylist()):
                mini = Runs(Words(held), window, size).mini
                total += len(mini)
                keys, back = np.unique(np.concatenate((keys, mini)), return_inverse=True)
                counts = np.bincount(back, np.concatenate((counts, np.ones(len(mini), np.int64))), len(keys)).astype(np.int64)
                if len(keys) > COUNTERS:
                    counts = counts - np.partition(counts, -COUNTERS - 1)[-COUNTERS - 1]
                    keys, counts = keys[counts > 0], counts[counts > 0]
        yield pa.RecordBatch.from_arrays([pa.array([None, *keys.view(np.int64).tolist()], pa.int64()), pa.array([total, *counts.tolist()], pa.int64())], ["mini", "n"])

    return docs.select(F.col("text")).mapInArrow(run, "mini long, n long").groupBy("mini").agg(F.sum("n").alias("n"))


class Parcel:
    """Packed strings of a task by bucket; equal ones once, with the texts and places they come from and how many rows these texts have."""

    def __init__(self, buckets: int):
        self.buckets, self.bytes = buckets, 0
        self.held: dict[int, dict[tuple[int, bytes], list]] = defaultdict(dict)

    def add(self, group: int, text: bytes, key: bytes, start: int, weight: int) -> None:
        held = self.held[group % self.buckets]
        entry = held.get((group, text))
        if entry is None:
            entry = held[(group, text)] = []
            self.bytes += len(text) + 200
        entry.append((key, start, weight))

    def send(self) -> pa.RecordBatch:
        ids, blobs = [], []
        for bucket, held in self.held.items():
            texts = [t for _, t in held]
            at = [o for entry in held.values() for o in entry]
            parts = [
                np.array([len(texts), len(at)], "<u4"), np.array([g for g, _ in held], "<u8"), np.fromiter(map(len, texts), "<u4", len(texts)),
                np.fromiter(map(len, held.values()), "<u4", len(texts)), np.array([o[1] for o in at], "<u4"), np.array([o[2] for o in at], "<u4"),
            ]
            raw = b"".join([*(p.tobytes() for p in parts), *(o[0] for o in at), *texts])
            ids.append(bucket)
            blobs.append(len(raw).to_bytes(4, "little") + pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True))
        self.held.clear()
        self.bytes = 0
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def unpacked(blob: bytes) -> Iterator[tuple[int, bytes, list[tuple[bytes, int]], int]]:
    """(group, packed string, its places, its weight) of each entry."""
    raw = pa.decompress(blob[4:], int.from_bytes(blob[:4], "little"), "zstd", asbytes=True)
    n, m = np.frombuffer(raw, "<u4", 2)
    at = 8
    arrays = []
    for kind, count in (("<u8", n), ("<u4", n), ("<u4", n), ("<u4", m), ("<u4", m)):
        arrays.append(np.frombuffer(raw, kind, count, at).tolist())
        at += int(count) * int(kind[2:])
    groups, sizes, many, starts, weights = arrays
    keys, at, seen = at, at + 16 * int(m), 0
    for group, size, count in zip(groups, sizes, many):
        places = [(raw[keys + 16 * i : keys + 16 * i + 16], starts[i]) for i in range(seen, seen + count)]
        yield group, raw[at : at + size], places, sum(weights[seen : seen + count])
        at, seen = at + size, seen + count


def repeated(entries: list[tuple[bytes, list, int]], window: int) -> Iterator[tuple[list, int, int]]:
    """Of the strings of one minimiser: (places, first, last) of each stretch of windows that occur twice or more."""
    ranked = []
    for e, (text, _, _) in enumerate(entries):
        edges = [-1, *(i for i, c in enumerate(text) if c == 32), len(text)]
        ranked += [(text[edges[i] + 1 : edges[i + window]], e, i) for i in range(len(edges) - window)]
    ranked.sort()
    found: dict[int, list[int]] = defaultdict(list)
    i = 0
    while i < len(ranked):
        j, weight = i, 0
        while j < len(ranked) and ranked[j][0] == ranked[i][0]:
            weight += entries[ranked[j][1]][2]
            j += 1
        if weight > 1:
            for _, e, at in ranked[i:j]:
                found[e].append(at)
        i = j
    for e, places in found.items():
        places.sort()
        first = last = places[0]
        for at in [*places[1:], -1]:
            if at != last + 1:
                yield entries[e][1], first, last
                first = at
            last = at


def repeated_ranges(docs: DataFrame, window: int = WINDOW, size: int = MINIMISER) -> DataFrame:
    """(key, ranges): for each text, named by the md5 of its bytes, the word ranges [first, end) that repeated windows cover."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    length = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), length // BUCKET_BYTES)
    counted = frequent(texts, window, size).cache()
    total = counted.where(F.col("mini").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # At most 4 * buckets minimisers can be that frequent, so the list is bounded.
    hot = max(FREQUENT, total // (4 * buckets))
    split = np.sort(np.array([r[0] for r in counted.where(F.col("mini").isNotNull() & (F.col("n") > hot)).select("mini").collect()], np.int64).view(np.uint64))
    counted.unpersist()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parcel = Parcel(buckets)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, held in chunks(batch.column(1).to_pylist()):
                # Equal texts of a chunk are packed once, with their number as weight.
                weights: dict[bytes, int] = defaultdict(int)
                own: dict[bytes, bytes] = {}
                for key, text in zip(keys[first : first + len(held)], held):
                    weights[key] += 1
                    own[key] = text
                names = list(own)
                words = Words(list(own.values()))
                line, begin, end = packed(words)
                runs = Runs(words, window, size)
                alone = np.isin(runs.mini, split)
                owner = words.text[runs.first]
                for a, b, mini, text, single in zip(runs.first.tolist(), runs.last.tolist(), runs.mini.tolist(), owner.tolist(), alone.tolist()):
                    start, key = a - int(words.first[text]), names[text]
                    if not single:
                        parcel.add(mini, line[begin[a] : end[b + window - 1]], key, start, weights[key])
                        continue
                    for i in range(a, b + 1):
                        string = line[begin[i] : end[i + window - 1]]
                        group = int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little")
                        parcel.add(group, string, key, start + i - a, weights[key])
                if parcel.bytes > FLUSH_BYTES:
                    yield parcel.send()
        yield parcel.send()

    def count(group: pd.DataFrame) -> pd.DataFrame:
        together: dict[int, list] = defaultdict(list)
        for blob in group["blob"]:
            for mini, text, places, weight in unpacked(blob):
                together[mini].append((text, places, weight))
        keys, firsts, ends = [], [], []
        for entries in together.values():
            if sum(e[2] for e in entries) < 2:
                continue
            for places, first, last in repeated(entries, window):
                for key, start in places:
                    keys.append(key), firsts.append(start + first), ends.append(start + last + window)
        return pd.DataFrame({"key": keys, "first": firsts, "end": ends})

    sent = texts.select(F.unhex(F.md5("text")).alias("key"), "text").mapInArrow(pack, "bucket long, blob binary")
    ranges = sent.groupBy("bucket").applyInPandas(count, "key binary, first int, end int")
    return ranges.groupBy("key").agg(F.collect_set(F.struct("first", "end")).alias("ranges"))


def drop_repeats(docs: DataFrame, window: int = WINDOW, size: int = MINIMISER) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every document, one row each.

    A null text has no words. Texts of fewer words than a window lose nothing. A null doc_id stays
    null; repeated rows are documents of their own, so their windows count as repeated; other
    columns are ignored, an empty table gives no rows.
    """
    ranges = repeated_ranges(docs, window, size)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2).to_pylist()
            for first, held in chunks(batch.column(1).to_pylist()):
                many, gone, kept = [], [], []
                for text, spans in zip(held, found[first : first + len(held)]):
                    words = text.split()
                    many.append(len(words))
                    if spans:
                        stay = np.ones(len(words), bool)
                        for span in spans:
                            stay[span["first"] : span["end"]] = False
                        words = [words[i] for i in np.flatnonzero(stay)]
                    gone.append(many[-1] - len(words))
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), pa.array(many, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    joined = rows.join(ranges, "key", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def digests(docs: DataFrame) -> DataFrame:
    """Per document: words, words removed, digest of the words kept."""
    return drop_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
