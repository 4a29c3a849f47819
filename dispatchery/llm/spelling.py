"""Spelling variants: words one edit apart, found with a bit-sliced position index.

The index of a bucket of words holds a bitset over the bucket for every (position, letter). A query
walks its letters and keeps, for all words of the bucket at once, the set that agrees so far and the
sets with one error: replaced (same position), inserted and deleted (position shifted by one).

Words meet by length class and by shared ends. A class m holds the words of m and of m + 1 code
points, and finds the pairs whose shorter word has m. One edit inside the window [lo, hi) leaves the
code points before and behind it alone, so a group of words that agree outside the window is cut,
where it is too large, into those that also agree in the window's first half and those that agree
in its second half. A pair agreeing in both belongs to the first. A window of one code point
ends this with groups of at most a few hundred words, so no vocabulary makes a group large.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchery.llm.runs import Run

#: Words a group, and on average a bucket of groups, may hold.
LIMIT = 4096
#: Queries taken at once; their sets take BLOCK * words / 8 bytes each.
BLOCK = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z, all else as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def vocabulary(docs: DataFrame, letters: int = 6, least: int = 5, slip: int = 199) -> DataFrame:
    """(word, n): words of at least `letters` code points with their occurrences, from `least` on.

    Runs of letters are lower-cased (A-Z only); a run loses one code point where `slip` divides the
    CRC-32 of `<doc_id>:<run>`. A null text has no runs, a null doc_id is written as nothing.
    Occurrences are summed before they are shuffled.
    """
    pattern = f"[A-Za-zÀ-ÿ]{{{letters},}}"
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"),
        F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(pattern), F.lit(0))).alias("run"),
    ).select("i", lower_ascii(F.col("run")).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("i", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _group(words: DataFrame) -> DataFrame:
    """`words` with `g`, a hash of the class, the window and what lies outside it."""
    return words.withColumn("g", F.xxhash64("m", "lo", "hi", F.expr("left(word, lo)"), F.expr("right(word, m - hi)")))


def groups(run: Run, words: DataFrame, letters: int = 6, limit: int = LIMIT) -> DataFrame:
    """(word, n, m, lo, hi, g): every word in groups of at most about `limit` words that hold all its near words between them.

    Only the names of too large groups are sent to all tasks: there is at most one for `limit` words.
    """
    size = F.length("word")
    classes = words.select("word", "n", F.explode(F.filter(F.array(size - 1, size), lambda m: m >= letters)).alias("m"))
    frontier, done = classes.select("*", F.lit(0).alias("lo"), F.col("m").alias("hi")), []
    while True:
        frontier = run.keep(_group(frontier))
        large = run.keep(frontier.filter("hi - lo > 1").groupBy("g").agg(F.count(F.lit(1)).alias("_words")).filter(F.col("_words") > limit).select("g"))
        if large.isEmpty():
            done.append(frontier)
            break
        marked = run.keep(frontier.join(F.broadcast(large.withColumn("_large", F.lit(True))), "g", "left"))
        done.append(marked.filter("_large IS NULL").drop("_large").select(frontier.columns))
        middle = F.expr("lo + (hi - lo) div 2").cast("int")
        halves = F.array(F.struct(middle.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), middle.alias("hi")))
        frontier = marked.filter("_large").select("word", "n", "m", F.explode(halves).alias("h")).select("word", "n", "m", "h.lo", "h.hi")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


class Index:
    """Bitsets over a bucket of words of `m` and `m` + 1 letters, one for every (position, letter)."""

    def __init__(self, words: list[str], m: int):
        self.count, self.m = len(words), m
        self.width = (self.count + 63) // 64
        self.lengths = np.array([len(w) for w in words])
        flat = np.frombuffer("".join(w.ljust(m + 1, "\0") for w in words).encode("utf-32-le"), "<u4").reshape(self.count, m + 1)
        self.codes = np.ascontiguousarray(flat.T)
        self.letters, self.slices = [], []
        for column in self.codes:
            letters = np.unique(column)
            # The last row is empty: a letter that no word has at this position.
            self.letters.append(letters)
            self.slices.append(np.vstack([self.bits(column == c) for c in letters] + [np.zeros(self.width, "<u8")]))
        self.short, self.long = self.bits(self.lengths == m), self.bits(self.lengths == m + 1)

    def bits(self, mask: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width * 8, "u1")
        packed = np.packbits(mask, bitorder="little")
        out[: len(packed)] = packed
        return out.view("<u8")

    def holding(self, position: int, codes: np.ndarray) -> np.ndarray:
        """Words with the given letters at `position`, a bitset a letter."""
        if not 0 <= position <= self.m:
            return np.zeros((len(codes), self.width), "<u8")
        letters = self.letters[position]
        at = np.minimum(np.searchsorted(letters, codes), len(letters) - 1)
        return self.slices[position][np.where(letters[at] == codes, at, len(letters))]

    def near(self, queries: np.ndarray, hi: int) -> np.ndarray:
        """One bitset a query: words of this class one edit away whose first `hi` letters are not all the query's, where `hi` < m.

        The queries are places of words in the bucket, all of one length.
        """
        length, m = int(self.lengths[queries[0]]), self.m
        shape = (len(queries), self.width)
        same = np.full(shape, np.uint64(0xFFFFFFFFFFFFFFFF))
        other, longer, shorter, head = np.zeros(shape, "<u8"), np.zeros(shape, "<u8"), np.zeros(shape, "<u8"), None
        for i in range(length):
            codes = self.codes[i][queries]
            here = self.holding(i, codes)
            if length == m:
                other = (other & here) | (same & ~here)
                longer = (longer | same) & self.holding(i + 1, codes)
            else:
                shorter = (shorter & self.holding(i - 1, codes)) | same
            same &= here
            if i + 1 == hi:
                head = same.copy()
        found = ((other & self.short) | ((longer | same) & self.long)) if length == m else (shorter & self.short)
        return found & ~head if hi < m and head is not None else found


def link(words: pd.DataFrame) -> pd.DataFrame:
    """What the groups of one bucket tell of their words: (word, n_near, form, form_n), words without a near word left out."""
    words = words.sort_values(["n", "word"], ascending=[False, True], kind="stable").reset_index(drop=True)
    m, texts = int(words["m"].iloc[0]), words["word"].tolist()
    index, counts = Index(texts, m), words["n"].to_numpy()
    names: dict[tuple, int] = {}
    shared = [(lo, hi, w[:lo], w[len(w) - (m - hi) :]) for w, lo, hi in zip(texts, words["lo"], words["hi"])]
    member = np.array([names.setdefault(key, len(names)) for key in shared])
    masks = np.vstack([index.bits(member == g) for g in range(len(names))]) if len(names) <= index.count // 8 + 64 else None
    his = words["hi"].to_numpy()
    out = []
    for hi in np.unique(his):
        for length in (m, m + 1):
            chosen = np.flatnonzero((his == hi) & (index.lengths == length))
            for start in range(0, len(chosen), BLOCK):
                queries = chosen[start : start + BLOCK]
                own = masks[member[queries]] if masks is not None else np.vstack([index.bits(member == g) for g in member[queries]])
                found = index.near(queries, int(hi)) & own
                n_near = np.bitwise_count(found).sum(axis=1)
                for q in np.flatnonzero(n_near):
                    # Words are in order of falling n, then of code points: the first one found is the form.
                    at = int(np.flatnonzero(found[q])[0])
                    word = int(found[q, at])
                    first = at * 64 + (word & -word).bit_length() - 1
                    out.append((texts[queries[q]], int(n_near[q]), texts[first], int(counts[first])))
    return pd.DataFrame(out, columns=["word", "n_near", "form", "form_n"])


LINKS = "word string, n_near long, form string, form_n long"


def links(run: Run, words: DataFrame, letters: int = 6, limit: int = LIMIT) -> DataFrame:
    """(word, n_near, form, form_n): how many words are near, and of these the most frequent, ties the first in code-point order."""
    grouped = groups(run, words, letters, limit)
    buckets = grouped.groupBy("m").agg(F.ceil(F.count(F.lit(1)) / F.lit(limit)).alias("_buckets"))
    # One row a length: k lengths need some k * k letters of text, so this stays small.
    dealt = grouped.join(F.broadcast(buckets), "m").withColumn("bucket", F.pmod("g", F.col("_buckets"))).select("word", "n", "m", "lo", "hi", "bucket")
    parts = dealt.groupBy("m", "bucket").applyInPandas(link, LINKS)
    best = F.min_by(F.struct("form", "form_n"), F.struct(-F.col("form_n"), F.col("form")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.form", "best.form_n")


def roots(run: Run, forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last word of the chain of forms.

    Chains are halved a round: each word's goal becomes its goal's goal. A form has several times its word's n, so a
    chain has no circle and its length grows with the logarithm of the largest n.
    """
    goals = run.keep(forms.select("word", F.col("form").alias("root")))
    while True:
        step = goals.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = run.keep(goals.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        goals = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            return goals


def variants(docs: DataFrame, letters: int = 6, least: int = 5, factor: int = 5, slip: int = 199) -> DataFrame:
    """Every word of the vocabulary with its form, the root of its chain of forms, its count and those of its near words.

    A null text counts as none, an empty one has no words, repeated rows count as often as they stand
    there, a null doc_id is written as nothing in the hash; equal counts go by code points. Only doc_id
    and text are read, so other columns may have any name. An empty table gives no rows.
    """
    run = Run(docs.sparkSession, "spelling")
    words = run.keep(vocabulary(docs, letters, least, slip))
    near = links(run, words, letters)
    known = run.keep(words.join(near, "word", "left"))
    takes = F.col("form_n") >= factor * F.col("n")
    chosen = known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("form")).alias("form"), F.when(takes, F.col("form_n")).alias("form_n"))
    ends = roots(run, chosen.filter("form IS NOT NULL"))
    return chosen.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
