"""Benchmark decontamination by spaced seeds.

Fixed masks hash some tokens of every window and ignore the others, so a seed survives
substitutions. Seeds of the documents meet those of the benchmark in a hash join, and along the
diagonal of each hit both texts are compared token by token. The masks together are hit by every
overlap that counts. Column expressions only; the benchmark is broadcast in blocks of bounded size,
so documents aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 1: the token at this place is hashed, 0: it is ignored.
#: Any 13, 15, 20 or 25 tokens with a fifth of them (rounded down) substituted anywhere are hit by one of these, and all that overlaps holds such a run.
MASKS = ("1011010001", "10010110001", "110111")
#: Aligned tokens an overlap needs (the whole item, if that is shorter), and the share of them that must be equal.
LEAST_TOKENS, LEAST_SHARE = 13, 0.8
#: Benchmark tokens broadcast at once; a larger benchmark takes more rounds.
BLOCK_TOKENS = 40_000
#: Places that are exploded together.
SEGMENT = 64
#: Equal tokens that a token which differs needs in a stretch: a share of LEAST_SHARE, in whole numbers.
PRICE = round(LEAST_SHARE / (1 - LEAST_SHARE))


def tokens(text: Column) -> Column:
    """64-bit hashes of a text's tokens: lower-cased runs of letters and digits."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda t: t != ""), lambda t: F.xxhash64(t))


def mask_of(size: int) -> str:
    """The mask of an item shorter than LEAST_TOKENS: the run of equal tokens that is left wherever its substitutions stand."""
    swaps = size // (PRICE + 1)
    return "1" * -(-(size - swaps) // (swaps + 1))


def _seed(mask: str, mark: int, h: Column, at: Column) -> Column:
    picked = [F.get(h, at + k) for k, c in enumerate(mask) if c == "1"]
    return F.when(at + len(mask) <= F.size(h), F.xxhash64(F.lit(mark), *picked))


def segments(h: Column, widest: int) -> Column:
    """The token array in runs of SEGMENT, each with the tokens behind it that a mask at its last place needs."""
    reach = SEGMENT + widest - 1
    run = lambda i: F.transform(F.sequence(i, F.least(i + reach, F.size(h)) - 1), lambda j: F.get(h, j))
    return F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), F.size(h) - 1, F.lit(SEGMENT)), run))


def seeded(texts: DataFrame, column: str, keys: list[str], place: str, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """A row for each place of the token array and mask that fits there: keys, `place`, __mask and __seed.

    An exploded row copies what it carries, so places are exploded within short segments; and their
    seeds are made after that, where Spark generates code for them.
    """
    runs = texts.select(*keys, F.posexplode(segments(F.col(column), max(map(len, masks)))).alias("__run", "__part"))
    at = runs.select("*", F.explode(F.sequence(F.lit(0), F.least(F.size("__part"), F.lit(SEGMENT)) - 1)).alias("__in"))
    made = F.array(*(_seed(mask, m, F.col("__part"), F.col("__in")) for m, mask in enumerate(masks)))
    rows = at.select(*keys, (F.col("__run") * SEGMENT + F.col("__in")).alias(place), made.alias("__made"))
    return rows.select(*keys, place, F.posexplode("__made").alias("__mask", "__seed")).where(F.col("__seed").isNotNull())


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _overlaps(equal: Column, need: Column) -> Column:
    """Whether `need` or more neighbouring places have a share of LEAST_SHARE equal, in one pass."""
    worth = lambda i: F.when(F.get(equal, i), 1).otherwise(-PRICE)
    first = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("before"), F.lit(0).alias("low"), F.lit(False).alias("good"))

    def step(a: Column, j: Column) -> Column:
        total = a["sum"] + worth(j - 1)
        before = a["before"] + F.when(j > need, worth(j - need - 1)).otherwise(0)
        low = F.least(a["low"], before)
        return F.struct(total.alias("sum"), before.alias("before"), low.alias("low"), (a["good"] | ((j >= need) & (total >= low))).alias("good"))

    return F.aggregate(F.sequence(F.lit(1), F.size(equal)), first, step, lambda a: a["good"])


def _longest(equal: Column) -> Column:
    """The longest stretch with a share of LEAST_SHARE equal, the first of several: struct<length, equal, back>, back being less its start.

    Such a stretch starts at 0 or after a place that differs and ends before one or at the end.
    """

    def among(differ: Column) -> Column:
        start = lambda a: F.when(a == 0, 0).otherwise(F.get(differ, a - 1) + 1)
        end = lambda b: F.coalesce(F.get(differ, b), F.size(equal))

        def upto(b: Column) -> Column:
            fits = F.filter(F.sequence(F.lit(0), b), lambda a: end(b) - start(a) >= (PRICE + 1) * (b - a))
            return _let(F.get(fits, 0), lambda a: F.struct((end(b) - start(a)).alias("length"), (end(b) - start(a) - b + a).alias("equal"), (-start(a)).alias("back")))

        return F.array_max(F.transform(F.sequence(F.lit(0), F.size(differ)), upto))

    return _let(F.filter(F.sequence(F.lit(0), F.size(equal) - 1), lambda i: ~F.get(equal, i)), among)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash that tells texts of one doc_id apart, and the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("__hash"), text.alias("__text"))


def overlaps(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Verified overlaps as (doc_id, __hash, item_id, start, length, equal): place, aligned tokens and equal tokens in the document.

    An overlap is a stretch of LEAST_TOKENS or more aligned tokens (of a shorter item, the whole of
    it) of which LEAST_SHARE are equal; of each diagonal the longest is given. Seeds meet without
    their texts; only then the texts of the rows that were hit are fetched, by one join, and compared.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text").cast("string")).alias("item")).where(F.size("item") > 0).distinct()
    sizes = items.groupBy(F.least(F.size("item"), F.lit(LEAST_TOKENS)).alias("size")).agg(F.sum(F.size("item")).alias("n")).collect()
    rounds = max(1, -(-sum(r["n"] for r in sizes) // block_tokens))
    short = sorted(r["size"] for r in sizes if r["size"] < LEAST_TOKENS)
    masks = (MASKS if len(short) < len(sizes) or not short else ()) + tuple(sorted({mask_of(n) for n in short}))
    # Whether a mask is one of an item of that size.
    own = F.col("__mask").isin([m for m, mask in enumerate(masks) if mask in MASKS])
    for n in short:
        own = F.when(F.col("__size") == n, F.col("__mask") == masks.index(mask_of(n))).otherwise(own)
    rows = keyed(docs)
    spread = seeded(rows.select("doc_id", "__hash", tokens(F.col("__text")).alias("__doc")), "__doc", ["doc_id", "__hash"], "__place", masks)
    out = None
    for r in range(rounds):
        # Seeds and items of one block are what is broadcast, so block_tokens bounds it.
        block = items.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == r).withColumn("__no", F.xxhash64("item_id", "item"))
        known = seeded(block.withColumn("__size", F.size("item")), "item", ["__no", "__size"], "__start", masks).where(own)
        known = known.select("__no", "__start", F.col("__mask").alias("__by"), "__seed")
        met = spread.join(F.broadcast(known), "__seed").where(F.col("__mask") == F.col("__by"))
        hits = met.groupBy("doc_id", "__hash").agg(F.collect_set(F.struct("__no", (F.col("__place") - F.col("__start")).alias("__shift"))).alias("__hits"))
        named = hits.toDF("__id", "__key", "__hits")
        fetched = rows.join(named, rows["doc_id"].eqNullSafe(named["__id"]) & (rows["__hash"] == named["__key"]))
        # Tokens are made before the hits are exploded, once a text.
        split = fetched.select("doc_id", "__hash", tokens(F.col("__text")).alias("__doc"), "__hits")
        found = split.select("doc_id", "__hash", "__doc", F.explode("__hits").alias("__hit")).select("doc_id", "__hash", "__doc", "__hit.*")
        found = found.join(F.broadcast(block), "__no")
        doc, item, shift = F.col("__doc"), F.col("item"), F.col("__shift")
        first, need = F.greatest(F.lit(0), -shift), F.least(F.size("item"), F.lit(LEAST_TOKENS))
        last = F.least(F.size(item), F.size(doc) - shift) - 1
        equal = F.when(last - first + 1 >= need, F.transform(F.sequence(first, last), lambda i: F.get(doc, i + shift) == F.get(item, i)))
        best = F.transform(F.array(equal), lambda e: F.when(e.isNotNull() & _overlaps(e, need), _longest(e)))
        good = found.select("doc_id", "__hash", "item_id", (first + shift).alias("__at"), F.explode(F.filter(best, lambda b: b.isNotNull())).alias("__best"))
        part = good.select("doc_id", "__hash", "item_id", (F.col("__at") - F.col("__best.back")).alias("start"), F.col("__best.length").alias("length"), F.col("__best.equal").alias("equal"))
        out = part if out is None else out.union(part)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that overlap: doc_id, item_id, and the longest overlap's start, length and equal tokens.

    Texts count by tokens; a null or empty text overlaps nothing. Documents or items without an id are reported under null, repeated rows once; other
    columns are ignored; an empty table on either side gives no rows.
    """
    found = overlaps(docs, benchmark)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("equal", "length", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"), F.col("best.equal").alias("equal"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that overlap no benchmark item, with all their columns."""
    bad = overlaps(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("__hash").alias("__key")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__doc_id"), F.xxhash64(text).alias("__hash"))
    return rows.join(bad, rows["__doc_id"].eqNullSafe(bad["__id"]) & (rows["__hash"] == bad["__key"]), "left_anti").select("__row.*")
