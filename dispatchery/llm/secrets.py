"""Secret scans: patterns of keys and assignments, and strings whose sliding windows carry too much entropy.

Column expressions only: a row is judged where it is read, nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchery.llm.spans import let, matches, merged, written

KINDS = ("assign", "access", "hex", "entropy")
#: The patterns and least lengths of the base kinds.
WORDS = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = WORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"

#: Candidate strings and their windows: a run of so many characters or more; bits that a window of so many characters
#: must reach, by the candidate's character class: hex digits, letters in both cases, and all else with a digit.
WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/=_-]{%d,}" % WINDOW
HEX_BITS, LETTER_BITS, MIXED_BITS = 3.0, 4.1, 3.9
#: Strings that look random but aren't secret: UUIDs, numbers, paths, names of joined words, alphabets and placeholders.
ALLOWED = (
    "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "^[0-9=_+/-]+$",
    "^/?[A-Za-z0-9_-]{1,15}+(?:/[A-Za-z0-9_-]{1,15}+){2,}+/?$",
    "^[A-Z]?+[a-z]++(?:[A-Z][a-z]++)*+$",
    "(?i)0123456789|abcdefghij|example|sample|dummy|placeholder|changeme|xxxx",
)


#: Counts of a window's characters are packed: so many to a long, so many bits each (a window has fewer than 32 characters).
_PACK, _BITS = 12, 5


def peak_entropy(value: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy, in bits a character, of any `window` (below 32) consecutive characters of an ASCII string.

    A character entering or leaving changes its own count alone, and with it the sum of c * log2(c).
    """
    terms = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)))
    ones = F.array(*(F.lit(1 << (_BITS * k)).cast("long") for k in range(_PACK)))
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    blank = F.array_repeat(F.lit(0).cast("long"), 128 // _PACK + 1)
    first = F.struct(blank.alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def count(counts: Column, code: Column) -> Column:
        unit = F.get(ones, code % _PACK)
        return (F.call_function("div", F.get(counts, F.call_function("div", code, F.lit(_PACK)).cast("int")), unit) % (1 << _BITS)).cast("int")

    def moved(counts: Column, code: Column, by: int) -> Column:
        unit, place = F.get(ones, code % _PACK), F.call_function("div", code, F.lit(_PACK)).cast("int")
        return F.transform(counts, lambda n, k: F.when(k == place, n + unit * by).otherwise(n))

    def step(codes: Column, a: Column, i: Column) -> Column:
        enters = F.get(codes, i)
        # What leaves goes first, so that a count is never above the window.
        less = let(F.get(codes, i - window), lambda c: let(count(a["counts"], c), lambda n: F.struct(
            moved(a["counts"], c, -1).alias("counts"), (a["sum"] - F.get(terms, n) + F.get(terms, n - 1)).alias("sum"))))
        kept = F.when(i >= window, less).otherwise(F.struct(a["counts"].alias("counts"), a["sum"].alias("sum")))

        def entered(k: Column) -> Column:
            total = let(count(k["counts"], enters), lambda n: k["sum"] - F.get(terms, n) + F.get(terms, n + 1))
            bits = F.when(i >= window - 1, F.lit(math.log2(window)) - total / window).otherwise(0.0)
            return F.struct(moved(k["counts"], enters, 1).alias("counts"), total.alias("sum"), F.greatest(a["best"], bits).alias("best"))

        return let(kept, entered)

    return let(codes, lambda c: F.aggregate(F.sequence(F.lit(0), F.size(c) - 1), first, lambda a, i: step(c, a, i), lambda a: a["best"]))


def base_spans(text: Column) -> list[Column]:
    assigned = matches(text, ASSIGN, text.rlike(WORDS))
    return [
        F.filter(assigned, lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= ASSIGN_LEAST),
        matches(text, ACCESS, text.contains("AKIA")),
        matches(text, HEX),
    ]


def entropy_spans(text: Column, base: Column) -> Column:
    """Candidates with a window above their class's bits that aren't allowed and don't lie within a span of `base`."""

    def secret(s: Column) -> Column:
        value = s["value"]
        allowed = F.lit(False)
        for pattern in ALLOWED:
            allowed = allowed | value.rlike(pattern)
        digit, cased = value.rlike("[0-9]"), value.rlike("[a-z]") & value.rlike("[A-Z]")
        least = F.when(value.rlike("^[0-9a-fA-F]+$"), HEX_BITS).when(digit, MIXED_BITS).otherwise(LETTER_BITS)
        told = F.exists(base, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
        return F.when(~(digit | cased) | allowed | told, False).otherwise(peak_entropy(value) >= least)

    return F.filter(matches(text, CANDIDATE, text.rlike(CANDIDATE)), secret)


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) with spans as array<struct<start, kind, end>>, kind being a place in KINDS; one row a document.

    A null text counts as empty and has no spans. A null doc_id stays null, repeated rows are
    scanned alike, other columns are ignored, an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    found = let(F.struct(*(s.alias(k) for k, s in zip(KINDS, base_spans(text)))), lambda b: merged(
        [*(b[k] for k in KINDS[:3]), entropy_spans(text, F.concat(*(b[k] for k in KINDS[:3])))]))
    return rows.select("doc_id", found.alias("spans"))


def digests(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, digest of the base spans, all spans."""
    found = secrets(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = written(F.filter("spans", lambda s: s["kind"] < 3), KINDS)
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(base, 256).alias("base_sha256"), written(F.col("spans"), KINDS).alias("spans"))
