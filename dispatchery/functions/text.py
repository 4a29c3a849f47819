"""Text columns: bodies, tokens, JSON arrays, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dispatchery import constants as K

# Whitespace as Unicode counts it; Java's `\s` alone is ASCII.
BLANK = r"[\s\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def alternation(values) -> str:
    """A regex that matches any of the literal values."""
    escaped = ("".join(c if c.isalnum() or c in " _-" else "\\" + c for c in v) for v in values)
    return "(?:" + "|".join(escaped) + ")"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^{BLANK}+|{BLANK}+$", "")


def squeeze(col: Column) -> Column:
    return strip(F.regexp_replace(col, f"{BLANK}+", " "))


def present(col: Column) -> Column:
    """True for text that holds something besides blanks."""
    return F.coalesce(F.length(strip(col)) > 0, F.lit(False))


def words(col: Column) -> Column:
    """Blank-separated words; no text gives an empty array."""
    squeezed = squeeze(F.coalesce(col, F.lit("")))
    return F.when(squeezed == "", F.array().cast("array<string>")).otherwise(F.split(squeezed, " "))


def word_count(col: Column) -> Column:
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(r"[^\s\p{Z}]+"))


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def first_chars(col: Column, most: int | None) -> Column:
    """The first `most` characters, or the whole text without a bound."""
    return col if most is None else F.substring(col, 1, most)


def content_tokens(col: Column) -> Column:
    """Distinct lowercase words over two characters that are not stopwords."""
    found = F.regexp_extract_all(
        F.lower(F.coalesce(col, F.lit(""))), F.lit(r"([\p{L}\p{N}_']+)"), F.lit(1)
    )
    return F.array_except(F.filter(found, lambda w: F.length(w) > 2), literal_array(K.STOPWORDS))


def capitalised_tokens(col: Column, most: int | None = None) -> Column:
    """Distinct capitalised words in code-point order, all or the first `most`."""
    found = F.regexp_extract_all(
        F.coalesce(col, F.lit("")),
        F.lit(r"(?<![\p{L}\p{N}_])([A-ZÇĞİÖŞÜ][\p{L}\p{N}_\-']+)"),
        F.lit(1),
    )
    names = F.array_sort(F.array_distinct(found))
    return names if most is None else F.slice(names, 1, most)


def parse_tags(col: Column) -> Column:
    """A JSON array of strings; anything malformed is an empty array."""
    return F.coalesce(F.from_json(col, "array<string>"), F.array().cast("array<string>"))


def tidy_tags(tags: Column, most: int | None = None) -> Column:
    """Stripped, lowercased, dashed, distinct in order, all or the first `most`."""
    cleaned = F.transform(tags, lambda t: F.regexp_replace(F.lower(strip(t)), " ", "-"))
    kept = F.array_distinct(F.filter(cleaned, lambda t: t != ""))
    return kept if most is None else F.slice(kept, 1, most)


def tidy_body(col: Column, most: int | None = None) -> Column:
    """Runs of blanks to one, runs of empty lines to one; whole, or its first `most` characters."""
    one_space = F.regexp_replace(col, r"[ \t]+", " ")
    two_lines = F.regexp_replace(one_space, r"\n{3,}", "\n\n")
    return first_chars(strip(two_lines), most)


def looks_truncated(col: Column) -> Column:
    return F.rlike(
        F.coalesce(col, F.lit("")), F.lit(f"{alternation(K.TEASER_ENDINGS)}{BLANK}*$")
    )


def is_usable(col: Column) -> Column:
    """Long enough to summarise, and not a teaser cut off by its feed."""
    text = strip(F.coalesce(col, F.lit("")))
    size = F.length(text)
    return (size >= K.MIN_BODY_CHARS) & ~((size < K.TEASER_CHARS) & looks_truncated(text))


def is_version_title(col: Column) -> Column:
    """A name and a version number, which is no query for a news search."""
    return F.rlike(
        F.coalesce(col, F.lit("")),
        F.lit(r"^[^\s\p{Z}][^\n]{0,60}?[\s\p{Z}]+v?\p{Nd}+\.\p{Nd}+(?:\.\p{Nd}+)*[\p{L}\p{N}_.\-]*$"),
    )


def paragraphs(col: Column) -> Column:
    """Blocks between blank lines, inner blanks squeezed."""
    blocks = F.split(strip(F.coalesce(col, F.lit(""))), r"\n\s*\n")
    return F.filter(F.transform(blocks, squeeze), lambda b: b != "")


def note_parts(detail: Column) -> Column:
    """A step note: its JSON parts as a map, null where the note is plain text."""
    return F.when(F.startswith(detail, F.lit("{")), F.from_json(detail, "map<string,string>"))
