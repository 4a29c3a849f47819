"""Regex spans of a text as DataFrame expressions: positions in code points, ends exclusive.

A match's place follows from the lengths of the pieces between matches, so a row is read twice and
nothing is shuffled. All of it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = 512
SPANS = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(gaps: Column, sizes: Column) -> Column:
    """Start of each match from the lengths around it. Runs of a few hundred, so appending stays cheap in a text of many matches."""
    steps = F.zip_with(F.slice(gaps, 1, F.size(sizes)), sizes, lambda gap, size: F.struct(gap.alias("gap"), size.alias("size")))

    def run(start: Column, at: Column) -> Column:
        first = F.struct(at.alias("at"), F.expr("CAST(array() AS array<int>)").alias("out"))
        return F.aggregate(F.slice(steps, start + 1, _STEP), first, lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["size"]).alias("at"), F.array_append(a["out"], a["at"] + x["gap"]).alias("out")))

    first = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<array<int>>)").alias("out"))
    runs = F.aggregate(F.sequence(F.lit(0), F.size(sizes) - 1, F.lit(_STEP)), first, lambda a, start: let(
        run(start, a["at"]), lambda r: F.struct(r["at"].alias("at"), F.array_append(a["out"], r["out"]).alias("out"))))
    return F.flatten(runs["out"])


def matches(text: Column, pattern: str, where: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>; `where` is a cheap test that every text with a match passes."""

    def body(s: Column) -> Column:
        starts = _places(F.transform(s["pieces"], F.length), F.transform(s["found"], F.length))
        spans = F.zip_with(starts, s["found"], lambda start, value: F.struct(
            start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value")))
        return F.when(F.size(s["found"]) > 0, spans).otherwise(none())

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    test = text.rlike(pattern) if where is None else where
    return F.when(test, let(both, body)).otherwise(none())


def none() -> Column:
    return F.expr(f"CAST(array() AS {SPANS})")


def merged(kinds: Sequence[Column]) -> Column:
    """Spans of several kinds, in their order, as one array<struct<start, kind, end>> sorted by start, then kind."""
    def tag(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    tagged = [tag(spans, kind) for kind, spans in enumerate(kinds)]
    return F.sort_array(F.concat(*tagged))


def written(spans: Column, names: Sequence[str]) -> Column:
    """kind:start:end of merged spans, joined by commas."""
    named = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(named, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, names: Sequence[str]) -> Column:
    """The text with merged spans replaced by [KIND]; of overlapping spans the first names the place."""
    marks = F.array(*(F.lit(f"[{n.upper()}]") for n in names))
    first = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<string>)").alias("out"))

    def step(a: Column, s: Column) -> Column:
        before = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        mark = F.when(s["start"] >= a["at"], F.get(marks, s["kind"])).otherwise("")
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.array_append(a["out"], F.concat(before, mark)).alias("out"))

    done = F.aggregate(spans, first, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
