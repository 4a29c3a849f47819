"""Texts handed to a model, one per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchery import constants as K
from dispatchery.functions.calendar import age_label
from dispatchery.functions.text import first_chars, present


def shown_body(body: Column, most: int | None = None) -> Column:
    """The body a summariser reads, whole or its first `most` characters."""
    text = F.when(F.coalesce(body, F.lit("")) == "", F.lit(K.NO_BODY)).otherwise(body)
    return first_chars(text, most)


def shown_extra(extra: Column, most: int | None = None) -> Column:
    """Search text under its marker; nothing at all where there is none."""
    marked = F.concat(F.lit(f"\n\n{K.WEB_CONTEXT_MARKER}\n"), first_chars(extra, most))
    return F.when(present(extra), marked).otherwise(F.lit(""))


def fill(template: str, fields: dict[str, Column]) -> Column:
    """A template with `{name}` places, filled from columns."""
    parts, rest = [], template
    while rest:
        start = rest.find("{")
        end = rest.find("}", start)
        if start < 0 or end < 0:
            parts.append(F.lit(rest))
            break
        if start:
            parts.append(F.lit(rest[:start]))
        parts.append(fields[rest[start + 1:end]])
        rest = rest[end + 1:]
    return F.concat(*parts)


def summary_fields(body_chars: int | None = None, extra_chars: int | None = None) -> dict[str, Column]:
    """What a summarise template may name, read from source/title/url/published/body/extra."""
    return {
        "source": F.col("source"), "title": F.col("title"), "url": F.col("url"),
        "published": F.coalesce(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit("unknown")),
        "body": shown_body(F.col("body_text"), body_chars),
        "extra": shown_extra(F.col("extra_text"), extra_chars),
        "tags": F.lit(", ".join(f"`{t}`" for t in K.TAG_VOCABULARY)),
    }


JUDGE_TEMPLATE = (
    "Source: {source}\nTitle: {title}\n\nArticle text:\n{body}\n\n---\nSummary:\n{summary}\n\n"
    "Why it matters:\n{why_it_matters}"
)


def judge_text(body_chars: int | None = None) -> Column:
    body = first_chars(F.coalesce("body_text", F.lit("")), body_chars)
    return fill(JUDGE_TEMPLATE, {
        "source": F.col("source"), "title": F.col("title"),
        "body": F.when(body == "", F.lit("(no body text)")).otherwise(body),
        "summary": F.col("summary"), "why_it_matters": F.col("why_it_matters"),
    })


def candidate_line() -> Column:
    """One numbered entry of the table a ranker reads, from ordinal and the pool's columns."""
    return F.concat(
        F.col("ordinal").cast("string"), F.lit(". ["), F.col("source"), F.lit(" · weight "),
        F.format_number("weight", 1), F.lit(" · "), F.col("kind"), F.lit(" · "),
        age_label(F.col("age_hours")), F.lit(" · importance "), F.col("importance").cast("string"),
        F.lit("] "), F.col("title_local"), F.lit("\n   "), F.col("summary"),
        F.lit("\n   Why it matters: "), F.col("why_it_matters"),
    )


def previous_blocks(headlines: DataFrame) -> DataFrame:
    """(day, language, block) from at most eight headlines a day."""
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("place", "title_local"))),
        lambda h: F.concat(F.lit("- "), h["title_local"]),
    )
    return headlines.groupBy("day", "language").agg(
        F.concat(
            F.lit("\n\nPREVIOUSLY PUBLISHED (context, not candidates):\n"), F.array_join(listed, "\n")
        ).alias("block")
    )
