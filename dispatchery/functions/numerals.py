"""Figures of a text, one spelling per value."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from dispatchery import constants as K

_NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
_FIGURE = (
    r"(?i)(?<![\p{L}\p{N}_.])[$€£₺%]?\s?(" + _NUMBER + r")\s?%?"
    r"(?:\s?(" + "|".join(sorted(K.SCALES, key=lambda w: (-len(w), w))) + r")(?![\p{L}\p{N}_]))?"
)


def _value(raw: Column) -> Column:
    """Groups of three digits after every mark are thousands; otherwise the last mark is decimal."""
    digits = F.regexp_replace(raw, r"[.,]", "")
    decimal = F.concat(
        F.regexp_replace(F.regexp_extract(raw, r"^(.*)[.,][0-9]+$", 1), r"[.,]", ""),
        F.lit("."),
        F.regexp_extract(raw, r"([0-9]+)$", 1),
    )
    grouped = F.rlike(raw, F.lit(r"^[0-9]+([.,][0-9]{3})*$"))
    return F.when(grouped, digits).otherwise(decimal).try_cast("double")


def _digits(value: Column) -> Column:
    """All digits of a whole double below 1e38, taken in three parts; a cast to decimal keeps 16 of them and fills up with zeros."""
    high, low = 2**100, 2**50
    parts = (
        F.floor(value / F.lit(float(high))).try_cast("decimal(9,0)") * F.lit(Decimal(high)),
        F.floor(value % F.lit(float(high)) / F.lit(float(low))).try_cast("decimal(16,0)") * F.lit(Decimal(low)),
        (value % F.lit(float(low))).try_cast("bigint").try_cast("decimal(16,0)"),
    )
    return F.when(value < F.lit(1e38), (parts[0] + parts[1] + parts[2]).cast("string"))


def _canonical(value: Column) -> Column:
    """Without fraction or exponent where there is none, else up to six places, never with an exponent."""
    whole = value % F.lit(1.0) == 0  # floor() gives a bigint, too small for the largest figures
    # Through its text, since a double cast to decimal keeps 16 digits.
    places = F.rtrim(F.round(value, 6).cast("string").try_cast("decimal(38,6)").cast("string"), F.lit("0"))
    small = F.abs(value) < F.lit(1e15)
    return (
        F.when(whole & small, value.try_cast("bigint").cast("string"))
        .when(whole, F.coalesce(_digits(value), value.cast("string")))
        .otherwise(F.when(F.endswith(places, F.lit(".")), F.concat(places, F.lit("0"))).otherwise(places))
    )


def figures(text: Column) -> Column:
    """array<struct<bare, scaled>> in text order; `scaled` is null without a scale word."""
    body = F.coalesce(text, F.lit(""))
    # A text is searched once, and only where it has a digit; a match is then taken apart, and its value computed once.
    found = F.when(F.rlike(body, F.lit("[0-9]")), F.regexp_extract_all(body, F.lit(_FIGURE), F.lit(0)))
    factors = F.create_map(*[F.lit(x) for kv in K.SCALES.items() for x in (kv[0], float(kv[1]))])

    def parsed(match: Column) -> Column:
        return F.struct(
            _value(F.regexp_extract(match, _NUMBER, 0)).alias("value"),
            F.regexp_replace(match, rf"^[$€£₺%]?\s?{_NUMBER}\s?%?\s?", "").alias("scale"),
        )

    def pair(figure: Column) -> Column:
        factor = F.element_at(factors, F.lower(figure["scale"]))
        return F.struct(
            _canonical(figure["value"]).alias("bare"),
            F.when(figure["scale"] != "", _canonical(figure["value"] * factor)).alias("scaled"),
        )

    return F.transform(F.transform(F.coalesce(found, F.array().cast("array<string>")), parsed), pair)


def values_of(found: Column) -> Column:
    """Every one of `figures`, bare, and scaled as well where a scale word follows; sorted."""
    both = F.flatten(F.transform(found, lambda f: F.array(f["bare"], f["scaled"])))
    return F.array_sort(F.array_distinct(F.filter(both, lambda v: v.isNotNull())))


def claims_of(found: Column) -> Column:
    """What `figures` claim: the scaled value where there is one, else the bare one."""
    return F.array_distinct(F.transform(found, lambda f: F.coalesce(f["scaled"], f["bare"])))


def numeral_values(text: Column) -> Column:
    return values_of(figures(text))


def claimed_values(text: Column) -> Column:
    return claims_of(figures(text))
