"""The reader's calendar over UTC instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dispatchery.constants import ZONE


def local_day(ts: Column, zone: str = ZONE) -> Column:
    """The local calendar day of an instant, as `yyyy-MM-dd`."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


def day_start(day: Column, zone: str = ZONE) -> Column:
    """The UTC instant at which a local day begins."""
    return F.to_utc_timestamp(F.to_timestamp(day, "yyyy-MM-dd"), zone)


def day_end(day: Column, zone: str = ZONE) -> Column:
    """The UTC instant at which the next local day begins: one wall-clock day later."""
    return F.to_utc_timestamp(F.to_timestamp(F.date_add(F.to_date(day), 1)), zone)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000.0)


def age_hours(now: Column, then: Column) -> Column:
    return seconds_between(now, then) / F.lit(3600.0)


def age_label(hours: Column) -> Column:
    """The coarse age a candidate table shows; halves round to even."""
    return (
        F.when(hours.isNull(), F.lit("age unknown"))
        .when(hours < 1, F.lit("under an hour old"))
        .when(hours < 48, F.concat(F.bround(hours).cast("bigint").cast("string"), F.lit("h old")))
        .otherwise(F.concat(F.bround(hours / 24).cast("bigint").cast("string"), F.lit("d old")))
    )


def relative_age(now: Column, then: Column) -> Column:
    """The coarse age a list shows: whole hours under a day, then whole days."""
    hours = F.floor(age_hours(now, then))
    return (
        F.when(then.isNull(), F.lit(""))
        .when(hours < 1, F.lit("just now"))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d")))
    )
