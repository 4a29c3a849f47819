"""Feed payloads to items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchery.functions.text import strip
from dispatchery.functions.urls import canonical_url

_RSS_ITEM = (
    "struct<title:string, link:string, pubDate:string, date:string, created:string,"
    " encoded:array<string>, summary:string, description:string, subtitle:string>"
)
_RSS = f"struct<channel:struct<item:array<{_RSS_ITEM}>>, item:array<{_RSS_ITEM}>>"
_ATOM = (
    "struct<entry:array<struct<title:string, link:array<struct<_href:string, _rel:string, _VALUE:string>>,"
    " published:string, updated:string, created:string, content:array<string>, summary:string,"
    " subtitle:string>>>"
)
_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}


def feed_time(raw: Column) -> Column:
    """An RFC 822 or ISO 8601 date; null for anything else."""
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s*[A-Za-z]{3,9},\s*", "")
    zoned = F.regexp_replace(F.regexp_replace(bare, r"\s+(GMT|UTC|UT|Z)\s*$", " +0000"), r"\s+$", "")
    return F.coalesce(
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm Z")),
        F.trim(F.coalesce(raw, F.lit(""))).try_cast("timestamp"),
    )


def _filled(col: Column) -> Column:
    return F.when(F.coalesce(F.length(col), F.lit(0)) > 0, col)


def _longest(values: Column) -> Column:
    ranked = F.transform(
        F.coalesce(values, F.array().cast("array<string>")),
        lambda v, i: F.struct(-F.length(F.coalesce(v, F.lit(""))), i, v.alias("v")),
    )
    return F.get(F.array_sort(ranked), F.lit(0))["v"]


def parse_feeds(payloads: DataFrame) -> DataFrame:
    """Items of every (payload_id, source_id, arrived_at, payload): RSS or Atom text.

    Entries without a link or a title are dropped. The date is the first of published, updated,
    created; the body is the longest content, else summary, description, subtitle.
    """
    parsed = payloads.select(
        "payload_id", "source_id", "arrived_at",
        F.from_xml("payload", _RSS, _OPTIONS).alias("rss"),
        F.from_xml("payload", _ATOM, _OPTIONS).alias("atom"),
    )
    empty = F.array().cast(
        "array<struct<title:string, link:string, published:timestamp, body:string>>"
    )

    def rss_entry(e: Column) -> Column:
        return F.struct(
            e["title"].alias("title"), e["link"].alias("link"),
            F.coalesce(feed_time(e["pubDate"]), feed_time(e["date"]), feed_time(e["created"])).alias("published"),
            F.coalesce(
                _filled(_longest(e["encoded"])), _filled(e["summary"]), _filled(e["description"]), _filled(e["subtitle"])
            ).alias("body"),
        )

    def atom_entry(e: Column) -> Column:
        links = F.coalesce(e["link"], F.array().cast("array<struct<_href:string,_rel:string,_VALUE:string>>"))
        main = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        return F.struct(
            e["title"].alias("title"), F.get(main, F.lit(0))["_href"].alias("link"),
            F.coalesce(feed_time(e["published"]), feed_time(e["updated"]), feed_time(e["created"])).alias("published"),
            F.coalesce(_filled(_longest(e["content"])), _filled(e["summary"]), _filled(e["subtitle"])).alias("body"),
        )

    entries = F.concat(
        F.coalesce(F.transform(F.col("rss.channel.item"), rss_entry), empty),
        F.coalesce(F.transform(F.col("rss.item"), rss_entry), empty),
        F.coalesce(F.transform(F.col("atom.entry"), atom_entry), empty),
    )
    rows = parsed.select("payload_id", "source_id", "arrived_at", F.posexplode(entries).alias("nth", "e"))
    title = strip(F.coalesce("e.title", F.lit("")))
    link = strip(F.coalesce("e.link", F.lit("")))
    return rows.where((title != "") & (link != "")).select(
        "payload_id", "source_id", "arrived_at", "nth", title.alias("title"), link.alias("url"),
        canonical_url(link).alias("url_canonical"), F.col("e.published").alias("published_at"),
        F.col("e.body").alias("body_text"),
    )
