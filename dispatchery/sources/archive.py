"""The engine's tables, derived from the given parquet tables.

Every view is a lazy DataFrame over whole tables. Only what a press would have stored (bulletins,
their items, the facts of bodies) is written once per archive, to the shared checkpoint folder, and read from there.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dispatchery import constants as K
from dispatchery.functions.calendar import day_end, local_day
from dispatchery.functions.hashing import content_hash, scatter
from dispatchery.functions.money import cost
from dispatchery.functions.text import literal_array
from dispatchery.operators import quality, ranking
from dispatchery.session import cut, ensure_checkpoint_dir, spread

EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC
MODELS = tuple(K.PRICES)
STAGES = ("collect", "dedupe", "enrich", "summarize", "rank", "translate", "persist")


def pick(values, index) -> F.Column:
    """The literal at a zero-based index column."""
    return F.element_at(literal_array(values), index.cast("int") + 1)


def first_sentence(text: F.Column) -> F.Column:
    """The headline of a document: its text up to the first full stop or line end."""
    return F.regexp_extract(text, r"^[^.\n]*", 0)


class Archive:
    """Views over one folder of parquet tables."""

    _open: dict[tuple[str, str], "Archive"] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = str(folder).rstrip("/")

    @classmethod
    def at(cls, spark: SparkSession, folder: str) -> "Archive":
        """One archive per application and folder, so stored tables are written once."""
        if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC"):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        key = (spark.sparkContext.applicationId, str(folder))
        if key not in cls._open:
            cls._open[key] = cls(spark, folder)
        return cls._open[key]

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        naive = [c for c, t in df.dtypes if t == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df

    # -- stories -------------------------------------------------------------

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents").withColumn(
            "n", F.regexp_extract("source", r"[0-9]+", 0).cast("bigint")
        )

    @cached_property
    def sources(self) -> DataFrame:
        n = F.col("id")
        return self.documents.select(F.col("n").alias("id")).distinct().select(
            "id",
            F.concat(F.lit("src"), n.cast("string")).alias("name"),
            F.round(F.lit(0.5) + (n % 16) * F.lit(0.1), 1).alias("weight"),
            ((n % 10) != 9).alias("enabled"),
            F.concat(F.lit("https://src"), n.cast("string"), F.lit(".example.com/feed")).alias("url"),
        )

    @cached_property
    def articles(self) -> DataFrame:
        i = F.col("doc_id")
        return self.documents.select(
            i.alias("id"),
            F.col("n").alias("source_id"),
            first_sentence(F.col("text")).alias("title"),
            F.when(i % 17 != 0, F.timestamp_seconds(F.lit(EPOCH) + i * 37 * 60)).alias("published_at"),
            F.timestamp_seconds(F.lit(EPOCH) + i * 41 * 60).alias("fetched_at"),
            F.col("text").alias("body_text"),
            pick(("feed", "fetch", "unknown"), i % 3).alias("body_source"),
            F.concat(
                F.lit("https://"), F.col("source"), F.lit(".example.com/"), i.cast("string")
            ).alias("url"),
        )

    @cached_property
    def bodies(self) -> DataFrame:
        """Articles for work that reads whole texts."""
        return spread(self.articles)

    @cached_property
    def facts(self) -> DataFrame:
        """Figures and names of every body: written once, so each body is parsed once however many checks read it."""
        path = f"{ensure_checkpoint_dir(self.spark)}/facts-{uuid.uuid4().hex}"
        quality.body_facts(self.bodies).write.parquet(path)
        return self.spark.read.parquet(path)

    @cached_property
    def marked_articles(self) -> DataFrame:
        """Articles with `dup_of`: the first id that carried the very same title."""
        first = self.articles.groupBy("title").agg(F.min("id").alias("first_id"))
        return self.articles.join(first, "title").withColumn(
            "dup_of", F.when(F.col("first_id") < F.col("id"), F.col("first_id"))
        ).drop("first_id")

    @cached_property
    def now(self) -> DataFrame:
        """One row: the newest fetch, which stands for the wall clock."""
        return self.articles.agg(F.max("fetched_at").alias("now"))

    @cached_property
    def summaries(self) -> DataFrame:
        i = F.col("doc_id")
        tokens_in = F.floor(F.col("n_chars") / 4).cast("bigint")
        tokens_out = F.least(tokens_in, F.lit(513))
        model = pick(MODELS, i % 5)
        tags = F.array(F.col("lang"), F.col("source"), F.concat(F.lit("t"), (i % 7).cast("string")))
        fact = F.regexp_extract("text", r"[\p{L}\p{N}_]{7,}", 0)
        fetched = F.timestamp_seconds(F.lit(EPOCH) + i * 41 * 60)
        return self.documents.join(self.table("labels"), "doc_id").select(
            i.alias("id"),
            i.alias("article_id"),
            F.col("n").alias("source_id"),
            F.lit("en").alias("language"),
            first_sentence(F.col("text")).alias("title_local"),
            F.regexp_extract("text", r"^[^\n]*", 0).alias("summary"),
            F.regexp_replace("text", r"^[^\n]*\n?", "").alias("why_it_matters"),
            F.to_json(tags).alias("tags_json"),
            (i % 5 + 1).cast("int").alias("importance"),
            (F.col("quality") == 1).alias("relevant"),
            pick(K.KINDS, i % 6).alias("kind"),
            F.when(fact != "", fact).alias("key_fact"),
            (fetched + F.expr("interval 5 minutes")).alias("created_at"),
            local_day(fetched + F.expr("interval 5 minutes")).alias("day"),
            tokens_in.alias("tokens_in"),
            tokens_out.cast("bigint").alias("tokens_out"),
            model.alias("model"),
            cost(model, tokens_in, tokens_out).alias("est_cost_usd"),
        )

    @cached_property
    def translations(self) -> DataFrame:
        def turkish(c):
            return F.concat(F.lit("TR "), F.col(c)).alias(c)

        stale = F.col("id") % 10 == 0
        return self.summaries.where(F.col("id") % 2 == 0).select(
            F.col("id").alias("summary_id"),
            F.lit("tr").alias("language"),
            turkish("title_local"), turkish("summary"), turkish("why_it_matters"),
            F.when(stale, F.sha2("title_local", 256))
            .otherwise(content_hash(F.col("title_local"), F.col("summary"), F.col("why_it_matters")))
            .alias("canonical_hash"),
        )

    @cached_property
    def verdicts(self) -> DataFrame:
        i = F.col("doc_id")
        return self.table("labels").where("toxic = 1").select(
            i.alias("summary_id"),
            F.lit("wrong").alias("verdict"),
            pick(K.REASONS, i % 4).alias("reason"),
            F.when(i % 3 == 0, F.concat(F.lit("note "), i.cast("string"))).alias("note"),
            F.timestamp_seconds(F.lit(EPOCH) + i * 43 * 60).alias("created_at"),
        )

    @cached_property
    def eval_results(self) -> DataFrame:
        i, row = F.col("doc_id"), F.col("row")
        good = (F.col("quality") == 1) == (row == 1)
        passed = F.when(i % 11 != 0, good)
        return (
            self.table("labels")
            .withColumn("row", F.explode(F.when(i % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
            .select(
                (i * 2 + row).alias("id"),
                i.alias("summary_id"),
                F.lit("grounding").alias("kind"),
                passed.alias("passed"),
                F.when(F.coalesce(passed, F.lit(False)), F.lit(None).cast("string"))
                .otherwise(F.concat(F.lit("claim "), i.cast("string"))).alias("detail"),
                pick(MODELS, (i + row) % 5).alias("model"),
                F.timestamp_seconds(F.lit(EPOCH) + i * 47 * 60 + row * 3600).alias("created_at"),
                (row * F.lit(0.0004)).alias("est_cost_usd"),
            )
        )

    # -- readings and bulletins ----------------------------------------------

    @cached_property
    def readings(self) -> DataFrame:
        """Three seeded readings of each local day, as picks."""
        scored = self.summaries.where("relevant").select(
            "day", F.col("id").alias("summary_id"), "importance",
            F.explode(F.sequence(F.lit(1), F.lit(K.RANK_PASSES))).alias("pass"),
        ).withColumn(
            "_score", F.col("importance") * 200000 + scatter(F.col("summary_id"), F.col("pass"))
        )
        order = Window.partitionBy("day", "pass").orderBy(F.desc("_score"), F.asc("summary_id"))
        position = F.col("position")
        return (
            scored.withColumn("position", F.row_number().over(order))
            .where(position <= K.TOP_N)
            .select(
                "day", "pass", "position", "summary_id",
                F.when(F.col("pass") < 3, ranking.band(position))
                .otherwise(pick(K.TIERS, F.least(ranking.tier_rank(ranking.band(position)) + 1, F.lit(3))))
                .alias("tier"),
                F.when(
                    (F.col("summary_id") + F.col("pass")) % 4 == 0, F.lit("")
                ).otherwise(
                    F.concat(F.lit("because "), F.col("summary_id").cast("string"), F.lit("."), F.col("pass").cast("string"))
                ).alias("reason"),
            )
        )

    @cached_property
    def versioned_readings(self) -> DataFrame:
        """Version 1 of a day used the first two readings, version 2 all three."""
        versions = F.when(F.col("pass") < 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
        return self.readings.withColumn("version", F.explode(versions))

    @cached_property
    def notes(self) -> DataFrame:
        return self.versioned_readings.select("day", "version", "pass").distinct().withColumn(
            "note", F.concat(F.lit("note "), F.col("day"), F.lit("/"), F.col("pass").cast("string"))
        )

    @cached_property
    def pools(self) -> DataFrame:
        """How many stories each version of a day chose from."""
        sizes = self.summaries.where("relevant").groupBy("day").agg(F.count(F.lit(1)).alias("pool"))
        return sizes.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))

    @cached_property
    def _press(self) -> tuple[DataFrame, DataFrame]:
        items, days = ranking.aggregate(
            self.versioned_readings, self.notes, self.pools, ["day", "version"]
        )
        bulletin_id = (F.datediff(F.to_date("day"), F.lit("2024-01-01").cast("date")) * 10 + F.col("version")).cast("bigint")
        stored_items = items.select(
            bulletin_id.alias("bulletin_id"), "summary_id", "position", "tier", "reason",
            F.when(F.col("summary_id") % 2 == 0, F.concat(F.lit("TR "), F.col("reason"))).alias("reason_tr"),
        )
        bulletins = days.select(
            bulletin_id.alias("id"), "day", F.lit("en").alias("language"), "version",
            "editor_note",
            F.when(F.col("version") == 2, F.concat(F.lit("TR "), F.col("editor_note"))).alias("editor_note_tr"),
            ((F.col("version") == 2) & (F.floor(bulletin_id / 10) % 3 != 0)).alias("bilingual"), "agreement",
            (F.floor(bulletin_id / 10) * 2 + F.col("version")).cast("bigint").alias("run_id"),
            (day_end(F.col("day")) + F.make_dt_interval(F.lit(0), F.col("version"))).alias("created_at"),
        )
        return cut(stored_items), cut(bulletins)

    @property
    def items(self) -> DataFrame:
        return self._press[0]

    @property
    def bulletins(self) -> DataFrame:
        return self._press[1]

    # -- the machine ---------------------------------------------------------

    @cached_property
    def runs(self) -> DataFrame:
        top = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "partial").otherwise("error")
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.when(top, "digest").otherwise("collect").alias("kind"),
            status.alias("status"),
            F.col("o_orderdate").alias("started_at"),
            F.timestamp_seconds(F.unix_seconds("o_orderdate") + F.col("o_custkey") % 600).alias("finished_at"),
            (F.col("o_custkey") % 100).alias("n_summarized"),
            (F.col("o_totalprice") / F.lit(1e6)).alias("est_cost_usd"),
        )

    @cached_property
    def run_steps(self) -> DataFrame:
        """One row per (run, stage number): the repeats of a pair keep their least row."""
        row = F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag")
        least = self.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(row).alias("r"))
        model = F.when(F.col("r.l_returnflag") == "A", MODELS[0]).when(F.col("r.l_returnflag") == "N", MODELS[1]).otherwise("")
        tokens_in = (F.col("r.l_quantity") * 100).cast("bigint")
        tokens_out = (F.col("r.l_quantity") * 10).cast("bigint")
        return least.select(
            F.col("l_orderkey").alias("run_id"),
            pick(STAGES, F.col("l_linenumber") - 1).alias("node"),
            F.col("l_linenumber").alias("stage"),
            model.alias("model"),
            tokens_in.alias("tokens_in"),
            tokens_out.alias("tokens_out"),
            (F.col("r.l_partkey") % 50).alias("n_out"),
            F.col("r.l_shipdate").alias("started_at"),
            F.timestamp_seconds(F.unix_seconds("r.l_shipdate") + F.col("r.l_suppkey") % 300).alias("finished_at"),
            F.when(model == "", F.lit(0.0)).otherwise(cost(model, tokens_in, tokens_out)).alias("est_cost_usd"),
        )

    @cached_property
    def poll_log(self) -> DataFrame:
        """One row per poll of a source: failed, unchanged, or delivering items."""
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").alias("poll_id"),
            F.col("user_id").alias("source_id"),
            "ts",
            (kind != "error").alias("ok"),
            (kind == "view").alias("unchanged"),
            F.floor("value").cast("bigint").alias("items"),
            F.when(kind != "view", F.get_json_object("props", "$.k")).alias("etag"),
        )

    @cached_property
    def pages(self) -> DataFrame:
        return self.table("pages")

    @cached_property
    def messages(self) -> DataFrame:
        return self.table("conversations").select(
            "conv_id", "turn", "role", "text",
            F.floor(F.length("text") / 4).cast("bigint").alias("tokens"),
        )
