"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dispatchery.llm.oracles import MERKLE, SPELLING

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op5_repetition")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from dispatchery.llm.repetition import repetition

    return repetition(table(spark, folder, "documents"))


@query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from dispatchery.llm.toxicity import fit, scores

    docs = table(spark, folder, "documents")
    return scores(docs, fit(docs, table(spark, folder, "labels")))


@query("op9_bpe")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from dispatchery.llm.bpe import digests

    return digests(table(spark, folder, "documents"))


@query("op10_simhash")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from dispatchery.llm.simhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


@query("op1_secrets")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from dispatchery.llm.secrets import digests

    return digests(table(spark, folder, "documents"))


@query("op3_decontamination")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from dispatchery.llm.decontamination import contaminated

    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op4_url_filters")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from dispatchery.llm.urls import judge, labelled_pages

    pages = table(spark, folder, "pages")
    return judge(pages, labelled_pages(pages, table(spark, folder, "labels")))


@query("op6_personal_data")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from dispatchery.llm.pii import digests

    return digests(table(spark, folder, "documents"))


@query("op7_html")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from dispatchery.llm.html import main_text

    return main_text(table(spark, folder, "pages"))


@query("op2_substrings")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from dispatchery.llm.substrings import digests

    return digests(table(spark, folder, "documents"))


@query("op11_sharding")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from dispatchery.llm.sharding import by_source, shards

    return shards(table(spark, folder, "documents"), by_source())


@query("op12_spelling", SPELLING)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from dispatchery.llm.spelling import variants

    return variants(table(spark, folder, "documents"))


@query("op13_merkle", MERKLE)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from dispatchery.llm.merkle import manifest

    return manifest(table(spark, folder, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
