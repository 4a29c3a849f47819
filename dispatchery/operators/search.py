"""Prose search: prefix words, all of them, in BM25 order, then translated prose.

Postings (summary_id, field, pos, term) and document lengths are built once and appended to; a
search reads the postings of the terms it can match and nothing else.
"""

from __future__ import annotations

import math
import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchery.operators.reading import valid_translations

FIELDS = ("title_local", "summary", "why_it_matters")
# The ranking function's constants.
K1, B, FLOOR = 1.2, 0.75, 1e-6
PROSE = 8_000_000  # characters of prose whose postings one task holds


def _folding() -> tuple[str, str]:
    """Accented Latin letters and their bases, from the Unicode decompositions."""
    accented, bases = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and len(chr(code).lower()) == 1:
            accented.append(chr(code))
            bases.append(base)
    return "".join(accented), "".join(bases)


_ACCENTED, _BASES = _folding()


def folded(col: Column) -> Column:
    """Lowercase without accents, combining marks dropped."""
    plain = F.translate(F.lower(F.coalesce(col, F.lit(""))), _ACCENTED, _BASES)
    return F.regexp_replace(plain, r"\p{M}", "")


def fold_text(text: str) -> str:
    lowered = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return unicodedata.normalize("NFC", lowered)


def terms(col: Column) -> Column:
    return F.regexp_extract_all(folded(col), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


def tasks(summaries: DataFrame) -> int:
    """Tasks that share the postings: every core, and as many more as the prose needs."""
    letters = sum((F.coalesce(F.length(f), F.lit(0)) for f in FIELDS), F.lit(0))
    total = summaries.agg(F.sum(letters.cast("bigint")).alias("letters")).head()["letters"] or 0
    return max(summaries.sparkSession.sparkContext.defaultParallelism, math.ceil(total / PROSE))


def dealt(summaries: DataFrame) -> DataFrame:
    """Summaries by id over those tasks, so that whatever is counted inside a summary is counted in its task."""
    return summaries.repartition(tasks(summaries), "id")


def uses(summaries: DataFrame) -> DataFrame:
    """(term, uses, summaries): how often a term stands anywhere, and in how many summaries."""
    once = postings(dealt(summaries)).groupBy("summary_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("term").agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("summaries"))


def postings(summaries: DataFrame) -> DataFrame:
    """(summary_id, field, pos, term): one row a word."""
    fields = F.array(*[
        F.struct(F.lit(i).alias("field"), terms(F.col(f)).alias("words")) for i, f in enumerate(FIELDS)
    ])
    rows = summaries.select(F.col("id").alias("summary_id"), F.explode(fields).alias("f"))
    return rows.select("summary_id", "f.field", F.posexplode("f.words").alias("pos", "term"))


def lengths(summaries: DataFrame) -> DataFrame:
    """(summary_id, words) over all fields."""
    total = sum((F.size(terms(F.col(f))) for f in FIELDS), F.lit(0))
    return summaries.select(F.col("id").alias("summary_id"), total.cast("bigint").alias("words"))


def write_index(summaries: DataFrame, path: str, label: str) -> None:
    """A batch of postings and lengths; a batch that runs again replaces itself.

    Rows are ranged by term and then by summary, so a term that stands in most texts fills several tasks and files;
    inside a file they are sorted, so the bounds of its row groups prune a term or a prefix.
    """
    bucket = F.substring("term", 1, 1)
    wide = tasks(summaries)
    (
        postings(summaries.repartition(wide, "id")).withColumn("initial", F.concat(F.lit("x"), F.hex(F.encode(bucket, "UTF-8"))))
        .repartitionByRange(wide, "initial", "term", "summary_id").sortWithinPartitions("initial", "term", "summary_id")
        .write.mode("overwrite").partitionBy("initial").parquet(f"{path}/postings/batch={label}")
    )
    lengths(summaries).write.mode("overwrite").parquet(f"{path}/lengths/batch={label}")


def read_index(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")


def parse(raw: str) -> list[list[str]]:
    """Typed words as phrases of index terms; the last term of each is a prefix."""
    phrases = []
    for word in raw.replace('"', " ").split():
        found = re.findall(r"[^\W_]+", fold_text(word))
        if found:
            phrases.append(found)
    return phrases


def matches(index: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """(summary_id, phrase, tf): how often each phrase stands in a summary.

    Every term test is a literal, so it reaches the scan of the postings.
    """
    hits, keep = [], None
    for p, phrase in enumerate(phrases):
        for k, term in enumerate(phrase):
            test = F.startswith("term", F.lit(term)) if k == len(phrase) - 1 else F.col("term") == term
            keep = test if keep is None else keep | test
            hits.append(F.when(test, F.struct(
                F.lit(p).alias("phrase"), F.lit(len(phrase)).alias("size"), (F.col("pos") - k).alias("start"))))
    if "initial" in index.columns:
        initials = {"x" + t[0].encode().hex().upper() for phrase in phrases for t in phrase}
        keep = F.col("initial").isin(*sorted(initials)) & keep
    found = index.where(keep).select(
        "summary_id", "field", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")
    ).select("summary_id", "field", "h.*")
    whole = found.groupBy("summary_id", "phrase", "field", "start", "size").agg(F.count(F.lit(1)).alias("n")).where("n = size")
    return whole.groupBy("summary_id", "phrase").agg(F.count(F.lit(1)).alias("tf"))


def ranked(index: DataFrame, sizes: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """(summary_id, score) of summaries that hold every phrase; a greater score is better."""
    hit = matches(index, phrases)
    corpus = sizes.agg(F.count(F.lit(1)).alias("docs"), F.avg("words").alias("mean"))
    docs, mean = corpus.select("docs").scalar(), corpus.select("mean").scalar()
    spread = hit.groupBy("phrase").agg(F.count(F.lit(1)).alias("df")).withColumn(
        "idf", F.greatest(F.log((docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(FLOOR))
    )
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("words") / mean))
    return (
        hit.join(spread, "phrase").join(sizes, "summary_id")
        .groupBy("summary_id").agg(F.sum(weight).alias("score"), F.count(F.lit(1)).alias("met"))
        .where(F.col("met") == len(phrases)).drop("met")
    )


def translated_hits(summaries: DataFrame, translations: DataFrame, raw: str) -> DataFrame:
    """(summary_id, created_at): summaries whose valid translation contains the typed text."""
    wanted = raw.lower()
    valid = valid_translations(summaries, translations)
    inside = [F.contains(F.lower(f"{f}_tr"), F.lit(wanted)) for f in FIELDS]
    hit = valid.where(inside[0] | inside[1] | inside[2]).select("id")
    return hit.join(summaries.select("id", "created_at"), "id").withColumnRenamed("id", "summary_id")


def search(
    index: DataFrame, sizes: DataFrame, summaries: DataFrame, translations: DataFrame, raw: str,
    language: str = "en", limit: int = 60,
) -> DataFrame:
    """(summary_id, place, score, total): index hits by score, then translation hits, newest first.

    Ties go to the older id. The total counts every hit.
    """
    phrases = parse(raw)
    if not phrases:
        return sizes.where("false").select(
            "summary_id", F.lit(0).alias("place"), F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("total"))
    hits = ranked(index, sizes, phrases).select(
        "summary_id", F.struct(F.lit(0).alias("part"), (-F.round("score", 9)).alias("by")).alias("at"), "score")
    if language == "tr":
        other = translated_hits(summaries, translations, raw).select(
            "summary_id",
            F.struct(F.lit(1).alias("part"), (-F.unix_seconds("created_at")).cast("double").alias("by")).alias("at"),
            F.lit(None).cast("double").alias("score"))
        hits = hits.unionByName(other).groupBy("summary_id").agg(
            F.min("at").alias("at"), F.max("score").alias("score"))
    total = hits.agg(F.count(F.lit(1)).alias("n")).scalar()
    top = hits.orderBy("at", "summary_id").limit(limit)
    # At most `limit` rows are left to number.
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at", "summary_id"))).select(
        "summary_id", "place", "score", total.alias("total"))

