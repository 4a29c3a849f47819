"""URL filters: a list of host and path rules, and association rules mined from labelled URLs.

FP-growth finds combinations of URL tokens that go with blocking; rules of enough support and
confidence are indexed by their rarest token, and a URL is held against those its tokens name.
DataFrame operations throughout.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchery.llm.runs import Run

#: Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Share of the labelled URLs a combination must occur in, share of them that must be blocked, and the largest combination.
SUPPORT, CONFIDENCE, LARGEST = 0.01, 0.8, 4
#: Rules broadcast at most; more are joined by a shuffle.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "label=block"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, suffix, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == suffix) | host.endswith(f".{suffix}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(suffix + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, labels of the host, parts of the path without those that are numbers, names in the query."""
    text = F.coalesce(url, F.lit(""))
    tag = lambda kind, parts: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(kind), p))
    scheme = tag("s=", F.array(F.regexp_extract(text, r"(?s)^(.*?)://", 1)))
    host = tag("h=", F.split(host_of(url), "\\."))
    path = tag("p=", F.filter(F.split(path_of(url), "[/.]"), lambda p: ~p.rlike("^[0-9]+$")))
    query = tag("q=", F.transform(F.split(F.regexp_extract(text, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: F.split(p, "=")[0]))
    return F.array_distinct(F.concat(scheme, host, path, query))


def together(rows: DataFrame, support: float) -> DataFrame:
    """`items` of rows, cut to frequent tokens, and of tokens that stand in the very same rows to the first by name.

    Such tokens give every rule in as many wordings as they have subsets; one wording fits the same labelled
    rows. A token's rows are named by their number and two sums of their hashes. At most the tokens a row
    over `support` are frequent, so the list that all tasks get is bounded.
    """
    run = Run(rows.sparkSession, "tokens")
    kept = run.keep(rows.where(F.size("items") > 0).withColumn("id", F.monotonically_increasing_id()))
    total = kept.count()
    each = kept.select("id", F.explode("items").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(F.xxhash64("id", F.lit(salt)).cast("decimal(38,0)")).alias(f"s{salt}") for salt in (1, 2)))
    frequent = each.where(F.col("n") >= support * total).withColumn("own", F.when(F.col("token") == BLOCK, 1).otherwise(0))
    first = frequent.groupBy("own", "n", "s1", "s2").agg(F.min("token").alias("token"))
    named = kept.select("id", F.explode("items").alias("token")).join(F.broadcast(first.select("token")), "token")
    return named.groupBy("id").agg(F.collect_list("token").alias("items"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, largest: int = LARGEST) -> DataFrame:
    """Rules (tokens, rare, confidence) for blocking, from (url, blocked boolean); tokens that always occur together count as one. `rare` is the token of a rule that fewest labelled URLs have."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col("url").isNotNull() & F.col("blocked").isNotNull())
    tagged = rows.select(F.array_distinct(F.concat(url_tokens(F.col("url")), F.when(F.col("blocked"), F.array(F.lit(BLOCK))).otherwise(F.expr("CAST(array() AS array<string>)")))).alias("items"))
    items = together(tagged, support)
    if items.isEmpty():
        return spark.createDataFrame([], "tokens array<string>, rare string, confidence double")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    rules = model.associationRules.where((F.col("consequent")[0] == BLOCK) & (F.size("antecedent") <= largest) & (F.col("lift") > 1))
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    tokens = rules.select(F.array_sort("antecedent").alias("tokens"), "confidence").select("*", F.explode("tokens").alias("token"))
    return tokens.join(single, "token").groupBy("tokens", "confidence").agg(F.min_by("token", F.struct("freq", "token")).alias("rare")).select("tokens", "rare", "confidence")


def blocked_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence) of the distinct urls that a rule fits."""
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    known = urls.select("url").where(F.col("url").isNotNull()).distinct().select("url", url_tokens(F.col("url")).alias("own"))
    met = known.select("*", F.explode("own").alias("rare")).join(F.broadcast(rules) if small else rules, "rare")
    return met.where(F.size(F.array_except("tokens", "own")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the mined rule's confidence of every page, one row each.

    A null url, or one without ://, has empty host and path, fits no listed rule and is allowed. A
    null page_id stays null, repeated rows are judged alike, other columns are ignored; without
    labelled rows only the list blocks, and an empty table gives no rows.
    """
    url = F.col("url").cast("string")
    seen = pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    seen = seen.select("*", listed(F.col("host"), F.col("path"), rules).alias("fits"))
    mined = blocked_urls(seen.where(F.col("fits").isNull()), mine(labelled))
    joined = seen.join(mined, "url", "left")
    verdict = F.coalesce("fits.verdict", F.when((F.col("confidence").isNotNull()) & (F.col("host") != ""), "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("fits").isNull(), F.col("confidence")).alias("confidence"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, blocked): pages whose id is a labelled one; quality 0 stands for blocking."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("page_id")).agg((F.min("quality") == 0).alias("blocked"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).join(known, "page_id").select("url", "blocked")
