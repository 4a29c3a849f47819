"""Prices and token arithmetic. The price table is a literal, so no join is needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dispatchery import constants as K


def price(model: Column, side: int) -> Column:
    """USD per million tokens by name prefix; an unknown name pays the dearest price."""
    found = None
    for prefix, pair in K.PRICES.items():
        test = F.startswith(model, F.lit(prefix))
        found = F.when(test, pair[side]) if found is None else found.when(test, pair[side])
    return found.otherwise(K.DEAREST_PRICE[side])


def cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    spent = tokens_in * price(model, 0) + tokens_out * price(model, 1)
    return spent / F.lit(1_000_000.0)


def digest_cost(
    candidates: Column, pool: Column, selected: Column, summarize_model: Column, rank_model: Column
) -> Column:
    """What a press is expected to cost, each stage at its own model."""
    summarize = cost(
        summarize_model, candidates * K.SUMMARY_TOKENS[0], candidates * K.SUMMARY_TOKENS[1]
    )
    rank = cost(
        rank_model,
        pool * K.RANK_PASSES * K.RANK_TOKENS[0],
        pool * K.RANK_PASSES * K.RANK_TOKENS[1],
    )
    translate = cost(
        summarize_model,
        selected * K.TRANSLATION_TOKENS[0] + K.EDITORIAL_TOKENS[0],
        selected * K.TRANSLATION_TOKENS[1] + K.EDITORIAL_TOKENS[1],
    )
    return summarize + rank + F.when(selected > 0, translate).otherwise(F.lit(0.0))


def prompt_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / K.CHARS_PER_TOKEN).cast("bigint")


def usage(message: Column) -> Column:
    """Token counts of a model reply: modern keys, or the legacy ones where those read zero."""

    def read(path: str) -> Column:
        value = F.get_json_object(message, path)
        return F.coalesce(value.try_cast("bigint"), F.lit(0))

    modern_in = read("$.usage_metadata.input_tokens")
    modern_out = read("$.usage_metadata.output_tokens")
    legacy_in = read("$.response_metadata.token_usage.prompt_tokens")
    legacy_out = read("$.response_metadata.token_usage.completion_tokens")
    silent = (modern_in == 0) & (modern_out == 0)
    return F.struct(
        F.when(silent, legacy_in).otherwise(modern_in).alias("tokens_in"),
        F.when(silent, legacy_out).otherwise(modern_out).alias("tokens_out"),
    )
