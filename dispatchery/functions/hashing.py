"""Hashes and seeded scatters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dispatchery import constants as K


def scatter(id_col: Column, seed: int | Column) -> Column:
    """A deterministic value in [0, modulus) per id; the seed scales, so it reorders."""
    # Reducing both factors first keeps the product inside a long for any id and seed.
    seed = F.lit(seed) if isinstance(seed, int) else seed
    factor = (F.lit(K.HASH_BASE) + seed.cast("bigint") * K.HASH_SEED_STEP) % K.HASH_MODULUS
    return ((id_col % K.HASH_MODULUS) * factor) % K.HASH_MODULUS


def json_string(col: Column) -> Column:
    """One JSON string literal, non-ASCII kept as it is."""
    text = F.to_json(F.array(col))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def content_hash(*fields: Column) -> Column:
    """SHA-256 of the compact JSON list of the fields."""
    return F.sha2(F.to_json(F.array(*fields)), 256)


def prompt_version(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)
