"""Personal data: patterns propose spans, checksums confirm them, words nearby move their score.

Column expressions only: a row is judged where it is read, nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchery.llm.spans import let, matches, merged, redacted, written

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: What the base kinds match. A match of a kind can begin only where its run of characters begins or the
#: last match ended, which spares the engine every other start; repeats are possessive, so long runs don't recurse.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = "^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"
#: Kinds of the method: an IBAN by its mod-97 rule, a social security number by the words before it.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"

#: Score of a proposal, added for a checksum that holds and for a word of its kind within NEAR characters before it.
START, CHECKED, NAMED, LEAST, NEAR = 0.4, 0.4, 0.2, 0.6, 40
CONTEXT = {
    "email": "(?i)mail|contact|write to|kontakt|correo|courriel",
    "ip": "(?i)\\bip\\b|address|server|host|login|client",
    "card": "(?i)card|visa|mastercard|amex|credit|payment|karte|tarjeta|carte",
    "phone": "(?i)phone|call|tel|mobile|fax|whatsapp|contact",
    "iban": "(?i)iban|account|bank|konto|cuenta|compte",
    "ssn": "(?i)ssn|social security|tax id",
}


def luhn(value: Column) -> Column:
    """Do the digits of a string pass Luhn's rule?"""
    digits = F.reverse(F.transform(F.split(F.regexp_replace(value, "[^0-9]", ""), ""), lambda c: c.cast("int")))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(value: Column) -> Column:
    """Does an IBAN leave 1, its first four characters moved to the end and letters read as 10 to 35?"""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))
    codes = F.transform(F.split(turned, ""), lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55))
    return F.aggregate(codes, F.lit(0), lambda a, c: (a * F.when(c > 9, 100).otherwise(10) + c) % 97) == 1


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def spans_by_kind(text: Column) -> dict[str, Column]:
    digit = text.rlike("[0-9]")
    email = matches(text, EMAIL, text.contains("@"))
    ip = F.filter(matches(text, IP, digit & text.rlike(IP)), lambda s: F.forall(F.split(s["value"], "\\."), lambda p: p.rlike(PART)))
    card = F.filter(matches(text, CARD, digit & text.rlike(CARD)), lambda s: F.when(_digits(s["value"]) <= 19, luhn(s["value"])).otherwise(False))
    phone = F.filter(matches(text, PHONE, text.contains("+")), lambda s: _digits(s["value"]).between(10, 15))
    iban = F.filter(matches(text, IBAN, digit & text.rlike(IBAN)), lambda s: F.length(F.regexp_replace(s["value"], " ", "")).between(15, 34) & mod97(s["value"]))
    ssn = F.filter(matches(text, SSN, digit & text.rlike(SSN)), lambda s: _score(text, "ssn", s) >= LEAST)
    return dict(zip(KINDS, (email, ip, card, phone, iban, ssn)))


def _score(text: Column, kind: str, s: Column) -> Column:
    before = F.substring(text, F.greatest(s["start"] - NEAR, F.lit(0)) + 1, F.least(s["start"], F.lit(NEAR)))
    checked = CHECKED if kind in ("card", "iban") else 0.2 if kind != "ssn" else 0.0
    return F.lit(START + checked) + F.when(before.rlike(CONTEXT[kind]), NAMED).otherwise(0.0)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, scores): spans as array<struct<start, kind, end>>, kind being a place in KINDS, and each span's score.

    A null text counts as empty and has no spans. A null doc_id stays null, repeated rows are
    scanned alike, other columns are ignored, an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.select("doc_id", "text", spans(F.col("text")).alias("spans"))
    scored = F.transform("spans", lambda s: F.round(_any_score(F.col("text"), s), 2))
    return found.select("doc_id", "spans", scored.alias("scores"))


def _any_score(text: Column, s: Column) -> Column:
    out = F.lit(0.0)
    for k, kind in enumerate(KINDS):
        out = F.when(s["kind"] == k, _score(text, kind, s)).otherwise(out)
    return out


def spans(text: Column) -> Column:
    by_kind = spans_by_kind(text)
    return merged([by_kind[k] for k in KINDS])


def digests(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, digest of the base spans, all spans, their scores."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = written(F.filter("spans", lambda s: s["kind"] < 4), KINDS)
    return personal_data(docs).select(
        "doc_id", count(0), count(1), count(2), count(3), F.sha2(base, 256).alias("base_sha256"),
        written(F.col("spans"), KINDS).alias("spans"), F.array_join(F.transform("scores", lambda x: x.cast("string")), ",").alias("scores"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with every span of `text` replaced by its kind in brackets, and n_chars, where there is such a column, counted anew."""
    text = F.coalesce(F.col("__row.text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("__row"))
    changed = rows.select("__row", let(spans(text), lambda s: F.when(F.size(s) > 0, redacted(text, s, KINDS))).alias("__text"))
    new = F.coalesce("__text", F.col("__row.text"))
    out = {c: F.col(f"__row.`{c}`") for c in docs.columns} | {"text": new}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("__text").isNull(), F.col("__row.n_chars")).otherwise(F.length("__text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*(c.alias(name) for name, c in out.items()))
