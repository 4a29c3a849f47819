"""Byte-level BPE encoding and decoding with the tiktoken library and a rank file.

The rank file is read where tasks run: a path given by the caller, or that of the installed
package of public vocabularies. Long texts are encoded in pieces cut where the pattern always
ends a match, so ids are those of the whole text. One pass over the rows, no shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchery.llm.words import chunks

RANKS = "byte_bpe_50k.tiktoken"
#: Texts longer than so many characters are cut.
PIECE = 1 << 16


@lru_cache(maxsize=4)
def encoding(path: str | None = None):
    """The encoding of a rank file, made once a process."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(RANKS)) as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(str.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about `size` characters, each cut before a space that follows a character that is no white space.

    No match of the pattern holds a space behind another kind of character, and none but a run of
    white space looks at what follows it, so such a place is always the end of one match and the
    start of the next. A text without such places stays whole.
    """
    start = 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at > 0 and text[at - 1].isspace():
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def encode_text(text: str, path: str | None = None) -> np.ndarray:
    coder = encoding(path)
    return np.concatenate([coder.encode_to_numpy(p, disallowed_special=()) for p in pieces(text)])


def decode_ids(ids: np.ndarray, path: str | None = None) -> bytes:
    return encoding(path).decode_bytes(ids.tolist())


SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Every text's ids (little-endian unsigned 32-bit integers) and the bytes these ids decode to, one row a document.

    A null text counts as empty: no ids, no bytes. doc_id is passed on as it is, null too; repeated
    rows are encoded alike, other columns are ignored, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for first, held in chunks(texts):
                ids = [encode_text(text or "", path) for text in texts[first : first + len(held)]]
                yield pa.RecordBatch.from_arrays([
                    keys.slice(first, len(held)), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([decode_ids(x, path) for x in ids], pa.binary()),
                ], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The text of each row's `ids` as (doc_id, decoded binary); null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decode_ids(np.frombuffer(x or b"", "<u4"), path) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("binary")).mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the decoded bytes."""
    return round_trip(docs, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
