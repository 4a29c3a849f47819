"""Quality rules by repetition coverage.

Words and lines are numbered by their bytes, so that equality never rests on a hash of long strings. Rolling
hashes of several n-gram lengths over these numbers mark the words that lie in an n-gram seen before in the
same text, and line numbers mark repeated lines; a text fails where too many of its characters are
covered. One pass over the rows, no shuffle; a task holds one chunk of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchery.llm.words import BASE, Words, chunks, covered, gram_hashes, mix, numbers

#: Greatest share of a text's word characters inside n-grams seen before, by n (3 or more). One boilerplate line
#: said twice covers up to 0.14 of a clean text of 70 words, so the limits begin above that.
GRAM_LIMITS = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
#: The same for words in lines equal to an earlier line.
LINE_LIMIT = 0.20
SYMBOLS = b"#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, gram_coverage double, line_coverage double"
)


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which of those places isn't their key's first."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    many = np.zeros(len(keys), bool)
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    places = np.flatnonzero(many)
    _, firsts = np.unique(keys[places], return_index=True)
    later = many.copy()
    later[places[firsts]] = False
    return many, later


def measure(texts: list[bytes], gram_limits: dict[int, float] = GRAM_LIMITS, line_limit: float = LINE_LIMIT) -> dict[str, np.ndarray]:
    """The figures of each text, as arrays in the texts' order."""
    words = Words(texts)
    n, size = len(words), len(texts)
    salt = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(BASE))
    hashes, points = mix(words.numbers()), words.code_points()
    n_words, word_chars = words.counts, words.per_text(points)

    def repeated(length: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows of so many words that begin in `among`: those found twice or more, and the later of them."""
        among = among[among <= n - length]
        among = among[words.text[among] == words.text[among + length - 1]]
        many, later = _repeats(gram_hashes(hashes, length, among) ^ salt[words.text[among]])
        return among[many], among[later]

    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    symbols = np.concatenate(([0], np.cumsum(symbol[words.data])))
    n_symbols = symbols[words.text_ends] - symbols[words.text_starts]

    breaks = np.flatnonzero(words.data == 10)
    line_starts, line_ends = np.append(0, breaks + 1), np.append(breaks, len(words.data))
    first_word = np.searchsorted(words.starts, line_starts)
    last_word = np.searchsorted(words.starts, line_ends)
    with_word = first_word < last_word
    line_starts, line_ends, first_word, last_word = (x[with_word] for x in (line_starts, line_ends, first_word, last_word))
    line_text = words.text[first_word] if len(first_word) else np.zeros(0, np.int64)
    lines = [words.raw[a:b] for a, b in zip(line_starts.tolist(), line_ends.tolist())]
    again = _repeats(mix(numbers(lines)) ^ salt[line_text])[1]
    n_dup_lines = np.bincount(line_text[again], minlength=size)
    total = np.concatenate(([0], np.cumsum(points)))
    in_lines = np.bincount(line_text[again], weights=(total[last_word] - total[first_word])[again], minlength=size)

    among, _ = repeated(3, np.arange(n))
    n_repeat = words.per_text(covered(among, 3, n).astype(np.int64))
    failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    chars = np.maximum(word_chars, 1)
    line_coverage = in_lines / chars
    worst, over = np.zeros(size), line_coverage > line_limit
    # A longer window repeats only where a shorter one does, so each length looks at what the last one left.
    for length, limit in sorted((k, v) for k, v in gram_limits.items() if k >= 3):
        among, later = repeated(length, among)
        share = words.per_text(points * covered(later, length, n)) / chars
        worst, over = np.maximum(worst, share), over | (share > limit)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat,
        "base_failed": failed, "kept": ~failed & ~over, "gram_coverage": worst, "line_coverage": line_coverage,
    }


def repetition(docs: DataFrame, gram_limits: dict[int, float] = GRAM_LIMITS, line_limit: float = LINE_LIMIT) -> DataFrame:
    """Repetition figures and verdict of every document, one row each.

    A null text counts as empty; a text without words has only zeros and fails. A null doc_id stays
    null, repeated rows are judged alike, other columns are ignored, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for first, held in chunks(texts):
                figures = measure(held, gram_limits, line_limit)
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(held)), *map(pa.array, figures.values())], ["doc_id", *figures])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
