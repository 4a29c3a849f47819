"""Words of many texts at once, as numpy arrays over one byte buffer.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is a maximal run of
characters other than those six. Hashes of spans are polynomials modulo 2**64, read from prefix sums, so no
Python code runs per word; as such polynomials collide on made-up inputs, they only choose and never decide
equality. Numbers do that: they come from the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 21
BLOCK = 1 << 20


def chunks(texts: list[str | None], most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Index of the first text and the encoded texts of each run of about `most` bytes; None counts as empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text.encode("utf-8", "surrogatepass") if text else b"")
        size += len(held[-1])
        if size >= most:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def numbers(values: Iterable[bytes]) -> np.ndarray:
    """A number for each value, in order of first appearance: equal values, and no others, have the same."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(v, len(known)) for v in values), np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = powers(BASE, BLOCK + 1), powers(INVERSE, BLOCK + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; spans are in order and don't overlap. Works in blocks, so memory stays small."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        up, down = (_UP, _DOWN) if high - low <= BLOCK else (powers(BASE, high - low + 1), powers(INVERSE, high - low + 1))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


class Words:
    """Words of a list of encoded texts: byte spans in `data`, the text each belongs to, first word of each text."""

    def __init__(self, texts: list[bytes], between: np.ndarray = GAP):
        self.raw = b"\n".join(texts)
        self.data = np.frombuffer(self.raw, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
        self.text_ends = self.text_starts + sizes
        gap = np.ones(len(self.data) + 2, bool)
        gap[1:-1] = between[self.data]
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.text_starts)
        self.counts = np.diff(np.append(self.first, len(self.starts)))
        self.text = np.repeat(np.arange(len(texts)), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def numbers(self) -> np.ndarray:
        """A number for each word; equal words, and no others, have the same."""
        return numbers(self.raw.split())

    def code_points(self) -> np.ndarray:
        """Code points of each word: bytes that aren't continuation bytes."""
        lead = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))
        return lead[self.ends] - lead[self.starts]

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per word over each text."""
        total = np.concatenate(([0], np.cumsum(values)))
        return total[self.first + self.counts] - total[self.first]


def gram_hashes(hashes: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """Rolling hash of the n consecutive values that begin at each place."""
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out *= np.uint64(BASE)
        out += hashes[at + k]
    return mix(out)


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of `size` words lie in a window of n words that begins at one of the starts."""
    begun = np.bincount(starts, minlength=size + 1)
    ended = np.bincount(np.minimum(starts + n, size), minlength=size + 1)
    return np.cumsum(begun - ended)[:-1] > 0
