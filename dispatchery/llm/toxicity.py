"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as its own vector and as its character n-grams' vectors, each with the log-odds that
the labelled rows give it. The network reads overlapping windows of words; a text scores as its
worst window, so nothing of a long text is left out. The fit uses a bounded sample of labelled
rows on the driver; scoring is one pass over the rows without a shuffle.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchery.llm.simhash import fingerprint, local_links
from dispatchery.llm.words import BASE, Words, chunks, mix

#: Bounds of the fit alone: labelled rows used, and the longest text among them, in characters.
FIT_ROWS, FIT_CHARS = 2500, 20_000
#: A fit on fewer rows is warned of.
FEW_ROWS = 100
THRESHOLD = 0.7
WINDOW, STRIDE = 24, 16
HIDDEN, WORD_DIM, CHAR_DIM = 8, 6, 6
GRAMS = (4, 6)
#: Texts a word or n-gram must occur in to be known; weight of the base rate in its log-odds.
KNOWN, PRIOR = 4, 10.0
STEPS, ROUNDS, DOCS_A_STEP, RATE, WINDOWS_A_DOC = 360, 25, 48, 0.01, 2
#: Parts of the sample, each of which gets its log-odds from the others.
FOLDS, DRAWS = 5, 6
#: Share of the rate at which the vectors of words and n-grams move.
SLOW = 0.1
_BLOCK = 768
_GRAMS_AT_ONCE = 500_000

#: Every byte but a letter or digit of ASCII parts words; bytes of other characters don't.
BETWEEN = np.ones(256, bool)
BETWEEN[128:] = False
BETWEEN[[*range(48, 58), *range(97, 123)]] = False


def lowered(texts: list[str | None]) -> list[str]:
    return [(t or "").lower() for t in texts]


class Vocabulary:
    """Distinct words of a chunk and their n-grams, as ragged arrays."""

    def __init__(self, texts: list[bytes]):
        words = Words(texts, BETWEEN)
        self.counts, self.first, self.text = words.counts, words.first, words.text
        self.keys, at, self.word = np.unique(words.hashes(), return_index=True, return_inverse=True)
        clean = np.full(len(words.data) + 2, 32, np.uint64)
        clean[1:-1] = np.where(BETWEEN[words.data], 32, words.data)
        starts, ends = words.starts[at], words.ends[at] + 2  # with a space on either side, in `clean`
        parts, owners = [], []
        for n in GRAMS:
            many = np.maximum(ends - starts - n + 1, 0)
            owner = np.repeat(np.arange(len(at)), many)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + starts[owner]
            code = np.full(len(place), n, np.uint64)
            for k in range(n):
                code = code * np.uint64(BASE) + clean[place + k]
            parts.append(mix(code))
            owners.append(owner)
        code, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        self.grams, self.owner = code[order], owner[order]
        self.many = np.bincount(owner, minlength=len(at))
        self.begin = np.cumsum(self.many) - self.many

    def reduce(self, how: np.ufunc, values: np.ndarray) -> np.ndarray:
        """Values of n-grams brought together for each word; zero for a word without any."""
        out = np.zeros((len(self.many), *values.shape[1:]), values.dtype)
        some = self.many > 0
        if some.any():
            out[some] = how.reduceat(values, self.begin[some])
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, owner): word places of every window, -1 beyond a text's end, and its text. A text without words has none."""
        many = np.where(self.counts > 0, 1 + np.maximum(0, -(-(self.counts - WINDOW) // STRIDE)), 0)
        owner = np.repeat(np.arange(len(many)), many)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        places = (nth * STRIDE)[:, None] + np.arange(WINDOW)
        return np.where(places < self.counts[owner][:, None], places + self.first[owner][:, None], -1), owner


def look_up(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key among the sorted known ones, counted from 1; 0 if it isn't known."""
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at + 1, 0)


def log_odds(toxic: np.ndarray, clean: np.ndarray, rate: float) -> np.ndarray:
    return np.log((toxic + PRIOR * rate) / ((toxic + clean) * rate + PRIOR * rate)).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * x.dtype.type(0.5)) * x.dtype.type(0.5) + x.dtype.type(0.5)


class Network:
    """The weights, the pass forward over windows and the pass back."""

    def __init__(self, rng: np.random.Generator, words: int, grams: int):
        inputs, small = WORD_DIM + CHAR_DIM + 3, lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        # Vectors of words and n-grams start at zero and move slowly: a small sample should lean on the log-odds.
        self.w = {"word": np.zeros((words + 1, WORD_DIM), np.float32), "gram": np.zeros((grams + 1, CHAR_DIM), np.float32)}
        for side in "fb":
            self.w |= {f"in_{side}": small(inputs, 3 * HIDDEN) * 3, f"own_{side}": small(HIDDEN, 3 * HIDDEN) * 3, f"bias_{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.w |= {"look": small(2 * HIDDEN), "out": small(2 * HIDDEN), "end": np.full(1, -1.0, np.float32)}

        # Start as a detector of high log-odds, which training then refines: one unit a side listens to them.
        for side, unit in (("f", 0), ("b", HIDDEN)):
            self.w[f"in_{side}"][-3:-1, 2 * HIDDEN] = 1.0, 0.5
            self.w[f"bias_{side}"][2 * HIDDEN] = -1.5
            self.w["look"][unit], self.w["out"][unit] = 2.0, 2.0

    def step(self, side: str, given: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, tuple]:
        own = state @ self.w[f"own_{side}"]
        gates = sigmoid(given[:, : 2 * HIDDEN] + own[:, : 2 * HIDDEN])
        reset, update = gates[:, :HIDDEN], gates[:, HIDDEN:]
        fresh = np.tanh(given[:, 2 * HIDDEN :] + reset * own[:, 2 * HIDDEN :])
        return update * state + (1 - update) * fresh, (state, own[:, 2 * HIDDEN :], reset, update, fresh)

    def forward(self, given: dict[str, np.ndarray], rows: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Logits of windows; `given` has each side's input to the gates by row, and the last row is for places beyond the end."""
        size, states, tape = len(rows), np.empty((WINDOW, len(rows), 2 * HIDDEN), np.float32), []
        inside = (rows >= 0).astype(np.float32)
        for side, steps in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            state = np.zeros((size, HIDDEN), np.float32)
            part = slice(0, HIDDEN) if side == "f" else slice(HIDDEN, None)
            for t in steps:
                fresh, held = self.step(side, given[side][rows[:, t]], state)
                state = fresh * inside[:, t, None]
                states[t, :, part] = state
                if keep:
                    tape.append((side, t, held))
        looks = states @ self.w["look"] + (inside.T - 1) * 1e4
        weights = np.exp(looks - looks.max(0))
        weights /= weights.sum(0)
        pooled = np.einsum("tn,tnh->nh", weights, states)
        return pooled @ self.w["out"] + self.w["end"], [states, weights, pooled, tape, inside]

    def backward(self, error: np.ndarray, kept: list, inputs: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights and of the inputs (window, place, feature)."""
        states, weights, pooled, tape, inside = kept
        grad = {k: np.zeros_like(v) for k, v in self.w.items() if k not in ("word", "gram")}
        grad["out"], grad["end"] = error @ pooled, error.sum(keepdims=True)
        d_pooled = error[:, None] * self.w["out"]
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_look = weights * (d_weight - (weights * d_weight).sum(0))
        grad["look"] = np.einsum("tn,tnh->h", d_look, states)
        d_states = weights[..., None] * d_pooled + d_look[..., None] * self.w["look"]
        d_inputs, carried = np.zeros(inputs.shape, np.float32), {s: np.zeros((len(error), HIDDEN), np.float32) for s in "fb"}
        for side, t, (before, own_fresh, reset, update, fresh) in reversed(tape):
            part = slice(0, HIDDEN) if side == "f" else slice(HIDDEN, None)
            d = (d_states[t][:, part] + carried[side]) * inside[:, t, None]
            d_fresh = d * (1 - update) * (1 - fresh * fresh)
            d_update = d * (before - fresh) * update * (1 - update)
            d_reset = d_fresh * own_fresh * reset * (1 - reset)
            d_given = np.concatenate((d_reset, d_update, d_fresh), 1)
            d_own = np.concatenate((d_reset, d_update, d_fresh * reset), 1)
            carried[side] = d * update + d_own @ self.w[f"own_{side}"].T
            grad[f"own_{side}"] += before.T @ d_own
            grad[f"in_{side}"] += inputs[:, t].T @ d_given
            grad[f"bias_{side}"] += d_given.sum(0)
            d_inputs[:, t] += d_given @ self.w[f"in_{side}"].T
        return grad, d_inputs


class Model:
    """Known words and n-grams with their log-odds, and the network; without both labels only the base rate."""

    def __init__(self, texts: list[str | None], toxic: list[int], seed: int = 7):
        labels = np.array(toxic, np.int64)
        self.rate = float((labels.sum() + 1) / (len(labels) + 10))
        self.net = None
        if len(set(toxic)) == 2:
            keep = self._one_of_each(texts)
            self._fit([texts[i] for i in keep], labels[keep], np.random.default_rng(seed))

    @staticmethod
    def _one_of_each(texts: list[str | None]) -> np.ndarray:
        """Near copies would teach their chance words, so one of each group is used."""
        marks = np.array([fingerprint((t or "").encode()) for t in texts], np.uint64)
        distinct, first = np.unique(marks, return_index=True)
        return np.sort(first[local_links(distinct) == np.arange(len(distinct))])

    def _fit(self, texts: list[str | None], labels: np.ndarray, rng: np.random.Generator) -> None:
        v = Vocabulary([t.encode("utf-8", "surrogatepass") for t in lowered(texts)])
        # A pair is a word and a text it occurs in; its log-odds are those of the other folds' texts, in several draws of folds.
        pair_keys, pair = np.unique(v.text * np.int64(len(v.keys) + 1) + v.word, return_inverse=True)
        pair_text, pair_word = np.divmod(pair_keys, len(v.keys) + 1)
        self.rate_fit = float(labels.mean())
        gram_keys, gram = np.unique(v.grams, return_inverse=True)
        gram = gram.astype(np.int32)
        many = v.many[pair_word]
        # The n-grams of all pairs are many times the words, so they are spread out for some texts at a time.
        block = np.cumsum(np.bincount(pair_text, many, len(texts)).astype(np.int64)) // _GRAMS_AT_ONCE
        edges = np.concatenate((np.searchsorted(block[pair_text], np.unique(block[pair_text])), [len(pair_text)]))

        def spread():
            """(pairs of some texts, the pair of each of their n-grams counted from the first, its n-gram)."""
            for low, high in zip(edges[:-1], edges[1:]):
                each = many[low:high]
                of = np.repeat(np.arange(high - low), each)
                place = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + v.begin[pair_word[low:high]][of]
                yield slice(low, high), of, gram[place]

        parts = [np.unique(pair_text[at][of] * np.int64(len(gram_keys)) + code) for at, of, code in spread()]
        text_of, key_of = (np.concatenate([how(p, len(gram_keys)).astype(np.int32) for p in parts] or [np.zeros(0, np.int32)]) for how in (np.floor_divide, np.mod))
        del parts
        draws = []
        for _ in range(DRAWS):
            fold = np.zeros(len(texts), np.int64)
            for y in (0, 1):
                fold[labels == y] = rng.permutation(np.arange((labels == y).sum()) % FOLDS)
            word_odds, seen = self._cross_fit(pair_word, pair_text, len(v.keys), labels, fold)
            gram_odds, held = self._cross_fit(key_of, text_of, len(gram_keys), labels, fold)
            known, known_gram = seen.sum(0) >= KNOWN, held.sum(0) >= KNOWN
            features = np.zeros((len(pair_word), 3), np.float32)
            features[:, 0] = np.where(known[pair_word], word_odds[fold[pair_text], pair_word], 0)
            for at, of, code in spread():
                odds = np.where(known_gram[code], gram_odds[fold[pair_text[at]][of], code], np.float32(0))
                some = many[at] > 0
                begin = (np.cumsum(many[at]) - many[at])[some]
                if len(begin):
                    features[at][some, 1] = np.maximum.reduceat(odds, begin)
                    features[at][some, 2] = np.add.reduceat(odds, begin) / many[at][some]
            draws.append(features)
        self.words, word_of = v.keys[known], np.where(known, np.cumsum(known), 0)
        self.word_odds = np.concatenate(([0], log_odds(seen[0][known], seen[1][known], self.rate_fit))).astype(np.float32)
        self.grams, gram_place = gram_keys[known_gram], np.where(known_gram, np.cumsum(known_gram), 0)
        self.gram_odds = np.concatenate(([0], log_odds(held[0][known_gram], held[1][known_gram], self.rate_fit))).astype(np.float32)
        del text_of, key_of, gram_odds, held
        features = sum(draws) / np.float32(DRAWS)
        places, owner = v.windows()
        # The windows to learn from: of each text those with the highest odds.
        worth = np.where(places >= 0, features[pair[places], 0] + features[pair[places], 1], -9)
        worth = np.sort(worth, axis=1)[:, -3:].sum(1)
        order = np.lexsort((-worth, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        order = order[rank < WINDOWS_A_DOC]
        places, owner = places[order], owner[order]
        self.net = Network(rng, len(self.words), len(self.grams))
        self._train(v, pair, draws, word_of, gram_place[gram], places, owner, labels, rng)

    def _cross_fit(self, key: np.ndarray, text: np.ndarray, keys: int, labels: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-odds of every key by the fold left out, counts of its toxic and other texts)."""
        part = (labels * FOLDS + fold)[text].astype(np.int8)
        by_fold = np.stack([[np.bincount(key[part == y * FOLDS + f], minlength=keys) for f in range(FOLDS)] for y in (1, 0)])
        total = by_fold.sum(1)
        rest = total[:, None] - by_fold
        return log_odds(rest[0], rest[1], self.rate_fit), total

    def _train(self, v, pair, draws, word_of, gram_of, places, owner, labels, rng) -> None:
        net, w = self.net, self.net.w
        docs = np.unique(owner)
        low, high = np.searchsorted(owner, docs), np.searchsorted(owner, docs, "right")
        first = {k: np.zeros_like(x) for k, x in w.items()}
        second = {k: np.zeros_like(x) for k, x in w.items()}
        tick = 0
        steps = min(STEPS, ROUNDS * -(-len(docs) // DOCS_A_STEP))
        while tick < steps:
            turn = rng.permutation(len(docs))
            for i in range(0, len(turn), DOCS_A_STEP):
                mine = turn[i : i + DOCS_A_STEP]
                rows = np.concatenate([np.arange(low[d], high[d]) for d in mine])
                at, local = places[rows], np.repeat(np.arange(len(mine)), high[mine] - low[mine])
                word = v.word[at]
                distinct, back = np.unique(word, return_inverse=True)
                back = back.reshape(word.shape)
                many = v.many[distinct]
                owner_of = np.repeat(np.arange(len(distinct)), many)
                grams = gram_of[np.arange(len(owner_of)) - np.repeat(np.cumsum(many) - many, many) + v.begin[distinct[owner_of]]]
                chars = np.zeros((len(distinct), CHAR_DIM), np.float32)
                np.add.at(chars, owner_of, w["gram"][grams])
                share = (1 / np.maximum(many, 1)).astype(np.float32)
                inputs = np.concatenate((w["word"][word_of[word]], (chars * share[:, None])[back], draws[rng.integers(len(draws))][pair[at]]), 2)
                flat = inputs.reshape(-1, inputs.shape[2])
                given = {s: np.concatenate((flat @ w[f"in_{s}"] + w[f"bias_{s}"], np.zeros((1, 3 * HIDDEN), np.float32))) for s in "fb"}
                spots = np.where(at >= 0, np.arange(at.size).reshape(at.shape), -1)
                logits, kept = net.forward(given, spots, True)
                # Of each text only its worst window counts.
                best = np.lexsort((-logits, local))
                best = best[np.searchsorted(local[best], np.arange(len(mine)))]
                error = np.zeros(len(logits), np.float32)
                error[best] = (sigmoid(logits[best]) - labels[docs[mine]]) / len(mine)
                grad, d_inputs = net.backward(error, kept, inputs)
                d_inputs[at < 0] = 0
                grad["word"], grad["gram"] = np.zeros_like(w["word"]), np.zeros_like(w["gram"])
                np.add.at(grad["word"], word_of[word], d_inputs[..., :WORD_DIM])
                d_chars = np.zeros_like(chars)
                np.add.at(d_chars, back, d_inputs[..., WORD_DIM : WORD_DIM + CHAR_DIM])
                np.add.at(grad["gram"], grams, (d_chars * share[:, None])[owner_of])
                tick += 1
                for k in w:
                    rate = (RATE * max(0.0, 1 - tick / steps) + 1e-4) * (SLOW if k in ("word", "gram") else 1)
                    first[k] += 0.1 * (grad[k] - first[k])
                    second[k] += 0.01 * (grad[k] * grad[k] - second[k])
                    w[k] -= rate * (first[k] / (1 - 0.9**tick)) / (np.sqrt(second[k] / (1 - 0.99**tick)) + 1e-6) + rate * 1e-3 * w[k]
                w["word"][0] = w["gram"][0] = 0

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Score of each lower-cased, encoded text: its worst window's; the base rate for one without words."""
        out = np.full(len(texts), self.rate)
        if self.net is None:
            return out
        v, w = Vocabulary(texts), self.net.w
        word, gram = look_up(self.words, v.keys), look_up(self.grams, v.grams)
        share = (1 / np.maximum(v.many, 1)).astype(np.float32)
        odds = self.gram_odds[gram]
        inputs = np.concatenate((
            w["word"][word], v.reduce(np.add, w["gram"][gram]) * share[:, None], self.word_odds[word][:, None],
            v.reduce(np.maximum, odds)[:, None], (v.reduce(np.add, odds) * share)[:, None],
        ), 1)
        given = {s: np.concatenate((inputs @ w[f"in_{s}"] + w[f"bias_{s}"], np.zeros((1, 3 * HIDDEN), np.float32))) for s in "fb"}
        places, owner = v.windows()
        logits = np.empty(len(places), np.float32)
        for i in range(0, len(places), _BLOCK):
            part = places[i : i + _BLOCK]
            logits[i : i + _BLOCK], _ = self.net.forward(given, np.where(part >= 0, v.word[part], -1))
        some, begin = np.unique(owner, return_index=True)
        if len(some):
            out[some] = sigmoid(np.maximum.reduceat(logits, begin).astype(np.float64))
        return out


def held_out(doc_id) -> F.Column:
    """Rows that no label is learned from: crc32 of the doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Model:
    """Train on at most `rows` labelled documents of at most `chars` characters, chosen by a hash of doc_id among those that have both; others play no part in the fit."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.length(F.coalesce("text", F.lit(""))) <= chars)
    # The bound is taken of labels that have such a document, so labels of other tables starve no fit.
    usable = texts.select("doc_id").join(known, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most `rows` ids, so the broadcast and what the driver reads are bounded.
    found = texts.join(F.broadcast(usable), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).collect()
    if len(found) < FEW_ROWS:
        warnings.warn(f"only {len(found)} labelled texts to learn toxicity from", stacklevel=2)
    return Model([r["text"] for r in found], [int(r["toxic"] > 0) for r in found])


SCHEMA = "doc_id long, score double"


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, one row each.

    A null or empty text gets the base rate of the fit. A null doc_id stays null and isn't held out;
    repeated rows score alike, other columns are ignored, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held in chunks(lowered(batch.column(1).to_pylist())):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), pa.array(shared.value.score(held))], ["doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held in chunks(lowered(batch.column("__text").to_pylist())):
                keep = pa.array(shared.value.score(held) < threshold)
                yield batch.drop_columns(["__text"]).slice(first, len(held)).filter(keep)

    rows = docs.select(F.struct("*").alias("__row"), F.col("text").cast("string").alias("__text"))
    return rows.mapInArrow(run, rows.drop("__text").schema).select("__row.*")
