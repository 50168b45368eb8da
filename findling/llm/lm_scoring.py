"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every word is predicted from the two words before and the two behind it, the
word itself being hidden; the log-probabilities of all words sum to the score of
a document. The network is written in numpy and predicts a class of words: each
of the most frequent words is one, all others share classes by their last two
bytes. A word within its class has its share of the corpus count; a word outside
the vocabulary is spelled by a byte bigram model.

All counts come from all documents. The network is trained on all documents too:
in each round every task makes one pass over its share, starting from the same
parameters, and the results are averaged by the number of words, as an
aggregation over parameters that sends the driver one row per parameter.

Defined results: a null text, or one without words, has no words, log-probability
0 and a null mean. An empty table gives an empty table. Extra columns are ignored.
Training depends on the order of rows in their files; scoring does not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findling.llm.common import flat_texts, pieces
from findling.llm.decontamination import Words, split_words
from findling.session import written

SIDE = 2  # words seen on either side
TOP = 95  # words that are a class of their own
ENDINGS = 32  # classes of the other words
CLASSES = 1 + TOP + ENDINGS  # class 0 stands beyond the ends of a text
VOCABULARY = 1 << 15  # words with a count of their own
HIDDEN = 24
ROUNDS = 2
BATCH = 4096
RATE = 0.01
PIECE_BYTES = 1 << 20
BYTES = 257  # the last stands for the edge of a word


@dataclass
class Lexicon:
    """Counts of the corpus, of bounded size."""

    codes: np.ndarray  # sorted hashes of the vocabulary
    classes: np.ndarray  # class of each
    log_share: np.ndarray  # log-probability of each within its class
    log_other: np.ndarray  # by class, of a word outside the vocabulary
    log_bigram: np.ndarray  # of a byte after a byte


def _ending(words: Words) -> np.ndarray:
    """Class of each word by its last two bytes."""
    last = words.low[words.end - 1].astype(np.int64)
    before = words.low[np.maximum(words.end - 2, words.start)].astype(np.int64)
    return 1 + TOP + (before * 31 + last) % ENDINGS


def _bigrams(words: Words) -> np.ndarray:
    """Place of every byte pair in a BYTES x BYTES table, edges included, word after word."""
    sizes = words.end - words.start
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    body = words.low[np.repeat(words.start, sizes) + inner].astype(np.int64)
    spelled = np.full(len(body) + len(sizes), BYTES - 1, np.int64)
    edge = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(spelled), bool)
    inside[edge] = False
    spelled[inside] = body
    return np.concatenate([[BYTES - 1], spelled[:-1]]) * BYTES + spelled


def _shards(batches: Iterator[pa.RecordBatch]):
    """``batch, first, last, words`` of bounded pieces of the batches."""
    for batch in batches:
        flat, offsets = flat_texts(batch.column("text"))
        for first, last in pieces(offsets, PIECE_BYTES):
            part = offsets[first : last + 1]
            yield batch, first, last, split_words(flat[part[0] : part[-1]], part - part[0])


def corpus_counts(texts: DataFrame) -> DataFrame:
    """``kind, code, ending, n``: words (0) with the class of their ending, byte pairs (1)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(BYTES * BYTES, np.int64)
        for _, _, _, words in _shards(batches):
            if not len(words.code):
                continue
            pairs += np.bincount(_bigrams(words), minlength=len(pairs))
            codes, first, n = np.unique(words.code, return_index=True, return_counts=True)
            yield _counts(0, codes.view(np.int64), _ending(words)[first], n)
        seen = np.nonzero(pairs)[0]
        yield _counts(1, seen, np.zeros(len(seen), np.int64), pairs[seen])

    return (
        texts.select("text")
        .mapInArrow(count, "kind int, code bigint, ending int, n bigint")
        .groupBy("kind", "code", "ending")
        .agg(F.sum("n").alias("n"))
    )


def _counts(kind: int, code: np.ndarray, ending: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    columns = [np.full(len(code), kind, np.int32), code, ending.astype(np.int32), n.astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "code", "ending", "n"])


def make_lexicon(counts: DataFrame) -> Lexicon:
    """The most frequent words and the byte pairs; sums over the rest are made by Spark."""
    words = counts.filter("kind = 0")
    kept = words.orderBy(F.desc("n"), "code").limit(VOCABULARY).toPandas()
    totals = words.groupBy("ending").agg(F.sum("n").alias("n")).toPandas()
    pairs = counts.filter("kind = 1").toPandas()

    code = kept["code"].to_numpy(np.int64).view(np.uint64)
    n = kept["n"].to_numpy(np.float64)
    place = np.arange(len(code))
    classes = np.where(place < TOP, 1 + place, kept["ending"].to_numpy(np.int64))
    total = np.zeros(CLASSES)
    total[totals["ending"].to_numpy(np.int64)] = totals["n"].to_numpy(np.float64)
    own, ending = place < TOP, kept["ending"].to_numpy(np.int64)
    np.subtract.at(total, ending[own], n[own])
    total[classes[own]] = n[own]
    inside = np.bincount(classes, weights=n, minlength=CLASSES)
    # One occurrence more in each class for words that were never seen.
    share = n / (total[classes] + 1)
    other = (total - inside + 1) / (total + 1)
    table = np.full(BYTES * BYTES, 0.01)
    table[pairs["code"].to_numpy(np.int64)] += pairs["n"].to_numpy(np.float64)
    table = table.reshape(BYTES, BYTES)
    order = np.argsort(code)
    return Lexicon(code[order], classes[order], np.log(share[order]), np.log(other),
                   np.log(table / table.sum(1, keepdims=True)))


def classify(words: Words, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Class of every word, and its log-probability within the class."""
    classes, inside = _ending(words), np.zeros(len(words.code))
    if len(lexicon.codes):
        spot = np.minimum(np.searchsorted(lexicon.codes, words.code), len(lexicon.codes) - 1)
        known = lexicon.codes[spot] == words.code
        classes = np.where(known, lexicon.classes[spot], classes)
        inside = np.where(known, lexicon.log_share[spot], 0.0)
    else:
        known = np.zeros(len(words.code), bool)
    rare = np.nonzero(~known)[0]
    if len(rare):
        few = Words(words.low, words.start[rare], words.end[rare], words.code[rare], words.first)
        sizes = few.end - few.start + 1
        spelled = np.add.reduceat(
            lexicon.log_bigram.ravel()[_bigrams(few)], np.cumsum(sizes) - sizes
        )
        inside[rare] = lexicon.log_other[classes[rare]] + spelled
    return classes, inside


def windows(classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The classes beside every word, 2 * SIDE columns; 0 beyond the ends of its text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(classes))
    columns = []
    for step in [*range(-SIDE, 0), *range(1, SIDE + 1)]:
        place = at + step
        beyond = (place < first[text]) | (place >= first[text + 1])
        columns.append(np.where(beyond, 0, classes[np.clip(place, 0, max(len(classes) - 1, 0))]))
    return np.stack(columns, 1)


class Network:
    """Embedding per side and class, summed, tanh, softmax over classes; float32."""

    SHAPES = ((2 * SIDE * CLASSES, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,))

    def __init__(self, flat: np.ndarray | None = None):
        sizes = [int(np.prod(s)) for s in self.SHAPES]
        if flat is None:
            random = np.random.Generator(np.random.PCG64(11))
            flat = random.normal(0, 0.1, sum(sizes))
        self.flat = flat.astype(np.float32)
        parts = np.split(self.flat, np.cumsum(sizes)[:-1])
        self.embed, self.shift, self.out, self.bias = (
            p.reshape(s) for p, s in zip(parts, self.SHAPES)
        )
        self.moment, self.spread, self.steps = np.zeros_like(self.flat), np.zeros_like(self.flat), 0

    def _forward(self, beside: np.ndarray):
        rows = beside + np.arange(2 * SIDE) * CLASSES
        hidden = self.embed[rows[:, 0]] + self.shift
        for k in range(1, 2 * SIDE):
            hidden += self.embed[rows[:, k]]
        hidden = np.tanh(hidden)
        return rows, hidden, hidden @ self.out + self.bias

    def log_probabilities(self, beside: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of every target class given the classes beside it."""
        out = np.zeros(len(target))
        for at in range(0, len(target), BATCH):
            some = slice(at, at + BATCH)
            _, _, scores = self._forward(beside[some])
            mine = scores[np.arange(len(scores)), target[some]]
            top = scores.max(1, keepdims=True)
            out[some] = mine - top[:, 0] - np.log(np.exp(scores - top).sum(1))
        return out

    def learn(self, beside: np.ndarray, target: np.ndarray) -> None:
        """One Adam step on one batch."""
        rows, hidden, scores = self._forward(beside)
        scores -= scores.max(1, keepdims=True)
        wrong = np.exp(scores)
        wrong /= wrong.sum(1, keepdims=True)
        wrong[np.arange(len(target)), target] -= 1
        wrong /= len(target)
        back = (wrong @ self.out.T) * (1 - hidden * hidden)
        slope = np.zeros_like(self.flat)
        embed, shift, out, bias = (
            p.reshape(s)
            for p, s in zip(np.split(slope, np.cumsum([np.prod(s) for s in self.SHAPES])[:-1]), self.SHAPES)
        )
        cells = (rows[:, :, None] * HIDDEN + np.arange(HIDDEN)).reshape(-1)
        weights = np.repeat(back[:, None, :], 2 * SIDE, axis=1).reshape(-1)
        embed.ravel()[:] = np.bincount(cells, weights=weights, minlength=embed.size)
        shift[:], out[:], bias[:] = back.sum(0), hidden.T @ wrong, wrong.sum(0)
        self.steps += 1
        self.moment += 0.1 * (slope - self.moment)
        self.spread += 0.01 * (slope * slope - self.spread)
        speed = self.moment / (1 - 0.9**self.steps)
        scale = np.sqrt(self.spread / (1 - 0.99**self.steps)) + 1e-8
        self.flat -= RATE * speed / scale


def train(texts: DataFrame, lexicon: Lexicon) -> Network:
    """Rounds of local passes and averaging; each document is in one round."""
    network = Network()
    context = texts.sparkSession.sparkContext
    held_lexicon = context.broadcast(lexicon)
    for round_no in range(ROUNDS):
        start = context.broadcast(network.flat)

        def local(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            mine, n_seen = Network(start.value.copy()), 0
            for _, _, _, words in _shards(batches):
                classes, _ = classify(words, held_lexicon.value)
                beside = windows(classes, words.first)
                for at in range(0, len(classes), BATCH):
                    mine.learn(beside[at : at + BATCH], classes[at : at + BATCH])
                n_seen += len(classes)
            if n_seen:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(len(mine.flat), dtype=np.int32)),
                        pa.array(mine.flat.astype(np.float64) * n_seen),
                        pa.array(np.full(len(mine.flat), n_seen, np.int64)),
                    ],
                    ["place", "weighed", "n"],
                )

        share = texts.filter(
            F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == round_no
        )
        averaged = (
            share.select("text")
            .mapInArrow(local, "place int, weighed double, n bigint")
            .groupBy("place")
            .agg((F.sum("weighed") / F.sum("n")).alias("value"))
            .toPandas()
        )
        if len(averaged):
            flat = np.zeros(len(network.flat))
            flat[averaged["place"].to_numpy()] = averaged["value"].to_numpy()
            network = Network(flat)
    return network


def score(texts: DataFrame, lexicon: Lexicon, network: Network) -> DataFrame:
    """``doc_id, n_words, log_prob, mean_log_prob`` of every document."""
    context = texts.sparkSession.sparkContext
    held = context.broadcast((lexicon, network.flat))  # VOCABULARY words and the parameters

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, flat = held.value
        network = Network(flat)
        for batch, first, last, words in _shards(batches):
            classes, inside = classify(words, lexicon)
            each = network.log_probabilities(windows(classes, words.first), classes) + inside
            n = np.diff(words.first)
            text = np.repeat(np.arange(len(n)), n)
            total = np.bincount(text, weights=each, minlength=len(n))
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, last - first), pa.array(n), pa.array(total), mean],
                ["doc_id", "n_words", "log_prob", "mean_log_prob"],
            )

    rows = texts.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(
        scored, "doc_id bigint, n_words bigint, log_prob double, mean_log_prob double"
    )


def report(docs: DataFrame) -> DataFrame:
    """Scores of all documents under a model of all documents."""
    texts = docs.select("doc_id", "text")
    lexicon = make_lexicon(written(corpus_counts(texts), "corpus-counts"))
    return score(texts, lexicon, train(texts, lexicon))
