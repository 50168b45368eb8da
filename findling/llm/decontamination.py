"""Benchmark decontamination with an FM-index per shard of the training texts.

Each task cuts its documents into shards of bounded size, indexes all words of a
shard, searches every test phrase backwards, locates the occurrences and merges
them into removal spans. Documents are not shuffled; phrases reach the tasks in
blocks of bounded size. One pass over the documents searches all blocks, one
after the other, so that many blocks give what one would.

A phrase is each run of ``WINDOW`` words of an item, or all words of a shorter
item; equal ones of a block are searched once. Words are compared lower-cased (A-Z);
a shard's symbols are words told apart byte by byte, not only by their hash. A text
longer than a shard is indexed in parts that overlap by all words but one of a phrase.

Defined results: a null text has no words, nor has an item with a null text any
phrase. An item listed twice counts once, one without id not among the items.
An empty table of either kind gives documents without hits. Rows of documents
sharing an id, or without one, are scored each by itself. Names of other columns
are free but for those beginning with ``__found_``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findling.llm.common import LOWER, flat_texts, pieces, schema_with
from findling.llm.fm_index import FMIndex

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20  # of test items that a task holds at once
LOCATE_AT_ONCE = 1 << 18
BYTES_AT_ONCE = 1 << 21  # of words that are compared at once

IS_WORD = np.ones(256, bool)
IS_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
PLACE_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """The words of texts end to end."""

    low: np.ndarray  # lower-cased bytes
    start: np.ndarray  # of each word
    end: np.ndarray
    code: np.ndarray  # 64-bit hash of each word
    first: np.ndarray  # the number of words before each text, and of all


def split_words(flat: np.ndarray, offsets: np.ndarray) -> Words:
    low = LOWER[flat]
    inside = IS_WORD[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = inside[edges]
    start = np.nonzero(begins)[0]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    end = np.nonzero(ends)[0] + 1
    sizes = end - start
    if len(start):
        kept = low[inside]
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        place = np.arange(len(kept)) - np.repeat(at, sizes)
        powers = np.cumprod(np.full(int(sizes.max()), PLACE_FACTOR))
        code = np.add.reduceat(BYTE_CODES[kept] * powers[place], at)
        code ^= code >> np.uint64(29)
    else:
        code = np.zeros(0, np.uint64)
    return Words(low, start, end, code, np.searchsorted(start, offsets))


@dataclass
class Phrases:
    """Different windows of test items, and which items hold each."""

    words: Words
    first: np.ndarray  # where each different word stands first among ``words``
    rows: np.ndarray  # per window its different words, aligned to the right
    length: np.ndarray
    begin: np.ndarray  # of each window's stretch of ``holders``, and the end of the last
    holders: np.ndarray  # places of items in ``ids``
    ids: list


def make_phrases(ids: list, texts: list, window: int = WINDOW) -> Phrases:
    flat, offsets = flat_texts(pa.array(texts, pa.large_string()))
    words = split_words(flat, offsets)
    word, first, _ = word_ids(words)
    n = np.diff(words.first)
    per_item = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
    item = np.repeat(np.arange(len(ids)), per_item)
    nth = np.arange(len(item)) - np.repeat(np.cumsum(per_item) - per_item, per_item)
    length = np.minimum(n, window)[item]
    back = np.arange(window)[None, :] - window
    place = (words.first[item] + nth + length)[:, None] + back
    rows = np.where(-back <= length[:, None], word[np.maximum(place, 0)] if len(word) else -1, -1)
    rows, of = np.unique(rows.astype(np.int32), axis=0, return_inverse=True)
    pairs = np.unique(of.ravel().astype(np.int64) * max(len(ids), 1) + item)
    begin = np.searchsorted(pairs, np.arange(len(rows) + 1) * max(len(ids), 1))
    return Phrases(words, first, rows, (rows >= 0).sum(axis=1), begin, pairs % max(len(ids), 1), ids)


def _same_bytes(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether word ``i`` of ``a`` is word ``j`` of ``b``, pair by pair."""
    out = np.zeros(len(i), bool)
    ends = np.cumsum(a.end[i] - a.start[i])
    at = 0
    while at < len(i):  # of a bounded number of bytes, or one word, at once
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + BYTES_AT_ONCE, side="right")))
        x, y = i[at:to], j[at:to]
        size = a.end[x] - a.start[x]
        same = size == b.end[y] - b.start[y]
        x, y, size = x[same], y[same], size[same]
        if len(x):
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            equal = a.low[np.repeat(a.start[x], size) + inner] == b.low[np.repeat(b.start[y], size) + inner]
            same[same] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
        out[at:to] = same
        at = to
    return out


def word_ids(words: Words) -> tuple[np.ndarray, np.ndarray, dict[bytes, int]]:
    """A number for each word, equal for equal bytes; where each number stands first; and
    the numbers of words whose hash an other word had before, which come last."""
    known, first, ids = np.unique(words.code, return_index=True, return_inverse=True)
    extra: dict[bytes, int] = {}
    places = []
    for w in np.nonzero(~_same_bytes(words, np.arange(len(ids)), words, first[ids]))[0].tolist():
        body = words.low[words.start[w] : words.end[w]].tobytes()
        if body not in extra:
            extra[body] = len(known) + len(extra)
            places.append(w)
        ids[w] = extra[body]
    return ids, np.concatenate([first, np.array(places, np.int64)]), extra


class Shard:
    """The index of a shard's words, whose symbols are numbers of words after those of texts."""

    def __init__(self, words: Words):
        self.words, self.n_texts = words, len(words.first) - 1
        ids, self.first, self.extra = word_ids(words)
        self.known = words.code[self.first[: len(self.first) - len(self.extra)]]
        symbols = np.zeros(len(ids) + self.n_texts, np.int64)
        of = np.repeat(np.arange(self.n_texts), np.diff(words.first))
        symbols[np.arange(len(ids)) + of + 1] = ids + self.n_texts
        symbols[words.first[:-1] + np.arange(self.n_texts)] = np.arange(self.n_texts)
        self.index = FMIndex(symbols, len(self.first) + self.n_texts)

    def symbols(self, phrases: Phrases) -> np.ndarray:
        """The symbol of each different word of the phrases; -1 if the shard lacks it."""
        code = phrases.words.code[phrases.first]
        spot = np.minimum(np.searchsorted(self.known, code), len(self.known) - 1)
        hashed = np.nonzero(self.known[spot] == code)[0]
        out = np.full(len(code), -1, np.int64)
        same = _same_bytes(phrases.words, phrases.first[hashed], self.words, self.first[spot[hashed]])
        out[hashed[same]] = spot[hashed[same]] + self.n_texts
        if self.extra:
            for k in hashed[~same].tolist():
                w = phrases.first[k]
                body = phrases.words.low[phrases.words.start[w] : phrases.words.end[w]].tobytes()
                out[k] = self.extra.get(body, -1 - self.n_texts) + self.n_texts
        return out

    def occurrences(self, phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(word, window)`` of every occurrence within one text, a bounded number at a time.

        At any word at most one window of each length begins, however often items hold it.
        """
        if not len(phrases.rows):
            return
        rows = np.append(self.symbols(phrases), -1)[phrases.rows]
        low, high = self.index.search(rows, phrases.length)
        found = np.nonzero(high > low)[0]
        sizes = (high - low)[found]
        ends = np.cumsum(sizes)
        for first in range(0, int(ends[-1]) if len(ends) else 0, LOCATE_AT_ONCE):
            nth = np.arange(first, min(first + LOCATE_AT_ONCE, int(ends[-1])))
            k = np.searchsorted(ends, nth, side="right")
            at = self.index.locate(low[found[k]] + nth - (ends[k] - sizes[k]))
            text = np.searchsorted(self.words.first + np.arange(self.n_texts + 1), at, side="right") - 1
            yield at - text - 1, found[k]


@dataclass
class Hits:
    """Per text of a shard: words, merged spans of hit words, and items."""

    n_words: np.ndarray
    spans: list  # of (first word, last word + 1) within each text
    byte_spans: list  # of (first byte, last byte + 1) within each text
    items: list  # of item ids, null ones left out
    words: Words | None


def shard_hits(flat: np.ndarray, offsets: np.ndarray, phrases: Phrases) -> Hits:
    return hits_of_blocks(flat, offsets, [phrases])


def hits_of_blocks(flat: np.ndarray, offsets: np.ndarray, blocks: Iterable[Phrases]) -> Hits:
    """Hits of all blocks in the texts as they stand; the shard is indexed once."""
    words = split_words(flat, offsets)
    n_texts = len(offsets) - 1
    out = Hits(np.diff(words.first), [[] for _ in range(n_texts)], [[] for _ in range(n_texts)],
               [[] for _ in range(n_texts)], words)
    if not len(words.code):
        return out
    shard = Shard(words)
    text_of = np.repeat(np.arange(n_texts), out.n_words)
    change = np.zeros(len(words.code) + 1, np.int64)
    for phrases in blocks:
        n_windows, pairs = max(len(phrases.rows), 1), np.zeros(0, np.int64)
        for word, window in shard.occurrences(phrases):
            np.add.at(change, word, 1)
            np.add.at(change, word + phrases.length[window], -1)
            pairs = np.union1d(pairs, text_of[word] * n_windows + window)
        text, window = pairs // n_windows, pairs % n_windows
        for t in np.unique(text).tolist():
            own = window[slice(*np.searchsorted(text, [t, t + 1]))]
            holders = [phrases.holders[phrases.begin[w] : phrases.begin[w + 1]] for w in own.tolist()]
            for i in np.unique(np.concatenate(holders)).tolist():
                if (name := phrases.ids[i]) is not None:
                    out.items[t].append(name)
    hit = np.cumsum(change)[:-1] > 0
    fresh = np.concatenate([[True], text_of[1:] != text_of[:-1]])
    begins = np.nonzero(hit & (fresh | ~np.concatenate([[False], hit[:-1]])))[0]
    last = hit & np.concatenate([fresh[1:] | ~hit[1:], [True]])
    ends = np.nonzero(last)[0] + 1
    for b, e in zip(begins.tolist(), ends.tolist()):
        t = int(text_of[b])
        base, origin = int(words.first[t]), int(offsets[t])
        out.spans[t].append((b - base, e - base))
        out.byte_spans[t].append((int(words.start[b]) - origin, int(words.end[e - 1]) - origin))
    return out


def _joined(spans: list) -> list:
    """Spans in order, with those that overlap or touch as one."""
    out: list = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def long_text_hits(text: np.ndarray, blocks: Callable[[], Iterable[Phrases]], size: int, window: int = WINDOW) -> Hits:
    """Hits of one text longer than a shard: in parts that share ``window - 1`` words."""
    begin, before, room = 0, 0, size
    spans, byte_spans, items = [], [], []
    while True:
        end = begin + room
        while end < len(text) and IS_WORD[LOWER[text[end]]]:
            end += 1
        part = text[begin:end]
        hits = hits_of_blocks(part, np.array([0, len(part)]), blocks())
        spans += [(a + before, b + before) for a, b in hits.spans[0]]
        byte_spans += [(a + begin, b + begin) for a, b in hits.byte_spans[0]]
        items += hits.items[0]
        n = int(hits.n_words[0])
        if end >= len(text):
            break
        if n <= 2 * window:  # words so long that the part holds too few of them
            room *= 2
            continue
        begin += int(hits.words.start[n - window + 1])
        before += n - window + 1
        room = size
    # Bytes between two touching words' spans belong to neither; word spans say which are one.
    ends = dict(zip(spans, byte_spans))
    merged = _joined(spans)
    bytes_of = []
    for first, last in merged:
        inside = [ends[s] for s in ends if first <= s[0] and s[1] <= last]
        bytes_of.append((min(a for a, _ in inside), max(b for _, b in inside)))
    return Hits(np.array([before + n]), [merged], [bytes_of], [sorted(set(items), key=str)], None)


_SPANS = "array<struct<first:bigint,last:bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
FOUND = f"n_words bigint, spans {_SPANS}, byte_spans {_SPANS}, items array<string>"


def _one_at_a_time(held: list[Broadcast]) -> Iterator[Phrases]:
    """The blocks in order; of several, a task lets go of one before it reads the next."""
    for block in held:
        yield block.value
        if len(held) > 1 and block._path is not None:  # it can be read from its file again
            del block._value


def _pass(docs: DataFrame, blocks: Iterable[Phrases], keep: list[str], prefix: str) -> DataFrame:
    context = docs.sparkSession.sparkContext
    held = [context.broadcast(b) for b in blocks]  # each BLOCK_BYTES of text, or one item

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = flat_texts(batch.column("text"))
            for first, last in pieces(offsets, SHARD_BYTES):
                part = offsets[first : last + 1]
                body, part = flat[part[0] : part[-1]], part - part[0]
                if len(body) > SHARD_BYTES:  # one text
                    hits = long_text_hits(body, lambda: _one_at_a_time(held), SHARD_BYTES)
                else:
                    hits = hits_of_blocks(body, part, _one_at_a_time(held))
                as_structs = [
                    [[{"first": a, "last": b} for a, b in row] for row in rows]
                    for rows in (hits.spans, hits.byte_spans)
                ]
                named = [list(map(str, row)) for row in hits.items]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(first, last - first) for c in keep]
                    + [
                        pa.array(hits.n_words),
                        pa.array(as_structs[0], _SPAN_TYPE),
                        pa.array(as_structs[1], _SPAN_TYPE),
                        pa.array(named, pa.list_(pa.string())),
                    ],
                    [*keep, *(prefix + c for c in ("n_words", "spans", "byte_spans", "items"))],
                )

    chosen = docs.select(*dict.fromkeys([*keep, "text"]))
    return chosen.mapInArrow(found, schema_with(chosen, keep, FOUND, prefix))


def phrase_blocks(benchmark: DataFrame) -> Iterator[Phrases]:
    """All phrases of the benchmark, in blocks of about ``BLOCK_BYTES`` of text."""
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // BLOCK_BYTES)
    for block in range(n_blocks):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == block).toArrow()
        yield make_phrases(part["item_id"].to_pylist(), part["text"].to_pylist())


def find_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, spans, byte_spans, items`` of every row of ``docs``."""
    return _pass(docs, phrase_blocks(benchmark), ["doc_id"], "")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])
    found = find_spans(docs, benchmark).withColumn("n_hit", n_hit)
    items = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def cut_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the removal spans taken out of ``text``; a blank stands for each span.

    Spans are those of all blocks in the text as it came, merged, and cut once.
    """
    columns = docs.columns

    def cut(texts: pa.Array, spans: pa.Array) -> list:
        out = []
        for text, row in zip(texts.cast(pa.large_binary()), spans.to_pylist()):
            body = text.as_py()
            for span in reversed(row):
                body = body[: span["first"]] + b" " + body[span["last"] :]
            out.append(body)
        return out

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = pa.array(cut(batch.column("text"), batch.column("__found_byte_spans")), pa.binary())
            kept = [body.cast(pa.string()) if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(kept, columns)

    return _pass(docs, phrase_blocks(benchmark), columns, "__found_").mapInArrow(without, docs.schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a test phrase."""
    marked = _pass(docs, phrase_blocks(benchmark), docs.columns, "__found_")
    return marked.filter(F.size("__found_spans") == 0).select(*docs.columns)
