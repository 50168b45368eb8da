"""How the sources of a language differ in their words, from an index built in one pass.

Each task reads its documents once and counts postings (how often, and in how many
documents, a source has a term) into a block in memory. When the block is full it
is spilled as runs sorted by term, one for each language and hash shard, into Spark's
shuffle. The runs of a shard are merged by a heap into frequencies; terms of too few
documents go there. There are as many shards as the size of all texts asks for.

Sources are compared over all kept terms of their language, which most of them do
not hold. For a pair of sources the sum is therefore a base, as if neither had any
term, plus corrections: for the terms of either alone, added up by distinct counts,
and for terms that both hold, streamed term by term over the postings.

``p = 1 + floor(10^9 * (count + 1) / (N + V))`` is a term's share in a source (or
language), ``N`` being all its occurrences of the ``V`` kept terms, and a pair's or
term's divergence ``floor((p - q)^2 / q)``. All of it is integer arithmetic.

Defined results: null texts, languages and sources are empty ones, so a null and an
empty source are one. A source without any term is still compared. A language that
keeps no term has divergences of zero between its sources. Equal values are ranked
by name in byte order. Texts and terms of any length are read whole, in bounded
pieces. An empty table gives an empty result. Columns other than ``text``,
``lang`` and ``source`` are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from findling.llm.common import flat_texts
from findling.session import written

LEAST_DOCUMENTS = 3
TERM_RANKS = 200
UNIT = 1_000_000_000
PIECE_BYTES = 1 << 20  # of text that is cut into terms at once
BLOCK_ENTRIES = 1 << 18  # postings in a task's memory before it spills them
ROWS_AT_ONCE = 256
BLOCK_BYTES = 64 << 20  # and bytes of their terms
SHARD_BYTES = 16 << 20  # of text whose postings a task merges
POOL_LINES = 1 << 17  # that a merge holds open at once
PAIRS_AT_ONCE = 1 << 18
SUMS_HELD = 1 << 20

_TERMS = re.compile(rb"[a-z\x80-\xff]+").findall
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")
RUN = """shard int, lang string, names array<string>, terms binary, source array<int>,
    counts array<bigint>, dfs array<bigint>"""
POSTINGS = "lang string, term string, source string, n bigint, total bigint"
LINE = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("source", pa.string()),
                  ("n", pa.int64()), ("df", pa.int64())])


def term_lists(text: bytes, piece: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The terms of a text, of a bounded piece of it at a time."""
    first = 0
    while first < len(text):
        gap = _GAP.search(text, first + piece)
        last = gap.start() if gap else len(text)
        yield _TERMS(text[first:last].lower())
        first = last


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    if not len(starts):
        return (keys, *counts)
    return (keys[starts], *(np.add.reduceat(x[order], starts) for x in counts))


class Words(dict):
    """A number for every different term, in order of their first occurrence."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


class Block:
    """Postings in memory: of each language and source, occurrences and documents by term.

    They are held as numbers, ``group << 32 | term`` beside its two counts, so that a term
    is an object once a block. Those of new texts wait, and are added up when as many wait
    as the block may hold; it is full when that leaves it half full or more.
    """

    def __init__(self):
        self.words = Words()
        self.groups: dict[tuple[str, str], int] = {}
        self.held = [np.zeros(0, np.int64)] * 3  # keys in order, occurrences, documents
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.entries = self.bytes = 0  # the bytes of those that wait are at most their texts'

    def add(self, lang: str, source: str, text: bytes) -> None:
        group = self.groups.setdefault((lang, source), len(self.groups)) << 32
        found = []
        for terms in term_lists(text):
            codes = np.fromiter(map(self.words.__getitem__, terms), np.int64, len(terms))
            found.append(np.unique(codes, return_counts=True))
        if len(found) > 1:
            codes, counts = (np.concatenate(x) for x in zip(*found))
            found = [_summed(codes, counts)]
        for codes, counts in found:
            self.waiting.append((codes | group, counts, np.ones(len(codes), np.int64)))
            self.entries += len(codes)
        self.bytes += len(text)

    def _add_up(self) -> None:
        if self.waiting:
            self.held = list(_summed(*map(np.concatenate, zip(self.held, *self.waiting))))
            self.waiting = []
            sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
            self.bytes = int(sizes[self.held[0] & 0xFFFFFFFF].sum())
            self.entries = len(self.held[0])

    @property
    def full(self) -> bool:
        if self.entries < BLOCK_ENTRIES and self.bytes < BLOCK_BYTES:
            return False
        self._add_up()
        return 2 * self.entries >= BLOCK_ENTRIES or 2 * self.bytes >= BLOCK_BYTES

    def spill(self, shards: int) -> Iterator[pa.RecordBatch]:
        """The block as runs, one of each language and hash shard, in order of terms.

        A run's terms stand in one string with blanks between, once for each source
        that has them. The empty term, of shard 0, lists the sources of a language.
        """
        self._add_up()
        empty = self.words[b""]
        terms = list(self.words)
        shard = np.fromiter(map(crc32, terms), np.int64, len(terms)) % shards
        order = pc.array_sort_indices(pa.array(terms, pa.large_binary())).to_numpy()
        place = np.empty(len(terms), np.int64)  # by shard, then by term
        place[order[np.argsort(shard[order], kind="stable")]] = np.arange(len(terms))
        edges = np.searchsorted(self.held[0], np.arange(len(self.groups) + 1) << 32)
        by_lang: dict[str, list[tuple[str, int]]] = {}
        for (lang, source), group in self.groups.items():
            by_lang.setdefault(lang, []).append((source, group))
        for lang, parts in by_lang.items():
            names = [name for name, _ in parts]
            spans = [slice(edges[group], edges[group + 1]) for _, group in parts]
            none = np.zeros(len(parts), np.int64)
            own = [np.concatenate([none, *(x[span] for span in spans)]) for x in self.held]
            words, counts, dfs = own[0] & 0xFFFFFFFF, own[1], own[2]
            words[: len(parts)] = empty
            sizes = [span.stop - span.start for span in spans]
            code = np.concatenate([np.arange(len(parts)), np.repeat(np.arange(len(parts)), sizes)])
            order = np.argsort(place[words], kind="stable")
            at = shard[words[order]]
            ends = np.nonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))[0].tolist()
            for a, b in zip(ends[:-1], ends[1:]):
                some = order[a:b]
                line = b" ".join(map(terms.__getitem__, words[some].tolist()))
                lists = [code[some].astype(np.int32), counts[some], dfs[some]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at[a]], pa.int32()), pa.array([lang], pa.string()),
                     pa.array([names], pa.list_(pa.string())), pa.array([line], pa.binary()),
                     *(pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), pa.array(x)) for x in lists)],
                    ["shard", "lang", "names", "terms", "source", "counts", "dfs"],
                )


def index_runs(docs: DataFrame) -> tuple[DataFrame, int]:
    """The sorted runs of all documents, and over how many shards they are dealt."""
    read = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            for first in range(0, len(batch), ROWS_AT_ONCE):
                some = batch.slice(first, ROWS_AT_ONCE)
                flat, offsets = flat_texts(some.column(0))
                langs, sources = some.column(1).to_pylist(), some.column(2).to_pylist()
                for row, (lang, source) in enumerate(zip(langs, sources)):
                    block.add(lang, source, flat[offsets[row] : offsets[row + 1]].tobytes())
                    if block.full:
                        yield from block.spill(shards)
                        block = Block()
        yield from block.spill(shards)

    return read.mapInArrow(indexed, RUN), shards


class Run:
    """A sorted run, of which a stretch of lines is read at a time."""

    def __init__(self, batch: pa.RecordBatch, row: int, stretch: int):
        row = {name: batch.column(name)[row] for name in batch.schema.names}
        self.lang, self.names, self.stretch = row["lang"].as_py(), row["names"].values, stretch
        self.terms = row["terms"].as_buffer()  # not yet read, from ``begin`` on
        self.columns = [row[c].values for c in ("source", "counts", "dfs")]
        self.begin = self.at = 0
        self.last = (self.lang, b"")  # language and term of the last line read

    @property
    def done(self) -> bool:
        return self.at == len(self.columns[0])

    def read(self) -> pa.Table:
        """The next lines: of as many bytes as they take, tried with ever more."""
        want, size = min(self.stretch, len(self.columns[0]) - self.at), 16 * self.stretch
        while True:
            terms = self.terms.slice(self.begin, min(size, self.terms.size - self.begin)).to_pybytes()
            terms = terms.split(b" ", want)
            if len(terms) > want or self.begin + size >= self.terms.size:
                break
            size *= 2
        terms = terms[:want]
        source, counts, dfs = (c.slice(self.at, want) for c in self.columns)
        self.begin += sum(map(len, terms)) + want
        self.at += want
        self.last = (self.lang, terms[-1])
        lang = pa.array([self.lang], pa.string()).take(pa.array(np.zeros(want, np.int64)))
        arrays = [lang, pa.array(terms, pa.binary()), self.names.take(source), counts, dfs]
        return pa.Table.from_arrays(arrays, schema=LINE)


def _added_up(lines: pa.Table) -> pa.Table:
    """One line for each language, term and source, in order of the first two."""
    sums = lines.group_by(["lang", "term", "source"], use_threads=False).aggregate([("n", "sum"), ("df", "sum")])
    sums = sums.select(["lang", "term", "source", "n_sum", "df_sum"]).rename_columns(LINE.names)
    return sums.sort_by([("lang", "ascending"), ("term", "ascending")])


def merged_lines(runs: list[Run], pool_lines: int = POOL_LINES) -> Iterator[pa.Table]:
    """The lines of all runs in order of language and term, those of one term together.

    A heap names the run whose lines in memory end first: it is read further, as
    long as the pool has room. No unread line comes before that end then, so the
    terms before it are complete, and leave the pool.
    """
    pool, size = [], 0

    def read(run: Run) -> None:
        nonlocal size
        pool.append(run.read())
        size += len(pool[-1])

    for run in runs:
        read(run)
    heads = [(run.last, i) for i, run in enumerate(runs) if not run.done]
    heapify(heads)
    while heads:
        run = runs[heads[0][1]]
        read(run)
        if run.done:
            heappop(heads)
        else:
            heapreplace(heads, (run.last, heads[0][1]))
        if size >= pool_lines and heads:
            lang, term = heads[0][0]
            lines = _added_up(pa.concat_tables(pool))
            before = pc.or_(
                pc.less(lines["lang"], lang),
                pc.and_(pc.equal(lines["lang"], lang), pc.less(lines["term"], pa.scalar(term, pa.binary()))),
            )
            n = pc.sum(before).as_py() or 0
            yield lines.slice(0, n)
            pool, size = [lines.slice(n)], len(lines) - n
            if size >= pool_lines // 2:  # terms of many sources: more room, not more merging
                pool_lines *= 2
    if pool:
        yield _added_up(pa.concat_tables(pool))


def kept_lines(lines: pa.Table, least: int) -> pa.RecordBatch | None:
    """The lines of terms in at least ``least`` documents, with each term's total."""
    if not len(lines):
        return None
    lines = lines.combine_chunks()
    codes = [lines[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "term")]
    fresh = np.concatenate([[True], (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])])
    starts = np.nonzero(fresh)[0]
    sizes = np.diff(np.append(starts, len(lines)))
    df = np.add.reduceat(lines["df"].to_numpy(), starts)
    total = np.repeat(np.add.reduceat(lines["n"].to_numpy(), starts), sizes)
    empty = pc.equal(pc.binary_length(lines["term"]), 0).to_numpy()
    keep = pa.array(np.repeat(df >= least, sizes) | empty)
    term = lines["term"].cast(pa.string())
    out = pa.table([lines["lang"], term, lines["source"], lines["n"], pa.array(total)],
                   ["lang", "term", "source", "n", "total"])
    return out.filter(keep)


def merge_runs(runs: DataFrame, shards: int, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, term, source, n, total``: how often a source, and its whole language, has a
    term of at least ``least`` documents; under an empty term all sources, with zeros."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        n_runs = sum(map(len, held))
        stretch = max(128, POOL_LINES // max(1, 2 * n_runs))
        runs = [Run(batch, row, stretch) for batch in held for row in range(len(batch))]
        for lines in merged_lines(runs):
            if (kept := kept_lines(lines, least)) is not None:
                yield from kept.to_batches(max_chunksize=1 << 16)

    return runs.repartition(shards, "shard").mapInArrow(merged, POSTINGS)


def index(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """The written postings of all kept terms, and the sources of each language."""
    return written(merge_runs(*index_runs(docs), least), "term-postings")


def _share(count: str, total: str) -> str:
    """``1 + floor(UNIT * (count + 1) / total)``, beyond 64 bits in decimals."""
    direct = f"(({count}) + 1) * {UNIT}L div ({total})"
    wide = f"cast(({count}) + 1 AS decimal(20, 0)) * {UNIT}BD div cast({total} AS decimal(20, 0))"
    return f"1 + CASE WHEN ({count}) < 9000000000 THEN {direct} ELSE cast({wide} AS bigint) END"


def _divergence(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"


def group_totals(postings: DataFrame) -> DataFrame:
    """``lang, source, place, n, v, lang_n, p0`` of every source of a language.

    ``place`` numbers the sources of a language, ``p0`` is the share of a term that
    the source does not hold.
    """
    sources = postings.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    terms = postings.filter("term != ''").groupBy("lang", "term").agg(F.first("total").alias("total"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("source"))
    p0 = F.expr(f"CASE WHEN v > 0 THEN {_share('0', 'n + v')} END")
    totals = sources.join(langs, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0).cast("bigint")))
    totals = totals.withColumn("place", place).withColumn("p0", p0)
    return written(totals.select("lang", "source", "place", "n", "v", "lang_n", "p0"), "source-totals")


def shares(postings: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, term, source, place, p, q, p0`` of every kept term that a source holds."""
    held = postings.filter("term != ''").withColumnRenamed("n", "n_term")
    p, q = _share("n_term", "n + v"), _share("total", "lang_n + v")
    return held.join(totals, ["lang", "source"]).select(
        "lang", "term", "source", "place", F.expr(p).alias("p"), F.expr(q).alias("q"), "p0"
    )


def term_divergences(held: DataFrame, ranks: int = TERM_RANKS) -> DataFrame:
    """``lang, source, item, value, rank``: terms that a source has more of than its language."""
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (
        held.filter("p > q")
        .select("lang", "source", F.col("term").alias("item"), F.expr(_divergence("p", "q")).alias("value"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= ranks)
    )


def _sums_of_pairs(held: dict[int, int], keys: np.ndarray, values: np.ndarray) -> None:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    for key, value in zip(keys[starts].tolist(), np.add.reduceat(values, starts).tolist()):
        held[key] = held.get(key, 0) + value


def pair_corrections(held: DataFrame) -> DataFrame:
    """``lang, a, b, value``: what terms that both sources hold change, per task.

    ``f(pa, pb) - f(pa, p0b) - f(p0a, pb) + f(p0a, p0b)`` for each such term.
    """
    terms = held.groupBy("lang", "term").agg(F.collect_list(F.struct("place", "p", "p0")).alias("s"))

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[int, int]] = {}

        def done() -> Iterator[pa.RecordBatch]:
            for lang, pairs in sums.items():
                keys = np.fromiter(pairs, np.int64, len(pairs))
                values = pa.array(list(pairs.values()), pa.int64())
                named = pa.array([lang] * len(keys), pa.string())
                arrays = [named, pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), values]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "a", "b", "value"])
            sums.clear()

        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            lists = batch.column("s")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            place, p, p0 = (flat.field(i).to_numpy().astype(np.int64) for i in range(3))
            size = np.repeat(sizes, sizes)  # of the list that an entry stands in
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            lang = np.repeat(langs.indices.to_numpy(), sizes)
            ends = np.cumsum(size)
            at = 0
            while at < len(size):  # each entry of a stretch meets its whole list
                base = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, side="right")))
                left = np.repeat(np.arange(at, to), size[at:to])
                inner = np.arange(len(left)) - np.repeat(ends[at:to] - size[at:to] - base, size[at:to])
                right = first[left] + inner
                left, right = left[left != right], right[left != right]
                a, a0, b, b0 = p[left], p0[left], p[right], p0[right]
                value = (a - b) ** 2 // b - (a - b0) ** 2 // b0 - (a0 - b) ** 2 // b + (a0 - b0) ** 2 // b0
                keys = place[left] << 32 | place[right]
                for code in np.unique(lang[at:to]).tolist():
                    own = lang[left] == code
                    if own.any():
                        pairs = sums.setdefault(langs.dictionary[code].as_py(), {})
                        _sums_of_pairs(pairs, keys[own], value[own])
                if sum(map(len, sums.values())) > SUMS_HELD:
                    yield from done()
                at = to
        yield from done()

    return terms.mapInArrow(streamed, "lang string, a bigint, b bigint, value bigint")


def pair_divergences(held: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, source, item, value, rank`` of every source and every other of its language."""
    place = F.col("place").cast("bigint")
    other = totals.select("lang", place.alias("y"), F.col("p0").alias("y0"), "v")
    base = (
        totals.select("lang", place.alias("x"), F.col("p0").alias("x0"))
        .join(other, "lang")
        .filter("x != y")
        .select("lang", F.col("x").alias("a"), F.col("y").alias("b"),
                F.expr(f"CASE WHEN v > 0 THEN v * ({_divergence('x0', 'y0')}) ELSE 0L END").alias("value"))
    )
    # Terms of one source alone, as many as have the same share: against each other source.
    alike = held.groupBy("lang", place.alias("x"), "p", F.col("p0").alias("x0")).agg(
        F.count(F.lit(1)).alias("h")
    )
    met = alike.join(other, "lang").filter("x != y")
    ahead = f"h * (({_divergence('p', 'y0')}) - ({_divergence('x0', 'y0')}))"
    behind = f"h * (({_divergence('y0', 'p')}) - ({_divergence('y0', 'x0')}))"
    both = f"""array(struct(x AS a, y AS b, {ahead} AS value),
        struct(y AS a, x AS b, {behind} AS value))"""
    single = met.select("lang", F.explode(F.expr(both)).alias("s")).select("lang", "s.*")
    sums = (
        base.unionByName(single)
        .unionByName(pair_corrections(held))
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("value"))
    )
    named = totals.select("lang", place.alias("a"), "source")
    items = totals.select("lang", place.alias("b"), F.col("source").alias("item"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (
        sums.join(named, ["lang", "a"])
        .join(items, ["lang", "b"])
        .select("lang", "source", "item", "value")
        .withColumn("rank", F.row_number().over(order))
    )


def report(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank``: divergences of pairs, and of terms."""
    postings = index(docs)
    totals = group_totals(postings)
    held = written(shares(postings, totals), "term-shares")
    parts = [
        df.withColumn("part", F.lit(name))
        for name, df in (("pair", pair_divergences(held, totals)), ("term", term_divergences(held)))
    ]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")
