"""Near-duplicates by SimHash, found through an index over fingerprint bytes.

A fingerprint has eight bytes at fixed positions. Two fingerprints that differ
in at most three bits differ in at most three bytes, so they share five or more
by position, and three or more within the first or the second half. The index
lists fingerprints under each three positions of a half (eight lists each, of
24 bits). Standing in a list together is what tallies a pair: three shared
positions of a half at once, in place of counting them list by list. Members are
then compared on their whole fingerprints, by shared positions and by bits; the
bits decide, as so few of them leave five positions alike anyway. No pair within
the distance is lost, and nothing is capped.

Equal fingerprints are one entry. A list longer than a block is cut into
blocks that meet two by two in different tasks. Each task walks through the
verified links and gives out a spanning forest, never all pairs.

Defined results: a null text has no words and fingerprint zero. The component
of documents without any id is null. Rows sharing an id are one document to
``drop_near_copies``, which never drops a row without an id. An empty table
gives an empty table. Extra columns are ignored, or kept by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from findling.llm.common import broadcast_if_small
from findling.session import written

WORDS = 3
SEED = 42
MAX_BITS = 3
BLOCK = 2048
SHORT_LIST = 16
SHINGLES_AT_ONCE = 1 << 16
SMALL_LOSERS = 2_000_000

N_BYTES = 8
LEAST_SHARED = N_BYTES - MAX_BITS
#: Of any five of eight positions three lie in one half.
LISTS = [p for half in (range(4), range(4, 8)) for p in combinations(half, 3)]


def shingles(text: bytes, n: int = WORDS) -> list[bytes]:
    """Runs of ``n`` lower-cased words; of fewer words the one run there is."""
    words = text.lower().split()  # of bytes: A-Z, and ASCII white space, alone
    if len(words) < n:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(n)))))


def _bits(runs: list[bytes]) -> np.ndarray:
    digests = b"".join(xxh64_digest(r, SEED) for r in runs)
    return np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)


def _majorities(runs: list[bytes], sizes: list[int]) -> np.ndarray:
    """Fingerprints of texts that have ``sizes`` of the ``runs`` each, in order; none gives zero."""
    out = np.zeros(len(sizes), np.uint64)
    counts = np.array(sizes, np.int64)
    filled = np.nonzero(counts)[0]
    if len(filled):
        starts = np.concatenate([[0], np.cumsum(counts[filled])[:-1]])
        ones = np.add.reduceat(_bits(runs), starts, axis=0, dtype=np.int64)
        packed = np.packbits(2 * ones > counts[filled, None], axis=1)
        out[filled] = packed.view(">u8")[:, 0]
    return out


def _long_majority(runs: list[bytes], most: int) -> np.ndarray:
    """The same of one long text, ``most`` hashes at a time."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(runs), most):
        ones += _bits(runs[at : at + most]).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(runs)).view(">u8").astype(np.uint64)


def fingerprints_of(texts: Iterator[bytes], most: int = SHINGLES_AT_ONCE) -> np.ndarray:
    """The majority of each bit over the hashes of all shingles, text by text."""
    parts, waiting, sizes = [np.zeros(0, np.uint64)], [], []
    for text in texts:
        runs = shingles(text)
        if len(waiting) + len(runs) > most:
            parts.append(_majorities(waiting, sizes))
            waiting, sizes = [], []
        if len(runs) > most:
            parts.append(_long_majority(runs, most))
        else:
            waiting += runs
            sizes.append(len(runs))
    return np.concatenate([*parts, _majorities(waiting, sizes)])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every whole text, as a signed number."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() or b"" for t in batch.column("text").cast(pa.large_binary()))
            fp = fingerprints_of(texts).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(hashed, "doc_id bigint, fp bigint")


def index_entries(distinct: DataFrame) -> DataFrame:
    """``key, fp``: each fingerprint under every list that it stands in."""
    keys = []
    for number, positions in enumerate(LISTS):
        mask = sum(0xFF << 8 * (N_BYTES - 1 - p) for p in positions)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.xxhash64(F.lit(number), F.col("fp").bitwiseAND(F.lit(signed))))
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _blocked(entries: DataFrame, block: int) -> DataFrame:
    """``entries`` with ``i, j``: in long lists every two blocks meet, elsewhere all entries."""
    long = (
        entries.groupBy("key").count().filter(F.col("count") > block)
        .select("key", F.ceil(F.col("count") / block).cast("int").alias("n"))
    )
    joined = entries.join(broadcast_if_small(written(long, "long-lists"), 1_000_000), "key", "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    meets = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: k != F.col("b")),
        lambda k: F.struct(F.least(k, F.col("b")).alias("i"), F.greatest(k, F.col("b")).alias("j")),
    )
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    return (
        joined.withColumn("b", mine)
        .withColumn("m", F.explode(F.when(F.col("n").isNull(), alone).otherwise(meets)))
        .select("key", "m.i", "m.j", "fp")
    )


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether fingerprints link: enough shared positions first, then the bits."""
    differ = a ^ b
    folded = differ | differ >> np.uint64(4)
    folded |= folded >> np.uint64(2)
    folded |= folded >> np.uint64(1)
    shared = N_BYTES - np.bitwise_count(folded & np.uint64(0x0101010101010101))
    return (shared >= LEAST_SHARED) & (np.bitwise_count(differ) <= MAX_BITS)


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """``(place, root's place)`` of all that hang together among many fingerprints."""
    n = len(fps)
    near = np.zeros((n, n), bool)
    for at in range(0, n, 256):
        near[at : at + 256] = linked(fps[at : at + 256, None], fps[None, :])
    left = near.sum(1) > 1
    edges = []
    while left.any():
        root = int(np.argmax(left))
        left[root] = False
        front = np.array([root])
        while len(front):
            front = np.nonzero(near[front].any(0) & left)[0]
            left[front] = False
            edges += [(int(k), root) for k in front]
    return edges


def links(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a, b`` with ``a > b``: links that connect all fingerprints within the distance."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_keys, kept_fps = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")], 1)
            keys = np.concatenate([kept_keys, keys])
            fps = np.concatenate([kept_fps, batch.column("fp").to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            last = int(np.nonzero((keys != keys[-1]).any(1))[0][-1]) + 1 if (keys != keys[-1]).any() else 0
            yield _pairs(keys[:last], fps[:last])
            kept_keys, kept_fps = keys[last:], fps[last:]
        yield _pairs(kept_keys, kept_fps)

    return (
        _blocked(entries, block)
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInArrow(meet, "a bigint, b bigint")
        .distinct()
    )


def _pairs(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
    """Links among the runs of equal keys: pair by pair in short runs, as a forest in long ones."""
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    if len(fps) > 1:
        starts = np.concatenate([[0], np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1, [len(fps)]])
        sizes = np.diff(starts)
        run = np.repeat(np.arange(len(sizes)), sizes)
        short = np.nonzero((sizes[run] > 1) & (sizes[run] <= SHORT_LIST))[0]
        for step in range(1, SHORT_LIST):
            first = short[short + step < len(fps)]
            first = first[run[first] == run[first + step]]
            if not len(first):
                break
            first = first[linked(fps[first], fps[first + step])]
            a.append(fps[first])
            b.append(fps[first + step])
        for k in np.nonzero(sizes > SHORT_LIST)[0]:
            part = fps[starts[k] : starts[k + 1]]
            edges = np.array(forest(part), np.int64).reshape(-1, 2)
            a.append(part[edges[:, 0]])
            b.append(part[edges[:, 1]])
    left, right = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.maximum(left, right)), pa.array(np.minimum(left, right))], ["a", "b"]
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of every node on the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang every node and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def smallest_connected(edges: DataFrame) -> DataFrame:
    """``a, b``: every node with edges but the smallest of its component, and that smallest.

    Star contraction; every round is written to the shared folder, so that a
    lost executor costs one round at most.
    """
    before = None
    while True:
        edges = written(_small_star(_large_star(edges)), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges
        before = now


def components(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest id reachable over links, itself included."""
    prints = written(fingerprints(docs), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    edges = written(links(index_entries(distinct.select("fp")), block), "links")
    hung = smallest_connected(edges).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = distinct.join(hung, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(roots, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return components(docs).select("doc_id", digits.alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one of smallest id."""
    losers = components(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    losers = written(losers, "near-copies")
    return docs.join(broadcast_if_small(losers, SMALL_LOSERS), "doc_id", "left_anti").select(
        *docs.columns
    )
