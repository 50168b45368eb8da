"""Substring search over a stored table of character trigrams with their places.

Every character of a text begins one trigram; the last two are filled up with a code
that no character has. Any pattern is found by lists alone: one of three characters is
a trigram, a shorter one is the beginning of some, and a longer one holds several, of
which the rarest of the tenant are looked up and must stand at the distances they have
in the pattern. Only the texts of chunks left by that are read, and decide.

Trigrams are numbers of 63 bits, three code points of 21. The lists are laid out by a
bucket of tenant and trigram, as postings are: every task writes those of its chunks in
sorted runs, so nothing is shuffled and a long list is in parts. A search reads the
buckets its trigrams fall into.

Defined results: a null or empty pattern matches nothing, a null text holds nothing.
Places count characters from 1. Rows of one chunk id and text give the same places twice
over, of which the first is taken.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from findling.session import BUCKET_BYTES, stored_options, written

BUCKET, BUCKETS = "gram_bucket", 32
BITS = 21
FILL = (1 << BITS) - 1  # beyond the last code point
AT_ONCE = 1 << 21  # characters that a task holds as numbers
RAREST, SPREAD = 3, 16  # trigrams looked up of a pattern, the others at most so much longer
NAMED = 2000  # values that a scan is told by name


def _bucket():
    return F.pmod(F.xxhash64("tenant_id", "gram"), F.lit(BUCKETS)).cast("int")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of ``AT_ONCE`` characters together; a longer one is a run alone."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > AT_ONCE:
            yield first, i
            first, held = i, 0
        held += len(text)
    yield first, len(texts)


def placed_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, gram, place)`` of every character, by text, trigram and place."""
    fill = np.full(2, FILL, np.int64)
    codes = np.concatenate([part for t in texts for part in (_codes(t), fill)] or [fill])
    lengths = np.array([len(t) for t in texts], np.int64)
    grams = codes[:-2] << 2 * BITS | codes[1:-1] << BITS | codes[2:]
    begins = np.cumsum(lengths + 2) - lengths - 2
    owner = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    gram = grams[begins[owner] + place] if len(owner) else np.zeros(0, np.int64)
    order = np.lexsort((place, gram, owner))
    return owner[order], gram[order], place[order] + 1


def _listed(texts: list[str], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same by group of texts, trigram, text and place."""
    fill = np.full(2, FILL, np.int64)
    codes = np.concatenate([part for t in texts for part in (_codes(t), fill)] or [fill])
    lengths = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # The characters that occur are numbered in order, so that trigram and place fit one number.
    there = np.zeros(FILL + 1, bool)
    there[codes] = True
    signs = np.flatnonzero(there)
    number = np.zeros(FILL + 1, np.int64)
    number[signs] = np.arange(len(signs))
    codes, width = number[codes], len(signs).bit_length()
    grams = (codes[:-2] << 2 * width | codes[1:-1] << width | codes[2:])[place + owner * 2 + (np.cumsum(lengths) - lengths)[owner]]
    bits, high = max(len(grams), 1).bit_length(), int(group.max(initial=0)).bit_length()
    if high + 3 * width + bits <= 63:
        both = np.sort((group[owner] << 3 * width | grams) << bits | np.arange(len(grams)))
        order, grams = both & ((1 << bits) - 1), both >> bits & ((1 << 3 * width) - 1)
    else:
        order = np.lexsort((grams, group[owner]))
        grams = grams[order]
    low = (1 << width) - 1
    gram = signs[grams >> 2 * width] << 2 * BITS | signs[grams >> width & low] << BITS | signs[grams & low]
    return owner[order], gram, place[order] + 1


def build_lists(chunks: DataFrame) -> DataFrame:
    """``(tenant_id, gram, n_places, chunk_ids, places)``: the lists of neighbouring chunks of
    ``AT_ONCE`` characters, which come sorted by tenant and trigram, without a shuffle."""
    kinds = {f.name: f.dataType for f in chunks.schema.fields}
    schema = T.StructType(
        [
            T.StructField("tenant_id", kinds["tenant_id"]),
            T.StructField("gram", T.LongType()),
            T.StructField("n_places", T.LongType()),
            T.StructField("chunk_ids", T.ArrayType(kinds["chunk_id"])),
            T.StructField("places", T.ArrayType(T.ArrayType(T.IntegerType()))),
        ]
    )

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            named = batch.column(0).dictionary_encode()
            order = np.append(pc.array_sort_indices(named.dictionary).to_numpy(), len(named.dictionary))
            tenant = np.argsort(order)[named.indices.fill_null(len(named.dictionary)).to_numpy(zero_copy_only=False)]
            for first, last in _runs(texts):
                owner, gram, place = _listed(texts[first:last], tenant[first:last])
                group = tenant[first:last][owner]
                new = np.ones(len(owner), bool)
                new[1:] = (group[1:] != group[:-1]) | (gram[1:] != gram[:-1])
                heads = np.flatnonzero(new)
                new[1:] |= owner[1:] != owner[:-1]
                chunk = np.flatnonzero(new)
                ends = pa.array(np.searchsorted(chunk, np.append(heads, len(owner))), pa.int32())
                held = pa.ListArray.from_arrays(pa.array(np.append(chunk, len(owner)), pa.int32()), pa.array(place, pa.int32()))
                columns = [
                    batch.column(0).take(pa.array(owner[heads] + first)),
                    pa.array(gram[heads]),
                    pa.array(np.diff(np.append(heads, len(owner)))),
                    pa.ListArray.from_arrays(ends, batch.column(1).take(pa.array(owner[chunk] + first))),
                    pa.ListArray.from_arrays(ends, held),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return chunks.select("tenant_id", "chunk_id", "text").mapInArrow(lists, schema)


def opened(lists: DataFrame) -> DataFrame:
    """``(tenant_id, chunk_id, gram, places)``, and the bucket of stored lists: a row per chunk."""
    stored = [c for c in (BUCKET,) if c in lists.columns]
    rows = lists.select("tenant_id", "gram", *stored, F.explode(F.arrays_zip("chunk_ids", "places")).alias("one"))
    return rows.select("tenant_id", F.col("one")["chunk_ids"].alias("chunk_id"), "gram", F.col("one")["places"].alias("places"), *stored)


def build_grams(chunks: DataFrame) -> DataFrame:
    """``(tenant_id, chunk_id, gram, places)``, made inside each chunk, without a shuffle."""
    return opened(build_lists(chunks))


def gram_stats(grams: DataFrame) -> DataFrame:
    """How many places each trigram of a tenant has, of lists or of single chunks."""
    n = F.col("n_places") if "n_places" in grams.columns else F.size("places")
    return grams.groupBy("tenant_id", "gram").agg(F.sum(n).alias("n_places"))


def store_grams(chunks: DataFrame, base: str) -> tuple[str, str]:
    """Write lists and their sizes to fresh folders below ``base``; returns them."""
    spark, name = chunks.sparkSession, uuid.uuid4().hex
    folders = f"{base}/grams-{name}", f"{base}/gram-stats-{name}"

    def write(df: DataFrame, folder: str) -> None:
        writer = df.write.mode("errorifexists").options(**stored_options(BUCKET_BYTES))
        writer.partitionBy(BUCKET).parquet(folder)

    # Lists come in sorted runs, which the writer's stable sort by bucket keeps.
    write(build_lists(chunks).withColumn(BUCKET, _bucket()), folders[0])
    sizes = gram_stats(spark.read.parquet(folders[0])).withColumn(BUCKET, _bucket())
    write(sizes.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, "tenant_id", "gram"), folders[1])
    return folders


def open_grams(spark: SparkSession, folders: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    return opened(spark.read.parquet(folders[0])), spark.read.parquet(folders[1])


def _named(df: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """``df`` cut to the values that ``names`` has in ``columns``, where those are few."""
    few = names.select(*columns).distinct().limit(NAMED + 1).collect()
    if len(few) > NAMED:
        return df
    for c in columns:
        df = df.filter(F.col(c).isin(sorted({r[c] for r in few if r[c] is not None})))
    return df


def pattern_grams(patterns: DataFrame) -> DataFrame:
    """``(query_id, tenant_id, n, gram, offset)``: the trigrams within each pattern of three
    characters or more, and of a shorter one the code it begins with."""
    kinds = {f.name: f.dataType for f in patterns.schema.fields}
    schema = T.StructType(
        [
            T.StructField("query_id", kinds["query_id"]),
            T.StructField("tenant_id", kinds["tenant_id"]),
            T.StructField("n", T.LongType()),
            T.StructField("gram", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for first, last in _runs(texts):
                part = texts[first:last]
                owner, gram, place = placed_grams(part)
                n = np.array([len(t) for t in part], np.int64)[owner]
                whole = (place <= n - 2) | ((n < 3) & (place == 1))
                owner, gram, place, n = owner[whole], gram[whole], place[whole], n[whole]
                gram = np.where(n < 3, gram >> BITS * np.clip(3 - n, 0, 2), gram)
                rows = pa.array(owner + first)
                columns = [batch.column(0).take(rows), batch.column(1).take(rows)]
                columns += [pa.array(x.astype(np.int64)) for x in (n, gram, place - 1)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return patterns.select("query_id", "tenant_id", "text").mapInArrow(cut, schema)


def looked_up(patterns: DataFrame, stats: DataFrame) -> DataFrame:
    """``(query_id, tenant_id, n, gram, offset, bit, needed)``: the lists to read, rarest first,
    each with a bit of its own.

    A pattern with a trigram that its tenant has nowhere is not looked up at all.
    """
    cut = written(pattern_grams(patterns), "pattern-grams")
    one = ["query_id", "tenant_id"]
    long = cut.filter("n >= 3").withColumn(BUCKET, _bucket())
    by = [BUCKET, "tenant_id", "gram"]
    held = _named(stats, long, BUCKET)
    sized = long.groupBy(*one, "n", *by).agg(F.min("offset").alias("offset")).join(held, by, "left")
    rarest = W.partitionBy(*one)
    chosen = (
        sized.withColumn("least", F.min("n_places").over(rarest))
        .withColumn("absent", F.max(F.col("n_places").isNull()).over(rarest))
        .filter("NOT absent")
        .withColumn("rank", F.row_number().over(rarest.orderBy("n_places", "offset")))
        .filter((F.col("rank") <= RAREST) & (F.col("n_places") <= SPREAD * F.col("least")))
        .withColumn("needed", F.count(F.lit(1)).over(rarest))
        .select(*one, "n", "gram", "offset", F.expr("shiftleft(1, rank - 1)").alias("bit"), "needed")
    )
    begins = F.array(*[F.struct(F.lit(n).alias("n"), F.shiftright("gram", BITS * (3 - n)).alias("head")) for n in (1, 2)])
    short = cut.filter("n < 3").withColumnRenamed("gram", "head")
    heads = stats.select("tenant_id", "gram", F.inline(begins))
    begun = heads.join(written(short, "short-patterns"), ["tenant_id", "n", "head"])
    return chosen.unionByName(begun.select(*one, "n", "gram", "offset", F.lit(1).alias("bit"), F.lit(1).alias("needed")))


def candidates(patterns: DataFrame, grams: DataFrame, stats: DataFrame) -> DataFrame:
    """``(query_id, tenant_id, n, chunk_id, at)``: places at which the looked-up trigrams of a
    pattern stand as they do in it; of one of up to three characters, which its lists decide
    alone, the first. No text is read."""
    asked = written(looked_up(patterns, stats).withColumn(BUCKET, _bucket()), "looked-up")
    near = _named(grams, asked, BUCKET)
    near = _named(near, asked, "tenant_id", "gram")
    decided = F.col("n") <= 3
    places = F.when(decided, F.slice("places", 1, 1)).otherwise(F.col("places"))
    at = F.col("place") - F.col("offset")
    return (
        near.join(asked, [BUCKET, "tenant_id", "gram"])
        .select("query_id", "tenant_id", "n", "needed", "chunk_id", "bit", "offset", F.explode(places).alias("place"))
        .groupBy("query_id", "tenant_id", "n", "needed", "chunk_id", F.when(~decided, at).alias("one"))
        .agg(F.min(at).alias("at"), F.bit_count(F.bit_or("bit")).alias("met"))
        .filter("(n < 3 OR met = needed) AND at >= 1")
        .select("query_id", "tenant_id", "n", "chunk_id", "at")
    )


def substring_search(
    patterns: DataFrame, chunks: DataFrame, grams: DataFrame, stats: DataFrame
) -> DataFrame:
    """``(query_id, chunk_id, at)`` of every chunk of the tenant that holds the pattern as it
    stands; ``at`` is where it does first. Texts are read of candidates only."""
    found = candidates(patterns, grams, stats).withColumn("doubtful", F.expr("n > 3"))
    found = written(found, "candidates", "doubtful")  # apart, as texts meet the doubtful ones alone
    doubtful = found.filter("doubtful")
    asked = patterns.select("query_id", "tenant_id", F.col("text").alias("pattern"))
    bodies = _named(chunks.select("tenant_id", "chunk_id", "text"), doubtful, "tenant_id", "chunk_id")
    checked = (
        bodies.join(doubtful, ["tenant_id", "chunk_id"])
        .join(asked, ["query_id", "tenant_id"])
        .filter(F.substring("text", F.col("at").cast("int"), F.col("n").cast("int")) == F.col("pattern"))
    )
    kept = found.filter("NOT doubtful").select("query_id", "chunk_id", "at")
    return (
        kept.unionByName(checked.select("query_id", "chunk_id", "at"))
        .groupBy("query_id", "chunk_id")
        .agg(F.min("at").cast("bigint").alias("at"))
    )
