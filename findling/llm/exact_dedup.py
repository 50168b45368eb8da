"""Exact deduplication that shuffles only rows a Bloom filter calls possibly repeated.

Pass one sets two bits per text, counted over all rows, and keeps as a filter
the bits that were set more than once. Pass two tests every row against that
filter: a text with a bit that nobody else has set is alone and goes straight
on; the others, true repeats and a few false alarms, meet by their SHA-256.
Pass one shuffles the filter's bits, two small numbers a row, counted within tasks
before. A filter of up to ``BROADCAST_BLOCKS`` blocks (16.8 million rows) travels as a
broadcast; beyond that slim rows, keys without texts, meet it by a shuffle.

``drop_exact_copies`` moves whole rows, so it decides on keys alone which texts are
repeated and puts those into a second filter, which is as large as the repeats are
many. Whole rows only ever meet that one, by a broadcast: if it has more than
``BROADCAST_BLOCKS`` blocks, it is cut into as many ranges as that takes, and each range
reads the rows once more. No row whose text is alone is shuffled, at any size.

Defined results: a null text counts as empty. Texts are equal when their bytes
are. Of equal texts the row with the largest id stays, a null id being the
smallest; of rows that share text and id, one stays. An empty table gives an
empty table. Columns of any name may come along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findling.session import written

BLOCK_BITS = 32768  # the width of Spark's bitmaps: 4096 bytes
BITS_PER_ROW = 32
SALTS = 16  # parts that the rows of one text are split into where they meet
BROADCAST_BLOCKS = 16384  # 64 MB, the most that one broadcast holds


def _body(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def filter_blocks(n_rows: int) -> int:
    """Blocks of a filter with ``BITS_PER_ROW`` bits for each of so many rows."""
    return max(1, -(-n_rows * BITS_PER_ROW // BLOCK_BITS))


def _block(key: str, n_blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 30), F.lit(n_blocks))


def _bits(key: str) -> tuple[Column, Column]:
    mask = F.lit(BLOCK_BITS - 1)
    return F.col(key).bitwiseAND(mask), F.shiftright(key, 15).bitwiseAND(mask)


def repeat_filter(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """``(block, bits)``: the bits that more than one row of ``keys`` has set.

    Only bit positions are shuffled, counted within each task before.
    """
    first, second = _bits(key)
    positions = keys.select(
        _block(key, n_blocks).alias("block"),
        F.explode(F.array_distinct(F.array(first, second))).alias("bit"),
    )
    return (
        positions.groupBy("block", "bit")
        .count()
        .filter("count > 1")
        .groupBy("block")
        .agg(F.bitmap_construct_agg(F.col("bit")).alias("bits"))
    )


def _is_set(bits: Column, position: Column) -> Column:
    place = F.shiftright(position, 3).cast("int") + 1
    byte = F.conv(F.hex(F.substring(bits, place, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def mark_possible_repeats(rows: DataFrame, key: str, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: false only if no other row has this ``key``."""
    n_blocks = filter_blocks(rows.count())
    held = written(repeat_filter(rows.select(key), key, n_blocks), "repeat-filter")
    held = held.withColumnsRenamed({"block": "__block", "bits": "__bits"})
    if n_blocks <= BROADCAST_BLOCKS:
        held = F.broadcast(held)
    first, second = _bits(key)
    bits = F.col("__bits")
    return (
        rows.withColumn("__block", _block(key, n_blocks))
        .join(held, "__block", "left")
        .withColumn(
            flag, F.coalesce(_is_set(bits, first) & _is_set(bits, second), F.lit(False))
        )
        .drop("__block", "__bits")
    )


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: which of the equal texts stays, and how many there are.

    ``doc_id, keep_id, group_size, kept, text_sha256``.
    """
    slim = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(_body(text)).alias("__key"),
        F.sha2(_body(text), 256).alias("text_sha256"),
    )
    marked = mark_possible_repeats(slim, "__key", "__maybe")
    alone = marked.filter("NOT __maybe").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    counted = marked.filter("__maybe").groupBy("text_sha256", "doc_id").agg(
        F.count(F.lit(1)).alias("__copies")
    )
    groups = counted.groupBy("text_sha256").agg(
        F.max("doc_id").alias("keep_id"), F.sum("__copies").alias("group_size")
    )
    # A group may hold a third of all rows: they are dealt over salts, to each of
    # which the group's one line is copied.
    salted = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = (
        counted.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        .join(salted, ["text_sha256", "__salt"])
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__copy") == 1)).alias("kept"),
            "text_sha256",
        )
    )
    return alone.unionByName(met)


def repeated_keys(keys: DataFrame, key: str) -> DataFrame:
    """``(key)``, distinct: those that more than one row of ``keys`` has.

    Keys the filter calls possibly repeated are counted, within each task first.
    """
    marked = mark_possible_repeats(keys.select(F.col(key).alias("key")), "key", "maybe")
    return marked.filter("maybe").groupBy("key").count().filter("count > 1").select("key")


def key_filter(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """``(block, bits)``: the bits of all ``keys``, which are distinct."""
    first, second = _bits(key)
    return (
        keys.select(_block(key, n_blocks).alias("block"), F.explode(F.array(first, second)).alias("bit"))
        .groupBy("block")
        .agg(F.bitmap_construct_agg(F.col("bit")).alias("bits"))
    )


def drop_exact_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_blocks: int | None = None
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows alone with their text pass without a shuffle. The others are reduced
    within each task first, so that a group of any size sends one row per task.
    At most ``most_blocks`` blocks of 4 kB are broadcast at once (``BROADCAST_BLOCKS``);
    each range of so many, 16.8 million repeated texts as it stands, reads ``docs`` once.
    """
    most = BROADCAST_BLOCKS if most_blocks is None else most_blocks
    # The row travels as one struct, so that no column of it can meet the names used here.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(row, F.xxhash64(_body(f"`{text}`")).alias("key"))
    repeated = written(repeated_keys(keyed, "key"), "repeated-keys")
    n_blocks = filter_blocks(repeated.count())
    held = written(key_filter(repeated, "key", n_blocks), "repeated-filter")
    ranges = -(-n_blocks // most)
    first, second = _bits("key")
    in_filter = F.coalesce(_is_set(F.col("bits"), first) & _is_set(F.col("bits"), second), F.lit(False))
    order = F.struct(F.col("row")[doc_id].isNotNull(), F.col("row")[doc_id])

    def stay(part: int) -> DataFrame:
        """What stays of the rows whose block lies in one range."""
        within = F.col("block") % ranges == part
        marked = (
            keyed.withColumn("block", _block("key", n_blocks))
            .filter(within)
            .join(F.broadcast(held.filter(within)), "block", "left")
            .withColumn("maybe", in_filter)
        )
        met = (
            marked.filter("maybe")
            .groupBy(F.sha2(F.coalesce(F.col("row")[text], F.lit("")), 256).alias("sha"))
            .agg(F.max_by("row", order).alias("row"))
        )
        return marked.filter("NOT maybe").select("row.*").unionByName(met.select("row.*"))

    return reduce(DataFrame.unionByName, [stay(part) for part in range(ranges)])
