"""Ranking by closeness: minimal covers of a question's parts, distances and prefixes.

A question is a row of parts that all must occur. ``word`` asks for a word, ``word*``
for any word that begins so, and ``a <3> b`` for ``b`` exactly three words behind ``a``
(``<1>`` is the next word); words joined by distances are one part. A cover is a
stretch of a chunk that holds every part, and minimal if no shorter cover lies inside
it. A chunk scores ``1 / (1 + words of the stretch that no part needs)`` for each of its
minimal covers, so it ranks by how often and how closely the parts stand together.

Covers are found where a chunk's positions are, which its postings list: at most one
chunk's words for one question. Stop words are not asked for and keep their place
between distances. A question without any other word matches nothing.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from findling.functions.text import is_stop_word, steady
from findling.operators.lexical import TERM_BUCKET, term_bucket
from findling.session import written

HEAD = 2  # characters by which prefixes meet terms; a shorter prefix is asked as it is


def parse_proximity(queries: DataFrame) -> DataFrame:
    """``query_id, tenant_id, grp, off, term, prefix``: words of one part share ``grp``.

    ``off`` is a word's distance from the first one of its part.
    """
    step = """CASE
        WHEN x RLIKE '^<[0-9]{1,4}>$' THEN named_struct('grp', s.grp, 'off', s.off,
            'gap', cast(substring(x, 2, length(x) - 2) AS int), 'out', s.out)
        WHEN s.gap IS NOT NULL AND s.grp > 0 THEN named_struct('grp', s.grp, 'off', s.off + s.gap,
            'gap', cast(NULL AS int), 'out', concat(s.out, array(struct(s.grp AS grp, s.off + s.gap AS off, x AS item))))
        ELSE named_struct('grp', s.grp + 1, 'off', 0, 'gap', cast(NULL AS int),
            'out', concat(s.out, array(struct(s.grp + 1 AS grp, 0 AS off, x AS item)))) END"""
    start = """named_struct('grp', 0, 'off', 0, 'gap', cast(NULL AS int),
        'out', cast(array() AS array<struct<grp: int, off: int, item: string>>))"""
    word = r"(<[0-9]{1,4}>|[\p{L}\p{N}]+\*?)"
    items = queries.select(
        "query_id", "tenant_id", "lang", F.regexp_extract_all(F.lower("text"), F.lit(word), F.lit(1)).alias("xs")
    ).select("query_id", "tenant_id", "lang", F.explode(F.expr(f"aggregate(xs, {start}, (s, x) -> {step}, s -> s.out)")).alias("i"))
    words = items.select(
        "query_id", "tenant_id", "lang", "i.grp", "i.off",
        F.rtrim(F.col("i")["item"], F.lit("*")).alias("term"), F.col("i")["item"].endswith("*").alias("prefix"),
    )
    return words.filter(F.col("prefix") | ~is_stop_word("term", "lang")).drop("lang")


def expand_prefixes(parsed: DataFrame, terms: DataFrame) -> DataFrame:
    """Every prefix replaced by the terms of its tenant that begin with it.

    ``terms`` holds ``tenant_id, term``. Prefixes and terms meet by their first letters.
    """
    head = F.substring("term", 1, HEAD)
    asked = parsed.filter("prefix").withColumn("head", head).withColumnRenamed("term", "asked")
    known = terms.select("tenant_id", "term").filter("term != ''").withColumn("head", head)
    long = asked.filter(F.length("asked") >= HEAD).join(known, ["tenant_id", "head"])
    short = asked.filter(F.length("asked") < HEAD).drop("head").join(known.drop("head"), "tenant_id")
    found = long.drop("head").unionByName(short).filter(F.col("term").startswith(F.col("asked")))
    return parsed.filter("NOT prefix").drop("prefix").unionByName(found.drop("asked", "prefix"))


def cover_score(lists: str) -> Column:
    """The closeness of one chunk's positions, a list for each part."""

    @F.arrow_udf("double")
    def score(lists: pa.Array) -> pa.Array:
        return pa.array([_covers(row or []) for row in lists.to_pylist()], pa.float64())

    return score(lists)


def _covers(lists: list[list[int]]) -> float:
    n, total, emitted = len(lists), 0.0, None
    last: dict[int, int] = {}
    events = heapq.merge(*([(p, part) for p in sorted(own)] for part, own in enumerate(lists)))
    events = list(events)
    for at, (place, part) in enumerate(events):
        last[part] = place
        if at + 1 < len(events) and events[at + 1][0] == place:
            continue  # parts that begin at one word count together
        if len(last) == n and (begin := min(last.values())) != emitted:
            emitted = begin
            total += 1.0 / (1 + max(place - begin + 1 - n, 0))
    return total


def cover_density(parsed: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """``query_id, chunk_id, doc_id, rank, score``: the best ``k`` chunks that hold all parts.

    ``parsed`` names terms only (``expand_prefixes``); ties are ranked by chunk.
    """
    keys = ["tenant_id", "term"]
    if TERM_BUCKET in postings.columns:
        parsed, keys = parsed.withColumn(TERM_BUCKET, term_bucket()), [TERM_BUCKET, *keys]
    parts = parsed.select("query_id", "grp", "off").distinct()
    sizes = parts.groupBy("query_id", "grp").agg(F.count(F.lit(1)).alias("n_words"))
    needed = sizes.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_parts"))
    begins = F.transform("positions", lambda p: p - F.col("off"))
    found = (
        postings.join(written(parsed, "asked-words"), keys)
        .select("query_id", "chunk_id", "doc_id", "grp", "off", begins.alias("begins"))
        .repartition("query_id", "chunk_id")  # all groupings below share this shuffle
    )
    chunk = ["query_id", "chunk_id", "doc_id"]
    words = found.groupBy(*chunk, "grp", "off").agg(
        F.array_distinct(F.flatten(F.collect_list("begins"))).alias("begins")
    )
    meeting = F.aggregate(
        F.slice("lists", F.lit(2), F.greatest(F.size("lists") - 1, F.lit(0))),
        F.get("lists", F.lit(0)),
        lambda acc, x: F.array_intersect(acc, x),
    )
    held = (
        words.groupBy(*chunk, "grp").agg(F.collect_list("begins").alias("lists"))
        .join(sizes, ["query_id", "grp"])
        .filter(F.size("lists") == F.col("n_words"))
        .withColumn("begins", meeting)
        .filter(F.size("begins") > 0)
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return (
        held.groupBy(*chunk).agg(F.collect_list("begins").alias("lists"))
        .join(needed, "query_id")
        .filter(F.size("lists") == F.col("n_parts"))
        .select(*chunk, steady(cover_score("lists")).alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(*chunk, "rank", "score")
    )
