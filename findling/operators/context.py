"""Packing context, citing it, and managing conversation history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from findling.functions.text import (
    coverage,
    drop_stop_words,
    sentences,
    steady,
    whitespace_tokens,
    word_tokens,
)

CITATION = r"\[(\d+), Page (\d+)\]"


def pack_context(hits: DataFrame, budget: int) -> DataFrame:
    """Hits in rank order while their tokens fit; the first overflow ends the pack.

    Expects ranked hits, a few per query, with ``n_tokens``.
    """
    running = (
        W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return hits.withColumn("used_tokens", F.sum("n_tokens").over(running)).filter(
        F.col("used_tokens") <= budget
    )


def cite(hits: DataFrame) -> DataFrame:
    """Append ``[<document>, Page <n>]``, the page being the chunk's first."""
    return hits.withColumn("citation", F.format_string("[%d, Page %d]", "doc_id", "page_no"))


def extractive_answer(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Per question the best sentence of every packed chunk, each with its citation.

    A deterministic stand-in for a generated answer.
    """
    asked = queries.select(
        "query_id", "lang", word_tokens(F.col("text")).alias("words")
    ).select("query_id", F.array_distinct(drop_stop_words("words", "lang")).alias("wanted"))
    order = W.partitionBy("query_id", "chunk_id").orderBy(F.desc("score"), "pos")
    best = (
        cite(hits)
        .select("query_id", "chunk_id", "rank", "citation", "text")
        .join(asked, "query_id")
        .select(
            "query_id",
            "chunk_id",
            "rank",
            "citation",
            "wanted",
            F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"),
        )
        .withColumn("score", steady(coverage(F.col("wanted"), word_tokens(F.col("sentence")))))
        .withColumn("nth", F.row_number().over(order))
        .filter(F.col("nth") == 1)
    )
    line = F.concat("sentence", F.lit(" "), "citation")
    return (
        best.groupBy("query_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"),
            F.count(F.lit(1)).alias("n_cited"),
        )
        .select(
            "query_id",
            F.array_join(F.transform("lines", lambda x: x["line"]), " ").alias("answer"),
            "n_cited",
        )
    )


def check_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Citations of each answer that do, and do not, point at a retrieved page."""
    cited = answers.select(
        "query_id", F.explode_outer(F.regexp_extract_all("answer", F.lit(CITATION), F.lit(0))).alias("c")
    ).select(
        "query_id",
        F.regexp_extract("c", CITATION, 1).try_cast("bigint").alias("doc_id"),
        F.regexp_extract("c", CITATION, 2).try_cast("int").alias("page_no"),
        F.col("c").isNotNull().alias("is_cited"),
    )
    known = hits.select("query_id", "doc_id", "page_no").distinct().withColumn("known", F.lit(True))
    flag = F.coalesce("known", F.lit(False))
    return (
        cited.join(known, ["query_id", "doc_id", "page_no"], "left")
        .groupBy("query_id")
        .agg(
            F.count_if(F.col("is_cited") & flag).alias("n_supported"),
            F.count_if(F.col("is_cited") & ~flag).alias("n_unsupported"),
        )
    )


def _recent_cut(turns: DataFrame, n_turns: int) -> DataFrame:
    """The newest ``n_turns`` turns of each conversation; a bounded rank, cut before the shuffle."""
    newest = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= n_turns)


def history_window(conv: DataFrame, n_turns: int, budget: int) -> DataFrame:
    """The last ``n_turns`` turns, cut to ``budget`` tokens counted from the newest.

    System turns are always kept and not counted.
    """
    counted = conv.withColumn("n_tokens", F.size(whitespace_tokens(F.col("text"))))
    running = (
        W.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, 0)
    )
    spoken = (
        _recent_cut(counted.filter(F.col("role") != "system"), n_turns)
        .withColumn("used_tokens", F.sum("n_tokens").over(running))
        .filter(F.col("used_tokens") <= budget)
        .drop("age")
    )
    fixed = counted.filter(F.col("role") == "system").withColumn(
        "used_tokens", F.lit(None).cast("bigint")
    )
    return spoken.unionByName(fixed)


def history_summary(conv: DataFrame, n_turns: int, segment: int = 512) -> DataFrame:
    """Turns older than the last ``n_turns``: count, tokens and their first sentences in order.

    One row per conversation. A long one is first summed up by ``segment`` turn
    numbers, in different tasks; only the segments' summaries meet.
    """
    first = F.coalesce(F.get(sentences(F.col("text")), F.lit(0)), F.lit(""))
    spoken = conv.filter(F.col("role") != "system").select(
        "conv_id",
        F.floor(F.col("turn") / segment).alias("segment"),
        "turn",
        F.size(whitespace_tokens(F.col("text"))).alias("n_tokens"),
        first.alias("first"),
    )
    cut = (
        _recent_cut(spoken.select("conv_id", "turn"), n_turns)
        .groupBy("conv_id")
        .agg(F.min("turn").alias("oldest_kept"))
    )
    older = spoken.join(cut, "conv_id").filter(F.col("turn") < F.col("oldest_kept"))
    joined = F.array_join(F.transform("firsts", lambda x: x["first"]), " | ")
    segments = (
        older.groupBy("conv_id", "segment")
        .agg(
            F.count(F.lit(1)).alias("n_turns"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sort_array(F.collect_list(F.struct("turn", "first"))).alias("firsts"),
        )
        .select("conv_id", "segment", "n_turns", "n_tokens", joined.alias("part"))
    )
    parts = F.sort_array(F.collect_list(F.struct("segment", "part")))
    return segments.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"),
        F.sum("n_tokens").alias("n_tokens"),
        F.array_join(F.transform(parts, lambda x: x["part"]), " | ").alias("summary"),
    )


def compact_prompt(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Collapse blanks and drop repeated lines, keeping the first of each."""
    lines = F.filter(
        F.transform(
            F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f]+", " "))
        ),
        lambda x: x != "",
    )
    return df.select(
        key,
        F.array_join(F.array_distinct(lines), "\n").alias("compact"),
        F.size(whitespace_tokens(F.col("text"))).alias("tokens_before"),
    ).withColumn("tokens_after", F.size(whitespace_tokens(F.col("compact"))))
