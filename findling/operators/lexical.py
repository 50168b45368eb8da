"""Postings, web-style queries and BM25."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from findling.functions.arrays import let, running_before
from findling.functions.stems import stemmed
from findling.functions.text import is_stop_word, placed_tokens, steady, stop_word_marks, token_stop_words, word_tokens
from findling.session import written

K1, B = 1.2, 0.75
TERM_BUCKET, BUCKETS = "term_bucket", 32  # how stored postings are laid out
NAMED_TERMS = 2000  # asked terms that a scan is told by name
WORDS_AT_ONCE = 1 << 20  # words that a task groups at once


def term_bucket() -> Column:
    """The bucket of a tenant's term."""
    return F.pmod(F.xxhash64("tenant_id", "term"), F.lit(BUCKETS)).cast("int")


def terms_of(text: Column, lang: str = "lang", stem: bool = False) -> Column:
    """The words of a text, or their stems; questions and postings must choose alike."""
    words = word_tokens(text)
    return stemmed(words, F.col(lang)) if stem else words


def tokenize(
    df: DataFrame, key: str, text: str = "text", lang: str = "lang", stem: bool = False
) -> DataFrame:
    """One row per word that is no stop word of its language.

    Positions are counted before stop words are dropped.
    """
    # A plain explode would test the array for emptiness first, and split every text twice.
    words = F.posexplode_outer(terms_of(F.col(text), lang, stem)).alias("pos", "term")
    rows = df.select(key, lang, words).filter("pos IS NOT NULL")
    return rows.filter(~is_stop_word("term", lang)).select(key, "pos", "term")


def build_postings(
    chunks: DataFrame, only: DataFrame | None = None, marked: bool = False, stem: bool = False
) -> DataFrame:
    """``(tenant_id, term, chunk_id, doc_id, chunk_terms, tf, positions)``.

    ``chunk_terms`` is the length of the chunk in words, stop words included. Chunks
    that know their ``uploaded_at`` pass it on. With ``marked`` every chunk has one
    line more, under the empty term, from which totals can be taken.
    Without ``only`` this is the whole index: a chunk is one row, so its words are
    grouped by sorting inside that row and nothing is shuffled. With ``only``, a
    table of ``(tenant_id, term)``, all other words are dropped as they are read
    and just the rest is grouped; that serves a search over chunks not indexed.
    """
    dated = ["uploaded_at"] if "uploaded_at" in chunks.columns else []
    ids = ("tenant_id", "chunk_id", "doc_id", "lang", *dated)
    split = chunks.select(*ids, terms_of(F.col("text"), stem=stem).alias("words"))
    is_term = ~is_stop_word("term", "lang")
    if only is not None:
        return (
            split.select(
                *ids,
                F.size("words").alias("chunk_terms"),
                # A plain explode would have Spark test the array for emptiness first,
                # and split every text twice for it. The join drops the null row.
                F.posexplode_outer("words").alias("pos", "term"),
            )
            .join(only.select("tenant_id", "term"), ["tenant_id", "term"], "left_semi")
            .filter(is_term)
            .groupBy("tenant_id", "term", "chunk_id", "doc_id", "chunk_terms", *dated)
            .agg(
                F.count(F.lit(1)).cast("int").alias("tf"),
                F.sort_array(F.collect_list("pos")).alias("positions"),
            )
        )

    rows = _grouped(split, ids, marked)
    columns = ("tenant_id", "term", "chunk_id", "doc_id", "chunk_terms", "tf", "positions")
    return rows.select(*columns, *dated)


def _ranks(values: pa.DictionaryArray) -> np.ndarray:
    """The place of every value among those of its dictionary in order; nulls come last."""
    places = np.empty(len(values.dictionary) + 1, np.int64)
    places[pc.array_sort_indices(values.dictionary).to_numpy()] = np.arange(len(values.dictionary))
    places[-1] = len(values.dictionary)
    return places[values.indices.fill_null(len(values.dictionary)).to_numpy(zero_copy_only=False)]


def _order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What sorts ``key``, equal ones as they stand, and the sorted key."""
    bits = max(len(key), 1).bit_length()
    if len(key) and int(key.max()).bit_length() + bits > 63:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = np.sort(key << bits | np.arange(len(key)))  # numbers sort faster than their order is found
    return both & ((1 << bits) - 1), both >> bits


def _grouped(split: DataFrame, ids: tuple[str, ...], marked: bool) -> DataFrame:
    """A row per chunk and word of it that is no stop word, with its places; neighbouring chunks
    of ``WORDS_AT_ONCE`` words at a time, whose rows come sorted by tenant and word."""
    fields = [
        *(split.schema[c] for c in ids),
        T.StructField("chunk_terms", T.IntegerType()),
        T.StructField("term", T.StringType()),
        T.StructField("tf", T.IntegerType()),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
    ]
    names, stops = [f.name for f in fields], token_stop_words()

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(ids))
            there = lists.is_valid().to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy()))
            words = lists.flatten().dictionary_encode()
            codes, tenant = _ranks(words), _ranks(batch.column(0).dictionary_encode())
            spoken = batch.column(ids.index("lang")).dictionary_encode()
            lang = spoken.indices.fill_null(len(spoken.dictionary)).to_numpy(zero_copy_only=False)
            known = max(len(words.dictionary), 1)
            by_name = words.dictionary.take(pc.array_sort_indices(words.dictionary))
            marks = stop_word_marks(by_name, spoken, stops)
            first = 0
            while first < len(lists):
                last = max(int(np.searchsorted(ends, ends[first] + WORDS_AT_ONCE, "right")) - 1, first + 1)
                sizes = np.diff(ends[first : last + 1])
                row = np.repeat(np.arange(last - first), sizes)
                place = np.arange(len(row)) - np.repeat(ends[first:last] - ends[first], sizes)
                code = codes[ends[first] : ends[last]]
                kept = ~marks[lang[first:last][row], code]
                row, place, code = row[kept], place[kept], code[kept]
                order, key = _order(tenant[first:last][row] * known + code)
                row, place = row[order], place[order]
                heads = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]))[: len(key)])
                chunk, term = row[heads], by_name.take(pa.array(key[heads] % known))
                starts = np.append(heads, len(key))
                if marked:
                    every = np.flatnonzero(there[first:last])
                    chunk = np.append(chunk, every)
                    term = pa.concat_arrays([term, pa.array([""] * len(every), term.type)])
                    starts = np.append(starts, np.full(len(every), len(key)))
                taken = pa.array(chunk + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).take(taken) for i in range(len(ids))),
                        pa.array(sizes[chunk], pa.int32()),
                        term,
                        pa.array(np.diff(starts), pa.int32()),
                        pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(place, pa.int32())),
                    ],
                    names,
                )
                first = last

    return split.select(*ids, "words").mapInArrow(lines, T.StructType(fields))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Number of chunks and their total length in words, per tenant."""
    return chunks.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(F.size(word_tokens(F.col("text")))).alias("n_terms"),
    )


def term_stats(postings: DataFrame) -> DataFrame:
    """Document frequency and total occurrences of every term of a tenant."""
    return postings.groupBy("tenant_id", "term").agg(
        F.count_if(F.col("tf") > 0).alias("df"), F.sum("tf").alias("cf")
    )


def search_stats(postings: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(tenant_id, term, df, cf, n_chunks, n_terms)`` of the whole index."""
    return term_stats(postings).join(corpus_stats(chunks), "tenant_id")


def marked_stats(marked: DataFrame) -> DataFrame:
    """The same from postings with a line per chunk under the empty term: no text is read again."""
    counts = written(
        marked.groupBy("tenant_id", "term").agg(
            F.count_if(F.col("tf") > 0).alias("df"), F.sum("tf").alias("cf"),
            F.count(F.lit(1)).alias("n_chunks"), F.sum("chunk_terms").alias("n_terms"),
        ),
        "term-counts",
    )
    totals = counts.filter("term = ''").select("tenant_id", "n_chunks", "n_terms")
    return counts.filter("term != ''").drop("n_chunks", "n_terms").join(totals, "tenant_id")


def asked_stats(chunks: DataFrame, only: DataFrame, stem: bool = False) -> DataFrame:
    """The same without ``cf`` for the terms ``only`` names, in one pass over the chunks.

    Every chunk also counts under the empty term, which yields the totals of its
    tenant beside the counts of the terms.
    """
    empty = F.lit("")
    asked = only.select("tenant_id", "term")
    keyed = chunks.select("tenant_id", "lang", terms_of(F.col("text"), stem=stem).alias("words")).select(
        "tenant_id",
        "lang",
        F.size("words").alias("n"),
        F.explode(F.concat(F.array(empty), F.array_distinct("words"))).alias("term"),
    )
    counts = (
        keyed.join(
            asked.unionByName(asked.withColumn("term", empty)), ["tenant_id", "term"], "left_semi"
        )
        .filter(~is_stop_word("term", "lang"))
        .groupBy("tenant_id", "term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("n"))
    )
    tenant, total = W.partitionBy("tenant_id"), F.col("term") == ""
    return (
        counts.withColumn("n_chunks", F.max(F.when(total, F.col("df"))).over(tenant))
        .withColumn("n_terms", F.max(F.when(total, F.col("n"))).over(tenant))
        .filter(~total)
        .drop("n")
    )


def parse_websearch(queries: DataFrame, stem: bool = False) -> DataFrame:
    """Query strings to rows ``(query_id, grp, alt, kind, terms, offsets)``.

    Bare words are all required, ``"..."`` asks for neighbours, ``or`` joins
    alternatives, a leading ``-`` excludes. Rows of one ``grp`` are alternatives.
    A word that splits into several terms is asked for as a phrase. Stop words
    vanish but keep their place between the words of a phrase.
    """
    # "or" joins only when something stands on both sides of it; what it joins
    # does not open a group of its own.
    joins = "transform(raw, (x, i) -> lower(x) = 'or' AND i > 0 AND i < size(raw) - 1)"
    opens = "transform(joins, (j, i) -> if(j OR (i > 0 AND get(joins, i - 1)), 0, 1))"
    groups = running_before("opens")
    numbered = let(
        groups,
        "before",
        """transform(raw, (x, i) -> struct(cast(get(before, i) + get(opens, i) AS int) AS grp,
             i + 1 AS alt, get(joins, i) AS joins, x AS item))""",
    )
    items = queries.select(
        "query_id",
        "tenant_id",
        "lang",
        F.array_remove(
            F.regexp_extract_all("text", F.lit(r'(-?"[^"]*"?|[^\s"]+)'), F.lit(1)), ""
        ).alias("raw"),
    )
    items = (
        items.withColumn("joins", F.expr(joins))
        .withColumn("opens", F.expr(opens))
        .select("query_id", "tenant_id", "lang", F.explode(F.expr(numbered)).alias("i"))
        .filter(~F.col("i")["joins"])
    )
    parsed = (
        items.select(
            "query_id",
            "tenant_id",
            "lang",
            F.col("i")["grp"].alias("grp"),
            F.col("i")["alt"].alias("alt"),
            F.col("i")["item"].startswith("-").alias("negated"),
            terms_of(F.col("i")["item"], stem=stem).alias("words"),
        )
        .withColumn("placed", placed_tokens("words", "lang"))
        .filter(F.size("placed") > 0)
    )
    base = F.get("placed", F.lit(0))["pos"]
    return parsed.select(
        "query_id",
        "tenant_id",
        "grp",
        "alt",
        F.when(F.col("negated"), "not")
        .when(F.size("placed") > 1, "phrase")
        .otherwise("word")
        .alias("kind"),
        F.transform("placed", lambda p: p["term"]).alias("terms"),
        F.transform("placed", lambda p: p["pos"] - base).alias("offsets"),
    )


def asked_terms(parsed: DataFrame) -> DataFrame:
    """``(tenant_id, term)`` of everything the queries name, exclusions included.

    Repeats stay: the table only serves semi-joins.
    """
    return parsed.select("tenant_id", F.explode("terms").alias("term"))


def query_terms(parsed: DataFrame) -> DataFrame:
    """Distinct required terms of each query."""
    return (
        parsed.filter(F.col("kind") != "not")
        .select("query_id", "tenant_id", F.explode("terms").alias("term"))
        .distinct()
    )


def only_asked(parsed: DataFrame, *stored: DataFrame) -> list[DataFrame]:
    """Stored tables cut to what can hold the asked terms.

    The folders they fall into are always named, at most ``BUCKETS`` of them. Few terms,
    ``NAMED_TERMS`` at most, are named themselves with their tenants: rows are sorted by
    both, so that the files' own statistics skip the rest. One short list comes to the
    driver for all tables. A table not laid out by bucket stays as it is.
    """
    if not any(TERM_BUCKET in df.columns for df in stored):
        return list(stored)
    asked = asked_terms(parsed).distinct().withColumn("b", term_bucket())
    named = asked.limit(NAMED_TERMS + 1).collect()
    within = F.lit(True)
    if len(named) <= NAMED_TERMS:
        tenants, terms = ({r[c] for r in named if r[c] is not None} for c in ("tenant_id", "term"))
        within = F.col("tenant_id").isin(sorted(tenants)) & F.col("term").isin(sorted(terms))
    else:
        named = asked.select("b").distinct().collect()
    within = within & F.col(TERM_BUCKET).isin(sorted({r.b for r in named}))
    return [df.filter(within) if TERM_BUCKET in df.columns else df for df in stored]


def _placed(terms: DataFrame, postings: DataFrame) -> tuple[DataFrame, list[str]]:
    """Asked terms with the bucket they are stored in, if the postings have any, and the keys
    to meet them by: only the buckets that occur are then read."""
    if TERM_BUCKET not in postings.columns:
        return terms, ["tenant_id", "term"]
    return terms.withColumn(TERM_BUCKET, term_bucket()), [TERM_BUCKET, "tenant_id", "term"]


def lexical_match(parsed: DataFrame, postings: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, doc_id)`` satisfying all groups and no exclusion.

    Queries that only exclude match nothing.
    """
    asked = parsed.select(
        "query_id",
        "tenant_id",
        "grp",
        "alt",
        "kind",
        F.size("terms").alias("n_terms"),
        F.explode(F.arrays_zip("terms", "offsets")).alias("t"),
    ).select(
        "query_id",
        "tenant_id",
        "grp",
        "alt",
        "kind",
        "n_terms",
        F.col("t")["terms"].alias("term"),
        F.col("t")["offsets"].alias("off"),
    )
    asked, keys = _placed(asked, postings)
    asked = written(asked, "asked")  # short, and known to be: postings are not shuffled to meet it
    found = postings.join(asked, keys).select(
        "query_id",
        "grp",
        "alt",
        "kind",
        "n_terms",
        "chunk_id",
        "doc_id",
        "off",
        F.when(
            F.col("n_terms") > 1, F.transform("positions", lambda p: p - F.col("off"))
        ).alias("origins"),
    )
    # A phrase stands where the origins of all its terms meet. The lists are as
    # many as the phrase has terms, each at most one chunk long. Both groupings
    # below share this one shuffle.
    meeting = F.aggregate(
        F.slice("lists", F.lit(2), F.greatest(F.size("lists") - 1, F.lit(0))),
        F.get("lists", F.lit(0)),
        lambda acc, x: F.array_intersect(acc, x),
    )
    stands = (F.col("n_terms") == 1) | (
        (F.size("lists") == F.col("n_terms")) & (F.size(meeting) > 0)
    )
    held = (
        found.repartition("query_id", "chunk_id")
        .groupBy("query_id", "grp", "alt", "kind", "n_terms", "chunk_id", "doc_id")
        .agg(F.collect_list("origins").alias("lists"))
        .filter(stands)
    )
    needed = (
        parsed.filter(F.col("kind") != "not")
        .groupBy("query_id")
        .agg(F.countDistinct("grp").alias("n_groups"))
    )
    positive = F.when(F.col("kind") != "not", F.col("grp"))
    excluded = F.max(F.col("kind") == "not")
    return (
        held.groupBy("query_id", "chunk_id", "doc_id")
        .agg(F.countDistinct(positive).alias("n_held"), excluded.alias("excluded"))
        .join(needed, "query_id")
        .filter((F.col("n_held") == F.col("n_groups")) & ~F.col("excluded"))
        .select("query_id", "chunk_id", "doc_id")
    )


def bm25_topk(
    parsed: DataFrame,
    postings: DataFrame,
    stats: DataFrame,
    k: int,
    match: str = "all",
) -> DataFrame:
    """The best ``k`` chunks of each query by BM25, ties by chunk id.

    ``match='all'`` ranks what ``lexical_match`` accepts; ``'any'`` ranks every
    chunk holding one required term. Postings meet the short list of asked terms with
    their weights, which drops those of other terms.
    """
    wanted, keys = _placed(query_terms(parsed), postings)
    wanted = written(wanted, "wanted")  # short: statistics of other terms are not even added up
    stats = stats.join(wanted.select(*keys), keys, "left_semi")
    idf = F.log(
        F.lit(1.0) + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    )
    # A short list, written so that Spark knows it may be broadcast: postings are not shuffled.
    weights = stats.select(
        *keys, idf.alias("idf"), (F.col("n_terms") / F.col("n_chunks")).alias("mean_terms")
    )
    weighted = written(wanted.join(weights, keys).select(*keys, "query_id", "idf", "mean_terms"), "weighted")
    tf = F.col("tf")
    scale = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("chunk_terms") / F.col("mean_terms"))
    part = F.col("idf") * tf * (K1 + 1) / (tf + scale)
    scored = (
        postings.select(*keys, "chunk_id", "doc_id", "chunk_terms", "tf")
        .join(weighted, keys)
        .select("query_id", "chunk_id", "doc_id", part.alias("part"))
        .groupBy("query_id", "chunk_id", "doc_id")
        .agg(steady(F.sum("part")).alias("score"))
    )
    if match == "all":
        scored = scored.join(lexical_match(parsed, postings), ["query_id", "chunk_id", "doc_id"])
    elif match != "any":
        raise ValueError(f"match must be 'all' or 'any', not {match!r}")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "chunk_id", "doc_id", "rank", "score")
    )
