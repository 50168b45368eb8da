"""Distances, search, fusion and reranking on rows made by hand and by brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from findling.functions.vectors import cosine_distance, euclidean_distance
from findling.operators import containment, dense, fusion, lexical

QUERY = "query_id bigint, tenant_id string, lang string, text string"
CHUNK = "tenant_id string, doc_id bigint, chunk_id string, lang string, text string"


def test_cosine_cases(spark):
    pairs = [
        ([1.0, 0.0], [0.0, 0.0], None),
        ([1.0, 2.0], [1.0, 2.0], 0.0),
        ([1.0, 2.0], [-1.0, -2.0], 2.0),
        ([1.0, 0.0], [0.0, 3.0], 1.0),
        ([1.0, 2.0], [10.0, 20.0], 0.0),
    ]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>, want double")
    for r in df.withColumn("got", cosine_distance(F.col("a"), F.col("b"))).collect():
        assert r.got == (None if r.want is None else pytest.approx(r.want, abs=1e-12))
    near = df.select(euclidean_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert near[3].d == pytest.approx(math.sqrt(10))


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("scoped", [True, False])
def test_block_and_broadcast_paths_equal_brute_force(spark, metric, scoped):
    rng = np.random.default_rng(3)
    base = np.round(rng.normal(size=(60, 4)), 1)
    rows = [(f"t{i % 3 // 2}", i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [("t0", 60 + i, rows[0][2]) for i in range(8)]  # exact copies tie on id
    rows.append(("t1", 90, [0.0] * 4))
    vectors = spark.createDataFrame(rows, "tenant_id string, v bigint, embedding array<double>")
    queries = vectors.withColumnRenamed("v", "q")
    if not scoped:
        queries, vectors = queries.drop("tenant_id"), vectors.drop("tenant_id")
    want = set()
    for tq, q, a in rows:
        found = []
        for tv, v, b in rows:
            if scoped and tq != tv:
                continue
            a_, b_ = np.array(a), np.array(b)
            if metric == "cosine":
                size = np.linalg.norm(a_) * np.linalg.norm(b_)
                if size == 0:
                    continue
                d = 1 - a_ @ b_ / size
            else:
                d = np.linalg.norm(a_ - b_)
            found.append((round(float(d), 6) + 0.0, v))
        want |= {(q, v, i + 1) for i, (d, v) in enumerate(sorted(found)[:5])}
    rank_by = dense.dense_topk if metric == "cosine" else dense.euclidean_topk
    for limit in (dense.QUERY_BYTES, 500):  # 500 bytes force the block path
        got = rank_by(queries, vectors, 5, "q", "v", max_query_bytes=limit).collect()
        assert {(r.q, r.v, r.rank) for r in got} == want


def test_brute_force_containment(spark):
    rnd = random.Random(5)
    vocab = ["ab", "abc", "b", "cab", "d", "é", "dé", "xyz"]
    texts = [" ".join(rnd.choices(vocab, k=rnd.randint(0, 12))) for _ in range(60)]
    texts[7] = texts[7].replace(" ", "\n", 1)
    patterns = ["", " ", "b", "a", "ab", "b c", "ab d", "é d", "xyz xyz", "b cab d", "c", "ab\nd"]
    patterns += [t[i : i + n] for t in texts[:25] for i, n in ((0, 7), (2, 9), (1, 15))]
    pt = spark.createDataFrame(list(enumerate(patterns)), "p bigint, text string")
    tt = spark.createDataFrame(list(enumerate(texts)), "t bigint, text string")
    got = [(r.p, r.t) for r in containment.containment_pairs(pt, tt, "p", "t").collect()]
    want = {(i, j) for i, p in enumerate(patterns) if p.split() for j, t in enumerate(texts) if p in t}
    assert len(got) == len(set(got)) and set(got) == want


def parsed_rows(spark, text):
    q = spark.createDataFrame([(1, "t", "en", text)], QUERY)
    rows = lexical.parse_websearch(q).orderBy("alt").collect()
    return [(r.grp, r.kind, list(r.terms), list(r.offsets)) for r in rows]


def test_web_search_forms(spark):
    assert parsed_rows(spark, "red blue") == [(1, "word", ["red"], [0]), (2, "word", ["blue"], [0])]
    assert parsed_rows(spark, '"red blue"') == [(1, "phrase", ["red", "blue"], [0, 1])]
    assert parsed_rows(spark, "red or blue green") == [
        (1, "word", ["red"], [0]), (1, "word", ["blue"], [0]), (2, "word", ["green"], [0]),
    ]
    assert parsed_rows(spark, 'red -"blue green"') == [
        (1, "word", ["red"], [0]), (2, "not", ["blue", "green"], [0, 1]),
    ]
    assert parsed_rows(spark, '"red of blue') == [(1, "phrase", ["red", "blue"], [0, 2])]
    assert parsed_rows(spark, "or red or") == [(2, "word", ["red"], [0])]
    assert parsed_rows(spark, "") == []
    assert parsed_rows(spark, "the and") == []


def chunks_of(spark, *texts, tenant="t"):
    return spark.createDataFrame(
        [(tenant, i, f"{i}:0", "en", t) for i, t in enumerate(texts)], CHUNK
    )


def matched(spark, chunks, text):
    q = spark.createDataFrame([(1, "t", "en", text)], QUERY)
    rows = lexical.lexical_match(lexical.parse_websearch(q), lexical.build_postings(chunks))
    return sorted(r.doc_id for r in rows.collect())


def test_lexical_match(spark):
    chunks = chunks_of(spark, "red blue green", "blue red", "red of blue", "green", "Red, BLUE!")
    assert matched(spark, chunks, "red blue") == [0, 1, 2, 4]
    assert matched(spark, chunks, '"red blue"') == [0, 4]
    assert matched(spark, chunks, '"red of blue"') == [2]
    assert matched(spark, chunks, "red or green") == [0, 1, 2, 3, 4]
    assert matched(spark, chunks, "red -green") == [1, 2, 4]
    assert matched(spark, chunks, 'blue -"red blue"') == [1, 2]
    assert matched(spark, chunks, "-green") == []


def test_postings_of_asked_terms_equal_the_full_ones(spark):
    chunks = chunks_of(spark, "red the red blue", "blue blue sky", "the of")
    full = lexical.build_postings(chunks)
    only = spark.createDataFrame([("t", "blue"), ("t", "red"), ("t", "blue")], "tenant_id string, term string")
    some = lexical.build_postings(chunks, only)
    keep = F.col("term").isin("blue", "red")
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, full.filter(keep).select(some.columns).collect()))
    wide = lexical.search_stats(full, chunks).filter(keep).drop("cf")
    assert sorted(map(tuple, lexical.asked_stats(chunks, only).select(wide.columns).collect())) == sorted(
        map(tuple, wide.collect())
    )
    row = full.filter("term = 'red'").first()
    assert (row.tf, list(row.positions), row.chunk_terms) == (2, [0, 2], 4)


def test_bm25_formula(spark):
    texts = ["red red blue", "blue sky sea", "sea"]
    chunks = chunks_of(spark, *texts)
    q = spark.createDataFrame([(1, "t", "en", "red blue")], QUERY)
    postings = lexical.build_postings(chunks)
    hits = lexical.bm25_topk(
        lexical.parse_websearch(q), postings, lexical.search_stats(postings, chunks), 5, "any"
    )
    mean = 7 / 3

    def part(tf, df, length):
        idf = math.log(1 + (3 - df + 0.5) / (df + 0.5))
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))

    want = {"0:0": round(part(2, 1, 3) + part(1, 2, 3), 6), "1:0": round(part(1, 2, 3), 6)}
    assert {r.chunk_id: r.score for r in hits.collect()} == want


def test_rrf_and_pool(spark):
    kind = "query_id bigint, chunk_id string, rank int"
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "p", 1)], kind)
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2), (2, "o", 1)], kind)
    got = {(r.query_id, r.chunk_id): (r.rank, r.score) for r in fusion.rrf_fuse(a, b).collect()}
    assert got[1, "y"] == (1, round(1 / 62 + 1 / 61, 6))
    assert got[1, "x"] == (2, round(1 / 61, 6)) and got[1, "z"] == (3, round(1 / 62, 6))
    assert got[2, "o"][0] == 1 and got[2, "p"][0] == 2  # a tie goes to the smaller id
    pool = {(r.query_id, r.chunk_id): (r.in_dense, r.in_lexical) for r in fusion.candidate_pool(a, b).collect()}
    assert pool[1, "y"] == (True, True) and pool[1, "x"] == (True, False) and pool[1, "z"] == (False, True)
    assert set(pool) == set(got)


def test_rerank_default_and_model(spark):
    chunks = chunks_of(spark, "blue red", "red blue", "sky")
    q = spark.createDataFrame([(1, "t", "en", "red blue")], QUERY)
    pool = spark.createDataFrame([(1, "0:0"), (1, "1:0"), (1, "2:0")], "query_id bigint, chunk_id string")
    rows = fusion.rerank(q, pool, chunks, k=2).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in rows] == [("1:0", 1.0), ("0:0", 0.6)]
    longest = lambda asked, texts: np.array([float(len(t)) for t in texts])
    rows = fusion.rerank(q, pool, chunks, longest, k=1).collect()
    assert [r.chunk_id for r in rows] == ["0:0"]


def test_the_rarest_pair_of_a_pattern_is_its_anchor(spark):
    texts = [(i, f"x of the common words {i} of the end") for i in range(200)]
    texts += [(1000, "so say of the common rare pair of the end now")]
    asked = [(1, "say of the common rare pair of the end"), (2, "a of the never met b"), (3, "of the common words")]
    tt = spark.createDataFrame(texts, "t bigint, text string")
    pt = spark.createDataFrame(asked, "p bigint, text string")
    found = containment.candidate_pairs(pt, tt, "p", "t").groupBy("_p").count().collect()
    assert {r._p: r["count"] for r in found} == {1: 1, 3: 201}
    got = containment.containment_pairs(pt, tt, "p", "t").collect()
    assert {(r.p, r.t, r["at"]) for r in got} == {(1, 1000, 4)} | {(3, i, 3) for i in range(200)}


def test_questions_go_to_the_blocks_of_their_tenant(spark):
    vec = F.array(F.rand(1), F.rand(2))
    side = lambda n, key: spark.range(n).select(
        (F.col("id") % 1000).cast("string").alias("tenant"), F.col("id").alias(key), vec.alias("vec")
    )
    hot = spark.range(400).select(F.lit("7").alias("tenant"), (F.col("id") + 10**6).alias("v"), vec.alias("vec"))
    asked, stored = side(1000, "q"), side(3000, "v").unionByName(hot)
    left, right = dense.tenant_blocks(asked, stored, 10_000, 80 * 20)
    assert left.count() < 1100 and right.count() == 3400
    assert left.filter("tenant = '7'").count() == 21  # 403 vectors, 20 a block


def test_words_are_grouped_in_blocks_of_chunks(spark, monkeypatch):
    """Odd texts, chunks of many words and blocks of few, against counting by hand."""
    monkeypatch.setattr(lexical, "WORDS_AT_ONCE", 7)
    rnd = random.Random(5)
    texts = [" ".join(rnd.choices("red blue the stone river".split(), k=n)) for n in (0, 1, 6, 30, 2, 2, 9)]
    rows = [("t", i, f"{i}:0", "en", t) for i, t in enumerate([*texts, None, "...", "red", "red"])]
    rows.append(("u", 50, "50:0", None, "the the"))
    want = set()
    for tenant, doc, chunk, lang, text in rows:
        words = [] if text in (None, "...") else text.split()
        for w in {w for w in words if w != "the" or lang is None}:
            places = tuple(i for i, x in enumerate(words) if x == w)
            want.add((tenant, w, chunk, doc, len(words), len(places), places))
        if text is not None:
            want.add((tenant, "", chunk, doc, len(words), 0, ()))
    chunks = spark.createDataFrame(rows, CHUNK).coalesce(1)
    got = lexical.build_postings(chunks, marked=True)
    assert got.count() == len(want) and {(*r[:6], tuple(r.positions)) for r in got.collect()} == want
    plain = lexical.build_postings(chunks)
    assert got.filter("term != ''").exceptAll(plain).count() == plain.filter("term = ''").count() == 0
    texted = chunks.filter("text IS NOT NULL")
    stats = lexical.search_stats(plain, texted)
    assert lexical.marked_stats(got).columns == stats.columns
    assert sorted(lexical.marked_stats(got).collect()) == sorted(stats.collect())


@pytest.mark.parametrize("match", ["any", "all"])
def test_postings_are_not_shuffled_to_meet_few_terms(spark, tmp_path, match):
    """Statistics too long to broadcast are cut to the asked terms before postings meet them."""
    rows = [("t", i, f"{i}:0", "xx", " ".join(f"w{i * 50 + k}" for k in range(50)) + " stone river") for i in range(300)]
    chunks = spark.createDataFrame(rows, CHUNK)
    lexical.build_postings(chunks).write.parquet(str(tmp_path / "p"))
    postings = spark.read.parquet(str(tmp_path / "p"))
    lexical.search_stats(postings, chunks).write.parquet(str(tmp_path / "s"))
    stats = spark.read.parquet(str(tmp_path / "s"))
    asked = spark.createDataFrame([(1, "t", "xx", "stone river")], QUERY)
    asked.write.parquet(str(tmp_path / "q"))
    parsed = lexical.parse_websearch(spark.read.parquet(str(tmp_path / "q")))
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "20000")
    try:
        hits = lexical.bm25_topk(parsed, postings, stats, 5, match)
        plan = hits._jdf.queryExecution().optimizedPlan().toString()
        physical = hits._jdf.queryExecution().executedPlan().toString()
        assert "LeftSemi" not in plan
        assert physical.count("SortMergeJoin") == (0 if match == "any" else physical.count("SortMergeJoin [query_id"))
        assert [r.rank for r in hits.orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_few_distances_are_computed_of_many_pairs(monkeypatch, metric):
    """Slabs of few vectors, ties, copies and zero vectors against all distances sorted."""
    rnd = np.random.Generator(np.random.PCG64(3))
    matrix = rnd.integers(-3, 4, (3000, 6)).astype(float)
    matrix[500:600], matrix[700] = matrix[499], 0
    matrix[1500:] = rnd.normal(size=(1500, 6))
    asked = matrix[::10]
    dist = dense._distances(asked, matrix, metric)
    want = {
        (10 * i, int(v), row[v])
        for i, row in enumerate(dist)
        for v in np.lexsort((np.arange(3000), row))[:7]
        if not np.isnan(row[v])
    }
    computed, plain = [], dense._pair_distances
    monkeypatch.setattr(dense, "CELLS", 100 * len(asked))
    monkeypatch.setattr(dense, "_pair_distances", lambda a, b, m: computed.append(len(a)) or plain(a, b, m))
    vectors = pd.DataFrame({"tenant": "", "v": np.arange(3000), "vec": list(matrix)}).sample(frac=1, random_state=1)
    queries = pd.DataFrame({"tenant": "", "q": np.arange(0, 3000, 10), "vec": list(asked)})
    got = dense._compare(dense._askers(queries), vectors, 7, metric)
    assert len(got) == len(want) and set(got.itertuples(index=False, name=None)) == want
    assert sum(computed) < dist.size // 20


def test_work_that_fits_in_memory_is_dealt_over_tasks(spark, monkeypatch):
    side = lambda n, key: spark.range(n).select(
        F.lit("t").alias("tenant"), F.col("id").alias(key), F.array(F.rand(1), F.rand(2)).alias("vec")
    )
    monkeypatch.setattr(dense, "PAIRS_A_TASK", 1000)
    for n_q, n_v in ((300, 300), (10, 3000)):
        left, right = dense.tenant_blocks(side(n_q, "q"), side(n_v, "v"), 10**6)
        pairs = left.groupBy("q_block", "v_block").count().join(
            right.groupBy("q_block", "v_block").agg(F.count(F.lit(1)).alias("m")), ["q_block", "v_block"]
        ).selectExpr("count * m AS n").toPandas()["n"]
        assert pairs.sum() == n_q * n_v and pairs.max() < 3000
    assert right.count() == 3000  # few questions go to the vectors' blocks, not the reverse


def test_postings_come_in_sorted_runs(spark, monkeypatch):
    """A batch's lines come by tenant and term, so that they are stored without a shuffle."""
    rnd = random.Random(9)
    rows = [(f"t{rnd.randrange(3)}", i, f"{i}:0", rnd.choice(["en", "de", "xx", None]), " ".join(rnd.choices("the der a b é z w und 7".split(), k=30)))
            for i in range(40)]
    chunks = spark.createDataFrame(rows, CHUNK).coalesce(1)
    got = [tuple(r) for r in lexical.build_postings(chunks).select("tenant_id", "term", "chunk_id", "positions").collect()]
    named = [(r[0], r[1]) for r in got]
    assert named == sorted(named)
    tokens = lexical.tokenize(chunks, "chunk_id").groupBy("chunk_id", "term").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    assert sorted((r[2], r[1], r[3]) for r in got) == sorted(tuple(r) for r in tokens.collect())
    key = np.array([5, 1 << 62, 5, 0, 1 << 62])  # too wide to be joined with its places
    order, ordered = lexical._order(key)
    assert order.tolist() == [3, 0, 2, 1, 4] and ordered.tolist() == key[order].tolist()


def test_the_vocabulary_is_cut_for_short_patterns_only(spark, monkeypatch):
    texts = spark.createDataFrame([("a", "one two three four five"), ("b", "two three")], "t string, text string")
    patterns = spark.createDataFrame([("p", "two three four"), ("q", "ne two three four fi")], "p string, text string")
    monkeypatch.setattr(containment, "_letter_runs", None)
    got = {(r.p, r.t, r.at) for r in containment.containment_pairs(patterns, texts, "p", "t").collect()}
    assert got == {("p", "a", 5), ("q", "a", 2)}
