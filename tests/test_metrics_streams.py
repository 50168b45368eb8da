"""Statistics, limits and streams."""

import bisect
import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from findling.operators import ingest, lexical, limits, metrics, selection
from findling.operators.selection import exact_percentiles
from findling.plans import hybrid
from findling.sources import documents as src
from findling.sources import index_store
from findling.streaming import jobs

FOLDER = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


@pytest.mark.parametrize("shape", ["normal", "heavy", "ties", "small"])
def test_percentiles_are_exact(spark, shape):
    rng = np.random.default_rng(1)
    values = {
        "normal": rng.normal(size=5000),
        "heavy": rng.pareto(0.5, size=5000),
        "ties": np.r_[np.zeros(3000), np.ones(10), np.full(990, 7.0)],
        "small": np.array([1.0, 2.0, 10.0]),
    }[shape]
    rows = [("a", float(v)) for v in values] + [("b", 5.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    points = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for most in (1_000_000, 40):  # the second has every bracket narrowed
        got = {r.g: r for r in exact_percentiles(df, ["g"], "v", points, most).collect()}
        for name, q in points.items():
            assert got["a"][name] == pytest.approx(float(np.quantile(values, q)), rel=1e-12, abs=1e-12)
            assert got["b"][name] == 5.0


def test_a_rank_outside_its_bracket_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(selection, "SMALL", 0)
    monkeypatch.setattr(
        selection, "_first_brackets",
        lambda data, keys, points: data.groupBy(*keys).agg(
            F.count("*").alias("_n"), F.lit(0.0).alias("_low_p50"), F.lit(1.0).alias("_high_p50")
        ),
    )
    df = spark.range(100).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    with pytest.raises(Exception, match="outside its bracket"):
        exact_percentiles(df, ["g"], "v", {"p50": 0.5}).collect()


def test_sketched_latency_is_close(spark):
    traces = src.scan_traces(spark, FOLDER)
    exact = {(r.stage, r.day): r for r in metrics.latency_breakdown(traces).collect()}
    close = metrics.latency_breakdown(traces, exact=False).collect()
    assert len(close) == len(exact)
    for r in close:
        same = exact[r.stage, r.day]
        assert (r.n, r.mean_latency, r.error_share) == (same.n, same.mean_latency, same.error_share)
        assert r.p50 <= same.p95 and r.p99 >= same.p50


def test_tool_arguments_that_do_not_parse(spark):
    rows = [('{"k": 1}',), ('{"k": 1, "z": 2}',), ('{"z": 2}',), ("{bad",), (None,)]
    df = spark.createDataFrame(rows, "args string").select(
        "args", F.lit(2.0).alias("latency"), F.lit(True).alias("failed")
    )
    got = {r.arg: (r.n_calls, r.n_failed) for r in metrics.tool_call_stats(df).collect()}
    assert got == {1: (2, 2), None: (3, 3)}


def test_retrieval_metrics_by_hand(spark):
    hits = spark.createDataFrame(
        [(1, 10, 1), (1, 10, 2), (1, 11, 3), (1, 12, 4), (2, 10, 1), (3, 10, 1)],
        "query_id bigint, doc_id bigint, rank int",
    )
    qrels = spark.createDataFrame(
        [(1, 11), (1, 99), (2, 50), (4, 1)], "query_id bigint, doc_id bigint"
    )
    got = {r.query_id: r for r in metrics.retrieval_metrics(hits, qrels, 2).collect()}
    assert set(got) == {1, 2, 4}  # query 3 has nothing relevant
    assert (got[1].recall, got[1].precision, got[1].mrr) == (0.5, 0.5, 0.5)
    assert got[1].ndcg == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3)), abs=1e-6)
    assert (got[2].recall, got[4].ndcg) == (0.0, 0.0)


def events(spark, offsets):
    """Events at micros after the start."""
    rows = [(i, START + timedelta(microseconds=m), u) for i, (u, m) in enumerate(offsets)]
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint")


def test_rate_limit_edges(spark):
    w = 60_000_000
    got = limits.rate_limit(events(spark, [(1, 0), (1, w), (2, 0), (2, w - 1), (3, 5), (3, 5)]), 1, 60)
    assert {r.event_id: (r.attempts, r.throttled) for r in got.collect()} == {
        0: (1, False), 1: (1, False), 2: (1, False), 3: (2, True), 4: (2, True), 5: (2, True),
    }


@pytest.mark.parametrize("slot_windows", [1, 2, 7])
def test_rate_limit_slots_do_not_show(spark, slot_windows):
    rng = np.random.default_rng(2)
    offsets = [(1, int(m)) for m in rng.integers(0, 3_000_000_000, 400)]
    got = limits.rate_limit(events(spark, offsets), 3, 60, slot_windows).collect()
    times = [m for _, m in offsets]
    want = {i: sum(m - 60_000_000 < x <= m for x in times) for i, m in enumerate(times)}
    assert {r.event_id: r.attempts for r in got} == want


def test_late_events_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "in")
    hours = [[0, 5], [30], [1, 29]]  # the 1 arrives behind the watermark
    for i, some in enumerate(hours):
        rows = [(h, START + timedelta(hours=h), 1, "view", 1.0, "{}") for h in some]
        part = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
        part.coalesce(1).write.parquet(f"{folder}/{i}")
    for i in range(3):
        name = next(f for f in os.listdir(f"{folder}/{i}") if f.endswith(".parquet"))
        os.link(f"{folder}/{i}/{name}", str(tmp_path / f"events{i}.parquet"))
        os.utime(tmp_path / f"events{i}.parquet", (1000 + i, 1000 + i))
    stream = jobs.stream_events(spark, str(tmp_path), max_files=1)
    out = jobs.run_available(jobs.stream_rate_windows(stream, "1 hour", "1 hour", "2 hours"), "late")
    got = {r.window_start.hour + 24 * (r.window_start.day - 1) for r in out.collect()}
    assert 0 in got and 5 in got and 1 not in got


def test_admission_equals_its_model(spark):
    out = jobs.run_available(
        jobs.stream_admission(jobs.stream_events(spark, FOLDER), 2, 24 * 3600), "admission"
    )
    got = {r.event_id: r.admitted for r in out.collect()}
    width, admitted, want = 24 * 3600 * 1_000_000, {}, {}
    micros = F.unix_micros(F.col("ts").cast("timestamp")).alias("m")
    rows = src.scan_events(spark, FOLDER).select("event_id", "user_id", micros).collect()
    for r in sorted(rows, key=lambda r: (r.m, r.event_id)):
        kept = admitted.setdefault(r.user_id, [])
        ok = len(kept) - bisect.bisect_right(kept, r.m - width) < 2
        want[r.event_id] = ok
        if ok:
            kept.append(r.m)
    assert got == want and not all(want.values())


def test_stream_ingest_twice_changes_nothing(spark, tmp_path):
    limit = ingest.MAX_UPLOAD_BYTES
    for _ in range(2):
        for start, name in ((jobs.stream_ingest, "chunks"), (jobs.stream_statuses, "statuses")):
            docs = jobs.stream_documents(spark, FOLDER)
            start(docs, str(tmp_path / name), str(tmp_path / f"{name}-log"), limit).awaitTermination()
    docs = src.scan_documents(spark, FOLDER)
    fit = ingest.validate_uploads(docs, limit).filter("status = 'PENDING'")
    want = ingest.chunk_fixed(fit).select("chunk_id", F.md5("text"))
    chunks = index_store.read_chunks(spark, str(tmp_path / "chunks"))
    got = chunks.select("chunk_id", F.md5("text"))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    seen = jobs.ingested_status(index_store.read_chunks(spark, str(tmp_path / "statuses")), chunks)
    states = {r.status: r.n for r in seen.groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert sum(states.values()) == docs.count() and set(states) == {"READY", "REJECTED"}
    assert seen.filter("status = 'REJECTED' AND reason IS NULL").count() == 0


def files_in_turn(spark, tmp_path, name, parts, schema):
    """Write each of ``parts`` as one file, to be read in this order."""
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(parts):
        part = spark.createDataFrame(rows, schema)
        part.coalesce(1).write.parquet(str(tmp_path / f"made{i}"))
        made = next(f for f in os.listdir(tmp_path / f"made{i}") if f.endswith(".parquet"))
        os.link(tmp_path / f"made{i}" / made, tmp_path / "in" / f"{name}{i}.parquet")
        os.utime(tmp_path / "in" / f"{name}{i}.parquet", (1000 + i, 1000 + i))


def test_two_streams_are_read_together(spark, tmp_path):
    doc = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    files_in_turn(spark, tmp_path, "documents", [[(1, "a b", "en", "s", 3)], [(2, "c", "en", "s", 1)]], doc)
    folders = []
    for i in range(2):
        docs = jobs.stream_documents(spark, str(tmp_path / "in"), f"documents{i}.parquet")
        folders.append(str(tmp_path / f"out{i}"))
        jobs.stream_ingest(docs, folders[-1], str(tmp_path / f"log{i}"), 100, dim=8).awaitTermination()
    assert {r.doc_id for r in index_store.read_chunks(spark, *folders).collect()} == {1, 2}


def test_streams_read_tables_of_several_files(spark, tmp_path):
    """A table written by Spark is a folder, and its parts do not bear the table's name."""
    doc = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, f"word{i}", "en", "s", 5) for i in range(6)]
    spark.createDataFrame(rows, doc).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    event = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    seen = [(i, START + timedelta(hours=i), 1, "view", 1.0, "{}") for i in range(4)]
    spark.createDataFrame(seen, event).repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    chunks, terms = str(tmp_path / "chunks"), str(tmp_path / "terms")
    docs = jobs.stream_documents(spark, str(tmp_path))
    jobs.stream_ingest(docs, chunks, f"{chunks}-log", 100, dim=8).awaitTermination()
    jobs.stream_terms(spark, chunks, terms, f"{terms}-log").awaitTermination()
    assert {r.doc_id for r in index_store.read_chunks(spark, chunks).collect()} == set(range(6))
    assert {r.term for r in index_store.read_terms(spark, terms).collect()} == {"", *(t for _, t, *_ in rows)}
    events = jobs.stream_events(spark, str(tmp_path))
    out = jobs.run_available(jobs.stream_admission(events, 9, 3600), "admission").collect()
    assert {r.event_id for r in out} == set(range(4))


def test_retention_follows_the_newest_upload(spark, tmp_path):
    """Document 1 comes again on day 3, together with an older copy; later files move the time on."""
    schema = "doc_id bigint, tenant_id string, day int"
    parts = [[(1, "a", 0)], [(1, "a", 3), (1, "a", 2)], [(2, "a", 8)], [(3, "a", 11)]]
    files_in_turn(spark, tmp_path, "uploads", parts, schema)
    raw = (
        spark.readStream.schema(schema).option("pathGlobFilter", "uploads*.parquet")
        .option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    )
    days = raw.withColumn("uploaded_at", F.lit(START) + F.make_dt_interval(F.col("day")))
    out = jobs.run_available(jobs.stream_retention(days), "retention").collect()
    assert [(r.doc_id, r.expires_at) for r in out] == [(1, START + timedelta(days=10))]


def test_admission_over_several_files(spark, tmp_path):
    """A user's list outlives the batch, and is gone once it cannot matter any more."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    row = lambda i, h: (i, START + timedelta(hours=h), 1, "view", 1.0, "{}")
    parts = [[row(1, 0), row(2, 1)], [row(3, 2), row(4, 7)], [row(5, 90)], [row(6, 91)]]
    files_in_turn(spark, tmp_path, "events", parts, schema)
    stream = jobs.stream_events(spark, str(tmp_path / "in"), max_files=1)
    out = jobs.run_available(jobs.stream_admission(stream, 2, 6 * 3600), "admission").collect()
    assert {r.event_id: r.admitted for r in out} == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True}



def test_stream_and_batch_make_one_index(spark, tmp_path):
    """Three batches, one document uploaded again newer, one older, one delivered twice."""
    doc = "doc_id bigint, tenant_id string, lang string, day int, text string"
    words = "red blue stone river the of data fast slow green cloud seven".split()
    rnd = random.Random(3)
    text = lambda: " ".join(rnd.choices(words, k=rnd.randrange(3, 1200)))
    base = [(i, f"t{i % 2}", "en", 0, text()) for i in range(12)]
    parts = [
        [(3, "t1", "en", 2, text()), (20, "t0", "en", 2, text())],
        [(4, "t0", "en", -1, "stone stone stone"), (21, "t1", "en", 3, text())],  # older than the base's
        [(3, "t1", "en", 5, "river data"), (21, "t1", "en", 3, "")],
    ]
    twice = (22, "t0", "en", 4, text())
    parts[1].append(twice)
    parts[2].append(twice)
    parts[2][1] = (20, "t0", "en", 1, "green green")  # older than the stream's own
    dated = lambda df: df.select(
        "*", (F.lit(START) + F.make_dt_interval(F.col("day"))).cast("timestamp_ntz").alias("uploaded_at"),
        F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit("text/plain").alias("mime"))
    files_in_turn(spark, tmp_path, "uploads", parts, doc)
    chunks, terms = str(tmp_path / "chunks"), str(tmp_path / "terms")
    raw = (
        spark.readStream.schema(doc).option("pathGlobFilter", "uploads*.parquet")
        .option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    )
    jobs.stream_ingest(dated(raw), chunks, f"{chunks}-log", 10**7, dim=16).awaitTermination()
    for _ in range(2):  # run again, it adds nothing
        jobs.stream_terms(spark, chunks, terms, f"{terms}-log").awaitTermination()
    old = dated(spark.createDataFrame([*base, base[0]], doc))  # a row delivered twice to the batch
    folders = hybrid.build_index(ingest.chunk_fixed(old), str(tmp_path / "base"), 16)
    merged = hybrid.open_index(spark, folders, 16, [(chunks, terms)])

    newest = {}
    for row in [*base, *parts[0], *parts[1], *parts[2]]:
        if row[0] not in newest or newest[row[0]][3] < row[3]:
            newest[row[0]] = row
    now = ingest.chunk_fixed(dated(spark.createDataFrame(list(newest.values()), doc)))
    rebuilt = hybrid.index_chunks(now.drop("uploaded_at"), 16)
    compacted = hybrid.open_index(spark, hybrid.compact(merged, str(tmp_path / "next")), 16)
    asked = spark.createDataFrame(
        [(i, f"t{i % 2}", "en", " ".join(words[i : i + 3])) for i in range(10)],
        "query_id bigint, tenant_id string, lang string, text string")
    for route in (lambda x: hybrid.lexical_route(asked, x, 50), lambda x: hybrid.dense_route(asked, x, 50)):
        want = sorted(map(tuple, route(rebuilt).collect()))
        assert want and sorted(map(tuple, route(merged).collect())) == want
        assert sorted(map(tuple, route(compacted).collect())) == want
    assert merged.chunks.filter("doc_id = 3").select("text").collect()[0].text == "river data"


def test_vectors_of_other_tenants_are_not_read(spark, tmp_path):
    docs = src.scan_documents(spark, FOLDER)
    folders = hybrid.build_index(ingest.chunk_fixed(docs), str(tmp_path), 8)
    index = hybrid.open_index(spark, folders, 8)
    asked = src.search_queries(spark, FOLDER).filter("query_id = 3")
    hits = hybrid.dense_route(asked, index, 5)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "(tenant_id#" in plan and "= src3" in plan
    assert hits.count() > 0


def test_one_question_reads_few_files(spark, tmp_path):
    """One tenant's two words: other folders, and rows of other tenants, stay unread."""
    folders = hybrid.build_index(ingest.chunk_fixed(src.scan_documents(spark, FOLDER)), str(tmp_path), 8)
    index = hybrid.open_index(spark, folders, 8)
    common = index.stats.filter("tenant_id = 'src3'").orderBy(F.desc("df"), "term").limit(2).collect()
    asked = spark.createDataFrame(
        [(1, "src3", "xx", " ".join(r.term for r in common))], "query_id bigint, tenant_id string, lang string, text string"
    )
    parsed = lexical.parse_websearch(asked)
    for table, whole in zip(lexical.only_asked(parsed, index.postings, index.stats), (index.postings, index.stats)):
        files = lambda df: df.select(F.input_file_name()).distinct().count()
        assert files(table) <= 2 < files(whole)
        plan = table._jdf.queryExecution().executedPlan().toString()
        pushed = plan[plan.index("PushedFilters") :]
        assert "EqualTo(tenant_id,src3)" in pushed and "In(term, [" in pushed
    assert hybrid.lexical_route(asked, index, 5).count() > 0
    every = spark.createDataFrame(
        [(1, "src3", "xx", " ".join(f"w{i}" for i in range(lexical.NAMED_TERMS + 5)) + " " + common[0].term)],
        "query_id bigint, tenant_id string, lang string, text string")
    many = lexical.only_asked(lexical.parse_websearch(every), index.postings)[0]
    assert "In(term" not in many._jdf.queryExecution().executedPlan().toString()
    assert hybrid.lexical_route(every, index, 5).count() > 0


def test_added_rows_are_compared_only_if_delivered_twice(spark):
    """Postings and texts that a stream added once are not shuffled to find repeated ones."""
    fields = "tenant_id string, doc_id bigint, chunk_id string, lang string, text string, uploaded_at timestamp_ntz"
    row = lambda i, text, day=0: ("t", i, f"{i}:0", "en", text, START + timedelta(days=day))
    lines = lambda df: lexical.build_postings(df, marked=True).withColumn("term_bucket", lexical.term_bucket())
    base = spark.createDataFrame([row(1, "red"), row(2, "blue")], fields)
    for more, shuffled in (([], False), ([row(3, "stone"), row(3, "stone")], True)):
        new = spark.createDataFrame([row(2, "blue sky", 2), row(4, "sky"), *more], fields)
        chunks, postings, stats = index_store.with_deltas(base, lines(base), new, lines(new))
        for table in (chunks, postings):
            plan = table._jdf.queryExecution().optimizedPlan().toString()
            assert ("Aggregate" in plan) == shuffled
        assert sorted(r.text for r in chunks.collect()) == sorted(["red", "blue sky", "sky", *(["stone"] if more else [])])
        df = {r.term: (r.df, r.cf, r.n_chunks) for r in stats.collect()}
        n = 4 if more else 3
        assert df["sky"] == (2, 2, n) and df["blue"] == (1, 1, n) and (not more or df["stone"] == (1, 1, n))


def test_documents_that_came_twice_are_found_by_keys(spark):
    """The same chunks as by comparing chunks, of documents with repeated, null and empty rows."""
    fields = "doc_id bigint, tenant_id string, lang string, text string, uploaded_at timestamp_ntz"
    row = lambda i, text, day=0, t="t": (i, t, "en", text, START + timedelta(days=day))
    rows = [row(1, "a b"), row(1, "c d", 2), row(2, "e"), row(2, "e"), row(3, "f"), row(3, "", 5), row(4, None),
            row(None, "g"), row(None, "g"), row(5, "h", 0, None), row(5, "h", 0, None), row(1, "i", 0, "u")]
    docs = spark.createDataFrame(rows, fields)
    want = index_store.only_newest(ingest.chunk_fixed(docs))
    for some in (docs, docs.filter("doc_id = 4 OR tenant_id = 'u'")):
        got = index_store.newest_chunked(some, ingest.chunk_fixed)
        same = index_store.only_newest(ingest.chunk_fixed(some))
        assert got.exceptAll(same).count() == same.exceptAll(got).count() == 0
    assert want.count() == 8


def test_a_stream_task_a_core_writes_postings(spark, tmp_path):
    """However many files a batch has, a bucket gets a file a core at most, so files stay few."""
    schema = "tenant_id string, doc_id bigint, chunk_id string, lang string, text string, uploaded_at timestamp_ntz"
    rows = [(f"t{i}", i, f"{i}:0", "en", "red blue", START) for i in range(24)]
    spark.createDataFrame(rows, schema).repartition(24).write.partitionBy("tenant_id").parquet(str(tmp_path / "chunks"))
    with_conf = ("spark.sql.files.openCostInBytes", "134217728")
    before = spark.conf.get(with_conf[0])
    spark.conf.set(*with_conf)  # every file is a task of its own
    try:
        jobs.stream_terms(spark, str(tmp_path / "chunks"), str(tmp_path / "terms"), str(tmp_path / "log")).awaitTermination()
    finally:
        spark.conf.set(with_conf[0], before)
    per_bucket = [len([f for f in os.listdir(tmp_path / "terms" / b) if f.endswith(".parquet")])
                  for b in os.listdir(tmp_path / "terms") if b.startswith("term_bucket")]
    assert max(per_bucket) <= spark.sparkContext.defaultParallelism
    assert spark.read.parquet(str(tmp_path / "terms")).count() == 72
