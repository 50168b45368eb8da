"""Readers, chunking, uploads and retention on rows made by hand."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from findling.operators import ingest, tenancy
from findling.sources import documents as src
from findling.plans import hybrid
from findling.sources import index_store

SCHEMA = "tenant_id string, doc_id bigint, lang string, text string"


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


def docs_of(spark, *texts):
    return spark.createDataFrame([("t", i, "en", t) for i, t in enumerate(texts)], SCHEMA)


def by_doc(chunks):
    out = {}
    for r in sorted(chunks.collect(), key=lambda r: (r.doc_id, r.start_tok)):
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_fixed_chunks_at_the_edges(spark):
    sizes = [0, 1, 450, 451, 500, 501, 950, 951]
    got = by_doc(ingest.chunk_fixed(docs_of(spark, *[words(n) for n in sizes])))
    spans = {i: [(r.start_tok, r.n_tokens) for r in rows] for i, rows in got.items()}
    assert 0 not in spans
    assert spans[1] == [(0, 1)]
    assert spans[2] == [(0, 450)]
    assert spans[3] == [(0, 451)]
    assert spans[4] == [(0, 500)]
    assert spans[5] == [(0, 500), (450, 51)]
    assert spans[6] == [(0, 500), (450, 500)]
    assert spans[7] == [(0, 500), (450, 500), (900, 51)]


def test_chunks_less_overlap_give_back_the_tokens(spark):
    text = "\n".join(words(n, 1000 * n) for n in (3, 0, 250, 700, 1, 120, 90, 333))
    docs = docs_of(spark, text)
    for chunk in (ingest.chunk_fixed, ingest.chunk_structured):
        tokens = []
        for r in by_doc(chunk(docs))[0]:
            assert r.start_tok <= len(tokens)
            tokens = tokens[: r.start_tok] + r.text.split()
            assert r.n_tokens == len(r.text.split())
        assert tokens == text.split()


def test_structured_chunks_start_at_lines(spark):
    lines = [words(40, 1000 * i) for i in range(30)]
    rows = by_doc(ingest.chunk_structured(docs_of(spark, "\n".join(lines))))[0]
    assert [r.start_tok for r in rows] == [0, 480 - 50, 920 - 50]
    assert [r.page_no for r in rows] == [1, 2, 3]
    assert max(r.n_tokens for r in rows) <= 449 + 100 + 50


def test_pages_and_offsets(spark):
    text = "ab\n\nc" + "\nx" * 10
    rows = sorted(ingest.extract_pages(docs_of(spark, text)).collect(), key=lambda r: r.line_no)
    assert [(r.char_start, r.char_end) for r in rows[:3]] == [(0, 2), (3, 3), (4, 5)]
    assert all(text[r.char_start : r.char_end] == r.text for r in rows)
    assert [r.page_no for r in rows] == [1] * 10 + [2] * 3


def test_running_offsets_over_many_lines(spark):
    text = "\n".join("x" * (i % 7) for i in range(1000))
    rows = ingest.extract_pages(docs_of(spark, text)).collect()
    assert all(text[r.char_start : r.char_end] == r.text for r in rows) and len(rows) == 1000


def test_html_blocks(spark):
    html = (
        "<nav><li>skip</li></nav><!-- <p>no</p> --><h2 class='a'>A &amp; B</h2>"
        "<script>var t='<p>no</p>'</script><P>one <b>two</b>\n three</P><p> </p>"
    )
    page = spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string")
    rows = sorted(ingest.extract_html_text(page).collect(), key=lambda r: r.block_no)
    assert [(r.kind, r.text) for r in rows] == [("h2", "A & B"), ("p", "one two three")]


def test_uploads_are_judged_and_counted(spark):
    at = datetime(2024, 1, 1)
    rows = [
        (i, "a" if i < 5 else "b", at + timedelta(hours=9 - i), n, m)
        for i, (n, m) in enumerate(
            [(0, "text/plain"), (11, "text/plain"), (5, "x/y"), (5, "text/plain"), (5, None), (1, "text/plain")]
        )
    ]
    docs = spark.createDataFrame(
        rows, "doc_id bigint, tenant_id string, uploaded_at timestamp_ntz, n_bytes bigint, mime string"
    )
    judged = {r.doc_id: r.reason for r in ingest.validate_uploads(docs, 10).collect()}
    assert judged == {
        0: "empty", 1: "too_large", 2: "unsupported_type", 3: None, 4: "unsupported_type", 5: None,
    }
    admitted = {r.doc_id for r in ingest.upload_quota(docs, 2).collect() if r.admitted}
    assert admitted == {4, 3, 5}


def test_retention_edge(spark):
    as_of = datetime(2024, 1, 31)
    rows = [(1, as_of - timedelta(days=7)), (2, as_of - timedelta(days=7, microseconds=1))]
    docs = spark.createDataFrame(rows, "doc_id bigint, uploaded_at timestamp_ntz")
    gone = ingest.retention_expired(docs, src.ntz("2024-01-31 00:00:00")).collect()
    assert [r.doc_id for r in gone] == [2]


def test_embeddings_are_unit_or_zero(spark):
    rows = ingest.embed_chunks(
        spark.createDataFrame([("t", 1, "1:0", "a b a"), ("t", 2, "2:0", " .,;")],
                              "tenant_id string, doc_id bigint, chunk_id string, text string"),
        16,
    ).collect()
    lengths = {r.chunk_id: float(np.linalg.norm(r.embedding)) for r in rows}
    assert lengths["1:0"] == pytest.approx(1, abs=1e-6) and lengths["2:0"] == 0


def test_embedding_model_plugs_in(spark):
    chunks = ingest.chunk_fixed(docs_of(spark, "a bb", "ccc"))
    model = lambda texts: np.array([[len(t), 1.0] for t in texts])
    got = {r.doc_id: list(r.embedding) for r in ingest.embed_chunks(chunks, model=model).collect()}
    assert got == {0: [4.0, 1.0], 1: [3.0, 1.0]}


def stored(spark, docs, base, dim=8):
    return index_store.store_chunks(ingest.chunk_fixed(docs), base, dim)


def test_chunks_and_vectors_are_one_write(spark, tmp_path):
    base = str(tmp_path / "index")
    docs = docs_of(spark, words(600), "b c").withColumn("uploaded_at", F.lit(datetime(2024, 1, 1)))
    one, two = stored(spark, docs, base), stored(spark, docs.withColumn("tenant_id", F.lit("007")), base)
    assert one != two  # a second writer gets a folder of its own
    seen = index_store.read_chunks(spark, one)
    assert seen.count() == 3 and seen.filter("size(embedding) <> 8").count() == 0
    both = index_store.read_chunks(spark, one, two)
    assert {r.tenant_id for r in both.select("tenant_id").collect()} == {"t", "007"}
    plan = both.filter("tenant_id = '007'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan


def test_a_document_uploaded_again_shows_once(spark, tmp_path):
    base = str(tmp_path / "index")
    at = [F.lit(datetime(2024, 1, day)) for day in (1, 2)]
    old = docs_of(spark, words(600), "b c").withColumn("uploaded_at", at[0])
    new = docs_of(spark, words(100)).withColumn("uploaded_at", at[1])
    folders = [stored(spark, d, base) for d in (old, new, new)]
    seen = index_store.newest_uploads(index_store.read_chunks(spark, *folders)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in seen) == [(0, 100), (1, 2)]


def test_deletes_stay_within_their_tenant(spark):
    docs = docs_of(spark, "a", "b").unionByName(docs_of(spark, "c").withColumn("tenant_id", F.lit("u")))
    doomed = spark.createDataFrame([("u", 0), ("u", 1)], "tenant_id string, doc_id bigint")
    left, chunks = ingest.cascade_delete(docs, ingest.chunk_fixed(docs), doomed)
    for rows in (left, chunks):
        assert sorted((r.tenant_id, r.doc_id) for r in rows.collect()) == [("t", 0), ("t", 1)]


def test_search_of_a_stored_index_reads_no_text_before_the_rerank(spark, tmp_path):
    docs = docs_of(spark, "alpha beta gamma", "beta delta", "omega")
    folders = hybrid.build_index(ingest.chunk_fixed(docs), str(tmp_path / "index"), 8)
    index = hybrid.open_index(spark, folders, 8)
    asked = spark.createDataFrame([(1, "t", "en", "beta delta")], "query_id bigint, tenant_id string, lang string, text string")
    for route in (hybrid.dense_route, hybrid.lexical_route):
        plan = route(asked, index, 5)._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema" in plan and "text:string" not in plan
    plan = hybrid.lexical_route(asked, index, 5)._jdf.queryExecution().executedPlan().toString()
    assert "term_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    hits = hybrid.hybrid_search(asked, index, 2).collect()
    assert [r.chunk_id for r in sorted(hits, key=lambda r: r.rank)][0] == "1:0"


def test_tenant_view_refuses(spark):
    docs = docs_of(spark, "a")
    view = tenancy.TenantView(spark, "t", lambda s, name: docs if name == "docs" else s.range(1))
    assert view.table("docs").count() == 1
    with pytest.raises(ValueError):
        view.table("other")
    with pytest.raises(ValueError):
        tenancy.TenantView(spark, None, lambda s, name: docs)


def test_audit_counts_leaks(spark):
    rows = [(1, "a"), (1, "b"), (1, "unknown"), (9, "a"), (1, "nobody's")]
    hits = spark.createDataFrame(rows, "query_id bigint, chunk_id string")
    owners = [("a", "t"), ("b", "u"), ("nobody's", None)]
    chunks = spark.createDataFrame(owners, "chunk_id string, tenant_id string")
    asked = spark.createDataFrame([(1, "t")], "query_id bigint, tenant_id string")
    assert tuple(tenancy.isolation_audit(hits, chunks, asked).first()) == (5, 4)


def test_files_are_read_as_bytes(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "b.txt").write_bytes(b"x")
    rows = src.scan_files(spark, str(tmp_path), "*.pdf").collect()
    assert [(bytes(r.content), r.length) for r in rows] == [(b"%PDF", 4)]


def test_health_reports_missing_tables(spark):
    rows = src.dataset_health(spark, "/root/testdata/sf0.001", tables=["region", "no_such"]).collect()
    assert [(r.table_name, r.status) for r in rows] == [
        ("region", "healthy"), ("no_such", "unreachable"),
    ]
