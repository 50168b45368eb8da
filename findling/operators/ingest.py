"""Uploads to pages, chunks and vectors, and the life of a document after that.

Page, chunk and token work stays inside the row of its document: no shuffle
moves text, and one very long document costs one row, not one task per key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from findling.functions.arrays import let, run_starts, running_before
from findling.functions.text import WHITESPACE_TOKENS, word_tokens
from findling.session import written

CHUNK_SIZE, CHUNK_OVERLAP, LINES_PER_PAGE, PIECE = 500, 0.10, 10, 100
DEFAULT_DIM = 384
RETENTION_DAYS, UPLOAD_LIMIT = 7, 3
MAX_UPLOAD_BYTES = 10_000  # the service's limit, for batch and stream alike

LINES = r"split(text, '\\n')"

# The entities decoded in page text.
ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&amp;", "&"),
)
# Page parts that hold no prose, and the blocks that do.
NOISE = (
    r"(?is)<!--.*?-->",
    r"(?is)<script\b.*?</script>",
    r"(?is)<style\b.*?</style>",
    r"(?is)<nav\b.*?</nav>",
)
BLOCK = r"(?is)<(?:h[1-6]|p|li)\b[^>]*>.*?</(?:h[1-6]|p|li)>"


def validate_uploads(
    docs: DataFrame, max_bytes: int, types: Iterable[str] = ("text/plain",)
) -> DataFrame:
    """Status ``PENDING``, or ``REJECTED`` with the first reason that applies."""
    reason = (
        F.when(F.col("n_bytes").isNull() | (F.col("n_bytes") == 0), "empty")
        .when(F.col("n_bytes") > max_bytes, "too_large")
        .when(~F.coalesce(F.col("mime").isin(*types), F.lit(False)), "unsupported_type")
    )
    return docs.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), "PENDING").otherwise("REJECTED")
    )


def upload_quota(docs: DataFrame, limit: int = UPLOAD_LIMIT) -> DataFrame:
    """Mark the first ``limit`` uploads of each tenant as admitted.

    Ranking with a bound lets every task keep only ``limit`` rows per tenant
    before the shuffle; the rest of a large tenant is never sorted in one place.
    The admitted ids, ``limit`` per tenant, are written so that Spark knows their
    size when they meet the documents again.
    """
    order = W.partitionBy("tenant_id").orderBy("uploaded_at", "doc_id")
    admitted = (
        docs.select("tenant_id", "uploaded_at", "doc_id")
        .withColumn("slot", F.row_number().over(order))
        .filter(F.col("slot") <= limit)
        .select("doc_id", "slot")
    )
    marked = docs.join(written(admitted, "admitted"), "doc_id", "left")
    return marked.withColumn("admitted", F.col("slot").isNotNull())


def extract_pages(docs: DataFrame, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """One row per line with its page and its character range in the document."""
    keep = [c for c in ("tenant_id", "doc_id") if c in docs.columns]
    starts = running_before("transform(ls, x -> length(x) + 1)")
    placed = let(LINES, "ls", f"zip_with({starts}, ls, (s, t) -> struct(s AS start, t AS text))")
    rows = docs.select(*keep, F.posexplode(F.expr(placed)).alias("line_no", "line"))
    start, text = F.col("line")["start"], F.col("line")["text"]
    return rows.select(
        *keep,
        (F.floor(F.col("line_no") / lines_per_page) + 1).cast("int").alias("page_no"),
        (F.col("line_no") + 1).alias("line_no"),
        start.alias("char_start"),
        (start + F.length(text)).alias("char_end"),
        text.alias("text"),
    )


def decode_entities(text: Column) -> Column:
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def extract_html_text(pages: DataFrame) -> DataFrame:
    """Headings, paragraphs and list items of a page, in order, as plain text."""
    html = F.col("html")
    for pattern in NOISE:
        html = F.regexp_replace(html, pattern, " ")
    blocks = F.regexp_extract_all(html, F.lit(BLOCK), F.lit(0))
    rows = pages.select("page_id", F.posexplode(blocks).alias("pos", "block"))
    bare = F.regexp_replace(F.regexp_replace("block", r"<[^>]*>", " "), r"\s+", " ")
    return rows.select(
        "page_id",
        (F.col("pos") + 1).alias("block_no"),
        F.lower(F.regexp_extract("block", r"^<([A-Za-z0-9]+)", 1)).alias("kind"),
        F.trim(F.regexp_replace(decode_entities(bare), r"\s+", " ")).alias("text"),
    ).filter(F.col("text") != "")


def _chunk_rows(docs: DataFrame, chunks: str, lines_per_page: int) -> DataFrame:
    """One row per element of ``chunks``, an array over ``lines`` and ``doc``.

    ``doc`` holds the tokens of the document and beside them the page of each.
    """
    pages = f"transform(lines, (l, i) -> array_repeat(cast(i div {lines_per_page} + 1 AS int), size(l)))"
    doc = f"struct(flatten(lines) AS toks, flatten({pages}) AS pages)"
    lines = f"transform({LINES}, x -> {WHITESPACE_TOKENS.format('x')})"
    cut = F.expr(let(lines, "lines", let(doc, "doc", chunks)))
    dated = ["uploaded_at"] if "uploaded_at" in docs.columns else []
    # Unlike posexplode, the outer form does not test the cut for emptiness first, which
    # would make it twice; a document without tokens gives a null row that is dropped.
    rows = docs.select("tenant_id", "doc_id", "lang", *dated, F.posexplode_outer(cut).alias("i", "c"))
    return rows.filter("i IS NOT NULL").select(
        "tenant_id",
        "doc_id",
        F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("i").cast("string")).alias(
            "chunk_id"
        ),
        "lang",
        F.col("c")["page_no"].alias("page_no"),
        F.col("c")["last_page"].alias("last_page"),
        F.col("c")["start_tok"].alias("start_tok"),
        F.size(F.col("c")["toks"]).alias("n_tokens"),
        F.array_join(F.col("c")["toks"], " ").alias("text"),
        *dated,
    )


def _cut(first: str, start: str, length: str) -> str:
    """A chunk of ``length`` tokens from ``start``; its pages count from ``first``."""
    return f"""struct(
        get(doc.pages, {first}) AS page_no,
        get(doc.pages, least({start} + {length}, size(doc.toks)) - 1) AS last_page,
        {start} AS start_tok,
        slice(doc.toks, {start} + 1, {length}) AS toks)"""


def chunk_fixed(
    docs: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: float = CHUNK_OVERLAP,
    lines_per_page: int = LINES_PER_PAGE,
) -> DataFrame:
    """Windows of ``size`` tokens; no window holds only tokens of the one before."""
    shared = int(size * overlap)
    starts = f"sequence(0, greatest(size(doc.toks) - {shared} - 1, 0), {size - shared})"
    windows = f"transform({starts}, s -> {_cut('s', 's', str(size))})"
    return _chunk_rows(docs, f"if(size(doc.toks) > 0, {windows}, NULL)", lines_per_page)


def chunk_structured(
    docs: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: float = CHUNK_OVERLAP,
    lines_per_page: int = LINES_PER_PAGE,
    piece: int = PIECE,
) -> DataFrame:
    """Chunks of whole lines, each led by the last tokens of the chunk before.

    Lines longer than ``piece`` are cut into pieces. A piece belongs to the
    bucket its first token falls into, so a chunk runs from the first token of
    its bucket to the first token of the next. ``page_no`` is the page of the
    chunk's own first token, not of the tokens it repeats.
    """
    shared = int(size * overlap)
    stride = size - shared
    pieces = f"""transform(filter(lines, l -> size(l) > 0), l -> transform(
        sequence(0, (size(l) - 1) div {piece}), p -> least({piece}, size(l) - cast(p AS int) * {piece})))"""
    firsts = run_starts("before", f"{{0}} div {stride}")
    marks = let(
        running_before(f"flatten({pieces})"),
        "before",
        f"transform({firsts}, i -> cast(get(before, i) AS int))",
    )
    lead = let(
        f"greatest(first - {shared}, 0)",
        "start",
        _cut("first", "start", "(coalesce(get(marks, i + 1), size(doc.toks)) - start)"),
    )
    chunks = let(marks, "marks", f"transform(marks, (first, i) -> {lead})")
    return _chunk_rows(docs, f"if(size(doc.toks) > 0, {chunks}, NULL)", lines_per_page)


def chunk_at(docs: DataFrame, marks: str, shared: int, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """Chunks that begin at the tokens which the array column ``marks`` lists, each led by
    the ``shared`` tokens before. ``page_no`` is the page of a chunk's own first token."""
    lead = let(
        f"greatest(first - {shared}, 0)",
        "start",
        _cut("first", "start", f"(coalesce(get({marks}, i + 1), size(doc.toks)) - start)"),
    )
    chunks = f"transform({marks}, (first, i) -> {lead})"
    return _chunk_rows(docs, f"if(size(doc.toks) > 0, {chunks}, NULL)", lines_per_page)


def document_of(chunk_id: Column) -> Column:
    """Chunk ids start with the id of their document."""
    return F.substring_index(chunk_id, ":", 1).cast("bigint")


@lru_cache(maxsize=1 << 18)
def _hashed(word: str) -> tuple[int, int]:
    """Hash and sign of a word; kept across the batches of a task."""
    digest = hashlib.md5(word.encode()).hexdigest()
    return int(digest[:8], 16), 1 - 2 * (int(digest[8], 16) % 2)


def feature_hash(tokens: pa.ListArray, dim: int) -> np.ndarray:
    """Signed token counts per md5 bucket, scaled to unit length, one row per list.

    Each distinct token of the batch is looked up once.
    """
    offsets = tokens.offsets.to_numpy()
    rows = np.repeat(np.arange(len(tokens)), np.diff(offsets))
    words = tokens.flatten().dictionary_encode()
    known = np.array([_hashed(w) for w in words.dictionary.to_pylist()], np.int64).reshape(-1, 2)
    bucket, sign = known[:, 0] % dim, known[:, 1]
    codes = words.indices.to_numpy(zero_copy_only=False)
    cells = np.bincount(
        rows * dim + bucket[codes], weights=sign[codes], minlength=len(tokens) * dim
    )
    sums = cells.astype(np.float64).reshape(len(tokens), dim)
    length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return np.divide(sums, length, out=np.zeros_like(sums), where=length > 0)


def embed_chunks(
    chunks: DataFrame,
    dim: int = DEFAULT_DIM,
    model: Callable[[list[str]], np.ndarray] | None = None,
    keys: tuple[str, ...] = ("tenant_id", "doc_id", "chunk_id"),
) -> DataFrame:
    """Append ``embedding`` to ``keys``, one Arrow batch at a time.

    ``model`` takes a list of texts and returns a matrix. Without one, tokens are
    feature-hashed: a sum over buckets by ``groupBy`` would shuffle several times
    the size of the text, while the batch form shuffles nothing.
    """
    keys = tuple(k for k in keys if k in chunks.columns)
    payload = F.col("text") if model else word_tokens(F.col("text"))
    source = chunks.select(*keys, payload.alias("payload"))
    schema = T.StructType(
        [chunks.schema[k] for k in keys]
        + [T.StructField("embedding", T.ArrayType(T.FloatType(), False))]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = batch.column(len(keys))
            matrix = (
                np.asarray(model(column.to_pylist())) if model else feature_hash(column, dim)
            ).astype(np.float32)
            flat = pa.array(matrix.reshape(-1))
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * matrix.shape[1])
            vectors = pa.ListArray.from_arrays(ends, flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keys))] + [vectors],
                names=[*keys, "embedding"],
            )

    return source.mapInArrow(encode, schema)


def retention_expired(docs: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Documents uploaded more than ``days`` before ``as_of``; exactly that old is kept."""
    return docs.filter(F.col("uploaded_at") < as_of - F.make_dt_interval(F.lit(days)))


def cascade_delete(
    docs: DataFrame, chunks: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The documents and chunks that stay once ``doomed`` documents are gone.

    A document goes only under the tenant that named it.
    """
    keys = ["tenant_id", "doc_id"]
    gone = doomed.select(*keys)
    return docs.join(gone, keys, "left_anti"), chunks.join(gone, keys, "left_anti")


def mark_ready(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``READY`` once the index holds a chunk of the document, else ``PENDING``."""
    indexed = chunks.select("doc_id").distinct().withColumn("indexed", F.lit(True))
    return (
        docs.join(indexed, "doc_id", "left")
        .withColumn("status", F.when(F.col("indexed"), "READY").otherwise("PENDING"))
        .drop("indexed")
    )


def document_catalog(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every document with its status, chunks, tokens and pages, in tenant order."""
    sizes = chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum("n_tokens").alias("n_tokens"),
        F.max("last_page").cast("bigint").alias("n_pages"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        docs.select("tenant_id", "doc_id", "uploaded_at", "n_bytes")
        .join(sizes, "doc_id", "left")
        .select(
            "tenant_id",
            "doc_id",
            "uploaded_at",
            "n_bytes",
            F.when(F.col("n_chunks") > 0, "READY").otherwise("PENDING").alias("status"),
            F.coalesce("n_chunks", zero).alias("n_chunks"),
            F.coalesce("n_tokens", zero).alias("n_tokens"),
            F.coalesce("n_pages", zero).alias("n_pages"),
        )
        .orderBy("tenant_id", "uploaded_at", "doc_id")
    )
