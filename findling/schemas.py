"""Explicit schemas of the input tables and of the derived ones."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LONG, INT, STR, DBL = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()

DOCUMENTS = _struct(doc_id=LONG, text=STR, lang=STR, source=STR, n_chars=LONG)
PAGES = _struct(page_id=LONG, url=STR, html=STR)
BENCHMARK = _struct(item_id=LONG, text=STR)
EMBEDDINGS = _struct(vec_id=LONG, embedding=T.ArrayType(T.FloatType()), label=INT)
CONVERSATIONS = _struct(conv_id=LONG, turn=LONG, role=STR, text=STR)
EVENTS = _struct(
    event_id=LONG,
    ts=T.TimestampNTZType(),
    user_id=LONG,
    event_type=STR,
    value=DBL,
    props=STR,
)
CHUNKS = _struct(
    tenant_id=STR,
    doc_id=LONG,
    chunk_id=STR,
    lang=STR,
    page_no=INT,
    last_page=INT,
    start_tok=INT,
    n_tokens=INT,
    text=STR,
)
VECTORS = _struct(
    tenant_id=STR, doc_id=LONG, chunk_id=STR, embedding=T.ArrayType(T.FloatType(), False)
)
TOOL_ARGS = _struct(k=LONG)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
