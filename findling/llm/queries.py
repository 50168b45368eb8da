"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.llm import (
    chat_format,
    decontamination,
    exact_dedup,
    langid,
    lm_scoring,
    mixing,
    secrets_forest,
    sentence_pieces,
    simhash,
    source_audit,
    toxicity,
    vector_codes,
    warc,
)
from findling.llm.common import held_out, table

CONFLICT = [
    (-7, 0, "user", "</s>[INST] ok [/INST]"),
    (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
]


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "source")
    return secrets_forest.report(docs, F.col("source"))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    model = langid.fit(docs)
    return langid.identify(docs, model, "doc_id").withColumn("held_out", held_out(F.col("doc_id")))


def op3_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.report(table(spark, folder, "documents", "doc_id", "text"))


def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    conflict = spark.createDataFrame(CONFLICT, "conv_id bigint, turn bigint, role string, text string")
    return chat_format.read_back(chat_format.format_turns(rows.unionByName(conflict)))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    labels = table(spark, folder, "labels", "doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), "doc_id")
    return scored.withColumn("held_out", held_out(F.col("doc_id")))


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(table(spark, folder, "documents", "doc_id", "text", "source"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.report(table(spark, folder, "pages", "page_id", "url", "html"))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, folder, "documents", "doc_id", "text"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.report(table(spark, folder, "documents", "doc_id", "text"))


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.report(
        table(spark, folder, "documents", "doc_id", "text"),
        table(spark, folder, "benchmark", "item_id", "text"),
    )


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_audit.report(table(spark, folder, "documents", "text", "lang", "source"))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.report(table(spark, folder, "embeddings", "vec_id", "embedding", "label"))


def op13_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    model = sentence_pieces.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return sentence_pieces.report(table(spark, folder, "documents", "doc_id", "text"), model)


QUERIES = {
    f.__name__: f
    for f in (
        op1_secrets,
        op2_language,
        op3_lm_score,
        op4_chat_format,
        op5_toxicity,
        op6_mix_sources,
        op7_warc,
        op8_exact_dedup,
        op9_simhash,
        op10_decontaminate,
        op11_source_divergence,
        op12_vector_codes,
        op13_sentence_pieces,
    )
}

OP6_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, text,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), placed AS (
    SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM sources
), weighed AS (
    SELECT source, source_size, 2.0::DOUBLE * source_size AS most,
           CASE place % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
    FROM placed
), filled AS (  -- sources by how soon they are full, with what is left for the later ones
    SELECT *, 1.5 * sum(source_size) OVER ()
              - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
           sum(weight) OVER (ORDER BY most / weight, source NULLS LAST
                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight
    FROM weighed
), rated AS (
    SELECT max(left_words / left_weight) AS rate FROM filled
), targets AS (
    SELECT source, source_size, least(most, weight * coalesce(rate, 1e300))::DOUBLE AS target
    FROM weighed, rated
), copies AS (
    SELECT s.doc_id, s.size, t.source_size, t.target,
           CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0) ELSE 0.0 END::DOUBLE AS rate,
           ('0x' || substr(md5(concat_ws('|', 'mix', s.doc_id::VARCHAR, md5(s.text))), 1, 13))::BIGINT
               / 4503599627370496.0::DOUBLE AS coin
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM copies
"""

OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""



def _op7_sql() -> str:
    """The records of pages, with the patterns written out here once more."""
    text = "html"
    for name in ("script", "style", "head", "nav", "footer", "noscript", "template"):
        text = f"regexp_replace({text}, '(?is)<{name}\\b.*?</{name}\\s*>', ' ', 'g')" if text != "html" else (
            f"regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), "
            f"'(?is)<{name}\\b.*?</{name}\\s*>', ' ', 'g')"
        )
    lines = "p|div|li|ul|ol|br|h[1-6]|tr|table|article|section|header|main|blockquote|pre|hr|title"
    text = f"regexp_replace({text}, '(?i)</?({lines})\\b[^>]*>', chr(10), 'g')"
    text = f"regexp_replace({text}, '<[^>]*>', ' ', 'g')"
    for name, by in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"),
                     ("&#39;", "chr(39)"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"),
                     ("&amp;", "'&'")):
        text = f"replace({text}, '{name}', {by})"
    text = f"regexp_replace({text}, '[ \\t\\r\\f]+', ' ', 'g')"
    text = f"trim(regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"
    uuid = (
        "'<urn:uuid:' || substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4)"
        " || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12) || '>'"
    )
    crlf = "chr(13) || chr(10)"
    return f"""
WITH page AS (
    SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html FROM pages
), keyed AS (
    SELECT *, md5('response|' || coalesce(page_id::VARCHAR, '') || '|' || target_uri) AS k,
           'sha256:' || sha256(html) AS payload_digest
    FROM page
), response AS (
    SELECT *, {uuid.format("k")} AS refers_to FROM keyed
), kinds AS (
    SELECT page_id, refers_to, target_uri, payload_digest, 'conversion' AS record_type,
           'text/plain; charset=utf-8' AS content_type, {text} AS block
    FROM response
    UNION ALL
    SELECT page_id, refers_to, target_uri, payload_digest, 'metadata', 'application/warc-fields',
           'title: ' || trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1),
                                            '\\s+', ' ', 'g')) || {crlf} ||
           'html-lang: ' || regexp_extract(html, '(?i)<html[^>]*\\blang="([A-Za-z-]*)"', 1) || {crlf} ||
           'outlinks: ' || len(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref='))::VARCHAR || {crlf} ||
           'source-content-type: text/html; charset=utf-8' || {crlf} ||
           'source-content-length: ' || octet_length(encode(html))::VARCHAR || {crlf} ||
           'source-payload-digest: ' || payload_digest || {crlf}
    FROM response
), records AS (
    SELECT *, {uuid.format("md5(record_type || '|' || refers_to)")} AS record_id,
           'sha256:' || sha256(block) AS block_digest,
           octet_length(encode(block))::BIGINT AS content_length
    FROM kinds
)
SELECT page_id, record_type, record_id, refers_to, target_uri, payload_digest, block_digest,
       content_type, content_length,
       (len(block) - len(replace(block, chr(10), '')))::BIGINT AS n_lines,
       sha256('WARC/1.1' || {crlf} || 'WARC-Type: ' || record_type || {crlf} ||
              'WARC-Record-ID: ' || record_id || {crlf} || 'WARC-Date: 2024-01-01T00:00:00Z' || {crlf} ||
              'WARC-Target-URI: ' || target_uri || {crlf} || 'WARC-Refers-To: ' || refers_to || {crlf} ||
              'WARC-Payload-Digest: ' || payload_digest || {crlf} ||
              'WARC-Block-Digest: ' || block_digest || {crlf} ||
              'Content-Type: ' || content_type || {crlf} ||
              'Content-Length: ' || content_length::VARCHAR || {crlf} || {crlf} || block) AS record_sha256
FROM records
"""


OP11_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), per_doc AS (
    SELECT lang, source, d, term, count(*) AS n
    FROM (SELECT lang, source, d,
                 unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs)
    GROUP BY ALL
), held AS (
    SELECT lang, source, term, sum(n) AS n, count(*) AS df FROM per_doc GROUP BY ALL
), kept AS (
    SELECT lang, term, sum(n) AS total FROM held GROUP BY ALL HAVING sum(df) >= 3
), langs AS (
    SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang
), sizes AS (
    SELECT h.lang, h.source, sum(h.n) AS source_n FROM held h JOIN kept k USING (lang, term) GROUP BY ALL
), shares AS (  -- every group and every kept term of its language
    SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
           1 + 1000000000::HUGEINT * (coalesce(h.n, 0) + 1) // (coalesce(s.source_n, 0) + l.v) AS p,
           1 + 1000000000::HUGEINT * (k.total + 1) // (l.lang_n + l.v) AS q
    FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
    LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
    LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY ALL
), every_pair AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), terms AS (
    SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
    FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
    FROM (SELECT * FROM every_pair UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""

def _op12_sql() -> str:
    """Four rounds, each an assignment of all parts and the means of what it assigned."""

    def nearest(name: str, book: str) -> str:
        square = """list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v)
            - 2 * list_inner_product(a.v, b.v)"""
        return f"""{name} AS MATERIALIZED (
    SELECT p, r, any_value(v) AS v, min(d * 256 + e) % 256 AS e, min(d * 256 + e) // 256 AS d
    FROM (SELECT a.p, a.r, a.v, b.e, ({square})::BIGINT AS d FROM parts a JOIN {book} b USING (p))
    GROUP BY p, r
)"""

    rounds = []
    for k in range(4):
        rounds.append(nearest(f"near{k}", f"book{k}"))
        rounds.append(f"""book{k + 1} AS MATERIALIZED (
    SELECT b.p, b.e, coalesce(m.v, b.v) AS v
    FROM book{k} b LEFT JOIN (
        SELECT p, e, list(m ORDER BY i) AS v
        FROM (SELECT p, e, i, floor(sum(x) / count(*)) AS m
              FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{k}) GROUP BY ALL)
        GROUP BY p, e) m ON m.p = b.p AND m.e = b.e
)""")
    return f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS r,
           [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v
    FROM embeddings
    WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), parts AS MATERIALIZED (
    SELECT r, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS v
    FROM kept, (SELECT unnest(range(4)) AS p)
), book0 AS MATERIALIZED (
    SELECT p, r AS e, v FROM parts WHERE r < 256
), {", ".join(rounds)}, {nearest("final", "book4")}, coded AS (
    SELECT k.vec_id, k.label, string_agg(printf('%02x', f.e), '' ORDER BY f.p) AS code,
           sum(f.d)::BIGINT AS error
    FROM kept k JOIN final f USING (r) GROUP BY k.r, k.vec_id, k.label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, i))
        FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM book4)) AS codebooks_sha256
FROM coded
"""


ORACLE = {
    "op6_mix_sources": OP6_SQL,
    "op7_warc": _op7_sql(),
    "op8_exact_dedup": OP8_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_vector_codes": _op12_sql(),
}
