"""The same queries as DuckDB SQL, for comparison on small data."""

from __future__ import annotations

from collections.abc import Callable

from findling import schemas
from findling.functions.text import LANGUAGES, SENTENCE_END, stop_words
from findling.operators.ingest import BLOCK, ENTITIES, NOISE
from findling.operators.significance import COVERED, POISSON, SEED
from findling.operators.security import INJECTIONS, REDACTED, SECRETS, WORDING
from findling.operators.tenancy import PERMISSIONS
from findling.plans import registry as reg

ORACLE: dict[str, Callable[[], str]] = {}

WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
TOKENS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda t: t <> '')"
TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _stop_rows() -> str:
    return ", ".join(
        f"('{lang}', {_quoted(word)})" for lang in LANGUAGES for word in stop_words(lang)
    )


# Named parts; each may use the parts listed before it.
PARTS: dict[str, Callable[[], str]] = {
    "docs": lambda: """
        SELECT doc_id, source AS tenant_id, lang, source, n_chars,
               TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id * 37 % 720) AS uploaded_at,
               CAST(strlen(text) AS BIGINT) AS n_bytes,
               CASE WHEN doc_id % 50 = 7 THEN 'application/octet-stream' ELSE 'text/plain' END AS mime,
               text
        FROM documents""",
    "tenant_events": lambda: """
        SELECT *, concat('src', user_id % 20) AS tenant_id,
               ['Owner', 'Admin', 'Member', 'Viewer'][(user_id + user_id // 20) % 4 + 1] AS role,
               CASE event_type WHEN 'purchase' THEN 'upload' WHEN 'error' THEN 'delete'
                    WHEN 'signup' THEN 'manage_keys' ELSE 'view' END AS action
        FROM events""",
    "permissions": lambda: "SELECT * FROM (VALUES "
    + ", ".join(f"('{r}', '{a}')" for r, actions in PERMISSIONS.items() for a in actions)
    + ") t(role, action)",
    "stop": lambda: f"SELECT * FROM (VALUES {_stop_rows()}) t(lang, word)",
    "doc_lines": lambda: """
        SELECT doc_id, tenant_id, lang, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS line_no
        FROM docs""",
    "line_marks": lambda: f"""
        SELECT *, coalesce(sum(n_tok) OVER (PARTITION BY doc_id ORDER BY line_no
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_tok,
               (line_no - 1) // 10 + 1 AS page_no
        FROM (SELECT doc_id, line_no, len({TOKENS.format('line')}) AS n_tok FROM doc_lines)""",
    "doc_toks": lambda: f"SELECT doc_id, tenant_id, lang, {TOKENS.format('text')} AS toks FROM docs",
    "spans": lambda: """
        SELECT doc_id, tenant_id, lang, toks, s AS own, s AS start_tok, least(s + 500, len(toks)) AS end_tok,
               s // 450 AS i
        FROM (SELECT *, unnest(range(0, greatest(len(toks) - 51, 0) + 1, 450)) AS s
              FROM doc_toks WHERE len(toks) > 0)""",
    "chunks": lambda: _chunk_select("spans"),
    "pieces": lambda: """
        SELECT doc_id, first_tok + p AS tok_at, (first_tok + p) // 450 AS i
        FROM (SELECT *, unnest(range(0, n_tok, 100)) AS p FROM line_marks WHERE n_tok > 0)""",
    "structured_spans": lambda: """
        SELECT doc_id, tenant_id, lang, toks, own, greatest(own - 50, 0) AS start_tok,
               coalesce(lead(own) OVER (PARTITION BY doc_id ORDER BY i), len(toks)) AS end_tok, i
        FROM (SELECT doc_id, i, min(tok_at) AS own FROM pieces GROUP BY ALL) JOIN doc_toks USING (doc_id)""",
    "structured_chunks": lambda: _chunk_select("structured_spans"),
    "words": lambda: f"""
        SELECT tenant_id, doc_id, chunk_id, lang, len(ws) AS chunk_terms, unnest(ws) AS term,
               generate_subscripts(ws, 1) - 1 AS pos
        FROM (SELECT *, {WORDS.format('text')} AS ws FROM chunks)""",
    "kept": lambda: """
        SELECT w.* FROM words w ANTI JOIN stop s ON w.lang = s.lang AND w.term = s.word""",
    "postings": lambda: """
        SELECT tenant_id, term, chunk_id, doc_id, count(*) AS tf,
               list(pos ORDER BY pos) AS positions, chunk_terms
        FROM kept GROUP BY tenant_id, term, chunk_id, doc_id, chunk_terms""",
    "terms": lambda: """
        SELECT tenant_id, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM postings GROUP BY ALL""",
    "corpus": lambda: f"""
        SELECT tenant_id, count(*) AS n_chunks, sum(len({WORDS.format('text')}))::BIGINT AS n_terms
        FROM chunks GROUP BY ALL""",
    "asked_stops": lambda: f"""
        SELECT b.item_id, s.lang, count(*) AS n
        FROM (SELECT item_id, unnest({WORDS.format('text')}) AS term FROM benchmark) b
        JOIN stop s ON s.word = b.term GROUP BY ALL""",
    "asked": lambda: """
        SELECT item_id AS query_id, concat('src', item_id % 20) AS tenant_id,
               coalesce((SELECT l.lang FROM asked_stops l WHERE l.item_id = b.item_id
                         ORDER BY l.n DESC, l.lang LIMIT 1), 'en') AS lang, text
        FROM benchmark b""",
    "web_asked": lambda: """
        SELECT query_id, tenant_id, lang,
               CASE query_id % 5
                 WHEN 0 THEN array_to_string(w, ' ')
                 WHEN 1 THEN concat('"', array_to_string(w, ' '), '"')
                 WHEN 2 THEN array_to_string(w, ' or ')
                 WHEN 3 THEN concat(array_to_string(w[1:len(w) - 1], ' or '), ' -', w[len(w)])
                 ELSE concat(array_to_string(w[1:greatest(len(w) - 2, 0)], ' or '), ' or "',
                             array_to_string(w[greatest(len(w) - 1, 1):], ' '), '"') END AS text
        FROM (SELECT *, list_filter(string_split(text, ' '), lambda t: t <> '') AS w FROM asked)
        WHERE len(w) > 0""",
    "labelled": lambda: """
        SELECT b.item_id, d.tenant_id, d.doc_id, concat(b.item_id, '@', d.tenant_id) AS query_id
        FROM benchmark b JOIN docs d ON contains(d.text, b.text)""",
    "eval_asked": lambda: """
        SELECT DISTINCT l.query_id, l.tenant_id, a.lang, a.text
        FROM labelled l JOIN asked a ON a.query_id = l.item_id""",
    "qrels": lambda: "SELECT query_id, doc_id FROM labelled",
}


def _chunk_select(spans: str) -> str:
    """Chunk rows; the pages come from the last line that starts at or before a token."""
    return f"""
        SELECT s.tenant_id, s.doc_id, concat(s.doc_id, ':', s.i) AS chunk_id, s.lang,
               a.page_no, b.page_no AS last_page, s.start_tok, s.end_tok - s.start_tok AS n_tokens,
               array_to_string(s.toks[s.start_tok + 1 : s.end_tok], ' ') AS text
        FROM (SELECT *, end_tok - 1 AS final_tok FROM {spans}) s
        ASOF JOIN (SELECT * FROM line_marks WHERE n_tok > 0) a
          ON s.doc_id = a.doc_id AND s.own >= a.first_tok
        ASOF JOIN (SELECT * FROM line_marks WHERE n_tok > 0) b
          ON s.doc_id = b.doc_id AND s.final_tok >= b.first_tok"""


def _embed(source: str, key: str) -> dict[str, str]:
    """Signed feature hashing of ``source`` as sparse float cells."""
    cells = f"""
        SELECT {key}, tenant_id, bucket, sum(sign)::DOUBLE AS s
        FROM (SELECT {key}, tenant_id,
                     CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % {reg.DIM} AS bucket,
                     1 - 2 * (CAST(('0x' || substr(h, 9, 1)) AS BIGINT) % 2) AS sign
              FROM (SELECT {key}, tenant_id, md5(unnest({WORDS.format('text')})) AS h FROM {source}))
        GROUP BY ALL"""
    return {
        f"{source}_raw": cells,
        f"{source}_cells": f"""
        SELECT r.{key}, r.tenant_id, bucket, (s / n)::FLOAT::DOUBLE AS v
        FROM {source}_raw r
        JOIN (SELECT {key}, sqrt(sum(s * s)) AS n FROM {source}_raw GROUP BY ALL) l USING ({key})
        WHERE s <> 0 AND n > 0""",
        f"{source}_norms": f"""
        SELECT {key}, tenant_id, sqrt(sum(v * v)) AS n FROM {source}_cells GROUP BY ALL""",
    }


def _dense(asked: str, k: int = reg.POOL) -> dict[str, str]:
    return {
        **_embed("chunks", "chunk_id"),
        **_embed(asked, "query_id"),
        "dense": f"""
        SELECT * FROM (
          SELECT query_id, chunk_id, distance,
                 row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank
          FROM (
            SELECT q.query_id, c.chunk_id, round(1 - coalesce(d.dot, 0) / (q.n * c.n), 6) + 0.0 AS distance
            FROM {asked}_norms q JOIN chunks_norms c USING (tenant_id)
            LEFT JOIN (SELECT x.query_id, y.chunk_id, sum(x.v * y.v) AS dot
                       FROM {asked}_cells x JOIN chunks_cells y USING (tenant_id, bucket)
                       GROUP BY ALL) d ON d.query_id = q.query_id AND d.chunk_id = c.chunk_id))
        WHERE rank <= {k}""",
    }


def _parsed(asked: str) -> dict[str, str]:
    return {
        "items": rf"""
        SELECT query_id, tenant_id, lang, i, item,
               sum(CASE WHEN joins OR coalesce(prev, false) THEN 0 ELSE 1 END)
                 OVER (PARTITION BY query_id ORDER BY i)::BIGINT AS grp, joins
        FROM (SELECT *, lag(joins) OVER (PARTITION BY query_id ORDER BY i) AS prev
              FROM (SELECT query_id, tenant_id, lang, unnest(xs) AS item,
                           generate_subscripts(xs, 1) AS i,
                           lower(item) = 'or' AND i > 1 AND i < len(xs) AS joins
                    FROM (SELECT *, list_filter(
                            regexp_extract_all(text, '(-?"[^"]*"?|[^\s"]+)', 1), lambda x: x <> '') AS xs
                          FROM {asked})))""",
        "item_words": f"""
        SELECT query_id, tenant_id, grp, i AS alt, starts_with(item, '-') AS negated, term, pos,
               pos - min(pos) OVER (PARTITION BY query_id, i) AS off,
               count(*) OVER (PARTITION BY query_id, i) AS n_terms
        FROM (SELECT w.* FROM (
                SELECT *, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos
                FROM (SELECT *, {WORDS.format('item')} AS ws FROM items WHERE NOT joins)) w
              ANTI JOIN stop s ON w.lang = s.lang AND w.term = s.word)""",
        "parsed": """
        SELECT query_id, tenant_id, grp, alt,
               CASE WHEN negated THEN 'not' WHEN n_terms > 1 THEN 'phrase' ELSE 'word' END AS kind,
               term, off, n_terms
        FROM item_words""",
    }


def _bm25(asked: str, k: int, match: str = "any") -> dict[str, str]:
    keep = "SEMI JOIN matched USING (query_id, chunk_id)" if match == "all" else ""
    return {
        **_parsed(asked),
        **(_matched() if match == "all" else {}),
        "scored": f"""
        SELECT query_id, chunk_id, doc_id, score FROM (
          SELECT q.query_id, p.chunk_id, p.doc_id,
                 round(sum(ln(1 + (c.n_chunks - t.df + 0.5) / (t.df + 0.5)) * p.tf * 2.2
                   / (p.tf + 1.2 * (0.25 + 0.75 * p.chunk_terms / (c.n_terms / c.n_chunks)))), 6) + 0.0 AS score
          FROM (SELECT DISTINCT query_id, tenant_id, term FROM parsed WHERE kind <> 'not') q
          JOIN terms t USING (tenant_id, term) JOIN corpus c USING (tenant_id)
          JOIN postings p USING (tenant_id, term)
          GROUP BY ALL) {keep}""",
        "lexical": f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
                       FROM scored) WHERE rank <= {k}""",
    }


def _matched() -> dict[str, str]:
    return {
        "held": """
        SELECT DISTINCT query_id, grp, kind, chunk_id, doc_id FROM (
          SELECT query_id, grp, alt, kind, chunk_id, doc_id, n_terms, origin
          FROM (SELECT q.*, p.chunk_id, p.doc_id, unnest(p.positions) - q.off AS origin
                FROM parsed q JOIN postings p USING (tenant_id, term))
          GROUP BY ALL HAVING count(DISTINCT off) = n_terms)""",
        "matched": """
        SELECT query_id, chunk_id, doc_id
        FROM held JOIN (SELECT query_id, count(DISTINCT grp) AS need FROM parsed
                        WHERE kind <> 'not' GROUP BY ALL) USING (query_id)
        GROUP BY query_id, chunk_id, doc_id, need
        HAVING count(DISTINCT CASE WHEN kind <> 'not' THEN grp END) = need AND NOT bool_or(kind = 'not')""",
    }


def _fused(k: int = reg.POOL) -> dict[str, str]:
    return {
        "fused": f"""
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
          FROM (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) + 0.0 AS score
                FROM (SELECT query_id, chunk_id, rank FROM dense
                      UNION ALL SELECT query_id, chunk_id, rank FROM lexical) GROUP BY ALL))
        WHERE rank <= {k}"""
    }


def _wants(asked: str) -> dict[str, str]:
    """The distinct words of each question that are no stop words."""
    return {
        "wants": f"""
        SELECT query_id, coalesce(wanted, []) AS wanted
        FROM {asked} LEFT JOIN (
          SELECT query_id, list(DISTINCT term) AS wanted
          FROM (SELECT w.* FROM (SELECT query_id, lang, unnest({WORDS.format('text')}) AS term FROM {asked}) w
                ANTI JOIN stop s ON w.lang = s.lang AND w.term = s.word)
          GROUP BY query_id) USING (query_id)"""
    }


def _reranked(asked: str, pool: str, k: int) -> dict[str, str]:
    pairs = "list_distinct(list_transform(range(1, len({0})), lambda i: concat({0}[i], ' ', {0}[i + 1])))"
    share = "CASE WHEN len({0}) > 0 THEN len(list_intersect({0}, {1})) / len({0}) ELSE 0.0 END"
    return {
        **_wants(asked),
        "asked_words": f"""
        SELECT query_id, ws, {pairs.format('ws')} AS pairs, wanted
        FROM (SELECT query_id, {WORDS.format('text')} AS ws FROM {asked}) JOIN wants USING (query_id)""",
        "reranked": f"""
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
          FROM (SELECT p.query_id, p.chunk_id, c.doc_id,
                       round(0.6 * ({share.format('q.wanted', 'c.ws')})
                           + 0.4 * ({share.format('q.pairs', 'c.pairs')}), 6) + 0.0 AS score
                FROM {pool} p JOIN asked_words q USING (query_id)
                JOIN (SELECT chunk_id, doc_id, ws, {pairs.format('ws')} AS pairs
                      FROM (SELECT *, {WORDS.format('text')} AS ws FROM chunks)) c USING (chunk_id)))
        WHERE rank <= {k}""",
    }


def _packed() -> dict[str, str]:
    return {
        **_bm25("asked", reg.TOP),
        "packed": f"""
        SELECT * FROM (
          SELECT l.query_id, l.chunk_id, l.rank, c.doc_id, c.page_no, c.n_tokens, c.text,
                 sum(c.n_tokens) OVER (PARTITION BY l.query_id ORDER BY l.rank)::BIGINT AS used_tokens
          FROM lexical l JOIN chunks c USING (chunk_id))
        WHERE used_tokens <= {reg.BUDGET}""",
    }


def _sentences(text: str) -> str:
    split = f"regexp_split_to_array({text}, '{SENTENCE_END}')"
    return f"list_filter(list_transform({split}, lambda s: trim(s)), lambda s: s <> '')"


def _answers() -> dict[str, str]:
    share = "CASE WHEN len(wanted) > 0 THEN len(list_intersect(wanted, {0})) / len(wanted) ELSE 0.0 END"
    return {
        **_packed(),
        **_wants("asked"),
        "answers": f"""
        SELECT query_id, string_agg(concat(sentence, ' [', doc_id, ', Page ', page_no, ']'), ' ' ORDER BY rank) AS answer,
               count(*) AS n_cited
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, pos) AS nth
              FROM (SELECT *, round({share.format(WORDS.format('sentence'))}, 6) AS score
                    FROM (SELECT p.*, wanted, unnest({_sentences('text')}) AS sentence,
                                 generate_subscripts({_sentences('text')}, 1) AS pos
                          FROM packed p JOIN wants USING (query_id))))
        WHERE nth = 1 GROUP BY query_id""",
    }


def _judged(hits: str, name: str) -> dict[str, str]:
    """Scores of a ranked chunk list ``(query_id, doc_id, rank)`` against the labels, at 10."""
    return {
        f"{name}_docs": f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, doc_id) AS r
                       FROM (SELECT query_id, doc_id, min(rank) AS best FROM {hits} GROUP BY ALL))
        WHERE r <= 10""",
        f"{name}_judged": f"""
        SELECT s.query_id, s.n_relevant,
               round(coalesce(f.n, 0) / s.n_relevant, 6) AS recall,
               round(coalesce(f.n, 0) / 10.0::DOUBLE, 6) AS precision,
               round(coalesce(1.0::DOUBLE / f.first, 0), 6) AS mrr,
               round(coalesce(f.gain, 0) / list_sum(list_transform(
                 range(1, least(s.n_relevant, 10) + 1), lambda x: 1 / log2(x + 1))), 6) AS ndcg
        FROM (SELECT query_id, count(DISTINCT doc_id) AS n_relevant FROM qrels GROUP BY ALL) s
        LEFT JOIN (SELECT query_id, count(*) AS n, min(r) AS first, sum(1 / log2(r + 1)) AS gain
                   FROM {name}_docs SEMI JOIN qrels USING (query_id, doc_id) GROUP BY ALL) f
        USING (query_id)""",
    }


def _sql(final: str, **extra: str) -> str:
    """``final`` with the parts it needs, as one statement."""
    parts = {name: make() for name, make in PARTS.items()}
    parts.update(extra)
    order = list(parts)

    def uses(text: str) -> set[str]:
        import re

        return {n for n in order if re.search(rf"\b{n}\b", text)}

    needed, open_ = set(), uses(final)
    while open_:
        name = open_.pop()
        if name not in needed:
            needed.add(name)
            open_ |= uses(parts[name]) - needed - {name}
    ctes = ",\n".join(
        f"{n} AS MATERIALIZED ({parts[n]})" for n in order if n in needed
    )
    return f"WITH {ctes}\n{final}" if ctes else final


def _add(name: str, final: str, parts: Callable[[], dict[str, str]] = dict) -> None:
    ORACLE[name] = lambda: _sql(final, **parts())


_add(
    "scan_documents",
    f"""SELECT doc_id, tenant_id, lang, source, n_chars, {TIME.format('uploaded_at')} AS uploaded_at,
               n_bytes, mime, md5(text) AS text_md5 FROM docs""",
)
REASON = """CASE WHEN n_bytes IS NULL OR n_bytes = 0 THEN 'empty' WHEN n_bytes > 10000 THEN 'too_large'
            WHEN mime <> 'text/plain' THEN 'unsupported_type' END"""
_add(
    "validate_uploads",
    f"""SELECT doc_id, tenant_id, n_bytes, {REASON} AS reason,
               CASE WHEN {REASON} IS NULL THEN 'PENDING' ELSE 'REJECTED' END AS status FROM docs""",
)
_add(
    "upload_quota",
    f"""SELECT doc_id, tenant_id, {TIME.format('uploaded_at')} AS uploaded_at,
               CASE WHEN n <= 3 THEN n END AS slot, n <= 3 AS admitted
        FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY uploaded_at, doc_id) AS n FROM docs)""",
)
_add(
    "extract_pages",
    """SELECT tenant_id, doc_id, CAST((line_no - 1) // 10 + 1 AS BIGINT) AS page_no, line_no,
              ends - length(line) - 1 AS char_start, ends - 1 AS char_end, md5(line) AS text_md5
       FROM (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS ends
             FROM doc_lines)""",
)


def _html() -> str:
    html = "html"
    for pattern in NOISE:
        html = f"regexp_replace({html}, {_quoted(pattern)}, ' ', 'g')"
    bare = r"regexp_replace(regexp_replace(block, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')"
    for entity, plain in ENTITIES:
        bare = f"replace({bare}, {_quoted(entity)}, {_quoted(plain)})"
    blocks = f"regexp_extract_all({html}, {_quoted(BLOCK)})"
    return rf"""SELECT page_id, block_no, kind, md5(plain) AS text_md5 FROM (
        SELECT page_id, block_no, lower(regexp_extract(block, '^<([A-Za-z0-9]+)', 1)) AS kind,
               trim(regexp_replace({bare}, '\s+', ' ', 'g')) AS plain
        FROM (SELECT page_id, unnest({blocks}) AS block, generate_subscripts({blocks}, 1) AS block_no FROM pages))
        WHERE plain <> ''"""


ORACLE["extract_html_text"] = _html
CHUNK_COLUMNS = """tenant_id, doc_id, chunk_id, lang, page_no, last_page, CAST(start_tok AS BIGINT) AS start_tok,
                   CAST(n_tokens AS BIGINT) AS n_tokens, md5(text) AS text_md5"""
_add("chunk_fixed", f"SELECT {CHUNK_COLUMNS} FROM chunks")
_add("chunk_structured", f"SELECT {CHUNK_COLUMNS} FROM structured_chunks")
_add(
    "embed_chunks",
    "SELECT chunk_id, bucket, round(v, 6) + 0.0 AS value FROM chunks_cells",
    lambda: _embed("chunks", "chunk_id"),
)
_add(
    "tenant_view",
    f"SELECT tenant_id, doc_id, lang, n_bytes FROM docs WHERE tenant_id = '{reg.TENANT}'",
)
_add(
    "metadata_filter",
    f"""SELECT tenant_id, doc_id, lang, source, n_chars FROM docs
        WHERE tenant_id = '{reg.TENANT}' AND lang IN ('en', 'fr') AND n_chars BETWEEN 100 AND 5000""",
)
_add(
    "isolation_audit",
    """SELECT count(*) AS n_hits,
              count(*) FILTER (WHERE c.tenant_id IS NULL OR c.tenant_id IS DISTINCT FROM q.tenant_id) AS n_leaks
       FROM reranked r LEFT JOIN chunks c USING (chunk_id) LEFT JOIN asked q ON q.query_id = r.query_id""",
    lambda: {
        **_dense("asked"),
        **_bm25("asked", reg.POOL),
        **_fused(),
        **_reranked("asked", "fused", reg.TOP),
    },
)
_add(
    "authorize",
    """SELECT event_id, tenant_id, e.role, e.action, p.role IS NOT NULL AS allowed
       FROM tenant_events e LEFT JOIN permissions p ON p.role = e.role AND p.action = e.action""",
)
_add(
    "denied_requests",
    """SELECT event_id, tenant_id, role, action
       FROM tenant_events ANTI JOIN permissions USING (role, action)""",
)
EXPIRED = f"uploaded_at < TIMESTAMP '{reg.AS_OF}' - INTERVAL 7 DAY"
_add(
    "retention_expired",
    f"SELECT doc_id, tenant_id, {TIME.format('uploaded_at')} AS uploaded_at FROM docs WHERE {EXPIRED}",
)
_add(
    "write_index",
    f"""SELECT c.tenant_id, c.doc_id, c.chunk_id, CAST(c.n_tokens AS BIGINT) AS n_tokens,
               CAST({reg.DIM} AS BIGINT) AS width, md5(c.text) AS text_md5
        FROM chunks c JOIN docs d USING (doc_id) WHERE NOT {EXPIRED}""",
)
_add(
    "cascade_delete",
    f"""SELECT tenant_id, sum(d)::BIGINT AS n_docs, sum(c)::BIGINT AS n_chunks FROM (
          SELECT tenant_id, 1 AS d, 0 AS c FROM docs WHERE NOT {EXPIRED}
          UNION ALL
          SELECT c.tenant_id, 0, 1 FROM chunks c JOIN docs USING (doc_id) WHERE NOT {EXPIRED})
        GROUP BY ALL""",
)
_add(
    "mark_ready",
    f"""SELECT doc_id, tenant_id, CASE WHEN {REASON} IS NULL AND doc_id IN (SELECT doc_id FROM chunks)
               THEN 'READY' ELSE 'PENDING' END AS status FROM docs""",
)
_add(
    "document_catalog",
    f"""SELECT tenant_id, doc_id, {TIME.format('uploaded_at')} AS uploaded_at, n_bytes,
               CASE WHEN n_chunks > 0 THEN 'READY' ELSE 'PENDING' END AS status,
               coalesce(n_chunks, 0) AS n_chunks, coalesce(t, 0)::BIGINT AS n_tokens,
               coalesce(p, 0)::BIGINT AS n_pages
        FROM docs LEFT JOIN (SELECT doc_id, count(*) AS n_chunks, sum(n_tokens) AS t, max(last_page) AS p
                             FROM chunks GROUP BY ALL) USING (doc_id)""",
)
_add(
    "cosine_distance",
    """SELECT a.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0
              AS distance
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)


def _self_topk(distance: str) -> str:
    return f"""SELECT * FROM (
        SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, distance
        FROM (SELECT a.vec_id AS query_id, b.vec_id, round({distance}, 6) + 0.0 AS distance
              FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a,
                   (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b))
        WHERE rank <= 10"""


_add("dense_topk", _self_topk("1 - list_cosine_similarity(a.e, b.e)"))
_add("euclidean_topk", _self_topk("list_distance(a.e, b.e)"))
_add(
    "tokenize",
    f"""SELECT w.doc_id, w.pos, w.term FROM (
          SELECT doc_id, lang, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos
          FROM (SELECT *, {WORDS.format('text')} AS ws FROM docs)) w
        ANTI JOIN stop s ON w.lang = s.lang AND w.term = s.word""",
)
_add(
    "build_postings",
    """SELECT tenant_id, term, chunk_id, doc_id, chunk_terms, tf, array_to_string(positions, ' ') AS positions
       FROM postings""",
)
_add("term_stats", "SELECT tenant_id, term, df, cf, n_chunks, n_terms FROM terms JOIN corpus USING (tenant_id)")
_add(
    "parse_websearch",
    """SELECT query_id, tenant_id, grp, alt, kind, string_agg(term, ' ' ORDER BY off) AS terms,
              string_agg(off::VARCHAR, ' ' ORDER BY off) AS offsets
       FROM parsed GROUP BY ALL""",
    lambda: _parsed("web_asked"),
)
_add(
    "lexical_match",
    "SELECT query_id, chunk_id, doc_id FROM matched",
    lambda: {**_parsed("web_asked"), **_matched()},
)
_add(
    "like_search",
    """SELECT q.query_id, c.chunk_id, CAST(instr(c.text, q.t) AS BIGINT) AS at
       FROM (SELECT concat(query_id, ':whole') AS query_id, tenant_id, text AS t FROM asked
             UNION ALL
             SELECT concat(query_id, ':short'), tenant_id,
                    array_to_string(list_filter(string_split(text, ' '), lambda t: t <> '')[1 : query_id % 4 + 1], ' ')
             FROM asked) q
       JOIN chunks c ON c.tenant_id = q.tenant_id AND contains(c.text, q.t)""",
)
_add(
    "substring_search",
    """SELECT q.query_id, c.chunk_id, CAST(instr(c.text, q.t) AS BIGINT) AS at
       FROM (SELECT concat(query_id, ':whole') AS query_id, tenant_id, text AS t FROM asked
             UNION ALL SELECT concat(query_id, ':inner'), tenant_id, substr(text, 4, 9) FROM asked
             UNION ALL SELECT concat(query_id, ':head'), tenant_id, substr(text, 1, 2) FROM asked) q
       JOIN chunks c ON c.tenant_id = q.tenant_id AND contains(c.text, q.t)""",
)
HITS = "SELECT query_id, chunk_id, doc_id, rank, score FROM {0}"
_add("bm25_topk", HITS.format("lexical"), lambda: _bm25("asked", reg.POOL))
_add("stream_search", HITS.format("lexical"), lambda: _bm25("asked", reg.POOL))
_add(
    "cover_density",
    HITS.format("close"),
    lambda: {
        "pairs": f"""
        SELECT query_id, tenant_id, term
        FROM (SELECT query_id, tenant_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) AS n
              FROM (SELECT a.* FROM (
                      SELECT query_id, tenant_id, lang, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos
                      FROM (SELECT *, {WORDS.format('text')} AS ws FROM asked)) a
                    ANTI JOIN stop s ON a.lang = s.lang AND a.term = s.word)
              GROUP BY query_id, tenant_id, term) WHERE n <= 2""",
        "places": """
        SELECT query_id, chunk_id, doc_id, term, pos,
               count(*) OVER (PARTITION BY query_id, chunk_id) AS n_places,
               lead(pos) OVER near AS next_pos, lead(term) OVER near AS next_term
        FROM (SELECT q.query_id, p.chunk_id, p.doc_id, p.term, unnest(p.positions) AS pos
              FROM pairs q JOIN postings p USING (tenant_id, term))
        WINDOW near AS (PARTITION BY query_id, chunk_id ORDER BY pos)""",
        "close": f"""
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
          FROM (SELECT query_id, chunk_id, doc_id, round(sum(score), 6) + 0.0 AS score
                FROM (SELECT query_id, chunk_id, doc_id, 1.0::DOUBLE / (next_pos - pos) AS score
                      FROM places WHERE next_term <> term
                      UNION ALL
                      SELECT query_id, chunk_id, doc_id, 1.0::DOUBLE FROM places
                      WHERE query_id IN (SELECT query_id FROM pairs GROUP BY ALL HAVING count(*) = 1))
                GROUP BY ALL))
        WHERE rank <= {reg.POOL}""",
    },
)
_add("bm25_topk_all", HITS.format("lexical"), lambda: _bm25("web_asked", reg.POOL, "all"))
_add(
    "rrf_fuse",
    "SELECT query_id, chunk_id, score, rank FROM fused",
    lambda: {**_dense("asked"), **_bm25("asked", reg.POOL), **_fused()},
)
_add(
    "candidate_pool",
    """SELECT query_id, chunk_id, bool_or(d) AS in_dense, bool_or(NOT d) AS in_lexical
       FROM (SELECT query_id, chunk_id, true AS d FROM dense
             UNION ALL SELECT query_id, chunk_id, false FROM lexical) GROUP BY ALL""",
    lambda: {**_dense("asked"), **_bm25("asked", reg.POOL)},
)
_add(
    "rerank",
    HITS.format("reranked"),
    lambda: {**_bm25("asked", reg.POOL), **_reranked("asked", "lexical", reg.TOP)},
)
_add(
    "hybrid_search",
    HITS.format("reranked"),
    lambda: {
        **_dense("asked"),
        **_bm25("asked", reg.POOL),
        **_fused(),
        **_reranked("asked", "fused", reg.TOP),
    },
)
_add(
    "pack_context",
    "SELECT query_id, chunk_id, rank, CAST(n_tokens AS BIGINT) AS n_tokens, used_tokens FROM packed",
    _packed,
)
_add(
    "cite",
    "SELECT query_id, chunk_id, concat('[', doc_id, ', Page ', page_no, ']') AS citation FROM packed",
    _packed,
)
_add("extractive_answer", "SELECT query_id, answer, n_cited FROM answers", _answers)
_add(
    "check_citations",
    """SELECT query_id, count(*) FILTER (WHERE p.ok) AS n_supported,
              count(*) FILTER (WHERE p.ok IS NULL) AS n_unsupported
       FROM (SELECT query_id, regexp_extract(c, '\\[(\\d+), Page (\\d+)\\]', 1)::BIGINT AS doc_id,
                    regexp_extract(c, '\\[(\\d+), Page (\\d+)\\]', 2)::BIGINT AS page_no
             FROM (SELECT query_id, unnest(regexp_extract_all(
                     CASE WHEN query_id % 3 = 0 THEN concat(answer, ' [999999999, Page 9]') ELSE answer END,
                     '\\[\\d+, Page \\d+\\]')) AS c FROM answers)) a
       LEFT JOIN (SELECT DISTINCT query_id, doc_id, page_no, true AS ok FROM packed) p
         USING (query_id, doc_id, page_no)
       GROUP BY query_id""",
    _answers,
)
_add(
    "history_window",
    f"""SELECT conv_id, turn, role, n_tokens, used_tokens FROM (
          SELECT *, sum(n_tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC)::BIGINT AS used_tokens
          FROM (SELECT *, len({TOKENS.format('text')}) AS n_tokens,
                       row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age
                FROM conversations WHERE role <> 'system') WHERE age <= 4) WHERE used_tokens <= 200
        UNION ALL
        SELECT conv_id, turn, role, len({TOKENS.format('text')}), NULL FROM conversations WHERE role = 'system'""",
)
_add(
    "history_summary",
    f"""SELECT conv_id, count(*) AS n_turns,
               sum(len({TOKENS.format('text')}))::BIGINT AS n_tokens,
               string_agg(coalesce(({_sentences('text')})[1], ''), ' | ' ORDER BY turn) AS summary
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age
              FROM conversations WHERE role <> 'system') WHERE age > 2 GROUP BY ALL""",
)
_add(
    "compact_prompt",
    rf"""SELECT doc_id, md5(compact) AS compact, len({TOKENS.format('text')}) AS tokens_before,
                len({TOKENS.format('compact')}) AS tokens_after
         FROM (SELECT d.doc_id, d.text, coalesce(c.compact, '') AS compact FROM docs d LEFT JOIN (
           SELECT doc_id, string_agg(line, chr(10) ORDER BY first_no) AS compact FROM (
             SELECT doc_id, line, min(line_no) AS first_no FROM (
               SELECT doc_id, line_no, trim(regexp_replace(line, '[ \t\r\f]+', ' ', 'g')) AS line FROM doc_lines)
             WHERE line <> '' GROUP BY ALL) GROUP BY doc_id) c USING (doc_id))""",
)


def _scrub() -> str:
    text = "text"
    for pattern in SECRETS.values():
        text = f"regexp_replace({text}, {_quoted(pattern)}, '\\1{REDACTED}', 'g')"
    return _sql(f"SELECT doc_id, md5({text}) AS text_md5 FROM docs")


def _found(table: str, text: str, patterns: dict[str, str], keys: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {keys}, '{name}' AS pattern, len(regexp_extract_all({text}, {_quoted(p)})) AS n FROM {table}"
        for name, p in patterns.items()
    )
    return f"""SELECT {keys.split(' AS ')[-1]}, pattern, sum(n)::BIGINT AS n_found,
                      count(*) FILTER (WHERE n > 0) AS n_rows FROM ({rows}) GROUP BY ALL"""


ORACLE["scrub_secrets"] = _scrub
ORACLE["secret_scan"] = lambda: _sql(_found("docs", "text", SECRETS, "source"))
ORACLE["injection_flags"] = lambda: " UNION ALL ".join(
    (
        _found("pages", "html", INJECTIONS, "'pages' AS origin"),
        _found("documents", "text", INJECTIONS, "'documents' AS origin"),
    )
)
_add(
    "hidden_instructions",
    f"""SELECT coalesce(doc_id % 6, 0)::BIGINT AS form, count(*) AS n_docs,
               count(*) FILTER (WHERE text IS NOT NULL AND coalesce(doc_id % 6, 0) >= 2
                                OR {' OR '.join(f"regexp_matches(text, '{INJECTIONS[n]}')" for n in WORDING)}) AS n_flagged,
               count(*) FILTER (WHERE text IS NOT NULL AND doc_id % 6 = 5) AS n_decoded
        FROM documents GROUP BY ALL""",
)
_add("encrypt_keys", "SELECT DISTINCT user_id, true AS opens, true AS sealed FROM events")
ORACLE["dataset_health"] = lambda: " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, CASE WHEN count(*) > 0 THEN 'healthy' ELSE 'empty' END AS status,
        '0.1.0' AS version, count(*) AS n_rows FROM {t}"""
    for t in schemas.TABLES
)
_add(
    "usage_stats",
    """SELECT tenant_id, event_type, grouping(tenant_id, event_type)::BIGINT AS level, count(*) AS n_events,
              round(sum(value), 6) + 0.0 AS total_value
       FROM tenant_events GROUP BY ROLLUP (tenant_id, event_type)""",
)
_add(
    "tenant_dashboard",
    f"""SELECT tenant_id, coalesce(n_docs, 0) AS n_docs, concat(coalesce(n_docs, 0), ' / 3') AS documents,
               {TIME.format('next_expiry')} AS next_expiry, {TIME.format('last_activity')} AS last_activity,
               coalesce(n_events, 0) AS n_events
        FROM (SELECT tenant_id, count(*) AS n_docs, min(uploaded_at) + INTERVAL 7 DAY AS next_expiry
              FROM docs GROUP BY ALL)
        FULL JOIN (SELECT tenant_id, max(ts) AS last_activity, count(*) AS n_events
                   FROM tenant_events GROUP BY ALL) USING (tenant_id)""",
)
_add(
    "latency_breakdown",
    """SELECT event_type AS stage, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n,
              round(avg(value), 6) AS mean_latency, round(avg((event_type = 'error')::INT), 6) AS error_share,
              round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
              round(quantile_cont(value, 0.99), 6) AS p99
       FROM events GROUP BY ALL""",
)
_add(
    "latency_trailing",
    """SELECT stage, strftime(day, '%Y-%m-%d') AS day, max(n)::BIGINT AS n,
              min(value) FILTER (upto * 1000 >= n * 500) AS p50,
              min(value) FILTER (upto * 1000 >= n * 950) AS p95,
              min(value) FILTER (upto * 1000 >= n * 990) AS p99
       FROM (SELECT *, sum(weight) OVER (PARTITION BY stage, day) AS n,
                    sum(weight) OVER (PARTITION BY stage, day ORDER BY value) AS upto
             FROM (SELECT d.stage, d.day, value, sum(weight) AS weight
                   FROM (SELECT DISTINCT stage, day FROM points) d
                   JOIN points p ON p.stage = d.stage AND p.day BETWEEN d.day - 6 AND d.day
                   GROUP BY ALL))
       GROUP BY ALL""",
    lambda: {
        "ranks": """
        SELECT *, sum(c) OVER (PARTITION BY stage, day) AS n, sum(c) OVER (PARTITION BY stage, day ORDER BY value) AS upto
        FROM (SELECT event_type AS stage, CAST(ts AS DATE) AS day, value, count(*) AS c
              FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL)""",
        "points": """
        SELECT stage, day, value, upto - lag(upto, 1, 0) OVER (PARTITION BY stage, day ORDER BY value) AS weight
        FROM (SELECT *, greatest(1, n // 100) AS step FROM ranks)
        WHERE upto // step > (upto - c) // step OR upto = n""",
    },
)
_add(
    "tool_call_stats",
    """SELECT TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS arg, count(*) AS n_calls,
              count(*) FILTER (WHERE event_type = 'error') AS n_failed, round(avg(value), 6) AS mean_latency
       FROM events GROUP BY ALL""",
)
_add(
    "argument_stats",
    """SELECT path, kind, count(*) AS n_calls, sum(n)::BIGINT AS n_values,
              count(*) FILTER (WHERE event_type = 'error') AS n_failed
       FROM (SELECT event_id, event_type, path, kind, count(*) AS n FROM (
               SELECT event_id, event_type, j.fullkey AS path,
                      CASE j.type WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT'
                                  WHEN 'NULL' THEN 'VOID' ELSE j.type END AS kind
               FROM events, json_tree(CASE WHEN json_valid(props) THEN props END) j
               UNION ALL
               SELECT event_id, event_type, NULL, 'malformed' FROM events
               WHERE NOT coalesce(json_valid(props), false))
             GROUP BY ALL)
       GROUP BY ALL""",
)
_add("qrels_from_passages", "SELECT item_id, tenant_id, doc_id FROM labelled")
_add(
    "retrieval_metrics",
    "SELECT * FROM lexical_judged",
    lambda: {**_bm25("eval_asked", reg.POOL), **_judged("lexical", "lexical")},
)


def _compare() -> str:
    parts = {
        **_dense("eval_asked"),
        **_bm25("eval_asked", reg.POOL),
        **_fused(),
        **_reranked("eval_asked", "fused", reg.POOL),
        "liked": f"""
        SELECT * FROM (SELECT q.query_id, c.chunk_id,
                              row_number() OVER (PARTITION BY q.query_id
                                                 ORDER BY instr(c.text, q.text), c.chunk_id) AS rank
                       FROM eval_asked q JOIN chunks c ON c.tenant_id = q.tenant_id AND contains(c.text, q.text))
        WHERE rank <= {reg.POOL}""",
    }
    for name, source in {"d": "dense", "f": "fused", "l": "liked"}.items():
        parts[f"hits_{name}"] = f"SELECT query_id, doc_id, rank FROM {source} JOIN chunks USING (chunk_id)"
    methods = {
        "dense": "hits_d",
        "lexical": "lexical",
        "like": "hits_l",
        "fused": "hits_f",
        "reranked": "reranked",
    }
    rows = []
    for name, hits in methods.items():
        parts.update(_judged(hits, f"m_{name}"))
        rows.append(f"SELECT '{name}' AS method, * FROM m_{name}_judged")
    return _sql(
        f"""SELECT method, count(*) AS n_queries, round(avg(recall), 6) AS recall,
                   round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg
            FROM ({' UNION ALL '.join(rows)}) GROUP BY ALL""",
        **parts,
    )


ORACLE["compare_retrievers"] = _compare


def _significance() -> str:
    parts = {**_dense("eval_asked"), **_bm25("eval_asked", reg.POOL), **_fused()}
    hits = {"dense": "hits_d", "fused": "hits_f", "lexical": "lexical"}
    for name, source in {"d": "dense", "f": "fused"}.items():
        parts[f"hits_{name}"] = f"SELECT query_id, doc_id, rank FROM {source} JOIN chunks USING (chunk_id)"
    rows = []
    for name, table in hits.items():
        parts.update(_judged(table, f"m_{name}"))
        rows.append(f"SELECT '{name}' AS method, query_id, round(ndcg * 1e6)::BIGINT AS s FROM m_{name}_judged")
    parts["scores"] = " UNION ALL ".join(rows)
    parts["differences"] = """
        SELECT x.query_id, x.method AS a, y.method AS b, x.s - y.s AS d
        FROM scores x JOIN scores y ON x.query_id = y.query_id AND x.method < y.method"""
    weight = " + ".join(f"(chance >= {p!r}::DOUBLE)::BIGINT" for p in POISSON)
    parts["draws"] = f"""
        SELECT a, b, r, sum(({weight}) * d)::BIGINT AS wd, sum({weight})::BIGINT AS w, sum(sign * d)::BIGINT AS sd
        FROM (SELECT *, ('0x' || substr(h, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS chance,
                     1 - 2 * (('0x' || substr(h, 14, 1))::BIGINT % 2) AS sign
              FROM (SELECT *, md5(concat_ws('|', '{SEED}', r::VARCHAR, query_id)) AS h
                    FROM (SELECT *, unnest(range({reg.RESAMPLES})) AS r FROM differences)))
        GROUP BY ALL"""
    parts["observed"] = "SELECT a, b, count(*) AS n_queries, sum(d)::BIGINT AS total FROM differences GROUP BY ALL"
    tail = (1 - COVERED) / 2
    at = "means[greatest(ceil(len(means) * {}::DOUBLE), 1)::BIGINT]"
    return _sql(
        f"""SELECT a, b, n_queries, round(total / n_queries::DOUBLE / 1e6, 6) + 0.0 AS difference,
                   round({at.format(repr(tail))}, 6) + 0.0 AS low, round({at.format(repr(1 - tail))}, 6) + 0.0 AS high,
                   round((n_extreme + 1) / {reg.RESAMPLES + 1}.0::DOUBLE, 6) AS p_value
            FROM (SELECT a, b, n_queries, total, list_sort(list(wd::DOUBLE / w / 1e6) FILTER (WHERE w > 0)) AS means,
                         count(*) FILTER (WHERE abs(sd) >= abs(total)) AS n_extreme
                  FROM draws JOIN observed USING (a, b) GROUP BY ALL)""",
        **parts,
    )


ORACLE["retriever_significance"] = _significance
_add(
    "rate_limit",
    f"""SELECT event_id, user_id, n AS attempts, n > {reg.LIMIT} AS throttled
        FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
                RANGE BETWEEN {reg.WINDOW_SECONDS * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS n FROM events)""",
)
_add(
    "fixed_counters",
    f"""SELECT user_id, {TIME.format("date_trunc('hour', ts)")} AS window_start, count(*) AS n
        FROM events GROUP BY ALL""",
)
_add(
    "stream_ingest",
    f"""SELECT c.tenant_id, c.doc_id, c.chunk_id, c.page_no, CAST(c.n_tokens AS BIGINT) AS n_tokens,
               md5(c.text) AS text_md5
        FROM chunks c JOIN docs d USING (doc_id) WHERE {REASON} IS NULL""",
)
_add(
    "stream_status",
    f"""SELECT doc_id, tenant_id, {TIME.format('uploaded_at')} AS uploaded_at, {REASON} AS reason,
               CASE WHEN {REASON} IS NOT NULL THEN 'REJECTED'
                    WHEN doc_id IN (SELECT doc_id FROM chunks) THEN 'READY' ELSE 'PENDING' END AS status
        FROM docs""",
)
ORACLE["stream_admission"] = lambda: f"""
    WITH RECURSIVE tries AS (
        SELECT user_id, event_id, epoch_us(ts) AS m,
               row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n
        FROM events
    ), judged AS (
        SELECT user_id, event_id, n, true AS admitted, [m] AS kept FROM tries WHERE n = 1
        UNION ALL
        SELECT user_id, event_id, n, len(live) < {reg.LIMIT},
               CASE WHEN len(live) < {reg.LIMIT} THEN list_append(live, m) ELSE live END
        FROM (SELECT t.*, list_filter(j.kept, lambda k: k > t.m - {reg.WINDOW_SECONDS * 1_000_000}) AS live
              FROM judged j JOIN tries t ON t.user_id = j.user_id AND t.n = j.n + 1)
    )
    SELECT event_id, user_id, admitted FROM judged"""
_add(
    "stream_rate_windows",
    f"""SELECT user_id, {TIME.format('s')} AS window_start, count(*) AS n
        FROM (SELECT user_id, date_trunc('hour', ts) - to_hours(unnest(range(0, 6))) AS s FROM events)
        WHERE s + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)
        GROUP BY ALL""",
)
_add(
    "stream_retention",
    f"""SELECT doc_id, tenant_id, {TIME.format('uploaded_at + INTERVAL 7 DAY')} AS expires_at
        FROM docs WHERE uploaded_at + INTERVAL 7 DAY < (SELECT max(uploaded_at) FROM docs)""",
)
