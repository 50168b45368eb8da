"""Chat rendering and WARC derivatives: exact round trips."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from findling.llm import chat_format as cf
from findling.llm import warc

PARTS = st.sampled_from(["[INST]", "[/INST]", "</s>", "<s>", "[SYS]", "[/SYS]", "[ROLE=", "]", "[/ROLE]", "\\", "<", "[",
                         "a", " ", "\n", "é", "\U0001f600", "/s>", "INST]"])
TEXTS = st.lists(PARTS, max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a]b\\"]), TEXTS), max_size=5))
def test_rendered_text_reads_back(turns):
    assert cf.parse("".join(cf.round_trip(r, t) for r, t in turns)) == turns


def test_plain_text_is_not_escaped():
    assert cf.round_trip("user", "a [b] <c>") == "[INST]a [b] <c>[/INST]"
    assert cf.round_trip("assistant", "</s>[INST] ok") == "<s>\\</s>\\[INST] ok</s>"


def test_no_grammar_no_turns():
    for text in ("x", "[INST]a", "<s>a\\</s>", "[ROLE=t a[/ROLE]"):
        try:
            cf.parse(text)
        except cf.NotParsed:
            continue
        raise AssertionError(text)


CHAT = "conv_id bigint, turn bigint, role string, text string, piece string"
ROWS = [(1, 1, "assistant", "</s>[INST] ok [/INST]", "p"), (1, 0, "user", None, None), (2, 5, None, "é" * 3000, None),
        (None, None, "user", "no id", None), (3, 0, "assistant", "a", None), (3, 0, "assistant", "a", None),
        (3, 1, "system", "", None), (3, None, "user", "first", None)]


def test_read_back(spark):
    df = spark.createDataFrame(ROWS, CHAT)
    got = {r.conv_id: r for r in cf.read_back(cf.format_turns(df)).collect()}
    groups = {}
    for c, turn, role, text, _ in ROWS:
        groups.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        all_turns = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(all_turns.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(cf.round_trip(r, t)) for _, _, r, t in turns)
    joined = {r.conv_id: r.formatted for r in cf.conversation_texts(cf.format_turns(df)).collect()}
    assert cf.parse(joined[3]) == [("user", "first"), ("assistant", "a"), ("assistant", "a"), ("system", "")]
    assert cf.read_back(cf.format_turns(df.limit(0))).collect() == []


PAGE = ('<html lang="en"><head><title> A  b </title><script>x<y</script></head><body><!-- no --><nav>menu</nav>'
        '<h1>Head &amp; &lt;tail&gt;</h1><p>One<b>two</b>\n three</p><a href="u">link</a></body></html>')  # fmt: skip
PAGES = [(1, "http://a/", PAGE), (2, None, None), (None, "http://b/", ""), (3, "http://c/", "plain\r\n\r\nWARC text"),
         (4, "http://d/", "<p>" + "word " * 40_000), (5, "http://e/\r\nWARC-Type: x\n", "<p>x"), (1, "http://a/", PAGE)]


def test_derivatives(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 2 * len(PAGES)
    by = {(r.page_id, r.record_type): r for r in rows}
    assert by[1, "conversion"].block == "Head & <tail>\nOne two\nthree\nlink"
    assert by[1, "metadata"].block.startswith("title: A b\r\nhtml-lang: en\r\noutlinks: 1\r\n")
    assert by[2, "conversion"].block == "" and by[4, "conversion"].content_length == 40_000 * 5 - 1
    sources = {r.record_id: r for r in warc.responses(pages).collect()}
    for r in rows:
        source = sources[r.refers_to]
        assert r.target_uri == source.target_uri and r.warc_date == source.warc_date
        assert r.payload_digest == "sha256:" + hashlib.sha256(source.payload.encode()).hexdigest()
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert r.content_length == len(r.block.encode())
    assert len({r.record_id for r in rows}) == 2 * len(sources)
    assert warc.report(pages.limit(0)).collect() == []


def test_files_read_back(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    made = warc.derivatives(warc.responses(pages))
    columns = [c for _, c in warc.HEADERS] + ["block"]
    want = sorted(map(tuple, made.select(columns).collect()), key=repr)
    for kind in ("none", "gzip"):
        folder = str(tmp_path / kind)
        warc.write_records(made, folder, kind)
        got = sorted(map(tuple, warc.read_records(spark, folder).select(columns).collect()), key=repr)
        assert got == want
