"""The source divergence audit against plain Python."""

import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

from findling.llm import source_audit as sa

DOC = "text string, lang string, source string, place int, p0 string"
WORDS = "the of été Über data river stone x ab zz 東京 longword and then so we".split()


def plain_report(rows):
    docs = [(t or "", g or "", s or "") for t, g, s, *_ in rows]
    find = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for lang in {g for _, g, _ in docs}:
        own = [(s, Counter(w.translate(low) for w in find(t))) for t, g, s in docs if g == lang]
        df = Counter(w for _, c in own for w in c)
        kept = sorted(w for w, n in df.items() if n >= 3)
        counts = {s: Counter() for s, _ in own}
        for s, c in own:
            counts[s].update(c)
        whole = sum(counts.values(), Counter())

        def share(c, kept=kept):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 1) // (n + len(kept)) for w in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        div = lambda a, b: (a - b) * (a - b) // b
        for s in p:
            pairs = [(o, sum(div(p[s][w], p[o][w]) for w in kept)) for o in p if o != s]
            terms = [(w, div(p[s][w], q[w])) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(found[:most], 1)]
    return sorted(out)


def make_rows():
    rnd = random.Random(5)
    rows = [(None, None, None), ("", "en", "empty"), ("...", "en", None), ("A a a A", "xx", "one"), (None, "xx", "")]
    for i in range(120):
        text = " ".join(rnd.choices(WORDS, k=rnd.randrange(1, 40))) + rnd.choice([".", "!Data", "\x00b"])
        rows.append((text, rnd.choice(["en", "fr", None]), rnd.choice(["s1", "s2", "s3", "é", None, ""])))
    rows.append((" ".join(rnd.choices(WORDS, k=300_000)), "en", "s1"))  # longer than a piece
    rows += [rows[7]] * 50  # a hot text
    return [(*r, 1, "x") for r in rows]


@pytest.mark.parametrize("block", [40, sa.BLOCK_ENTRIES])
def test_audit_equals_plain_python(spark, monkeypatch, block):
    """Blocks of 40 postings spill many runs."""
    monkeypatch.setattr(sa, "BLOCK_ENTRIES", block)
    rows = make_rows()
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    assert sorted(map(tuple, sa.report(docs).collect())) == plain_report(rows)


def test_audit_of_nothing(spark):
    assert sa.report(spark.createDataFrame([], DOC)).count() == 0
    one = spark.createDataFrame([(None, None, None, 1, "")], DOC)
    assert sa.report(one).count() == 0  # a source alone has no pair
    two = spark.createDataFrame([(None, None, None, 1, ""), ("a", "", "s", 1, "")], DOC)
    assert [(r.item, r.value) for r in sa.report(two).orderBy("source").collect()] == [("s", 0), ("", 0)]


def test_text_is_cut_into_pieces_between_terms():
    text = ("Word été " * 500).encode()
    whole = [w for part in sa.term_lists(text) for w in part]
    cut = list(sa.term_lists(text, 10))
    assert [w for part in cut for w in part] == whole and len(cut) > 300


@pytest.mark.parametrize("pool", [4, 50, 10_000])
def test_runs_are_merged_in_order(pool):
    rnd, batches, want = random.Random(pool), [], Counter()
    for _ in range(30):
        block = sa.Block()
        for _ in range(8):
            text = " ".join(rnd.choices(WORDS, k=6))
            lang, source = rnd.choice(["en", "fr"]), rnd.choice("abc")
            block.add(lang, source, text.encode())
            want.update((lang, w.encode().lower().decode(), source) for w in text.split())
        batches += block.spill(1)
    runs = [sa.Run(b, 0, 3) for b in batches]
    parts = list(sa.merged_lines(runs, pool))
    lines = pa.concat_tables(parts).to_pylist()
    keys = [(x["lang"], x["term"]) for x in lines]
    assert keys == sorted(keys)
    got = {(x["lang"], x["term"].decode(), x["source"]): x["n"] for x in lines if x["term"]}
    assert got == dict(want) and len(got) == sum(bool(t) for _, t in keys)


def test_shares_beyond_64_bits(spark):
    big = 10**13
    (row,) = spark.range(1).selectExpr(f"{sa._share(f'{big}L', f'{3 * big}L')} AS p").collect()
    assert row.p == 1 + 10**9 * (big + 1) // (3 * big)


def test_runs_reach_the_shuffle_packed(spark):
    """One row per run and shard, not one per posting."""
    docs = spark.createDataFrame(make_rows(), DOC).coalesce(1)
    runs, shards = sa.index_runs(docs.select("text", "lang", "source"))
    assert shards == 1 and runs.count() == 4  # en, fr, xx and the empty language


def test_a_block_holds_a_term_once():
    """Twenty sources with the same 5,000 terms: as numbers, not as objects of each source."""
    text = " ".join(f"{a}{b}{c}x" for a in "abcdefghijklmnopq" for b in "abcdefghijklmnopq" for c in "abcdefghijklmnopqr")
    tracemalloc.start()
    block = sa.Block()
    for source in range(20):
        block.add("en", str(source), text.encode())
    assert not block.full
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert block.entries == 20 * 17 * 17 * 18 and held < 60 * block.entries
    batches = list(block.spill(1))
    assert sum(map(len, (b.column("counts")[0] for b in batches))) == block.entries + 20
