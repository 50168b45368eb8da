"""Substring search by trigram lists against plain Python."""

import random

import pytest

from findling.operators import substrings
from findling.session import scratch_folder

CHUNK = "tenant_id string, chunk_id string, text string"
ASKED = "query_id bigint, tenant_id string, text string"
LETTERS = "ab é😀\n%"


def random_text(rnd: random.Random, most: int) -> str:
    return "".join(rnd.choices(LETTERS, k=rnd.randrange(most)))


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(3)
    chunks = [(f"t{i % 3}", f"c{i}", random_text(rnd, 120)) for i in range(60)]
    chunks += [("t0", "null", None), ("t0", "empty", ""), ("t1", "a", "a"), ("t1", "nul", "x\0"), ("t0", "long", "ab" * 3000)]
    asked = [(i, f"t{i % 4}", random_text(rnd, 9)) for i in range(200)]
    texts = [t for _, _, t in chunks if t]
    for i in range(200, 260):  # pieces of texts, which do occur
        text = rnd.choice(texts)
        first = rnd.randrange(len(text))
        asked.append((i, f"t{i % 3}", text[first : first + rnd.randrange(1, 40)]))
    asked += [(900, "t0", None), (901, "t0", ""), (902, "t1", "a\0"), (903, "t1", "x\0"), (904, "t0", "ab" * 3000), (905, None, "ab")]
    df = spark.createDataFrame(chunks, CHUNK)
    folders = substrings.store_grams(df, scratch_folder(spark, "grams"))
    return chunks, asked, df, spark.createDataFrame(asked, ASKED), folders


def plain_hits(chunks, asked):
    return sorted(
        (q, c, text.index(pattern) + 1)
        for q, tenant, pattern in asked
        for owner, c, text in chunks
        if pattern and text and owner == tenant and pattern in text
    )


@pytest.mark.parametrize("named", (substrings.NAMED, 0))
def test_equals_a_plain_search(spark, tables, monkeypatch, named):
    monkeypatch.setattr(substrings, "NAMED", named)
    chunks, asked, df, patterns, folders = tables
    got = substrings.substring_search(patterns, df, *substrings.open_grams(spark, folders)).collect()
    assert sorted(tuple(r) for r in got) == plain_hits(chunks, asked)
    assert len(got) > 200


def test_candidates_read_no_text(spark, tables):
    chunks, _, df, patterns, folders = tables
    few = patterns.filter("query_id = 904")
    found = substrings.candidates(few, *substrings.open_grams(spark, folders))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "In(gram" in plan.replace("EqualTo(gram", "In(gram")
    assert {r.chunk_id for r in found.collect()} == {"long"}


def test_a_rare_trigram_leaves_few_candidates(spark):
    rows = [("t", f"c{i}", "the common words of every text " * 5 + ("zq here" if i == 7 else "")) for i in range(300)]
    df = spark.createDataFrame(rows, CHUNK)
    folders = substrings.store_grams(df, scratch_folder(spark, "grams"))
    asked = spark.createDataFrame([(1, "t", "every text zq"), (2, "t", "every text qz")], ASKED)
    grams, stats = substrings.open_grams(spark, folders)
    assert [r.chunk_id for r in substrings.candidates(asked, grams, stats).collect()] == ["c7"]


def test_empty_tables(spark, tables):
    _, _, df, patterns, folders = tables
    grams, stats = substrings.open_grams(spark, folders)
    assert substrings.substring_search(patterns.limit(0), df, grams, stats).count() == 0
    none = df.limit(0)
    bare = substrings.build_grams(none).withColumn(substrings.BUCKET, substrings._bucket())
    sizes = substrings.gram_stats(bare).withColumn(substrings.BUCKET, substrings._bucket())
    assert substrings.substring_search(patterns, none, bare, sizes).count() == 0


def test_lists_are_stored_by_run_without_a_shuffle(spark):
    """One row for a trigram of a task's chunks, however many hold it."""
    df = spark.createDataFrame([("t", f"c{i}", "abcd") for i in range(50)], CHUNK).coalesce(1)
    plan = substrings.build_lists(df)._jdf.queryExecution().executedPlan().toString()
    folders = substrings.store_grams(df, scratch_folder(spark, "grams"))
    assert "Exchange" not in plan and spark.read.parquet(folders[0]).count() == 4
    grams, stats = substrings.open_grams(spark, folders)
    assert grams.count() == 200 and {r.n_places for r in stats.collect()} == {50}


@pytest.mark.parametrize("signs", (40, 70_000))  # the second does not fit one number
def test_lists_equal_plain_ones(spark, signs):
    rnd = random.Random(signs)
    letters = [chr(c) for c in range(1, signs) if not 0xD800 <= c < 0xE000]
    rows = [(rnd.choice(["t", "u", None]), f"c{i}", "".join(rnd.choices(letters, k=rnd.randrange(80)))) for i in range(30)]
    rows += [("t", "every", "".join(letters[:9000])), ("t", None, "xyx"), ("u", "null", None)]
    group = substrings.np.arange(len(rows)) << (20 if signs > 40 else 0)
    wide = substrings._listed([t or "" for *_, t in rows], group)
    assert len(wide[0]) == sum(len(t or "") for *_, t in rows)
    assert list(zip(*map(list, wide))) == sorted(zip(*map(list, substrings.placed_grams([t or "" for *_, t in rows]))))
    want = sorted(
        (str(tenant), str(chunk), gram, places)
        for tenant, chunk, text in rows
        for gram, places in _plain_places(text or "").items()
    )
    got = substrings.build_grams(spark.createDataFrame(rows, CHUNK)).collect()
    assert sorted((str(r.tenant_id), str(r.chunk_id), r.gram, r.places) for r in got) == want


def _plain_places(text):
    codes, found = [*map(ord, text), substrings.FILL, substrings.FILL], {}
    for i in range(len(text)):
        gram = codes[i] << 2 * substrings.BITS | codes[i + 1] << substrings.BITS | codes[i + 2]
        found.setdefault(gram, []).append(i + 1)
    return found


def test_short_patterns_give_one_candidate_a_chunk(spark):
    df = spark.createDataFrame([("t", "c", "ab" * 30), ("t", "c", "ab" * 30), ("t", "d", "xabab")], CHUNK)
    folders = substrings.store_grams(df, scratch_folder(spark, "grams"))
    asked = spark.createDataFrame([(1, "t", "a"), (2, "t", "ab"), (3, "t", "aba"), (4, "t", "abab")], ASKED)
    lists = substrings.open_grams(spark, folders)
    found = [(r.query_id, r.chunk_id, r.at) for r in substrings.candidates(asked, *lists).collect()]
    assert sorted(x for x in found if x[0] < 4) == [(q, c, at) for q in (1, 2, 3) for c, at in (("c", 1), ("d", 2))]
    got = sorted(tuple(r) for r in substrings.substring_search(asked, df, *lists).collect())
    assert got == [(q, c, at) for q in (1, 2, 3, 4) for c, at in (("c", 1), ("d", 2))]
