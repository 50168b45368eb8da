"""Covers, distances and prefixes against brute force."""

import itertools
import random

import pytest

from findling.operators import lexical, proximity

QUERY = "query_id bigint, tenant_id string, lang string, text string"
CHUNK = "tenant_id string, doc_id bigint, chunk_id string, lang string, text string"
WORDS = "red blue stone river data fast slow the of".split()


def brute(lists):
    """All stretches from any choice of one position per part, those with none inside them."""
    spans = {(min(c), max(c)) for c in itertools.product(*lists)}
    least = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
    return sum(1 / (1 + max(b - a + 1 - len(lists), 0)) for a, b in least)


@pytest.mark.parametrize("seed", range(60))
def test_covers_equal_brute_force(seed):
    rnd = random.Random(seed)
    n = rnd.randrange(1, 5)
    lists = [rnd.sample(range(25), rnd.randrange(1, 7)) for _ in range(n)]
    assert proximity._covers(lists) == pytest.approx(brute(lists))


def test_order_of_parts_does_not_matter():
    lists = [[1, 9, 14], [3, 10], [2, 20]]
    assert len({round(proximity._covers(list(p)), 9) for p in itertools.permutations(lists)}) == 1


def test_parts(spark):
    texts = ["red <2> blue stone", "Red* river", "the <1> data", "<3> red <1> the <1> blue", "of", "", "red <2> blu* x"]
    df = spark.createDataFrame([(i, "t", "en", x) for i, x in enumerate(texts)], QUERY)
    got = {}
    for r in proximity.parse_proximity(df).collect():
        got.setdefault(r.query_id, set()).add((r.grp, r.off, r.term, r.prefix))
    assert got == {
        0: {(1, 0, "red", False), (1, 2, "blue", False), (2, 0, "stone", False)},
        1: {(1, 0, "red", True), (2, 0, "river", False)},
        2: {(1, 1, "data", False)},
        3: {(1, 0, "red", False), (1, 2, "blue", False)},
        6: {(1, 0, "red", False), (1, 2, "blu", True), (2, 0, "x", False)},
    }


def test_search_equals_brute_force(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choices(WORDS, k=rnd.randrange(0, 60))) for _ in range(60)] + [None]
    chunks = spark.createDataFrame([(f"t{i % 2}", i, f"{i}:0", "en", x) for i, x in enumerate(texts)], CHUNK)
    asked = ["red blue", "red <2> blue", "st* river", "s* <1> data red", "red <3> blue <1> stone", "red red", "f*", "zebra red"]
    queries = spark.createDataFrame([(i, f"t{i % 2}", "en", x) for i, x in enumerate(asked)], QUERY)
    postings = lexical.build_postings(chunks)
    parsed = proximity.expand_prefixes(proximity.parse_proximity(queries), postings.select("tenant_id", "term").distinct())
    got = {(r.query_id, r.doc_id): r.score for r in proximity.cover_density(parsed, postings, 100).collect()}

    want = {}
    for q, text in enumerate(asked):
        parts, gap = [], None
        for x in text.split():
            if x.startswith("<"):
                gap = int(x[1:-1])
            elif gap is not None:
                parts[-1].append((parts[-1][-1][0] + gap, x))
                gap = None
            else:
                parts.append([(0, x)])
        for d, body in enumerate(texts):
            if d % 2 != q % 2 or not body:
                continue
            words = body.split()

            def fits(item, at, words=words):
                if not 0 <= at < len(words) or words[at] in ("the", "of"):
                    return False
                return words[at].startswith(item[:-1]) if item.endswith("*") else words[at] == item

            lists = [[p for p in range(len(words)) if all(fits(x, p + off) for off, x in part)] for part in parts]
            if all(lists):
                want[q, d] = round(brute(lists), 6)
    assert len(want) > 60 and got == pytest.approx(want)


def test_ranks_are_bounded(spark):
    chunks = spark.createDataFrame([("t", i, f"{i}:0", "en", "red " + "x " * i + "blue") for i in range(30)], CHUNK)
    queries = spark.createDataFrame([(1, "t", "en", "red blue")], QUERY)
    parsed = proximity.parse_proximity(queries).drop("prefix")
    best = proximity.cover_density(parsed, lexical.build_postings(chunks), 4).orderBy("rank").collect()
    assert [(r.doc_id, r.rank) for r in best] == [(0, 1), (1, 2), (2, 3), (3, 4)]
