"""Product codes of vectors against plain numpy."""

import hashlib
import math

import numpy as np
import pytest

from findling.llm import vector_codes as vc

VEC = "vec_id bigint, embedding array<float>, label int, code string"


def plain_report(rows):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[math.floor(1024 * float(np.float32(v))) for v in r[1]] for r in kept], np.int64)
    size = x.shape[1] // 4
    parts = [x[:, p * size : (p + 1) * size] for p in range(4)]
    books = [part[:256].copy() for part in parts]

    def assign(p):
        square = ((parts[p][:, None, :] - books[p][None]) ** 2).sum(axis=2)
        return square.argmin(axis=1), square.min(axis=1)

    for _ in range(4):
        for p in range(4):
            best, _ = assign(p)
            for e in set(best.tolist()):
                own = parts[p][best == e]
                books[p][e] = own.sum(axis=0) // len(own)
    found = [assign(p) for p in range(4)]
    error = sum(least for _, least in found)
    codes = ["".join(f"{found[p][0][i]:02x}" for p in range(4)) for i in range(len(kept))]
    totals = {}
    for r, e in zip(kept, error):
        totals[r[2]] = totals.get(r[2], 0) + int(e)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return [(r[0], c, int(e), totals[r[2]], digest) for r, c, e in zip(kept, codes, error)]


def make_rows(n, width=8, seed=1):
    rnd = np.random.Generator(np.random.PCG64(seed))
    rows = [(int(i), rnd.normal(0, 1, width).astype(np.float32).tolist(), int(i % 3) or None, "z") for i in range(n)]
    rows += [(n, None, 1, None), (n + 1, [], 1, ""), (n + 2, [None] * width, 2, ""),
             (n + 3, [float("nan")] * width, None, ""), (n + 4, [float("inf")] + [0.0] * (width - 1), 1, ""),
             (None, [0.25] * width, None, ""), (3, [-0.0004] * width, 1, "")]
    return rows + [rows[5]] * 300  # one vector many times


@pytest.mark.parametrize("n,width", [(700, 8), (40, 4), (400, 12)])
def test_codes_equal_plain_numpy(spark, n, width):
    rows = make_rows(n, width)
    if n == 40:
        rows = rows[:-300]
    got = vc.report(spark.createDataFrame(rows, VEC).repartition(3)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_report(rows)))


def test_candidates_are_those_of_the_box():
    rnd = np.random.Generator(np.random.PCG64(2))
    entries, parts = rnd.integers(-50, 50, (130, 3)), rnd.integers(-60, 60, (200, 3))
    radius = rnd.integers(0, 60, 200)
    row, entry = vc.Slices(entries).candidates(parts, radius)
    inside = (np.abs(parts[:, None, :] - entries[None]) <= radius[:, None, None]).all(axis=2)
    assert sorted(zip(row.tolist(), entry.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(inside))))


@pytest.mark.parametrize("spread", [1, 3, 1000, 1 << 25])
def test_nearest_whatever_the_first_radius(spread):
    rnd = np.random.Generator(np.random.PCG64(spread))
    entries = rnd.integers(-spread, spread + 1, (256, 4))
    parts = np.concatenate([rnd.integers(-2 * spread, 2 * spread + 1, (300, 4)), entries[:20]])
    square = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    for radius in (1, 7, 1 << 20):
        slices = vc.Slices(entries)
        slices.radius = radius
        best, least = slices.nearest(parts)
        assert best.tolist() == square.argmin(axis=1).tolist() and least.tolist() == square.min(axis=1).tolist()


def test_no_vectors_and_wrong_widths(spark):
    empty = spark.createDataFrame([(1, None, 1, "")], VEC)
    assert vc.report(empty).collect() == []
    for vectors in ([[1.0] * 6], [[1.0] * 8, [1.0] * 4], [[1.0, 2.0, 3.0, 1e9]]):
        df = spark.createDataFrame([(i, v, 1, "") for i, v in enumerate(vectors)], VEC)
        with pytest.raises(Exception, match="component|width|parts"):
            vc.report(df).collect()


def test_decoding_gives_the_entries(spark):
    rows = [(i, [i / 4.0, -i / 8.0, 0.5, 2.0], 1, "") for i in range(20)]
    vectors = spark.createDataFrame(rows, VEC)
    books = vc.fit(vectors)
    back = vc.decode(vc.encode(vectors, books), books).collect()
    assert {r.vec_id: (r.decoded, r.error) for r in back} == {r[0]: (r[1], 0) for r in rows}
    nothing = spark.createDataFrame([(None,)], "code string")
    assert vc.decode(nothing, books).first().decoded is None
