"""Cells of vectors: recall and reading against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from findling.operators import cells, dense
from findling.plans import registry

VEC = "tenant_id string, vec_id bigint, embedding array<float>"


def make(n, width=16, seed=1):
    rnd = np.random.Generator(np.random.PCG64(seed))
    centres = rnd.normal(size=(25, width))
    rows = [(f"t{i % 2}", i, (centres[i % 25] + rnd.normal(0, 0.35, width)).tolist()) for i in range(n)]
    rows += [(f"t{i % 2}", n + i, rows[7][2]) for i in range(60)]  # one vector many times
    return rows + [("t0", n + 70, None), ("t1", n + 71, [0.0] * width), (None, n + 72, rows[3][2])]


@pytest.fixture(scope="module")
def celled(spark, tmp_path_factory):
    vectors = spark.createDataFrame(make(2000), VEC)
    centres = cells.fit_cells(vectors, 20, "vec_id", sample=700)
    folder = cells.store_cells(vectors, centres, str(tmp_path_factory.mktemp("cells")))
    return vectors, centres, spark.read.parquet(folder)


def test_every_vector_lies_in_the_cell_of_its_nearest_centre(celled):
    vectors, centres, stored = celled
    rows = stored.collect()
    assert len(rows) == 2061  # all but the null one and the one without a direction
    for r in rows[:300]:
        v = np.array(r.embedding)
        assert r.cell == (centres @ v).argmax()


@pytest.mark.parametrize("scoped", [True, False])
def test_all_cells_give_the_exact_result(celled, scoped):
    vectors, centres, stored = celled
    asked = vectors.filter("vec_id % 40 = 0").withColumnRenamed("vec_id", "query_id")
    if not scoped:
        asked, stored, vectors = asked.drop("tenant_id"), stored.drop("tenant_id"), vectors.drop("tenant_id")
    got = cells.cell_topk(asked, stored, centres, 10, 20, vector_id="vec_id")
    want = dense.dense_topk(asked, vectors, 10, vector_id="vec_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_few_cells_give_most_of_it(celled):
    vectors, centres, stored = celled
    asked = vectors.drop("tenant_id").filter("vec_id % 40 = 0").withColumnRenamed("vec_id", "query_id")
    for probes, least in ((1, 0.5), (4, 0.9), (20, 1.0)):
        row = cells.cell_recall(asked, stored.drop("tenant_id"), centres, 10, probes, vector_id="vec_id").first()
        assert row.recall >= least and row.n_queries == 52
        assert row.scanned_share == pytest.approx(1.0) if probes == 20 else row.scanned_share < 0.1 + probes / 20


def test_other_cells_are_not_read(celled):
    vectors, centres, stored = celled
    asked = vectors.filter("vec_id = 7").withColumnRenamed("vec_id", "query_id")
    hits = cells.cell_topk(asked, stored, centres, 5, 2, vector_id="vec_id")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan and hits.count() == 5


def test_recall_on_the_table(spark):
    row = registry.QUERIES["cell_recall"](spark, "/root/testdata/sf0.1").first()
    assert row.recall >= 0.9 and row.scanned_share < 1.0


def test_probes_are_chosen_by_what_they_hold(celled):
    vectors, centres, stored = celled
    stored = stored.drop("tenant_id")
    few = [cells.choose_probes(stored, centres, 10, recall, "vec_id") for recall in (0.5, 0.98, 1.0)]
    assert few == sorted(few) and few[0] == 1 and few[1] < 8
    asked = vectors.drop("tenant_id").filter("vec_id % 40 = 0").withColumnRenamed("vec_id", "query_id")
    assert cells.cell_recall(asked, stored, centres, 10, few[1], vector_id="vec_id").first().recall > 0.95


def test_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([("t", 1, None)], VEC)
    centres = cells.fit_cells(none, 4, "vec_id")
    assert len(centres) == 0
    assert cells.nearest_cells(none, centres, 1).count() == 0
