import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormlane.llm import ann

SCHEMA = "vec_id long, embedding array<float>, key string, score int"


def exact(rows, k, asks):
    """The k nearest by brute force: {query: [(id, score)]}."""
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows]
    out = {}
    for i, v in good:
        if asks(i):
            scores = sorted((-float(v @ w) / math.sqrt((v @ v) * (w @ w)), j) for j, w in good if j != i)
            out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def test_edge_rows_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.standard_normal(8).astype(np.float32).tolist() for i in range(40)}
    for i in range(100, 160):  # more copies than a result holds, queries among them
        vectors[i] = vectors[3]
    vectors[200] = [0.0] + vectors[5][1:]
    vectors[201] = [-0.0] + vectors[5][1:]
    odd = [(300, None), (301, [0.0] * 8), (302, [1.0, None] + [1.0] * 6), (303, [float("nan")] * 8), (304, [float("inf")] + [1.0] * 7), (305, [1.0, 2.0]), (None, vectors[1]), (306, [])]
    rows = [(i, v, "x", None) for i, v in [*vectors.items(), *odd, (0, vectors[0])]]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") % 20 == 0).collect()
    want = exact(vectors.items(), 5, lambda i: i % 20 == 0)
    found = {q: [(r.id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in {r.query_id for r in got}}
    assert found.keys() == want.keys()
    for q in want:
        assert [i for i, _ in found[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in found[q]], [s for _, s in want[q]], atol=1e-12)


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_few_rows(spark, n):
    rows = [(i * 50, [1.0, float(i)], None, None) for i in range(n)]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") % 50 == 0).collect()
    assert len(got) == n * (n - 1)


def test_recall_and_scores_on_clustered_rows(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 32))
    rows = [(i, (centres[i % 30] + 0.3 * rng.standard_normal(32)).astype(np.float32).tolist(), None, None) for i in range(6000)]
    small = ann.Settings(block_rows=2000, query_rows=40)
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") % 50 == 0, settings=small).collect()
    want = exact([r[:2] for r in rows], 5, lambda i: i % 50 == 0)
    assert sum(any(r.id == j for j, _ in want[r.query_id]) for r in got) >= 0.9 * 5 * len(want)
    assert len(got) == 5 * len(want)


def test_query_recall_on_small_tables(spark):
    got = ann.op8_approximate_nearest_neighbours(spark, "/root/testdata/sf0.01").collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want = exact(rows, 5, lambda i: i % 50 == 0)
    assert {(r.query_id, r["rank"]) for r in got} == {(q, k) for q in want for k in range(1, 6)}
    assert sum(r.vec_id in {j for j, _ in want[r.query_id]} for r in got) >= 0.9 * len(got)


def test_large_and_small_components(spark):
    rng = np.random.default_rng(4)
    plain = rng.standard_normal((60, 6))
    scales = [1e200, 1e-200, 1.0, 5e-310, 1e-30]
    rows = [(i, (v * scales[i % 5]).tolist(), None, None) for i, v in enumerate(plain)]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA.replace("float", "double")), F.col("id") % 10 == 0).collect()
    want = exact([(i, v) for i, v in enumerate(plain)], 5, lambda i: i % 10 == 0)
    for q, best in want.items():
        found = [(r.id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        assert [i for i, _ in found] == [i for i, _ in best] and np.allclose([s for _, s in found], [s for _, s in best], atol=1e-6)


def test_queries_ascend_where_few_rows_match(spark):
    """A far cluster's depth leaves the lone vectors without matches; they still get all their neighbours."""
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + 0.01 * rng.standard_normal(16)).tolist(), None, None) for i in range(1, 600)]
    rows += [(1000 * k, (-centre + 2 * rng.standard_normal(16)).tolist(), None, None) for k in range(1, 4)]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") >= 1000, settings=ann.Settings(block_rows=100, sample_rows=300)).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(1000 * q, k) for q in (1, 2, 3) for k in range(1, 6)]
