"""Batched nearest vectors and the index of cells against a plain full comparison."""

import numpy as np
import pytest

from folioscope.operators import search, vector_index
from folioscope.operators.vector_index import VectorIndex


def plain(vectors, queries, k, threshold=None):
    out = []
    for q, a in queries:
        if a is None:
            continue
        scored = []
        for i, b in vectors:
            if b is not None:
                n = np.linalg.norm(a) * np.linalg.norm(b)
                scored.append((-round(float(np.dot(a, b) / n), 9) if n else 0.0, i))
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(scored)[:k], 1) if threshold is None or -s >= threshold]
    return sorted((q, r, i, round(s, 9)) for q, i, s, r in out)


def rows(df, id_col="id"):
    return sorted((r["query_id"], r["rank"], r[id_col], round(r["score"], 9) + 0.0) for r in df.collect())


def same(got, want):
    return [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], atol=2e-9)


def clusters(n=600, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims)) * 3
    values = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * 0.2
    values[100:140] = values[100]  # equal rows, more than k
    values[200:203] = 0
    return [(int(i), [float(x) for x in v]) for i, v in enumerate(values.astype(np.float32))] + [(9000, None)]


QUERY_ROWS = (0, 7, 100, 200, 300, 301)


@pytest.mark.parametrize("k, threshold, limits", [(5, None, None), (5, 0.9, None), (50, None, (3, 40)), (1000, None, None), (1, -0.5, (2, 16))])
def test_same_as_full_comparison(spark, monkeypatch, k, threshold, limits):
    if limits:
        monkeypatch.setattr(vector_index, "QUERIES", limits[0])
        monkeypatch.setattr(vector_index, "CELL_ROWS", limits[1])
    vectors = clusters()
    queries = [(i, vectors[i][1]) for i in QUERY_ROWS] + [(77, None), (78, [0.1] * 8)]
    v = spark.createDataFrame(vectors, "id long, vec array<float>").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, query_vector array<float>")
    want = plain(vectors, queries, k, threshold)
    assert same(rows(search.batch_top_k(v, q, k, threshold, "id", "vec")), want)
    index = VectorIndex.build(v, "id", "vec")
    assert same(rows(index.search(q, k, threshold, "id")), want)


def test_prunes_and_survives_saving(spark, tmp_path):
    vectors = clusters(3000, 8, 4)
    v = spark.createDataFrame(vectors, "id long, vec array<float>")
    q = spark.createDataFrame([(i, vectors[i][1]) for i in (0, 7, 300)], "query_id long, query_vector array<float>")
    index = VectorIndex.build(v, "id", "vec", n_cells=60)
    shares = {r["query_id"]: r["share"] for r in index.visited_shares(q, 5).collect()}
    assert max(shares.values()) < 0.35, shares
    index.save(str(tmp_path / "index"))
    again = VectorIndex.load(spark, str(tmp_path / "index"))
    want = plain(vectors, [(i, vectors[i][1]) for i in (0, 7, 300)], 5)
    assert same(rows(again.search(q, 5, id_col="id")), want)
    plan = again.search(q, 5, id_col="id")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_odd(spark):
    q = spark.createDataFrame([("a", [1.0, 0.0])], "query_id string, query_vector array<double>")
    none = spark.createDataFrame([], "id long, vec array<double>")
    assert search.batch_top_k(none, q, 3, None, "id", "vec").count() == 0 and VectorIndex.build(none, "id", "vec").search(q, 3, id_col="id").count() == 0
    zero = spark.createDataFrame([(2, [0.0, 0.0]), (1, [0.0, 0.0])], "id long, vec array<double>")
    for df in (search.batch_top_k(zero, q, 1, None, "id", "vec"), VectorIndex.build(zero, "id", "vec").search(q, 1, id_col="id")):
        assert rows(df) == [("a", 1, 1, 0.0)]
    assert search.batch_top_k(zero, q, 0, None, "id", "vec").count() == 0 and search.batch_top_k(zero, q.limit(0), 2, None, "id", "vec").count() == 0
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, vec array<double>")
    with pytest.raises(Exception, match="different lengths"):
        search.batch_top_k(mixed, q, 1, None, "id", "vec").collect()
