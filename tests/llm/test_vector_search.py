import numpy as np
import pytest
from pyspark.sql import functions as F

from joblume.llm import vector_search
from joblume.llm.queries import op11_vector_search
from joblume.llm.vector_search import nearest_vectors, rotated

SCHEMA = "vec_id long, embedding array<double>, label int, ids string, code int, key long, score string"


@pytest.fixture
def vectors(spark):
    """Rows of (vec_id, vector), with more columns whose names the operator uses inside."""
    return lambda rows: spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], SCHEMA)


def brute_force(rows, is_query, k=5):
    usable = {(i, tuple(float(x) + 0.0 for x in v)) for i, v in rows if i is not None and v
              and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {}
    for i, v in usable:
        a = np.array(v) / np.abs(v).max()
        unit[i, v] = a / np.sqrt(a @ a)
    out = []
    for i, v in usable:
        if is_query(i):
            near = sorted((-float(unit[i, v] @ unit[j, w]), j) for j, w in usable if j != i and len(w) == len(v))[:k]
            # what is equal but for rounding is ranked by id
            out += [(i, round(-s, 9), j) for s, j in near]
    return sorted(out)


def result(frame):
    rows = frame.collect()
    for r in rows:
        assert r.rank >= 1
    return sorted((r.query_id, round(r.score, 9), r.vec_id) for r in rows)


def gathered(seed, n=600, dims=64, groups=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dims))
    return [(i, (centres[r.integers(groups)] + r.normal(size=dims) * 0.7).tolist()) for i in range(n)]


@pytest.mark.parametrize("dims", [1, 64, 300])
def test_every_neighbour_is_found(vectors, monkeypatch, dims):
    monkeypatch.setattr(vector_search, "LEAST_BLOCK", 100)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 30)
    monkeypatch.setattr(vector_search, "TILE", 7)
    rows = gathered(dims, dims=dims)
    got = result(nearest_vectors(vectors(rows), F.col("vec_id") % 9 == 0))
    want = brute_force(rows, lambda i: i % 9 == 0)
    assert len(got) == len(want)
    if dims == 1:  # all cosines are 1 or -1, but for rounding
        assert {s for _, s, _ in got} == {1.0}
    else:
        assert len(set(got) & set(want)) >= 0.99 * len(want)


def test_odd_vectors_ties_and_copies(vectors):
    same, other = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(0, same), (50, same), (50, same), (7, same), (3, same), (4, other), (5, [2.0, 4.0, 6.0]), (100, [0.0, -0.0, 0.0]),
            (150, None), (200, [1.0, None, 2.0]), (250, [float("nan")] * 3), (300, [float("inf"), 0.0, 0.0]), (350, []),
            (400, [1.0, 2.0]), (None, same), (450, [1e200, 2e200, 3e200]), (500, [1e-200, 2e-200, 3e-200]), (50, other),
            (9, [-1.0, -2.0, -3.0]), (10, [-0.0, 0.0, 1.0])]
    got = nearest_vectors(vectors(rows), F.col("vec_id") % 50 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    assert set(by) == {0, 50, 450, 500}
    # 450 and 500 are parallel to these but for rounding; 5 is exactly
    assert {v for _, v, _ in by[0]} <= {3, 5, 7, 50, 450, 500} and {s for *_, s in by[0]} == {1.0}
    assert [v for _, v, _ in sorted(by[0]) if v < 450] == [3, 5, 7, 50][:sum(v < 450 for _, v, _ in by[0])]
    assert {s for *_, s in by[450]} == {s for *_, s in by[500]} == {1.0} and len(by[450]) == 5
    # an id with two vectors is searched for both
    assert any(v == 0 and s == 1.0 for _, v, s in by[50]) and any(v == 4 and s == 1.0 for _, v, s in by[50]) and len(by[50]) == 10


def test_a_vector_that_a_third_of_all_rows_have(vectors):
    rows = gathered(3, 300) + [(1000 + i, [1.0] * 64) for i in range(200)]
    got = nearest_vectors(vectors(rows), F.col("vec_id") % 50 == 0)
    hot = [r for r in got.collect() if r.query_id >= 1000]
    assert {r.query_id for r in hot} == {1000, 1050, 1100, 1150}
    assert [r.vec_id for r in sorted(hot, key=lambda r: (r.query_id, r.rank))][:10] == [1001, 1002, 1003, 1004, 1005,
                                                                                      1000, 1001, 1002, 1003, 1004]


def test_empty_table_and_too_few_candidates(vectors):
    assert nearest_vectors(vectors([]), F.col("vec_id") % 50 == 0).count() == 0
    got = nearest_vectors(vectors([(0, [1.0, 0.0]), (1, [0.0, 1.0])]), F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 0.0)]


def test_the_rotation_keeps_inner_products():
    x = np.random.default_rng(0).normal(size=(20, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(rotated(x) @ rotated(x).T, x @ x.T, atol=1e-5) and rotated(x).shape == (20, 256)


def test_recall_of_the_query(spark, sf_small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()]
    want = brute_force(rows, lambda i: i % 50 == 0)
    got = result(op11_vector_search(spark, sf_small))
    assert want and len(set(got) & set(want)) >= 0.99 * len(want)
