import math
import random

import numpy as np
import pytest

from joblume.llm import embedding_dedup
from joblume.llm.embedding_dedup import bucket_codes, hadamard, near_duplicate_vectors


def brute_force(rows):
    usable = lambda v, l: (l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
                           and any(v))
    big = 2**63 - 1
    keys = sorted({(big if i is None else i, tuple(map(str, v or ())), l) for i, v, l in rows}, key=str)
    vector = {(big if i is None else i, tuple(map(str, v or ())), l): v for i, v, l in rows}
    links, parent = {k: set() for k in keys}, {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in keys:
        for b in keys:
            x, y = vector[a], vector[b]
            if a < b and a[2] == b[2] and usable(x, a[2]) and usable(y, b[2]) and len(x) == len(y):
                x, y = np.array(x, float), np.array(y, float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                    links[a].add(b)
                    links[b].add(a)
                    p, q = find(a), find(b)
                    parent[max(p, q, key=lambda k: (k[0], str(k)))] = min(p, q, key=lambda k: (k[0], str(k)))
    out = []
    for i, v, l in rows:
        k = (big if i is None else i, tuple(map(str, v or ())), l)
        root = find(k)[0]
        out.append((str(i), len(links[k]), None if root == big else root, k[0] == root))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    r, rows = random.Random(4), []
    ids = iter(r.sample(range(1000), 400))
    for label in (1, 2, None):
        for _ in range(8):
            base = [r.gauss(0, 1) for _ in range(12)]
            for _ in range(r.randrange(1, 25)):
                rows.append((next(ids), [x + r.gauss(0, 0.06) for x in base], label))
            rows.append((next(ids), base, label))
            rows.append((next(ids), base, label))
            rows.append((next(ids), [2 * x for x in base], label))
    rows += [rows[0], (None, rows[0][1], 1), (2000, None, 1), (2001, [], 1), (2002, [0.0] * 12, 1), (2003, [0.0] * 12, 1),
             (2004, [float("nan")] * 12, 1), (2005, [float("inf")] * 12, 1), (2006, [None] + [1.0] * 11, 1),
             (2007, [1.0, 0.0], 1), (2008, [1.0, -0.0], 1), (2009, [3.0], 1), (2010, [-3.0], 1)]
    frame = spark.createDataFrame([(*x, 1, "x") for x in rows],
                                  "vec_id long, embedding array<double>, label int, node int, bucket string")
    got = sorted(((str(x.vec_id), x.n_links, x.component_id, x.kept)
                  for x in near_duplicate_vectors(frame).collect()), key=str)
    assert got == brute_force(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_duplicate_vectors(empty).count() == 0


@pytest.mark.parametrize("d", [2, 8, 64])
def test_hadamard_is_orthogonal(d):
    matrix = hadamard(np.eye(d))
    assert np.allclose(matrix @ matrix.T, np.eye(d)) and np.allclose(np.abs(matrix), 1 / math.sqrt(d))


def test_near_vectors_meet():
    r = np.random.default_rng(5)
    a = r.standard_normal((500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    aside = r.standard_normal((500, 64))
    aside -= (aside * a).sum(axis=1, keepdims=True) * a
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * aside  # at the threshold
    x, y = bucket_codes(a), bucket_codes(b)
    met = ((x[:, :, :1] == y).any(axis=2) | (y[:, :, :1] == x).any(axis=2)).any(axis=1)
    assert met.mean() > 0.99
