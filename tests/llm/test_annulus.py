"""Annulus clustering against plain code."""

import hashlib
import math
import random

import numpy as np
import pytest

from threadloom.llm import annulus as A

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"


def brute(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: "" if i is None else str(i)
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{name(r[0])}".encode()).hexdigest(), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda: [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(centroids)):
            some = [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == j]
            if some:
                centroids[j] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    own = assign()
    inertia = [sum(d for d, c in own if c == j) for j in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, c, d, inertia[c], sum(inertia), digest[c]) for (i, _), (d, c) in zip(kept, own, strict=True)], key=repr)


def vectors(rng, n, spread=1.0):
    return [(i, [float(np.float32(rng.gauss(0, spread))) for _ in range(64)]) for i in range(n)]


def check(spark, rows):
    got = A.cluster(spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_against_plain_code(spark):
    rng = random.Random(4)
    rows = vectors(rng, 400) + [(1000 + i, [x + 3.0 * (i % 5) for x in v]) for i, v in vectors(rng, 100, 0.2)]
    inf, nan = float("inf"), float("nan")
    odd = [(2000, None), (2001, []), (2002, [0.0] * 63), (2003, [0.0] * 65), (2004, [None] + [0.0] * 63), (2005, [nan] + [0.0] * 63), (2006, [inf] + [0.0] * 63)]
    check(spark, rows + odd + [(None, rows[3][1]), (7, rows[9][1]), rows[5], rows[5]])


def test_ties_copies_and_empty_clusters(spark):
    hot = [0.25] * 64
    check(spark, [(i, hot) for i in range(200)] + [(300 + i, [float(i % 3)] * 64) for i in range(30)] + [(400 + i, [(-1.0) ** (i + j) for j in range(64)]) for i in range(20)])


def test_few_and_none(spark):
    check(spark, vectors(random.Random(1), 5))
    assert A.cluster(spark.createDataFrame([], SCHEMA)).collect() == []
    assert A.cluster(spark.createDataFrame([(1, None, 0, "x")], SCHEMA)).collect() == []


def test_annulus_leaves_out_far_centroids_and_keeps_boundary_ties():
    rng = np.random.default_rng(3)
    centroids = np.array([[100 * k, 0] for k in range(16)])
    v = np.column_stack([rng.integers(0, 1600, 500), rng.integers(-20, 20, 500)])
    number, far, taken = A.Annuli(centroids).nearest(v)
    every = ((v[:, None] - centroids[None]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (far == every.min(1)).all()
    assert taken < 3 * len(v)
    number, far, _ = A.Annuli(np.array([[4, 0], [0, 0], [4, 0]])).nearest(np.array([[2, 0], [4, 0], [0, 0]]))
    assert number.tolist() == [0, 0, 1] and far.tolist() == [4, 0, 0]


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="after scaling"):
        A.cluster(spark.createDataFrame([(1, [1e9] * 64, 0, "x")], SCHEMA)).collect()
