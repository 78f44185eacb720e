"""Nearest neighbours: ties, copies, what is sent."""

import numpy as np
from pyspark.sql import functions as F

from threadloom.operators import graph


def plain(rows, k, threshold):
    """By every pair, as the SQL does it; ties to the smaller id."""
    x = {i: np.array(v) for i, v in rows}
    norm = {i: (v * v).sum() ** 0.5 for i, v in x.items()}
    out = set()
    for i in x:
        near = sorted((-s, j) for j in x if j != i and (s := (x[i] * x[j]).sum() / max(norm[i] * norm[j], 1e-300)) > threshold)
        out |= {(i, j) for _, j in near[:k]}
    return out


def test_ties_go_to_the_smaller_id_wherever_copies_lie(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    rows = [(i, base[i % 30 if i % 3 else 0].tolist()) for i in rng.permutation(240).tolist()]
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    want = plain(rows, 3, 0.3)
    for block, part_rows in ((4096, None), (16, 16), (16, 60)):
        got = graph.nearest_neighbours(frame, 3, 0.3, block, part_rows)
        assert {(r.src, r.dst) for r in got.collect()} == want


def test_vectors_are_sent_once_a_part_and_results_are_read_from_files(spark):
    rng = np.random.default_rng(5)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(640, 8)))], "id long, vector array<double>")
    scratch = graph.Scratch(spark, "test")
    pairs, dealt = graph._pivot_tree(frame, 640, 10, 0.75, scratch)
    blocks = dealt.select("b").distinct().count()
    parts, tasks = graph._parts(pairs, dealt, 80, scratch)
    most = parts.select("part").distinct().count()
    assert blocks > 40 and most <= 9 and tasks.count() <= most * (most + 1) // 2
    assert tasks.select(F.explode("pairs")).count() == pairs.where("q <= c").count()
    found = graph.nearest_neighbours(frame, 3, 0.75, 10)
    plan = found._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and "Exchange" not in plan
