import math
import random

import numpy as np
from pyspark.sql import functions as F

from threadloom.functions import vectors as V
from threadloom.operators import features, graph, graph_training, messages, metrics, relational, sampling, training


def walk(rows):
    """Depths by plain recursion, ids ascending."""
    parent, conv, known = {r[0]: r[2] for r in rows}, {r[0]: r[1] for r in rows}, {}

    def depth(x, seen):
        if x in seen:
            return 0
        seen.add(x)
        if x not in known:
            if x == conv[x]:
                known[x] = 0
            elif parent[x] == conv[x] or parent[x] not in parent:
                known[x] = 1
            else:
                known[x] = depth(parent[x], seen) + 1
        return known[x]

    return {r[0]: depth(r[0], set()) for r in sorted(rows)}


def test_depth_of_odd_threads(spark):
    chain = [("0", "0", None)] + [(f"{i:04d}", "0", "0" if i == 1 else f"{i - 1:04d}") for i in range(1, 150)]
    circle = [("c1", "z", "c2"), ("c2", "z", "c3"), ("c3", "z", "c1"), ("a9", "z", "c2"), ("b8", "z", "a9"), ("s", "z", "s")]
    other = [("m", "q", None), ("n", "q", "gone"), ("o", "q", "n"), ("q2", None, None)]
    rows = chain + circle + other
    got = graph.reply_depth(spark.createDataFrame(rows, "tweet_id string, conversation_id string, parent_id string"))
    assert {r.tweet_id: r.depth for r in got.collect()} == walk(rows)


def test_depth_of_empty_table(spark):
    assert graph.reply_depth(spark.createDataFrame([], "tweet_id string, conversation_id string, parent_id string")).count() == 0


def test_edges(spark):
    rows = spark.createDataFrame([("1", "1", None), ("2", "1", "1"), ("3", "1", "2"), ("4", "9", "9"), ("5", "9", "5")], "tweet_id string, conversation_id string, parent_id string")
    pairs = {(r.src, r.dst) for r in graph.reply_edges(rows).collect()}
    assert pairs == {("1", "2"), ("2", "1"), ("2", "3"), ("3", "2")}
    star = {(r.src, r.dst) for r in graph.conversation_edges(rows).collect()}
    assert star == {("1", "2"), ("2", "1"), ("1", "3"), ("3", "1")}


def test_neighbours_with_copies_and_zeros(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [0.9, 0.1]), (5, [-1.0, 0.0])], "id long, vector array<float>")
    for block in (2, 100):
        near = sorted((r.src, r.dst) for r in graph.nearest_neighbours(rows, 2, 0.75, block).collect())
        assert near == [(1, 2), (1, 4), (2, 1), (2, 4), (4, 1), (4, 2)]


def test_neighbours_of_many_blocks(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 8))
    x = np.concatenate([centres[rng.integers(0, 5, 150)] * 3 + rng.normal(size=(150, 8)), np.tile(centres[:1], (30, 1))]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    similar = unit @ unit.T
    want = set()
    for i in range(len(x)):
        near = [j for j in range(len(x)) if j != i and similar[i, j] > 0.75]
        want |= {(i, j) for j in sorted(near, key=lambda j: (-round(similar[i, j], 9), j))[:3]}
    got = {(r.src, r.dst, round(r.similarity, 6)) for r in graph.nearest_neighbours(rows, 3, 0.75, 20).collect()}
    assert sorted((s, v) for s, _, v in got) == sorted((i, round(similar[i, j], 6)) for i, j in want)
    assert {p for p in want if p[0] < 150} == {(s, d) for s, d, _ in got if s < 150} or len(got) == len(want)


def test_components_and_clustering_against_plain_code(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(100 + i, 101 + i) for i in range(40)]
    nodes = sorted({x for e in edges for x in e} | {500})
    near = {n: {b if a == n else a for a, b in edges if n in (a, b) and a != b} for n in nodes}
    label = {}
    for n in nodes:
        stack = [n]
        while stack:
            x = stack.pop()
            if x not in label:
                label[x] = n
                stack += near[x]
    v, e = spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "src long, dst long")
    assert {r.id: r.component for r in graph.connected_components(v, e).collect()} == label
    triangles = {n: sum(1 for a in near[n] for b in near[n] if a < b and b in near[a]) for n in nodes}
    assert {r.id: r.triangles for r in graph.clustering(v, e).collect()} == triangles
    assert graph.graph_stats(v, e).first().n_components == len(set(label.values()))


def test_samples_and_folds(spark):
    rows = [(str(i), "a" if i % 10 else ("b" if i % 20 else "c")) for i in range(200)] + [("u", "undecided"), ("lone", "d")]
    df = spark.createDataFrame(rows, "tweet_id string, taco_class string")
    for n in (4, 37, 100):
        quotas = {r.taco_class: r.quota for r in sampling.quotas(df, n).collect()}
        assert sum(quotas.values()) == n and min(quotas.values()) >= 1 and "undecided" not in quotas
    sample = sampling.stratified_sample(df, 50)
    assert sample.count() == 50 and sampling.remaining(df, sample).count() == 152
    folds = sampling.stratified_folds(df)
    sizes = {r["count"] for r in folds.where("taco_class = 'a'").groupBy("fold").count().collect()}
    assert folds.count() == 202 and sizes == {18}
    assert sampling.train_validation(df, 0.1).where("is_validation").count() == 20
    assert sampling.fold_masks(folds, 3).where("train_mask = test_mask").count() == 0


def test_metrics(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(3), rng.randrange(4)) for _ in range(100)]
    df = spark.createDataFrame(pairs, "y_true int, y_pred int")
    labels = sorted({x for p in pairs for x in p})
    tp = {k: sum(a == b == k for a, b in pairs) for k in labels}
    f1 = {k: 2 * tp[k] / max(1, sum(a == k for a, _ in pairs) + sum(b == k for _, b in pairs)) for k in labels}
    got = metrics.averages(df).first()
    assert got.macro_f1 == round(sum(f1.values()) / len(f1), 6) and math.isclose(got.accuracy, sum(tp.values()) / 100, abs_tol=1e-6)
    assert metrics.confusion(df).count() == 16 and metrics.confusion(df).agg(F.sum("n")).first()[0] == 100


def test_features(spark):
    x = list(map(float, range(8 + 6 + 3 + 2)))
    df = spark.createDataFrame([(x,)], "x array<double>")
    cut = lambda b: df.select(features.select_blocks(F.col("x"), b, 8).alias("x")).first().x
    assert cut(features.ABLATIONS["all"]) == x and cut(features.ABLATIONS["embs_topic"]) == x[:8] + x[14:17] and cut(features.ABLATIONS["embs_conf"]) == x[:8] + x[18:]
    codes = relational.category_codes(spark.createDataFrame([("b",), ("a",), (None,)], "t string"), "t")
    hot = {r.t: r.h for r in codes.select("t", V.one_hot(F.col("t_code"), F.col("n_codes")).alias("h")).collect()}
    assert hot == {"a": [1.0, 0.0], "b": [0.0, 1.0], None: [0.0, 1.0]}
    scaled = graph.max_scaled(spark.createDataFrame([(0,), (0,)], "d int"), "d").first()
    assert math.isnan(scaled.d_scaled)


def test_stack_and_experiment(spark):
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, x array<double>")
    e = spark.createDataFrame([(i, (i + 1) % 8) for i in range(8)], "src int, dst int")
    zero = [[0.0] * 3] * 3
    layer = lambda a, b: messages.sage(a, b, w.tolist(), zero, [0.0] * 3)
    norm = lambda m: (m - m.mean()) / (m.std() + 1e-5)
    want = norm(np.maximum(norm(x @ w), 0) @ w) @ w
    got = messages.stack(v, e, [layer, layer], (w.tolist(), [0.0] * 3)).orderBy("id").collect()
    assert np.allclose([r.x for r in got], want)
    project, out = (w.tolist(), [0.1] * 3), messages.Dense(rng.normal(size=(9, 4)).tolist(), [0.0] * 4, rng.normal(size=(4, 2)).tolist(), [0.0, 1.0])
    by_row = lambda m: (m - m.mean(1, keepdims=True)) / np.sqrt(m.var(1, keepdims=True) + 1e-5)
    first = np.maximum(by_row(x @ w + 0.1), 0)
    one = np.maximum(norm(first @ w), 0)
    two = np.maximum(norm(one @ w), 0) + one
    want = np.maximum(by_row(np.concatenate([first, two, x], 1) @ np.array(out.first)), 0) @ np.array(out.second) + np.array(out.second_bias)
    assert np.allclose([r.x for r in messages.balanced(v, e, project, [layer, layer], out).orderBy("id").collect()], want)
    rows = spark.createDataFrame([(i, i % 2, [float(i % 3), float(i % 2)], i % 3) for i in range(24)], "id int, fold int, x array<double>, y int")
    ring = spark.createDataFrame([(i, (i + 3) % 24) for i in range(24)], "src int, dst int")
    kinds = [graph_training.Settings(k, classes=3, hidden=4, layers=2, dense=4, heads=2, dropout=0.0, epochs=25, rate=0.05) for k in ("MLP", "SAGE")]
    done = {r.model: r.mean_accuracy for r in training.experiment(rows, ring, kinds, 2).collect()}
    assert set(done) == {"MLP", "SAGE"} and done["MLP"] > 0.6 and done["SAGE"] > 0.4  # chance is 1 / 3
    full = rows.withColumn("x", F.concat("x", F.array(*[F.lit(0.0)] * 6), F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.5), F.lit(0.1))))
    assert {r.config for r in training.ablations(full, ring, 2, kinds[0]._replace(epochs=2), 2).collect()} == set(features.ABLATIONS)


def test_layers_against_numpy(spark):
    rng = np.random.default_rng(3)
    x, edges = rng.normal(size=(6, 3)), [(0, 1), (1, 2), (2, 0), (3, 4), (0, 2)]
    w, u, b = rng.normal(size=(3, 2)), rng.normal(size=(3, 2)), rng.normal(size=2)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, x array<double>")
    e = spark.createDataFrame(edges, "src int, dst int")
    run = lambda df: np.array([r.x for r in df.orderBy("id").collect()])
    mean = np.array([np.mean([x[s] for s, d in edges if d == i] or [np.zeros(3)], axis=0) for i in range(6)])
    assert np.allclose(run(messages.sage(v, e, w.tolist(), u.tolist(), b.tolist())), x @ w + mean @ u + b)
    a = np.eye(6)
    for s, d in edges:
        a[d, s] += 1
    root = 1 / np.sqrt(a.sum(1))
    assert np.allclose(run(messages.gcn(v, e, w.tolist(), b.tolist())), (a * root[:, None] * root[None, :]) @ (x @ w) + b)
    p, q = rng.normal(size=(2, 2)), rng.normal(size=(2, 2))
    heads = []
    for k, m in enumerate((w, u)):
        h = x @ m
        score = (h @ q[k])[:, None] + (h @ p[k])[None, :]
        score = np.where(a > 0, np.where(score > 0, score, 0.2 * score), -np.inf)
        soft = np.exp(score - score.max(1, keepdims=True))
        heads.append((soft / soft.sum(1, keepdims=True)) @ h)
    got = run(messages.gat(v, e, [w.tolist(), u.tolist()], p.tolist(), q.tolist(), [0.0, 0.0], concat=False))
    assert np.allclose(got, (heads[0] + heads[1]) / 2)
    mlp = messages.Dense(w.tolist(), b.tolist(), [[1.0, 0.0], [0.5, -1.0]], [0.0, 0.1])
    hidden = np.maximum(x @ w + b, 0) @ np.array(mlp.second) + np.array(mlp.second_bias)
    refined = run(messages.hybrid(v, e, mlp, lambda n, g: messages.sage(n, g, [[1.0, 0], [0, 1.0]], [[0.0, 0], [0, 0.0]], [0.0, 0.0])))
    assert np.allclose(refined, 2 * hidden)


def test_wedges_of_hubs_are_shared(spark):
    rng = random.Random(8)
    pointed = [(0, i) for i in range(1, 60)] + [(1, i) for i in rng.sample(range(2, 60), 9)] + [(2, 5)]
    rows = spark.createDataFrame(pointed, "u int, v int")
    for block in (1, 7, 1000):
        got = [tuple(r) for r in graph.wedges(rows, block).collect()]
        of = {u: sorted(v for w, v in pointed if w == u) for u, _ in pointed}
        assert sorted(got) == sorted((u, x, y) for u, ends in of.items() for x in ends for y in ends if x < y)


def test_triangles_at_a_star_and_in_a_clique(spark):
    star = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    clique = spark.createDataFrame([(200_000 + i, 200_000 + j) for i in range(60) for j in range(i)], "src long, dst long")
    edges = star.union(clique).union(spark.createDataFrame([(1, 2), (2, 3), (0, 200_000)], "src long, dst long"))
    vertices = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    got = {r.id: (r.triangles, r.coefficient) for r in graph.clustering(vertices, edges, 16).where("triangles > 0").collect()}
    want = {0: (2, 0.0), 1: (1, 1.0), 2: (2, round(2 * 2 / 6, 6)), 3: (1, 1.0), 200_000: (59 * 58 // 2, round(59 * 58 / (60 * 59), 6))}
    want |= {200_000 + i: (59 * 58 // 2, 1.0) for i in range(1, 60)}
    assert got == want


def test_hot_and_null_parents(spark):
    rows = [("r", "r", None)] + [(f"a{i}", "r", "r") for i in range(300)] + [(f"b{i}", "r", "a0") for i in range(300)] + [(f"x{i}", f"x{i}", None) for i in range(300)] + [("lost", "gone", "gone")]
    tweets = spark.createDataFrame(rows, "tweet_id string, conversation_id string, parent_id string")
    depth = {r.tweet_id: r.depth for r in graph.reply_depth(tweets).collect()}
    assert depth == {i: 0 if i == c else 2 if p == "a0" else 1 for i, c, p in rows}
    assert graph.reply_edges(tweets).count() == 2 * 600 and graph.conversation_edges(tweets).count() == 2 * 600


def clustered(rng, clusters, each, width=64, spread=0.05):
    centers = rng.normal(size=(clusters, width))
    return [(i, (centers[i % clusters] + spread * np.linalg.norm(centers[i % clusters]) / width**0.5 * rng.normal(size=width)).tolist()) for i in range(clusters * each)]


def test_neighbours_by_a_tree_of_pivots(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = clustered(rng, 12, 20) + [(1000 + i, [1.0] * 64) for i in range(50)] + [(2000, [0.0] * 64)] + [(3000 + i, rng.normal(size=64).tolist()) for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    x = np.array([v for _, v in rows])
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    ids, cosine = [i for i, _ in rows], unit @ unit.T
    monkeypatch.setattr(graph, "FAN", 4)
    for block in (16,):
        got = {}
        for r in graph.nearest_neighbours(frame, 3, 0.75, block).collect():
            got.setdefault(r.src, []).append(round(r.similarity, 6))
        for at, i in enumerate(ids):
            near = sorted((c for j, c in zip(ids, cosine[at].tolist(), strict=True) if j != i and c > 0.75), reverse=True)[:3]
            assert sorted(got.get(i, []), reverse=True) == [round(c, 6) for c in near]


def test_share_of_block_pairs_falls_with_size(spark):
    rng = np.random.default_rng(7)
    shares = []
    for clusters in (10, 120):
        frame = spark.createDataFrame(clustered(rng, clusters, 20), "id long, vector array<double>")
        found = graph.block_pairs(frame, 0.75, 20).first()
        shares.append(found.pairs / found.blocks**2)
    assert shares[1] < shares[0] / 4 and shares[1] < 0.1
