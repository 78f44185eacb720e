"""Mini-batch training against a plain loop over the same batches."""

import numpy as np

from threadloom.operators import minibatch as B
from threadloom.operators import networks as N
from threadloom.operators import training

FOLDS = 3
SETTINGS = B.Settings(classes=3, hidden=5, batch=16, epochs=5, rate=0.05, dropout=0.2, patience=2)


def data(spark, n=90, seed=2):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 4)) + 2 * np.eye(4)[y]
    rows = [(i, i % FOLDS, None if i == 7 else 9 if i == 8 else int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(rows, "id long, fold int, y int, x array<double>")


def plain(run, settings):
    """The same training row by row: (best weights by fold, losses, scores)."""
    rows = run.base.withColumn("slot", __import__("pyspark").sql.functions.expr(f"pmod(xxhash64(id, {settings.seed + 1}), {run.slots})")).collect()
    p, models = B.initial(settings, 4, FOLDS), range(FOLDS)
    adam, step, losses, scores = N.Adam(p, settings.decay, decoupled=True), 0, [], []
    best, top, waited, going = [None] * FOLDS, [-1.0] * FOLDS, [0] * FOLDS, [True] * FOLDS
    for epoch in range(settings.epochs):
        rate, lost, seen = N.cosine_rate(settings.rate, epoch, settings.epochs, settings.least_rate), np.zeros(FOLDS), np.zeros(FOLDS)
        for slot in B.order_of(settings, epoch, run.slots):
            step += 1
            own = [r for r in rows if r.slot == slot]
            if not own:
                continue
            g, n = {k: np.zeros_like(v) for k, v in p.items()}, np.zeros(FOLDS)
            for r in own:
                kept = N.dropout(np.array([r.key]), step, 0, FOLDS, settings.hidden, settings.dropout)
                for f in models:
                    if r.own == f or r.back or not 0 <= r.y < 3:
                        continue
                    x, mask = np.array(r.x), kept[f, 0]
                    h = np.maximum(x @ p["m1"][f] + p["b1"][f, 0], 0)
                    z = (h * mask) @ p["m2"][f] + p["b2"][f, 0]
                    q = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
                    lost[f] -= np.log(q[r.y])
                    n[f] += 1
                    d = q - np.eye(3)[r.y]
                    inner = (p["m2"][f] @ d) * mask * (h > 0)
                    g["m2"][f] += np.outer(h * mask, d)
                    g["b2"][f, 0] += d
                    g["m1"][f] += np.outer(x, inner)
                    g["b1"][f, 0] += inner
            seen += n
            moved = adam.step(p, {k: v / np.maximum(n, 1)[:, None, None] for k, v in g.items()}, rate)
            p = {k: np.array([moved[k][f] if going[f] else p[k][f] for f in models]) for k in p}
        losses.append(lost / np.maximum(seen, 1))
        now = []
        for f in models:
            told = [(r.y, int((np.maximum(np.array(r.x) @ p["m1"][f] + p["b1"][f, 0], 0) @ p["m2"][f] + p["b2"][f, 0]).argmax())) for r in rows if r.back and r.own != f and 0 <= r.y < 3]
            names = {a for pair in told for a in pair}
            f1 = [2 * sum(a == b == c for a, b in told) / (sum(a == c for a, _ in told) + sum(b == c for _, b in told)) for c in names]
            now.append(sum(f1) / max(1, len(f1)))
            if going[f] and now[f] > top[f]:
                top[f], waited[f], best[f] = now[f], 0, {k: v[f].copy() for k, v in p.items()}
            else:
                waited[f] += 1
        scores.append(now)
        going = [g and w < settings.patience for g, w in zip(going, waited, strict=True)]
        if not any(going):
            break
    return best, losses, scores


def test_training_equals_a_plain_loop(spark):
    run = B.MiniBatch(data(spark), SETTINGS, FOLDS)
    best, losses, scores = run.fit()
    want, lost, scored = plain(run, SETTINGS)
    assert np.allclose(losses, lost) and np.allclose(scores, scored)
    assert all(np.allclose(best[k][f], want[f][k]) for k in best for f in range(FOLDS))
    assert (losses[-1] < losses[0]).all()
    got = {r.id: r for r in run.predictions(best).collect()}
    assert set(got) == set(range(90)) - {7, 8}
    for r in run.base.where("y BETWEEN 0 AND 2").collect():
        p = want[r.own]
        z = np.maximum(np.array(r.x) @ p["m1"] + p["b1"][0], 0) @ p["m2"] + p["b2"][0]
        assert got[r.id].y_pred == int(z.argmax()) and got[r.id].fold == r.own


def test_summary_of_folds(spark):
    done = training.summary(B.cross_validate(data(spark), SETTINGS._replace(epochs=8, patience=8, dropout=0.0), FOLDS)).first()
    assert done.mean_accuracy > 0.6 and done.std_accuracy >= 0


def test_patience_keeps_the_best_of_each_model():
    p = {"m1": np.zeros((2, 1, 1))}
    watch = B.Patience(p, 2)
    for k, score in enumerate([(0.5, 0.1), (0.4, 0.2), (0.3, 0.3), (0.9, 0.2)]):
        go = watch.after({"m1": np.full((2, 1, 1), float(k))}, np.array(score))
    assert go and watch.best["m1"].ravel().tolist() == [0.0, 2.0] and watch.going.tolist() == [False, True]


def test_macro_f1_leaves_out_absent_classes():
    assert np.allclose(B.macro_f1(np.array([[[2, 0, 0], [1, 1, 0], [0, 0, 0]]], float)), [(0.8 + 2 / 3) / 2])


def test_runs_of_batches_and_single_ones_give_the_same(spark, monkeypatch):
    jobs, found = [], []
    for segment in (1 << 16, 40, 1):
        monkeypatch.setattr(B, "SEGMENT", segment)
        run = B.MiniBatch(data(spark), SETTINGS._replace(epochs=2), FOLDS)
        taken = run._taken
        run._taken = lambda *a, f=taken: jobs.append(segment) or f(*a)  # noqa: B023
        found.append(run.fit())
    assert jobs.count(1 << 16) == 2 and jobs.count(40) == 2 * -(-run.slots // 2) and not jobs.count(1)  # one a run, not one a batch
    for best, losses, scores in found[1:]:
        assert np.allclose(losses, found[0][1]) and np.allclose(scores, found[0][2])
        assert all(np.allclose(best[k], found[0][0][k]) for k in best)
