"""A dense classifier trained by mini-batches: Adam, a rate on half a cosine, patience by macro F1 on held-back rows.

A batch is the rows of one slot of a hash of their ids; rows are written once, a folder a slot, so a step reads its batch alone. Each
task adds up the gradients of its Arrow batches, chunks of the sums are combined before they reach the driver, and the driver
takes the step. All folds' models train in the same steps. A fold that has not got better for ``patience`` epochs keeps
its best weights and takes no more part; training ends when none is left.

Batches of over half of SEGMENT rows cost a job each. Smaller ones are taken in runs of about SEGMENT rows: each fold's model has a task that takes the run's steps one
after another, so weights pass through the driver once a run and not once a batch, and no task holds more than a run. Rows whose y is null
or not a class number neither teach nor count. An empty fold trains on all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import networks as N
from .networks import Params


SEGMENT = 65_536  # rows whose batches are taken in one job


class Settings(NamedTuple):
    classes: int = 4
    hidden: int = 256
    batch: int = 256
    epochs: int = 20
    rate: float = 1e-3
    least_rate: float = 1e-6
    decay: float = 0.01
    dropout: float = 0.3
    patience: int = 7
    held_back: int = 10  # per cent of a fold's training rows that patience goes by
    seed: int = 42


def initial(settings: Settings, inputs: int, models: int) -> Params:
    rng = np.random.default_rng(settings.seed)
    return {
        "m1": N.glorot(rng, models, inputs, settings.hidden), "b1": np.zeros((models, 1, settings.hidden)),
        "m2": N.glorot(rng, models, settings.hidden, settings.classes), "b2": np.zeros((models, 1, settings.classes)),
    }


def forward(p: Params, x: np.ndarray, kept: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(logits, hidden units)."""
    hidden = np.maximum(x @ p["m1"] + p["b1"], 0)
    return hidden * kept @ p["m2"] + p["b2"], hidden


def batch_gradients(p: Params, settings: Settings, step: int, keys: np.ndarray, own: np.ndarray, back: np.ndarray, y: np.ndarray, x: np.ndarray, first: int = 0) -> Params:
    """Summed loss, rows and gradients of each model, of those from ``first`` on, over the rows of a batch that teach it."""
    models = p["m1"].shape[0]
    kept = N.dropout(keys, step, 0, models, settings.hidden, settings.dropout, first)
    logits, hidden = forward(p, x, kept)
    teaches = (own[None] != np.arange(first, first + models)[:, None]) & (~back & (y >= 0) & (y < settings.classes))[None]
    loss, d = N.cross_entropy(logits, y, teaches.astype(float))
    inner = (d @ p["m2"].transpose(0, 2, 1)) * kept * (hidden > 0)
    wide = np.broadcast_to(x, (models, *x.shape[1:]))
    return {
        "loss": loss, "n": teaches.sum(1).astype(float), "m2": (hidden * kept).transpose(0, 2, 1) @ d, "b2": d.sum(1, keepdims=True),
        "m1": wide.transpose(0, 2, 1) @ inner, "b1": inner.sum(1, keepdims=True),
    }


def macro_f1(confusion: np.ndarray) -> np.ndarray:
    """Of (models, true, predicted) counts, the mean F1 over the classes that occur."""
    hit, true, told = np.einsum("mcc->mc", confusion), confusion.sum(2), confusion.sum(1)
    f1 = 2 * hit / np.maximum(true + told, 1)
    there = (true + told) > 0
    return (f1 * there).sum(1) / np.maximum(there.sum(1), 1)


class Patience:
    """Best weights of each model, and which models still train."""

    def __init__(self, params: Params, patience: int) -> None:
        models = params["m1"].shape[0]
        self.best, self.score, self.waited, self.patience = {k: v.copy() for k, v in params.items()}, np.full(models, -1.0), np.zeros(models, int), patience
        self.going = np.ones(models, bool)

    def after(self, params: Params, score: np.ndarray) -> bool:
        """Takes note of an epoch; false if no model goes on."""
        better = self.going & (score > self.score)
        for k in params:
            self.best[k][better] = params[k][better]
        self.score[better] = score[better]
        self.waited = np.where(better, 0, self.waited + 1)
        self.going &= self.waited < self.patience
        return bool(self.going.any())


def _columns(piece: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    keys, own, back, y = (np.asarray(piece.column(piece.schema.names.index(c))) for c in ("key", "own", "back", "y"))
    return keys, own, back.astype(bool), y, N.matrix(piece, "x")


def order_of(settings: Settings, epoch: int, slots: int) -> list[int]:
    """The batches of an epoch in their order."""
    return np.random.default_rng([settings.seed, epoch]).permutation(slots).tolist()


class MiniBatch:
    """Rows (id, fold, y, x) dealt to batches."""

    def __init__(self, rows: DataFrame, settings: Settings, folds: int) -> None:
        self.settings, self.folds, self.spark = settings, folds, rows.sparkSession
        self.scratch = Scratch(self.spark, "minibatch")
        base = rows.select("id", F.xxhash64("id").alias("key"), F.col("fold").cast("int").alias("own"), F.coalesce(F.col("y").cast("int"), F.lit(-1)).alias("y"), F.col("x").cast("array<double>").alias("x"))
        base = base.withColumn("back", (F.pmod(F.xxhash64("id", F.lit(settings.seed)), F.lit(100)) < settings.held_back).cast("int"))
        self.base = self.scratch.write(base, "base")
        self.slots = max(1, -(-self.base.count() // settings.batch))
        self.inputs = len((self.base.select("x").first() or [[]])[0])
        dealt = self.base.withColumn("slot", F.pmod(F.xxhash64("id", F.lit(settings.seed + 1)), F.lit(self.slots)))
        self.where = f"{self.scratch.root}/slots"
        self.run = max(1, SEGMENT // settings.batch)  # batches of a job
        dealt.repartition("slot", *([F.pmod("key", F.lit(8))] if self.run == 1 else [])).write.partitionBy("slot").parquet(self.where)
        self.dealt = self.spark.read.schema(dealt.schema).parquet(self.where)
        self.filled = {r.slot for r in dealt.select("slot").distinct().collect()}

    def batch(self, slot: int) -> DataFrame:
        return self.spark.read.schema(self.base.schema).parquet(f"{self.where}/slot={slot}")

    def fit(self) -> tuple[Params, list[np.ndarray], list[np.ndarray]]:
        """(best weights, each epoch's mean losses, each epoch's macro F1 on the held-back rows)."""
        s, params = self.settings, initial(self.settings, self.inputs, self.folds)
        adam, watch, losses, scores = N.Adam(params, s.decay, decoupled=True), Patience(params, s.patience), [], []
        like = params | {"loss": np.zeros(self.folds), "n": np.zeros(self.folds)}
        for epoch in range(s.epochs):
            rate, lost, seen = N.cosine_rate(s.rate, epoch, s.epochs, s.least_rate), np.zeros(self.folds), np.zeros(self.folds)
            order = [(epoch * self.slots + k + 1, slot) for k, slot in enumerate(order_of(s, epoch, self.slots))]
            for at in range(0, len(order), self.run):
                some = [(step, slot) for step, slot in order[at : at + self.run] if slot in self.filled]
                if self.run > 1 and some:
                    params, more, count = self._taken(some, params, adam, watch.going, rate)
                    lost, seen = lost + more, seen + count
                    continue
                for step, slot in some:
                    got = N.summed(self.batch(slot), lambda piece, p=params, k=step: batch_gradients(p, s, k, *_columns(piece)), like)
                    lost, seen, n = lost + got.pop("loss"), seen + got["n"], np.maximum(got.pop("n"), 1)[:, None, None]
                    moved = adam.step(params, {k: v / n for k, v in got.items()}, rate)
                    params = {k: np.where(watch.going[:, None, None], moved[k], params[k]) for k in params}
            losses.append(lost / np.maximum(seen, 1))
            scores.append(macro_f1(self._confusion(params)))
            if not watch.after(params, scores[-1]):
                break
        return watch.best, losses, scores

    def _taken(self, steps: list[tuple[int, int]], params: Params, adam: N.Adam, going: np.ndarray, rate: float) -> tuple[Params, np.ndarray, np.ndarray]:
        """(weights, summed losses, rows) after the steps (number, slot), each model's in a task of its own, which has SEGMENT rows or so; ``adam`` goes on with them."""
        s, at, m, v, t = self.settings, {slot: k for k, (_, slot) in enumerate(steps)}, adam.m, adam.v, adam.t
        folds = self.spark.range(self.folds).select(F.col("id").cast("int").alias("model"))
        rows = self.dealt.where(F.col("slot").isin(list(at)) & (F.col("back") == 0) & F.col("y").between(0, s.classes - 1))
        sent = rows.select("slot", "key", "own", "back", "y", "x", F.explode(F.array(*map(F.lit, range(self.folds)))).alias("model")).where("NOT own <=> model")

        def train(left: pa.Table, right: pa.Table) -> pa.Table:
            f = right["model"][0].as_py()
            one = lambda w: {k: x[f : f + 1] for k, x in w.items()}
            own_adam, p, lost, seen = N.Adam(one(params), s.decay, decoupled=True), one(params), 0.0, 0.0
            own_adam.m, own_adam.v, own_adam.t = one(m), one(v), t
            place = np.array([at[x] for x in left["slot"].to_pylist()], np.int64)
            order = np.lexsort((left["key"].to_numpy(), place))
            keys, own, y = (left[c].to_numpy()[order] for c in ("key", "own", "y"))
            x = np.asarray(left["x"].combine_chunks().flatten(), np.float64).reshape(len(order), -1)[order]
            ends = np.searchsorted(place[order], np.arange(len(steps) + 1))
            for k, (step, _) in enumerate(steps):
                total = {n: np.zeros_like(w) for n, w in p.items()} | {"loss": np.zeros(1), "n": np.zeros(1)}
                for low in range(ends[k], ends[k + 1], N.ROWS):
                    part = slice(low, min(low + N.ROWS, ends[k + 1]))
                    got = batch_gradients(p, s, step, keys[part], own[part], np.zeros(len(keys[part]), bool), y[part], x[part][None], f)
                    total = {n: w + got[n] for n, w in total.items()}
                lost, count = lost + total.pop("loss")[0], total.pop("n")[0]
                seen += count
                if going[f]:
                    p = own_adam.step(p, {n: w / max(count, 1) for n, w in total.items()}, rate)
            return pa.table({"model": pa.array([f], pa.int32()), "lost": [lost], "seen": [seen], **{n: [N.packed(w)] for n, w in (("p", p), ("m", own_adam.m), ("v", own_adam.v))}})

        fields = "model int, lost double, seen double, p array<double>, m array<double>, v array<double>"
        done = sorted(sent.groupBy("model").cogroup(folds.groupBy("model")).applyInArrow(train, fields).collect())  # a row a model
        join = lambda c: {n: np.concatenate([N.unpacked(np.array(r[c]), {n: w[:1] for n, w in params.items()})[n] for r in done]) for n in params}
        adam.m, adam.v, adam.t = join("m"), join("v"), t + len(steps)
        return join("p"), np.array([r.lost for r in done]), np.array([r.seen for r in done])

    def _confusion(self, params: Params) -> np.ndarray:
        s, folds = self.settings, self.folds

        def count(piece: pa.RecordBatch) -> Params:
            _, own, back, y, x = _columns(piece)
            told, out = forward(params, x)[0].argmax(2), np.zeros((folds, s.classes, s.classes))
            for f in range(folds):
                some = back & (own != f) & (y >= 0) & (y < s.classes)
                np.add.at(out[f], (y[some], told[f][some]), 1)
            return {"c": out}

        return N.summed(self.base.where("back = 1"), count, {"c": np.zeros((folds, s.classes, s.classes))})["c"]

    def predictions(self, params: Params) -> DataFrame:
        """(id, fold, y_true, y_pred): each row with a class by the model that was trained without its fold."""
        folds, classes = self.folds, self.settings.classes

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in N.pieces(batches):
                _, own, _, _, x = _columns(piece)
                best = forward(params, x)[0][np.clip(own, 0, folds - 1), np.arange(len(own))].argmax(1)
                yield pa.RecordBatch.from_arrays([*piece.select(["id", "own", "y"]).columns, pa.array(best.astype(np.int32))], ["id", "fold", "y_true", "y_pred"])

        out = self.base.mapInArrow(chosen, f"id {self.base.schema['id'].dataType.simpleString()}, fold int, y_true int, y_pred int")
        return out.where(F.col("y_true").between(0, classes - 1) & F.col("fold").between(0, folds - 1))


def cross_validate(rows: DataFrame, settings: Settings, folds: int = 10) -> DataFrame:
    """Out-of-fold predictions (id, fold, y_true, y_pred)."""
    run = MiniBatch(rows, settings, folds)
    return run.predictions(run.fit()[0])
