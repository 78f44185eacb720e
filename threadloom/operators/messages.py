"""Message passing over (id, x) vertices and (src, dst) edges with given weights.

Vectors are arrays. A layer is one join, and one aggregation by Spark's vector summarizer, which combines before the shuffle and
keeps one buffer per vertex, not a row per dimension. Edges of a hub, a vertex with over 1 / PARTS of all edges at one end, stay where they are
and get its state by broadcast (``skew.hot_join``). Weights are matrices of fixed size (rows: inputs) that travel in the
closure of an Arrow function, so plans don't grow with them. Dropout is the identity when a model is applied.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..skew import hot_join, hot_keys

Matrix = Sequence[Sequence[float]]
EPS = 1e-5


class Edges(NamedTuple):
    """Written edges and the hubs at either end, as several layers use them."""

    rows: DataFrame
    sources: list
    targets: list

    def met(self, rows: DataFrame, state: DataFrame, end: str) -> DataFrame:
        return hot_join(rows, state, end, self.sources if end == "src" else self.targets)


def edges_of(edges: DataFrame | Edges) -> Edges:
    if isinstance(edges, Edges):
        return edges
    rows = Scratch(edges.sparkSession, "edges").write(edges.select("src", "dst"), "edges")
    total = rows.count()
    return Edges(rows, hot_keys(rows, "src", total), hot_keys(rows, "dst", total))


Layer = Callable[[DataFrame, "DataFrame | Edges"], DataFrame]


def _applied(x: Column, forward: Callable[[np.ndarray], np.ndarray]) -> Column:
    """``forward`` on the vectors of an Arrow batch as rows of a matrix."""

    @F.pandas_udf("array<double>")
    def apply(rows: pd.Series) -> pd.Series:
        return pd.Series(list(forward(np.array(rows.tolist(), np.float64)))) if len(rows) else pd.Series([], dtype=object)

    return apply(x)


def linear(x: Column, weight: Matrix, bias: Sequence[float] | None = None) -> Column:
    """x W + b."""
    w, b = np.array(weight, np.float64), np.array(bias if bias is not None else 0.0, np.float64)
    return _applied(x, lambda rows: rows @ w + b)


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def rows_normed(rows: np.ndarray) -> np.ndarray:
    """Each row less its mean, over its deviation."""
    return (rows - rows.mean(1, keepdims=True)) / np.sqrt(rows.var(1, keepdims=True) + EPS)


def add(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def _plus(x: Column, bias: Sequence[float]) -> Column:
    b = np.array(bias, np.float64)
    return _applied(x, lambda rows: rows + b) if np.any(b) else x


def layer_norm(x: Column, mean: Column, std: Column, eps: float = EPS) -> Column:
    """Graph-wide normalisation with the mean and deviation of all values."""
    return F.transform(x, lambda v: (v - mean) / (std + eps))


def normalise_graph(vertices: DataFrame) -> DataFrame:
    """``x`` normalised over all vertices and dimensions."""
    total = lambda power: F.sum(F.aggregate("x", F.lit(0.0), lambda s, v: s + F.pow(v.cast("double"), F.lit(power))))
    sums = vertices.agg(total(1).alias("s"), total(2).alias("q"), F.sum(F.size("x")).alias("n"))  # one row
    stats = sums.select((F.col("s") / F.col("n")).alias("m"), F.sqrt(F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2)), F.lit(0.0))).alias("d"))
    return vertices.crossJoin(F.broadcast(stats)).withColumn("x", layer_norm(F.col("x"), F.col("m"), F.col("d"))).drop("m", "d")


def _vector(x: str) -> Column:
    return array_to_vector(F.col(x).cast("array<double>"))


def _loops(vertices: DataFrame) -> DataFrame:
    return vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"))


def sage(vertices: DataFrame, edges: DataFrame | Edges, own: Matrix, neighbour: Matrix, bias: Sequence[float]) -> DataFrame:
    """x W_own + mean of the in-neighbours W_neighbour + b; a vertex without any has a zero mean."""
    graph = edges_of(edges)
    sent = graph.met(graph.rows, vertices.select(F.col("id").alias("src"), _vector("x").alias("v")), "src")
    mean = sent.groupBy(F.col("dst").alias("id")).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("mean"))
    joined = vertices.join(mean, "id", "left").withColumn("mean", F.coalesce("mean", F.transform("x", lambda v: F.lit(0.0))))
    both = np.concatenate([np.array(own, np.float64), np.array(neighbour, np.float64)])
    return joined.select("id", linear(F.concat(F.col("x").cast("array<double>"), "mean"), both, bias).alias("x"))


def gcn(vertices: DataFrame, edges: DataFrame | Edges, weight: Matrix, bias: Sequence[float]) -> DataFrame:
    """Symmetrically normalised sum over in-neighbours and itself, of x W, plus b."""
    graph = edges_of(edges)
    loops = graph.rows.unionByName(_loops(vertices))
    degree = loops.groupBy("dst").agg(F.sqrt(F.count("*")).alias("root"))
    state = vertices.select("id", linear(F.col("x"), weight).alias("h")).join(degree.withColumnRenamed("dst", "id"), "id")
    sent = graph.met(loops, state.select(F.col("id").alias("src"), (1 / F.col("root")).alias("w"), _vector("h").alias("v")), "src")
    total = sent.groupBy("dst").agg(vector_to_array(Summarizer.sum(F.col("v"), F.col("w"))).alias("x"))
    scaled = total.join(degree, "dst").select(F.col("dst").alias("id"), F.transform("x", lambda v: v / F.col("root")).alias("x"))
    return scaled.select("id", _plus(F.col("x"), bias).alias("x"))


def gat(vertices: DataFrame, edges: DataFrame | Edges, weights: Sequence[Matrix], source: Matrix, target: Matrix, bias: Sequence[float], concat: bool = True, slope: float = 0.2) -> DataFrame:
    """Attention over in-neighbours and itself with one weight matrix per head; heads side by side, or their mean."""
    heads, width = len(weights), len(weights[0][0])
    graph = edges_of(edges)
    loops = graph.rows.where("src <> dst").unionByName(_loops(vertices))
    w = np.concatenate([np.array(m, np.float64) for m in weights], 1)
    a, b = (np.array(v, np.float64) for v in (source, target))

    def forward(rows: np.ndarray) -> np.ndarray:
        """The heads' states, then their scores as a source, then as a target."""
        h = rows @ w
        by_head = h.reshape(len(h), heads, width)
        return np.concatenate([h, (by_head * a).sum(2), (by_head * b).sum(2)], 1)

    state = vertices.select("id", _applied(F.col("x"), forward).alias("z"))
    part = lambda k: F.slice("z", k * width + 1, width)
    sender = state.select(F.col("id").alias("src"), *[array_to_vector(part(k)).alias(f"h{k}") for k in range(heads)], F.slice("z", heads * width + 1, heads).alias("s"))
    taker = state.select(F.col("id").alias("dst"), F.slice("z", heads * width + heads + 1, heads).alias("t"))
    scores = F.zip_with("s", "t", lambda x, y: F.when(x + y > 0, x + y).otherwise((x + y) * slope))
    pair = graph.met(graph.met(loops, sender, "src"), taker, "dst").select("dst", *[f"h{k}" for k in range(heads)], scores.alias("e"))
    top = pair.groupBy("dst").agg(F.array(*[F.max(F.get("e", F.lit(k))) for k in range(heads)]).alias("top"))
    pair = graph.met(pair, top, "dst").withColumn("w", F.zip_with("e", "top", lambda x, y: F.exp(x - y)))
    means = pair.groupBy("dst").agg(*[vector_to_array(Summarizer.mean(F.col(f"h{k}"), F.get("w", F.lit(k)))).alias(f"m{k}") for k in range(heads)])
    names = [F.col(f"m{k}") for k in range(heads)]
    if concat:
        out = F.concat(*names)
    else:
        out = names[0]
        for n in names[1:]:
            out = add(out, n)
        out = F.transform(out, lambda v: v / heads)
    return means.select(F.col("dst").alias("id"), out.alias("x")).select("id", _plus(F.col("x"), bias).alias("x"))


def stack(vertices: DataFrame, edges: DataFrame, layers: Sequence[Layer], classifier: tuple[Matrix, Sequence[float]]) -> DataFrame:
    """Logits of a stack: each layer normalised over the graph, ReLU between layers, then a linear classifier.

    ``layers`` are functions of (vertices, edges), such as ``gcn`` with its weights bound. Edges and each layer's result are
    written, as several later steps read them.
    """
    scratch = Scratch(vertices.sparkSession, "stack")
    state, edges = vertices.select("id", "x"), edges_of(edges)
    for k, layer in enumerate(layers):
        state = normalise_graph(scratch.write(layer(state, edges), f"layer{k}"))
        if k + 1 < len(layers):
            state = state.select("id", relu(F.col("x")).alias("x"))
    return state.select("id", linear(F.col("x"), *classifier).alias("x"))


class Dense(NamedTuple):
    """Weights of Linear, ReLU, Linear."""

    first: Matrix
    first_bias: Sequence[float]
    second: Matrix
    second_bias: Sequence[float]

    def __call__(self, x: Column) -> Column:
        w, b, v, c = (np.array(m, np.float64) for m in self)
        return _applied(x, lambda rows: np.maximum(rows @ w + b, 0.0) @ v + c)

    def normed(self, x: Column) -> Column:
        """With the hidden units normalised by row."""
        w, b, v, c = (np.array(m, np.float64) for m in self)
        return _applied(x, lambda rows: np.maximum(rows_normed(rows @ w + b), 0.0) @ v + c)


def hybrid(vertices: DataFrame, edges: DataFrame, mlp: Dense, refine: Layer) -> DataFrame:
    """Logits of the dense model plus those of a graph model that refines them: ``refine(vertices, edges)`` on (id, logits)."""
    logits = vertices.select("id", mlp(F.col("x")).alias("x"))
    refined = refine(logits, edges).select("id", F.col("x").alias("r"))
    return logits.join(refined, "id").select("id", add(F.col("x"), F.col("r")).alias("x"))


def fused(embedding: Column, perspectives: Column, mlp: Dense) -> Column:
    """Logits from an embedding and perspective features side by side."""
    return mlp(F.concat(embedding.cast("array<double>"), perspectives.cast("array<double>")))


def multi_scale(vertices: DataFrame, layers: Sequence[DataFrame]) -> DataFrame:
    """Each vertex's outputs of several layers side by side."""
    joined = vertices.select("id", F.col("x").cast("array<double>").alias("x"))
    for k, layer in enumerate(layers):
        joined = joined.join(layer.select("id", F.col("x").alias(f"x{k}")), "id")
    return joined.select("id", F.concat("x", *[F.col(f"x{k}") for k in range(len(layers))]).alias("x"))


def balanced(vertices: DataFrame, edges: DataFrame, project: tuple[Matrix, Sequence[float]], layers: Sequence[Layer], classifier: Dense) -> DataFrame:
    """Projection, layers with residuals from the second on, and a classifier on projection, last state and input side by side.

    The projection and the classifier's hidden units are normalised by row, graph layers over the graph.
    """
    scratch = Scratch(vertices.sparkSession, "balanced")
    edges = edges_of(edges)
    w, b = (np.array(m, np.float64) for m in project)
    first = scratch.write(vertices.select("id", _applied(F.col("x"), lambda rows: np.maximum(rows_normed(rows @ w + b), 0.0)).alias("x")), "first")
    state = first
    for k, layer in enumerate(layers):
        after = normalise_graph(scratch.write(layer(state, edges), f"layer{k}")).select("id", relu(F.col("x")).alias("x"))
        if k:
            after = after.join(state.select("id", F.col("x").alias("before")), "id").select("id", add(F.col("x"), F.col("before")).alias("x"))
        state = after
    return multi_scale(first, [state, vertices.select("id", F.col("x").cast("array<double>").alias("x"))]).select("id", classifier.normed(F.col("x")).alias("x"))
