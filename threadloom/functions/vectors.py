"""Vectors as arrays, without leaving the JVM."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def one_hot(code: Column, width: Column) -> Column:
    """A missing code (-1) sets the last place."""
    at = F.when(code < 0, width - 1).otherwise(code)
    return F.transform(F.sequence(F.lit(0), (width - 1).cast("int")), lambda i: (i == at).cast("double"))


def argmax(values: Column) -> Column:
    """Place of the first greatest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors under a 0/1 mask; the divisor is 1e-9 at least."""
    kept = F.zip_with(tokens, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    width = F.size(F.element_at(tokens, 1))
    total = F.aggregate(kept, F.array_repeat(F.lit(0.0), width), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    return F.transform(total, lambda x: x / weight)


def pooled(rows: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """(key, vector): the mean of a group's vectors weighted by their mask, combined before the shuffle; zeros if all are masked."""
    parts = rows.groupBy(key).agg(F.max(F.size(vector)).alias("width"), F.sum(mask).alias("weight"))
    held = rows.where(F.col(mask) > 0).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"), F.col(mask).cast("double").alias("w"))
    sums = held.groupBy(F.col(key).alias("__key")).agg(vector_to_array(Summarizer.sum(F.col("v"), F.col("w"))).alias("total"))
    joined = parts.join(sums, parts[key].eqNullSafe(F.col("__key")), "left")
    total = F.coalesce("total", F.array_repeat(F.lit(0.0), F.col("width")))
    return joined.select(key, F.transform(total, lambda x: x / F.greatest(F.col("weight"), F.lit(1e-9))).alias("vector"))


def cls_pool(tokens: Column) -> Column:
    return F.element_at(tokens, 1)


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    log_sum = top + F.ln(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    return F.transform(logits, lambda x: x - log_sum)


def focal_loss(logits: Column, target: Column, gamma: float = 2.0, weight: Column | None = None) -> Column:
    """(1 - p)^gamma times the cross entropy of the target class, weighted by class if weights are given."""
    entropy = -F.get(log_softmax(logits), target)
    if weight is not None:
        entropy = entropy * F.get(weight, target)
    return F.pow(1 - F.exp(-entropy), F.lit(gamma)) * entropy
