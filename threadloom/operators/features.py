"""Node features: assembly, ablations and checks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: class numbers.
CLASS_IDS = {"reason": 0, "statement": 1, "notification": 2, "none": 3}


class Blocks(NamedTuple):
    """Which parts of [embedding, perspectives, topic one-hot, depth, confidence] a feature vector keeps."""

    embedding: bool = True
    perspectives: bool = True
    topic: bool = True
    depth: bool = True
    confidence: bool = True


ABLATIONS = {
    "all": Blocks(),
    "embs_only": Blocks(perspectives=False, topic=False, depth=False, confidence=False),
    "embs_persp": Blocks(topic=False, depth=False, confidence=False),
    "embs_topic": Blocks(perspectives=False, depth=False, confidence=False),
    "embs_depth": Blocks(perspectives=False, topic=False, confidence=False),
    "embs_conf": Blocks(perspectives=False, topic=False, depth=False),
}


def class_id(label: Column) -> Column:
    """The class's number; null for other values."""
    return F.create_map(*[F.lit(x) for p in CLASS_IDS.items() for x in p])[label]


def assemble(*parts: Column) -> Column:
    """One array<float> of arrays and numbers side by side; an array part must come as an array."""
    return F.concat(*[p.cast("array<float>") for p in parts])


def scalar(c: Column) -> Column:
    return F.array(c.cast("float"))


def select_blocks(x: Column, keep: Blocks, embedding: int, perspectives: int = 6) -> Column:
    """The kept blocks of an assembled vector; the topic block is what is left between the others and the two last places."""
    topics = F.size(x) - (embedding + perspectives + 2)
    starts = [F.lit(1), F.lit(1 + embedding), F.lit(1 + embedding + perspectives), F.size(x) - 1, F.size(x)]
    sizes = [F.lit(embedding), F.lit(perspectives), topics, F.lit(1), F.lit(1)]
    parts = [F.slice(x, s, n) for k, s, n in zip(keep, starts, sizes, strict=True) if k]
    return F.concat(*parts) if parts else F.slice(x, 1, 0)


def matrix_stats(df: DataFrame, vector: str = "x", first: int = 0, count: int = 6) -> DataFrame:
    """Global range, mean and sample deviation of all values, whether any is NaN or infinite, and the distinct values of some columns."""
    values = df.select(F.posexplode(vector).alias("at", "v")).withColumn("v", F.col("v").cast("double"))
    bad = F.isnan("v") | F.abs(F.col("v")).eqNullSafe(F.lit(float("inf")))
    inside = F.col("at").between(first, first + count - 1)
    return values.agg(
        F.round(F.min("v"), 6).alias("min"), F.round(F.max("v"), 6).alias("max"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"),
        F.bool_or(bad).alias("bad"), F.count_distinct(F.when(inside, F.col("v"))).alias("distinct_inside"),
    )
