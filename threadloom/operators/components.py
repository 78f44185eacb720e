"""Connected components by randomised contraction, on tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..skew import split_join


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b); a component is named by its smallest id.

    In each round every vertex moves to the neighbour (or itself) whose hash of id and round is least; edges follow,
    and those that have become loops or repeats go. Expected rounds are logarithmic in the longest path, for chains too.
    Every round is a written table, so nothing is computed twice when an executor is lost.
    """
    live = scratch.write(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{tag}-edges")
    named, round_, old = None, 0, f"{tag}-edges"
    while not live.isEmpty():
        both = live.select(F.col("a").alias("u"), F.col("b").alias("v")).union(live.select(F.col("b").alias("u"), F.col("a").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(round_)).alias("h"), F.col(c).alias("id"))
        moved = both.groupBy("u").agg(F.min(rank("v")).alias("best"), F.count("*").alias("k")).select("u", F.least(F.col("best"), rank("u"))["id"].alias("to"), "k")
        moved = scratch.write(moved, f"{tag}-moved{round_}")
        first = moved.select(F.col("u").alias("a"), F.col("to").alias("x"), "k")
        second = moved.select(F.col("u").alias("b"), F.col("to").alias("y"), "k")
        size = live.count()  # a vertex with many edges is split, its own row is small
        after = split_join(split_join(live, first, "a", size), second, "b", size).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()
        new = f"{tag}-edges{round_}"
        live = scratch.write(after, new)
        scratch.drop(old)
        if named is None:
            named = moved.select(F.col("u").alias("id"), F.col("to").alias("label"))
        else:
            step = moved.select(F.col("u").alias("label"), "to")
            named = named.join(step, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        named = scratch.write(named, f"{tag}-named{round_}")
        scratch.drop(f"{tag}-moved{round_}", f"{tag}-named{round_ - 1}")
        old, round_ = new, round_ + 1
    if named is None:
        return live.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = named.groupBy("label").agg(F.min("id").alias("component"))
    return named.join(least, "label").select("id", "component")
