"""Joins, filters, codes and set operations of the threaded-text model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import vertex_index


def merge_tweets(votes: DataFrame, backup: DataFrame, threads: DataFrame) -> DataFrame:
    """votes with text and thread ids, all votes kept; repeated ids fan out."""
    return votes.join(backup, "tweet_id", "left").join(threads.select("tweet_id", "conversation_id", "parent_id"), "tweet_id", "left")


def not_equal(c: Column, value: str) -> Column:
    """Different from the value; a null is different."""
    return ~c.eqNullSafe(F.lit(value))


def not_in(c: Column, values: list[str]) -> Column:
    return ~F.coalesce(c.isin(values), F.lit(False))


def normalise_class(c: Column) -> Column:
    """Trimmed lower case; missing values read ``None``."""
    low = F.lower(F.trim(c))
    return F.when(low.isNull() | (low == "nan"), "None").otherwise(low)


def join_features(tweets: DataFrame, features: DataFrame) -> DataFrame:
    """Tweets with features of the same id and topic (two missing topics agree); clashing columns get _taco and _persp."""
    clash = (set(tweets.columns) & set(features.columns)) - {"tweet_id", "topic"}
    a = tweets.select([F.col(c).alias(f"{c}_taco" if c in clash else c) for c in tweets.columns])
    b = features.select([F.col(c).alias(f"{c}_persp" if c in clash else ("__" + c if c in ("tweet_id", "topic") else c)) for c in features.columns])
    return a.join(b, (a["tweet_id"] == b["__tweet_id"]) & a["topic"].eqNullSafe(b["__topic"])).drop("__tweet_id", "__topic")


def overlay(success: DataFrame, failed: DataFrame) -> DataFrame:
    """(tweet_id, annotations) of both runs; a failed id wins and has no annotations."""
    lost = failed.select("tweet_id", F.array().cast(success.schema["annotations"].dataType).alias("annotations")).dropDuplicates(["tweet_id"])
    return success.select("tweet_id", "annotations").join(lost, "tweet_id", "left_anti").unionByName(lost)


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """``df`` with <column>_code, the rank of the value among the sorted distinct ones from 0 (-1 if missing), and n_codes.

    The dictionary has a row per distinct value, is ranked in ranges and joined.
    """
    values = vertex_index(df.where(F.col(column).isNotNull()).select(column).distinct(), column)
    codes = values.select(column, F.col("idx").cast("int").alias("code"))
    count = values.agg(F.count("*").cast("int").alias("n_codes"))  # one row
    out = df.join(codes, column, "left").crossJoin(F.broadcast(count))
    return out.select(*df.columns, F.coalesce("code", F.lit(-1)).alias(f"{column}_code"), "n_codes")


ARGUMENT = ("reason", "statement")  # fixed value: the classes that make an argument


def binary_collapse(label: Column, positive: tuple = ARGUMENT) -> Column:
    """Whether a class belongs to the positive side; a missing one doesn't."""
    return F.coalesce(label.isin(*positive), F.lit(False))


def replaced(c: Column, values: dict) -> Column:
    """The value that the map gives, or else what was there."""
    return F.coalesce(F.create_map(*[F.lit(x) for p in values.items() for x in p])[c], c)


def same_ids(a: DataFrame, b: DataFrame, key: str = "tweet_id") -> bool:
    """Whether both hold the same ids, with the same repeats."""
    left, right = a.select(key), b.select(key)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def align(frame: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """Inner join on id that fails, when it runs, for a row without a vector."""
    joined = frame.join(vectors.withColumnRenamed("vector", "__v"), key, "left")
    checked = F.when(F.col("__v").isNull(), F.raise_error(F.concat(F.lit("no vector for id "), F.col(key).cast("string")))).otherwise(F.col("__v"))
    return joined.withColumn("vector", checked).drop("__v")
