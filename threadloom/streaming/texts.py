"""Streams: the per-row operators run unchanged on a stream; profiles run on windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import preprocess
from ..functions.urls import extract_urls, raw_domain


def preprocess_stream(tweets: DataFrame, **settings) -> DataFrame:
    """Preprocessed records of a stream of (tweet_id, text, taco_class, topic, confidence)."""
    return preprocess(tweets, **settings)


def windowed_domains(tweets: DataFrame, at: str = "ts", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Domain counts by window; a window closes when the watermark has passed it."""
    urls = tweets.withWatermark(at, late).select(at, F.explode(extract_urls(F.col("text"))).alias("url"))
    return urls.groupBy(F.window(at, size).alias("window"), raw_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


def windowed_perspectives(annotations: DataFrame, at: str = "ts", threshold: float = 0.7, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Labels of at least the threshold's confidence by window."""
    taken = annotations.withWatermark(at, late).where(F.col("confidence") >= threshold)
    return taken.groupBy(F.window(at, size).alias("window"), "label").agg(F.count("*").alias("n"), F.max("confidence").alias("max_confidence"))
