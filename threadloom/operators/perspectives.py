"""Annotations to features, and summaries of annotation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.annotations import LABEL_COLUMNS, LABELS, build_prompt, validate_response
from .profile import percent

THRESHOLD = 0.7


def aggregate(annotations: DataFrame, key: str = "tweet_id", threshold: float = THRESHOLD) -> DataFrame:
    """Features of each id from rows (id, label, confidence): presence, greatest confidence and count by label, and totals.

    Only known labels of the threshold's confidence count, but total_annotations counts all rows.
    """
    low = F.coalesce(F.col("confidence"), F.lit(0.0)).cast("double")
    taken = F.col("label").isin(*LABELS) & (low >= threshold)
    own = dict(zip(LABEL_COLUMNS, (taken & (F.col("label") == x) for x in LABELS), strict=True))
    return annotations.groupBy(key).agg(
        *[F.max(F.when(c, 1).otherwise(0)).alias(k) for k, c in own.items()],
        *[F.coalesce(F.max(F.when(c, low)), F.lit(0.0)).alias(f"max_conf_{k}") for k, c in own.items()],
        *[F.count_if(c).alias(f"count_{k}") for k, c in own.items()],
        F.count_distinct(F.when(taken, F.col("label"))).alias("num_perspectives"),
        F.round(F.coalesce(F.avg(F.when(taken, low)), F.lit(0.0)), 6).alias("avg_confidence"),
        F.count("*").alias("total_annotations"),
    )


def enrich(tweets: DataFrame, annotations: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Features of every tweet; one without annotations has zeros."""
    features = aggregate(annotations, "tweet_id", threshold)
    joined = tweets.join(features, "tweet_id", "left").fillna(0, [c for c in features.columns if c != "tweet_id"])
    text = F.col("text")
    meta = [F.coalesce(F.length(text), F.lit(0)).alias("text_length"), X.word_count(text).alias("word_count"), X.contains_http(text).alias("has_url")]
    return joined.select("tweet_id", "taco_class", "topic", "text", *meta, *[c for c in features.columns if c != "tweet_id"])


def _long(features: DataFrame, *keys: str) -> DataFrame:
    parts = ", ".join(f"'{c}', {c}, max_conf_{c}" for c in LABEL_COLUMNS)
    return features.select(*keys, F.expr(f"stack({len(LABEL_COLUMNS)}, {parts}) AS (perspective, present, confidence)"))


def _prevalence() -> list[Column]:
    mean = F.round(F.coalesce(F.avg(F.when(F.col("present") == 1, F.col("confidence"))), F.lit(0.0)), 6)
    return [F.sum("present").alias("n"), percent(F.sum("present"), F.count("*")).alias("percent"), mean.alias("mean_confidence")]


def prevalence(features: DataFrame) -> DataFrame:
    return _long(features).groupBy("perspective").agg(*_prevalence())


def by_class(features: DataFrame) -> DataFrame:
    return features.groupBy("taco_class").agg(F.count("*").alias("n"), F.round(F.avg("num_perspectives"), 6).alias("mean_perspectives"))


def class_breakdown(features: DataFrame) -> DataFrame:
    return _long(features, "taco_class").groupBy("taco_class", "perspective").agg(F.count("*").alias("total"), *_prevalence())


def build_prompts(tweets: DataFrame) -> DataFrame:
    return tweets.select("tweet_id", "text", build_prompt(F.col("tweet_id"), F.coalesce("text", F.lit(""))).alias("prompt"))


def validate(responses: DataFrame, strict: bool = False) -> DataFrame:
    """(tweet_id, text, response) with is_valid, error, errors and the valid annotations."""
    return responses.withColumn("v", validate_response(F.col("response"), F.col("text"), strict)).select(*responses.columns, "v.*")


def validation_metrics() -> list[Column]:
    """Totals, error counts by kind and the rate of valid answers, as aggregates; answers without well-formed JSON are neither valid nor invalid."""
    bad_items = F.size(F.filter("errors", lambda e: (F.size(e) > 0) & ~F.startswith(e[0], F.lit("missing_"))))
    return [
        F.count("*").alias("total_validated"), F.count_if("is_valid").alias("valid"), F.count_if(F.col("error").isNull() & ~F.col("is_valid")).alias("invalid"),
        F.count_if(F.col("error") == "no_json").alias("no_json"), F.count_if(F.col("error").isNotNull() & (F.col("error") != "no_json")).alias("invalid_json_structure"),
        F.sum(bad_items).alias("invalid_annotation_fields"), percent(F.count_if("is_valid"), F.count("*")).alias("validation_rate"),
    ]


def validation_stats(validated: DataFrame) -> DataFrame:
    return validated.agg(*validation_metrics())


def run_metrics(seconds: float, tokens: int = 0) -> list[Column]:
    """Totals of a run with its time, as aggregates over its records."""
    n = F.count("*")
    return [
        n.alias("total_tweets"), F.count_if("is_valid").alias("successful"), F.count_if(~F.col("is_valid")).alias("failed"),
        percent(F.count_if("is_valid"), n).alias("success_rate"), F.lit(float(seconds)).alias("total_time"),
        F.coalesce(F.try_divide(F.lit(float(seconds)), n), F.lit(0.0)).alias("seconds_per_tweet"), F.lit(tokens).alias("total_tokens"),
        F.coalesce(F.try_divide(F.lit(float(tokens)), F.lit(float(seconds))), F.lit(0.0)).alias("tokens_per_second"),
    ]


def run_summary(validated: DataFrame, seconds: float, tokens: int = 0) -> DataFrame:
    return validated.agg(*run_metrics(seconds, tokens))
