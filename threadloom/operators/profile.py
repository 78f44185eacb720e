"""Corpus profiles: each is one aggregation, or two where shares or sizes need it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), 6)


def value_counts(df: DataFrame, column: str, with_null: bool = False) -> DataFrame:
    """(value, n, percent); nulls are left out unless asked for. Shares come from a one-row total, not a window over all."""
    rows = df if with_null else df.where(F.col(column).isNotNull())
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", percent(F.col("n"), F.col("total")).alias("percent"))


def class_imbalance(df: DataFrame, column: str) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    ratio = F.round(F.max("n") / F.min("n"), 6)
    return counts.agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"), ratio.alias("ratio"), (F.max("n") / F.min("n") > 3).alias("imbalanced"))


def _text_measures() -> list[Column]:
    n, words = F.length("text"), X.word_count(F.col("text"))
    return [
        F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_length"), F.median(n).alias("median_length"), F.min(n).alias("min_length"),
        F.max(n).alias("max_length"), F.round(F.avg(words), 6).alias("mean_words"), F.median(words).alias("median_words"),
    ]


def text_stats(df: DataFrame) -> DataFrame:
    return df.where("text IS NOT NULL").agg(*_text_measures())


def text_stats_by(df: DataFrame, column: str) -> DataFrame:
    """By class as the data spells it (the classes present, lower case)."""
    rows = df.where(f"text IS NOT NULL AND `{column}` IS NOT NULL")
    return rows.groupBy(column).agg(F.round(F.avg(F.length("text")), 6).alias("mean_length"), F.round(F.avg(X.word_count(F.col("text"))), 6).alias("mean_words"))


def _url_measures() -> list[Column]:
    n = F.size(U.extract_urls(F.col("text")))
    return [
        F.count_if(n > 0).alias("with_url"), percent(F.count_if(n > 0), F.count("*")).alias("percent"), F.sum(n).alias("n_urls"),
        F.round(F.avg(n), 6).alias("per_text"),
    ]


def url_stats(df: DataFrame) -> DataFrame:
    return df.where("text IS NOT NULL").agg(*_url_measures())


def url_stats_by(df: DataFrame, column: str) -> DataFrame:
    return df.where(f"text IS NOT NULL AND `{column}` IS NOT NULL").groupBy(column).agg(*_url_measures())


def top_domains(df: DataFrame, text: str = "text", k: int = 20) -> DataFrame:
    """The k most frequent domains as written; ties by name."""
    domains = df.select(F.explode(U.extract_urls(F.col(text))).alias("url")).select(U.raw_domain(F.col("url")).alias("domain")).where("domain <> ''")
    return domains.groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(k)


def special_chars(df: DataFrame) -> DataFrame:
    t, kinds = F.col("text"), {"mention": X.has_mention, "hashtag": X.has_hashtag, "emoji": X.has_emoji}
    counts = [F.count_if(f(t)).alias(f"n_{k}") for k, f in kinds.items()]
    return df.where("text IS NOT NULL").agg(F.count("*").alias("n"), *counts, *[percent(F.count_if(f(t)), F.count("*")).alias(f"percent_{k}") for k, f in kinds.items()])


def thread_stats(threads: DataFrame) -> DataFrame:
    """Top-level and reply counts (a missing id is a reply) and the sizes of conversations."""
    top = F.coalesce(F.col("tweet_id") == F.col("conversation_id"), F.lit(False))
    sizes = threads.groupBy("conversation_id").agg(F.count("*").alias("size"), F.count_if(top).alias("top"))
    known = F.col("conversation_id").isNotNull()
    size = F.when(known, F.col("size"))
    return sizes.agg(
        F.sum("top").alias("top_level"), F.sum(F.col("size") - F.col("top")).alias("replies"), F.count_if(known).alias("conversations"),
        F.round(F.avg(size), 6).alias("mean_size"), F.median(size).alias("median_size"), F.max(size).alias("max_size"),
    )


def problem_rows(df: DataFrame) -> DataFrame:
    """Counts of problem texts, which may overlap, their sum and its share of the texts."""
    t = F.col("text")
    checks = {
        "missing": t.isNull(), "very_short": F.length(t) < 5, "very_long": F.length(t) > 500,
        "only_url": t.rlike(r"(?U)\A\s*https?://.*\s*\z"), "only_mention": t.rlike(r"(?U)\A\s*@\w+\s*\z"),
    }
    counts = [F.count_if(c).alias(k) for k, c in checks.items()]
    total = sum((F.count_if(c) for c in checks.values()), F.lit(0))
    return df.agg(*counts, total.alias("total"), percent(total, F.count("*")).alias("percent"))


def preprocess_metrics() -> list[Column]:
    """Counters of a preprocessing run, as aggregates over its records; urls_found counts records with a URL."""
    reason = F.col("validation_reason")
    return [
        F.count("*").alias("total_processed"), *[F.count_if(reason == r).alias(a) for r, a in (("valid", "cleaned"), ("too_short", "too_short"), ("too_long", "too_long"), ("missing_text", "missing_text"))],
        F.count_if("has_urls").alias("urls_found"), F.count_if(X.has_mention(F.col("text_cleaned"))).alias("mentions_found"), F.count_if(F.col("hashtag_count") > 0).alias("hashtags_found"),
        percent(F.count_if(reason == "valid"), F.count("*")).alias("percent_cleaned"),
    ]


def preprocess_counters(records: DataFrame) -> DataFrame:
    """Counters of a preprocessing run from its records."""
    return records.agg(*preprocess_metrics())


def url_types(records: DataFrame) -> DataFrame:
    return X.url_rows(records).groupBy("type").agg(F.count("*").alias("n"))


def valid_by_class(records: DataFrame) -> DataFrame:
    return records.where("is_valid").groupBy("taco_class").agg(F.count("*").alias("n"))


def sample_quality(sample: DataFrame, full: DataFrame, label: str = "taco_class") -> DataFrame:
    """Class shares, lengths and URL share of a sample beside the full data: (measure, sample, full)."""

    def measures(df: DataFrame, name: str) -> DataFrame:
        total = df.agg(F.count("*").alias("t"))
        shares = df.groupBy(label).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select(F.concat(F.lit("class:"), label).alias("measure"), percent(F.col("n"), F.col("t")).alias(name))
        one = df.agg(F.round(F.avg(F.length("text")), 6).alias("a"), F.median(F.length("text")).alias("m"), percent(F.count_if(F.size(U.extract_urls(F.col("text"))) > 0), F.count("*")).alias("u"))
        return shares.unionByName(one.select(F.expr(f"stack(3, 'mean_length', a, 'median_length', m, 'url_percent', u) AS (measure, {name})")))

    return measures(full, "full").join(measures(sample, "sample"), "measure", "left").select("measure", "sample", "full")
