"""The three end-to-end flows: profile and preprocess, annotate and aggregate, build graphs by fold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..functions.annotations import LABEL_COLUMNS
from ..operators import annotate, features, graph, perspectives, profile, relational, sampling
from ..scratch import Scratch
from ..sources.tables import write_graph, write_json


def profile_corpus(votes: DataFrame, backup: DataFrame, threads: DataFrame, out: str) -> DataFrame:
    """Writes the merged tweets, every profile and the preprocessed records below ``out``; returns the records.

    votes: tweet_id, class, topic, confidence; backup: tweet_id, text; threads: tweet_id, conversation_id, parent_id.
    """
    scratch = Scratch(votes.sparkSession, "profile")
    merged = relational.merge_tweets(votes, backup, threads).withColumn("class", relational.normalise_class(F.col("class")))
    merged = scratch.write(merged, "merged")
    merged.write.mode("overwrite").parquet(f"{out}/merged")
    reports = {
        "class_counts": profile.value_counts(merged, "class"), "topic_counts": profile.value_counts(merged, "topic", with_null=True), "imbalance": profile.class_imbalance(merged, "class"),
        "text": profile.text_stats(merged), "text_by_class": profile.text_stats_by(merged, "class"), "urls": profile.url_stats(merged), "urls_by_class": profile.url_stats_by(merged, "class"),
        "domains": profile.top_domains(merged), "special": profile.special_chars(merged), "threads": profile.thread_stats(merged), "problems": profile.problem_rows(merged),
    }
    for name, report in reports.items():
        write_json(report.coalesce(1), f"{out}/statistics/{name}")
    records = scratch.write(X.preprocess(merged.withColumnRenamed("class", "taco_class")), "records")
    records.write.mode("overwrite").parquet(f"{out}/records")
    write_json(url_documents(records), f"{out}/url_metadata")
    write_json(profile.preprocess_counters(records).coalesce(1), f"{out}/statistics/preprocessing")
    return records


def url_documents(records: DataFrame) -> DataFrame:
    """The URL metadata of each record that has URLs."""
    return records.where("has_urls").select("tweet_id", "taco_class", "topic", F.col("text_cleaned").alias("text"), "url_count", F.col("url_metadata").alias("urls"))


def annotate_corpus(records: DataFrame, make_backend: Callable[[], annotate.Backend], test_mode: bool = False, threshold: float = perspectives.THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(validated answers, features of every selected tweet) of the preprocessed records."""
    chosen = sampling.select_rows(records, test_mode).select("tweet_id", F.col("text_cleaned").alias("text"), "taco_class", "topic")
    done = annotate.run(chosen, make_backend)
    rows = done.where("is_valid").select("tweet_id", F.explode("annotations").alias("a")).select("tweet_id", "a.label", "a.confidence")
    return done, perspectives.enrich(chosen, rows, threshold)


def node_table(merged: DataFrame, enriched: DataFrame, vectors: DataFrame, folds: int = 10) -> DataFrame:
    """(idx, id, x, y, fold, conversation_id, parent_id, vector) of the decided tweets that have features; a missing vector is an error.

    x is [embedding, six perspectives, topic one-hot, scaled depth, confidence].
    """
    joined = relational.join_features(merged.withColumnRenamed("class", "taco_class"), enriched.drop("text", "taco_class"))
    kept = joined.where(relational.not_equal(F.col("taco_class"), "undecided"))
    kept = graph.vertex_index(relational.category_codes(kept, "topic"))
    depth = graph.max_scaled(graph.reply_depth(kept.select("tweet_id", "conversation_id", "parent_id")), "depth").select("tweet_id", "depth_scaled")
    rows = kept.join(depth, "tweet_id").withColumn("y", features.class_id(F.col("taco_class")))
    rows = relational.align(sampling.stratified_folds(rows, folds, "tweet_id", "y").withColumnRenamed("tweet_id", "id"), vectors)
    x = features.assemble(
        F.col("vector"), F.array(*[F.col(c) for c in LABEL_COLUMNS]), V.one_hot(F.col("topic_code"), F.col("n_codes")), features.scalar(F.col("depth_scaled")), features.scalar(F.col("confidence"))
    )
    return rows.select("idx", "id", x.alias("x"), "y", "fold", "conversation_id", "parent_id", "vector")


def build_graphs(nodes: DataFrame, out: str, folds: int = 10, k: int = 3, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Writes the inference graph of each fold (all nodes, masks) and its edges; returns both tables.

    Reply, conversation and similarity edges don't depend on the fold, so they are built once; the training graph of a fold
    is ``graph.induced_subgraph`` of its vertices.
    """
    scratch = Scratch(nodes.sparkSession, "graphs")
    nodes = scratch.write(nodes, "nodes")
    threads = nodes.select(F.col("id").alias("tweet_id"), "conversation_id", "parent_id")
    edges = scratch.write(graph.all_edges(threads, nodes.select("id", "vector"), k, threshold), "edges")
    of = nodes.select("id", "idx")
    indexed = edges.join(of.withColumnsRenamed({"id": "src", "idx": "src_idx"}), "src").join(of.withColumnsRenamed({"id": "dst", "idx": "dst_idx"}), "dst")
    every = nodes.sparkSession.range(folds).select(F.col("id").cast("int").alias("f"))
    vertices = nodes.crossJoin(F.broadcast(every))  # a row per node and fold, as the original writes one graph a fold
    vertices = vertices.select("idx", "id", "x", "y", (F.col("fold") != F.col("f")).alias("is_train"), (F.col("fold") == F.col("f")).alias("is_test"), F.col("f").alias("fold"))
    edges = indexed.select("src_idx", "dst_idx", "kind", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    write_graph(vertices, edges, out)
    return vertices, edges
