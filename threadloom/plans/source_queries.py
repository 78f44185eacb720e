"""Queries that write with each sink, read back with each source, and return what came back."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import features, graph, perspectives, profile, relational, sampling
from ..scratch import Scratch
from ..sources import tables
from ..streaming import annotation
from . import fixtures as T
from .registry import query


@query("votes", "SELECT tweet_id, taco_class AS class, CASE WHEN doc_id % 3 = 0 THEN 'NA' WHEN doc_id % 3 = 1 THEN 'none' END AS topic, confidence FROM votes")
def q_csv_round_trip(spark, sf_dir):
    """Ids stay strings and only the empty string is null: NA and none are values."""
    out = f"{Scratch(spark, 'csv').root}/votes"
    topic = F.when(F.col("doc_id") % 3 == 0, "NA").when(F.col("doc_id") % 3 == 1, "none")
    tables.write_csv(T.votes(spark, sf_dir).select("tweet_id", F.col("taco_class").alias("class"), topic.alias("topic"), "confidence"), out)
    return tables.read_csv(spark, out, tables.VOTES)


@query("votes tweets", """SELECT tweet_id, md5('He said "' || replace(text, chr(13), ' ') || '",' || chr(10) || 'then left' ) AS digest FROM tweets""")
def q_csv_multi_line(spark, sf_dir):
    out = f"{Scratch(spark, 'csv').root}/tweets"
    text = F.concat(F.lit('He said "'), F.replace("text", F.lit("\r"), F.lit(" ")), F.lit('",\nthen left'))
    tables.write_csv(T.tweets(spark, sf_dir).select("tweet_id", text.alias("text")), out)
    return tables.read_csv(spark, out, tables.TWEETS, multi_line=True).select("tweet_id", F.md5("text").alias("digest"))


@query("votes threads", "SELECT v.tweet_id, v.taco_class AS class, t.conversation_id FROM votes v JOIN threads t ON v.tweet_id = t.tweet_id")
def q_csv_keyed(spark, sf_dir):
    """Two CSV tables that are joined by the ids they are keyed by."""
    scratch = Scratch(spark, "csv")
    tables.write_csv(T.votes(spark, sf_dir).select("tweet_id", F.col("taco_class").alias("class"), F.lit("x").alias("topic"), "confidence"), f"{scratch.root}/votes")
    tables.write_csv(T.threads(spark, sf_dir).select("tweet_id", "conversation_id", "parent_id"), f"{scratch.root}/threads")
    votes = tables.read_csv(spark, f"{scratch.root}/votes", tables.VOTES).select("tweet_id", "class")
    return votes.join(tables.read_csv(spark, f"{scratch.root}/threads", tables.CONVERSATIONS).select("tweet_id", "conversation_id"), "tweet_id")


@query("annotations", "SELECT tweet_id, label, confidence, 'text of ' || id AS evidence FROM annotations")
def q_json_annotations(spark, sf_dir):
    """Documents with a map-shaped member, one per tenth of the ids and a file each, read as rows of its keys."""
    out = f"{Scratch(spark, 'json').root}/annotations"
    item = F.struct("label", F.concat(F.lit("text of "), "id").alias("evidence_span"), "confidence", F.lit("because").alias("rationale"))
    one = T.annotations(spark, sf_dir).groupBy("tweet_id").agg(F.collect_list(item).alias("items"))
    documents = one.groupBy((F.crc32("tweet_id") % 10).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("tweet_id", "items")))).alias("value"))
    documents.withColumn("value", F.concat(F.lit('{"run": [1, 2], "annotations": '), "value", F.lit("}"))).write.partitionBy("part").mode("overwrite").text(out)
    rows = tables.read_annotations(spark, out, "annotations")
    found = rows.select("tweet_id", F.inline("annotations"))
    return found.select("tweet_id", "label", "confidence", F.col("evidence_span").alias("evidence"))


@query("votes tweets", "SELECT CASE WHEN taco_class IS NULL THEN 'failed' ELSE 'annotations' END AS part, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, TRUE IN (SELECT taco_class IS NULL FROM tweets) AS any_failed FROM tweets GROUP BY 1")
def q_failed_records(spark, sf_dir):
    """Results and, since some failed, a second folder with the failed ones."""
    out = f"{Scratch(spark, 'outcome').root}/run"
    failed = tables.write_outcome(T.tweets(spark, sf_dir).select("tweet_id", "text", F.when(F.col("taco_class").isNotNull(), True).alias("is_valid")), out)
    names = ["annotations", "failed"] if failed else ["annotations"]
    parts = [spark.read.schema("tweet_id string, text string").json(f"{out}/{p}").withColumn("part", F.lit(p)) for p in names]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).withColumn("any_failed", F.lit(failed))


@query("votes", "SELECT taco_class, count(*) AS n FROM votes GROUP BY 1")
def q_json_document(spark, sf_dir):
    """One document that holds all counts, spread over lines, read whole."""
    out = f"{Scratch(spark, 'json').root}/statistics"
    counts = T.votes(spark, sf_dir).groupBy("taco_class").agg(F.count("*").alias("n"))  # a row a class
    counts.agg(F.to_json(F.struct(F.collect_list(F.struct("taco_class", "n")).alias("classes")), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(out)
    return tables.read_documents(spark, out, "classes array<struct<taco_class:string,n:long>>").select(F.inline("classes"))


@query("vectors", "SELECT id, len(vector) AS width, round(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM vectors", ints="width")
def q_vector_store(spark, sf_dir):
    out = f"{Scratch(spark, 'vectors').root}/fold"
    tables.write_vectors(T.vectors(spark, sf_dir), out)
    back = tables.read_vectors(spark, out)
    return back.select("id", F.size("vector").alias("width"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query("votes threads", """, x AS (SELECT tweet_id, row_number() OVER (ORDER BY tweet_id) - 1 AS idx FROM threads), e AS (SELECT a.idx AS src_idx, b.idx AS dst_idx FROM threads t JOIN x a ON a.tweet_id = t.parent_id JOIN x b ON b.tweet_id = t.tweet_id)
    SELECT CAST(f AS INT) AS fold, count(*) AS edges, CAST(sum(src_idx) AS BIGINT) AS src_total, CAST(sum(dst_idx) AS BIGINT) AS dst_total, (SELECT count(*) FROM x WHERE idx % 3 <> f) AS train, (SELECT count(*) FROM x WHERE idx % 3 = f) AS test FROM e, range(3) r(f) GROUP BY f""")
def q_graph_store(spark, sf_dir):
    """Graphs of three folds, written by fold and read again, with masks from the fold."""
    out = f"{Scratch(spark, 'graphs').root}/graphs"
    rows = T.threads(spark, sf_dir)
    index = graph.vertex_index(rows.select("tweet_id"))
    of = lambda name: index.select(F.col("tweet_id").alias(name), F.col("idx").alias(f"{name}_idx"))
    links = rows.select(F.col("parent_id").alias("src"), F.col("tweet_id").alias("dst")).join(of("src"), "src").join(of("dst"), "dst").select("src_idx", "dst_idx")
    folded = index.withColumn("fold", (F.col("idx") % 3).cast("int"))
    parts = [sampling.fold_masks(folded, k).withColumn("fold", F.lit(k)) for k in range(3)]
    vertices = parts[0].unionByName(parts[1]).unionByName(parts[2])
    tables.write_graph(vertices, links.withColumn("fold", F.explode(F.array(*map(F.lit, range(3))))), out)
    vertices, edges = tables.read_graph(spark, out)
    masks = vertices.groupBy("fold").agg(F.count_if("train_mask").alias("train"), F.count_if("test_mask").alias("test"))
    sums = edges.groupBy("fold").agg(F.count("*").alias("edges"), F.sum("src_idx").alias("src_total"), F.sum("dst_idx").alias("dst_total"))
    return sums.join(masks, "fold")


@query("votes", "SELECT c AS name, c NOT IN (SELECT taco_class FROM votes) AS missing FROM (VALUES ('reason'), ('statement'), ('notification'), ('none'), ('undecided')) t(c)")
def q_missing_inputs(spark, sf_dir):
    """Of the folders that a table written by class should have, those that aren't there."""
    out, names = f"{Scratch(spark, 'by-class').root}/votes", [*features.CLASS_IDS, "undecided"]
    T.votes(spark, sf_dir).write.partitionBy("taco_class").parquet(out)
    lost = tables.missing_inputs(spark, [f"{out}/taco_class={n}" for n in names])
    return spark.createDataFrame([(n, f"{out}/taco_class={n}" in lost) for n in names], "name string, missing boolean")


@query("votes", "SELECT taco_class, count(*) AS n, 'pass2_' || taco_class || '_test_20250101_000000.json' AS name FROM votes GROUP BY 1")
def q_output_name(spark, sf_dir):
    """Each class's rows written under a name made for it, and read again."""
    root, rows = Scratch(spark, "named").root, T.votes(spark, sf_dir)
    parts = []
    for label in features.CLASS_IDS:
        name = tables.output_name(label, "test", "20250101_000000", 2)
        tables.write_json(rows.where(F.col("taco_class") == label), f"{root}/{name}")
        back = spark.read.schema("taco_class string").json(f"{root}/{name}").groupBy("taco_class").agg(F.count("*").alias("n"))
        parts.append(back.withColumn("name", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("votes tweets", "SELECT tweet_id, right(tweet_id, 1) <> '9' AS is_valid, CASE WHEN right(tweet_id, 1) = '9' THEN 'parse_error' END AS error FROM tweets WHERE text IS NOT NULL")
def q_annotation_stream(spark, sf_dir):
    """A run that is stopped after its first batch and started again."""
    root = Scratch(spark, "annotation-stream").root
    T.tweets(spark, sf_dir).where("text IS NOT NULL").select("tweet_id", "text").repartition(4, "tweet_id").write.parquet(f"{root}/records")

    def stop(number):
        raise InterruptedError("stopped")

    from .model_queries import _unsteady

    try:
        annotation.start(spark, f"{root}/records", f"{root}/run", _unsteady, after=stop).awaitTermination()
    except StreamingQueryException as error:
        if "stopped" not in str(error):
            raise
    annotation.start(spark, f"{root}/records", f"{root}/run", _unsteady, files=2).awaitTermination()
    return annotation.results(spark, f"{root}/run").select("tweet_id", "is_valid", "error")


@query("votes tweets", "SELECT tweet_id, CAST(CASE taco_class WHEN 'reason' THEN 0 WHEN 'statement' THEN 1 WHEN 'notification' THEN 2 WHEN 'none' THEN 3 END AS INT) AS y, CASE topic WHEN 'src1' THEN 'first' ELSE topic END AS topic FROM tweets")
def q_class_map(spark, sf_dir):
    rows = T.tweets(spark, sf_dir)
    return rows.select("tweet_id", features.class_id(F.col("taco_class")).alias("y"), relational.replaced(F.col("topic"), {"src1": "first"}).alias("topic"))


@query("votes tweets", "SELECT tweet_id, taco_class FROM tweets WHERE confidence >= 0.05 AND coalesce(taco_class, '') NOT IN ('undecided', '') AND length(text) BETWEEN 5 AND 500")
def q_selected_rows(spark, sf_dir):
    """Valid rows of a decided class (here also of some confidence)."""
    records = T.tweets(spark, sf_dir).withColumn("is_valid", (F.col("confidence") >= 0.05) & X.validate_length(F.col("text"))["is_valid"])
    return sampling.select_rows(records).where("taco_class IS NOT NULL").select("tweet_id", "taco_class")


@query("votes tweets", "SELECT (SELECT count(*) FROM tweets) > 0 AS same, (SELECT max(n) FROM (SELECT count(*) AS n FROM tweets GROUP BY tweet_id)) > 1 AS same_without_one, (SELECT count(*) FROM votes) = (SELECT count(*) FROM tweets) AS voted")
def q_same_ids(spark, sf_dir):
    rows = T.tweets(spark, sf_dir).select("tweet_id")
    least = rows.agg(F.min("tweet_id")).first()[0]
    answers = (relational.same_ids(rows, rows.orderBy(F.desc("tweet_id"))), relational.same_ids(rows, rows.where(F.col("tweet_id") != least)), relational.same_ids(rows, T.votes(spark, sf_dir)))
    return spark.createDataFrame([answers], "same boolean, same_without_one boolean, voted boolean")


@query("vectors predictions", "SELECT v.id, p.y_true, round(CAST(v.vector[1] AS DOUBLE), 5) AS first, round(CAST(v.vector[64] AS DOUBLE), 5) AS last FROM predictions p JOIN vectors v ON v.id = p.id")
def q_aligned(spark, sf_dir):
    """Rows with their vectors; a row without one would be an error, so only rows that have one are asked for."""
    known = T.vectors(spark, sf_dir)
    rows = relational.align(T.predictions(spark, sf_dir).join(known.select("id"), "id", "left_semi"), known.select("id", "vector"))
    return rows.select("id", "y_true", F.round(F.col("vector")[0].cast("double"), 5).alias("first"), F.round(F.col("vector")[63].cast("double"), 5).alias("last"))


@query("votes tweets", "SELECT tweet_id, CAST(row_number() OVER (ORDER BY CAST(tweet_id AS BIGINT)) - 1 AS BIGINT) AS place FROM tweets")
def q_numeric_order(spark, sf_dir):
    """The place of each id in numeric order (9 before 10), from ranges."""
    rows = T.tweets(spark, sf_dir).select("tweet_id", F.col("tweet_id").cast("long").alias("number"))
    return graph.numeric_order(graph.vertex_index(rows, "number", 2000)).select("tweet_id", F.col("idx").cast("long").alias("place"))


@query("votes tweets", "SELECT taco_class AS value, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM tweets), 6) AS percent FROM tweets GROUP BY 1")
def q_value_counts_with_null(spark, sf_dir):
    return profile.value_counts(T.tweets(spark, sf_dir), "taco_class", with_null=True)


@query("votes tweets", "SELECT count(*) AS num_nodes, array_to_string(list_sort(list(DISTINCT topic)), ' ') AS topics, 'a b' AS columns, 3 AS none_id FROM tweets", ints="none_id")
def q_graph_metadata(spark, sf_dir):
    one = graph.graph_metadata(T.tweets(spark, sf_dir), ["a", "b"], features.CLASS_IDS)
    return one.select("num_nodes", F.array_join("topics", " ").alias("topics"), F.array_join("feature_columns", " ").alias("columns"), F.col("label_map")["none"].alias("none_id"))


@query("annotations", "SELECT count(*) AS total_tweets, count(*) FILTER (WHERE confidence < 0.5) AS successful, count(*) FILTER (WHERE NOT confidence < 0.5) AS failed, round(count(*) FILTER (WHERE confidence < 0.5) * 100.0::DOUBLE / count(*), 6) AS success_rate, 120.0::DOUBLE AS total_time, round(120.0::DOUBLE / count(*), 9) AS seconds_per_tweet, 6000 AS total_tokens, 50.0::DOUBLE AS tokens_per_second FROM annotations", ints="total_tokens")
def q_run_summary(spark, sf_dir):
    done = T.annotations(spark, sf_dir).withColumn("is_valid", F.col("confidence") < 0.5)
    counted = tables.write_counted(done, f"{Scratch(spark, 'counters').root}/run", perspectives.run_metrics(120.0, 6000))
    return counted.withColumn("seconds_per_tweet", F.round("seconds_per_tweet", 9))
