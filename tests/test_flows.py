import random

from pyspark.sql import functions as F

from threadloom.operators import annotate, graph, training
from threadloom.plans import flows


def test_flows_end_to_end(spark, tmp_path):
    rng = random.Random(0)
    classes = ["Reason", "Statement", "Notification", "None", "Undecided"]
    ids = [f"{i:03d}" for i in range(80)]
    votes = spark.createDataFrame([(i, rng.choice(classes), rng.choice(["x", "y", None]), rng.random()) for i in ids], "tweet_id string, class string, topic string, confidence double")
    backup = spark.createDataFrame([(i, f"tweet number {i} says #something https://t.co/{i}") for i in ids], "tweet_id string, text string")
    threads = spark.createDataFrame([(i, f"{int(i) // 8 * 8:03d}", None if int(i) % 8 == 0 else f"{int(i) - 1:03d}") for i in ids], "tweet_id string, conversation_id string, parent_id string")
    records = flows.profile_corpus(votes, backup, threads, str(tmp_path / "profile"))
    assert records.count() == 80 and spark.read.json(str(tmp_path / "profile/statistics/urls")).first().with_url == 80
    assert spark.read.json(str(tmp_path / "profile/url_metadata")).count() == 80
    done, enriched = flows.annotate_corpus(records, annotate.fake_backend)
    decided = records.where("taco_class <> 'undecided'").count()
    assert done.where("is_valid").count() == decided == enriched.where("information_providing = 1").count()
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in ids], "id string, vector array<float>")
    merged = spark.read.parquet(str(tmp_path / "profile/merged")).drop("text")
    nodes = flows.node_table(merged, enriched, vectors, 4)
    vertices, edges = flows.build_graphs(nodes, str(tmp_path / "graphs"), 4, 3, 0.5)
    assert vertices.count() == 4 * decided and vertices.where("fold = 1 AND is_train = is_test").count() == 0
    width = {len(r.x) for r in nodes.select("x").collect()}
    assert width == {8 + 6 + 2 + 2}
    one = vertices.where("fold = 0")
    assert graph.integrity(one, edges.where("fold = 0")).first().edges_inside
    train, inner = graph.induced_subgraph(one.drop("idx"), edges.where("fold = 0").join(one.select(F.col("idx").alias("src_idx"), F.col("id").alias("src")), "src_idx").join(one.select(F.col("idx").alias("dst_idx"), F.col("id").alias("dst")), "dst_idx").select("src", "dst"))
    assert inner.where(F.greatest("src_idx", "dst_idx") >= train.count()).count() == 0
    scores = training.summary(training.cross_validate(nodes.select("id", "fold", "x", "y"), 18, 4, folds=4, hidden=4, epochs=5)).first()
    assert 0 <= scores.mean_accuracy <= 1
