"""The engine's tables, built from the driver's, once as DataFrames and once as the CTEs that oracle SQL starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLASS = {3: "reason", 2: "statement", 1: "notification", 0: "none"}
_EVENT_LABELS = {"view": "Information Providing", "click": "Information Seeking", "purchase": "Opinion/Belief", "signup": "AOT"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _map(pairs: dict):
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with class and confidence."""
    rows = table(spark, sf_dir, "labels")
    return rows.select("doc_id", F.col("doc_id").cast("string").alias("tweet_id"), _map(_CLASS)[F.col("quality") * 2 + F.col("toxic")].alias("taco_class"), ((F.col("doc_id") % 100) / 100.0).alias("confidence"))


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a page's URL at the end of its text; class and confidence are null where there is no vote."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    count = pages.agg(F.count("*").alias("n_pages"))  # one row
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("topic")).crossJoin(F.broadcast(count))
    docs = docs.withColumn("page_id", F.col("doc_id") % F.col("n_pages")).join(pages, "page_id", "left")
    texts = docs.select("doc_id", "topic", F.concat("text", F.lit(" "), "url").alias("text"))
    known = votes(spark, sf_dir).select("doc_id", "taco_class", "confidence")
    return texts.join(known, "doc_id", "left").select(F.col("doc_id").cast("string").alias("tweet_id"), "taco_class", "confidence", "topic", "text")


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as tweets of chains, with thread ids."""
    rows, first = table(spark, sf_dir, "conversations"), F.col("conv_id") * 100
    name = lambda c: c.cast("string")
    return rows.select(name(first + F.col("turn")).alias("tweet_id"), name(first).alias("conversation_id"), F.when(F.col("turn") > 0, name(first + F.col("turn") - 1)).alias("parent_id"), "text")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with confidence by tweet; some labels are unknown."""
    confidence = F.get_json_object("props", "$.k").cast("int") / 100.0
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("tweet_id"), F.coalesce(_map(_EVENT_LABELS)[F.col("event_type")], F.lit("unknown")).alias("label"), confidence.alias("confidence"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class numbers, true and predicted, with a fold."""
    true = 3 - (F.col("quality") * 2 + F.col("toxic"))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), true.alias("y_true"), ((true + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)) % 4).alias("y_pred"), (F.col("doc_id") % 10).cast("int").alias("fold"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_WHEN_CLASS = "CASE quality * 2 + toxic WHEN 3 THEN 'reason' WHEN 2 THEN 'statement' WHEN 1 THEN 'notification' ELSE 'none' END"
SQL = {
    "votes": f"SELECT doc_id, CAST(doc_id AS VARCHAR) AS tweet_id, {_WHEN_CLASS} AS taco_class, (doc_id % 100) / 100.0::DOUBLE AS confidence FROM labels",
    "tweets": """SELECT CAST(d.doc_id AS VARCHAR) AS tweet_id, v.taco_class, v.confidence, d.source AS topic, d.text || ' ' || p.url AS text FROM documents d
        LEFT JOIN votes v ON v.doc_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)""",
    "threads": """SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS tweet_id, CAST(conv_id * 100 AS VARCHAR) AS conversation_id,
        CASE WHEN turn > 0 THEN CAST(conv_id * 100 + turn - 1 AS VARCHAR) END AS parent_id, text FROM conversations""",
    "annotations": """SELECT event_id AS id, CAST(user_id AS VARCHAR) AS tweet_id, CASE event_type WHEN 'view' THEN 'Information Providing'
        WHEN 'click' THEN 'Information Seeking' WHEN 'purchase' THEN 'Opinion/Belief' WHEN 'signup' THEN 'AOT' ELSE 'unknown' END AS label,
        CAST(json_extract_string(props, '$.k') AS INT) / 100.0::DOUBLE AS confidence FROM events""",
    "predictions": """SELECT doc_id AS id, 3 - (quality * 2 + toxic) AS y_true, (3 - (quality * 2 + toxic) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) % 4 AS y_pred,
        CAST(doc_id % 10 AS INT) AS fold FROM labels""",
    "vectors": "SELECT vec_id AS id, embedding AS vector, label FROM embeddings",
    "counts": """SELECT label, CAST(sum(CASE WHEN hit THEN t ELSE 0 END) AS BIGINT) AS tp, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(t) AS BIGINT) AS support FROM (
        SELECT y_true AS label, y_true = y_pred AS hit, 1 AS t, 0 AS p FROM predictions UNION ALL SELECT y_pred, y_true = y_pred, 0, 1 FROM predictions) GROUP BY label""",
    "f1": """SELECT label, tp, predicted, support, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted::DOUBLE END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support::DOUBLE END AS recall,
        CASE WHEN predicted + support = 0 THEN 0 ELSE 2.0 * tp::DOUBLE / (predicted + support) END AS f1 FROM counts""",
}
_NEEDS = {"tweets": ["votes"], "f1": ["predictions", "counts"], "counts": ["predictions"]}


def with_tables(names: str, sql: str, recursive: bool = False) -> str:
    """``sql`` after the CTEs of the named tables (in blanks) and those they need."""
    order: list[str] = []
    for name in names.split():
        order += [n for n in [*_NEEDS.get(name, []), name] if n not in order]
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{sql if sql.lstrip().startswith(',') else chr(10) + sql}" if order else sql
