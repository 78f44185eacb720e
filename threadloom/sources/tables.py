"""Reading and writing the engine's tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json_objects import read_object

CONVERSATIONS = T.StructType([T.StructField(c, T.StringType()) for c in ("tweet_id", "conversation_id", "parent_id")])
VOTES = T.StructType([*(T.StructField(c, T.StringType()) for c in ("tweet_id", "class", "topic")), T.StructField("confidence", T.DoubleType())])
TWEETS = T.StructType([T.StructField(c, T.StringType()) for c in ("tweet_id", "text")])
ANNOTATION_LIST = "array<struct<label:string,evidence_span:string,confidence:double,rationale:string>>"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    """CSV with a header. Ids keep their type from ``schema``; only the empty string is null, so ``none`` and ``NA`` are values."""
    reader = spark.read.schema(schema).option("header", True).option("nullValue", "").option("emptyValue", "").option("enforceSchema", False)
    return reader.option("multiLine", multi_line).option("quote", '"').option("escape", '"').csv(path)


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Whole JSON documents, one a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_annotations(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """(tweet_id, annotations) of each key of a map-shaped annotation document a file, or of its member of that name; large files are shared among tasks."""
    rows = read_object(spark, path, member)
    return rows.select(F.col("key").alias("tweet_id"), F.from_json("value", ANNOTATION_LIST).alias("annotations"))


def read_vectors(spark: SparkSession, path: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return spark.read.parquet(path).select(F.col(key).alias("id"), F.col(vector).alias("vector"))


def write_vectors(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding") -> None:
    """(id, vector) rows, with 32-bit values."""
    vectors.select(F.col("id").alias(key), F.col("vector").cast("array<float>").alias(vector)).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_outcome(results: DataFrame, path: str, ok: str = "is_valid") -> bool:
    """Writes ``results`` and, in a second folder only if there are any, the failed records. Returns whether there were."""
    write_json(results.where(F.col(ok)), f"{path}/annotations")
    failed = results.where(~F.coalesce(F.col(ok), F.lit(False)))
    if failed.isEmpty():
        return False
    write_json(failed, f"{path}/failed")
    return True


def write_counted(rows: DataFrame, path: str, metrics: list[Column], mode: str = "overwrite") -> DataFrame:
    """Writes ``rows`` as JSON and returns one row of ``metrics`` (named aggregates), taken while they are written.

    The rows are computed once, for both. They are counted in the tasks that write them, of which each counts once, however often it was tried.
    """
    seen = Observation(f"counted-{uuid.uuid4().hex}")
    rows.observe(seen, *metrics).write.mode(mode).json(path)
    kind = rows.agg(*metrics).schema
    got = seen.get
    return rows.sparkSession.createDataFrame([tuple(got[f.name] for f in kind)], kind)


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Vertices and edges by fold."""
    vertices.write.mode("overwrite").partitionBy("fold").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").partitionBy("fold").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def missing_inputs(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of ``paths`` that can't be read."""
    missing = []
    for path in paths:
        try:
            spark.read.format("binaryFile").load(path).schema  # noqa: B018
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
                raise
            missing.append(path)
    return missing


def output_name(model: str, mode: str, stamp: str, number: int = 1) -> str:
    return f"pass{number}_{model}_{mode}_{stamp}.json"
