"""Annotation as a stream that can be stopped and started again.

Records are read by file, some files a batch, with a checkpoint. A batch's answers are written to a folder of its own before anything is made of
them, and a folder that is complete is not asked for again: when a run was killed between the model's answers and the end of the
batch, the next one reads what was answered. The results of a batch replace what an earlier try at it left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import annotate, perspectives

RECORDS = "tweet_id string, text string"
_ANSWERS = "tweet_id string, text string, response string, ok boolean, seconds double"


def _complete(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def answered(batch: DataFrame, folder: str, make_backend: Callable[[], annotate.Backend], **settings) -> DataFrame:
    """The model's answers to a batch, from its folder if they are all there."""
    spark = batch.sparkSession
    if not _complete(spark, folder):
        annotate.annotate(perspectives.build_prompts(batch), make_backend, **settings).write.mode("overwrite").parquet(folder)
    return spark.read.schema(_ANSWERS).parquet(folder)


def start(spark: SparkSession, records: str, out: str, make_backend: Callable[[], annotate.Backend], files: int = 1, strict: bool = False, after: Callable[[int], None] | None = None, **settings) -> StreamingQuery:
    """Annotates the Parquet records below ``records`` that no earlier run on ``out`` has, then stops.

    Below ``out``: ``checkpoint``, ``answers/<batch>``, ``results/batch=<batch>``. ``after`` is called with a batch's number when it is written.
    """

    def one(batch: DataFrame, number: int) -> None:
        done = annotate.checked(answered(batch, f"{out}/answers/{number}", make_backend, **settings), strict)
        done.write.mode("overwrite").parquet(f"{out}/results/batch={number}")
        if after:
            after(number)

    stream = spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", files).parquet(records)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()


def results(spark: SparkSession, out: str) -> DataFrame:
    """Everything that has been annotated below ``out``, with its batch."""
    return spark.read.option("basePath", f"{out}/results").parquet(f"{out}/results").withColumn("batch", F.col("batch").cast("long"))
