"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: the files outlive a lost executor, stay
compressed and are column-pruned when they are read again.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode with nothing set."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


@contextlib.contextmanager
def _freeing(spark: SparkSession):
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Scratch:
    """Written tables of one operator call; ``drop`` removes those that later tables have replaced.

    What the result still reads stays until the driver ends. If ``freed``, the shuffle files of a write are removed when it has ended, not
    when the driver's garbage collector comes to them.
    """

    def __init__(self, spark: SparkSession, name: str, freed: bool = False) -> None:
        self.spark, self.freed = spark, freed
        self.root = f"{shared_dir(spark)}/threadloom/{name}-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def write(self, df: DataFrame, table: str) -> DataFrame:
        path = f"{self.root}/{table}"
        with _freeing(self.spark) if self.freed else contextlib.nullcontext():
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        for table in tables:
            self._delete(f"{self.root}/{table}")

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None:
            return
        try:
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may have gone already when the driver ends
            return
