"""Session settings for the engine; all of them can be overridden."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "1000",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "threadloom", **conf: str) -> SparkSession:
    """A session with DEFAULTS, then ``conf`` (dots as double underscores) on top."""
    chosen = DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=chosen).getOrCreate()
