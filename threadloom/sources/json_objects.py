"""Huge JSON objects in one file, read in parallel: one row a key.

The file is read as text that ends a line at every comma, which Spark splits by byte ranges like any other text. Whether a piece
begins inside a string depends on all quotes before it, and how deep it lies on all brackets before it outside of
strings: both are running sums, taken within each byte range and over the totals of the ranges before, so nothing needs
the whole file. A comma outside of strings at the wanted depth ends a record; the pieces of a record come together by its number.

A document is an object, {key: value, ...}, or such an object as a member of the outermost one. Each file holds one document; of a compressed
file, which can't be split, one task reads all. Keys come back unescaped; values as JSON text. An empty object or file has no rows; a key that
is repeated comes as often as it stands; a document without the member has no rows. Broken JSON gives rows that later parsing turns to nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..scratch import Scratch

_AT = ["file", "begin"]  # a byte range


def _without_strings(value: Column) -> Column:
    """What of a piece lies outside of strings, if it begins outside of one; escapes are gone already."""
    return F.regexp_replace(value, '"[^"]*("|$)', "")


def _brackets(value: Column) -> Column:
    opened = F.length(value) - F.length(F.translate(value, "{[", ""))
    return opened - (F.length(value) - F.length(F.translate(value, "}]", "")))


def _before(parts: DataFrame, amount: str, name: str) -> DataFrame:
    """(file, begin, name): the sum of ``amount`` over a file's byte ranges before each one; a row a range."""
    sums = parts.groupBy(*_AT).agg(F.sum(amount).alias("total"))
    earlier = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*_AT, F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias(name))


def _running(parts: DataFrame, amount: str, name: str) -> DataFrame:
    """``parts`` with the sum of ``amount`` over all pieces of the file before each one."""
    earlier = Window.partitionBy(*_AT).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    own = parts.withColumn(name, F.coalesce(F.sum(amount).over(earlier), F.lit(0)))
    return own.join(_before(parts, amount, "__earlier"), _AT).withColumn(name, F.col(name) + F.col("__earlier")).drop("__earlier")


def _unescaped(text: Column) -> Column:
    """A quoted JSON string's value."""
    return F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), F.lit(0))


def read_object(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """(file, key, value) of each key of the object in each file of ``path``, or of its member of that name."""
    scratch = Scratch(spark, "json-object")
    deep = 1 if member is None else 2
    text = spark.read.option("lineSep", ",").option("recursiveFileLookup", True).text(path)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("piece"))
    plain = F.regexp_replace("piece", r"(?s)\\.", "")
    pieces = scratch.write(pieces.withColumn("quotes", F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))), "pieces")
    told = _running(pieces, "quotes", "before")
    inside = F.col("before") % 2 == 1
    outer = _without_strings(F.when(inside, F.regexp_replace(plain, '^[^"]*("|$)', "")).otherwise(plain))
    told = told.select(*_AT, "place", "piece", _brackets(outer).cast("long").alias("delta"), ((F.col("before") + F.col("quotes")) % 2 == 0).alias("closed"))
    told = scratch.write(told, "told")
    scratch.drop("pieces")
    deeper = _running(told, "delta", "at").withColumn("end", F.col("at") + F.col("delta"))
    ends = F.when(F.col("closed") & (F.col("end") <= deep), 1).otherwise(0)
    outer_ends = F.when(F.col("closed") & (F.col("end") <= 1), 1).otherwise(0)
    deeper = scratch.write(deeper.withColumns({"ends": ends, "outer_ends": outer_ends}), "deeper")
    scratch.drop("told")
    numbered = _running(_running(deeper, "ends", "record"), "outer_ends", "member")
    held = F.array_sort(F.collect_list(F.struct("begin", "place", "piece")))
    records = numbered.groupBy("file", "member", "record").agg(F.array_join(F.transform(held, lambda x: x["piece"]), ",").alias("text"), F.min_by("at", F.struct("begin", "place")).alias("at"), F.max_by("end", F.struct("begin", "place")).alias("end"))
    if member is not None:
        records = scratch.write(records, "records")
        first = records.where(f"at < {deep}").select("file", "member", "text")
        name = _unescaped(F.regexp_extract("text", r'^\s*\{?\s*("(?:[^"\\]|\\.)*")\s*:\s*\{', 1))
        records = records.join(first.where(name == member).select("file", "member"), ["file", "member"], "left_semi")
        head = r'^\s*\{?\s*"(?:[^"\\]|\\.)*"\s*:\s*\{'
    else:
        head = r"^\s*\{"
    body = F.when(F.col("at") < deep, F.regexp_replace("text", head, "")).otherwise(F.col("text"))
    for k in (1, 2)[:deep]:  # brackets that close the object, and what holds it
        body = F.when(F.col("end") <= deep - k, F.regexp_replace(body, r"\s*\}\s*$", "")).otherwise(body)
    pair = r'^\s*("(?:[^"\\]|\\.)*")\s*:\s*'
    rows = records.select("file", body.alias("body")).where(F.col("body").rlike(r"\S"))
    return rows.select("file", _unescaped(F.regexp_extract("body", pair, 1)).alias("key"), F.regexp_replace(F.regexp_replace("body", pair, ""), r"\s+$", "").alias("value"))
