"""Joins on keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys with over 1 / PARTS of all rows are hot; there are fewer than PARTS of them, whatever the size.
PARTS = 512


def split_join(rows: DataFrame, side: DataFrame, on: str | list[str], total: int, count: str = "k", how: str = "inner", parts: int = PARTS) -> DataFrame:
    """``rows`` joined with ``side``, which has one row a key and in column ``count`` how many of the ``total`` rows have it.

    Hot keys' rows of ``side`` are broadcast, at most ``parts`` of them, so the rows that have them stay where they are;
    the others are joined as usual. Both tables are read twice, so they should be written ones; ``how`` is inner, left or left_semi.
    ``count`` isn't in the result.
    """
    on = [on] if isinstance(on, str) else on
    limit = max(1, total // parts)
    hot = F.broadcast(side.where(F.col(count) > limit).drop(count))
    usual = side.where(F.col(count) <= limit).drop(count)
    keep = rows.join(hot.select(on), on, "left_anti")
    return rows.join(hot, on, "left_semi" if how == "left_semi" else "inner").unionByName(keep.join(usual, on, how))


def hot_keys(rows: DataFrame, column: str, total: int | None = None, parts: int = PARTS) -> list:
    """The values of a column that over 1 / ``parts`` of all rows have, so fewer than ``parts``; nulls are not among them."""
    limit = max(1, (rows.count() if total is None else total) // parts)
    often = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__k")).where(F.col("__k") > limit)
    return sorted(r[0] for r in often.select(column).collect())


def hot_join(rows: DataFrame, side: DataFrame, on: str, hot: list, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, which has one row a key: hot keys' rows stay where they are, and so do those without a key.

    ``hot`` are the keys of ``hot_keys``; their rows of ``side`` are broadcast. ``how`` is inner, left or left_semi.
    """
    null = rows.where(F.col(on).isNull()) if how == "left" else None
    known = rows.where(F.col(on).isNotNull())
    if hot:
        is_hot = F.col(on).isin(hot)
        out = known.where(is_hot).join(F.broadcast(side.where(is_hot)), on, how).unionByName(known.where(~is_hot).join(side.where(~is_hot), on, how))
    else:
        out = known.join(side, on, how)
    return out if null is None else out.unionByName(null, allowMissingColumns=True)


def salted_join(rows: DataFrame, side: DataFrame, on: list[str], parts: int = PARTS) -> DataFrame:
    """``rows`` joined with ``side``, of which a key may have any number of rows on either side.

    A key that over 1 / ``parts`` of ``rows`` have is hot. Its rows are dealt by their hash over as many groups as it has such shares, at
    most ``parts``, and its rows of ``side`` go to each of these; of all other keys there is one group. Both tables are read twice, so they should be
    written ones.
    """
    counts = rows.groupBy(*on).agg(F.count("*").alias("__k"))
    total = rows.count()
    limit = max(1, total // parts)
    hot = counts.where(F.col("__k") > limit).select(*on, F.ceil(F.col("__k") / limit).cast("int").alias("__groups"))  # fewer than ``parts`` rows
    hot = [r.asDict() for r in hot.collect()]
    if not hot:
        return rows.join(side, on)
    hot = rows.sparkSession.createDataFrame([tuple(r[c] for c in (*on, "__groups")) for r in hot], rows.select(*on).withColumn("__groups", F.lit(1)).schema)
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("__group", F.pmod(F.xxhash64(*rows.columns), F.coalesce("__groups", F.lit(1))).cast("int")).drop("__groups")
    sent = side.join(F.broadcast(hot), on, "left").withColumn("__group", F.explode(F.sequence(F.lit(0), F.coalesce("__groups", F.lit(1)) - 1))).drop("__groups")
    return dealt.join(sent, [*on, "__group"]).drop("__group")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
