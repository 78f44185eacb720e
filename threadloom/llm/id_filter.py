"""A filter on ids, so that a scan can leave out rows that a later join would drop anyway.

The filter is a bitmap of hashed ids with about BITS_EACH bits an id, MOST_BITS at most: it may let rows through that aren't
wanted, never the other way round, so the join behind it decides. It reaches the driver combined, in blocks of 4 KB, and the
workers with the function. Beyond some hundred million ids it lets most rows through; the result stays the same, and the
rows are then shuffled for the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 20, 1 << 28, 8
_BLOCK = 1 << 15  # bits of one of Spark's bitmaps


def place(id_: str) -> Column:
    """Where an id falls, in a filter of MOST_BITS; smaller ones use its lowest digits."""
    return F.pmod(F.xxhash64(id_), F.lit(MOST_BITS)).cast("int")


def bitmap(ids: DataFrame, id_: str) -> np.ndarray:
    """The filter of column ``id_``, as bytes, lowest bit first."""
    return bitmap_of(ids.select(place(id_).alias("at")), ids.agg(F.approx_count_distinct(id_)).first()[0])


def bitmap_of(places: DataFrame, count: int, bits_each: int = BITS_EACH) -> np.ndarray:
    """The filter of ``count`` places (at), each below MOST_BITS."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, bits_each * count - 1).bit_length()))
    at = places.select(F.pmod("at", F.lit(bits)).alias("at"))
    rows = at.groupBy(F.floor(F.col("at") / _BLOCK).alias("block")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(_BLOCK))).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in rows.collect():
        out[row.block * _BLOCK // 8 : (row.block + 1) * _BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def passes(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = at & (8 * len(filter_) - 1)
    return (filter_[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


_PLACE = "__place"


def _passer(filter_: np.ndarray, id_: str, wanted: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(batch.schema.get_field_index(id_)).is_valid().to_numpy(zero_copy_only=False)
            good = passes(filter_, np.asarray(batch.column(batch.num_columns - 1))) & known
            yield batch.filter(pa.array(good if wanted else ~good)).select(list(range(batch.num_columns - 1)))

    return rows


def divided(rows: DataFrame, ids: DataFrame, id_: str, then=None, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``id_`` may be among those of ``ids``, and those whose isn't; null ids are among the second.

    ``then``, a function of Arrow batches to batches of ``schema``, is applied to the second part by the same worker.
    """
    filter_, marked = bitmap(ids, id_), rows.withColumn(_PLACE, place(id_))
    others = _passer(filter_, id_, False)
    rest = marked.mapInArrow(others, rows.schema) if then is None else marked.mapInArrow(lambda batches: then(others(batches)), schema)
    return marked.mapInArrow(_passer(filter_, id_, True), rows.schema), rest
