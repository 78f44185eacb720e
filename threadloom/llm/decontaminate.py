"""Benchmark decontamination: which documents contain (most of) a benchmark item.

Both sides become sets of hashed word shingles. Items are partitioned by the size of their set, and in each
partition an item is represented by its bottom-k MinHash sketch, where k is one more than the number of shingles
that an item of the partition's largest size may miss: a document that contains the demanded share of an item must
hold one of these k, so the search loses nothing.

Documents are read once, and never shuffled. A task holds two bitmaps of bounded size: one of all sketch keys, one of all shingles of the items.
Of a document with a shingle in the first, the shingles in the second leave as rows of two hashes. What bitmaps let through by
mistake goes in the joins: hits meet the sketch keys of each size partition, which gives candidates, documents and items that share a key;
each candidate's item is then taken shingle by shingle and looked for among the document's hits, and counting them is the exact
containment. Items are never on the driver; equal items are searched once. Joins deal hot keys (a shingle in a third of all
documents, an item in a third of them) over many tasks.

Words are runs of anything but white space and ASCII punctuation, A-Z in lower case. An item with fewer words than
a shingle is one shingle, its whole sequence, looked for among the documents' runs of that length. Null and empty
items and texts match nothing. Repeated items and documents each give their own rows. Empty tables give
empty results; of other columns ``decontaminate`` alone keeps the documents'. One very long text needs about 40 times its bytes in
a worker.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..skew import salted_join
from .arrowtext import WordHasher, runs, shingle_sets, slices
from .id_filter import bitmap_of, divided, passes

SHINGLE = 5
SHARE = 0.8
BITS_EACH = 64  # of a bitmap, so that few of the documents' shingles pass by mistake
_ROW = "__row"


def _hasher() -> WordHasher:
    return WordHasher(True, string.punctuation.encode())


def may_miss(n: np.ndarray, share: float) -> np.ndarray:
    """Shingles that a set of n may lack and still be contained by the share."""
    return n - np.ceil(share * n - 1e-9).astype(np.int64)


def partition_of(n: int) -> int:
    """The largest set size, a power of two, of the partition that a set of n is in."""
    return 1 << (n - 1).bit_length()


def sketch(shingles: np.ndarray, share: float) -> np.ndarray:
    """The least shingles of a sorted set: as many as no contained item of its partition can all miss."""
    return shingles[: int(may_miss(np.array([partition_of(len(shingles))]), share)[0]) + 1]


def _item_sets(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(item_id, length, n, digest, shingles) of each item with words, from (item_id, text)."""
        hasher = _hasher()
        for batch in batches:
            for part, data, bounds in slices(batch):
                words = hasher(data, bounds)
                ids, out = part.column(0).to_pylist(), []
                for k, own in enumerate(shingle_sets(words, size)):
                    count = int(words.first[k + 1] - words.first[k])
                    if not count:
                        continue
                    if count < size:
                        own = runs(words.hashes[words.first[k] : words.first[k + 1]], count)
                    length = min(size, count)
                    out.append((ids[k], length, len(own), xxhash.xxh3_128_digest(own.tobytes(), seed=length), own.view(np.int64)))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], ["item_id", "length", "n", "digest", "shingles"])

    return sets


def _sketches(share: float):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(length, key, size, digest) of the sketches of (length, digest, shingles) sets."""
        for batch in batches:
            found = [sketch(np.array(x, np.int64).view(np.uint64), share).view(np.int64) for x in batch.column(2).to_pylist()]
            at = np.repeat(np.arange(batch.num_rows), [len(x) for x in found])
            size = np.array([partition_of(len(x)) for x in batch.column(2).to_pylist()], np.int64)
            key = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(key), pa.array(size[at]), batch.column(1).take(pa.array(at))], ["length", "key", "size", "digest"])

    return keys


def _scanner(lengths: list[int], some: np.ndarray, every: np.ndarray):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(rid, doc_id, row, length, key) of the shingles of (rid, doc_id, row, text) rows that pass, of texts with one that may be a sketch's."""
        hasher = _hasher()
        for batch in batches:
            for part, data, bounds in slices(batch):
                words = hasher(data, bounds)
                for length in lengths:
                    hashes = runs(words.hashes, length)
                    at = np.flatnonzero(passes(every, hashes.view(np.int64) & _MASK))
                    doc = np.searchsorted(words.first, at, "right") - 1
                    at, doc = (x[at + length <= words.first[doc + 1]] for x in (at, doc))
                    found = hashes[at].view(np.int64)
                    hit = np.zeros(part.num_rows, bool)
                    hit[doc[passes(some, found & _MASK)]] = True
                    keep = hit[doc]
                    pairs = np.unique(np.stack([doc[keep], found[keep]], 1), axis=0)
                    if len(pairs):
                        rows = part.select([0, 1, 2]).take(pa.array(pairs[:, 0]))
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(pairs), length, np.int32)), pa.array(pairs[:, 1])], ["rid", "doc_id", "row", "length", "key"])

    return scan


_MASK = (1 << 28) - 1


def _bits(keys: DataFrame) -> np.ndarray:
    return bitmap_of(keys.select(F.col("key").bitwiseAND(F.lit(_MASK)).cast("int").alias("at")), keys.count(), BITS_EACH)


def text_row(text: str = "text") -> Column:
    """What tells texts apart when documents are dropped."""
    return F.xxhash64(text, F.octet_length(text))


def _found(docs: DataFrame, items: DataFrame, size: int, share: float, scratch: Scratch) -> tuple[DataFrame, DataFrame] | None:
    """((rid, doc_id, row, digest, n_shared, n) of each document row and set that it contains, (item_id, digest, ...) of the items); None without items."""
    sets = items.where("text IS NOT NULL").select("item_id", "text").mapInArrow(_item_sets(size), "item_id long, length int, n long, digest binary, shingles array<long>")
    sets = scratch.write(sets, "items")
    classes = scratch.write(sets.groupBy("digest", "length", "n").agg(F.first("shingles").alias("shingles")), "classes")
    lengths = [r.length for r in classes.select("length").distinct().orderBy("length").collect()]  # at most ``size``
    if not lengths:
        return None
    keys = scratch.write(classes.select("length", "digest", "shingles").mapInArrow(_sketches(share), "length int, key long, size long, digest binary"), "keys")
    parts = scratch.write(classes.select("length", "digest", F.explode("shingles").alias("key")), "parts")
    texts = docs.where("text IS NOT NULL").select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text_row().alias("row"), "text")
    hits = scratch.write(texts.mapInArrow(_scanner(lengths, _bits(keys), _bits(parts)), "rid long, doc_id long, row long, length int, key long"), "hits")
    # the size partitions are searched together, each with sketches of its own length
    candidates = salted_join(hits, keys, ["length", "key"]).select("rid", "doc_id", "row", "digest").distinct()
    candidates = scratch.write(candidates, "candidates")
    asked = salted_join(candidates, parts, ["digest"])
    shared = asked.join(hits.select("rid", "length", "key"), ["rid", "length", "key"], "left_semi").groupBy("rid", "doc_id", "row", "digest").agg(F.count("*").alias("n_shared"))
    known = classes.select("digest", "n")
    least = F.ceil(F.lit(share) * F.col("n") - 1e-9)
    return scratch.write(salted_join(scratch.write(shared, "shared"), known, ["digest"]).where(F.col("n_shared") >= least), "found"), sets


def find_leaks(docs: DataFrame, items: DataFrame, size: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) where at least ``share`` of an item's shingles are in a document, from docs (doc_id, text) and items (item_id, text)."""
    scratch = Scratch(docs.sparkSession, "leaks")
    found = _found(docs, items, size, share, scratch)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_shared long, n_item long, containment double")
    named = salted_join(found[0], found[1].select("digest", "item_id"), ["digest"])
    return named.select("doc_id", "item_id", "n_shared", F.col("n").alias("n_item"), (F.col("n_shared") / F.col("n")).alias("containment"))


def leaked_documents(docs: DataFrame, items: DataFrame, size: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """One row per document with leaks: doc_id, n_items, best containment, and the sorted list of item ids."""
    return find_leaks(docs, items, size, share).groupBy("doc_id").agg(
        F.countDistinct("item_id").alias("n_items"), F.max("containment").alias("containment"), F.array_sort(F.collect_set("item_id")).alias("item_ids")
    )


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """The documents without a leak, all columns. Texts that no leak may equal are filtered where they are read; copies of one leaked text stay where they are."""
    scratch = Scratch(docs.sparkSession, "clean")
    found = _found(docs, items, size, share, scratch)
    if found is None:
        return docs
    leaks = scratch.write(found[0].groupBy(F.col("row").alias(_ROW)).agg(F.count_distinct("rid").alias("k")), "leaks")
    some, none = divided(docs.withColumn(_ROW, text_row()), leaks, _ROW)
    total = max(1, leaks.agg(F.sum("k")).first()[0] or 0)
    often = leaks.where(F.col("k") > max(1, total // 512)).select(_ROW)  # fewer than 512
    rest = some.join(F.broadcast(often), _ROW, "left_anti").join(leaks.where(F.col("k") <= max(1, total // 512)).select(_ROW), _ROW, "left_anti")
    return rest.unionByName(none).select(docs.columns)
