"""Token counts with a digest cache.

Stored counts are keyed by two digests: SHA-256 of the normalised content, and SHA-256 of the tokenizer (library version
and file). Texts are joined to the stored counts; only distinct texts without one are encoded, and their counts are
appended to the cache. Normalisation only makes a null text empty, since anything more would change counts.

Copies are found on digests alone. Of each distinct miss one text is fetched, by its least id and digest; rows of one id and
text are combined where they are read, so each miss is encoded once and no group of copies is gathered; a digest of many rows is split
when counts go back to them. The cache is a folder a tokenizer, and only this batch's digests are joined with it. A filter on ids leaves out
what has no miss where it is read; the other texts travel once. Ids may be null or repeated. An
empty table gives an empty result; other columns are not looked at. One very long text needs about 40 times its bytes in
a worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..skew import split_join
from .arrowtext import slices
from .id_filter import divided
from .packing import BYTE_ALPHABET, cut_anywhere, loaded_tokenizer

_CACHE = "content string, n_tokens long, tokenizer string"


def tokenizer_digest(path: str) -> str:
    import tokenizers

    with open(path, "rb") as file:
        return hashlib.sha256(tokenizers.__version__.encode() + b"\n" + file.read()).hexdigest()


class PieceCounter:
    """Token counts of texts under a byte-level vocabulary, from remembered counts of pieces.

    The vocabulary's splitter always cuts where white space follows something else, so a piece is a run of white space
    and what follows it. Where marks stand alone, full stops and commas are pieces of their own. A blank and plain letters
    are one unit of the splitter and go straight to the vocabulary's model, in its byte alphabet; all else is encoded. Pieces
    met first tend to be the common ones, so a full memory drops its newest half.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer, self.known = loaded_tokenizer(path), {}

    def __call__(self, split: list[list[str]]) -> list[int]:
        met = set(chain.from_iterable(split))
        fresh = met - self.known.keys()
        if len(self.known) + len(fresh) > _REMEMBERED:
            for piece in list(self.known)[_REMEMBERED // 2 :]:
                del self.known[piece]
            fresh = met - self.known.keys()
        known, model, others = self.known, self.tokenizer.model, []
        for piece in fresh:
            if _PLAIN.fullmatch(piece):
                known[piece] = len(model.tokenize(piece.encode().decode("latin-1").translate(BYTE_ALPHABET)))
            else:
                others.append(piece)
        for low in range(0, len(others), 2_000):
            part = others[low : low + 2_000]
            known.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return [sum(map(known.__getitem__, pieces)) for pieces in split]


_REMEMBERED = 500_000
_PLAIN = re.compile("[ ]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PIECES = re.compile(r"\s*\S+|\s+\Z")
_FINER = re.compile(r"\s*(?:[.,]|[^\s.,]+)|\s+\Z")
_ODD = re.compile("[\x1c-\x1f\x85]")  # white space to this pattern's engine or to the vocabulary's, but not to both
_SPECIAL = "<|"


def pieces_of(text: str, anywhere: bool) -> list[str]:
    if _ODD.search(text) or _SPECIAL in text:  # a special token's string may hold or touch anything
        return [text] if text else []
    return (_FINER if anywhere else _PIECES).findall(text)


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(path)
        for batch in batches:
            for part, data, bounds in slices(batch):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                counts = counter([pieces_of(t, anywhere) for t, anywhere in zip(texts, cut_anywhere(data, bounds), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("content")), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return count


def cached_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The cache's counts of one tokenizer, whose folder alone is read; none if nothing has been stored yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    every = spark.read.schema(_CACHE).parquet(cache) if there else spark.createDataFrame([], _CACHE)
    return every.where(F.col("tokenizer") == version).select("content", "n_tokens")


def _stored(batch: DataFrame, cache: str, version: str) -> DataFrame:
    """(content, k, n_tokens) of the batch's digests that the cache knows; a digest stored twice counts once."""
    known = cached_counts(batch.sparkSession, cache, version)
    return batch.join(known, "content").groupBy("content", "k").agg(F.max("n_tokens").alias("n_tokens"))


def compact(spark: SparkSession, cache: str, to: str) -> None:
    """Writes the cache anew, each digest once and few files a tokenizer."""
    every = spark.read.schema(_CACHE).parquet(cache).groupBy("content", "tokenizer").agg(F.max("n_tokens").alias("n_tokens"))
    every.repartition("tokenizer", F.substring("content", 1, 2)).write.mode("overwrite").partitionBy("tokenizer").parquet(to)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, cache: str | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit. ``cache`` is a shared folder; without one it starts empty."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-counts")
    cache, version = cache or f"{scratch.root}/cache", tokenizer_digest(tokenizer)
    text = F.coalesce("text", F.lit("")).alias("text")
    content = F.sha2(F.coalesce("text", F.lit("")), 256).alias("content")
    keyed = scratch.write(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), content), "keyed")
    batch = scratch.write(keyed.groupBy("content").agg(F.min("doc_id").alias("id"), F.count("*").alias("k")), "batch")
    misses = batch.join(cached_counts(spark, cache, version), "content", "left_anti").select(F.col("id").alias("i"), F.col("content").alias("c"), "k")
    misses = scratch.write(misses, "misses")
    # null ids are all in the second part; the first holds only texts whose id may be a miss's
    some, none = divided(docs.select("doc_id", "text"), misses.select(F.col("i").alias("doc_id")), "doc_id")
    have = some.unionByName(none.where("doc_id IS NULL")).select(F.coalesce("doc_id", F.lit(0)).alias("a"), F.col("doc_id").isNull().alias("b"), content, text)
    once = have.groupBy("a", "b", "content").agg(F.first("text").alias("text"))  # repeated rows are combined before the shuffle, which the join shares
    wanted = misses.select(F.coalesce("i", F.lit(0)).alias("a"), F.col("i").isNull().alias("b"), F.col("c").alias("content"))
    fetched = once.join(wanted, ["a", "b", "content"], "left_semi")
    fresh = scratch.write(fetched.select("content", "text").mapInArrow(_counter(tokenizer), "content string, n_tokens long"), "fresh")
    new = fresh.groupBy("content").agg(F.max("n_tokens").alias("n_tokens")).select("content", "n_tokens", F.lit(version).alias("tokenizer"))
    new.write.mode("append").partitionBy("tokenizer").parquet(cache)
    stored = scratch.write(_stored(batch.select("content", "k"), cache, version), "stored")
    counted = split_join(keyed, stored, "content", keyed.count())
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
