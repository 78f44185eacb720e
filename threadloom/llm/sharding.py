"""Sharding by fixed virtual slots, native DataFrame operations only.

A record's id and text hash to one of SLOTS virtual slots; bytes are summed per slot; a slot-to-shard map is made by
giving the largest slot left to the lightest shard, and kept as a versioned table. Rebalancing edits the map: slots
stay where they are as far as a shard is not over its share, only the surplus moves. The map has SLOTS rows whatever
the data, so it is built in one task and broadcast.

Law: ``bytes``. A record's size is its UTF-8 bytes plus 1, a null text has none. Records with the same id and text share a
slot up to REPEATS rows; each further REPEATS rows or so have a slot of their own, hashed from the record and the number of the chunk, so no
number of repeated rows overfills a slot, and a record's slots follow from the record and its number of rows. Ids may be null. Places within a slot
are one task's work a slot, so for tables beyond some billion rows ``slots`` should be raised with them. Texts are read whole and only
counted and hashed; other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..scratch import Scratch
from ..skew import split_join

SLOTS = 4096
REPEATS = 64
SLACK = 0.01  # of a shard's share, before a rebalance moves slots away
_OWNERS = "array<struct<slot:int,shard:int>>"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, content (a hash of id and text) and virtual_slot of each row."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("doc_id", "text").alias("content"), slot_of(F.xxhash64("doc_id", "text"), F.lit(0), slots).alias("virtual_slot"),
    )


def slot_of(content: Column, chunk: Column, slots: int = SLOTS) -> Column:
    """The slot of a record's (id and text) ``chunk``-th REPEATS rows: of the first, the record's own."""
    return F.pmod(F.when(chunk == 0, content).otherwise(F.xxhash64(content, chunk)), F.lit(slots)).cast("int")


def spread_repeats(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``rows`` (written ones) with each record's rows dealt to chunks of about REPEATS, and a slot for each chunk.

    A record's slots follow from its hash and the number of its rows alone, so they can be found again; records of up to REPEATS rows have one.
    """
    often = rows.groupBy("content").agg(F.count("*").alias("k")).where(F.col("k") > REPEATS)
    often = Scratch(rows.sparkSession, "repeats").write(often.withColumn("chunks", F.ceil(F.col("k") / REPEATS)), "often")
    marked = split_join(rows, often, "content", rows.count(), how="left")
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("chunks", F.lit(1)))
    marked = marked.withColumn("chunk", chunk)  # drawn once
    return marked.withColumn("virtual_slot", slot_of(F.col("content"), F.col("chunk"), slots)).drop("chunks", "chunk")


def slot_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("virtual_slot").alias("slot")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def _deal(pending: Column, loads: Column) -> Column:
    """Owners of the pending (bytes, slot) structs, largest first, each to the lightest shard of ``loads``."""

    def step(state: Column, x: Column) -> Column:
        lightest = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda load, i: F.when(i == lightest, load + x["bytes"]).otherwise(load)).alias("loads"),
            F.concat(state["owners"], F.array(F.struct(x["slot"].alias("slot"), lightest.alias("shard")))).cast(_OWNERS).alias("owners"),
        )

    start = F.struct(loads.cast("array<bigint>").alias("loads"), F.array().cast(_OWNERS).alias("owners"))
    return F.aggregate(F.sort_array(pending, asc=False), start, step, lambda state: state["owners"])


def build_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: version, slot, shard, bytes, rows."""
    pending = sizes.agg(F.collect_list(F.struct("bytes", "slot")).alias("pending"))
    owners = pending.select(F.explode(_deal(F.col("pending"), F.array_repeat(F.lit(0).cast("long"), shards))).alias("o")).select("o.slot", "o.shard")
    return owners.join(F.broadcast(sizes), "slot").select(F.lit(1).alias("version"), "slot", "shard", "bytes", "rows")


def rebalance(old: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version for today's ``sizes`` and number of shards; only surplus and ownerless slots move."""
    now = sizes.join(F.broadcast(old.select("slot", "shard", "version")), "slot", "left")
    share = now.agg((F.sum("bytes") / shards * (1 + SLACK)).alias("share"), F.coalesce(F.max("version"), F.lit(0)).alias("old_version"))
    run = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot").rowsBetween(Window.unboundedPreceding, 0))
    marked = now.withColumn("run", run).crossJoin(F.broadcast(share))  # one row
    marked = marked.withColumn("stays", F.coalesce((F.col("shard") < shards) & (F.col("run") <= F.col("share")), F.lit(False)))
    kept = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda i: F.aggregate(F.filter("held", lambda h: h["shard"] == i), F.lit(0).cast("long"), lambda a, h: a + h["bytes"]),
    )
    state = marked.agg(
        F.collect_list(F.when(~F.col("stays"), F.struct("bytes", "slot"))).alias("pending"),
        F.collect_list(F.when(F.col("stays"), F.struct("slot", "shard", "bytes"))).alias("held"),
        (F.max("old_version") + 1).alias("version"),
    )
    stay = F.transform("held", lambda h: F.struct(h["slot"].alias("slot"), h["shard"].alias("shard"))).cast(_OWNERS)
    owners = state.select("version", F.explode(F.concat(stay, _deal(F.col("pending"), kept))).alias("o")).select("version", "o.slot", "o.shard")
    return owners.join(F.broadcast(sizes), "slot").select("version", "slot", "shard", "bytes", "rows")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Adds a version to the table of maps."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def stored_map(spark, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, the newest by default."""
    every = spark.read.schema("slot int, shard int, bytes long, rows long, version int").parquet(path)
    wanted = F.lit(version) if version is not None else F.lit(every.agg(F.max("version")).first()[0])
    return every.where(F.col("version") == wanted).select("version", "slot", "shard", "bytes", "rows")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with shard and position (gapless from 0 in each shard, by slot and then by id)."""
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.select("version", F.col("slot").alias("virtual_slot"), "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("own", own).join(F.broadcast(offsets), "virtual_slot").withColumn("position", F.col("offset") + F.col("own") - 1)


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot (its place in the shard), grown_shard, virtual_slot, map_version."""
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.write(records(docs, slots), "records")
    rows = scratch.write(spread_repeats(rows, slots), "spread")
    store_map(build_map(slot_sizes(rows), shards), f"{scratch.root}/maps")
    placed = place(rows, stored_map(docs.sparkSession, f"{scratch.root}/maps"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )
