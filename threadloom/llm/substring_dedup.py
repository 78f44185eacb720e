"""Removal of word passages that an earlier document already holds, with an FM-index per shard.

A window is WINDOW consecutive words. A word goes if it lies in a window that also starts in a document with a smaller
doc_id. All windows are judged on the input.

1. Anchors. Every window has an anchor, the least hash among its runs of ANCHOR words; equal windows have equal
   anchors. Neighbouring windows with one anchor form a context (its words, at most CONTEXT windows). Contexts whose
   anchor is in one document only can't hold a repeat and go.
2. Copies. Equal contexts of one anchor are combined, before the shuffle, to the least doc_id; in all other documents
   every window of such a context is a repeat. One context per text stays.
3. Index. What stays is dealt by anchor into shards of about SHARD contexts. A shard builds a compressed FM-index
   (Burrows-Wheeler transform, wavelet matrix) over its contexts, in which a symbol is a run of STRIDE words and a
   context is written once per phase, so a window is a pattern of WINDOW / STRIDE symbols. The shard's contexts are
   streamed through it: backward search narrows each window's suffix interval, windows that are alone leave at once, and
   those that match over the whole WINDOW are repeats if the interval holds a smaller doc_id. Windows so found
   are reported as intervals.
4. Hot anchors. An anchor with more than SHARD contexts (a passage that a third of all documents share) is spread over
   several shards by hash. Each shard then also hands out, once per window, the smallest document it knows; the
   minimum over shards, combined before the shuffle, settles those windows.

Joins split anchors and contexts that hold a large share of all rows. Words are hashed to 64 bits (arrowtext: no pair of words collides by
construction); windows agree if five hashes of ten words each do, contexts within one anchor by a hash of all words, windows of hot
anchors by 128 bits. Rows of one id and text are one document before anything is collected or joined. Texts that lose nothing are never shuffled. Null, empty
and short texts have no windows. Rows without a doc_id neither lose words nor take them from others. Rows of one doc_id take
nothing from each other and are judged by their own texts. One very long text needs about 60 times its bytes in a worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..skew import split_join
from .arrowtext import WordHasher, mix, runs, slices, spans
from .fm_index import FMIndex
from .id_filter import divided

WINDOW = 50
ANCHOR = 6
STRIDE = 10
CONTEXT = 64
SHARD = 2000
_SPANS = "__spans"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    have, least = 1, values
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    return np.minimum(least[: len(least) - (width - have)], least[width - have :]) if have < width else least


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher(False)
    for batch in batches:
        for part, data, bounds in slices(batch):
            words = hasher(data, bounds)
            n = len(words.hashes) - WINDOW + 1
            if n < 1:
                continue
            anchors = sliding_least(runs(words.hashes, ANCHOR), WINDOW - ANCHOR + 1)
            owner = np.repeat(np.arange(part.num_rows), np.diff(words.first))
            at = np.arange(n)
            valid = at + WINDOW <= words.first[owner[:n] + 1]
            place = at - words.first[owner[:n]]
            begins = valid.copy()
            begins[1:] &= (anchors[1:] != anchors[:-1]) | (place[1:] % CONTEXT == 0)
            start = np.flatnonzero(begins)
            stop = np.minimum(np.append(start[1:], n), words.first[owner[start] + 1] - WINDOW + 1)
            whole = spans(words.hashes, start, stop + WINDOW - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchors[start].view(np.int64)), pa.array(whole.view(np.int64)),
                    *[part.column(part.schema.get_field_index(c)).take(pa.array(owner[start])) for c in ("doc_id", "row")],
                    pa.array(place[start].astype(np.int32)), pa.array((stop - start).astype(np.int32)),
                ],
                ["anchor", "context", "doc_id", "row", "start", "n"],
            )


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each context asked for, the hashes of its runs of STRIDE words."""
    hasher, tail = WordHasher(False), WINDOW - STRIDE
    for batch in batches:
        for part, data, bounds in slices(batch):
            words = hasher(data, bounds)
            every = runs(words.hashes, STRIDE)
            ids, rows = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "row"))
            out: list[tuple] = []
            for d, asked in enumerate(part.column(part.schema.get_field_index("asked")).to_pylist()):
                low, high = int(words.first[d]), int(words.first[d + 1])
                for x in asked:
                    if low + x["start"] + x["n"] + WINDOW - 1 <= high:
                        own = every[low + x["start"] : low + x["start"] + x["n"] + tail]
                        out.append((x["shard"], x["open"], ids[d], rows[d], x["start"], x["n"], own.tobytes()))
            if out:
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["shard", "open", "doc_id", "row", "start", "n", "symbols"])


def search_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, row, start, n, window, check) of one shard: repeats as runs of n windows; open windows, if no smaller one is known here, with two hashes."""
    per, count = WINDOW // STRIDE, pdf["n"].to_numpy(np.int64)
    lengths, docs, rows = count + WINDOW - STRIDE, pdf["doc_id"].to_numpy(np.int64), pdf["row"].to_numpy(np.int64)
    hashes = np.frombuffer(b"".join(pdf["symbols"]), np.uint64)
    symbol = np.unique(hashes, return_inverse=True)[1].astype(np.int64) + 1
    context = np.repeat(np.arange(len(pdf)), lengths)
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.lexsort((place // STRIDE, place % STRIDE, context))
    phase = context[order] * STRIDE + place[order] % STRIDE
    spot = np.arange(len(order)) + (np.cumsum(np.diff(phase, prepend=phase[:1]) != 0))  # a separator after each phase
    text = np.zeros(int(spot[-1]) + 2, np.int64)
    text[spot] = symbol[order]
    where = np.empty(len(order), np.int64)
    where[order] = spot
    index = FMIndex(text, np.append(context[order][np.flatnonzero(np.diff(phase))], context[order][-1:]))

    lane = np.flatnonzero(place < count[context])  # the windows
    begin = where[lane]
    last = text[begin + per - 1]
    low, high = index.first[last], index.first[last + 1]
    live = np.flatnonzero(high - low > 1)
    for step in range(per - 2, -1, -1):
        low, high = index.extend(text[begin[live] + step], low[live], high[live]) if step == per - 2 else index.extend(text[begin[live] + step], low, high)
        going = high - low > 1
        live, low, high = live[going], low[going], high[going]
    smallest = docs[context[lane]].copy()
    if len(live):
        low, own, back = np.unique(low, return_index=True, return_inverse=True)  # intervals of one length don't overlap
        width = high[own] - low
        begin = np.cumsum(width) - width
        found = docs[index.owners(np.arange(int(width.sum())) + np.repeat(low - begin, width))]
        smallest[live] = np.minimum.reduceat(found, begin)[back.reshape(-1)]
    repeat = smallest < docs[context[lane]]
    own, at = context[lane], place[lane]
    head = repeat.copy()
    head[1:] &= ~repeat[:-1] | (own[1:] != own[:-1])
    tail = repeat.copy()
    tail[:-1] &= ~repeat[1:] | (own[1:] != own[:-1])
    head, tail = np.flatnonzero(head), np.flatnonzero(tail)
    start = pdf["start"].to_numpy(np.int64)
    none = pd.array([None] * len(head), "Int64")
    closed = pd.DataFrame({"doc_id": docs[own[head]], "row": rows[own[head]], "start": start[own[head]] + at[head], "n": at[tail] - at[head] + 1, "window": none, "check": none})
    ask = np.flatnonzero(pdf["open"].to_numpy(bool)[own] & ~repeat)
    window, check = np.zeros(len(ask), np.uint64), np.ones(len(ask), np.uint64)
    offset = np.cumsum(lengths) - lengths
    for step in range(per):
        part = hashes[offset[own[ask]] + at[ask] + step * STRIDE]
        window, check = mix(window * np.uint64(0x9E3779B97F4A7C15) + part), mix((check ^ part) * np.uint64(0xC2B2AE3D27D4EB4F))
    asked = pd.DataFrame({"doc_id": docs[own[ask]], "row": rows[own[ask]], "start": start[own[ask]] + at[ask], "n": 1, "window": pd.array(window.view(np.int64), "Int64"), "check": pd.array(check.view(np.int64), "Int64")})
    return pd.concat([closed, asked], ignore_index=True)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, which tells rows of one doc_id apart by their texts."""
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


def repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, row, start, n): from word ``start`` on, ``n`` windows that an earlier document holds."""
    texts = keyed(docs.select("doc_id", "text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    every = scratch.write(texts.mapInArrow(_contexts, "anchor long, context long, doc_id long, row long, start int, n int"), "contexts")
    ends = [F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.count("*").alias("k")]
    spread = scratch.write(every.groupBy("anchor").agg(*ends).where("x < y").select("anchor", "k"), "spread")
    # rows of one id and text have the same contexts, which count once from here on
    shared = scratch.write(split_join(every, spread, "anchor", every.count(), how="left_semi").distinct(), "shared")
    scratch.drop("contexts")
    least = scratch.write(shared.groupBy("anchor", "context").agg(F.min("doc_id").alias("least"), F.count("*").alias("k")), "least")
    placed = scratch.write(split_join(shared, least, ["anchor", "context"], shared.count()), "placed")
    scratch.drop("shared", "least")
    found_at = ["doc_id", "row", "start", "n"]
    copies = placed.where("doc_id > least").select(found_at)

    kept = placed.where("doc_id = least").select("anchor", "context", *found_at)
    counted = scratch.write(kept.groupBy("anchor").agg(*ends).where("x < y").select("anchor", "k", F.col("k").alias("members")), "counted")
    wanted = scratch.write(split_join(kept, counted, "anchor", kept.count()), "wanted")
    shards = max(1, wanted.count() // SHARD)
    salt = F.pmod(F.xxhash64("context", "start"), F.ceil(F.col("members") / SHARD).cast("long"))
    shard = F.pmod(F.xxhash64("anchor", salt), F.lit(shards))
    ask = F.struct(shard.alias("shard"), (F.col("members") > SHARD).alias("open"), "start", "n")
    asked = wanted.groupBy("doc_id", "row").agg(F.collect_list(ask).alias("asked"))  # as long as the document
    some = divided(texts.select("doc_id", "row", "text"), wanted, "doc_id")[0].groupBy("doc_id", "row").agg(F.first("text").alias("text"))
    once = some.join(asked, ["doc_id", "row"])
    symbols = once.mapInArrow(_symbols, "shard long, open boolean, doc_id long, row long, start int, n int, symbols binary")
    found = scratch.write(symbols.groupBy("shard").applyInPandas(search_shard, "doc_id long, row long, start int, n int, window long, check long"), "found")
    open_ = found.where("window IS NOT NULL")
    first = scratch.write(open_.groupBy("window", "check").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("k")).where("least < most").drop("most"), "first")
    across = split_join(open_, first, ["window", "check"], open_.count()).where("doc_id > least").select(found_at)
    return copies.union(found.where("window IS NULL").select(found_at)).union(across)


def _keep(words: list[bytes], repeats_: list[dict] | None) -> tuple[np.ndarray, int]:
    """Which words stay, and how many go."""
    change = np.zeros(len(words) + 1, np.int64)
    for x in repeats_ or ():
        if x["start"] + x["n"] + WINDOW - 1 <= len(words):
            change[x["start"]] += 1
            change[x["start"] + x["n"] + WINDOW - 1] -= 1
    gone = np.cumsum(change[:-1]) > 0
    return ~gone, int(gone.sum())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, bounds in slices(batch):
            out, raw = [], data.tobytes()
            for k, found in enumerate(part.column(_SPANS).to_pylist() if _SPANS in part.schema.names else [None] * part.num_rows):
                words, gone = raw[bounds[k] : bounds[k + 1]].split(), 0
                n = len(words)
                if found:
                    stay, gone = _keep(words, found)
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                out.append((n, gone, hashlib.sha256(b" ".join(words)).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kept words and the white space before them; texts that lose nothing are unchanged."""
    separator = WordHasher(False)
    for batch in batches:
        for part, data, bounds in slices(batch):
            words, raw, out = None, data.tobytes(), []
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            for k, found in enumerate(part.column(part.schema.get_field_index(_SPANS)).to_pylist()):
                if not found:
                    out.append((texts[k], 0, False))
                    continue
                words = words or separator(data, bounds)
                a, b = int(words.first[k]), int(words.first[k + 1])
                stay, gone = _keep([b""] * (b - a), found)
                edges = np.append(words.starts[a], words.ends[a:b])  # a word goes with the white space before it
                pieces = [raw[edges[i] : edges[i + 1]] for i in np.flatnonzero(stay).tolist()]
                out.append((b"".join(pieces).strip().decode("utf-8", "replace"), gone, gone == b - a))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string(), pa.int64(), pa.bool_()], strict=True)]
            rest = part.drop_columns(["text", _SPANS])
            yield pa.RecordBatch.from_arrays([*rest.columns, *columns], [*rest.schema.names, "text", "n_removed", "emptied"])


def _with_repeats(docs: DataFrame, scratch: Scratch, then=None, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``docs`` that may lose words, with their repeats, and those that don't, whose texts aren't shuffled (and to which ``then`` is applied)."""
    found = repeats(docs, scratch).distinct()
    spans_ = found.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_list(F.struct("start", "n")).alias(_SPANS))
    spans_ = scratch.write(spans_, "spans")
    some, none = divided(docs, spans_.select(F.col("__id").alias("doc_id")), "doc_id", then, schema)
    same = (F.col("doc_id") == F.col("__id")) & (F.xxhash64("doc_id", "text") == F.col("__row"))
    return some.join(spans_, same, "left").drop("__id", "__row"), none


def removal_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256."""
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    fields = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    some, none = _with_repeats(docs.select("doc_id", "text"), scratch, _digests, fields)
    return some.mapInArrow(_digests, fields).unionByName(none)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the cut text, then n_removed and emptied (true if every word has gone), which replace columns of these names."""
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    others = [c for c in docs.columns if c not in ("text", "n_removed", "emptied")]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    some, none = _with_repeats(docs.select(*others, "text"), scratch)
    cut = some.select(*others, "text", _SPANS).mapInArrow(_texts, f"{fields}, text string, n_removed long, emptied boolean")
    return cut.unionByName(none.select(*others, "text").withColumns({"n_removed": F.lit(0).cast("long"), "emptied": F.lit(False)}))
