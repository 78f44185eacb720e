"""MinHash near-duplicates by a multi-index Hamming join, confirmed on whole shingle sets.

A document's set of word shingles gives a signature of HASHES b-bit minima (b = 16). The signature is cut into
CHUNKS chunks of six symbols. Two signatures that differ in at most RADIUS = 2 * CHUNKS - 1 symbols have, by
pigeonhole, a chunk with at most one differing symbol; every signature is therefore indexed, for each chunk, under
its six variants with one symbol left out, and no pair within the radius escapes. A pair beyond the radius is still
found if any chunk agrees; at a similarity of 0.85 no chunk does with a probability of 3e-7, at 0.8 of 2e-5.

Skew and size. Equal sets are one class from the start (hash aggregation, combined before the shuffle), so thousands
of copies cost one row. Within an index bucket members are first paired with the bucket's smallest id only; every
document's closest partner is confirmed, components are built, then the other such pairs that still cross components.
What is left are buckets that hold several components. There, all pairs across components that are not both in the
bucket's largest one are compared, each pair once and alike in buckets of every size:

* by set sizes, which bound the similarity,
* by signatures: at most ``farthest`` symbols apart, never fewer than RADIUS, which a similar pair exceeds with a probability of 1e-5,
* by occupancy: every class has a bitmap of the places that its shingles hash to. Each place that only one of two sets occupies
  holds a shingle that the other lacks, so the bitmaps bound the similarity from above. The bound is proven, and so refutes no
  similar pair; it keeps the pairs of a group of thousands of edited copies, most of them below the similarity, from becoming rows.

What passes goes to exact confirmation. A bucket is enumerated as pairs of blocks of about BLOCK members, each a group of its
own, so that tasks share a bucket of any size. No cap loses a link. Comparing within a bucket is quadratic in its
members of minor components.

Shingles are hashed to 64 bits. Empty sets link with nothing. Rows of one doc_id and one text are one document; if one doc_id
has several texts, each is judged by its own. A null doc_id is never linked: its component is null and it is kept. Ties of
distance go to the smaller id. Texts are read in slices, so one very long text needs about 30 times its bytes in a worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..scratch import Scratch
from ..skew import split_join
from .arrowtext import WordHasher, give_back, mix, shingle_sets, slices
from .id_filter import bitmap, divided, passes, place

SHINGLE, PERCENT = 5, 80
HASHES, CHUNKS, BLOCK = 60, 10, 4000
LEAST_PLACES, MOST_PLACES, PLACES_EACH = 256, 1 << 15, 4
COMPARED = 1 << 23  # bytes of bitmaps that are compared at once
RADIUS = 2 * CHUNKS - 1
_WIDTH = HASHES // CHUNKS


def farthest(percent: int) -> int:
    """Differing symbols up to which a pair is looked at: 4.7 deviations above the mean at the least similarity."""
    p = 1 - percent / 100
    return max(RADIUS, int(HASHES * p + 4.7 * (HASHES * p * (1 - p)) ** 0.5))


def hash_parameters(first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    flips = mix(np.arange(first, first + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return flips[:, None], mix(flips)[:, None] | np.uint64(1)


def minima(shingles: np.ndarray, flips: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Of each hash function, its least value over the set, hashed."""
    least = np.full(len(flips), np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(shingles), 2048):
        np.minimum(least, ((shingles[low : low + 2048] ^ flips) * odd).min(1), out=least)
    return mix(least)


def signature(shingles: np.ndarray, flips: np.ndarray, odd: np.ndarray) -> bytes:
    """HASHES symbols of 16 bits."""
    return (minima(shingles, flips, odd) >> np.uint64(48)).astype("<u2").tobytes()


def occupancy(shingles: np.ndarray) -> bytes:
    """A bitmap of the places that a set's shingles hash to; a power of two of places, about PLACES_EACH a shingle."""
    places = min(MOST_PLACES, max(LEAST_PLACES, 1 << (PLACES_EACH * len(shingles) - 1).bit_length()))
    bits = np.zeros(places, bool)
    bits[(shingles & np.uint64(places - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bitmaps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of ``width`` or 2, 4, ... times as many bytes as rows of 64-bit words of ``width`` bytes."""
    out = np.zeros((len(bitmaps), width // 8), np.uint64)
    for k, raw in enumerate(bitmaps):
        if len(raw) == width:
            out[k] = np.frombuffer(raw, np.uint64)
        else:
            np.bitwise_or.reduce(np.frombuffer(raw, np.uint64).reshape(-1, width // 8), axis=0, out=out[k])
    return out


def may_be_similar(bitmaps: list[bytes], n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Of the pairs (i, j) of sets of n shingles, which their bitmaps don't refute."""
    size = np.array([len(b) for b in bitmaps])
    width, good = np.minimum(size[i], size[j]), np.zeros(len(i), bool)
    for w in np.unique(width).tolist():
        alike, step = np.flatnonzero(width == w), COMPARED // w
        for low in range(0, len(alike), step):
            at = alike[low : low + step]
            some, place = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
            rows = folded([bitmaps[k] for k in some.tolist()], w)
            x, y = rows[place[: len(at)]], rows[place[len(at) :]]
            common = np.minimum(n[i[at]] - np.bitwise_count(x & ~y).sum(1, np.int64), n[j[at]] - np.bitwise_count(y & ~x).sum(1, np.int64))
            good[at] = 100 * common >= percent * (n[i[at]] + n[j[at]] - common)
    return good


def _signer(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (flips, odd) = WordHasher(True), hash_parameters(1, HASHES)
        for batch in batches:
            for part, data, bounds in slices(batch):
                counts, digests, signs, places = [], [], [], []
                for own in shingle_sets(hasher(data, bounds), size):
                    counts.append(len(own))
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                    signs.append(signature(own, flips, odd) if len(own) else None)
                    places.append(occupancy(own) if len(own) else None)
                same = [part.column(part.schema.get_field_index(c)) for c in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary()), pa.array(places, pa.binary())],
                    ["doc_id", "text_hash", "n_shingles", "digest", "signature", "places"],
                )
        give_back()

    return sign


def variant_keys(symbols: np.ndarray) -> np.ndarray:
    """(signatures, CHUNKS, width) keys: a chunk with one symbol left out, hashed to 57 bits under the chunk's number and the symbol's."""
    symbols = symbols.reshape(len(symbols), CHUNKS, _WIDTH).astype(np.uint64)
    keys = np.empty(symbols.shape, np.uint64)
    for gone in range(_WIDTH):
        key = np.full(symbols.shape[:2], gone + 1, np.uint64)
        for at in range(_WIDTH):
            if at != gone:
                key = mix(key ^ symbols[:, :, at]) * np.uint64(0x9E3779B97F4A7C15)
        keys[:, :, gone] = mix(key) >> np.uint64(7) | np.uint64(gone << 57) | np.arange(CHUNKS, dtype=np.uint64) << np.uint64(60)
    return keys


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All bucket keys of each (id, signature, n)."""
    for batch in batches:
        keys = variant_keys(_symbols(batch.column(1))).reshape(-1)
        own = np.repeat(np.arange(batch.num_rows), HASHES)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0).take(pa.array(own))], ["key", "id"])


def _pairs_of(key: int, ids: np.ndarray, n: np.ndarray, component: np.ndarray, major: int, block: np.ndarray, bitmaps: list[bytes], symbols: np.ndarray, percent: int) -> list[np.ndarray]:
    """(a, b, distance) of the close pairs across components of one bucket, with an end outside of its major component.

    If the members are of two blocks, pairs within a block belong to another group.
    """
    out, minor = [np.zeros((0, 3), np.int64)], np.flatnonzero(component != major)
    step, two = max(1, 200_000 // len(ids)), bool((block != block[0]).any())
    for low in range(0, len(minor), step):
        x = minor[low : low + step, None]
        fits = (component[x] != component) & ((component == major) | (ids[x] < ids))
        fits &= 100 * np.minimum(n[x], n) >= percent * np.maximum(n[x], n)
        if two:
            fits &= block[x] != block
        x, y = minor[low + np.nonzero(fits)[0]], np.nonzero(fits)[1]
        for at in range(0, len(x), 50_000):
            i, j = x[at : at + 50_000], y[at : at + 50_000]
            same = symbols[i] == symbols[j]
            good = same.sum(1) >= HASHES - farthest(percent)
            i, j, same = i[good], j[good], same[good]
            # in the first bucket that the pair shares
            equal = same.reshape(-1, CHUNKS, _WIDTH).sum(2)
            chunk = (equal >= _WIDTH - 1).argmax(1)
            good = (chunk == key >> 60) & ((equal[np.arange(len(i)), chunk] < _WIDTH) | (key >> 57 & 7 == 0))
            i, j, same = i[good], j[good], same[good]
            good = may_be_similar(bitmaps, n, i, j, percent)
            i, j, same = i[good], j[good], same[good]
            out.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), HASHES - same.sum(1)], 1))
    return out


def _enumerator(percent: int):
    def enumerate_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of the groups of (key, part, id, n, component, major, block, places, signature) rows in order of key and part."""
        held: pa.Table | None = None

        def starts(rows: pa.Table) -> np.ndarray:
            key, part = np.asarray(rows.column(0)), np.asarray(rows.column(1))
            return np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))

        def pairs(rows: pa.Table) -> pa.RecordBatch:
            key, _, ids, n, component, major, block = (np.asarray(rows.column(k)) for k in range(7))
            symbols, found = _symbols(rows.column(8)), [np.zeros((0, 3), np.int64)]
            edges = np.append(starts(rows), len(key))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                bitmaps = rows.column(7).slice(a, b - a).to_pylist()
                found += _pairs_of(int(key[a].view(np.uint64)), ids[a:b], n[a:b], component[a:b], major[a], block[a:b], bitmaps, symbols[a:b], percent)
            whole = np.concatenate(found)
            return pa.RecordBatch.from_arrays([pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(whole[:, 2].astype(np.int32))], ["a", "b", "distance"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = int(starts(held)[-1])  # the last group may go on
            if last:
                yield pairs(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield pairs(held)
        held = None
        give_back()

    return enumerate_


def _closeness(percent: int):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distance = (_symbols(batch.column(2)) != _symbols(batch.column(3))).sum(1)
            close = np.flatnonzero(distance <= farthest(percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(close), batch.column(1).take(close), pa.array(distance[close], pa.int32())], ["a", "b", "distance"])

    return near


def _setter(size: int, wanted: np.ndarray):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, digest, shingles) of the (doc_id, text, place) rows that pass the filter."""
        hasher = WordHasher(True)
        for batch in batches:
            batch = batch.filter(pa.array(passes(wanted, np.asarray(batch.column(2)))))
            for part, data, bounds in slices(batch):
                own = [s.tobytes() for s in shingle_sets(hasher(data, bounds), size)]
                digests = [xxhash.xxh3_128_digest(x) for x in own]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(own, pa.binary())], ["id", "digest", "shingles"])
        give_back()

    return sets


def _confirmer(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part, good = batch.slice(low, 256), []
                for x, y in zip(part.column(2), part.column(3), strict=True):
                    x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                    common = 0
                    if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                        both = np.concatenate([x, y])
                        both.sort()
                        common = int((both[1:] == both[:-1]).sum())
                    good.append(100 * common >= percent * (len(x) + len(y) - common))
                yield part.filter(pa.array(good, pa.bool_())).select([0, 1])

    return confirm


def _crossing(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components of ``of`` (id, component); ids not in it are their own."""
    a = of.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    b = of.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    joined = pairs.join(a, "a", "left").join(b, "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})
    return joined.where("ca <> cb")


class _Links:
    """The steps of one call over its written tables."""

    def __init__(self, docs: DataFrame, signed: DataFrame, classes: DataFrame, size: int, percent: int, scratch: Scratch) -> None:
        self.docs, self.signed, self.classes, self.size, self.percent, self.scratch = docs, signed, classes, size, percent, scratch

    def alike(self, n: str, m: str):
        return F.least(n, m) * 100 >= F.greatest(n, m) * self.percent

    def across(self, placed: DataFrame, total: int) -> DataFrame:
        """(a, b, distance) of one bucket and two components, unless both are in the bucket's largest, from (key, id, n, component)."""
        sizes = placed.groupBy("key", "component").agg(F.count("*").alias("k"))
        mixed = sizes.groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("major"), F.count("*").alias("c"), F.sum("k").alias("k"))
        mixed = self.scratch.write(mixed.where("c > 1").select("key", "major", "k", F.col("k").alias("members")), "mixed")
        live = self.scratch.write(split_join(placed, mixed, "key", total), "live")
        held = live.select("id").distinct().join(self.classes.select("id", "digest", "signature"), "id")
        places = self.signed.groupBy(F.col("doc_id").alias("id"), "digest").agg(F.first("places").alias("places"))
        held = held.join(places, ["id", "digest"]).select("id", "signature", "places")
        # a member meets each block of its bucket in the group of its own block and that one
        live = live.withColumn("blocks", F.ceil(F.col("members") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).join(held, "id")
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
        live = live.select("*", other).withColumn("part", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
        rows = live.select("key", "part", "id", "n", "component", "major", "block", "places", "signature")
        rows = rows.repartition("key", "part").sortWithinPartitions("key", "part")
        return rows.mapInArrow(_enumerator(self.percent), "a long, b long, distance int")

    def near(self, pairs: DataFrame, table: str) -> DataFrame:
        """The pairs (a, b) whose set sizes allow the similarity and whose signatures are close, with the distance."""
        of = lambda x: self.classes.select(F.col("id").alias(x), F.col("signature").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
        often = self.scratch.write(pairs.groupBy("a").agg(F.count("*").alias("k")).join(of("a"), "a"), f"{table}-least")  # one id may be the least of many buckets
        both = split_join(pairs, often, "a", pairs.count()).join(of("b"), "b").where(self.alike("na", "nb"))
        return self.scratch.write(both.select("a", "b", "sa", "sb").mapInArrow(_closeness(self.percent), "a long, b long, distance int"), table)

    def sets(self, pairs: DataFrame, table: str) -> DataFrame:
        """(id, shingles) of the pairs' ends; texts are scanned, and shuffled only if too many are wanted for the filter."""
        ends = self.ends(pairs)
        texts = self.docs.where("doc_id IS NOT NULL").select("doc_id", "text", place("doc_id").alias("place"))
        found = texts.mapInArrow(_setter(self.size, bitmap(ends, "id")), "id long, digest binary, shingles binary")
        once = found.groupBy("id", "digest").agg(F.first("shingles").alias("shingles"))  # of repeated rows
        return self.scratch.write(once.join(self.classes.select("id", "digest"), ["id", "digest"], "left_semi").select("id", "shingles"), table)

    def ends(self, pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("id")).union(pairs.select("b"))

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(
            sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(_confirmer(self.percent), "a long, b long")

    def merged(self, have: DataFrame, crossing: DataFrame, sets: DataFrame, tag: str) -> DataFrame:
        """``have`` with the components joined that a confirmed pair connects."""
        links = self.confirmed(crossing.select("a", "b"), sets).distinct()
        over = components(_crossing(links, have).select(F.col("ca").alias("a"), F.col("cb").alias("b")), self.scratch, tag)
        known = have.select("id", "component").union(over.select("id", F.col("id").alias("component")))
        # an id that no earlier component had is its own; one that had is listed twice and keeps the smaller name
        known = known.groupBy("id").agg(F.min("component").alias("component"))
        step = over.select(F.col("id").alias("component"), F.col("component").alias("to"))
        return self.scratch.write(known.join(step, "component", "left").select("id", F.coalesce("to", "component").alias("component")), f"{tag}-merged")


def link_classes(docs: DataFrame, signed: DataFrame, classes: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """(id, component) of the classes (id, digest, signature, n) that some other class is similar to."""
    run = _Links(docs, signed, classes, size, percent, scratch)
    keys = classes.select("id", "signature").mapInArrow(_index, "key long, id long")
    shared = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("k")).where("low < high")
    shared = scratch.write(shared.select("key", "low", "k"), "shared")
    members = scratch.write(split_join(keys, shared, "key", HASHES * classes.count()), "members")
    near = run.near(scratch.write(members.select(F.col("low").alias("a"), F.col("id").alias("b")).where("a < b").distinct(), "low-pairs"), "near")
    sets = run.sets(near, "sets")

    ends = near.select(F.col("a").alias("u"), F.struct("distance", F.col("b").alias("v")).alias("best")).union(
        near.select(F.col("b").alias("u"), F.struct("distance", F.col("a").alias("v")).alias("best")))
    closest = ends.groupBy("u").agg(F.min("best").alias("best")).select(F.least("u", "best.v").alias("a"), F.greatest("u", "best.v").alias("b")).distinct()
    found = scratch.write(components(run.confirmed(closest, sets), scratch, "closest"), "found")

    rest = scratch.write(_crossing(near.join(closest, ["a", "b"], "left_anti"), found).select("a", "b"), "rest")
    if not rest.isEmpty():
        found = run.merged(found, rest, sets, "rest")

    placed = members.select("key", "id").join(classes.select("id", "n"), "id").join(found, "id", "left")
    placed = scratch.write(placed.select("key", "id", "n", F.coalesce("component", "id").alias("component")), "placed")
    scratch.drop("members")
    across = run.across(placed, placed.count())
    left = scratch.write(across.distinct().join(near, ["a", "b"], "left_anti"), "near-left")
    if not left.isEmpty():
        found = run.merged(found, left, run.sets(left, "sets-left"), "left")
    scratch.drop("live", "placed", "sets")
    return found


def _reported(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept of each row."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    fields = "doc_id long, text_hash long, n_shingles long, digest binary, signature binary, places binary"
    signed = scratch.write(texts.mapInArrow(_signer(size), fields), "signed")
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("digest", "signature", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("id"), F.count("*").alias("k"))
    classes = scratch.write(classes, "classes")
    found = link_classes(texts.select("doc_id", "text"), signed, classes, size, percent, scratch)
    named = scratch.write(classes.select("digest", "id", "k").join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("linked"), "k"), "named")
    out = split_join(known.select("digest", "doc_id", "text_hash", "n_shingles"), named, "digest", known.count()).drop("digest")
    alone = signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("linked"))
    kept = F.coalesce(F.col("doc_id") == F.col("linked"), F.lit(True))
    return out.unionByName(alone).select("doc_id", "text_hash", "n_shingles", F.col("linked").alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (the least doc_id it is linked with), kept."""
    return _reported(docs, size, percent).drop("text_hash")


def deduplicate(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents with one of each group of near-duplicates (that of the least doc_id), all columns.

    Rows are told apart by id and text, so a text that only shares its id with a copy stays. Only texts whose id may belong to a
    dropped one are shuffled.
    """
    gone = _reported(docs, size, percent).where("NOT kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    gone = Scratch(docs.sparkSession, "near-dedup-gone").write(gone, "gone")
    some, none = divided(docs, gone.select(F.col("__id").alias("doc_id")), "doc_id")
    kept = some.join(gone, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left_anti")
    return kept.select(docs.columns).unionByName(none)
