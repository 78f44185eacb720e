"""Best-fit packing of token sequences, best-two-fit variant.

Documents are encoded and cut into pieces of at most ``capacity`` tokens. Pieces are dealt by number into blocks of
about BLOCK_PIECES pieces, and each block is packed on its own: a bin is filled greedily with the largest piece
that fits until none does, then its smallest piece is replaced by the two unpacked pieces that together fit the gap
so expanded more tightly. A block wastes at most about one bin in thousands, so blocks cost next to nothing and the
number of blocks grows with the input while a task stays as large as ever.

A worker's encoder keeps the ids of words it has met (bounded, emptied when full); text is cut at ASCII white space,
which the vocabulary's own splitter never crosses and always drops, so ids equal those of the whole text.

A null text is empty: it is one piece holding only the closing id. Repeated rows are packed as rows of their own: pieces are
dealt by their number in the task that made them, never by content, so blocks stay even whatever repeats. An empty table
gives an empty result; other columns are not looked at. One very long text needs about 30 times its bytes in a worker.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .arrowtext import slices

CAPACITY = 2048
BLOCK_PIECES = 20_000
_CACHED_WORDS = 500_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def loaded_tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding; a worker process loads it once."""
    held = sys.__dict__.setdefault("_threadloom_tokenizers", {})
    if path not in held:
        from tokenizers import Tokenizer

        held[path] = Tokenizer.from_file(path)
        held[path].no_truncation()
        held[path].no_padding()
    return held[path]


class WordEncoder:
    """Ids, as little-endian 32-bit words in bytes, of texts under a tokenizer that never looks across white space.

    A word of lower-case Latin-1 letters is what the vocabulary's normaliser and splitter leave as it is, so it goes
    straight to its model, in the byte alphabet of the splitter. Words met first tend to be the common ones, so a full
    cache drops its newest half.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer, self.known = loaded_tokenizer(path), {}

    def __call__(self, split: list[list[str]]) -> list[bytes]:
        met = set(chain.from_iterable(split))
        fresh = met - self.known.keys()
        if len(self.known) + len(fresh) > _CACHED_WORDS:
            for word in list(self.known)[_CACHED_WORDS // 2 :]:
                del self.known[word]
            fresh = met - self.known.keys()
        self._learn(fresh)
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def _learn(self, fresh: set[str]) -> None:
        known, model, others = self.known, self.tokenizer.model, []
        for word in fresh:
            if _PLAIN.fullmatch(word):
                alphabet = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_ALPHABET)
                known[word] = array("I", [t.id for t in model.tokenize(alphabet)]).tobytes()
            else:
                others.append(word)
        for low in range(0, len(others), 20_000):
            part = others[low : low + 20_000]
            for word, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[word] = array("I", got.ids).tobytes()


_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
BYTE_ALPHABET = {b: 0x100 + k for k, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
_BLANKS = dict.fromkeys(range(0x09, 0x0E), " ")


def cut_anywhere(data: np.ndarray, bounds: np.ndarray) -> list[bool]:
    """Of each text, whether marks stand alone (touch no other mark) among ASCII and Latin letters, without apostrophes."""
    mark, never = np.zeros(256, bool), np.zeros(256, bool)
    mark[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
    never[[*range(0x09), *range(0x0E, 0x20), 0x27, 0x7F, 0xC2, *range(0xCA, 0x100)]] = True
    bad, marks = never[data], mark[data]
    bad[1:] |= marks[1:] & marks[:-1]
    for first, second in ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0)):  # two signs, and a capital with no plain small letter
        bad[1:] |= (data[:-1] == first) & (data[1:] == second)
    return (np.diff(np.searchsorted(np.flatnonzero(bad), bounds)) == 0).tolist()


def words_of(text: str, anywhere: bool) -> list[str]:
    """Pieces at whose edges the vocabulary's splitter always cuts.

    White space is such an edge; if marks stand alone, full stops and commas are pieces of their own, and letters may be
    lower-cased, as the vocabulary does. (str.split also cuts at control characters, which such texts don't have.)
    """
    if anywhere:
        return text.lower().replace(".", " . ").replace(",", " , ").split()
    return text.translate(_BLANKS).split(" ")


def _piecer(path: str, capacity: int, closing_id: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = WordEncoder(path)
        last = int(closing_id).to_bytes(4, "little")
        number = TaskContext.get().partitionId() << 33  # a task that is run again gives the same numbers
        for batch in batches:
            for part, data, bounds in slices(batch):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                texts = [words_of(t or "", anywhere) for t, anywhere in zip(texts, cut_anywhere(data, bounds), strict=True)]
                out: list[tuple] = []
                for doc, ids in zip(part.column(part.schema.get_field_index("doc_id")).to_pylist(), encode(texts), strict=True):
                    ids += last
                    for k, low in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[low : low + 4 * capacity]
                        out.append((doc, k, low // 4, len(own) // 4, zlib.crc32(own)))
                cols = list(zip(*out, strict=True))
                columns = [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(number, number + len(out)))], ["doc_id", "piece", "start", "length", "ids_crc32", "number"])
                number += len(out)

    return pieces


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. Pieces of one length are alike, so the work is on counts by length."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=capacity + 1)
    place = np.cumsum(counts) - counts  # where a length's pieces begin in order
    left, sizes = counts.tolist(), np.flatnonzero(counts).tolist()
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left[0] = 0

    def take(size: int) -> None:
        left[size] -= 1
        if not left[size]:
            del sizes[bisect_right(sizes, size) - 1]

    def give(size: int) -> None:
        if not left[size]:
            sizes.insert(bisect_right(sizes, size), size)
        left[size] += 1

    number = 0
    while sizes:
        chosen, gap = [], capacity
        while gap and sizes and (at := bisect_right(sizes, gap)):
            chosen.append(sizes[at - 1])
            gap -= sizes[at - 1]
            take(sizes[at - 1])
        if gap and len(chosen) > 1 and sizes:
            room, pair = gap + chosen[-1], best_two(sizes, left, gap + chosen[-1], chosen[-1])
            if pair:
                give(chosen.pop())
                for size in pair:
                    take(size)
                    chosen.append(size)
                gap = room - sum(pair)
        offset = 0
        for size in chosen:
            index = order[place[size]]
            place[size] += 1
            bins[index], offsets[index] = number, offset
            offset += size
        number += 1
    return bins, offsets


def best_two(sizes: list[int], left: list[int], room: int, beat: int) -> tuple[int, int] | None:
    """Two unpacked sizes of the largest sum over ``beat`` and up to ``room``, by two pointers over the sizes."""
    low, high, best, pair = 0, bisect_right(sizes, room) - 1, beat, None
    while low <= high:
        total = sizes[low] + sizes[high]
        if total > room or (low == high and left[sizes[low]] < 2):
            high -= 1
            continue
        if total > best:
            best, pair = total, (sizes[low], sizes[high])
            if best == room:
                break
        low += 1
    return pair


def _block_packer(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ignore_index=True)
        bins, pdf["offset"] = pack_lengths(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = (pdf["block"].to_numpy().astype(np.int64) << 32) + bins
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return pack


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing_id: int = 0, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(docs.select("doc_id", "text").mapInArrow(_piecer(tokenizer, capacity, closing_id), f"{_PIECES}, number long"), "pieces")
    blocks = max(1, -(-pieces.count() // block_pieces))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int")).drop("number")
    return dealt.groupBy("block").applyInPandas(_block_packer(capacity), f"{_PIECES}, sequence_id long, offset long")
