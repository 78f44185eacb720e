"""Interleaved document sequences: text and media in the order of the page.

HTML is parsed to an ordered array of items, text runs and media references; a reference holds the digest of its
payload and its caption (the figure's, before or after it, or else the alternative text). A reference is src, or else the first address of
srcset, data-src or data-srcset; inside a picture, video or audio with a reference of its own, sources are other forms of it and add
none. A caption or figure that is not closed ends with its figure or the page. Payloads live once in a store keyed by digest, and a digest
join resolves them while positions and captions stay with the items.

The stored form here is an 8-bit grey PNG whose rows are WIDTH samples. A task stores a digest once; copies in
other tasks are dropped when features are read back, by digest, combined before the shuffle. Media bytes are never
shuffled, and a digest that many rows refer to is split. Null and empty texts are one row of blanks; repeated rows keep their rows.
Malformed HTML is read as far as the parser gets; null HTML has no items; an empty table gives an empty result. Columns to keep
may have any names but position, caption and digest. One very long text needs about 10 times its bytes in a worker.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..skew import split_join
from .arrowtext import slices

WIDTH = 192
ITEM = "struct<position:int,kind:string,text:string,ref:string,caption:string>"
_PNG = b"\x89PNG\r\n\x1a\n"
_REMEMBERED = 200_000
_HIDDEN = {"script", "style", "template", "noscript"}
_MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "media"}
_WRAPPERS = {"picture", "video", "audio"}
_INLINE = {"a", "b", "i", "em", "strong", "span", "code", "sub", "sup"}


def pad(raw: bytes, width: int = WIDTH) -> bytes:
    """``raw`` with blanks up to a positive multiple of ``width``."""
    return raw + b" " * (max(1, -(-len(raw) // width)) * width - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # filter 0, then the samples
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG without line filters, rows by width."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, packed, width, height = 8, [], 0, 0
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)[:, 1:]


def describe(samples: np.ndarray) -> str:
    """Size, total, spread and a coarse histogram of the samples, in whole numbers."""
    flat = samples.reshape(-1)
    bins = np.bincount(flat >> 5, minlength=8)
    return f"{samples.shape[1]}x{samples.shape[0]};sum={int(flat.sum(dtype=np.int64))};min={int(flat.min())};max={int(flat.max())};hist={','.join(map(str, bins.tolist()))}"


class _Items(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden, self.figure, self.caption = 0, None, None
        self.said: str | None = None  # the caption of the figure that is open
        self.wrapped: list[bool] = []  # open pictures, videos and audios, and whether they have a reference

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        have = dict(attrs)
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag in _MEDIA or tag in _WRAPPERS:
            self.refer(tag, have)
        elif tag == "figure":
            self.end_figure()
            self.flush()
            self.figure = len(self.items)
        elif tag == "figcaption" and self.figure is not None:
            self.flush()
            self.caption = []
        elif tag not in _INLINE:
            self.flush()

    def refer(self, tag: str, have: dict) -> None:
        ref = next((first for name in ("src", "srcset", "data-src", "data-srcset") if (first := address(name, have.get(name)))), None)
        again = tag in ("source", "img") and bool(self.wrapped) and self.wrapped[-1]
        if again and tag == "img":  # the image itself stands for its sources
            self.items[-1].update(kind="image", caption=have.get("alt") or self.items[-1]["caption"], ref=ref or self.items[-1]["ref"])
        elif ref and not again:
            self.flush()
            kind = "image" if tag == "source" and self.within == "picture" else _MEDIA.get(tag, "image")
            self.items.append({"position": len(self.items), "kind": kind, "text": None, "ref": ref, "caption": have.get("alt")})
            if self.wrapped:
                self.wrapped[-1] = True
        if tag in _WRAPPERS:
            self.wrapped.append(bool(ref))
            self.within = tag

    within: str | None = None

    def end_caption(self) -> None:
        if self.caption is not None:
            self.said = " ".join("".join(self.caption).split())
            self.caption = None

    def end_figure(self) -> None:
        self.end_caption()
        if self.figure is not None and self.said is not None:
            held = [item for item in self.items[self.figure :] if item["ref"]]
            for item in held:
                item["caption"] = self.said
            if not held and self.said:  # a caption of nothing is text
                self.text.append(self.said)
                self.flush()
        self.figure = self.said = None

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.flush()
            self.end_figure()
        elif tag in _WRAPPERS:
            if self.wrapped:
                self.wrapped.pop()
            self.within = None
        elif tag not in _INLINE:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def address(name: str, value: str | None) -> str | None:
    """The address that an attribute gives first."""
    words = (value or "").split()
    return (words[0].rstrip(",") if name.endswith("set") else value.strip()) if words else None


def parse_items(source: str | None) -> list[dict]:
    parser = _Items()
    parser.feed(source or "")
    parser.close()
    parser.flush()
    parser.end_figure()
    return parser.items


def _interleaver(column: str):
    def interleave_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            for part, _, _ in slices(batch, column):
                items = [parse_items(x) for x in part.column(part.schema.get_field_index(column)).to_pylist()]
                rest = part.drop_columns([column])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(items, kind)], [*rest.schema.names, "items"])

    return interleave_


def interleave(pages: DataFrame, keep: list[str], column: str = "html") -> DataFrame:
    """Columns ``keep`` and ``items``, the page's ordered text runs and media references, which replace columns of these names."""
    kept = [c for c in dict.fromkeys(keep) if c not in ("items", column)]
    source = pages.select(*kept, column)
    fields = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept)
    return source.mapInArrow(_interleaver(column), f"{fields + ', ' if kept else ''}items array<{ITEM}>")


def resolve(sequences: DataFrame, keep: list[str], store: DataFrame, unresolved: bool = False) -> DataFrame:
    """A row per media item whose payload is in ``store`` (digest, ...): columns ``keep``, position, caption, digest and the store's. With ``unresolved``, one of the
    others too, with nulls.

    Of ``keep``, columns with a name of the others are left out. References are written, as those of a digest are counted before they are joined.
    """
    scratch = Scratch(sequences.sparkSession, "media-references")
    kept = [c for c in dict.fromkeys(keep) if c not in ("position", "caption", "items", *store.columns)]
    refs = sequences.select(*kept, F.explode("items").alias("__item")).where("__item.ref IS NOT NULL")
    refs = scratch.write(refs.select(*kept, "__item.position", "__item.caption", F.regexp_replace("__item.ref", "^sha256:", "").alias("digest")), "references")
    side = scratch.write(refs.groupBy("digest").agg(F.count("*").alias("__k")).join(store, "digest", "left" if unresolved else "inner"), "resolved")
    return split_join(refs, side, "digest", refs.count(), count="__k")


def _storer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The page of each text (its heading, then the payload as a figure) and, once a task, the stored payload."""
    done: set[bytes] = set()
    for batch in batches:
        for part, data, bounds in slices(batch):
            raw, out = data.tobytes(), []
            ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
            for k, doc in enumerate(ids):
                own = raw[bounds[k] : bounds[k + 1]]
                payload = pad(own)
                digest = hashlib.sha256(payload)
                page = f'<h1>{html.escape(str(doc))}</h1><figure><img src="sha256:{digest.hexdigest()}"><figcaption>{len(own)} bytes</figcaption></figure>'
                if len(done) >= _REMEMBERED:
                    done.clear()
                media = None if digest.digest() in done else encode_png(payload)
                done.add(digest.digest())
                out.append((doc, len(own), page, digest.hexdigest(), media))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "html", "digest", "media"])


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for digest, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            samples = decode_png(media)
            back = samples.tobytes()
            out.append((digest, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), describe(samples)))
        if out:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )


def read_back(store: DataFrame) -> DataFrame:
    """Per distinct digest of ``store`` (digest, media): what its stored bytes hold, and features of their samples."""
    fields = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    read = store.select("digest", "media").mapInArrow(_reader, fields)
    return read.groupBy(*read.columns).agg(F.count("*").alias("copies")).drop("copies")


def store_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, store): doc_id, n_bytes, html of each row, and the stored payloads by digest, both written tables."""
    written = Scratch(docs.sparkSession, "media").write(
        docs.select("doc_id", "text").mapInArrow(_storer, "doc_id long, n_bytes long, html string, digest string, media binary"), "stored"
    )
    return written.select("doc_id", "n_bytes", "html"), written.where("media IS NOT NULL").select("digest", "media")


def media_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, payload and media digests, feature, position and caption, as read back from the store."""
    pages, store = store_texts(docs)
    found = resolve(interleave(pages, ["doc_id", "n_bytes"]), ["doc_id", "n_bytes"], read_back(store))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
