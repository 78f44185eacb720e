"""Language identification with hyperdimensional profiles.

Every letter, by its code point, has a random vector of +1 and -1. A letter trigram of a word (word ends count as a blank)
binds the permuted vectors of its letters by multiplication; a language prototype bundles (adds) the trigram vectors of
all its labelled texts; a document's bundle is compared with each prototype by cosine, with the bundle's own norm.
Prototypes are compared after their common mean is taken out, which removes what all languages share.

Bundles are products of counts and trigram vectors, for GROUP texts at a time. A worker keeps the trigram vectors that it has
used, HELD of them at most, which is memory only: vectors are made again from their letters when needed. No document sends
more than its prediction.

Nulls and texts without letters are ``und`` with score 0; rows whose label is null or whose text is null teach
nothing; an empty training set predicts ``und`` for all. Equal cosines go to the label that sorts first. Repeated rows
teach as often as they stand. One document at a time must fit in a worker (about 60 bytes a character).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import give_back, mix, slices

UNKNOWN = "und"
DIMENSIONS = 1024
#: A score that unrelated vectors do not reach: four deviations of their cosine. No margin is larger.
LEAST_SCORE = 4 / DIMENSIONS**0.5
GROUP = 64
HELD = 24_000
_BLANK = ord(" ")
_POINT = 21  # bits of a code point


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    table = np.zeros(0x110000, bool)
    table[[c for c in range(0x323B0) if chr(c).isalpha()]] = True
    return table


def letter_vectors(points: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """The vectors (+1, -1) of code points, from hashes of the point and each 64 dimensions."""
    words = np.arange(-(-dimensions // 64), dtype=np.uint64)
    bits = mix(mix(points.astype(np.uint64) + np.uint64(seed << 32))[:, None] + words * np.uint64(0x9E3779B97F4A7C15))
    flags = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[:, :dimensions]
    return flags.astype(np.int8) * 2 - 1


def trigram_vectors(trigrams: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Bound vectors (+1, -1) of trigrams, each three code points in one number."""
    mask = (1 << _POINT) - 1
    points, at = np.unique(np.concatenate([trigrams >> 2 * _POINT, trigrams >> _POINT & mask, trigrams & mask]), return_inverse=True)
    own, at = letter_vectors(points, dimensions, seed), at.reshape(3, -1)
    return np.roll(own, 2, 1)[at[0]] * np.roll(own, 1, 1)[at[1]] * own[at[2]]


class TrigramMemory:
    """Trigram vectors that have been used before, as rows of a table that starts anew when it is full."""

    def __init__(self, dimensions: int, seed: int) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.known, self.place, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dimensions), np.int8)

    def __call__(self, trigrams: np.ndarray) -> np.ndarray:
        """The vectors of sorted distinct trigrams."""
        if len(trigrams) > HELD // 2:
            return trigram_vectors(trigrams, self.dimensions, self.seed)
        fresh = np.setdiff1d(trigrams, self.known, assume_unique=True)
        if len(self.known) + len(fresh) > HELD:
            self.known, self.place, self.rows, fresh = self.known[:0], self.place[:0], self.rows[:0], trigrams
        if len(fresh):
            at = np.arange(len(self.rows), len(self.rows) + len(fresh))
            self.rows = np.concatenate([self.rows, trigram_vectors(fresh, self.dimensions, self.seed)])
            known, place = np.concatenate([self.known, fresh]), np.concatenate([self.place, at])
            order = np.argsort(known)
            self.known, self.place = known[order], place[order]
        return self.rows[self.place[np.searchsorted(self.known, trigrams)]]


def trigrams_of(texts: list[str | None], is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of all texts in order, and where each text's begin (with the end)."""
    lowered = [(t or "").lower() for t in texts]
    whole = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "replace"), np.uint32)
    letter = is_letter[whole]
    points = np.where(letter, whole, _BLANK).astype(np.int64)
    middle = np.flatnonzero(letter[1:-1]) + 1
    trigrams = points[middle - 1] << 2 * _POINT | points[middle] << _POINT | points[middle + 1]
    ends = np.cumsum([0] + [len(t) + 1 for t in lowered])
    return trigrams, np.searchsorted(middle, ends + 1)


def bundles(trigrams: np.ndarray, owner: np.ndarray, owners: int, memory: TrigramMemory) -> np.ndarray:
    """(owners, dimensions) sums of the vectors of each owner's trigrams."""
    seen, at = np.unique(trigrams, return_inverse=True)
    total = np.zeros((owners, memory.dimensions))
    for low in range(0, len(seen), 2048):
        some = seen[low : low + 2048]
        inside = (at >= low) & (at < low + len(some))
        counts = np.bincount(owner[inside] * len(some) + at[inside] - low, minlength=owners * len(some)).reshape(owners, len(some))
        total += counts.astype(np.float32) @ memory(some).astype(np.float32)  # whole numbers, exact below 2**24
    return total


def _learner(dimensions: int, seed: int):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter, memory, totals = letters(), TrigramMemory(dimensions, seed), {}
        for batch in batches:
            for part, _, _ in slices(batch):
                langs = part.column(part.schema.get_field_index("lang")).to_pylist()
                trigrams, first = trigrams_of(part.column(part.schema.get_field_index("text")).to_pylist(), is_letter)
                names = list(dict.fromkeys(langs))
                of = {n: k for k, n in enumerate(names)}
                own = np.repeat(np.array([of[x] for x in langs]), np.diff(first))
                for name, row in zip(names, bundles(trigrams, own, len(names), memory), strict=True):
                    totals[name] = totals[name] + row if name in totals else row
        del memory
        give_back()
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.list_(pa.float64()))], ["lang", "total"])

    return learn


def fit(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = 20) -> dict[str, list[float]]:
    """Prototypes of all languages in ``docs`` (text, lang), from every labelled row.

    What reaches the driver is one sum per language and dimension, whatever the number of documents.
    """
    partial = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    partial = partial.mapInArrow(_learner(dimensions, seed), "lang string, total array<double>")
    sums = partial.select("lang", F.posexplode("total").alias("at", "part")).groupBy("lang", "at").agg(F.sum("part").alias("total"))
    out: dict[str, list[float]] = {}
    for row in sums.collect():
        out.setdefault(row.lang, [0.0] * dimensions)[row.at] = row.total
    return {lang: out[lang] for lang in sorted(out)}


def cosines(texts: list[str | None], prototypes: np.ndarray, is_letter: np.ndarray, memory: TrigramMemory) -> tuple[np.ndarray, np.ndarray]:
    """(texts, languages) cosines with the prototypes (unit rows), and which texts have letters."""
    out, some = np.zeros((len(texts), len(prototypes))), np.zeros(len(texts), bool)
    for low in range(0, len(texts), GROUP):
        part = texts[low : low + GROUP]
        trigrams, first = trigrams_of(part, is_letter)
        sums = bundles(trigrams, np.repeat(np.arange(len(part)), np.diff(first)), len(part), memory)
        norm = np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        out[low : low + GROUP], some[low : low + GROUP] = sums @ prototypes.T / norm, np.diff(first) > 0
    return out, some


def _predictor(names: list[str], prototypes: np.ndarray, dimensions: int, seed: int, dropped: tuple[str, ...]):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter, memory = letters(), TrigramMemory(dimensions, seed)
        for batch in batches:
            for part, _, _ in slices(batch):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                if names:
                    found, known = cosines(texts, prototypes, is_letter, memory)
                    best = found.argmax(1)
                    score = np.where(known, np.clip(found[np.arange(len(texts)), best], 0.0, 1.0), 0.0)
                    langs = [names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
                else:
                    score, langs = np.zeros(len(texts)), [UNKNOWN] * len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.drop_columns(list(dropped)).columns, pa.array(langs, pa.string()), pa.array(score, pa.float64())],
                    [*[n for n in part.schema.names if n not in dropped], "lang_pred", "score"],
                )
        del memory
        give_back()

    return predict


def centred(model: dict[str, list[float]], dimensions: int) -> np.ndarray:
    """The prototypes as unit rows, without their common mean."""
    raw = np.array([model[n] for n in model], np.float64).reshape(len(model), dimensions)
    raw /= np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
    if len(model) > 1:
        raw -= raw.mean(0)
        raw /= np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
    return raw


def predict(docs: DataFrame, model: dict[str, list[float]], keep: list[str], dimensions: int = DIMENSIONS, seed: int = 20, keep_text: bool = False) -> DataFrame:
    """Columns ``keep`` of ``docs`` (and its text, if asked for), with lang_pred and score (the cosine, 0 at least), from the whole text alone."""
    names = list(model)
    source = docs.select(*keep, "text")
    dropped = () if keep_text else ("text",)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name not in dropped)
    return source.mapInArrow(_predictor(names, centred(model, dimensions), dimensions, seed, dropped), f"{fields}, lang_pred string, score double")


def letter_class(text: str = "text"):
    """The number of binary digits of a text's count of letters."""
    return F.length(F.bin(F.length(F.regexp_replace(text, r"\P{L}+", "")))).cast("int")


def margins(docs: DataFrame, model: dict[str, list[float]]) -> list[float]:
    """The least score to be expected of a text of each class of length, from the scores of all labelled rows.

    It is half of what all but one in a thousand of the rows reach that are told rightly, and LEAST_SCORE at most. Classes without
    rows take that of the next shorter one (longer texts score higher), or 0 if there is none.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang", letter_class().alias("class"))
    told = predict(known, model, ["lang", "class"])
    low = told.where("lang = lang_pred").groupBy("class").agg(F.percentile_approx("score", 0.001, 100_000).alias("low"))
    found = {r["class"]: r.low for r in low.collect()}  # a row per class, of which there are 32 at most
    out, last = [], 0.0
    for k in range(33):
        last = min(LEAST_SCORE, found[k] / 2) if k in found else last
        out.append(last)
    return out


def least_score(margin: list[float], text: str = "text"):
    return F.array(*[F.lit(m) for m in margin])[letter_class(text)]


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the rows that must not teach; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def identify(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Learn from the rows that are not held out, then predict every row: doc_id, held_out, lang_pred, score."""
    marked = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = fit(marked.where("NOT held_out"), dimensions)
    return predict(marked, model, ["doc_id", "held_out"], dimensions)
