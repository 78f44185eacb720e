"""Toxicity by compression distance between two zstandard dictionaries.

Texts are brought to words: lower-case letters, with the first HEAD letters of each word in capitals, so that what
begins a word is told from the same letters inside one. WINDOW words are a window, and one begins every STEP words. A window is compressed with both
dictionaries; where the toxic one saves bytes, the window holds what toxic texts have and ordinary ones lack. A text's
features are statistics of these differences over all its windows: means, the largest, and the shares that reach each of
several thresholds. A ridge logistic regression on learnable rows weighs the thresholds and turns them into a probability.

Dictionaries. The ordinary one is trained by zstandard on windows of ordinary texts. Trained in the same way on toxic texts, a
dictionary is filled with the ordinary nine tenths of their words, and the difference is noise. So the toxic
dictionary is the ordinary one followed by toxic content: the word beginnings whose share of toxic texts exceeds
their share of ordinary ones by Z deviations, the strongest last, where references are cheapest. Both
dictionaries then differ in nothing else.

Fitting reads a bounded sample of the labelled rows, TOXIC and ORDINARY texts at most (about, as it is drawn by a
hash of the id), each text whole; rows are weighted back to the shares of all labelled rows. The driver gets
MOST_FRAGMENTS word beginnings, PER_TEXT windows of an ordinary text, and eight numbers of a sampled text. Scoring reads every
whole text where it is and shuffles nothing.

A null or empty text has no windows and gets what that implies. Without rows of both labels every score is the share of
toxic rows (0 without any). A doc_id with several labels counts as toxic if one is; with several texts, the least
teaches. Null ids and null labels teach nothing. Repeated rows get equal scores. Extra columns are not read. A text takes
about 30 times its bytes in a worker.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .arrowtext import slices

TOXIC, ORDINARY = 3000, 6000
WINDOW, STEP, HEAD, LEVEL = 4, 2, 6, 1
DICTIONARY, PER_TEXT, MOST_FRAGMENTS = 4096, 4, 512
SHORTEST, LONGEST, LEAST_TEXTS, Z = 5, 16, 3, 8.0
THRESHOLD = 0.7
_LETTERS = re.compile(r"[^\W\d_]{1,32}")  # longer runs of letters are several words
_SPREAD = 1 << 30
_FLUSH = 200_000


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def words(text: str | None) -> list[bytes]:
    return [(" " + w[:HEAD].upper() + w[HEAD:]).encode("utf-8", "replace") for w in _LETTERS.findall((text or "").lower())]


def windows(own: list[bytes]) -> list[bytes]:
    return [b"".join(own[k : k + WINDOW]) for k in range(0, max(len(own) - STEP, 1), STEP)] if own else []


def fragments(own: list[bytes]) -> set[bytes]:
    """The beginnings of a text's words, of SHORTEST to LONGEST bytes."""
    return {w[:k] for w in set(own) for k in range(SHORTEST, min(len(w), LONGEST) + 1)}


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)


def trained(samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples themselves if they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=64, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def features(differences: np.ndarray) -> np.ndarray:
    """Eight statistics of the bytes that the toxic dictionary saves on each window."""
    if not len(differences):
        return np.zeros(8)
    gain, top = np.maximum(differences, 0), np.sort(differences)[-3:]
    shares = [(differences >= t).mean() for t in (1, 2, 3)]
    return np.array([differences.mean(), gain.mean(), gain.max(), top.mean(), *shares, np.log1p((differences >= 2).sum())])


class Distances:
    """Features of texts under two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.ordinary, self.toxic = compressor(ordinary), compressor(toxic)

    def __call__(self, text: str | None) -> np.ndarray:
        a, b = self.ordinary.compress, self.toxic.compress
        return features(np.array([len(a(w)) - len(b(w)) for w in windows(words(text))]))


def deviations(toxic: int, ordinary: int, n_toxic: int, n_ordinary: int) -> float:
    """By how many deviations the share of toxic texts that have something exceeds that of ordinary ones."""
    p = (toxic + ordinary) / (n_toxic + n_ordinary)
    return (toxic / n_toxic - ordinary / n_ordinary) / max(p * (1 - p) * (1 / n_toxic + 1 / n_ordinary), 1e-12) ** 0.5


def toxic_content(found: list[tuple[bytes, int, float]]) -> bytes:
    """Word beginnings (with their texts and deviations), weakest first, without those that a stronger one stands for."""
    of = {f: (n, z) for f, n, z in found}
    kept = set(of)
    for f, (n, z) in of.items():
        shorter = [of[f[:k]] for k in range(SHORTEST, len(f)) if f[:k] in of]
        if any(s > z for _, s in shorter):
            kept.discard(f)
        else:
            kept -= {f[:k] for k in range(SHORTEST, len(f)) if f[:k] in of and of[f[:k]][1] <= z and n >= 0.9 * of[f[:k]][0]}
    return b"".join(sorted(kept, key=lambda f: (of[f][1], f)))


def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, scale, weights with the constant first) of a weighted ridge logistic regression, by Newton's method."""
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    design = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    beta, penalty = np.zeros(design.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - penalty @ beta
        curve = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + penalty
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, beta


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fragment, toxic, ordinary) counts of texts, from (toxic, text) rows."""
    held: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def out() -> pa.RecordBatch:
        names = list(held[0] | held[1])
        columns = [pa.array(names, pa.binary()), *(pa.array([held[k][f] for f in names], pa.int64()) for k in (1, 0))]
        held[0].clear(), held[1].clear()
        return pa.RecordBatch.from_arrays(columns, ["fragment", "toxic", "ordinary"])

    for batch in batches:
        for part, _, _ in slices(batch):
            for toxic, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                held[toxic].update(fragments(words(text)))
            if len(held[0]) + len(held[1]) > _FLUSH:
                yield out()
    yield out()


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PER_TEXT windows of each text, evenly spread over it."""
    for batch in batches:
        for part, _, _ in slices(batch):
            out = []
            for text in part.column(1).to_pylist():
                every = windows(words(text))
                out += [every[k] for k in sorted({int(k) for k in np.linspace(0, len(every) - 1, PER_TEXT)})] if every else []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["window"])


def _measurer(ordinary: bytes, toxic: bytes):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(ordinary, toxic)
        for batch in batches:
            for part, _, _ in slices(batch):
                found = [distances(t).tolist() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.float64()))], ["toxic", "features"])

    return measure


def learnable(doc_id: str = "doc_id"):
    """True for the rows that may teach."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, ordinary: int = ORDINARY) -> Model:
    """Dictionaries and weights from about ``toxic`` and ``ordinary`` labelled rows at most."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(learnable()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    counts = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, most / counts[k]) if counts.get(k) else 0.0 for k, most in ((0, ordinary), (1, toxic))}
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(_SPREAD)) < F.when(F.col("toxic") == 1, int(share[1] * _SPREAD)).otherwise(int(share[0] * _SPREAD))
    sample = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").join(F.broadcast(marked.where(drawn)), "doc_id")
    sample = scratch.write(sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("toxic", "text"), "sample")
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        rate = float(next(iter(n), 0))
        return Model(b"", b"", np.zeros(8), np.ones(8), np.array([1e3 * (2 * rate - 1)] + [0.0] * 8))
    texts = sample.repartition(max(2, docs.sparkSession.sparkContext.defaultParallelism))
    counted = texts.mapInArrow(_counter, "fragment binary, toxic long, ordinary long").groupBy("fragment").agg(F.sum("toxic").alias("t"), F.sum("ordinary").alias("o"))
    p = (F.col("t") + F.col("o")) / (n[0] + n[1])
    z = (F.col("t") / n[1] - F.col("o") / n[0]) / F.sqrt(F.greatest(p * (1 - p) * (1 / n[1] + 1 / n[0]), F.lit(1e-12)))
    best = counted.where(F.col("t") >= LEAST_TEXTS).select("fragment", "t", z.alias("z")).where(F.col("z") >= Z).orderBy(F.desc("z"), "fragment").limit(MOST_FRAGMENTS)
    content = toxic_content([(bytes(r.fragment), r.t, r.z) for r in best.collect()])
    base = trained([bytes(r.window) for r in texts.where("toxic = 0").mapInArrow(_sampler, "window binary").orderBy("window").collect()])
    rows = texts.mapInArrow(_measurer(base, base + content), "toxic int, features array<double>").collect()
    x, y = np.array([r.features for r in rows]), np.array([r.toxic for r in rows], float)
    order = np.lexsort([*x.T, y])  # sums don't depend on the order of tasks
    return Model(base, base + content, *regression(x[order], y[order], np.where(y[order] == 1, 1 / share[1], 1 / share[0])))


def probability(model: Model, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.weights[0] + (x - model.centre) / model.scale @ model.weights[1:], -700, 700)))


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model.ordinary, model.toxic)
        for batch in batches:
            for part, _, _ in slices(batch):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                found = probability(model, np.array([distances(t) for t in texts]))
                others = part.drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*others.columns, pa.array(found, pa.float64())], [*others.schema.names, "score"])

    return score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text), from the text alone."""
    source = docs.select("doc_id", (~learnable()).alias("held_out"), "text")
    scored = source.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the learnable labelled rows, then scores every document."""
    return predict(docs, fit(docs, labels))
