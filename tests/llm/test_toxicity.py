"""Toxicity: held-out accuracy, and single parts against plain code."""

import random
import zlib

import numpy as np
import zstandard

from threadloom.llm import toxicity as X

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"
SOUNDS = ("the of and to in is that it was for on as with by at from".split(), "der die und das nicht mit sich auf für ist ein zu den von".split())
INSULTS = ("blockhead", "nitwit", "dunderpate")


def corpus(n, seed=5):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        own, bad = SOUNDS[i % 2], rng.random() < 0.2
        words = ["".join(rng.choice(own) for _ in range(rng.choice((1, 1, 2)))) for _ in range(rng.randrange(30, 150))]
        if bad:
            for _ in range(max(3, len(words) // 30)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words), None, None, None, "x"))
        labels.append((i, None, int(bad)))
    return rows, labels


def scored(spark, rows, labels):
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return X.score(docs, marks).collect()


def test_held_out_accuracy(spark):
    rows, labels = corpus(900)
    label = {i: t for i, _, t in labels}
    extra = [(5000, None), (5001, ""), (5002, "blockhead " * 50), (5003, "12 34 %%"), (5004, "the of and to in is that it was for on as " * 3000), (None, rows[0][1]), (1, rows[1][1])]
    got = scored(spark, rows + [(*e, None, None, None, "x") for e in extra], labels + [(None, 0, 1), (6000, 1, None)])
    assert len(got) == len(rows) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) for r in got)
    known = [r for r in got if r.held_out and r.doc_id in label]
    hits = sum(r.predicted and label[r.doc_id] for r in known)
    assert hits >= 0.8 * sum(label[r.doc_id] for r in known)
    assert sum(r.predicted and not label[r.doc_id] for r in known) <= 0.02 * len(known)
    of = {r.doc_id: r for r in got}
    assert of[5002].predicted and not of[5004].predicted and of[5000].score == of[5001].score == of[5003].score
    assert len({r.score for r in got if r.doc_id == 1}) == 1


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus(150)
    other = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    assert sorted(scored(spark, rows, labels)) == sorted(scored(spark, rows, other))


def test_one_label_or_none(spark):
    rows, labels = corpus(30)
    assert {round(r.score, 9) for r in scored(spark, rows, [(i, 0, 0) for i, _, _ in labels])} == {0.0}
    assert {round(r.score, 9) for r in scored(spark, rows, [(i, 0, 1) for i, _, _ in labels])} == {1.0}
    assert {round(r.score, 9) for r in scored(spark, rows, [])} == {0.0}
    assert scored(spark, [], labels) == []


def test_windows_cover_all_words():
    own = X.words("One two, THREE four5five ß " + "x" * 70)
    assert own == [b" ONE", b" TWO", b" THREE", b" FOUR", b" FIVE", b" SS", b" " + b"X" * 6 + b"x" * 26, b" " + b"X" * 6 + b"x" * 26, b" XXXXXX"]
    for n in range(12):
        some = [bytes([65 + k]) for k in range(n)]
        assert set(b"".join(X.windows(some))) == {65 + k for k in range(n)}
    assert X.windows(list(map(bytes, [[65], [66], [67], [68], [69]]))) == [b"ABCD", b"CDE"]


def test_differences_are_compressed_lengths():
    samples = [f" THIS is WINDOW {k % 7} of{k % 3}".encode() for k in range(400)]
    base = X.trained(samples)
    distances = X.Distances(base, base + b" BLOCKHead")
    length = lambda d, w: len(zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(w))
    text = "blockhead and more words blockhead here"
    want = np.array([length(base, w) - length(base + b" BLOCKHead", w) for w in X.windows(X.words(text))])
    assert np.allclose(distances(text), X.features(want)) and want.max() > 0
    assert X.trained([b"too few"]) == b"too few"


def test_regression_finds_the_slope():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(float)
    centre, scale, beta = X.regression(x, y, np.ones(4000))
    assert abs(beta[1] - 2) < 0.25 and abs(beta[2]) < 0.15 and abs(beta[0] + 1) < 0.2
