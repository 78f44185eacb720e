import random
import string
import zlib

import numpy as np

from threadloom.llm import decontaminate as D
from threadloom.skew import salted_join
from threadloom.llm import language_id as L
from threadloom.llm.arrowtext import WordHasher

SOUNDS = {"aa": "the of and to in is that it was for", "bb": "der die und das nicht mit sich auf für ist", "cc": "le la et les des en un du une que"}


def speech(rng, lang, n):
    return " ".join(rng.choice(SOUNDS[lang].split()) for _ in range(n))


def test_held_out_accuracy_and_unknowns(spark, docs_of):
    rng = random.Random(0)
    rows = [(i, speech(rng, k := rng.choice(list(SOUNDS)), rng.randrange(3, 40)), k) for i in range(400)]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 !?", "bb"), (903, "the of", None), (None, "la et les", None), (904, "日本語", None)]
    got = L.identify(docs_of(*rows)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows[:400]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.95 * len(held)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    assert by[None].lang_pred == "cc" and all(0 <= r.score <= 1 for r in got)


def test_prediction_uses_the_text_alone(docs_of):
    model = L.fit(docs_of((1, "der die das", "bb"), (2, "the of and", "aa")))
    a = L.predict(docs_of((7, "und nicht der", "aa")), model, ["doc_id"]).first()
    b = L.predict(docs_of((8, "und nicht der", None)), model, ["doc_id"]).first()
    assert (a.lang_pred, a.score) == (b.lang_pred, b.score) and a.lang_pred == "bb"


def test_empty_training_and_empty_table(docs_of):
    assert L.identify(docs_of((1, "abc"))).first().lang_pred == "und"
    assert L.identify(docs_of()).count() == 0


def plain_bundle(text, dimensions=L.DIMENSIONS, seed=20):
    total = np.zeros(dimensions)
    vector = lambda c: L.letter_vectors(np.array([ord(c)]), dimensions, seed)[0].astype(float)
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        padded = f" {word} "
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            total += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return total


def test_predictions_equal_plain_bundles_and_cosines(docs_of, monkeypatch):
    rng = random.Random(7)
    rows = [(i, speech(rng, k := rng.choice(list(SOUNDS)), rng.randrange(1, 12)), rng.choice([k, k, None])) for i in range(120)]
    rows += [(500, "ein Straßen-schild, ÄÖ", "bb"), (501, "日本 слово", "dd"), (502, None, "aa"), (503, "4 5", None), (504, "x" * 3000, None)]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows}
    langs = sorted({x for i, t, x in rows if x and t is not None and not held[i]})
    proto = np.array([sum(plain_bundle(t) for i, t, x in rows if x == lang and t is not None and not held[i]) for lang in langs])
    proto /= np.linalg.norm(proto, axis=1, keepdims=True)
    proto -= proto.mean(0)
    proto /= np.linalg.norm(proto, axis=1, keepdims=True)
    for held_vectors in (L.HELD, 40):  # 40: the memory is full all the time
        monkeypatch.setattr(L, "HELD", held_vectors)
        got = {r.doc_id: r for r in L.identify(docs_of(*rows)).collect()}
        for i, text, _ in rows:
            own = plain_bundle(text)
            if not own.any():
                assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
                continue
            cosine = proto @ own / np.linalg.norm(own)
            assert got[i].lang_pred == langs[int(cosine.argmax())] and got[i].held_out == held[i]
            assert abs(got[i].score - max(0.0, cosine.max())) < 1e-5


def test_letters_have_vectors_of_their_own():
    points = np.array([ord(c) for c in "abcäß日本語д"])
    own = L.letter_vectors(points, 1024, 20).astype(float)
    near = own @ own.T / 1024
    assert np.abs(near - np.eye(len(points))).max() < 0.15 and set(np.unique(own)) == {-1.0, 1.0}


def words_of(text):
    table = {ord(c): " " for c in string.punctuation} | {ord(c): c.lower() for c in string.ascii_uppercase}
    return [w for w in text.translate(table).replace("\n", " ").split(" ") if w]


def brute(docs, items, size=5, share=0.8):
    out = set()
    for item, t in items:
        w = words_of(t or "")
        n = min(size, len(w))
        own = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for doc, text in docs:
            v = words_of(text or "")
            have = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
            if own and len(own & have) >= share * len(own) - 1e-9:
                out.add((doc, item, len(own & have), len(own)))
    return out


def test_finds_exactly_contained_items(spark, docs_of, monkeypatch):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    items = [(i, fresh(rng.choice([1, 2, 4, 5, 6, 12, 30, 55]))) for i in range(60)] + [(60, []), (61, ["tie", "tie"])]
    docs = []
    for i in range(150):
        words = fresh(rng.randrange(200))
        for _, item in rng.sample(items, 2):
            part = list(item)
            if len(part) > 6 and rng.random() < 0.6:
                part[rng.randrange(len(part))] = "changed"
            if rng.random() < 0.3:
                part = part[: int(len(part) * 0.85)]
            words += [p.upper() if rng.random() < 0.1 else p for p in part] + fresh(3)
        docs.append((i, (", " if i % 3 else " ").join(words)))
    docs += [(500, None), (501, ""), (502, "tie tie"), (503, " ".join(items[7][1]) * 1)]
    items = [(i, " ".join(w)) for i, w in items] + [(70, None), (71, "tie tie")]
    table = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    assert expected
    for parts in (512, 2):  # with few and with many keys that are hot
        monkeypatch.setattr(D, "salted_join", lambda rows, side, on, parts=parts: salted_join(rows, side, on, parts))
        got = [(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in D.find_leaks(docs_of(*docs), table).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    clean = {r.doc_id for r in D.decontaminate(docs_of(*docs), table).collect()}
    assert clean == {d for d, _ in docs} - {e[0] for e in expected}


def test_documents_are_read_once_whatever_the_items(spark, docs_of):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    docs = docs_of(*[(i, " ".join(f"w{i * 7 + k}" for k in range(30))) for i in range(200)])
    docs = docs.mapInArrow(counted, docs.schema)
    items = spark.range(40_000).selectExpr("id AS item_id", "concat_ws(' ', transform(sequence(0, 24), k -> concat('w', id * 40 + k))) AS text")  # over 5 MB
    D.find_leaks(docs, items).collect()
    assert seen.value == 200


def test_a_hot_item_and_repeated_rows(spark, docs_of):
    item, other = "one two three four five six seven", "a b c d e f"
    rows = [(i, f"start {item} end {i}") for i in range(300)] + [(900, f"{other} {item}")] * 5 + [(None, item), (None, "clean text only"), (901, "one two three four five")]
    items = spark.createDataFrame([(1, item), (2, item), (3, other)], "item_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.item_id, r.containment) for r in D.find_leaks(docs_of(*rows), items).collect())
    want = [(False, i, k, 1.0) for i in range(300) for k in (1, 2)] + [(False, 900, k, 1.0) for k in (1, 2, 3)] * 5 + [(True, 0, k, 1.0) for k in (1, 2)]
    assert got == sorted(want)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in D.decontaminate(docs_of(*rows), items).collect()) == [(False, 901), (True, 0)]


def test_no_items_and_no_documents(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find_leaks(docs_of((1, "a b c d e")), none).count() == 0
    assert D.leaked_documents(docs_of(), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0


def test_long_words_and_buffers():
    hasher = WordHasher(False)
    text = ("x" * 3_000_000 + " y").encode()
    words = hasher(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert (len(words.hashes), words.first.tolist()) == (2, [0, 2])
