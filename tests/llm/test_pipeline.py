"""The pipeline against plain code on a small corpus."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from test_dedup import brute as near_brute
from test_language_and_leaks import brute as leak_brute

from threadloom.llm import language_id

WINDOW = 50


def plain(rows, items):
    letters = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    kept = {i for i, (_, _, first) in near_brute(letters, 5, 80).items() if first}
    texts = sorted((i, t.split()) for i, t in letters if i in kept)
    first = {}
    for i, w in texts:
        for k in range(len(w) - WINDOW + 1):
            first.setdefault(tuple(w[k : k + WINDOW]), i)
    cut = []
    for i, w in texts:
        gone = {j for k in range(len(w) - WINDOW + 1) if first[tuple(w[k : k + WINDOW])] < i for j in range(k, k + WINDOW)}
        if len(gone) < len(w) or not w:
            cut.append((i, " ".join(x for j, x in enumerate(w) if j not in gone)))
    leaks = {e[0] for e in leak_brute(cut, items)}
    return {i: t for i, t in cut if i not in leaks}


def test_stages_against_plain_code(spark, tmp_path):
    rng = random.Random(9)
    fresh = lambda n: [f"{rng.choice('abcdefgh')}{rng.choice('klmnop')}{rng.choice('rstuvw')}{rng.choice('aeiou')}{rng.choice('xyz')}{rng.choice('aeiou')}" for _ in range(n)]
    passage, items = fresh(70), [(k, " ".join(fresh(20))) for k in range(5)]
    texts = []
    for i in range(120):
        words = fresh(rng.randrange(5, 120))
        if i % 5 == 0:
            words[3:3] = passage
        if i % 7 == 0:
            words += items[i % 5][1].split()
        texts.append(" ".join(words))
    texts += [texts[3], texts[3] + " end", "12 34 !", "", None, " ".join(passage), " ".join(passage)]
    rows = list(enumerate(texts))
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}-{name}")
        docs = spark.read.parquet(f"{tmp_path}/{k}-{name}")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    got = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}
    assert got == plain(rows, items)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(got)


def test_language_stage_rejects_by_score(spark, docs_of):
    rng = random.Random(2)
    sounds = {"aa": "the of and to in is that it was for", "bb": "der die und das nicht mit sich auf für ist"}
    rows = [(i, " ".join(rng.choice(sounds[k].split()) for _ in range(rng.randrange(5, 40))), k) for i in range(300) for k in [rng.choice(list(sounds))]]
    strange = [" ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(60)) for letters in ("бгджзклмнп", "日本語中文字", "qxzjvkwy")]
    rows += [(1000 + k, t, None) for k, t in enumerate([*strange, "12 34 !", None])]
    rows += [(2000, "Avec.", None), (2001, "日本", None)]  # too short to tell
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs_of(*rows), "").collect()}
    assert kept == {*range(300), 2000, 2001}


def test_language_stage_without_labels_keeps_what_has_letters(spark, docs_of):
    kept = corpus_pipeline.identify_language(spark, docs_of((1, "some text"), (2, "é"), (3, "12 !"), (4, None), (5, "日本")), "")
    assert {r.doc_id for r in kept.collect()} == {1, 2, 5}


def test_language_stage_learns_from_every_labelled_row(spark, docs_of, monkeypatch):
    rng = random.Random(3)
    crc = __import__("zlib").crc32
    held = [i for i in range(400) if crc(str(i).encode()) % 5 == 0]
    words = {"aa": "the of and to in is that it was for".split(), "cc": "жил был один старый царь с тремя сыновьями".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k) for i in range(400) for k in ["cc" if i in held else "aa"]]
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs_of(*rows), "").collect()}
    assert kept == set(range(400))  # one of the languages is labelled only in rows that op10 holds out
    seen, predict = [], language_id.predict
    monkeypatch.setattr(language_id, "predict", lambda docs, *more, **named: seen.append(docs.count()) or predict(docs, *more, **named))
    many = spark.range(20_400).select(F.col("id").alias("doc_id"), F.lit("the of").alias("text"), F.lit("aa").alias("lang"))
    language_id.margins(many, language_id.fit(docs_of(*rows)))
    assert seen == [20_400]
