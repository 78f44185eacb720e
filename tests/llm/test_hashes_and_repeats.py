"""Words that a sum of powers confuses, and rows that stand thousands of times."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import arrowtext, decontaminate, near_dedup, substring_dedup, token_counts


def thue_morse(n, a, b):
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


# of 2**10 to 2**12 letters: equal sums of powers modulo 2**64, whatever the base
PAIRS = [(thue_morse(1 << k, "a", "b"), thue_morse(1 << k, "b", "a")) for k in (10, 11, 12)]


def hashes(texts):
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    return arrowtext.WordHasher(False)(data, np.array([0, len(data)])).hashes


def test_no_pair_of_words_collides():
    words = [w for p in PAIRS for w in p] + [x * n for x in "ab" for n in range(1, 40)] + [f"{a}{b}" for a in ("x" * 8, "y" * 8, "x" * 16) for b in ("", "x", "y", "xy")]
    words = sorted(set(words) | {thue_morse(n, "a", "b") for n in range(1, 1030)} | {thue_morse(n, "b", "a") for n in range(1, 1030)})
    assert len(set(hashes(words).tolist())) == len(words)
    assert (hashes(words) == np.concatenate([hashes([w]) for w in words])).all()  # alone and among others


def test_runs_of_two_words_do_not_collide():
    a, b = hashes(["one", "two"])
    spans = [np.array([(a, b)[bin(k).count("1") % 2 ^ flip] for k in range(128)], np.uint64) for flip in (0, 1)]
    one, two = (arrowtext.spans(s, np.array([0]), np.array([113])) for s in spans)
    assert one != two
    twice = arrowtext.spans(np.concatenate([spans[0], spans[0]]), np.array([3, 131, 3, 4]), np.array([90, 218, 91, 90]))
    assert twice[0] == twice[1] and len(set(twice.tolist())) == 3


@pytest.mark.parametrize("pair", PAIRS[:1])
def test_operators_tell_such_words_apart(spark, docs_of, pair):
    fill = lambda n: [f"w{k}" for k in range(n)]
    one, two = (" ".join([*fill(25), x, *fill(50)[25:49]]) for x in pair)
    docs = docs_of((1, one), (2, two))
    assert [r.n_removed for r in substring_dedup.removal_report(docs).collect()] == [0, 0]
    near = near_dedup.near_duplicates(docs_of((1, f"a {pair[0]} b"), (2, f"a {pair[1]} b")), 3, 85)
    assert {r.component_id for r in near.collect()} == {1, 2}
    items = spark.createDataFrame([(9, f"a b {pair[0]} d e")], "item_id long, text string")
    assert decontaminate.find_leaks(docs_of((1, f"a b {pair[1]} d e")), items).collect() == []


def timed(run):
    begun = time.perf_counter()
    out = run()
    return out, time.perf_counter() - begun


def test_ten_thousand_equal_rows_cost_what_one_does(spark):
    words = [f"w{k}" for k in range(200)]
    one, near = " ".join(words), " ".join([*words[:100], "new", *words[101:]])
    rows = lambda k: spark.range(k).select(F.lit(5).cast("long").alias("doc_id"), F.lit(one).alias("text")).union(
        spark.createDataFrame([(1, near), (7, "something else")], "doc_id long, text string"))
    for run in (
        lambda k: near_dedup.near_duplicates(rows(k), 3, 85).groupBy("doc_id", "component_id", "kept").count().collect(),
        lambda k: substring_dedup.removal_report(rows(k)).groupBy("doc_id", "n_removed").count().collect(),
    ):
        run(1)
        few, short = timed(lambda run=run: run(1))
        many, long = timed(lambda run=run: run(10_000))
        assert {tuple(r)[:-1] for r in few} == {tuple(r)[:-1] for r in many} and max(r["count"] for r in many) == 10_000
        assert long < 5 * short + 5


def test_repeated_rows_are_encoded_once(spark, monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    rows = spark.range(400).select(F.lit(5).cast("long").alias("doc_id"), F.lit("some words here").alias("text")).union(
        spark.createDataFrame([(1, "other"), (None, None), (None, "some words here"), (5, "other")], "doc_id long, text string"))
    written, plain = {}, token_counts.Scratch.write

    def kept(self, df, table):
        written[table] = plain(self, df, table)
        return written[table]

    monkeypatch.setattr(token_counts.Scratch, "write", kept)
    got = token_counts.count_tokens(rows, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(got) == 404 and {r.n_tokens for r in got if r.doc_id == 5} == {3, 1}
    assert written["fresh"].count() == 3
