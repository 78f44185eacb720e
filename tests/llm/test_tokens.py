import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import packing as P
from threadloom.llm import token_counts as C

tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

ODD = [
    None, "", " ", "It's ...a,b 3.14 <|endoftext|> <|EndOfText|> x<|startoftext|>y É́ é É, ½.²", "ÀÉ×÷ İSTANBUL ΣΑΣ «a».b", "a\x1cb c\x85d\xa0e", "don't. can't,'s 's",
    "naïve. Straße, ŒUVRE ǅ ẞ", "日本語. テスト 😀,😀", "a_b _. x", "A.B,C ..", "'", "x" * 5000, "two  blanks \n\n lines\t.", " . , ",
]


def texts(n=150):
    rng = random.Random(6)
    alphabet = "ab.,' É'é́<|>\n\t_1½ßİΣσ×😀\x1f A  e"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)] + ["same text. again"] * 5


def test_counts_equal_the_library(spark, docs_of, tmp_path):
    path = tokenizers.path("byte_bpe_50k.json")
    library, rows = Tokenizer.from_file(path), list(enumerate(texts()))
    expected = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = C.count_tokens(docs_of(*rows), path, 20, cache).collect()
        assert {r.doc_id: r.n_tokens for r in got} == expected and len(got) == len(rows)
        assert all(r.over_limit == (r.n_tokens > 20) and r.n_bytes == len((dict(rows)[r.doc_id] or "").encode()) for r in got)
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})  # the second run adds nothing


def test_new_texts_only_are_encoded(spark, docs_of, tmp_path):
    path, cache = tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    C.count_tokens(docs_of((1, "one text"), (2, "one text")), path, cache=cache).collect()
    got = C.count_tokens(docs_of((None, "one text"), (3, "other"), (3, "other"), (None, None)), path, cache=cache)
    assert got.count() == 4 and spark.read.parquet(cache).count() == 3
    assert C.count_tokens(docs_of(), path).count() == 0


def test_packing_places_all_ids(docs_of):
    path = tokenizers.path("word_bpe_49k.json")
    library, rng = Tokenizer.from_file(path), random.Random(2)
    rows = list(enumerate(texts() + [" ".join(rng.choice(["alpha", "beta.", "Gamma,"]) for _ in range(rng.randrange(3000))) for _ in range(60)]))
    got = P.pack(docs_of(*rows), path).collect()
    pieces, bins = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.02 * sum(r.length for r in got) / 2048 + 2


def test_empty_and_repeated_rows(docs_of):
    path = tokenizers.path("word_bpe_49k.json")
    assert P.pack(docs_of(), path).count() == 0
    rows = P.pack(docs_of((1, "a"), (1, "a"), (None, None)), path).collect()
    assert sorted(r.length for r in rows) == [1, 2, 2] and sorted(r.offset for r in rows)[0] == 0


def test_best_two_is_exact():
    rng = random.Random(1)
    for _ in range(300):
        lengths = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 25))]
        counts = np.bincount(lengths, minlength=101).tolist()
        room, beat = rng.randrange(1, 100), rng.randrange(0, 50)
        sums = [a + b for i, a in enumerate(lengths) for b in lengths[:i] if beat < a + b <= room]
        pair = P.best_two(sorted(set(lengths)), counts, room, beat)
        assert (sum(pair) if pair else None) == (max(sums) if sums else None)


def test_packing_beats_greedy():
    rng = np.random.default_rng(0)
    lengths = np.minimum(rng.lognormal(5.5, 1, 5000).astype(int) + 1, 2048)
    bins, offsets = P.pack_lengths(lengths, 2048)
    assert bins.max() + 1 <= 1.003 * -(-lengths.sum() // 2048) + 1
    assert np.bincount(bins, lengths).max() <= 2048


def test_cache_hits_keep_their_counts(spark, docs_of, tmp_path):
    path, cache = tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    C.count_tokens(docs_of((1, "one text"), (2, "two")), path, cache=cache).collect()
    odd = spark.read.parquet(cache).withColumn("n_tokens", F.col("n_tokens") + 100)  # a hit shows that the stored count is used
    odd.write.partitionBy("tokenizer").parquet(str(tmp_path / "odd"))
    got = {r.doc_id: r.n_tokens for r in C.count_tokens(docs_of((5, "one text"), (6, "new"), (7, "one text")), path, cache=str(tmp_path / "odd")).collect()}
    assert got[5] == got[7] > 100 > got[6]
    C.compact(spark, str(tmp_path / "odd"), str(tmp_path / "small"))
    assert spark.read.parquet(str(tmp_path / "small")).count() == 3


def test_repeated_rows_fall_into_even_blocks(spark):
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words").alias("text"))
    got = P.pack(docs, tokenizers.path("word_bpe_49k.json"), capacity=64, block_pieces=10_000)
    blocks = got.groupBy(F.shiftright("sequence_id", 32).alias("block")).agg(F.count("*").alias("n"), F.countDistinct("sequence_id").alias("bins"), F.max("length").alias("length")).collect()
    assert len(blocks) == 10 and sum(r.n for r in blocks) == 100_000 and max(r.n for r in blocks) < 11_000
    assert all(r.bins == -(-r.n // (64 // r.length)) for r in blocks)
