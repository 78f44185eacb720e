"""One very long text among short ones, in every operator that reads whole texts."""

import hashlib
import random

import pytest

from threadloom.llm import chat, decontaminate, media, near_dedup, packing, substring_dedup, token_counts

RNG = random.Random(11)
WORDS = [f"w{RNG.randrange(10**7)}" for _ in range(120_000)]
LONG = " ".join(WORDS)
NEAR = " ".join(["other", *WORDS[1:]])


@pytest.fixture
def docs(docs_of):
    return docs_of((1, LONG), (2, NEAR), (3, "short text"), (4, " ".join(WORDS[70_000:70_060])))


def test_near_duplicates_and_passages(docs):
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 3, 85).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removal_report(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (120_000, 0, sha(LONG)), 2: (120_000, 119_999, sha("other")), 3: (2, 0, sha("short text")), 4: (60, 60, sha(""))}


def test_leaks(spark, docs):
    items = spark.createDataFrame([(1, " ".join(WORDS[90_000:90_030])), (2, "not there at all or so")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.containment) for r in decontaminate.find_leaks(docs, items).collect()) == [(1, 1, 1.0), (2, 1, 1.0)]


def test_tokens(docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()}[1] == len(Tokenizer.from_file(path).encode(LONG, add_special_tokens=False).ids)
    pieces = [r for r in packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect() if r.doc_id == 1]
    assert sorted(r.piece for r in pieces) == list(range(len(pieces))) and sum(r.length for r in pieces) == max(r.start + r.length for r in pieces) and sorted(r.length for r in pieces)[1:] == [2048] * (len(pieces) - 1)


def test_media_and_chat(spark, docs):
    r = media.media_report(docs).where("doc_id = 1").first()
    assert r.n_bytes == len(LONG) and r.payload_sha256 == hashlib.sha256(LONG.encode() + b" " * (-len(LONG) % 192)).hexdigest()
    rows = spark.createDataFrame([(4, 0, "user", LONG), (4, 1, "assistant", NEAR + "<>[]\\")], "conv_id long, turn long, role string, text string")
    got = chat.conversation_report(chat.turn_records(rows)).first()
    assert got.n_turns == 2 and got.loss_sha256 == hashlib.sha256((NEAR + "<>[]\\").encode()).hexdigest()
