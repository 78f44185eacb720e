import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import near_dedup as N
from threadloom.llm import substring_dedup as S
from threadloom.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(rng):
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [edited(rng, base, rng.randrange(14)) for _ in range(150)]  # a group with links and near misses
    texts += [f"{passage} {' '.join(f'u{rng.randrange(10**6)}' for _ in range(rng.randrange(5, 60)))}" for _ in range(150)]  # a frequent passage
    texts += ["Same TEXT here\nagain", "same text  here again", "one", "One", "two words", "", None, "   ", None, " ".join(base * 200)]
    texts += [" ".join(f"x{rng.randrange(10**6)}" for _ in range(30))] * 40
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_links_all_and_only_similar_documents(docs_of, size, percent):
    rows = corpus(random.Random(size))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(docs_of(*rows), size, percent).collect()}
    assert got == brute(rows, size, percent)


def test_divided_buckets_lose_nothing(docs_of, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 20)
    rows = corpus(random.Random(8))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(docs_of(*rows), 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_a_large_bucket_loses_no_pair_that_shares_nothing_else(spark, docs_of, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 20)
    symbols = np.random.default_rng(4).integers(0, 1 << 16, (70, N.HASHES)).astype("<u2")
    symbols[:, :6] = 7  # what the frequent passage makes equal
    symbols[50] = symbols[30]
    symbols[50, [0, *(6 * c + k for c in range(1, N.CHUNKS) for k in (0, 1))]] ^= 1
    assert (symbols[30] != symbols[50]).sum() == N.RADIUS
    docs = docs_of(*[(i, "a b c d e f") for i in range(70)])
    signed = docs.select("doc_id", "text", F.lit(0).cast("long").alias("text_hash")).mapInArrow(N._signer(5), "doc_id long, text_hash long, n_shingles long, digest binary, signature binary, places binary")
    same = signed.first().digest
    classes = spark.createDataFrame([(i, bytes(same), symbols[i].tobytes(), 2) for i in range(70)], "id long, digest binary, signature binary, n long")
    found = N.link_classes(docs, signed, classes, 5, 80, N.Scratch(spark, "test-large"))
    assert {(r.id, r.component) for r in found.collect()} == {(30, 30), (50, 30)}


def test_a_crowded_bucket_is_treated_like_any_other(docs_of):
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    rows = list(enumerate(edited(rng, base, rng.randrange(4, 12)) for _ in range(300)))  # all pairs are near the limit
    for size, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(docs_of(*rows), size, percent).collect()}
        assert got == brute(rows, size, percent)


def test_bitmaps_refute_no_similar_pair():
    rng = np.random.default_rng(6)
    for n in (1, 3, 40, 500, 20_000):
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(n) > cut], rng.integers(0, 1 << 63, int(n * cut)).astype(np.uint64), base[:1]])) for cut in rng.random(20) * 0.25]
        bitmaps, sizes = [N.occupancy(s) for s in sets], np.array([len(s) for s in sets])
        i, j = np.triu_indices(20, 1)
        good = N.may_be_similar(bitmaps, sizes, i, j, 85)
        for a, b, ok in zip(i.tolist(), j.tolist(), good.tolist(), strict=True):
            common = len(np.intersect1d(sets[a], sets[b]))
            assert ok or 100 * common < 85 * (len(sets[a]) + len(sets[b]) - common)


def test_bitmaps_compared_in_pieces_give_the_same(monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 9000).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[:n][rng.random(n) > 0.1], base[:1]])) for n in rng.integers(1, 9000, 30)]
    bitmaps, sizes = [N.occupancy(s) for s in sets], np.array([len(s) for s in sets])
    i, j = np.triu_indices(30, 1)
    whole = N.may_be_similar(bitmaps, sizes, i, j, 80)
    monkeypatch.setattr(N, "COMPARED", N.MOST_PLACES // 4)
    assert 0 < whole.sum() < len(i) and (N.may_be_similar(bitmaps, sizes, i, j, 80) == whole).all()


def test_one_id_with_two_texts(docs_of):
    same, other = "a b c d e f g", "q r s t u v w x"
    got = N.near_duplicates(docs_of((1, same), (2, same), (2, other), (None, same)), 3, 85).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in got) == [("1", 1, True), ("2", 1, False), ("2", 2, True), ("None", None, True)]
    kept = N.deduplicate(docs_of((1, same), (2, same), (2, other), (None, same))).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("1", same), ("2", other), ("None", same)]


def test_near_edge_cases(docs_of):
    got = N.near_duplicates(docs_of((None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (6, None)), 3, 85).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in got) == [("5", 5, True), ("5", 5, True), ("6", 6, True), ("None", None, True), ("None", None, True)]
    assert N.near_duplicates(docs_of(), 3, 85).count() == 0
    kept = N.deduplicate(docs_of((1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, None)))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4] and "component_id" in kept.columns


def test_index_variants_meet_within_the_radius():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (200, N.HASHES)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(N.HASHES, N.RADIUS, replace=False)] ^= 1
    x, y = N.variant_keys(a).reshape(200, -1), N.variant_keys(b).reshape(200, -1)
    assert ((x == y).any(1)).all()


def removal(rows):
    first = {}
    words = {i: WORD.findall(t or "") for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def passages(rng):
    fresh = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    long, line = fresh(130), fresh(50)
    rows = []
    for _ in range(200):
        words = fresh(rng.randrange(80))
        for _ in range(rng.randrange(3)):
            low = rng.randrange(60)
            words += rng.choice([long[low : low + rng.randrange(20, 130)], line, line[:49], fresh(10)]) + fresh(rng.randrange(20))
        rows.append(rng.choice([" ", "\n", "\t "]).join(words))
    rows += [" ".join(long)] * 3 + [" ".join(["again"] * 400)] * 3 + [" ".join(["again"] * 70 + fresh(3)), "", None, "short", " ".join(line), "é " * 60, "é " * 60]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("shard", [2000, 7])
def test_removes_exactly_repeated_windows(docs_of, monkeypatch, shard):
    monkeypatch.setattr(S, "SHARD", shard)  # 7: the frequent anchors are spread over shards
    rows = passages(random.Random(2))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.removal_report(docs_of(*rows)).collect()}
    assert got == removal(rows)


def test_substring_edge_cases(docs_of):
    text = " ".join(f"w{i}" for i in range(60))
    got = S.removal_report(docs_of((None, text), (1, text), (1, text), (2, text), (3, None)))
    assert sorted((str(r.doc_id), r.n_removed) for r in got.collect()) == [("1", 0), ("1", 0), ("2", 60), ("3", 0), ("None", 0)]
    assert S.removal_report(docs_of()).count() == 0


def test_cut_texts(docs_of):
    text = " ".join(f"w{i}" for i in range(60))
    rows = {r.doc_id: r for r in S.remove_repeats(docs_of((1, text), (2, f"Start\n{text}\n\nend  here"), (3, text), (4, " a  b "), (5, None))).collect()}
    assert (rows[1].text, rows[2].text, rows[3].text, rows[4].text, rows[5].text) == (text, "Start\n\nend  here", "", " a  b ", None)
    assert [rows[i].emptied for i in range(1, 6)] == [False, False, True, False, False] and rows[2].component_id == "extra"


def test_one_id_with_two_texts_keeps_its_other_words(docs_of):
    fresh = lambda x, n: " ".join(f"{x}{i}" for i in range(n))
    same, other = fresh("w", 60), fresh("u", 80)
    got = S.removal_report(docs_of((1, same), (2, same), (2, other), (2, same), (3, other + " " + same))).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 60, 0), (2, 60, 60), (2, 60, 60), (2, 80, 0), (3, 140, 140)]


def test_columns_of_the_operators_own_names(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(1, text, "a", 7, [1]), (2, text, "b", 8, [2])], "doc_id long, text string, row string, anchor int, repeats array<int>")
    cut = {r.doc_id: r for r in S.remove_repeats(rows).collect()}
    assert (cut[2].row, cut[2].anchor, cut[2].repeats, cut[2].emptied) == ("b", 8, [2], True)


def test_fm_index_counts(rng=np.random.default_rng(5)):
    lengths = rng.integers(1, 40, 30)
    text = np.concatenate([np.append(rng.integers(1, 5, n), 0) for n in lengths])
    index = FMIndex(text, np.arange(30) * 10)
    phrase = np.repeat(np.arange(30), lengths + 1) * 10
    for _ in range(300):
        pattern = rng.integers(1, 5, 3)
        low, high = index.first[pattern[-1:]], index.first[pattern[-1:] + 1]
        for symbol in pattern[-2::-1]:
            low, high = index.extend(np.array([symbol]), low, high)
        at = [i for i in range(len(text) - 2) if (text[i : i + 3] == pattern).all()]
        assert high[0] - low[0] == len(at)
        assert sorted(index.owners(np.arange(low[0], high[0])).tolist()) == sorted(phrase[at].tolist())
