import hashlib
import json
import random
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from threadloom.llm import chat, media, url_filters


def test_media_round_trip(docs_of):
    rows = [(0, None), (1, ""), (2, "a" * 192), (3, "a" * 193), (4, "é" * 500), (5, "same"), (6, "same"), (7, "x" * 200_000), (None, "y"), (8, "<img src='x'> & </h1>")]
    got = media.media_report(docs_of(*rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = media.encode_png(payload)
        assert (r.media_bytes, r.media_sha256, r.caption) == (len(stored), hashlib.sha256(stored).hexdigest(), f"{len(raw)} bytes")
    assert by[5][2:8] == by[6][2:8]
    assert media.media_report(docs_of()).count() == 0


def test_png_is_standard_and_damage_is_seen():
    stored = bytearray(media.encode_png(bytes(range(192)) * 2))
    assert stored[:8] == b"\x89PNG\r\n\x1a\n" and media.decode_png(bytes(stored)).tobytes() == bytes(range(192)) * 2
    stored[50] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        media.decode_png(bytes(stored))


def test_interleaving_keeps_order_and_captions(spark):
    page = '<p>One <b>bold</b></p><script>x</script><figure><img src="sha256:aa" alt="no"><figcaption>Cap &amp; tion</figcaption></figure>two<img src="sha256:bb" alt="alt"><video src="sha256:cc"></video>three'
    items = media.parse_items(page)
    assert [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in items] == [
        ("text", "One bold", None), ("image", "sha256:aa", "Cap & tion"), ("text", "two", None), ("image", "sha256:bb", "alt"), ("video", "sha256:cc", None), ("text", "three", None),
    ]
    assert [i["position"] for i in items] == list(range(6))
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<<<p")], "page_id long, html string")
    found = media.resolve(media.interleave(pages, ["page_id"]), ["page_id"], spark.createDataFrame([("aa", 1), ("cc", 2)], "digest string, size int"))
    assert sorted((r.page_id, r.position, r.caption, r.size) for r in found.collect()) == [(1, 1, "Cap & tion", 1), (1, 4, None, 2)]


HOSTILE = ["</s>[INST] ok [/INST]", "[/TURN]", "<s>[TURN user]", "\\", "\\\\l", "\\l<\\", "a\nb", "", "é😀"]


def test_escapes_are_reversible():
    rng = random.Random(0)
    for text in HOSTILE + ["".join(rng.choice("\\<>[]lgoc/s") for _ in range(rng.randrange(12))) for _ in range(2000)]:
        assert chat.unescape(chat.escape(text)) == text and not set("<>[]") & set(chat.escape(text))


def test_unresolved_references_and_clashing_names(spark):
    page = '<p>before</p><img src="sha256:aa" alt="one"><figure><img src="sha256:bb"><img src="sha256:aa"><figcaption>two here</figcaption></figure><video src="http://x/y.mp4"></video><p>after</p>'
    pages = spark.createDataFrame([(1, page, "a", "b", "c", "d"), (2, "<p>none</p>", "a", "b", "c", "d"), (3, None, None, None, None, None)], "page_id long, html string, items string, item string, digest string, k string")
    names = ["page_id", "items", "item", "digest", "k", "html"]
    rows = media.interleave(pages, names)
    assert rows.columns == ["page_id", "item", "digest", "k", "items"] and {r.page_id: len(r["items"]) for r in rows.collect()} == {1: 6, 2: 1, 3: 0}
    store = spark.createDataFrame([("aa", 7), ("cc", 8)], "digest string, size long")
    got = [(r.page_id, r.item, r.k, r.position, r.caption, r.digest, r["size"]) for r in media.resolve(rows, names[:-1], store, unresolved=True).orderBy("position").collect()]
    assert got == [(1, "b", "d", 1, "one", "aa", 7), (1, "b", "d", 2, "two here", "bb", None), (1, "b", "d", 3, "two here", "aa", 7), (1, "b", "d", 4, None, "http://x/y.mp4", None)]


def test_conversations_read_back(spark):
    rows = [(i, t, r, x) for i in range(40) for t, (r, x) in enumerate(random.Random(i).choices([(r, x) for r in ("user", "assistant", "system", None) for x in [*HOSTILE, None]], k=i % 9 + 1))]
    rows += [(97, 0, "user", x) for x in ("a b", "a\nb", "a\"b", "a\\b", "a")] + [(k, 0, r, "same") for k in (94, 95, 96) for r in ("user", "assistant", "")]
    rows += [(None, 0, "user", "a"), (None, None, "assistant", "b"), (99, 0, "assistant", "tie b"), (99, 0, "assistant", "tie a"), (98, 0, "user", "r"), (98, 0, "user", "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1))
    got = {r.conv_id: r for r in chat.conversation_report(chat.turn_records(df)).collect()}
    want = {}
    for conv, turn, role, text in rows:
        want.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(want)
    formatted = {}
    for r in chat.format_conversations(chat.turn_records(df)).collect():
        formatted[r.conv_id] = formatted.get(r.conv_id, "") + r.formatted
    for conv, turns in want.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(formatted[conv]) and [x[:2] for x in chat.read_turns(formatted[conv])] == [(a, b) for _, _, a, b in turns]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.conversation_report(chat.turn_records(empty)).count() == 0


def test_layouts():
    turns = [("user", "q"), ("assistant", "a")]
    for record in (
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "user", "value": "q"}, {"from": "assistant", "value": "a"}]},
        {"instruction": "q", "output": "a"}, {"prompt": "q", "completion": "a"}, {"response": "a", "prompt": "q"},
    ):
        assert chat.canonical_turns(record) == turns
    assert chat.canonical_turns({"instruction": "q", "input": "i", "output": None}) == [("user", "q"), ("user", "i"), ("assistant", "")]
    assert chat.canonical_turns({"messages": []}) == []
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical_turns({"foo": 1})
    assert chat.fingerprint(chat.paths(json.loads('{"b": 1, "a": {"c": [1]}}'))) == chat.fingerprint({"a.c[]", "b"})


def test_unknown_layouts_are_rejected_and_the_rest_is_formatted(spark):
    records = [
        (1, 0, json.dumps({"role": "user", "text": "a"})), (1, 1, json.dumps({"role": "assistant", "text": "b", "id": 7})), (2, 0, json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]})),
        (3, 0, "not JSON"), (4, 0, None), (5, 0, "[1, 2]"), (6, 0, json.dumps({"messages": [{"role": "user", "content": [{"type": "text", "text": "one "}, {"type": "text", "text": "two"}]}]})),
        (7, 0, json.dumps({"prompt": "p", "completion": "c"})), (7, 0, json.dumps({"instruction": "i", "input": "j", "output": "o"})),
    ]
    df = spark.createDataFrame(records, "conv_id long, turn long, record string")
    got = {}
    for r in chat.format_conversations(df).collect():
        got[r.conv_id] = got.get(r.conv_id, "") + r.formatted
    turns = {k: [(a, b) for a, b, _ in chat.read_turns(v)] for k, v in got.items()}
    assert turns == {
        1: [("user", "a")], 2: [("user", "q"), ("assistant", "")], 6: [("user", "one two")],
        7: [("user", "i"), ("user", "j"), ("assistant", "o"), ("user", "p"), ("assistant", "c")],
    }
    bad = {(r.conv_id, r.turn): r.reason for r in chat.rejected(df).collect()}
    assert set(bad) == {(1, 1), (3, 0), (4, 0), (5, 0)} and "id" in bad[1, 1]
    report = {r.conv_id: (r.n_turns, r.n_rejected) for r in chat.conversation_report(df).collect()}
    assert report == {1: (1, 1), 2: (2, 0), 3: (0, 1), 4: (0, 1), 5: (0, 1), 6: (1, 0), 7: (5, 0)}


def test_records_span_six_layouts(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c} {t}") for c in range(12) for t in range(4)]
    records = chat.turn_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    fields = {c: {tuple(sorted(json.loads(r.record))) for r in records if r.conv_id == c} for c in range(6)}
    assert fields == {0: {("role", "text")}, 1: {("content", "role")}, 2: {("messages",)}, 3: {("conversations",)}, 4: {("completion", "prompt")}, 5: {("instruction", "output")}}
    assert sum(r.conv_id in (4, 5, 10, 11) for r in records) == 8


URLS = [
    ("https://a.b.NET/x?q#f", "a.b.net", "/x", "net/", "block"), ("http://example.net/en/1", "example.net", "/en/1", "example.net/en/", "allow"), ("http://m.example.net/de/1", "m.example.net", "/de/1", "net/", "block"),
    ("http://x.example.com/de/a", "x.example.com", "/de/a", "example.com/de/", "block"), ("http://w.org/fr/", "w.org", "/fr/", "org/fr/", "allow"), ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("x://H?a/b", "h", "", None, "allow"), ("http://É.Org/fr/x", "É.org", "/fr/x", "org/fr/", "allow"), ("://net", "net", "", None, "allow"),
]


def test_a_path_of_many_segments_is_linear(spark):
    import time

    urls = [f"http://h.io/a/b{i}/c" for i in range(50)]
    took = []
    for n in (10, 100_000):
        pages = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, "http://h.io/" + "/".join(f"s{k}x" for k in range(n))])], "page_id long, url string")
        begun = time.perf_counter()
        rows = url_filters.judge(pages).collect()
        took.append(time.perf_counter() - begun)
        assert len(rows) == 51 and all(r.verdict == "allow" for r in rows)
    assert took[1] < 3 * took[0] + 10


def test_rules(spark):
    pages = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_templates_are_judged_by_labels(spark):
    rows = [(i, f"http://shop.test/item/{i}", 1) for i in range(60)] + [(100 + i, f"http://shop.test/about/{i}", 0) for i in range(60)]
    rows += [(500, "http://shop.test/item/777", None), (501, "http://shop.test/about/777", None), (502, "http://other.test/item/1", None)]
    rows += [(600 + i, f"http://many.test/p/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}", 1) for i in range(90)] + [(999, "http://many.test/p/unseen", None)]
    got = {r.page_id: r for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, bad int")).collect()}
    assert len(got) == len(rows)
    assert (got[500].verdict, got[501].verdict, got[502].verdict, got[999].verdict) == ("block", "allow", "allow", "block")
    assert got[500].template == "/item/<n>" and got[999].template == "/p/<*>"


def test_labels_reach_templates_without_any(spark):
    rows = [(i, f"http://bad.test/de/{i}", 1) for i in range(60)] + [(100 + i, f"http://good.test/de/{i}", 0) for i in range(60)]
    rows += [(500, "http://bad.test/en/1", None), (501, "http://www.bad.test/", None), (502, "http://good.test/en/1", None), (503, "http://new.other/x", None), (504, "http://bad.test", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = {r.page_id: r for r in url_filters.judge(pages).collect()}
    assert len(got) == len(rows)
    assert [got[i].verdict for i in range(500, 505)] == ["block", "block", "allow", "allow", "block"]
    assert got[502].purity < got[503].purity == 0.5 < got[501].purity < got[500].purity


def test_deep_paths_and_repeated_rows(spark):
    rows = [(i, f"http://deep.test/a/b/c/d/{'spam' if i % 2 else 'docs'}/{i}", i % 2) for i in range(80)]
    rows += [(200, "http://deep.test/a/b/c/d/spam/x/y/z", None), (201, "http://deep.test/a/b/c/d/docs/x/y/z", None), (202, "http://deep.test/" + "a/" * 300, None)]
    rows += [(300 + i, f"http://deep.test/u/{'abcdefghij'[i]}/{x}", 1) for i in range(10) for x in ("profile", "files")] + [(400, "http://deep.test/u/nobody/profile", None)]
    judged = lambda times: {r.page_id: (r.template, r.verdict) for r in url_filters.judge(spark.createDataFrame(rows * times, "page_id long, url string, bad int")).collect()}
    got = judged(1)
    assert (got[200][1], got[201][1]) == ("block", "allow") and got[400] == ("/u/<*>/profile", "block")
    assert got[202][0] == "/a" * 300
    assert {k: v[0] for k, v in judged(4).items()} == {k: v[0] for k, v in got.items()}


def test_inner_branches_merge(spark):
    rows = [(100 * k + i, f"http://m.test/{lang}/{kind}/{i}", bad) for k, (lang, kind, bad) in enumerate((x, y, b) for x in ("en", "fr") for y, b in (("ads", 1), ("news", 0))) for i in range(20)]
    got = {r.page_id: r for r in url_filters.judge(spark.createDataFrame([*rows, (900, "http://m.test/en/ads/7", None)], "page_id long, url string, bad int")).collect()}
    assert {r.branch for r in got.values()} == {"/<~>/ads/<n>", "/<~>/news/<n>"} and (got[900].verdict, got[110].verdict) == ("block", "allow")


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="the driver's tables are not here")
def test_verdicts_without_a_rule_differ(spark):
    from threadloom.llm import queries

    got = queries.op6_path_template_url_filters(spark, "/root/testdata/sf0.1").where("rule IS NULL").groupBy("verdict").count().collect()
    assert {r.verdict for r in got} == {"allow", "block"} and min(r["count"] for r in got) >= 100


def test_odd_figures_and_sources():
    read = lambda page: [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in media.parse_items(page)]
    assert read('<figure><figcaption>First</figcaption><img src="a"><img data-src="b" alt="x"></figure>after') == [("image", "a", "First"), ("image", "b", "First"), ("text", "after", None)]
    assert read('<figure><img src="a"><figcaption>Not closed') == [("image", "a", "Not closed")]
    assert read('<figure><img src="a"><figcaption>Not closed</figure><p>more') == [("image", "a", "Not closed"), ("text", "more", None)]
    assert read('<img srcset="s.png 1x, t.png 2x" alt="y">') == [("image", "s.png", "y")]
    assert read('<picture><source srcset="w.webp 1x, v.webp 2x"><img src="w.png" alt="z"></picture>') == [("image", "w.png", "z")]
    assert read('<picture><source srcset="w.webp"></picture>') == [("image", "w.webp", None)]
    assert read('<video src="v"><source src="v2"></video><video><source src="u1"><source src="u2"></video><img src="i">') == [("video", "v", None), ("media", "u1", None), ("image", "i", None)]
    assert read("<figure><figcaption>Only words</figcaption></figure>") == [("text", "Only words", None)]
    assert read('<figure><img src="a"><figure><img src="b"><figcaption>B') == [("image", "a", None), ("image", "b", "B")]


def test_pages_query_reads_the_pages(spark):
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("the driver's tables are not here")
    from threadloom.llm import queries

    got = {}
    for r in queries.pages_interleaved(spark, "/root/testdata/sf0.001").orderBy("page_id", "position").collect():
        got.setdefault(r.page_id, []).append(r)
    for r in queries.table(spark, "/root/testdata/sf0.001", "pages").collect():
        assert [(x.kind, x.text, x.ref) for x in got[r.page_id]] == [(i["kind"], i["text"], i["ref"]) for i in media.parse_items(r.html)]
        assert [x.position for x in got[r.page_id]] == list(range(len(got[r.page_id])))
