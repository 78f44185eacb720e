"""Parallel reading of large JSON objects."""

import json
import random

import pytest

from threadloom.sources import json_objects, tables


def tricky(rng, n):
    keys = ["", "a,b", 'q"uote', "back\\slash\\", "{", "}]", "[,", "é😀", "tab\t", 'ends \\"', "line\nline", "annotations"]
    text = lambda: "".join(rng.choice(['"', "\\", ",", "{", "}", "[", "]", ":", " ", "x", "é", "\n", "😀"]) for _ in range(rng.randrange(12)))
    value = lambda deep: rng.choice([None, True, 1.5, text(), [], {}, [text(), {"k": text()}], {"a": {"b": [1, text()]}}, [value(deep - 1)] if deep else 3])
    return {k: value(2) for k in keys + [f"key{i}{text()}" for i in range(n)]}


def read(spark, path, member=None):
    return {r.key: json.loads(r.value) for r in json_objects.read_object(spark, path, member).collect()}


@pytest.mark.parametrize("indent", [None, 1])
def test_every_key_once(spark, tmp_path, indent):
    rng = random.Random(4)
    one, two = tricky(rng, 300), tricky(rng, 50)
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "one.json").write_text(json.dumps(one, indent=indent, ensure_ascii=False))
    assert read(spark, str(tmp_path / "plain")) == one
    wholes = ({"annotations": two, "run": {"a": 1, "b": {"c": [2, 3]}}}, {"run": {"annotations": {"no": 1}, "b": 2}, "annotations": two, "z": 3}, {"x": [1, {"annotations": {}}], "annotations": two})
    for k, whole in enumerate(wholes if indent else wholes[1:2]):
        (tmp_path / f"m{k}.json").write_text(json.dumps(whole, indent=indent))
        assert read(spark, str(tmp_path / f"m{k}.json"), "annotations") == two
        assert read(spark, str(tmp_path / f"m{k}.json")) == whole
    assert read(spark, str(tmp_path / "m0.json"), "none such") == {}


def test_small_ranges_give_the_same(spark, tmp_path):
    rng = random.Random(7)
    one, two = tricky(rng, 120), tricky(rng, 80)
    (tmp_path / "a.json").write_text(json.dumps({"annotations": one, "n": 1}, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps({"annotations": two}, ensure_ascii=False))
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("177",):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            rows = json_objects.read_object(spark, str(tmp_path), "annotations").collect()
            got = {(r.file.rsplit("/", 1)[-1], r.key): json.loads(r.value) for r in rows}
            assert len(rows) == len(got) and got == {("a.json", k): v for k, v in one.items()} | {("b.json", k): v for k, v in two.items()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_a_large_document_is_shared(spark, tmp_path):
    whole = {f"{i}": [{"label": "AOT", "evidence_span": f"a, {i}", "confidence": 0.5, "rationale": "x" * 20}] for i in range(100_000)}
    (tmp_path / "large.json").write_text(json.dumps(whole))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        assert spark.read.option("lineSep", ",").text(str(tmp_path)).rdd.getNumPartitions() > 8
        rows = tables.read_annotations(spark, str(tmp_path))
        assert rows.where("size(annotations) = 1 AND annotations[0].evidence_span = concat('a, ', tweet_id)").count() == 100_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("text", ["{}", " { } ", "", "\n"])
def test_empty(spark, tmp_path, text):
    (tmp_path / "e.json").write_text(text)
    assert read(spark, str(tmp_path / "e.json")) == {} == read(spark, str(tmp_path / "e.json"), "annotations")
