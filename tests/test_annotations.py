import json

import pytest
from pyspark.sql import functions as F

from threadloom.functions import annotations as A
from threadloom.operators import annotate, perspectives

TEXT = "Climate change is real and urgent"


def answer(**changes):
    item = {"label": "Epistemic/Factual", "evidence_span": "Climate change is real", "confidence": 0.9, "rationale": "States it as a fact."} | changes
    return json.dumps({"1": [{k: v for k, v in item.items() if v != "drop"}]})


CASES = [
    ("valid", answer(), True, None, []),
    ("fenced", f"Here:\n```json\n{answer()}\n```", True, None, []),
    ("fuzzy", answer(evidence_span="Climate  change"), True, None, []),
    ("span", answer(evidence_span="not there"), False, None, ["evidence"]),
    ("range", answer(confidence=1.5), False, None, ["confidence"]),
    ("true", answer(confidence=True), True, None, []),
    ("string", answer(confidence="0.5"), False, None, ["confidence"]),
    ("null", answer(confidence=None), False, None, ["confidence"]),
    ("zero", answer(confidence=0), True, None, []),
    ("pipe", answer(label="AOT|Experiential"), False, None, ["label"]),
    ("short", answer(rationale="123456789"), False, None, ["rationale"]),
    ("ten", answer(rationale="1234567890"), True, None, []),
    ("missing", answer(rationale="drop"), False, None, ["missing_rationale"]),
    ("prose", "This is not JSON at all!", False, "parse_error", []),
    ("empty", "", False, "no_json", []),
    ("two", '{"a": [], "b": []}', False, "not_one_key", []),
    ("text", '{"a": "b"}', False, "not_a_list", []),
    ("list", "[1]", False, "not_a_dictionary", []),
]


@pytest.mark.parametrize(("name", "response", "valid", "error", "errors"), CASES)
def test_strict_validation(spark, name, response, valid, error, errors):
    row = spark.createDataFrame([(response, TEXT)], "r string, t string").select(A.validate_response(F.col("r"), F.col("t"), strict=True).alias("v")).first().v
    assert (row.is_valid, row.error, sorted(e for item in row.errors for e in item)) == (valid, error, errors)


def test_lenient_validation_keeps_structure(spark):
    row = spark.createDataFrame([(answer(confidence=2), TEXT)], "r string, t string").select(A.validate_response(F.col("r"), F.col("t")).alias("v")).first().v
    assert row.is_valid and row.annotations == []


def test_prompts(spark):
    rows = spark.createDataFrame([("7", "text with {tweet_id} braces"), ("8", "long " * 20)], "tweet_id string, text string")
    for r in perspectives.build_prompts(rows).withColumn("fits", A.prompt_fits(F.col("prompt"))).collect():
        assert r.tweet_id in r.prompt and r.text in r.prompt and r.fits
    longer = rows.select(A.augment_prompt(F.lit("x " + A.MARKER), F.lit(None).cast("string"), F.lit("s")).alias("p")).first().p
    assert "Title: N/A" in longer and longer.endswith(A.MARKER)


def test_aggregate(spark):
    rows = spark.createDataFrame([("1", "AOT", 0.7), ("1", "AOT", 0.9), ("1", "Experiential", 0.69), ("1", "other", 1.0), ("2", None, None)], "tweet_id string, label string, confidence double")
    got = {r.tweet_id: r for r in perspectives.aggregate(rows).collect()}
    assert (got["1"].aot, got["1"].max_conf_aot, got["1"].count_aot, got["1"].experiential, got["1"].num_perspectives, got["1"].avg_confidence, got["1"].total_annotations) == (1, 0.9, 2, 0, 1, 0.8, 4)
    assert (got["2"].num_perspectives, got["2"].avg_confidence, got["2"].total_annotations) == (0, 0.0, 1)


def test_failing_backend(spark):
    def broken():
        def answer_(prompts):
            raise RuntimeError("out of memory")

        return answer_

    rows = spark.createDataFrame([("1", TEXT)], "tweet_id string, text string")
    row = annotate.run(rows, broken, retries=2, delay=0.0).first()
    assert (row.is_valid, row.error, row.response) == (False, "inference_failed", "out of memory")
    stats = annotate.inference_stats(annotate.annotate(perspectives.build_prompts(rows), annotate.fake_backend)).first()
    assert (stats.requests, stats.success_rate) == (1, 100.0)


def test_outcome_sink(spark, tmp_path):
    from threadloom.sources.tables import read_csv, write_csv, write_outcome, missing_inputs, read_annotations

    rows = spark.createDataFrame([("1", True), ("2", False)], "tweet_id string, is_valid boolean")
    assert write_outcome(rows, str(tmp_path / "a")) and spark.read.json(str(tmp_path / "a/failed")).count() == 1
    assert not write_outcome(rows.where("is_valid"), str(tmp_path / "b"))
    text = spark.createDataFrame([("1", "none"), ("2", 'a "quoted"\nline, NA'), ("3", None)], "tweet_id string, text string")
    write_csv(text.coalesce(1), str(tmp_path / "c"))
    back = read_csv(spark, str(tmp_path / "c"), text.schema, multi_line=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, text.collect()))
    assert missing_inputs(spark, [str(tmp_path / "c"), str(tmp_path / "nowhere")]) == [str(tmp_path / "nowhere")]
    (tmp_path / "x.json").write_text(answer())
    assert read_annotations(spark, str(tmp_path / "x.json")).first().tweet_id == "1"
