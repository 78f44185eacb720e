"""A stream of annotations that is stopped and started again, and counters taken while rows are written."""

import pathlib

import pytest
from pyspark.sql import functions as F

from threadloom.operators import annotate, perspectives, profile
from threadloom.sources import tables
from threadloom.streaming import annotation


def test_killed_and_started_again(spark, tmp_path):
    asked, records, out = tmp_path / "asked", str(tmp_path / "records"), str(tmp_path / "out")
    asked.mkdir()
    for k in range(4):
        spark.createDataFrame([(f"{k}{i}", f"text number {i} of {k}") for i in range(5)], annotation.RECORDS).coalesce(1).write.mode("append").parquet(records)

    def backend(folder=str(asked)):
        """The stand-in model, which leaves a mark for every text that it is asked for."""
        steady = annotate.fake_backend()

        def answer(prompts):
            for p in prompts:
                with open(f"{folder}/{p.partition('Tweet ID: ')[2].partition(chr(10))[0]}", "a") as f:
                    f.write("x")
            return steady(prompts)

        return answer

    def dies(number):
        if number == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        annotation.start(spark, records, out, backend, after=dies).awaitTermination()
    assert len(list(asked.iterdir())) == 10  # two batches, of which one isn't marked as done
    annotation.start(spark, records, out, backend).awaitTermination()
    done = annotation.results(spark, out).collect()
    assert len(done) == 20 == len({r.tweet_id for r in done}) and all(r.is_valid for r in done) and {r.batch for r in done} == {0, 1, 2, 3}
    assert {p.name: p.read_text() for p in asked.iterdir()} == {r.tweet_id: "x" for r in done}  # nothing twice
    annotation.start(spark, records, out, backend).awaitTermination()
    assert annotation.results(spark, out).count() == 20
    spark.createDataFrame([("new", "one more text")], annotation.RECORDS).coalesce(1).write.mode("append").parquet(records)
    annotation.start(spark, records, out, backend).awaitTermination()
    assert annotation.results(spark, out).count() == 21 and pathlib.Path(asked / "new").read_text() == "x"


def test_counters_while_writing(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i}", "a text", i % 3 == 0) for i in range(100)], "tweet_id string, text string, is_valid boolean")
    touched = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            touched.add(b.num_rows)
            yield b

    got = tables.write_counted(rows.mapInArrow(seen, rows.schema), str(tmp_path / "out"), perspectives.run_metrics(10.0, 50)).first()
    assert got.asDict() == perspectives.run_summary(rows, 10.0, 50).first().asDict() and got.successful == 34
    assert touched.value == 100 and spark.read.json(str(tmp_path / "out")).count() == 100
    assert len(profile.preprocess_metrics()) == 9 and len(perspectives.validation_metrics()) == 7
    none = tables.write_counted(rows.where(F.lit(False)), str(tmp_path / "none"), perspectives.run_metrics(1.0)).first()
    assert none.total_tweets == 0
