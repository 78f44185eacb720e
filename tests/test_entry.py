from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from threadloom.operators import sampling
from threadloom.session import session
from threadloom.skew import split_join


def test_oracles_belong_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert len(driver.queries()) >= 75


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the driver's tables are not here")
def test_flagship(spark):
    rows = driver.entry(spark)
    assert rows.columns == ["domain", "n"] and rows.count() > 0


def test_core_queries_do_not_need_the_optional_part(monkeypatch):
    import builtins
    import sys

    plain = builtins.__import__
    for name in [n for n in sys.modules if n.startswith("threadloom.llm") or n in ("corpus_pipeline", "xxhash")]:
        monkeypatch.delitem(sys.modules, name)

    def without(name, *rest, **more):
        if name.partition(".")[0] == "xxhash":
            raise ModuleNotFoundError(f"No module named '{name}'")
        return plain(name, *rest, **more)

    monkeypatch.setattr(builtins, "__import__", without)
    assert len(driver.queries()) >= 100 and not [n for n in driver.queries() if n.startswith("op") or n == "pipeline"]
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_hot_keys_are_split(spark):
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(900)] + [(None, -1), (5000, -2)], "key long, v long")
    side = rows.where("key IS NOT NULL AND key < 5000").groupBy("key").agg(F.count("*").alias("k"), F.max("v").alias("top"))
    for how in ("inner", "left", "left_semi"):
        want = sorted(map(str, rows.join(side.drop("k"), "key", how).collect()))
        assert sorted(map(str, split_join(rows, side, "key", 902, how=how).collect())) == want


def test_session_takes_settings(spark):
    assert session(spark__sql__shuffle__partitions="4").conf.get("spark.sql.shuffle.partitions") == "4"


def test_ranks_equal_a_plain_window(spark):
    rows = spark.createDataFrame([(str(i), "a" if i % 7 else None) for i in range(500)], "tweet_id string, kind string")
    got = {r.tweet_id: r.rank for r in sampling.digest_rank(rows, "tweet_id", 3, "kind").collect()}
    import hashlib

    for group in (True, False):
        own = sorted((hashlib.md5(f"{i}:3".encode()).hexdigest(), str(i)) for i in range(500) if bool(i % 7) is group)
        assert [got[k] for _, k in own] == list(range(1, len(own) + 1))
