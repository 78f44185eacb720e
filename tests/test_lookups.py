"""Work per row that must not grow with a dictionary or with small batches."""

import random
import re

import pandas as pd
from pyspark.sql import functions as F

from threadloom.functions import tokens as TK
from threadloom.operators import annotate


def test_a_lookup_searches_few_words(spark):
    words = [(f"ab{i}", f"<{i}>") for i in range(3000)]
    frame = spark.createDataFrame(words, "token string, meaning string")
    row, _ = TK._buckets(frame, 3000)
    assert row.select(F.array_max(F.transform("__words", F.size))).first()[0] < 12
    rows = spark.createDataFrame([(1, "ab7 AB2999 none can't @ab1"), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.normal for r in TK.normalize_tweets(rows, frame, "id").collect()}
    assert got == {1: "<7> <2999> none can not @USER", 2: None, 3: ""}


def test_runs_kept_whole_give_the_same_tokens(spark):
    rng = random.Random(1)
    parts = ["a", "é", "x9", "'", "-", "@", "#", ".", ",", "1", "22", "%", " ", "a@b.co", "well-known", "http://x.y", "+", "_", "/", ":)", "don't"]
    texts = ["".join(rng.choice(parts) for _ in range(30)) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert TK._TOKEN != TK.TOKEN and not re.search(r"\+\+\+", TK._TOKEN)
    plain = F.regexp_extract_all("text", F.lit(TK.TOKEN), F.lit(0))
    assert frame.where(~TK.tokens(F.col("text")).eqNullSafe(plain)).count() == 0


def test_rows_come_back_as_many_at_once_as_they_were_sent():
    class Prompts:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):  # noqa: N802
            return run

    run = annotate.annotate(Prompts(), annotate.fake_backend, batch=1)
    frame = pd.DataFrame({"tweet_id": ["1", "2", "3"], "text": list("abc"), "prompt": [f'Tweet ID: {i}\nTweet Text: "a"\n\nProvide' for i in range(3)]})
    out = list(run(iter([frame, frame])))
    assert [len(x) for x in out] == [3, 3] and all(x["ok"].all() for x in out)
