import html

from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.functions import urls as U


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def test_url_types(spark):
    cases = {
        "https://www.nytimes.com/article/climate-change": "news", "https://arxiv.org/abs/1234.5678": "academic", "https://t.co/abc123def": "shortened",
        "https://example.com/funny.gif": "media", "https://reddit.com/x": "shortened", "https://washingtonpost.com/x": "shortened",
        "https://sciencedirect.com/x": "shortened", "https://microsoft.com/x": "shortened", "http://": "other", "https://linkedin.com/a": "social",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", U.classify_url(F.col("u")).alias("t")).collect()
    assert {r.u: r.t for r in rows} == cases


def test_should_fetch(spark):
    fetch = lambda text, label: one(spark, U.analyze_urls(F.col("t"), F.lit(label)), t=text)
    assert fetch("Study shows https://arxiv.org/abs/1234.5678", "reason").urls[0].should_fetch
    assert not fetch("see https://example.com/funny.gif", "notification").urls[0].should_fetch
    assert not fetch("no marker https://nytimes.com/a", "statement").urls[0].should_fetch
    assert fetch("a study https://nytimes.com/a", "statement").urls[0].should_fetch
    assert fetch("x https://nytimes.com/a", "notification").urls[0].should_fetch
    nothing = fetch("no URL here", "statement")
    assert (nothing.has_urls, nothing.url_count, nothing.urls) == (False, 0, [])


def test_long_and_odd_urls(spark):
    long = "http://a.b/" + "x" * 5000
    assert one(spark, U.extract_urls(F.col("t")), t=f"{long} http://c.d/#frag http://e.f/~g") == [long, "http://c.d/", "http://e.f/"]
    assert one(spark, U.extract_domain(F.col("t")), t="https://u:p@WWW.x.com:80/a") == "u:p@www.x.com:80"
    assert one(spark, U.extract_domain(F.col("t")), t="https://www.X.com/a") == "x.com"
    assert one(spark, U.extract_domain(F.col("t")), t="not a url") == ""
    assert one(spark, U.remove_urls(F.col("t"), "$1\\"), t="a http://b.c d") == "a $1\\ d"
    both = one(spark, U.text_without_urls(F.col("t")), t=" a  http://b.c \n d ")
    assert (both.text, both.urls) == ("a d", ["http://b.c"])


def test_cleaning(spark):
    assert one(spark, X.clean_whitespace(F.col("t")), t=" a  b\t\n") == "a b"
    assert one(spark, X.strip_retweet(F.col("t")), t="RT @u: RT @v: x") == "RT @v: x"
    assert one(spark, X.extract_hashtags(F.col("t")), t="#café x #a_1") == ["#café", "#a_1"]
    assert one(spark, X.decode_entities(F.col("t")), t="&amp;lt; &eacute; &#233;") == html.unescape("&amp;lt; &eacute; &#233;")
    assert one(spark, X.clean_text(F.col("t")), t="RT @u:  &amp;  b ") == "& b"
    assert one(spark, X.word_count(F.col("t")), t="  ") == 0


def test_length_bounds(spark):
    rows = spark.createDataFrame([(None,), ("",), ("a" * 4,), ("a" * 5,), ("a" * 500,), ("a" * 501,)], "t string")
    reasons = [r.x.reason for r in rows.select(X.validate_length(F.col("t")).alias("x")).collect()]
    assert reasons == ["missing_text", "missing_text", "too_short", "valid", "valid", "too_long"]


def test_preprocess(spark):
    rows = spark.createDataFrame([("1", "RT @u: hi  #Tag https://t.co/a", "reason", "t", 0.5), ("2", None, None, None, None), ("3", "", "none", "t", 1.0)], "tweet_id string, text string, taco_class string, topic string, confidence double")
    got = {r.tweet_id: r for r in X.preprocess(rows).collect()}
    assert got["1"].text_cleaned == "hi #Tag https://t.co/a" and got["1"].url_metadata[0].should_fetch and got["1"].hashtags == ["#Tag"]
    assert got["2"].validation_reason == "missing_text" and got["2"].url_count == 0 and got["2"].word_count == 0
    assert X.preprocess(rows, keep_urls=False).where("tweet_id = '1'").first().text_cleaned == "hi #Tag [URL]"
    again = X.preprocess(X.preprocess(rows).select("tweet_id", F.col("text_cleaned").alias("text"), "taco_class", "topic", "confidence"))
    assert {r.tweet_id: r.text_cleaned for r in again.collect()} == {k: r.text_cleaned for k, r in got.items()}


CASES = [
    ("@someone says can't", "@USER says cannot"), ("see https://x.y/z?q=1, now", "see HTTPURL now"), ("mail a.b@c.org at 10:30 or 1,000.5%", "mail a.b@c.org at 10:30 or 1,000.5%"),
    ("well :-) <3 ;P --> <- <b>x</b>", "well :-) <3 ;P --> <- <b> x </b>"), ("#Tag's it . . . fine!!", "#Tag ' s it . . . fine ! !"), ("mother-in-law isn’t… here", "mother-in-law is not ... here"),
    ("😂 👍🏽 🇩🇪🇫🇷 👨‍👩‍👧", ":face_with_tears_of_joy: 👍🏽 🇩🇪 🇫🇷 👨‍👩‍👧"), ("at 8 p . m . ok", "at 8 p.m. ok"), ("ünï_cødé x2 +3.5", "ünï_cødé x2 +3.5"), ("", ""), (None, None), ("@ alone", "@ alone"),
]


def test_normalisation(spark):
    from threadloom.functions import tokens

    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, text string")
    got = {r.id: r.n for r in rows.select("id", tokens.normalize_tweet(F.col("text")).alias("n")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}
    words = spark.createDataFrame([("SEE", "look"), ("see", "watch"), ("now", "then"), (None, "x"), ("fine", None), ("😂", ":joy:")] + [(f"w{i}", f"m{i}") for i in range(300)], "token string, meaning string")
    want = {i: None if w is None else w.replace("see ", "look ").replace(" now", " then").replace(":face_with_tears_of_joy:", ":joy:") for i, (_, w) in enumerate(CASES)}
    for most in (1000, 10):  # sent to all tasks, or joined
        assert {r.id: r.normal for r in tokens.normalize_tweets(rows, words, "id", most=most).collect()} == want


def test_stream(spark, tmp_path):
    from threadloom.streaming.texts import preprocess_stream, windowed_domains

    rows = spark.createDataFrame([("1", "hello https://a.b/c", "reason", "t", 0.5, "2024-01-01 00:00:00"), ("2", "x", "none", "t", 0.1, "2024-01-01 00:10:00")], "tweet_id string, text string, taco_class string, topic string, confidence double, ts string")
    rows.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    for name, frame, mode in (("records", preprocess_stream(stream), "append"), ("domains", windowed_domains(stream), "complete")):
        run = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
        run.processAllAvailable()
        run.stop()
    assert spark.table("records").where("is_valid").count() == 1
    assert [(r.domain, r.n) for r in spark.table("domains").collect()] == [("a.b", 1)]
