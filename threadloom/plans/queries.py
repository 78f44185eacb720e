"""Every registered query of the library with the DuckDB SQL that it is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import annotations as A
from ..functions import text as X
from ..functions import tokens as TK
from ..functions import urls as U
from ..functions import vectors as V
from ..operators import features, graph, metrics, perspectives, profile, relational, sampling
from ..scratch import Scratch
from ..sources import tables
from . import fixtures as T
from . import model_queries as model_queries
from . import source_queries as source_queries
from .registry import NEAREST
from .registry import ORACLE_SQL as ORACLE_SQL
from .registry import QUERIES as QUERIES
from .registry import query

_URLS = "regexp_extract_all(text, 'https?://[!$-_a-z]+')"
_WORDS = "CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END"
_DOMAIN = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\\.', '')"


def _any(column: str, values: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{v}')" for v in values) + ")"


def _url_type(url: str = "url") -> str:
    domain = _DOMAIN.replace("url", url)
    media = " OR ".join(f"ends_with(lower({url}), '{e}')" for e in U.MEDIA_EXTENSIONS)
    return (
        f"CASE WHEN {media} THEN 'media' WHEN {domain} = '' THEN 'other' WHEN {_any(domain, U.SHORTENED_DOMAINS)} THEN 'shortened' WHEN {_any(domain, U.SOCIAL_DOMAINS)} THEN 'social' "
        f"WHEN {_any(domain, U.NEWS_DOMAINS)} THEN 'news' WHEN {_any(domain, U.ACADEMIC_DOMAINS)} THEN 'academic' ELSE 'other' END"
    )


# ---- profiles


@query("votes tweets", f"SELECT regexp_extract(url, '://([^/]+)', 1) AS domain, count(*) AS n FROM (SELECT unnest({_URLS}) AS url FROM tweets) GROUP BY 1 ORDER BY n DESC, domain LIMIT 20")
def q_top_domains(spark, sf_dir):
    return profile.top_domains(T.tweets(spark, sf_dir))


@query("votes", "SELECT taco_class AS value, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM votes), 6) AS percent FROM votes GROUP BY 1")
def q_value_counts(spark, sf_dir):
    return profile.value_counts(T.votes(spark, sf_dir), "taco_class")


@query("votes", "SELECT min(n) AS min_n, max(n) AS max_n, round(max(n) / min(n)::DOUBLE, 6) AS ratio, max(n) / min(n)::DOUBLE > 3 AS imbalanced FROM (SELECT count(*) AS n FROM votes GROUP BY taco_class)")
def q_class_imbalance(spark, sf_dir):
    return profile.class_imbalance(T.votes(spark, sf_dir), "taco_class")


@query("votes tweets", f"""SELECT count(*) AS n, round(avg(length(text)), 6) AS mean_length, CAST(median(length(text)) AS DOUBLE) AS median_length, min(length(text)) AS min_length, max(length(text)) AS max_length,
    round(avg({_WORDS}), 6) AS mean_words, CAST(median({_WORDS}) AS DOUBLE) AS median_words FROM tweets WHERE text IS NOT NULL""", ints="min_length max_length")
def q_text_stats(spark, sf_dir):
    return profile.text_stats(T.tweets(spark, sf_dir))


@query("votes tweets", f"SELECT taco_class, round(avg(length(text)), 6) AS mean_length, round(avg({_WORDS}), 6) AS mean_words FROM tweets WHERE text IS NOT NULL AND taco_class IS NOT NULL GROUP BY 1")
def q_text_stats_by_class(spark, sf_dir):
    return profile.text_stats_by(T.tweets(spark, sf_dir), "taco_class")


_URL_STATS = f"count(*) FILTER (WHERE len({_URLS}) > 0) AS with_url, round(count(*) FILTER (WHERE len({_URLS}) > 0) * 100.0::DOUBLE / count(*), 6) AS percent, CAST(sum(len({_URLS})) AS BIGINT) AS n_urls, round(avg(len({_URLS})), 6) AS per_text"


@query("votes tweets", f"SELECT {_URL_STATS} FROM tweets WHERE text IS NOT NULL")
def q_url_stats(spark, sf_dir):
    return profile.url_stats(T.tweets(spark, sf_dir))


@query("votes tweets", f"SELECT taco_class, {_URL_STATS} FROM tweets WHERE text IS NOT NULL AND taco_class IS NOT NULL GROUP BY taco_class")
def q_url_stats_by_class(spark, sf_dir):
    return profile.url_stats_by(T.tweets(spark, sf_dir), "taco_class")


@query("", f"SELECT {_DOMAIN} AS domain, count(*) AS n FROM pages GROUP BY 1")
def q_domain_normalised(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").groupBy(U.extract_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


_SPECIAL = {"mention": "@[\\p{L}\\p{N}_]+", "hashtag": "#[\\p{L}\\p{N}_]+", "emoji": "[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}]"}
_MATCHES = {k: f"regexp_matches(text, '{p}')" for k, p in _SPECIAL.items()}


@query("", "SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {m}) AS n_{k}, round(count(*) FILTER (WHERE {m}) * 100.0::DOUBLE / count(*), 6) AS percent_{k}" for k, m in _MATCHES.items()) + " FROM documents WHERE text IS NOT NULL")
def q_special_chars(spark, sf_dir):
    return profile.special_chars(T.table(spark, sf_dir, "documents"))


@query("threads", """SELECT CAST(sum(top) AS BIGINT) AS top_level, CAST(sum(size - top) AS BIGINT) AS replies, count(*) AS conversations, round(avg(size), 6) AS mean_size, CAST(median(size) AS DOUBLE) AS median_size, max(size) AS max_size
    FROM (SELECT count(*) AS size, count(*) FILTER (WHERE tweet_id = conversation_id) AS top FROM threads GROUP BY conversation_id)""")
def q_thread_stats(spark, sf_dir):
    return profile.thread_stats(T.threads(spark, sf_dir))


_PROBLEMS = {"missing": "text IS NULL", "very_short": "length(text) < 5", "very_long": "length(text) > 500", "only_url": "regexp_full_match(text, '\\s*https?://.*\\s*')", "only_mention": "regexp_full_match(text, '\\s*@[\\p{L}\\p{N}_]+\\s*')"}
_PROBLEM_SUM = " + ".join(f"count(*) FILTER (WHERE {c})" for c in _PROBLEMS.values())


@query("", "SELECT " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in _PROBLEMS.items()) + f", {_PROBLEM_SUM} AS total, round(({_PROBLEM_SUM}) * 100.0::DOUBLE / count(*), 6) AS percent FROM documents")
def q_problem_rows(spark, sf_dir):
    return profile.problem_rows(T.table(spark, sf_dir, "documents"))


# ---- preprocessing

_CLEAN = "trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '^RT\\s+@[\\p{L}\\p{N}_]+:\\s*', ''), '\\s+', ' ', 'g'))"
_REASON = "CASE WHEN clean IS NULL OR clean = '' THEN 'missing_text' WHEN length(clean) < 5 THEN 'too_short' WHEN length(clean) > 500 THEN 'too_long' ELSE 'valid' END"
_TAGS = "regexp_extract_all(text, '#[\\p{L}\\p{N}_]+')"
_RECORDS = f", c AS (SELECT *, {_CLEAN} AS clean FROM tweets), records AS (SELECT *, {_REASON} AS reason, regexp_extract_all(clean, 'https?://[!$-_a-z]+') AS urls FROM c)"


def _records(spark, sf_dir):
    return X.preprocess(T.tweets(spark, sf_dir))


@query("votes tweets", _RECORDS + f""" SELECT tweet_id, text AS text_original, clean AS text_cleaned, taco_class, topic, confidence, reason = 'valid' AS is_valid, reason AS validation_reason, length(clean) AS text_length,
    {_WORDS.replace('text', 'clean')} AS word_count, len(urls) > 0 AS has_urls, len(urls) AS url_count, array_to_string({_TAGS}, ' ') AS hashtags, len({_TAGS}) AS hashtag_count FROM records""", ints="text_length word_count url_count hashtag_count")
def q_preprocess(spark, sf_dir):
    return _records(spark, sf_dir).drop("url_metadata").withColumn("hashtags", F.array_join("hashtags", " "))


@query("votes tweets", _RECORDS + """ SELECT count(*) AS total_processed, count(*) FILTER (WHERE reason = 'valid') AS cleaned, count(*) FILTER (WHERE reason = 'too_short') AS too_short, count(*) FILTER (WHERE reason = 'too_long') AS too_long,
    count(*) FILTER (WHERE reason = 'missing_text') AS missing_text, count(*) FILTER (WHERE len(urls) > 0) AS urls_found, count(*) FILTER (WHERE regexp_matches(clean, '@[\\p{L}\\p{N}_]+')) AS mentions_found,
    count(*) FILTER (WHERE regexp_matches(text, '#[\\p{L}\\p{N}_]+')) AS hashtags_found, round(count(*) FILTER (WHERE reason = 'valid') * 100.0::DOUBLE / count(*), 6) AS percent_cleaned FROM records""")
def q_preprocess_counters(spark, sf_dir):
    """Counters of the records, taken while these are written."""
    return tables.write_counted(_records(spark, sf_dir), f"{Scratch(spark, 'counters').root}/records", profile.preprocess_metrics())


@query("votes tweets", _RECORDS + f", u AS (SELECT unnest(urls) AS url FROM records) SELECT {_url_type()} AS type, count(*) AS n FROM u GROUP BY 1")
def q_url_types(spark, sf_dir):
    return profile.url_types(_records(spark, sf_dir))


_FETCH = f"CASE WHEN type IN ('media', 'social') THEN FALSE WHEN taco_class = 'reason' THEN TRUE WHEN taco_class = 'statement' THEN {_any('lower(clean)', U.EPISTEMIC_MARKERS)} WHEN taco_class = 'notification' THEN type IN ('news', 'academic') ELSE FALSE END"
_SHORT = "regexp_matches(url, '" + "(?:https?://)?(?:" + "|".join(U.SHORTENED_DOMAINS) + ")/\\S+" + "')"


@query("votes tweets", _RECORDS + f""", u AS (SELECT tweet_id, taco_class, clean, unnest(urls) AS url FROM records), t AS (SELECT *, {_url_type()} AS type FROM u)
    SELECT tweet_id, url, type, {_DOMAIN} AS domain, {_SHORT} AS is_shortened, {_FETCH} AS should_fetch FROM t""")
def q_should_fetch(spark, sf_dir):
    return X.url_rows(_records(spark, sf_dir), "tweet_id")


@query("votes tweets", f"""SELECT tweet_id, regexp_replace(text, 'https?://[!$-_a-z]+', '[URL]', 'g') AS masked, trim(regexp_replace(regexp_replace(text, 'https?://[!$-_a-z]+', '', 'g'), '\\s+', ' ', 'g')) AS bare,
    array_to_string({_URLS}, ' ') AS urls FROM tweets""")
def q_strip_urls(spark, sf_dir):
    parts = U.text_without_urls(F.col("text"))
    return T.tweets(spark, sf_dir).select("tweet_id", U.remove_urls(F.col("text")).alias("masked"), parts["text"].alias("bare"), F.array_join(parts["urls"], " ").alias("urls"))


@query("", f"SELECT doc_id, array_to_string({_TAGS}, ' ') AS hashtags, len({_TAGS}) AS n FROM (SELECT doc_id, text || ' #tag_' || coalesce(lang, '') || ' #é' AS text FROM documents) WHERE len({_TAGS}) > 0", ints="n")
def q_hashtags(spark, sf_dir):
    tags = X.extract_hashtags(F.concat("text", F.lit(" #tag_"), F.coalesce("lang", F.lit("")), F.lit(" #é")))
    return T.table(spark, sf_dir, "documents").select("doc_id", F.array_join(tags, " ").alias("hashtags"), F.size(tags).alias("n")).where("n > 0")


@query("votes tweets", _RECORDS + " SELECT taco_class, count(*) AS n FROM records WHERE reason = 'valid' GROUP BY 1")
def q_valid_by_class(spark, sf_dir):
    return profile.valid_by_class(_records(spark, sf_dir))


@query("", "SELECT page_id, replace(replace(replace(replace(replace(replace(replace(url || ' &amp; &copy; &middot; &quot;', '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&amp;', '&') AS decoded FROM pages")
def q_entities(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select("page_id", X.decode_entities(F.concat("url", F.lit(" &amp; &copy; &middot; &quot;"))).alias("decoded"))


@query("votes tweets", "SELECT tweet_id, md5(regexp_replace(regexp_replace(txt, '^RT\\s+@[\\p{L}\\p{N}_]+:\\s*', ''), '@[\\p{L}\\p{N}_]+', '[USER]', 'g')) AS masked FROM (SELECT tweet_id, 'RT @user_' || tweet_id || ': hi @b ' || text AS txt FROM tweets)")
def q_mentions(spark, sf_dir):
    """Each text, retweeted and with one mention more, without its retweet mark and names."""
    text = F.concat(F.lit("RT @user_"), "tweet_id", F.lit(": hi @b "), "text")
    return T.tweets(spark, sf_dir).select("tweet_id", F.md5(X.mask_mentions(X.strip_retweet(text))).alias("masked"))


_MARKERS = ", ".join(f"'{m}'" for m in X.DISCOURSE_MARKERS)


@query("", f"SELECT doc_id, len(list_filter(string_split(lower(text), ' '), lambda w: w IN ({_MARKERS}))) AS n FROM documents", ints="n")
def q_markers(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", F.size(X.discourse_markers(F.col("text"))).alias("n"))


@query("votes tweets", f"SELECT tweet_id, CAST(len(list_filter({_URLS}, lambda u: NOT contains(CASE WHEN length(u) % 3 = 0 THEN 'https://twitter.com/x' ELSE u END, 'twitter.com'))) > 0 AS INT) AS external FROM tweets")
def q_external_urls(spark, sf_dir):
    urls = F.array_distinct(U.extract_urls(F.col("text")))
    leads = F.map_from_entries(F.transform(urls, lambda u: F.struct(u, F.when(F.length(u) % 3 == 0, "https://twitter.com/x").otherwise(u))))
    return T.tweets(spark, sf_dir).select("tweet_id", U.has_external_url(F.col("text"), leads).alias("external"))


_PLAIN = f"regexp_replace(regexp_replace(text, 'https?://[!$-_a-z]+', '', 'g'), '{TK.EMOJI_SEQUENCE}', chr(19968), 'g')"
_WIDE = f"len(regexp_extract_all({_PLAIN}, '[^\\x{{0}}-\\x{{10FF}}\\x{{2000}}-\\x{{200D}}\\x{{2010}}-\\x{{201F}}\\x{{2032}}-\\x{{2037}}]'))"
_INFORMATION = f", i AS (SELECT *, length({_PLAIN}) + {_WIDE} + 23 * len({_URLS}) AS weighted_length, len({_URLS}) AS url_count, len(regexp_extract_all(text, '{_SPECIAL['emoji']}')) AS emoji_count, length(text) - length(replace(text, '#', '')) AS hashtags, length(text) - length(replace(text, '@', '')) AS mentions, len(list_filter(string_split(lower(text), ' '), lambda w: w IN ({_MARKERS}))) AS markers FROM tweets)"


@query("votes tweets", _INFORMATION + " SELECT tweet_id, weighted_length, url_count, emoji_count, hashtags, mentions, markers FROM i", ints="weighted_length url_count emoji_count hashtags mentions markers")
def q_text_information(spark, sf_dir):
    return T.tweets(spark, sf_dir).select("tweet_id", *X.text_information(F.col("text")))


# Emoji sequences and what each counts: a family, a flag, a tone, a keycap, a heart with its variation, a flag of tags, two letters that are no flag.
_SEQUENCES = (("\U0001F468\u200D\U0001F469\u200D\U0001F467", 2), ("\U0001F1E9\U0001F1EA\U0001F1EB\U0001F1F7", 4), ("\U0001F44D\U0001F3FD", 2), ("1\uFE0F\u20E3", 2), ("\u2764\uFE0F", 2),
    ("\U0001F3F4\U000E0067\U000E0062\U000E007F", 2), ("\u65e5\u672c", 4), ("caf\u00e9", 4))


@query("", f"SELECT doc_id, CAST(length(regexp_replace(coalesce(text, ''), '[^a-z]', '', 'g')) + CASE doc_id % {len(_SEQUENCES)} " + " ".join(f"WHEN {k} THEN {n}" for k, (_, n) in enumerate(_SEQUENCES)) + " END AS INTEGER) AS weighted_length FROM documents")
def q_emoji_length(spark, sf_dir):
    """The weighted length of each text's letters with a sequence of emoji (or what is none) in their midst."""
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z]", "")
    some = F.array(*[F.lit(x) for x, _ in _SEQUENCES])[F.col("doc_id") % len(_SEQUENCES)]
    half = (F.length(letters) / 2).cast("int")
    text = F.concat(F.substr(letters, F.lit(1), half), some, F.substr(letters, half + 1))
    rows = T.table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return rows.select("doc_id", X.text_information(F.col("text"))[0].cast("int").alias("weighted_length"))


@query("votes tweets", _INFORMATION + " SELECT round(avg(weighted_length), 6) AS mean_length, round_even(100.0::DOUBLE * count(*) FILTER (WHERE url_count > 0) / count(*), 2) AS percent_url, round_even(100.0::DOUBLE * count(*) FILTER (WHERE markers > 0) / count(*), 2) AS percent_marker, round_even(100.0::DOUBLE * count(*) FILTER (WHERE hashtags > 0) / count(*), 2) AS percent_hashtag FROM i WHERE taco_class = 'statement'")
def q_describe_class(spark, sf_dir):
    rows = T.tweets(spark, sf_dir).where("taco_class = 'statement'").select(*X.text_information(F.col("text")))
    return metrics.describe_group(rows)


@query("votes", "SELECT tweet_id, CASE WHEN doc_id % 5 = 0 THEN 'None' ELSE lower(trim('  ' || upper(taco_class) || ' ')) END AS class FROM votes")
def q_normalise_class(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("  "), F.upper("taco_class"), F.lit(" ")))
    return T.votes(spark, sf_dir).select("tweet_id", relational.normalise_class(raw).alias("class"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _token_sql(known: str) -> str:
    """SQL of a text's normal form; ``known`` is what the dictionary has for lower(t)."""
    short = " ".join(f"WHEN ends_with(lower(t), {_quoted(k)}) AND length(t) > 1 THEN left(t, length(t) - {len(k)}) || {_quoted(v)}" for k, v in TK.CONTRACTIONS.items())
    one = f"CASE WHEN starts_with(t, '@') AND length(t) > 1 THEN '@USER' WHEN starts_with(lower(t), 'http') OR starts_with(lower(t), 'www') THEN 'HTTPURL' WHEN {known} IS NOT NULL THEN {known} {short} ELSE t END"
    plain = "replace(replace(text, chr(8217), ''''), chr(8230), '...')"
    out = f"array_to_string(list_transform(regexp_extract_all({plain}, {_quoted(TK.TOKEN)}), lambda t: {one}), ' ')"
    for old, new in TK.SPACING:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


_EMOJI_SQL = "CASE t " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in TK.EMOJI_NAMES.items()) + " END"


@query("votes tweets", f"SELECT tweet_id, {_token_sql(_EMOJI_SQL)} AS normal FROM tweets")
def q_tweet_normalise(spark, sf_dir):
    return T.tweets(spark, sf_dir).select("tweet_id", TK.normalize_tweet(F.col("text")).alias("normal"))


@query("votes tweets", f""", words AS (SELECT token, '<' || min(label) || '>' AS meaning FROM (SELECT unnest(string_split(lower(text), ' ')) AS token, 'b' || item_id % 7 AS label FROM benchmark) WHERE token <> '' GROUP BY token),
    w AS (SELECT map(list(token), list(meaning)) AS m FROM words) SELECT tweet_id, {_token_sql('m[lower(t)]')} AS normal FROM tweets, w""")
def q_dictionary(spark, sf_dir):
    """Tokens that a table has (here the words of all benchmark items) replaced by their meanings there."""
    items = T.table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("token"), F.concat(F.lit("<b"), F.col("item_id") % 7, F.lit(">")).alias("meaning"))
    return TK.normalize_tweets(T.tweets(spark, sf_dir), items.where("token <> ''"), "tweet_id")


# ---- joins and sets


@query("votes tweets threads", "SELECT v.tweet_id, v.taco_class, v.confidence, t.text, h.conversation_id, h.parent_id FROM votes v LEFT JOIN tweets t ON v.tweet_id = t.tweet_id LEFT JOIN threads h ON v.tweet_id = h.tweet_id")
def q_left_chain(spark, sf_dir):
    return relational.merge_tweets(T.votes(spark, sf_dir).drop("doc_id"), T.tweets(spark, sf_dir).select("tweet_id", "text"), T.threads(spark, sf_dir))


_NULL_TOPIC = "CASE WHEN topic = 'src1' THEN NULL ELSE topic END"


@query("votes tweets", f"""SELECT a.tweet_id, a.topic, a.confidence AS confidence_taco, b.confidence AS confidence_persp FROM (SELECT tweet_id, {_NULL_TOPIC} AS topic, confidence FROM tweets) a
    JOIN (SELECT tweet_id, {_NULL_TOPIC} AS topic, confidence * 2 AS confidence FROM tweets) b ON a.tweet_id = b.tweet_id AND a.topic IS NOT DISTINCT FROM b.topic""")
def q_two_key_inner(spark, sf_dir):
    rows = T.tweets(spark, sf_dir).select("tweet_id", F.when(F.col("topic") != "src1", F.col("topic")).alias("topic"), "confidence")
    return relational.join_features(rows, rows.withColumn("confidence", F.col("confidence") * 2))


@query("votes threads", "SELECT tweet_id, taco_class FROM votes WHERE tweet_id IN (SELECT tweet_id FROM threads)")
def q_semi(spark, sf_dir):
    return T.votes(spark, sf_dir).join(T.threads(spark, sf_dir), "tweet_id", "left_semi").select("tweet_id", "taco_class")


@query("votes threads", "SELECT tweet_id, taco_class FROM votes WHERE tweet_id NOT IN (SELECT tweet_id FROM threads)")
def q_anti(spark, sf_dir):
    return sampling.remaining(T.votes(spark, sf_dir), T.threads(spark, sf_dir)).select("tweet_id", "taco_class")


@query("votes", "SELECT tweet_id, taco_class FROM votes WHERE taco_class <> 'none' AND taco_class NOT IN ('notification')")
def q_class_filter(spark, sf_dir):
    kind = F.col("taco_class")
    return T.votes(spark, sf_dir).where(relational.not_equal(kind, "none") & relational.not_in(kind, ["notification"])).select("tweet_id", "taco_class")


_RUNS = "SELECT tweet_id, array_agg(label ORDER BY id) AS labels FROM annotations WHERE tweet_id % 2 = 0 GROUP BY tweet_id"


@query("annotations", """, s AS (SELECT tweet_id, count(*) AS n FROM annotations GROUP BY 1), f AS (SELECT DISTINCT tweet_id FROM annotations WHERE id % 5 = 0 AND confidence > 0.9)
    SELECT coalesce(s.tweet_id, f.tweet_id) AS tweet_id, CASE WHEN f.tweet_id IS NOT NULL THEN 0 ELSE s.n END AS n FROM s FULL JOIN f ON s.tweet_id = f.tweet_id""")
def q_overlay_merge(spark, sf_dir):
    rows = T.annotations(spark, sf_dir)
    success = rows.groupBy("tweet_id").agg(F.collect_list("label").alias("annotations"))
    failed = rows.where("id % 5 = 0 AND confidence > 0.9").select("tweet_id")
    return relational.overlay(success, failed).select("tweet_id", F.size("annotations").cast("long").alias("n"))


@query("votes tweets", "SELECT tweet_id, topic, CAST(dense_rank() OVER (ORDER BY topic) - 1 AS INT) AS topic_code, CAST((SELECT count(DISTINCT topic) FROM tweets) AS INT) AS n_codes FROM tweets")
def q_category_codes(spark, sf_dir):
    return relational.category_codes(T.tweets(spark, sf_dir).select("tweet_id", "topic"), "topic")


@query("votes tweets", """, c AS (SELECT tweet_id, dense_rank() OVER (ORDER BY topic) - 1 AS code, (SELECT count(DISTINCT topic) FROM tweets) AS n FROM tweets)
    SELECT tweet_id, place, CAST(CASE WHEN place = code THEN 1 ELSE 0 END AS DOUBLE) AS value FROM (SELECT tweet_id, code, unnest(range(n)) AS place FROM c)""")
def q_one_hot(spark, sf_dir):
    rows = relational.category_codes(T.tweets(spark, sf_dir).select("tweet_id", "topic"), "topic")
    return rows.select("tweet_id", F.posexplode(V.one_hot(F.col("topic_code"), F.col("n_codes"))).alias("place", "value")).withColumn("place", F.col("place").cast("long"))


# ---- sampling

_N = 100
_QUOTA = f""", k AS (SELECT taco_class, count(*) AS available FROM votes GROUP BY 1), q AS (SELECT *, greatest(1, CAST(round_even(available * {_N} / (SELECT sum(available) FROM k)::DOUBLE, 0) AS BIGINT)) AS q FROM k),
    p AS (SELECT *, sum(q) OVER () - {_N} AS diff, row_number() OVER o AS place, coalesce(sum(q - 1) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spare FROM q WINDOW o AS (ORDER BY q DESC, available DESC, taco_class)),
    quotas AS (SELECT taco_class, available, CAST(CASE WHEN diff > 0 THEN q - greatest(0, least(q - 1, diff - spare)) WHEN diff < 0 AND place = 1 THEN q - diff ELSE q END AS BIGINT) AS quota FROM p)"""


@query("votes", _QUOTA + " SELECT * FROM quotas")
def q_stratified_quota(spark, sf_dir):
    return sampling.quotas(T.votes(spark, sf_dir), _N)


_SAMPLE = _QUOTA + """, ranked AS (SELECT v.*, quota, row_number() OVER (PARTITION BY v.taco_class ORDER BY md5(v.tweet_id || ':42'), v.tweet_id) AS rank FROM votes v JOIN quotas USING (taco_class)), sample AS (SELECT * FROM ranked WHERE rank <= quota)"""


@query("votes", _SAMPLE + " SELECT tweet_id, taco_class FROM sample")
def q_stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(T.votes(spark, sf_dir), _N).select("tweet_id", "taco_class")


@query("votes", _SAMPLE.replace("votes", "chosen").replace(", k AS", ", chosen AS (SELECT * FROM votes WHERE confidence >= 0.2), k AS", 1) + " SELECT tweet_id, taco_class FROM sample")
def q_test_mode(spark, sf_dir):
    """Selection in test mode: a stratified sample of the valid rows."""
    records = T.votes(spark, sf_dir).withColumn("is_valid", F.col("confidence") >= 0.2)
    return sampling.select_rows(records, test_mode=True, n=_N).select("tweet_id", "taco_class")


@query("votes", "SELECT tweet_id, taco_class, CAST((row_number() OVER (PARTITION BY taco_class ORDER BY md5(tweet_id || ':123456789'), tweet_id) - 1) % 10 AS INT) AS fold FROM votes")
def q_kfold(spark, sf_dir):
    return sampling.stratified_folds(T.votes(spark, sf_dir)).select("tweet_id", "taco_class", "fold")


@query("votes", "SELECT tweet_id, md5(tweet_id || ':42') AS place FROM votes ORDER BY place, tweet_id")
def q_shuffle(spark, sf_dir):
    return sampling.shuffled(T.votes(spark, sf_dir)).select("tweet_id", sampling.digest("tweet_id", 42).alias("place"))


@query("votes", "SELECT tweet_id, row_number() OVER (ORDER BY md5(tweet_id || ':42'), tweet_id) <= CAST(floor(0.1 * (SELECT count(*) FROM votes)) AS BIGINT) AS is_validation FROM votes")
def q_train_val(spark, sf_dir):
    return sampling.train_validation(T.votes(spark, sf_dir)).select("tweet_id", "is_validation")


def _quality(name: str, table: str) -> str:
    return f"""SELECT 'class:' || taco_class AS measure, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM {table}), 6) AS {name} FROM {table} GROUP BY taco_class
    UNION ALL SELECT 'mean_length', round(avg(length(text)), 6) FROM {table} UNION ALL SELECT 'median_length', CAST(median(length(text)) AS DOUBLE) FROM {table}
    UNION ALL SELECT 'url_percent', round(count(*) FILTER (WHERE len({_URLS}) > 0) * 100.0::DOUBLE / count(*), 6) FROM {table}"""


@query("votes tweets", _SAMPLE + f", s AS (SELECT t.* FROM tweets t JOIN sample USING (tweet_id)), a AS ({_quality('sample', 's')}), b AS ({_quality('full', 'tweets')}) SELECT measure, a.sample, b.full FROM b LEFT JOIN a USING (measure)".replace("AS full", 'AS "full"').replace("b.full", 'b."full"'))
def q_sample_quality(spark, sf_dir):
    rows = T.tweets(spark, sf_dir)
    return profile.sample_quality(sampling.stratified_sample(rows, _N), rows)


# ---- annotations


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def prompt_sql(text: str = "text") -> str:
    """The prompt of (tweet_id, text) from the template's parts."""
    head, _, tail = A.TEMPLATE.partition("{tweet_text}")
    before, _, after = head.partition("{tweet_id}")
    return f"{_sql_text(before)} || tweet_id || {_sql_text(after)} || {text} || {_sql_text(tail)}"


@query("votes tweets", f"SELECT tweet_id, md5(p) AS digest, length(p) AS n, length(p) / 4.0 <= 4000 AS fits FROM (SELECT tweet_id, {prompt_sql()} AS p FROM tweets)", ints="n")
def q_prompts(spark, sf_dir):
    prompts = perspectives.build_prompts(T.tweets(spark, sf_dir))
    return prompts.select("tweet_id", F.md5("prompt").alias("digest"), F.length("prompt").alias("n"), A.prompt_fits(F.col("prompt")).alias("fits"))


@query("votes tweets", f"SELECT tweet_id, md5(replace({prompt_sql()}, {_sql_text(A.MARKER)}, " + " || ".join(["'Linked content:' || chr(10) || 'Title: '", "CASE WHEN length(text) % 2 = 0 THEN topic ELSE 'N/A' END", "chr(10) || 'Summary: '", "CASE WHEN length(text) % 3 = 0 THEN tweet_id ELSE 'N/A' END", f"chr(10) || chr(10) || {_sql_text(A.MARKER)}"]) + f")) AS digest, {_sql_text(A.SYSTEM_MESSAGE)} AS system FROM tweets")
def q_augmented_prompts(spark, sf_dir):
    rows = perspectives.build_prompts(T.tweets(spark, sf_dir)).join(T.tweets(spark, sf_dir).select("tweet_id", "topic"), "tweet_id")
    title, summary = F.when(F.length("text") % 2 == 0, F.col("topic")), F.when(F.length("text") % 3 == 0, F.col("tweet_id"))
    return rows.select("tweet_id", F.md5(A.augment_prompt(F.col("prompt"), title, summary)).alias("digest"), F.lit(A.SYSTEM_MESSAGE).alias("system"))


def _responses(spark, sf_dir):
    """Model answers of eight kinds by id: valid, fenced, and six that break a rule."""
    rows = T.annotations(spark, sf_dir).withColumn("text", F.concat(F.lit("text of tweet "), "tweet_id"))
    item = F.concat(F.lit('{"label": "'), "label", F.lit('", "evidence_span": "'), F.when(F.col("id") % 8 == 2, "elsewhere").otherwise("text of"), F.lit('", "confidence": '), F.when(F.col("id") % 8 == 3, "1.5").otherwise(F.col("confidence").cast("string")), F.lit(', "rationale": "'), F.when(F.col("id") % 8 == 4, "short").otherwise("long enough to pass"), F.lit('"}'))
    body = F.concat(F.lit('{"'), "tweet_id", F.lit('": ['), item, F.lit("]}"))
    response = F.when(F.col("id") % 8 == 7, "").when(F.col("id") % 8 == 5, "no JSON at all").when(F.col("id") % 8 == 6, F.concat(F.lit('{"a": 1, "b": '), item, F.lit("}"))).when(F.col("id") % 8 == 1, F.concat(F.lit("Sure!\n```json\n"), body, F.lit("\n```"))).otherwise(body)
    return rows.select("id", "tweet_id", "label", "confidence", "text", response.alias("response"))


_KNOWN = ", ".join(f"'{x}'" for x in A.LABELS)
_VALID = f", r AS (SELECT *, id % 8 AS kind, id % 8 NOT IN (2, 3, 4, 5, 6, 7) AND label IN ({_KNOWN}) AS good FROM annotations)"


@query("annotations", _VALID + " SELECT id, tweet_id, kind NOT IN (5, 6, 7) AS is_valid, CASE kind WHEN 5 THEN 'parse_error' WHEN 6 THEN 'not_one_key' WHEN 7 THEN 'no_json' END AS error, CASE WHEN good THEN 1 ELSE 0 END AS n, CASE WHEN good THEN label END AS label, CASE WHEN good THEN confidence END AS confidence FROM r")
def q_validate_annotations(spark, sf_dir):
    done = perspectives.validate(_responses(spark, sf_dir).drop("label", "confidence"))
    first = F.get("annotations", F.lit(0))
    return done.select("id", "tweet_id", "is_valid", "error", F.size("annotations").alias("n"), first["label"].alias("label"), first["confidence"].alias("confidence"))


@query("annotations", _VALID + """ SELECT count(*) AS total_validated, count(*) FILTER (WHERE good) AS valid, count(*) FILTER (WHERE NOT good AND kind NOT IN (5, 6, 7)) AS invalid, count(*) FILTER (WHERE kind = 7) AS no_json, count(*) FILTER (WHERE kind IN (5, 6)) AS invalid_json_structure,
    count(*) FILTER (WHERE NOT good AND kind NOT IN (5, 6, 7)) AS invalid_annotation_fields, round(count(*) FILTER (WHERE good) * 100.0::DOUBLE / count(*), 6) AS validation_rate FROM r""")
def q_validation_stats(spark, sf_dir):
    """Counters of the validated answers, taken while these are written."""
    done = perspectives.validate(_responses(spark, sf_dir).drop("label", "confidence"), strict=True)
    return tables.write_counted(done, f"{Scratch(spark, 'counters').root}/validated", perspectives.validation_metrics())


def _features_sql(key: str = "tweet_id") -> str:
    own = [(c, f"(label = '{x}' AND confidence >= 0.7)") for c, x in zip(A.LABEL_COLUMNS, A.LABELS, strict=True)]
    taken = f"(label IN ({_KNOWN}) AND confidence >= 0.7)"
    parts = [f"max(CASE WHEN {c} THEN 1 ELSE 0 END) AS {k}" for k, c in own] + [f"coalesce(max(CASE WHEN {c} THEN confidence END), 0.0) AS max_conf_{k}" for k, c in own] + [f"count(*) FILTER (WHERE {c}) AS count_{k}" for k, c in own]
    return f"SELECT {key}, {', '.join(parts)}, count(DISTINCT CASE WHEN {taken} THEN label END) AS num_perspectives, round(coalesce(avg(CASE WHEN {taken} THEN confidence END), 0.0), 6) AS avg_confidence, count(*) AS total_annotations FROM annotations GROUP BY {key}"


@query("annotations", _features_sql())
def q_multilabel(spark, sf_dir):
    return perspectives.aggregate(T.annotations(spark, sf_dir))


_FEATURE_COLUMNS = [*A.LABEL_COLUMNS, *[f"max_conf_{c}" for c in A.LABEL_COLUMNS], *[f"count_{c}" for c in A.LABEL_COLUMNS], "num_perspectives", "avg_confidence", "total_annotations"]
_ENRICHED = f", f AS ({_features_sql()}), e AS (SELECT t.tweet_id, t.taco_class, t.topic, t.text, length(t.text) AS text_length, {_WORDS.replace('text', 't.text')} AS word_count, CAST(contains(lower(t.text), 'http') AS INT) AS has_url, " + ", ".join(f"coalesce(f.{c}, 0) AS {c}" for c in _FEATURE_COLUMNS) + " FROM tweets t LEFT JOIN f USING (tweet_id))"
_LONG = ", l AS (" + " UNION ALL ".join(f"SELECT taco_class, '{c}' AS perspective, {c} AS present, max_conf_{c} AS confidence FROM e" for c in A.LABEL_COLUMNS) + ")"
_SHARES = "CAST(sum(present) AS BIGINT) AS n, round(sum(present) * 100.0::DOUBLE / count(*), 6) AS percent, round(coalesce(avg(CASE WHEN present = 1 THEN confidence END), 0.0), 6) AS mean_confidence"


def _enriched(spark, sf_dir):
    return perspectives.enrich(T.tweets(spark, sf_dir), T.annotations(spark, sf_dir))


@query("votes tweets annotations", _ENRICHED + " SELECT * FROM e", ints="text_length word_count")
def q_enriched(spark, sf_dir):
    return _enriched(spark, sf_dir)


@query("votes tweets annotations", _ENRICHED + _LONG + f" SELECT perspective, {_SHARES} FROM l GROUP BY 1")
def q_prevalence(spark, sf_dir):
    return perspectives.prevalence(_enriched(spark, sf_dir))


@query("votes tweets annotations", _ENRICHED + " SELECT taco_class, count(*) AS n, round(avg(num_perspectives), 6) AS mean_perspectives FROM e GROUP BY 1")
def q_class_perspective(spark, sf_dir):
    return perspectives.by_class(_enriched(spark, sf_dir))


@query("votes tweets annotations", _ENRICHED + _LONG + f" SELECT taco_class, perspective, count(*) AS total, {_SHARES} FROM l GROUP BY 1, 2")
def q_class_breakdown(spark, sf_dir):
    return perspectives.class_breakdown(_enriched(spark, sf_dir))


# ---- graph

_DEPTH = ", d(tweet_id, conversation_id, depth) AS (SELECT tweet_id, conversation_id, 0 FROM threads WHERE parent_id IS NULL UNION ALL SELECT t.tweet_id, t.conversation_id, d.depth + 1 FROM threads t JOIN d ON t.parent_id = d.tweet_id)"


@query("threads", _DEPTH + " SELECT tweet_id, depth FROM d", recursive=True)
def q_depth(spark, sf_dir):
    return graph.reply_depth(T.threads(spark, sf_dir))


@query("threads", _DEPTH + " SELECT tweet_id, round(depth / (SELECT max(depth) FROM d)::DOUBLE, 6) AS depth_scaled FROM d", recursive=True)
def q_depth_scaled(spark, sf_dir):
    scaled = graph.max_scaled(graph.reply_depth(T.threads(spark, sf_dir)), "depth")
    return scaled.select("tweet_id", F.round("depth_scaled", 6).alias("depth_scaled"))


_REPLY = "SELECT t.parent_id AS a, t.tweet_id AS b FROM threads t JOIN threads p ON p.tweet_id = t.parent_id WHERE t.parent_id <> t.tweet_id"
_CONV = "SELECT t.conversation_id AS a, t.tweet_id AS b FROM threads t JOIN threads p ON p.tweet_id = t.conversation_id WHERE t.conversation_id <> t.tweet_id"


def _both(sql: str, kind: str) -> str:
    return f"SELECT a AS src, b AS dst, '{kind}' AS kind FROM ({sql}) UNION ALL SELECT b, a, '{kind}' FROM ({sql})"


@query("threads", _both(_REPLY, "reply"))
def q_reply_edges(spark, sf_dir):
    return graph.reply_edges(T.threads(spark, sf_dir))


@query("threads", _both(_CONV, "conversation"))
def q_conv_edges(spark, sf_dir):
    return graph.conversation_edges(T.threads(spark, sf_dir))


_COS = NEAREST


@query("vectors", _COS + " SELECT src, dst, round(similarity, 6) AS similarity FROM near WHERE rank <= 3")
def q_knn(spark, sf_dir):
    near = graph.nearest_neighbours(T.vectors(spark, sf_dir), 3, 0.4)
    return near.select("src", "dst", F.round("similarity", 6).alias("similarity"))


@query("vectors", _COS + " SELECT src, dst, 'similar' AS kind FROM near WHERE rank <= 3 UNION ALL SELECT dst, src, 'similar' FROM near WHERE rank <= 3")
def q_knn_edges(spark, sf_dir):
    return graph.neighbour_edges(T.vectors(spark, sf_dir), 3, 0.4)


@query("threads vectors", _COS + f" {_both(_REPLY, 'reply')} UNION ALL {_both(_CONV, 'conversation')} UNION ALL SELECT CAST(src AS VARCHAR), CAST(dst AS VARCHAR), 'similar' FROM near WHERE rank <= 3 UNION ALL SELECT CAST(dst AS VARCHAR), CAST(src AS VARCHAR), 'similar' FROM near WHERE rank <= 3")
def q_all_edges(spark, sf_dir):
    nearest = graph.neighbour_edges(T.vectors(spark, sf_dir), 3, 0.4)
    strings = nearest.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "kind")
    rows = T.threads(spark, sf_dir)
    return graph.reply_edges(rows).unionByName(graph.conversation_edges(rows)).unionByName(strings)


@query("threads", "SELECT tweet_id, row_number() OVER (ORDER BY tweet_id) - 1 AS idx FROM threads")
def q_vertex_index(spark, sf_dir):
    return graph.vertex_index(T.threads(spark, sf_dir).select("tweet_id"), range_rows=50)


_TRAIN = f", v AS (SELECT tweet_id AS id, CAST(tweet_id AS BIGINT) % 5 <> 0 AS is_train FROM threads), e AS ({_both(_REPLY, 'reply')}), t AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM v WHERE is_train)"


def _split(spark, sf_dir):
    return T.threads(spark, sf_dir).select(F.col("tweet_id").alias("id"), (F.col("tweet_id").cast("long") % 5 != 0).alias("is_train"))


@query("threads", _TRAIN + " SELECT a.idx AS src_idx, b.idx AS dst_idx FROM e JOIN t a ON e.src = a.id JOIN t b ON e.dst = b.id")
def q_induced_subgraph(spark, sf_dir):
    return graph.induced_subgraph(_split(spark, sf_dir), graph.reply_edges(T.threads(spark, sf_dir)))[1]


_SIMPLE = f", e AS (SELECT src, dst FROM near WHERE rank <= 3 UNION ALL SELECT dst, src FROM near WHERE rank <= 3), g AS (SELECT DISTINCT src AS x, dst AS y FROM e)"


def _near_graph(spark, sf_dir):
    rows = T.vectors(spark, sf_dir)
    return rows.select("id"), graph.neighbour_edges(rows, 3, 0.4)


@query("vectors", _COS + _SIMPLE + " SELECT n.id, count(g.y) AS degree FROM n LEFT JOIN g ON g.x = n.id GROUP BY n.id")
def q_degree(spark, sf_dir):
    return graph.degrees(*_near_graph(spark, sf_dir))


@query("vectors", _COS + _SIMPLE + ", r(id, other) AS (SELECT id, id FROM n UNION SELECT r.id, g.y FROM r JOIN g ON g.x = r.other) SELECT id, min(other) AS component FROM r GROUP BY id", recursive=True)
def q_components(spark, sf_dir):
    return graph.connected_components(*_near_graph(spark, sf_dir))


_TRIANGLES = ", c AS (SELECT a.x AS id, count(*) / 2 AS k FROM g a JOIN g b ON a.y = b.x JOIN g d ON b.y = d.x AND d.y = a.x GROUP BY a.x), deg AS (SELECT n.id, count(g.y) AS degree FROM n LEFT JOIN g ON g.x = n.id GROUP BY n.id), cl AS (SELECT deg.id, CAST(coalesce(k, 0) AS BIGINT) AS triangles, degree, round(CASE WHEN degree < 2 THEN 0.0 ELSE 2.0 * coalesce(k, 0) / (degree * (degree - 1)) END::DOUBLE, 6) AS coefficient FROM deg LEFT JOIN c ON c.id = deg.id)"


@query("vectors", _COS + _SIMPLE + _TRIANGLES + " SELECT id, triangles, coefficient FROM cl")
def q_clustering(spark, sf_dir):
    return graph.clustering(*_near_graph(spark, sf_dir))


@query("vectors", _COS + _SIMPLE + _TRIANGLES + ", r(id, other) AS (SELECT id, id FROM n UNION SELECT r.id, g.y FROM r JOIN g ON g.x = r.other), k AS (SELECT count(DISTINCT m) AS parts FROM (SELECT id, min(other) AS m FROM r GROUP BY id)) SELECT (SELECT parts FROM k) AS n_components, (SELECT parts FROM k) = 1 AS connected, round(avg(coefficient), 6) AS average_clustering, round(avg(degree), 6) AS average_degree FROM cl", recursive=True)
def q_graph_stats(spark, sf_dir):
    return graph.graph_stats(*_near_graph(spark, sf_dir))


_CHECKED = """, x AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx, is_train, CASE WHEN id LIKE '%17' THEN is_train ELSE NOT is_train END AS is_test FROM v),
    f AS (SELECT a.idx AS s, b.idx + CASE WHEN e.src LIKE '%23' THEN 1000000000 ELSE 0 END AS d FROM e JOIN x a ON e.src = a.id JOIN x b ON e.dst = b.id),
    marked AS (SELECT 'as built' AS graph, idx, is_train <> NOT is_train AS ok, FALSE AS odd FROM x UNION ALL SELECT 'damaged', idx + CASE WHEN idx = 0 THEN (SELECT count(*) FROM x) + 5 ELSE 0 END, is_train <> is_test, TRUE FROM x),
    top AS (SELECT 'as built' AS graph, max(greatest(s, d % 1000000000)) AS top, count(*) AS n FROM f UNION ALL SELECT 'damaged', max(greatest(s, d)), count(*) FROM f)
    SELECT b.graph, count(*) AS n, any_value(t.n) AS n_edges, bool_and(ok) AS masks_cover, any_value(t.top) < count(*) AS edges_inside, max(idx) + 1 = count(*) AS index_gapless FROM marked b JOIN top t ON t.graph = b.graph GROUP BY b.graph"""


@query("threads", _TRAIN + _CHECKED)
def q_integrity(spark, sf_dir):
    """A graph as it was built, and one with masks, edges and an index that are wrong in places."""
    rows = graph.vertex_index(_split(spark, sf_dir).withColumn("is_test", ~F.col("is_train")), "id")
    _, edges = graph.induced_subgraph(rows.withColumn("is_train", F.lit(True)).drop("idx"), graph.reply_edges(T.threads(spark, sf_dir)))
    good = graph.integrity(rows, edges).withColumn("graph", F.lit("as built"))
    n, of = rows.count(), rows.select(F.col("idx").alias("src_idx"), "id")
    odd = rows.withColumns({"is_test": F.when(F.col("id").endswith("17"), F.col("is_train")).otherwise(F.col("is_test")), "idx": F.when(F.col("idx") == 0, n + 5).otherwise(F.col("idx"))})
    far = edges.join(of, "src_idx").withColumn("dst_idx", F.when(F.col("id").endswith("23"), F.col("dst_idx") + 1_000_000_000).otherwise(F.col("dst_idx")))
    return good.unionByName(graph.integrity(odd, far).withColumn("graph", F.lit("damaged")))


# ---- features and message passing


def _vector_features(spark, sf_dir):
    rows = T.vectors(spark, sf_dir)
    code = F.col("label").cast("int")
    hot = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == code % n).cast("double"))
    x = features.assemble(F.col("vector"), hot(6), hot(5), features.scalar(F.col("id") % 4), features.scalar((F.col("id") % 10) / 10.0))
    return rows.select("id", x.alias("x"))


_HOT = lambda n: f"list_transform(range({n}), lambda i: CAST(CASE WHEN i = label % {n} THEN 1 ELSE 0 END AS FLOAT))"
_ASSEMBLED = f", x AS (SELECT id, list_concat(list_concat(list_concat(vector, {_HOT(6)}), {_HOT(5)}), [CAST(id % 4 AS FLOAT), CAST((id % 10) / 10.0 AS FLOAT)]) AS x FROM vectors)"


@query("vectors", _ASSEMBLED + " SELECT name, id, place, round(CAST(value AS DOUBLE), 6) AS value FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS name, id, unnest({parts}) AS value, unnest(range(len({parts}))) AS place FROM x" for name, parts in (("all", "x"), ("embs_only", "list_slice(x, 1, 64)"), ("embs_depth", "list_concat(list_slice(x, 1, 64), list_slice(x, 76, 76))"), ("embs_persp", "list_slice(x, 1, 70)"), ("embs_topic", "list_concat(list_slice(x, 1, 64), list_slice(x, 71, 75))"), ("embs_conf", "list_concat(list_slice(x, 1, 64), list_slice(x, 77, 77))"))) + ")")
def q_feature_slice(spark, sf_dir):
    rows, out = _vector_features(spark, sf_dir), None
    for name in features.ABLATIONS:
        cut = rows.select(F.lit(name).alias("name"), "id", F.posexplode(features.select_blocks(F.col("x"), features.ABLATIONS[name], 64)).alias("at", "v"))
        part = cut.select("name", "id", F.col("at").cast("long").alias("place"), F.round(F.col("v").cast("double"), 6).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("vectors", _ASSEMBLED + ", f AS (SELECT CAST(unnest(x) AS DOUBLE) AS v, unnest(range(len(x))) AS place FROM x) SELECT round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, bool_or(isnan(v) OR isinf(v)) AS bad, count(DISTINCT CASE WHEN place BETWEEN 64 AND 69 THEN v END) AS distinct_inside FROM f")
def q_matrix_stats(spark, sf_dir):
    return features.matrix_stats(_vector_features(spark, sf_dir), "x", 64, 6)


# ---- metrics


@query("f1", "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f1")
def q_prf(spark, sf_dir):
    rows = metrics.per_class(T.predictions(spark, sf_dir))
    return rows.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("f1", "SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f1")
def q_averages(spark, sf_dir):
    return metrics.averages(T.predictions(spark, sf_dir))


_MEAN = "round(sum({0} * support) / sum(support), 4) AS {0}"


@query("f1", "SELECT CAST(label AS VARCHAR) AS name, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM f1 UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), CAST(sum(support) AS BIGINT) FROM f1 UNION ALL SELECT 'weighted avg', " + ", ".join(_MEAN.format(c) for c in ("precision", "recall", "f1")) + ", CAST(sum(support) AS BIGINT) FROM f1 UNION ALL SELECT 'accuracy', " + ", ".join(_MEAN.format("recall") for _ in range(3)) + ", CAST(sum(support) AS BIGINT) FROM f1")
def q_report(spark, sf_dir):
    return metrics.report(T.predictions(spark, sf_dir))


@query("predictions", ", l AS (SELECT y_true AS v FROM predictions UNION SELECT y_pred FROM predictions) SELECT a.v AS y_true, b.v AS y_pred, count(p.id) AS n FROM l a CROSS JOIN l b LEFT JOIN predictions p ON p.y_true = a.v AND p.y_pred = b.v GROUP BY 1, 2")
def q_confusion(spark, sf_dir):
    return metrics.confusion(T.predictions(spark, sf_dir))


@query("predictions", ", a AS (SELECT fold, round(avg(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END), 6) AS accuracy FROM predictions GROUP BY 1) SELECT round(avg(accuracy), 6) AS mean_accuracy, round(stddev_pop(accuracy), 6) AS std_accuracy FROM a")
def q_fold_mean_std(spark, sf_dir):
    return metrics.across_folds(metrics.accuracy(T.predictions(spark, sf_dir), "fold"), "accuracy")


@query("predictions", """, c AS (SELECT fold, label, sum(CASE WHEN hit THEN t ELSE 0 END) AS tp, sum(t) AS s, sum(p) AS p FROM (SELECT fold, y_true AS label, y_true = y_pred AS hit, 1 AS t, 0 AS p FROM predictions UNION ALL SELECT fold, y_pred, y_true = y_pred, 0, 1 FROM predictions) GROUP BY 1, 2)
    SELECT label, round(avg(2.0 * tp::DOUBLE / (p + s)), 6) AS mean_f1, round(stddev_pop(2.0 * tp::DOUBLE / (p + s)), 6) AS std_f1 FROM c GROUP BY 1""")
def q_class_f1_folds(spark, sf_dir):
    return metrics.class_f1_across_folds(T.predictions(spark, sf_dir))


@query("predictions", "SELECT CAST(r.i AS INT) AS label, count(p.id) AS n FROM (SELECT unnest(range(6)) AS i) r LEFT JOIN predictions p ON p.y_true = r.i GROUP BY 1")
def q_label_histogram(spark, sf_dir):
    return metrics.label_histogram(T.predictions(spark, sf_dir), "y_true", 6)


@query("predictions", ", c AS (SELECT CAST(y_true AS INT) AS label, count(*) AS n FROM predictions GROUP BY 1), w AS (SELECT *, (SELECT sum(n) FROM c) / (4.0::DOUBLE * n) AS raw FROM c) SELECT label, n, round(raw / (SELECT sum(raw) FROM w) * 4, 6) AS weight FROM w")
def q_class_weights(spark, sf_dir):
    return metrics.class_weights(T.predictions(spark, sf_dir), "y_true", 4)


@query("predictions", "SELECT id, y_true, y_pred FROM predictions WHERE y_true = 1 AND y_pred IN (0, 2)")
def q_misclassified(spark, sf_dir):
    return metrics.misclassified(T.predictions(spark, sf_dir), 1, [0, 2]).select("id", "y_true", "y_pred")
