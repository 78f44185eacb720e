"""Tokens of short texts by rules, and their normal forms, in Spark's own functions.

Rules are tried in order at each place: links, mail addresses, emoticons, marks of a page, arrows, mentions, tags, words with
apostrophes or hyphens inside, numbers with separators, other runs of letters and digits, emoji as long as they are, dots in a row, and any other
character alone. Dictionaries (emoji names, contractions, anything by token) come from tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..skew import let

_W = r"[\p{L}\p{M}\p{N}_]"
_PICTURE = r"[\x{203C}\x{2049}\x{2122}\x{2139}\x{2190}-\x{2BFF}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1F1E5}\x{1F200}-\x{1F3FA}\x{1F400}-\x{1FAFF}]"
_STYLED = _PICTURE + r"(?:\x{FE0F}|[\x{1F3FB}-\x{1F3FF}])?"
#: One emoji, as long as it may be: a flag's two letters, a keycap, pictures with tones or tags, joined or not.
EMOJI_SEQUENCE = r"[\x{1F1E6}-\x{1F1FF}]{2}|[0-9#*]\x{FE0F}?\x{20E3}|[\x{A9}\x{AE}]\x{FE0F}|" + _STYLED + r"[\x{E0020}-\x{E007F}]*(?:\x{200D}" + _STYLED + ")*"
RULES = (
    r"(?:https?://|www\.)[^\s]+",
    r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    r"[<>]?[:;=8][-o*']?[()\[\]DPp/\\|}{@*]+|<3",
    r"</?[A-Za-z][^<>\n]*>",
    r"-+>|<-+",
    rf"@{_W}+",
    rf"#{_W}+",
    rf"\p{{L}}{_W}*(?:['-]{_W}+)+",
    r"[+-]?\p{N}+(?:[.,/:-]\p{N}+)+%?",
    rf"{_W}+",
    EMOJI_SEQUENCE,
    r"\.(?:\s*\.)+",
    r"[^\s]",
)
TOKEN = "|".join(RULES)
#: The same for Spark's engine: a run that is followed by none of its own characters is never given back, so no word is walked through twice.
_TOKEN = "|".join(re.sub(r"(?<=[\])}+])\+", "++", r).replace("]*(?:['-]", "]*+(?:['-]") if r in RULES[1:2] + RULES[5:10] else r for r in RULES)
#: The most rows of a dictionary that a query sends to all tasks.
MOST_ROWS = 50_000

# Examples for when no table is given; full dictionaries are the caller's.
EMOJI_NAMES = {"😂": ":face_with_tears_of_joy:", "😀": ":grinning_face:", "❤": ":red_heart:", "👍": ":thumbs_up:", "🔥": ":fire:"}
CONTRACTIONS = {"can't": "cannot", "won't": "will not", "n't": " not", "'re": " are", "'ll": " will", "'ve": " have", "'m": " am"}
# Fixed values, applied in this order.
SPACING = (
    ("cannot ", "can not "), ("n't ", " n't "), ("n 't ", " n't "), ("ca n't", "can't"), ("ai n't", "ain't"),
    ("'m ", " 'm "), ("'re ", " 're "), ("'s ", " 's "), ("'ll ", " 'll "), ("'d ", " 'd "), ("'ve ", " 've "),
    (" p . m .", "  p.m."), (" p . m ", " p.m "), (" a . m .", " a.m."), (" a . m ", " a.m "),
)


def tokens(text: Column) -> Column:
    """The tokens of a text, its curved apostrophes and one-character ellipses straightened first."""
    plain = F.replace(F.replace(text, F.lit("’"), F.lit("'")), F.lit("…"), F.lit("..."))
    return F.regexp_extract_all(plain, F.lit(_TOKEN), F.lit(0))


def normal_token(token: Column, known: Column, endings: dict[str, str], low: Column | None = None) -> Column:
    """Mentions to @USER, links to HTTPURL, what the dictionary has (``known``) to its meaning, contracted endings apart. ``low`` is the token in lower case, if at hand."""
    low = F.lower(token) if low is None else low
    out = F.when(F.startswith(token, F.lit("@")) & (F.length(token) > 1), "@USER").when(F.startswith(low, F.lit("http")) | F.startswith(low, F.lit("www")), "HTTPURL").when(known.isNotNull(), known)
    if all("'" in ending for ending in endings):
        out = out.when(~F.contains(token, F.lit("'")), token)
    for ending, apart in endings.items():
        out = out.when(F.endswith(low, F.lit(ending)) & (F.length(token) > 1), F.concat(F.left(token, F.length(token) - len(ending)), F.lit(apart)))
    return out.otherwise(token)


def spaced(joined: Column) -> Column:
    """The fixed spacing of clitics and times of day, single blanks."""
    for old, new in SPACING:
        joined = F.replace(joined, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(joined, r"\s+", " "))


def normalize_tweet(text: Column, dictionary: dict[str, str] | None = None, endings: dict[str, str] | None = None) -> Column:
    """Tokens normalised one by one, joined by blanks and spaced. ``dictionary`` is a small one, held in the plan."""
    names = EMOJI_NAMES if dictionary is None else dictionary
    pairs = F.create_map(*[F.lit(x) for p in names.items() for x in p]) if names else F.create_map().cast("map<string,string>")
    one = lambda t: normal_token(t, F.try_element_at(pairs, F.lower(t)), CONTRACTIONS if endings is None else endings)
    return spaced(F.array_join(F.transform(tokens(text), one), " "))


def _buckets(words: DataFrame, n: int) -> tuple[DataFrame, Callable[[Column], Column]]:
    """One row with an array of ``n`` maps of (token, meaning), and a token's place in it."""
    place = lambda low: F.pmod(F.xxhash64(low), F.lit(n)).cast("int")
    own = words.groupBy(place(F.col("token")).alias("place")).agg(F.collect_list(F.struct("token", "meaning")).alias("own"))
    every = words.sparkSession.range(n).select(F.col("id").cast("int").alias("place")).join(own, "place", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "own"))), lambda x: F.map_from_entries(x["own"])).alias("__words")), place


def normalize_tweets(rows: DataFrame, dictionary: DataFrame, key: str, text: str = "text", endings: dict[str, str] | None = None, most: int = MOST_ROWS) -> DataFrame:
    """(key, normal) of ``rows``, with a table (token, meaning) as the dictionary; of a token that has several meanings the first in order counts.

    A dictionary of ``most`` rows or fewer goes to all tasks, as an array of as many small maps by the words' hashes (a map is searched from its begin), and texts stay where they are. A larger one is joined with the distinct tokens of
    the texts; tokens then come together again by ``key``, whose values must be distinct.
    """
    ends = CONTRACTIONS if endings is None else endings
    clean = dictionary.where("token IS NOT NULL AND meaning IS NOT NULL").groupBy(F.lower("token").alias("token")).agg(F.min("meaning").alias("meaning"))
    words = clean.limit(most + 1).count()
    if words <= most:
        one_row, place = _buckets(clean, max(1, words))
        met = rows.select(key, text).crossJoin(F.broadcast(one_row))
        known = lambda low: F.try_element_at(F.get(F.col("__words"), place(low)), low)
        one = lambda t: let(F.struct(t.alias("t"), F.lower(t).alias("low")), lambda x: normal_token(x["t"], known(x["low"]), ends, x["low"]))
        return met.select(key, spaced(F.array_join(F.transform(tokens(F.col(text)), one), " ")).alias("normal"))
    each = rows.select(key, F.posexplode(tokens(F.col(text))).alias("at", "token"))
    words = each.select(F.lower("token").alias("word")).distinct().join(clean.withColumnRenamed("token", "word"), "word")
    told = each.withColumn("word", F.lower("token")).join(words, "word", "left").select(key, "at", normal_token(F.col("token"), F.col("meaning"), ends).alias("token"))
    joined = told.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), " ").alias("joined"))
    out = rows.select(key, text).join(joined, key, "left")
    return out.select(key, F.when(F.col(text).isNotNull(), spaced(F.coalesce("joined", F.lit("")))).alias("normal"))
