"""Cleaning and describing short texts. Native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..skew import let
from .entities import decode_entities
from .tokens import EMOJI_SEQUENCE
from .urls import URL_PATTERN, analyze_urls, remove_urls

# Fixed values.
MIN_LENGTH, MAX_LENGTH = 5, 500
MENTION_PLACEHOLDER = "[USER]"
RETWEET_PATTERN = r"(?U)^RT\s+@\w+:\s*"
EMOJI_PATTERN = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]"
DISCOURSE_MARKERS = (
    "actually", "anyway", "basically", "certainly", "clearly", "consequently", "definitely", "evidently", "generally",
    "however", "incidentally", "indeed", "interestingly", "likewise", "meanwhile", "moreover", "nevertheless", "obviously",
    "overall", "personally", "previously", "really", "right", "so", "somehow", "sometimes", "specifically", "still",
    "technically", "therefore", "thus", "unfortunately", "well", "whatever", "whenever", "whereas", "whether", "while", "yet",
)


def clean_whitespace(text: Column) -> Column:
    """Runs of any Unicode white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_retweet(text: Column) -> Column:
    """Without one leading ``RT @user:``."""
    return F.regexp_replace(text, RETWEET_PATTERN, "")


def mask_mentions(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)@\w+", MENTION_PLACEHOLDER)


def has_mention(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)@\w+"), F.lit(False))


def has_hashtag(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)#\w+"), F.lit(False))


def has_emoji(text: Column) -> Column:
    return F.coalesce(text.rlike(EMOJI_PATTERN), F.lit(False))


def extract_hashtags(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"(?U)#\w+"), F.lit(0)), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """White-space separated words; 0 for null and blank texts."""
    return let(clean_whitespace(text), lambda clean: F.when(F.coalesce(clean, F.lit("")) == "", 0).otherwise(F.size(F.split(clean, " "))))


def validate_length(text: Column) -> Column:
    """Struct of is_valid and reason: missing_text, too_short, too_long or valid (both bounds included)."""
    n = F.length(text)
    reason = (
        F.when(F.coalesce(n, F.lit(0)) == 0, "missing_text")
        .when(n < MIN_LENGTH, "too_short")
        .when(n > MAX_LENGTH, "too_long")
        .otherwise("valid")
    )
    return F.struct((reason == "valid").alias("is_valid"), reason.alias("reason"))


def clean_text(text: Column, keep_mentions: bool = True, entities: bool = True) -> Column:
    """Entities, retweet mark, mentions, white space, in this order."""
    out = strip_retweet(decode_entities(text) if entities else text)
    return clean_whitespace(out if keep_mentions else mask_mentions(out))


def preprocess(tweets: DataFrame, keep_urls: bool = True, keep_mentions: bool = True) -> DataFrame:
    """The preprocessed record of each row of (tweet_id, text, taco_class, topic, confidence).

    Hashtags come from the raw text. With URLs masked, their analysis is made before they go and has no class.
    """
    base = tweets.select("tweet_id", "text", "taco_class", "topic", "confidence", decode_entities(F.col("text")).alias("decoded"))

    def described(clean: Column, shown: Column) -> Column:
        urls, checked = analyze_urls(clean, F.col("taco_class") if keep_urls else None), validate_length(shown)
        parts = F.struct(shown.alias("shown"), urls.alias("urls"), checked.alias("checked"), F.length(shown).alias("n"), word_count(shown).alias("words"))
        return parts

    cleaned = clean_text(F.col("decoded"), keep_mentions, entities=False)
    record = let(cleaned, lambda clean: let(clean if keep_urls else remove_urls(clean), lambda shown: described(clean, shown)))
    made = base.select("*", record.alias("r"), extract_hashtags(F.col("text")).alias("tags"))
    return made.select(
        "tweet_id", F.col("text").alias("text_original"), F.col("r.shown").alias("text_cleaned"), "taco_class", "topic", "confidence",
        F.col("r.checked.is_valid").alias("is_valid"), F.col("r.checked.reason").alias("validation_reason"),
        F.coalesce("r.n", F.lit(0)).alias("text_length"), F.col("r.words").alias("word_count"),
        F.col("r.urls.has_urls").alias("has_urls"), F.col("r.urls.url_count").alias("url_count"), F.col("r.urls.urls").alias("url_metadata"),
        F.col("tags").alias("hashtags"), F.size("tags").alias("hashtag_count"),
    )


def handle_urls(tweets: DataFrame, keep_urls: bool = True) -> DataFrame:
    """(tweet_id, text, has_urls, url_count): the text as it is or with its URLs replaced, and what it held."""
    urls = analyze_urls(F.col("text"))
    shown = F.col("text") if keep_urls else remove_urls(F.col("text"))
    return tweets.select("tweet_id", shown.alias("text"), urls.alias("u")).select("tweet_id", "text", "u.has_urls", "u.url_count")


def url_rows(records: DataFrame, *keep: str) -> DataFrame:
    """A row per URL of the records: columns ``keep`` and what is known of the URL.

    (A plain inline would let the optimiser filter on the URLs first and analyse every text twice.)
    """
    return records.select(*keep, F.inline_outer("url_metadata")).where("url IS NOT NULL")


def contains_http(text: Column) -> Column:
    """1 if the text holds ``http`` in any case, else 0."""
    return F.coalesce(F.contains(F.lower(text), F.lit("http")).cast("int"), F.lit(0))


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def discourse_markers(text: Column) -> Column:
    """The words of the text (lower case, cut at blanks) that are discourse markers, in order."""
    words = F.array(*map(F.lit, DISCOURSE_MARKERS))
    return F.filter(F.split(F.lower(text), " "), lambda w: F.array_contains(words, w))


def text_information(text: Column) -> list[Column]:
    """Counts that describe a text: weighted length, URLs, emoji, tags, mentions, markers.

    In the weighted length a URL counts 23, a wide character twice, and an emoji sequence (joined, with a skin tone or a
    variation, a flag, a keycap) like one wide character.
    """
    urls = F.regexp_count(text, F.lit(URL_PATTERN))
    plain = F.regexp_replace(F.regexp_replace(text, URL_PATTERN, ""), EMOJI_SEQUENCE, "\u4e00")
    wide = F.regexp_count(plain, F.lit(r"[^\x{0}-\x{10FF}\x{2000}-\x{200D}\x{2010}-\x{201F}\x{2032}-\x{2037}]"))
    return [
        (F.length(plain) + wide + 23 * urls).alias("weighted_length"), urls.alias("url_count"),
        F.regexp_count(text, F.lit(EMOJI_PATTERN)).alias("emoji_count"), count_char(text, "#").alias("hashtags"),
        count_char(text, "@").alias("mentions"), F.size(discourse_markers(text)).alias("markers"),
    ]
