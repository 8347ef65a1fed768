"""Text, tag and sentiment expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from agora.functions.scores import ColumnOrName, _c

# Patterns.
# White space as Unicode defines it (Java's \s is ASCII only).
WHITE_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_WHITE_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"
# Runs of white space other than one plain blank.
UNEVEN_SPACE = rf" {WHITE_SPACE}+|[\s\x1c-\x1f\x85\p{{Z}}&&[^ ]]{WHITE_SPACE}*"
WHITE_SPACE_CHARACTERS = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
EMAIL_LIKE = r"\S+@\S+"
NOT_BASIC_TEXT = r"[^a-zA-Z0-9\s.,!?;:]"
NOT_LETTERS = r"[^a-zA-Z\s]"
TAG = r"^[a-zA-Z0-9_-]+$"
METRIC_NAME = r"^[a-zA-Z0-9._-]+$"

MAX_TAG_LENGTH = 50


def collapse(text: ColumnOrName) -> Column:
    """Runs of white space become one blank; no blanks at the ends."""
    return F.trim(F.regexp_replace(_c(text), UNEVEN_SPACE, " "))


def strip(text: ColumnOrName) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(_c(text), F.lit(WHITE_SPACE_CHARACTERS))


def is_blank(text: ColumnOrName) -> Column:
    """True for text without a single visible character."""
    return ~_c(text).rlike(NOT_WHITE_SPACE)


def clean_text(text: ColumnOrName) -> Column:
    """Collapse blanks, then drop URLs, mail addresses and unusual characters.

    Blanks left behind by a removal stay, because collapsing comes first. The costly
    patterns run only on texts that can match them.
    """
    out = collapse(F.coalesce(_c(text), F.lit("")))
    out = F.when(out.contains("http"), F.regexp_replace(out, URL, "")).otherwise(out)
    out = F.when(out.contains("@"), F.regexp_replace(out, EMAIL_LIKE, "")).otherwise(out)
    return F.regexp_replace(out, NOT_BASIC_TEXT + "+", "")


def combined_text(*parts: ColumnOrName) -> Column:
    return F.concat_ws(" ", *[_c(p) for p in parts])


def normalised_text(*parts: ColumnOrName) -> Column:
    """Lower-case letters and blanks of all parts joined."""
    return F.lower(F.trim(F.regexp_replace(combined_text(*parts), NOT_LETTERS, "")))


def word_count(text: ColumnOrName) -> Column:
    """Number of words; 0 for empty or blank text."""
    return F.regexp_count(F.coalesce(_c(text), F.lit("")), F.lit(NOT_WHITE_SPACE + "+"))


def token_count(text: ColumnOrName, pattern: str = r"\s+") -> Column:
    """Pieces after a split; a leading blank adds an empty piece."""
    return F.size(F.split(_c(text), pattern))


def has_question_mark(text: ColumnOrName) -> Column:
    return F.when(_c(text).contains("?"), 1.0).otherwise(0.0)


def clip(value: ColumnOrName, low: float = -1.0, high: float = 1.0) -> Column:
    """Limit to a range; null stays null (``least`` and ``greatest`` would skip it)."""
    column = _c(value)
    return F.when(column.isNotNull(), F.greatest(F.least(column, F.lit(high)), F.lit(low)))


def sentiment_category(score: ColumnOrName, null_as: str | None = "neutral") -> Column:
    """positive above 0.3, negative below -0.3, else neutral; ``null_as`` for a missing score."""
    column = _c(score)
    return (
        F.when(column.isNull(), F.lit(null_as))
        .when(column > 0.3, "positive")
        .when(column < -0.3, "negative")
        .otherwise("neutral")
    )


def tag_count(tags: ColumnOrName) -> Column:
    return F.when(_c(tags).isNull(), F.lit(0)).otherwise(F.size(_c(tags)))


def has_tag(tags: ColumnOrName, tag: str = "personal") -> Column:
    return F.coalesce(F.array_contains(_c(tags), tag), F.lit(False))


def clean_tags(tags: ColumnOrName) -> Column:
    """Trimmed lower-case tags; blank, long and oddly spelled ones are dropped."""
    cleaned = F.transform(F.coalesce(_c(tags), F.array().cast("array<string>")), lambda t: F.lower(strip(t)))
    return F.filter(cleaned, lambda t: (F.length(t) <= MAX_TAG_LENGTH) & t.rlike(TAG))


def leading_tags(tags: ColumnOrName, count: int = 3) -> Column:
    return F.slice(F.coalesce(_c(tags), F.array().cast("array<string>")), 1, count)


def metric_name(name: ColumnOrName) -> Column:
    return F.replace(F.lower(_c(name)), F.lit(" "), F.lit("_"))


def label(name: ColumnOrName, fallback: ColumnOrName, role: ColumnOrName) -> Column:
    """``name (role)``; the fallback stands in for an empty name, ``Unknown`` for an empty role."""
    def filled(value: Column) -> Column:
        return F.when(value != "", value)

    return F.concat(
        F.coalesce(filled(_c(name)), _c(fallback)),
        F.lit(" ("),
        F.coalesce(filled(_c(role)), F.lit("Unknown")),
        F.lit(")"),
    )


def hidden_id(user_id: ColumnOrName, salt: str) -> Column:
    """Salted hash that stands in for a voter whose identity must stay private."""
    return F.sha2(F.concat(F.lit(salt), _c(user_id)), 256)


# A small word list for the default sentiment score.
POSITIVE_WORDS = ("exciting", "great", "good", "helpful", "love", "excellent", "practical", "needed")
NEGATIVE_WORDS = ("risky", "bad", "untested", "poor", "hate", "terrible", "complex", "expensive")


def lexicon_sentiment(
    text: ColumnOrName,
    positive: tuple[str, ...] = POSITIVE_WORDS,
    negative: tuple[str, ...] = NEGATIVE_WORDS,
) -> Column:
    """(positive - negative) / (positive + negative) word hits, null without any hit."""
    words = F.split(F.lower(F.regexp_replace(F.coalesce(_c(text), F.lit("")), "[^a-zA-Z]+", " ")), " ")
    plus = F.size(F.filter(words, lambda w: w.isin(*positive)))
    minus = F.size(F.filter(words, lambda w: w.isin(*negative)))
    return F.when(plus + minus > 0, (plus - minus) / (plus + minus))
