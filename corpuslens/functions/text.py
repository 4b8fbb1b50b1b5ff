"""Text expressions. Only Unicode normalisation leaves the JVM."""

import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.defaults import (
    LEFT_PHRASES,
    MIN_CORPUS_WORDS,
    RIGHT_PHRASES,
)
from corpuslens.functions.phrases import phrase_counts

#: Up to so many phrases are counted one by one in the JVM; more by one automaton, with the same result.
FEW_PHRASES = 8

# White space outside ASCII. One range test passes over nearly every character, and the
# look-behind names the exact ones.
_WIDE_SPACE = (
    r"[\x85\xa0\u1680-\u3000]"
    r"(?<=[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])"
)
# Runs of ASCII white space other than one plain space.
_SPACE_RUN = r"[\t-\r\x1c- ]{2,}|[\t-\r\x1c-\x1f]"
_BLANK_RUN = r"[\t\x0b-\r\x1c- ]{2,}|[\t\x0b-\r\x1c-\x1f]"
_LINK = r"https?://[^\s\x1c-\x1f]+"
# A token that holds a mail address is replaced whole. Anchored at the token start and
# without backtracking, so one long unbroken run costs linear time.
_MAIL_TOKEN = r"(?<![^\s\x1c-\x1f])[^\s\x1c-\x1f][^\s\x1c-\x1f@]*@[^\s\x1c-\x1f][^\s\x1c-\x1f.]*\.[^\s\x1c-\x1f]+"


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def plain_spaces(text: Column) -> Column:
    """White space outside ASCII as plain spaces."""
    return bind(text, lambda t: F.when(is_ascii(t), t).otherwise(F.regexp_replace(t, _WIDE_SPACE, " ")))


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE_RUN, " "))


def collapse_spaces(text: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return _squeeze(plain_spaces(text))


def word_count(text: Column) -> Column:
    return F.size(F.split(text, r"\s+"))


def head(text: Column, n_chars: int | None) -> Column:
    """First ``n_chars`` characters, or the whole text for None."""
    return text if n_chars is None else F.substring(text, 1, n_chars)


def text_fingerprint(text: Column, n_chars: int | None = None) -> Column:
    """md5 of the lower-cased, space-collapsed text, or of its first ``n_chars`` characters."""
    return F.when(text != "", F.md5(collapse_spaces(F.lower(head(text, n_chars)))))


def non_ascii_ratio(text: Column) -> Column:
    """Share of characters above U+007F; 1.0 for empty or null text."""
    n = F.length(text)
    return (
        F.when(text.isNull() | (n == 0), F.lit(1.0))
        .when(F.octet_length(text) == n, F.lit(0.0))
        .otherwise(F.length(F.regexp_replace(text, r"[\x00-\x7F]+", "")) / n)
    )


def cleaned(text: Column, min_words: int = MIN_CORPUS_WORDS) -> Column:
    """Array of the cleaned text, or empty below ``min_words`` words.

    Explode it to drop short texts: a filter on the cleaned text would be pushed below the
    projection and run all of the cleaning a second time.
    """
    t = plain_spaces(F.lower(text))
    t = bind(t, lambda c: F.when(c.contains("://"), F.regexp_replace(c, _LINK, " ")).otherwise(c))
    t = bind(t, lambda c: F.when(c.contains("@"), F.regexp_replace(c, _MAIL_TOKEN, " ")).otherwise(c))
    t = _squeeze(t)

    def long_enough(c: Column) -> Column:
        spaces = F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))
        return F.when(c == "", 0).otherwise(spaces + 1) >= min_words

    return F.filter(F.array(F.when(text != "", t)), long_enough)


def clean_for_nlp(text: Column, min_words: int = MIN_CORPUS_WORDS) -> Column:
    """Lower-case text without links and mail addresses; null below ``min_words`` words."""
    return F.get(cleaned(text, min_words), F.lit(0))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """NFKC form. ASCII text is its own NFKC form and is not sent to Python."""
    return F.coalesce(_nfkc(F.when(~is_ascii(text), text)), text)


def tidy_spaces(text: Column) -> Column:
    """Blanks other than newline to one space, three or more newlines to two, ends trimmed."""
    t = F.regexp_replace(F.regexp_replace(plain_spaces(text), _BLANK_RUN, " "), r"\n{3,}", "\n\n")
    return F.trim(t, F.lit(" \n"))


def normalize_text(text: Column) -> Column:
    return tidy_spaces(nfkc(text))


def phrase_count(text: Column, phrases: Iterable[str]) -> Column:
    """Non-overlapping occurrences of each phrase, summed over the phrases, in lower-cased text."""
    lowered = F.lower(text)
    size = F.octet_length(lowered)
    total = F.lit(0)
    for p in phrases:
        cut = F.octet_length(F.replace(lowered, F.lit(p), F.lit("")))
        # A search is several times cheaper than a replacement, and most phrases are absent.
        hits = F.when(lowered.contains(p), ((size - cut) / len(p.encode())).cast("int"))
        total = total + hits.otherwise(F.when(lowered.isNotNull(), 0))
    return F.coalesce(total, F.lit(0))


def slant(left: Column, right: Column) -> Column:
    """(right - left) / (right + left); 0 without any hit."""
    return (right - left) / F.greatest(left + right, F.lit(1))


def partisan_score(
    text: Column, left: Iterable[str] = LEFT_PHRASES, right: Iterable[str] = RIGHT_PHRASES
) -> Column:
    """Slant of the partisan phrases in a text, -1 (left) to 1 (right)."""
    left, right = list(left), list(right)
    if len(left) + len(right) <= FEW_PHRASES:
        return slant(phrase_count(text, left), phrase_count(text, right))
    counts = phrase_counts(text, left, right)
    return slant(counts[0], counts[1])


def tokenize(text: Column, min_length: int = 3) -> Column:
    """Lower-case a-z runs of at least ``min_length`` letters."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: F.length(w) >= min_length)
