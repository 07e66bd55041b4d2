"""Word tokens, stop words, n-grams and per-row term counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkdesk.functions.text import let

# Two or more Unicode word characters.
TOKEN = r"[\p{L}\p{N}_]{2,}"

# Words without signal in tickets, on top of the English list.
DOMAIN_STOP_WORDS = [
    "issue", "problem", "error", "bug", "fix", "fixed", "working", "work",
    "help", "please", "need", "trying", "tried", "using", "used", "use",
    "want", "would", "could", "should", "getting", "got", "seems", "like",
    "also", "still", "currently", "expected", "actual", "found", "make",
    "hi", "hello", "hey", "dear", "thanks", "thank", "regards", "sincerely",
    "cheers", "best",
    "describe", "steps", "reproduce", "expected", "behavior", "environment",
    "version", "os", "operating", "system", "additional", "context",
    "feature", "request", "related", "possible", "solution",
    "br", "nbsp", "div", "span", "lt", "gt", "amp",
]


def stop_words(english: Iterable[str] | None = None) -> list[str]:
    """English list (as tokens, so ``don't`` gives ``don``) plus the domain words."""
    if english is None:
        english = StopWordsRemover.loadDefaultStopWords("english")
    tokens = {t for word in english for t in word.lower().split("'") if len(t) > 1}
    return sorted(tokens.union(DOMAIN_STOP_WORDS))


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def remove_stopwords(tokens: Column, words: Iterable[str]) -> Column:
    words = list(words)
    return F.filter(tokens, lambda t: ~t.isin(words)) if words else tokens


def ngrams(tokens: Column, lo: int = 1, hi: int = 2) -> Column:
    """Word n-grams for n in lo..hi, shortest first, each joined by a blank."""
    def of_length(words: Column, n: int) -> Column:
        if n == 1:
            return words
        grams = F.transform(
            words, lambda x, i: F.concat_ws(" ", x, *[F.get(words, i + k) for k in range(1, n)])
        )
        whole = F.slice(grams, F.lit(1), F.size(words) - (n - 1))
        return F.when(F.size(words) >= n, whole).otherwise(F.array().cast("array<string>"))

    return let(tokens, lambda w: F.concat(*[of_length(w, n) for n in range(lo, hi + 1)]))


def joined_words(c: Column, words: Iterable[str]) -> Column:
    """Word tokens without stop words as one text, joined by blanks."""
    return F.array_join(remove_stopwords(tokenize(c), words), " ")


def split_words(c: Column) -> Column:
    """The words of ``joined_words``."""
    return F.when(c != "", F.split(c, " ")).otherwise(F.array().cast("array<string>"))


def truncate_tokens(c: Column, n: int = 256) -> Column:
    """First ``n`` word tokens, joined by blanks."""
    return F.array_join(F.slice(tokenize(c), 1, n), " ")


def terms(c: Column, words: Iterable[str], lo: int = 1, hi: int = 2) -> Column:
    return ngrams(remove_stopwords(tokenize(c), words), lo, hi)


def term_counts(term_list: Column) -> Column:
    """``array<struct<term, tf>>`` of one row, by sorting and run lengths.

    Counting inside the row keeps (row, term) pairs out of the shuffle.
    """
    def runs(s: Column) -> Column:
        size = F.size(s)
        starts = F.filter(
            F.sequence(F.lit(0), size - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return let(
            starts,
            lambda b: F.transform(
                b,
                lambda p, j: F.struct(
                    F.get(s, p).alias("term"),
                    (F.coalesce(F.get(b, j + 1), size) - p).alias("tf"),
                ),
            ),
        )

    return F.when(F.size(term_list) > 0, let(F.sort_array(term_list), runs)).otherwise(
        F.array().cast("array<struct<term:string,tf:int>>")
    )
