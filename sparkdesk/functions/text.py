"""Ticket text clean-up, validation and display expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode white space, spelled out because Java's \s is ASCII only.
WS = r"[\t\n\x0B\f\r\x1C-\x20\x85\p{Z}]"
NOT_WS = r"[^\t\n\x0B\f\r\x1C-\x20\x85\p{Z}]"

# Possessive quantifiers: same matches, no backtracking over long bodies.
ANSI = r"\x1B\[[0-9;]*+m"
HTML_TAG = r"<[^>]++>"
URL = rf"https?://{NOT_WS}++"
CODE_FENCE = r"(?s)```.*?```"
INLINE_CODE = r"`[^`\n]{1,100}`"
PLACEHOLDER = r"\{[^}]++\}"
HEADING = rf"(?md)^#{{1,6}}+{WS}++"
EMPHASIS = r"\*{1,2}([^*]++)\*{1,2}"
CHECKBOX = rf"-{WS}*+\[[ xX]\]"

# Words that mark a ticket as urgent.
URGENT_WORDS = [
    "crash", "blocker", "urgent", "emergency", "regression", "vulnerability",
    "panic", "broken", "production", "down", "security",
]

# Limits of a ticket request.
MAX_TITLE_CHARS = 1000
MAX_BODY_CHARS = 10_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), 0)


def add_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that filters on it do not compute a second time.

    A filter is pushed below a plain projection together with a copy of the expression;
    it stays above a generated column.
    """
    return df.withColumn(name, F.explode_outer(F.array(value)))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def number_text(c: Column) -> Column:
    """A double column as text with NaN treated as missing."""
    return F.when(~F.isnan(c), c.cast("string")).otherwise(F.lit(""))


def squeeze(c: Column) -> Column:
    """Collapse white space to single blanks and trim."""
    return F.trim(F.regexp_replace(c, WS + "++", " "))


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(c, rf"^{WS}++|{WS}++$", "")


def clean_text(c: Column) -> Column:
    return squeeze(F.lower(_text(c)))


def _blank_out(c: Column, patterns: Iterable[str]) -> Column:
    for pattern in patterns:
        c = F.regexp_replace(c, pattern, " ")
    return c


def deep_clean_text(c: Column) -> Column:
    """Strip markup in a fixed order, then lower-case and squeeze."""
    c = _blank_out(
        _text(c), [ANSI, HTML_TAG, URL, CODE_FENCE, INLINE_CODE, PLACEHOLDER, HEADING]
    )
    c = F.regexp_replace(c, EMPHASIS, "$1")
    return clean_text(_blank_out(c, [CHECKBOX]))


def light_clean(c: Column) -> Column:
    """Strip markup blocks but keep case and inline marks."""
    return squeeze(_blank_out(_text(c), [ANSI, HTML_TAG, URL, CODE_FENCE, PLACEHOLDER]))


def combine_title_body(title: Column, body: Column) -> Column:
    """Cleaned title twice, then the cleaned body; empty parts are left out."""
    return let(
        deep_clean_text(title),
        lambda t: F.trim(F.concat_ws(" ", t, t, deep_clean_text(body))),
    )


def add_text_column(
    df: DataFrame, title: str = "title", body: str = "body", out: str = "text"
) -> DataFrame:
    """Add the training text and drop rows where it is empty."""
    def part(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit("")

    return add_once(df, out, combine_title_body(part(title), part(body))).where(
        F.length(out) > 0
    )


def concat_text(
    title: Column, body: Column, sep: str = " ", fill: str = "", lower: bool = False
) -> Column:
    joined = F.concat(F.coalesce(title, F.lit(fill)), F.lit(sep), F.coalesce(body, F.lit(fill)))
    return F.lower(strip(joined)) if lower else joined


def lower_all(df: DataFrame) -> DataFrame:
    text = {name for name, kind in df.dtypes if kind == "string"}
    return df.select(*[F.lower(c).alias(c) if c in text else F.col(c) for c in df.columns])


def truncate_title(c: Column, n: int = 60) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def title_case(c: Column) -> Column:
    """Capital at the start of every run of letters, the rest in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.concat(
                F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 2_147_483_647))
            ),
        ),
        "",
    )


def display_label(c: Column) -> Column:
    return title_case(F.replace(c, F.lit("_"), F.lit(" ")))


def percent_text(c: Column, decimals: int = 1) -> Column:
    return F.concat(F.format_number(c * 100, decimals), F.lit("%"))


def format_predictions(c: Column) -> Column:
    """``bug (0.82), question (0.61)`` from an array of label/confidence structs."""
    return F.array_join(
        F.transform(
            c,
            lambda p: F.concat(
                p["label"], F.lit(" ("), F.format_number(p["confidence"], 2), F.lit(")")
            ),
        ),
        ", ",
    )


def reject_reason(title: Column, body: Column) -> Column:
    """Why a ticket request is refused; null for a valid one."""
    return (
        F.when(title.isNull(), F.lit("title missing"))
        .when(F.length(title) == 0, F.lit("title empty"))
        .when(F.length(title) > MAX_TITLE_CHARS, F.lit("title too long"))
        .when(~title.rlike(NOT_WS), F.lit("title blank"))
        .when(F.length(body) > MAX_BODY_CHARS, F.lit("body too long"))
    )


def mark_tickets(df: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """Default the body to ``""`` and add ``reject_reason``."""
    filled = F.coalesce(F.col(body), F.lit("")) if body in df.columns else F.lit("")
    df = df.withColumn(body, filled)
    return df.withColumn("reject_reason", reject_reason(F.col(title), F.col(body)))


def validate_tickets(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid tickets, refused tickets with ``reject_reason``)."""
    marked = mark_tickets(df)
    return (
        marked.where(F.col("reject_reason").isNull()).drop("reject_reason"),
        marked.where(F.col("reject_reason").isNotNull()),
    )


def length_features(df: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    return df.withColumns(
        {
            "title_length": F.length(F.coalesce(F.col(title), F.lit(""))),
            "body_length": F.length(F.coalesce(F.col(body), F.lit(""))),
        }
    )


def urgency_flag(c: Column, words: Iterable[str] = URGENT_WORDS) -> Column:
    """1 if the lower-cased text contains any of the words as a substring."""
    pattern = "|".join(rf"\Q{w}\E" for w in words)
    return F.coalesce(F.lower(c).rlike(pattern), F.lit(False)).cast("int")
