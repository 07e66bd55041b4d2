"""Statistics of a text as built-in expressions, computed once into a narrow table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdesk.functions.text import let
from sparkdesk.llm.common import SPACE, whole, words

WINDOW = 5
STATS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_chars", "n_lines", "n_upper", "n_letters", "n_marks", "n_runs",
    "n_distinct",
]


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that the text holds twice or more.

    Windows are compared by 64-bit hashes. Texts whose windows all differ skip the sort.
    """

    def covered(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def places(s: Column) -> Column:
            def like(x: Column, k: Column) -> Column:
                return F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))

            twice = F.filter(s, lambda x, k: like(x, k - 1) | like(x, k + 1))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def count(at: Column) -> Column:
            def new(i: Column, k: Column) -> Column:
                return F.least(F.coalesce(i - F.get(at, k - 1), F.lit(window)), F.lit(window))

            return F.aggregate(F.transform(at, new), F.lit(0), lambda total, x: total + x)

        return let(let(F.sort_array(placed), places), count)

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - window)
        return F.when(
            F.size(w) >= window,
            F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(window)])),
        ).otherwise(F.array().cast("array<bigint>"))

    return let(
        hashes(found),
        lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0),
    )


def _without(text: Column, pattern: str) -> Column:
    """Code points that are left when all matches go."""
    return F.length(F.regexp_replace(text, pattern, ""))


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, STATS...): one row per document, all counts of type long."""
    text = F.col("text")
    split = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).alias("n"),
            (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup"),
        )

    with_word = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n"),
            F.size(F.array_distinct(w)).alias("distinct"),
            repeated_words(w).alias("repeat"),
        )

    found = split.select(
        "id",
        let(words(text), of_words).alias("w"),
        let(with_word, of_lines).alias("l"),
        F.length(text).alias("n_chars"),
        _without(text, SPACE).alias("word_chars"),
        _without(text, r"[#*$%&|<>]+").alias("no_symbols"),
        _without(text, r"\p{Lu}+").alias("no_upper"),
        _without(text, r"\p{L}+").alias("no_letters"),
        _without(text, r"[!-/:-@\[-`{-~]{2,}").alias("no_runs"),
        _without(text, r"[.,;:!?]+").alias("no_marks"),
    )
    columns = {
        "n_words": F.col("w.n"),
        "word_chars": F.col("word_chars"),
        "n_symbols": F.col("n_chars") - F.col("no_symbols"),
        "n_dup_lines": F.col("l.dup"),
        "n_repeat_words": F.col("w.repeat"),
        "n_chars": F.col("n_chars"),
        "n_lines": F.col("l.n"),
        "n_upper": F.col("n_chars") - F.col("no_upper"),
        "n_letters": F.col("n_chars") - F.col("no_letters"),
        "n_runs": F.col("n_chars") - F.col("no_runs"),
        "n_marks": F.col("n_chars") - F.col("no_marks"),
        "n_distinct": F.col("w.distinct"),
    }
    return found.select("id", *[columns[c].cast("long").alias(c) for c in STATS])
