"""Quality rules as weak supervision.

Every rule votes good or bad on a document's statistics, or abstains. Expectation-maximisation
over the counts of vote patterns estimates how often each rule gives each vote on good and on
bad documents; a document's posterior probability of being good then replaces a filter that
all rules must pass. The iterations read the pattern counts alone, 3 to the power of the number
of rules at most, and run as one expression; the driver gets the estimated rates.

Cases: a null or empty text has no words and fails the base rules, repeated rows are counted
each, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdesk.functions.text import let
from sparkdesk.llm.common import read
from sparkdesk.llm.stats import text_stats
from sparkdesk.session import materialize

GOOD, BAD, NONE = 1, 0, -1
ROUNDS = 50
# Documents of each class that every rule counts as judged rightly and wrongly beforehand.
PRIOR_SEEN = (2.0, 0.2)


def _share(part: str, of: str) -> Column:
    return F.col(part) / F.greatest(F.col(of), F.lit(1))


def rules() -> dict[str, tuple[Column, Column]]:
    """Name -> (votes bad, votes good); neither: the rule abstains."""
    mean_length = _share("word_chars", "n_words")
    return {
        "length": (F.col("n_words") < 10, F.col("n_words") >= 50),
        "symbols": (_share("n_symbols", "n_words") > 0.1, F.col("n_symbols") == 0),
        "capitals": (_share("n_upper", "word_chars") > 0.4, _share("n_upper", "word_chars") < 0.1),
        "lines": (_share("n_dup_lines", "n_lines") > 0.3, F.col("n_dup_lines") == 0),
        "repeats": (_share("n_repeat_words", "n_words") > 0.3, F.col("n_repeat_words") == 0),
        "variety": (
            (F.col("n_distinct") / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))) < 2,
            (F.col("n_distinct") / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))) > 4,
        ),
        "marks": (_share("n_marks", "n_words") > 0.6, _share("n_marks", "n_words") < 0.4),
        "letters": (
            (F.col("n_words") > 0) & (_share("n_letters", "word_chars") < 0.9),
            _share("n_letters", "word_chars") > 0.93,
        ),
        "runs": (_share("n_runs", "n_words") > 0.2, _share("n_runs", "n_words") < 0.02),
        "word_length": ((mean_length < 2) | (mean_length > 15), mean_length.between(3, 10)),
    }


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(NONE)


def _log_odds(votes: Column, share: Column, on_good: Column, on_bad: Column) -> Column:
    """Log odds of being good: a bad vote counts its rates, a good vote the rates' rest."""

    def ratio(total: Column, i: Column) -> Column:
        g, b = F.get(on_good, i), F.get(on_bad, i)
        cast = F.get(votes, i)
        return (
            F.when(cast == BAD, total + F.log(g) - F.log(b))
            .when(cast == GOOD, total + F.log1p(-g) - F.log1p(-b))
            .otherwise(total)
        )

    places = F.sequence(F.lit(0), F.size(votes) - 1)
    return F.aggregate(places, F.log(share) - F.log1p(-share), ratio)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _maximise(seen: Column, rules_: int) -> Column:
    """Parameters from (votes, n, belief in good) of every pattern."""
    right, wrong = PRIOR_SEEN

    def rate(i: Column, weight, more_bad: float, more_good: float) -> Column:
        def mass(cast: int) -> Column:
            return _sum(
                F.transform(seen, lambda p: F.when(F.get(p["votes"], i) == cast, weight(p)).otherwise(0.0))
            )

        return let(
            F.struct(mass(BAD).alias("bad"), mass(GOOD).alias("good")),
            lambda m: (m["bad"] + more_bad) / (m["bad"] + m["good"] + more_bad + more_good),
        )

    places = F.sequence(F.lit(0), F.lit(rules_ - 1))
    good = lambda p: p["n"] * p["belief"]
    bad = lambda p: p["n"] * (1 - p["belief"])
    share = (_sum(F.transform(seen, good)) + 1.0) / (_sum(F.transform(seen, lambda p: p["n"])) + 2.0)
    return F.struct(
        share.alias("share"),
        F.transform(places, lambda i: rate(i, good, wrong, right)).alias("on_good"),
        F.transform(places, lambda i: rate(i, bad, right, wrong)).alias("on_bad"),
    )


def estimate(patterns: DataFrame, rules_: int, rounds: int = ROUNDS) -> DataFrame:
    """One row (share, on_good, on_bad): the good documents' share and, per rule, how often
    it votes bad when it votes, on good and on bad documents.

    ``patterns`` has the rules' ``votes`` and ``n``, the documents that got them. The start
    believes a document good if no rule votes bad; abstaining says nothing about the class.
    All rounds are one expression over the collected patterns.
    """
    all_of = patterns.agg(
        F.array_sort(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("seen")
    )

    def believed(seen: Column, belief) -> Column:
        return F.transform(
            seen,
            lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), belief(p).alias("belief")),
        )

    start = believed(
        F.col("seen"), lambda p: F.when(F.array_contains(p["votes"], BAD), 0.1).otherwise(0.9)
    )

    def again(params: Column, _: Column) -> Column:
        return let(
            believed(
                F.col("seen"),
                lambda p: _sigmoid(
                    _log_odds(p["votes"], params["share"], params["on_good"], params["on_bad"])
                ),
            ),
            lambda seen: _maximise(seen, rules_),
        )

    fitted = F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)), let(start, lambda seen: _maximise(seen, rules_)), again
    )
    return all_of.select(fitted.alias("fitted")).select("fitted.*")


def judge_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    chosen: dict[str, tuple[Column, Column]] | None = None,
    least: float = 0.5,
) -> DataFrame:
    """(id, statistics, votes, p_good, base_failed, kept) per document."""
    chosen = chosen or rules()
    votes = F.array(*[vote(*rule) for rule in chosen.values()])
    table, _ = materialize(
        text_stats(docs, id_col, text_col).withColumn("votes", votes), "quality-stats"
    )
    patterns = table.groupBy("votes").agg(F.count("*").alias("n"))
    found = estimate(patterns, len(chosen)).first()  # one row of 2 x rules + 1 numbers
    on_good, on_bad = (F.array(*map(F.lit, found[k])) for k in ("on_good", "on_bad"))
    p_good = _sigmoid(_log_odds(F.col("votes"), F.lit(found["share"]), on_good, on_bad))
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return table.select(
        "*", F.round(p_good, 6).alias("p_good"), base_failed.alias("base_failed")
    ).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge_quality(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "p_good",
    )
