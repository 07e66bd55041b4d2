"""Quality classifier as a sparse ensemble of rules.

A forest of shallow trees is fitted on statistics of labelled texts. Every path from a root to
a node is a rule, a conjunction of bounds on statistics. A lasso logistic regression over the
rules' truth values keeps few of them; the kept rules and their weights are compiled into one
Spark column expression, which scores any table of statistics without a model object.

The fit reads a bounded sample of labelled rows, about ``SAMPLE_ROWS``; scoring reads all rows
and whole texts.

Cases: null and empty texts have statistics of 0 and get a score; without labels of both
classes every score is the good share of the labels (0.5 without any); a label that a document
has twice counts by its smallest value; repeated rows are scored each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdesk.llm.common import HASH_BITS, read, seeded
from sparkdesk.llm.stats import text_stats
from sparkdesk.session import materialize

SAMPLE_ROWS = 60_000
TREES, DEPTH = 24, 3
LASSO = 5e-4
SEED = 6

# A rule: per statistic a lower bound (exclusive) and an upper bound (inclusive).
Rule = tuple[tuple[str, float, float], ...]


def _share(part: str, of: str) -> Column:
    return F.col(part) / F.greatest(F.col(of), F.lit(1))


def quality_features() -> dict[str, Column]:
    """Statistics that trees may split on, from the counts of ``text_stats``."""
    return {
        "log_words": F.log1p("n_words"),
        "word_length": _share("word_chars", "n_words"),
        "words_per_line": _share("n_words", "n_lines"),
        "symbols": _share("n_symbols", "n_words"),
        "dup_lines": _share("n_dup_lines", "n_lines"),
        "repeats": _share("n_repeat_words", "n_words"),
        "capitals": _share("n_upper", "word_chars"),
        "letters": _share("n_letters", "word_chars"),
        "marks": _share("n_marks", "n_words"),
        "runs": _share("n_runs", "n_words"),
        "variety": F.col("n_distinct") / F.sqrt(F.greatest(F.col("n_words"), F.lit(1))),
    }


@dataclass
class Ensemble:
    """Kept rules with their weights, and the intercept."""

    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self) -> Column:
        """Probability of good quality, from the statistics' columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for name, low, high in rule:
        if low > -math.inf:
            out = out & (F.col(name) > low)
        if high < math.inf:
            out = out & (F.col(name) <= high)
    return out


def tree_rules(root, names: list[str]) -> list[Rule]:
    """The rules of all nodes below the root of a fitted tree; ``root`` is the JVM's node."""
    found, todo = [], [(root, {})]
    while todo:
        node, bounds = todo.pop()
        if bounds:
            found.append(tuple((n, *bounds[n]) for n in sorted(bounds)))
        if node.getClass().getSimpleName() == "LeafNode":
            continue
        name, at = names[node.split().featureIndex()], node.split().threshold()
        low, high = bounds.get(name, (-math.inf, math.inf))
        todo.append((node.leftChild(), {**bounds, name: (low, min(high, at))}))
        todo.append((node.rightChild(), {**bounds, name: (max(low, at), high)}))
    return found


def fit(
    stats: DataFrame,
    labels: DataFrame,
    features: list[str],
    rows: int = SAMPLE_ROWS,
    lasso: float = LASSO,
    seed: int = SEED,
) -> Ensemble:
    """Fit on statistics (id, features...) and labels (id, y), on about ``rows`` of them."""
    known = (
        labels.where(F.col("id").isNotNull() & F.col("y").isNotNull())
        .groupBy(F.col("id").alias("of"))
        .agg(F.min("y").cast("double").alias("y"))
    )
    counts = {int(r["y"]): r["count"] for r in known.groupBy("y").count().collect()}
    good, total = counts.get(1, 0), sum(counts.values())
    if not good or good == total:
        share = good / total if total else 0.5
        return Ensemble(math.log((share + 1e-6) / (1 - share + 1e-6)))
    bound = int((1 << HASH_BITS) * min(1.0, rows / total))
    drawn = known.where(seeded(seed, F.col("of")) < bound)
    sample, _ = materialize(
        stats.join(drawn, F.col("id") == F.col("of")).select("y", *features), "rule-sample"
    )
    if sample.select("y").distinct().count() < 2:
        return Ensemble(math.log(good / (total - good)))

    assembled = VectorAssembler(inputCols=features, outputCol="x").transform(sample)
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="y", numTrees=TREES, maxDepth=DEPTH, maxBins=64,
        featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=seed,
    ).fit(assembled)
    rules: list[Rule] = []
    for tree in forest.trees:
        rules += tree_rules(tree._java_obj.rootNode(), features)
    rules = sorted(set(rules))
    if not rules:
        return Ensemble(math.log(good / (total - good)))
    truth = F.array(*[F.when(holds(r), 1.0).otherwise(0.0) for r in rules])
    lasso_fit = LogisticRegression(
        featuresCol="truth", labelCol="y", elasticNetParam=1.0, regParam=lasso, maxIter=60
    ).fit(sample.select("y", array_to_vector(truth).alias("truth")))
    weights = lasso_fit.coefficients.toArray().tolist()
    return Ensemble(
        float(lasso_fit.intercept), [(r, w) for r, w in zip(rules, weights) if abs(w) > 1e-9]
    )


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 3 == 1


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """(id, statistics, held_out, score) per document; held-out documents' labels aren't read."""
    features = quality_features()
    stats, _ = materialize(
        text_stats(docs, id_col, text_col).withColumns(features), "rule-stats"
    )
    known = labels.where(~held_out(F.col(id_col))).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("y")
    )
    model = fit(stats, known, list(features))
    return stats.select("*", held_out(F.col("id")).alias("held_out"), model.score().alias("score"))


def op6_rule_ensemble(spark, sf_dir: str) -> DataFrame:
    scored = score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select(
        F.col("id").alias("doc_id"),
        "held_out",
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
