"""Fitting and evaluating the ticket classifiers with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdesk.functions.decode import sigmoid_scores, softmax_scores
from sparkdesk.operators.features import (
    Tfidf,
    label_classes,
    multi_hot,
    sparse_column,
    tfidf_transform,
    written_vectors,
)
from sparkdesk.operators.metrics import accuracy, macro_f1, micro_f1, subset_accuracy
from sparkdesk.operators.sampling import split_random, split_size, split_stratified
from sparkdesk.plans.linear import (
    LinearModel,
    MultiLabelModel,
    OneVsRestModel,
    SingleLabelModel,
    decision_values,
)
from sparkdesk.plans.loading import load_category, load_intent, load_priority
from sparkdesk.plans.solver import Objective, linear_svm, logistic, solve
from sparkdesk.session import materialize, remove_path, small_batches, written
from sparkdesk.sources.registry import REGISTRY, append_registry
from sparkdesk.sources.tables import limit_rows

SEED = 42
SINGLE_TYPE = "TF-IDF + LogisticRegression"
MULTI_TYPE = "TF-IDF + OneVsRest LogisticRegression"


def single_label_weights(rows: int, counts: Sequence[int], coupled: bool) -> np.ndarray:
    """Weights of a row without and with each fitted class.

    A class weighs n / (classes * its rows). Without it a row weighs 1 if the classes have
    classifiers of their own, and nothing in a softmax. Of two classes only the second has a
    classifier, and both sides have their class weight.
    """
    own = rows / (len(counts) * np.array(counts))
    if len(counts) == 2:
        return np.array([[own[0]], [own[1]]])
    return np.stack([np.zeros(len(own)) if coupled else np.ones(len(own)), own])


def multi_label_weights(rows: int, counts: Sequence[int]) -> np.ndarray:
    """Balanced weights of a row without and with each label."""
    ones = np.array(counts)
    return np.stack([rows / (2 * (rows - ones)), rows / (2 * ones)])


def summed_weights(rows: int, counts: Sequence[int], weights: np.ndarray) -> np.ndarray:
    ones = np.array(counts)
    return weights[0] * (rows - ones) + weights[1] * ones


def _read_by(features: Estimator) -> list[str]:
    """Columns that ``features`` are fitted on and made of, once the words are extracted."""
    extract = features.extractor()
    return [extract.words_col, *([extract.getInputCol()] if features.reads_text else [])]


@contextmanager
def fitted_vectors(
    df: DataFrame, text: str, features: Estimator | PipelineModel | None, *columns: str
) -> Iterator[tuple[DataFrame, PipelineModel]]:
    """The columns with ``features`` as vectors in a table, and the feature pipeline (jobs).

    Features that are still to be fitted read a table of the rows' words, so texts are
    tokenised once.
    """
    features = features or Tfidf(input_col=text)

    @contextmanager
    def listed() -> Iterator[DataFrame]:
        if isinstance(features, PipelineModel) or features.extractor().getOutputCol() in df.columns:
            yield df
        else:
            words = features.extractor().with_words(df).select(*columns, *_read_by(features))
            with written(words, "words") as table:
                yield table

    with ExitStack() as kept:
        with listed() as rows:  # the words go once the vectors are written
            model = features.fit(rows) if isinstance(features, Estimator) else features
            vectors = tfidf_transform(model, rows).select("features", *columns)
            table = kept.enter_context(written_vectors(vectors, "features", "features"))
        yield table, model


def _width(table: DataFrame) -> int:
    """Number of features of a table of vectors."""
    first = table.select(sparse_column(table, "features")["size"]).first()
    return first[0] if first else 0


# Single label

def fit_single_label(
    df: DataFrame,
    text: str = "text",
    label: str = "label",
    features: Estimator | PipelineModel | None = None,
    objective: Objective = logistic(),
) -> SingleLabelModel:
    """Balanced single-label classifier on TF-IDF features (jobs).

    The logistic loss is softmax over the classes, or binary for two; any other loss makes one
    binary classifier per class.
    """
    named = df.where(F.col(label).isNotNull())
    counts = {r[label]: r["count"] for r in named.groupBy(label).count().orderBy(label).collect()}
    labels, rows = list(counts), sum(counts.values())
    if len(labels) < 2:
        raise ValueError("a classifier needs at least two classes")
    coupled = objective.loss == "logistic"
    fitted = labels[1:] if len(labels) == 2 else labels
    weights = single_label_weights(rows, [counts[x] for x in labels], coupled)
    totals = summed_weights(rows, [counts[x] for x in fitted], weights)
    hot = multi_hot(named.withColumn("_own", F.array(label)), "_own", fitted)
    with fitted_vectors(hot, text, features, "hot") as (table, model):
        matrix, intercepts = solve(
            table, _width(table), weights,
            np.array([rows]) if coupled and len(labels) > 2 else totals,
            objective, coupled=len(labels) > 2,
        )
    kind = SingleLabelModel if coupled else OneVsRestModel
    if len(labels) == 2:
        other = 0.0 if coupled else -1.0
        matrix = np.vstack([other * matrix, matrix])
        intercepts = np.concatenate([other * intercepts, intercepts])
    return kind(model, labels, matrix, intercepts)


def evaluate_single(model: LinearModel, df: DataFrame, label: str = "label") -> dict:
    """Accuracy and macro F1 of one pass over the rows (job)."""
    scored = model.predict(df).select(F.col(label).alias("y"), "p")
    with small_batches(df.sparkSession), written(scored, "judged") as judged:
        return {"accuracy": _value(accuracy(judged)), "macro_f1": _value(macro_f1(judged))}


def _value(df: DataFrame) -> float:
    return float(df.first()[0] or 0.0)


# Several labels

def fit_multi_label(
    df: DataFrame,
    classes: Sequence[str] | None = None,
    text: str = "text",
    labels: str = "labels",
    features: Estimator | PipelineModel | None = None,
    objective: Objective = logistic(),
) -> MultiLabelModel:
    """One balanced binary classifier per class, all fitted in the same passes (jobs).

    A class that all or no rows have gets a constant score.
    """
    names = list(classes) if classes is not None else label_classes(df, labels)
    hot = multi_hot(df, labels, names)
    with fitted_vectors(hot, text, features, "hot") as (table, model):
        counts = table.agg(
            F.count("*").alias("rows"),
            F.array(*[F.sum(F.get("hot", i)) for i in range(len(names))]).alias("ones"),
        ).first()
        rows, ones = counts["rows"], np.array([n or 0 for n in counts["ones"]])
        some = np.flatnonzero((ones > 0) & (ones < rows))
        matrix = np.zeros((len(names), _width(table)))
        intercepts = np.where((ones > 0) & (ones == rows), np.inf, -np.inf)
        if len(some):
            weights = multi_label_weights(rows, ones[some])
            chosen = F.filter("hot", lambda x, i: i.isin(some.tolist()))
            matrix[some], intercepts[some] = solve(
                table.withColumn("hot", chosen), matrix.shape[1], weights,
                np.full(len(some), rows), objective,
            )
    return MultiLabelModel(model, names, matrix, intercepts)


def evaluate_multi(model: LinearModel, df: DataFrame, labels: str = "labels") -> dict:
    scored = model.predict(df).select(F.col(labels).alias("y"), "p")
    with small_batches(df.sparkSession), written(scored, "judged") as judged:
        return {
            "micro_f1": _value(micro_f1(judged, model.labels)),
            "macro_f1": _value(macro_f1(judged, model.labels)),
        }


def fit_gradients(
    model: LinearModel, df: DataFrame, label: str = "label", objective: Objective = logistic()
) -> DataFrame:
    """``label, gradient, total``: the gradient's norm of each fitted label's objective, and its
    summed row weights (jobs).

    The objective is convex, so a model is fitted as well as its gradients are small. They are
    summed here from the model's own decision values, apart from the solver.
    """
    multi = dict(df.dtypes)[label].startswith("array")
    if not multi:
        df = df.where(F.col(label).isNotNull()).withColumn("_own", F.array(label))
    known = [i for i, b in enumerate(model.intercepts) if np.isfinite(b)]
    if not multi and len(model.labels) == 2:
        known = [1]
    names = [model.labels[i] for i in known]
    hot = multi_hot(tfidf_transform(model.features, df), label if multi else "_own", model.labels)
    scored = decision_values(hot, {"_margins": model})
    found = scored.select("features", "hot", "_margins")
    with small_batches(df.sparkSession), written(found, "gradients") as rows:
        counts = rows.agg(
            F.count("*").alias("rows"),
            F.array(*[F.sum(F.get("hot", i)) for i in range(len(model.labels))]).alias("ones"),
        ).first()
        ones = [counts["ones"][i] for i in known]
        coupled = isinstance(model, SingleLabelModel) and objective.loss == "logistic"
        softmax = coupled and len(names) > 1
        if multi:
            weights = multi_label_weights(counts["rows"], ones)
        else:
            weights = single_label_weights(counts["rows"], counts["ones"], coupled)
        totals = summed_weights(counts["rows"], ones, weights)
        table = df.sparkSession.createDataFrame(
            [
                (place, k, name, *map(float, (*weights[:, k], totals[k], model.intercepts[place])))
                for k, (place, name) in enumerate(zip(known, names))
            ],
            "place int, k int, label string, negative double, positive double, total double, b double",
        )
        shares = softmax_scores(F.col("_margins")) if softmax else sigmoid_scores(F.col("_margins"))
        own = F.get("hot", F.lit(0)) * 0.0
        weight_of = F.array(*[F.lit(float(w)) for w in weights[1]])
        if softmax:
            own = F.aggregate(
                F.zip_with("hot", weight_of, lambda y, w: y * w), F.lit(0.0), lambda a, x: a + x
            )
        each = rows.select(
            "features", own.alias("own"),
            F.posexplode(F.arrays_zip("hot", "_margins", shares.alias("share"))).alias("place", "x"),
        ).join(F.broadcast(table), "place")  # a row per label
        y, weight = F.col("x.hot"), F.when(F.col("x.hot") == 1, F.col("positive")).otherwise(F.col("negative"))
        side = 2 * y - 1
        if softmax:
            slope = F.col("own") * (F.col("x.share") - y)
        elif objective.loss == "logistic":
            slope = weight * (F.col("x.share") - y)
        else:
            slope = -2 * weight * side * F.greatest(F.lit(0.0), 1 - side * F.col("x._margins"))
        each = each.withColumn("slope", objective.c * slope)
        sums = (
            each.select("k", "slope", F.inline(F.arrays_zip("features.indices", "features.values")))
            .groupBy("k", F.col("indices").alias("idx"))
            .agg(F.sum(F.col("slope") * F.col("values")).alias("g"))
        )
        held = df.sparkSession.createDataFrame(
            [(k, model.coefficients[place].tolist()) for k, place in enumerate(known)],
            "k int, coefficients array<double>",
        ).select("k", F.posexplode("coefficients").alias("idx", "w"))
        squares = held.join(sums, ["k", "idx"], "left").groupBy("k").agg(
            F.sum((F.col("w") + F.coalesce("g", F.lit(0.0))) ** 2).alias("square")
        )
        intercept = F.sum("slope") + (F.first("b") if objective.loss == "squared_hinge" else 0)
        ends = each.groupBy("k", "label", "total").agg(intercept.alias("end"))
        found = ends.join(squares, "k").select(
            "label", F.sqrt(F.col("square") + F.col("end") ** 2).alias("gradient"), "total"
        )
        return df.sparkSession.createDataFrame(found.toArrow())  # a row per label


# Comparison and the training driver

def fit_linear_svm(df: DataFrame, label: str, text: str = "text", **options):
    """Balanced linear SVM; a label-list column gives a multi-label model.

    A class weighs n / (classes * its rows) as the positive side and 1 among the rest; with
    two classes both sides have their class weight.
    """
    if dict(df.dtypes)[label].startswith("array"):
        return fit_multi_label(df, text=text, labels=label, objective=linear_svm(), **options)
    return fit_single_label(df, text=text, label=label, objective=linear_svm(), **options)


def split_table(
    df: DataFrame,
    row_id: str,
    label: str,
    test: float | int | None = None,
    features: Estimator | None = None,
) -> tuple[DataFrame, str]:
    """The rows with ``is_test`` as a table of the shared folder, and its path (jobs).

    The loader's text work runs once, before the passes of the split. Label lists
    split at random, single labels by class. With ``features`` the table holds what they are
    fitted on and made of in place of the text.
    """
    with written(df, "loaded") as loaded:
        if test is None:
            test = split_size(loaded.count())
        if dict(df.dtypes)[label].startswith("array"):
            split = split_random(loaded, row_id, SEED, test)
        else:
            split = split_stratified(loaded, row_id, label, SEED, test)
        if features is not None:
            read, source = _read_by(features), features.extractor().getInputCol()
            kept = [c for c in split.columns if c != source and c not in read]
            split = features.extractor().with_words(split).select(*kept, *read)
        return materialize(split, "split")


def split_parts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(~F.col("is_test")).drop("is_test"), df.where("is_test").drop("is_test")


@contextmanager
def split_vectors(
    df: DataFrame,
    row_id: str,
    label: str,
    text: str = "text",
    test: float | int | None = None,
    features: Estimator | None = None,
) -> Iterator[tuple[DataFrame, PipelineModel]]:
    """The split rows with feature vectors instead of texts, and the feature pipeline, fitted on
    the training rows (jobs). Texts are tokenised once."""
    features = features or Tfidf(input_col=text)
    table, path = split_table(df, row_id, label, test, features)
    with ExitStack() as held:
        try:
            model = features.fit(table.where(~F.col("is_test")))
            kept = [c for c in (*df.columns, "is_test") if c != text]
            vectors = tfidf_transform(model, table).select(*kept, "features")
            rows = held.enter_context(written_vectors(vectors, "vectors", "features"))
        finally:  # the words go once the vectors are written
            remove_path(df.sparkSession, path)
        yield rows, model


def compare_models(
    df: DataFrame,
    candidates: Mapping[str, Objective],
    row_id: str,
    text: str = "text",
    label: str = "label",
    test: float | int | None = None,
    features: Estimator | None = None,
) -> DataFrame:
    """``model, accuracy, macro_f1`` of each candidate on one split and one feature table.

    ``features`` replaces the default text features, such as a ``Tfidf`` with other n-grams,
    document-frequency bounds or stop words. They are fitted on the training rows.
    """
    multi = dict(df.dtypes)[label].startswith("array")
    results = []
    with split_vectors(df, row_id, label, text, test, features) as (rows, fitted):
        train, held = split_parts(rows)
        for name, objective in candidates.items():
            fit, of = (fit_multi_label, "labels") if multi else (fit_single_label, "label")
            model = fit(train, text=text, features=fitted, objective=objective, **{of: label})
            scored = model.predict(held).select(F.col(label).alias("y"), "p")
            with small_batches(df.sparkSession), written(scored, "judged") as judged:
                if multi:
                    scores = (subset_accuracy(judged), macro_f1(judged, model.labels))
                else:
                    scores = (accuracy(judged), macro_f1(judged))
                results.append((name, *[_value(s) for s in scores]))
    return df.sparkSession.createDataFrame(
        results, "model string, accuracy double, macro_f1 double"
    )


def compare_texts(
    df: DataFrame,
    texts: Sequence[str],
    candidates: Mapping[str, Objective],
    row_id: str,
    **options,
) -> DataFrame:
    """``compare_models`` for each of several text columns, with the column's name as ``text``."""
    found = [
        compare_models(df, candidates, row_id, text=t, **options).select(F.lit(t).alias("text"), "*")
        for t in texts
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@dataclass(frozen=True)
class TrainingResult:
    target: str
    path: str
    rows: int
    labels: list[str]
    metrics: dict[str, float]
    model_type: str
    dataset: str


def train_target(
    target: str, df: DataFrame, out: str, row_id: str, dataset: str = ""
) -> TrainingResult:
    """Split, fit, evaluate and save one target; ``df`` comes from a training loader."""
    multi = "labels" in df.columns
    label = "labels" if multi else "label"
    with split_vectors(df, row_id, label) as (table, features):
        rows, names = table.count(), label_classes(table, label)
        train, held = split_parts(table)
        if multi:
            model = fit_multi_label(train, names, features=features)
            metrics = evaluate_multi(model, held)
        else:
            model = fit_single_label(train, features=features)
            metrics = evaluate_single(model, held)
        model.save(out)
    kind = MULTI_TYPE if multi else SINGLE_TYPE
    return TrainingResult(target, out, rows, names, metrics, kind, dataset)


LOADERS = {"category": load_category, "priority": load_priority, "intent": load_intent}


def train_all(
    spark: SparkSession,
    sources: Mapping[str, DataFrame],
    out: str,
    row_id: str = "id",
    limit: int | None = None,
) -> DataFrame:
    """Train each given target under ``out`` and return its new registry rows (jobs)."""
    def job(target: str) -> Callable[[], TrainingResult]:
        rows = limit_rows(sources[target], limit, row_id)
        loaded = LOADERS[target](rows, keep=[row_id])
        return lambda: train_target(target, loaded, f"{out}/{target}", row_id)

    # One after the other: each is distributed, and their tables would add up on the disks.
    results = [job() for job in [job(t) for t in LOADERS if t in sources]]
    entries = spark.createDataFrame(
        [(r.target, r.model_type, r.path, r.rows, r.labels, r.metrics, r.dataset, None)
         for r in results],
        REGISTRY,
    ).withColumn("updated_at", F.current_timestamp())
    append_registry(entries, f"{out}/registry")
    return entries
