"""Scoring tickets with fitted models or a user's own scorer."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdesk.functions.decode import decode_multi, decode_single
from sparkdesk.functions.text import combine_title_body, format_predictions, mark_tickets
from sparkdesk.operators.reports import prediction_log
from sparkdesk.plans.linear import LinearModel, MultiLabelModel, SingleLabelModel, decision_values
from sparkdesk.session import small_batches, written
from sparkdesk.sources.tables import read_tickets_csv, require_columns, write_csv

# Fixed value: backend name of the default models.
BACKEND = "TF-IDF + LogisticRegression (Baseline)"

# Feature rows sent to an external scorer at once.
SCORER_BATCH = 1024


@dataclass
class TicketModels:
    category: MultiLabelModel
    priority: SingleLabelModel
    intent: SingleLabelModel

    @staticmethod
    def load(spark: SparkSession, path: str) -> TicketModels:
        return TicketModels(
            MultiLabelModel.load(spark, f"{path}/category"),
            SingleLabelModel.load(spark, f"{path}/priority"),
            SingleLabelModel.load(spark, f"{path}/intent"),
        )


def probabilities(model: LinearModel, df: DataFrame, out: str) -> DataFrame:
    """``df`` plus one probability per label of the model."""
    return decision_values(df, {out: model}).withColumn(out, model.shares(F.col(out)))


def _with_terms(df: DataFrame, models: TicketModels) -> DataFrame:
    """Extract the terms once if the three models want the same ones."""
    extractors = [
        m.features.stages[0] for m in (models.category, models.priority, models.intent)
    ]
    if len({e.settings() for e in extractors}) == 1:
        return extractors[0].transform(df)
    return df


def predict_batch(df: DataFrame, models: TicketModels) -> DataFrame:
    """``df`` plus ``category``, ``priority`` and ``intent``; narrow, without a shuffle.

    One pass through Python multiplies the features of all three models with their matrices.
    """
    require_columns(df, ["title", "body"], "table", list_all=True)
    kept = df.columns
    scored = df.withColumn("text", combine_title_body(F.col("title"), F.col("body")))
    named = {f"{t}_margins": getattr(models, t) for t in ("category", "priority", "intent")}
    scored = decision_values(_with_terms(scored, models), named)
    category, priority, intent = (m.shares(F.col(name)) for name, m in named.items())
    return scored.select(
        *kept,
        decode_multi(category, models.category.labels).alias("category"),
        decode_single(priority, models.priority.labels).alias("priority"),
        decode_single(intent, models.intent.labels).alias("intent"),
    )


def prediction_json(*extra: str) -> Column:
    return F.to_json(F.struct("category", "priority", "intent", *extra))


def flatten_predictions(df: DataFrame) -> DataFrame:
    """Predictions as plain columns plus their JSON text."""
    rest = [c for c in df.columns if c not in ("category", "priority", "intent")]
    return df.select(
        *rest,
        format_predictions(F.col("category")).alias("category"),
        F.col("priority.label").alias("priority"),
        F.col("priority.confidence").alias("priority_confidence"),
        F.col("intent.label").alias("intent"),
        F.col("intent.confidence").alias("intent_confidence"),
        prediction_json().alias("prediction_json"),
    )


def with_json(df: DataFrame, out: str = "prediction") -> DataFrame:
    """Predictions folded into one JSON column."""
    return df.withColumn(out, prediction_json()).drop("category", "priority", "intent")


def attach_run(df: DataFrame, total_ms: float, rows: int, backend: str = BACKEND) -> DataFrame:
    """Backend name and latency per ticket of a scoring run."""
    return df.withColumns(
        {"model_backend": F.lit(backend), "latency_ms": F.lit(round(total_ms / max(rows, 1), 2))}
    )


def external_scorer(
    make_predict_fn: Callable, input_shape: Sequence[int], batch_size: int = SCORER_BATCH
) -> Callable[[Column], Column]:
    """A user's NumPy model as ``features -> array<double>`` column.

    ``make_predict_fn`` loads the model once per Python worker and returns a function
    from a batch of feature rows to a batch of score rows.
    """
    return predict_batch_udf(
        make_predict_fn,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[list(input_shape)],
    )


def score_table(
    spark: SparkSession,
    source: str | DataFrame,
    target: str,
    models: TicketModels,
    rejected: str | None = None,
    log: str | None = None,
) -> DataFrame:
    """Score a ticket CSV (or table) into a predictions CSV; returns what was written.

    Every row is scored, once. With a ``rejected`` path, rows that break the request limits
    go there instead. With a ``log`` path, a row per prediction with the run's latency per
    ticket is appended to that Parquet table.
    """
    start = time.monotonic()
    tickets = read_tickets_csv(spark, source) if isinstance(source, str) else source
    require_columns(tickets, ["title", "body"], "table", list_all=True)
    if rejected is None:
        return _score_and_log(spark, tickets, target, models, log, start)
    with written(mark_tickets(tickets), "tickets") as marked:
        write_csv(marked.where(F.col("reject_reason").isNotNull()), rejected)
        valid = marked.where(F.col("reject_reason").isNull()).drop("reject_reason")
        return _score_and_log(spark, valid, target, models, log, start)


def _score_and_log(spark, tickets, target, models, log, start) -> DataFrame:
    with small_batches(spark), written(predict_batch(tickets, models), "scored") as scored:
        result = flatten_predictions(scored)
        write_csv(result, target)
        if log is not None:
            rows, spent = scored.count(), (time.monotonic() - start) * 1000
            run = prediction_log(attach_run(scored, spent, rows))
            run.write.mode("append").parquet(log)
        return read_tickets_csv(spark, target, result.schema)
