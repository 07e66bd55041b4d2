"""Counts, shares, coverage and dashboard summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdesk.functions.text import display_label, truncate_title
from sparkdesk.operators.curation import union_splits

# Fixed value: share of label uses the most frequent labels should cover.
COVERAGE = 0.83


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """Rows per value, most frequent first, nulls left out."""
    counts = (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), col)
    )
    return counts if n is None else counts.limit(n)


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """Percent of rows per value."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.select(col, (F.col("count") * 100 / total).alias("percent")).orderBy(
        F.desc("percent"), col
    )


def label_counts(df: DataFrame, col: str, n: int | None = 20) -> DataFrame:
    return value_counts(df.select(F.explode_outer(col).alias("label")), "label", n)


def label_coverage(df: DataFrame, col: str, share: float = COVERAGE) -> DataFrame:
    """How many of the most frequent labels reach the share of all label uses.

    Labels with equal counts are taken together, so the running sum goes over the
    distinct counts and stays short however many labels there are.
    """
    uses = (
        df.select(F.explode_outer(col).alias("label"))
        .where(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.count("*").alias("c"))
    )
    levels = uses.groupBy("c").agg(F.count("*").alias("labels"))
    running = Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    upto, total = F.sum(F.col("c") * F.col("labels")), F.sum(F.col("c") * F.col("labels"))
    steps = levels.select(
        "c",
        "labels",
        upto.over(running).alias("upto"),
        F.sum("labels").over(running).alias("n_upto"),
        total.over(Window.partitionBy()).alias("total"),
    ).withColumn("target", F.lit(share) * F.col("total"))
    before = F.col("upto") - F.col("c") * F.col("labels")
    near = F.ceil((F.col("target") - before) / F.col("c"))
    # The division may round across a whole number: settle it on the sums themselves.
    taken = (
        F.when(before + (near - 1) * F.col("c") >= F.col("target"), near - 1)
        .when(before + near * F.col("c") < F.col("target"), near + 1)
        .otherwise(near)
    )
    return (
        steps.where((F.col("upto") >= F.col("target")) & (before < F.col("target")))
        .select(
            (F.col("n_upto") - F.col("labels") + taken).alias("n"),
            ((before + taken * F.col("c")) / F.col("total")).alias("coverage"),
        )
    )


def distinct_classes(df: DataFrame, col: str) -> DataFrame:
    """Sorted class names, each with the number of classes."""
    names = df.where(F.col(col).isNotNull()).select(col).distinct()
    return names.withColumn("classes", names.agg(F.count("*")).scalar()).orderBy(col)


def session_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("predictions"),
        F.avg("priority_conf").alias("avg_priority_conf"),
        F.avg("intent_conf").alias("avg_intent_conf"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    )


def distribution(df: DataFrame, col: str, display: bool = False) -> DataFrame:
    """Value counts, with readable label names if wanted."""
    counts = value_counts(df, col)
    return counts.withColumn(col, display_label(F.col(col))) if display else counts


def recent_predictions(df: DataFrame, n: int | None = None) -> DataFrame:
    """History rows under their dashboard headings; ``n`` keeps the newest, oldest first.

    Rows of one time are told apart by their other columns. Without ``n`` nothing is sorted.
    """
    if n is not None:
        rest = ["title", "priority", "intent", "top_category", "latency_ms"]
        df = df.orderBy(F.desc("timestamp"), *rest).limit(n).orderBy("timestamp", *rest)
    return df.select(
        F.date_format("timestamp", "HH:mm:ss").alias("Time"),
        truncate_title(F.col("title")).alias("Title"),
        F.col("priority").alias("Priority"),
        F.col("intent").alias("Intent"),
        F.col("top_category").alias("Top Category"),
        F.col("latency_ms").alias("Latency (ms)"),
    )


def top_category(field: str, missing) -> Column:
    return F.coalesce(F.get(F.col("category"), 0)[field], F.lit(missing))


def prediction_log(df: DataFrame) -> DataFrame:
    """One log row per prediction: lengths, backend, latency, confidences, labels."""
    return df.select(
        F.length(F.coalesce("title", F.lit(""))).alias("title_length"),
        F.length(F.coalesce("body", F.lit(""))).alias("body_length"),
        F.col("model_backend").alias("backend"),
        "latency_ms",
        F.col("priority.confidence").alias("priority_confidence"),
        F.col("intent.confidence").alias("intent_confidence"),
        top_category("confidence", 0.0).alias("top_category_confidence"),
        F.col("priority.label").alias("predicted_priority"),
        F.col("intent.label").alias("predicted_intent"),
    )


def session_history(df: DataFrame) -> DataFrame:
    """Predictions as history rows (``recent_predictions`` reads these)."""
    return df.select(
        "timestamp",
        truncate_title(F.col("title")).alias("title"),
        F.col("priority.label").alias("priority"),
        F.col("priority.confidence").alias("priority_conf"),
        F.col("intent.label").alias("intent"),
        F.col("intent.confidence").alias("intent_conf"),
        top_category("label", "—").alias("top_category"),
        "latency_ms",
    )


def batch_summary(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Size, latency and time of each batch."""
    return df.groupBy(batch).agg(
        F.count("*").alias("total"),
        F.sum("latency_ms").alias("total_latency_ms"),
        F.avg("latency_ms").alias("avg_latency_ms_per_ticket"),
        F.max("processed_at").alias("processed_at"),
    )


def model_table(registry: DataFrame, metrics: list[str]) -> DataFrame:
    """One display row per target; the named metrics become columns."""
    return registry.select(
        F.initcap("target").alias("Target"),
        F.coalesce("model_type", F.lit("—")).alias("Model"),
        F.coalesce(F.format_number("rows", 0), F.lit("?")).alias("Training Rows"),
        *[
            F.format_number(F.col("metrics")[m], 3).alias(m.replace("_", " ").title())
            for m in metrics
        ],
    )


def dataset_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each named table."""
    return union_splits(
        [
            df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("dataset"), "rows")
            for name, df in tables.items()
        ]
    )
