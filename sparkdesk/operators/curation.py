"""Row filters, label taxonomy joins and dataset curation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdesk.functions.labels import (
    UNKNOWN,
    consolidate_labels,
    group_or_unknown,
    resolve_groups,
    severity_priority,
)
from sparkdesk.functions.text import NOT_WS, add_once, light_clean


def drop_empty(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows where any listed text is Unicode white space alone, or any array is empty."""
    kinds = dict(df.dtypes)
    for name in cols:
        column = F.col(f"`{name}`")
        is_array = kinds[name].startswith("array")
        df = df.where(F.size(column) > 0 if is_array else column.rlike(NOT_WS))
    return df


def drop_class(df: DataFrame, col: str, value: str = "oos") -> DataFrame:
    """Drop one class; rows without a class stay."""
    return df.where(~F.col(col).eqNullSafe(value))


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def class_filter(df: DataFrame, col: str, value: str) -> DataFrame:
    return df.where(F.col(col) == value)


def union_splits(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def map_labels_join(
    df: DataFrame,
    dim: DataFrame,
    labels: str = "labels",
    out: str = "mapped",
    alias: str = "alias",
    group: str = "group",
) -> DataFrame:
    """Label mapping through an alias table of any size.

    Labels are compared in lower case with the aliases as they stand; an alias given twice
    contributes both groups. Each distinct label list is mapped once, so a list shared by a
    third of the rows is a single row of the mapping; the join back is broadcast or shuffled
    by its size at run time, and adaptive skew handling splits its hot keys.
    """
    lists = df.select(labels).where(F.col(labels).isNotNull()).distinct()
    items = lists.select(labels, F.posexplode_outer(labels).alias("pos", "label"))
    aliases = dim.select(F.col(alias).alias("alias"), F.col(group).alias("found"))
    found = items.join(aliases, F.lower(items["label"]) == aliases["alias"], "left").select(
        labels, F.struct("pos", group_or_unknown(F.col("found")).alias("group")).alias("item")
    )
    mapped = found.groupBy(labels).agg(
        resolve_groups(F.array_sort(F.collect_list("item"))["group"]).alias(out)
    )
    return df.join(mapped, labels, "left").withColumn(
        out, F.coalesce(F.col(out), F.array(F.lit(UNKNOWN)))
    )


def is_unknown(col: str) -> Column:
    return F.col(col) == F.array(F.lit(UNKNOWN))


def split_unknown(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a known label, rows labelled exactly ``[unknown]``)."""
    return df.where(~is_unknown(col)), df.where(is_unknown(col))


def consolidate_rare(df: DataFrame, col: str) -> DataFrame:
    """Merge rare labels and drop the rows that lose all of theirs."""
    return add_once(df, col, consolidate_labels(F.col(col))).where(F.size(col) > 0)


def severity_to_priority(df: DataFrame, severity: str = "severity") -> DataFrame:
    """Map severities to priorities and clean the texts.

    Rows without a mapped severity, or without any text, are dropped.
    """
    mapped = (
        drop_null(df, [severity])
        .withColumn("priority", severity_priority(F.col(severity)))
        .where(F.col("priority").isNotNull())
        .drop(severity)
    )
    cleaned = F.struct(*[light_clean(F.col(c)).alias(c) for c in ("title", "body")])
    return (
        add_once(mapped, "_clean", cleaned)
        .where((F.length("_clean.title") > 0) | (F.length("_clean.body") > 0))
        .withColumns({c: F.col(f"_clean.{c}") for c in ("title", "body")})
        .drop("_clean")
    )
