"""Training tables of the three targets: check, clean, normalise, filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdesk.functions.labels import normalize_items, normalize_label, parse_label_list
from sparkdesk.functions.text import add_once, add_text_column, clean_text
from sparkdesk.sources.tables import require_columns


def load_category(
    df: DataFrame, labels: str = "labels-mapped", keep: Sequence[str] = ()
) -> DataFrame:
    """``keep + text, labels`` from title, body and a label list."""
    require_columns(df, ["title", "body", labels], "category dataset")
    column = F.col(f"`{labels}`")
    listed = dict(df.dtypes)[labels].startswith("array")
    parsed = normalize_items(F.coalesce(column, F.array())) if listed else parse_label_list(column)
    named = add_once(df, "labels", parsed).where(F.size("labels") > 0)
    return add_text_column(named).select(*keep, "text", "labels")


def load_priority(df: DataFrame, label: str = "priority", keep: Sequence[str] = ()) -> DataFrame:
    """``keep + text, label`` from title, body and a priority."""
    require_columns(df, ["title", "body", label], "priority dataset")
    return (
        add_text_column(df)
        .select(*keep, "text", normalize_label(F.col(label)).alias("label"))
        .where(F.length("label") > 0)
    )


def load_intent(df: DataFrame, label: str = "intent", keep: Sequence[str] = ()) -> DataFrame:
    """``keep + text, label`` from single utterances and their intent."""
    require_columns(df, ["text", label], "intent dataset")
    named = df.select(*keep, "text", normalize_label(F.col(label)).alias("label"))
    cleaned = add_once(named.where(F.length("label") > 0), "text", clean_text(F.col("text")))
    return cleaned.where(F.length("text") > 0)
