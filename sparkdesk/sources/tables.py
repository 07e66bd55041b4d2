"""Table scans and sinks, column checks and label-id decoding."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdesk.functions.decode import label_array

RAW_ISSUES = T.StructType(
    [T.StructField("id", T.LongType())]
    + [
        T.StructField(name, T.StringType())
        for name in ("repo", "title", "body", "labels", "severity", "priority")
    ]
)


def text_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


TICKETS = text_schema("title", "body")
CATEGORY_ROWS = text_schema("title", "body", "labels-mapped")
PRIORITY_ROWS = text_schema("title", "body", "priority")
INTENT_ROWS = text_schema("text", "intent")

# Quotes are doubled inside quoted fields; white space and empty text are data.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "multiLine": "true",
    "lineSep": "\n",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    # A value longer than the reader's default buffer limit is still one value.
    "maxCharsPerColumn": "-1",
}


def read_tickets_csv(spark: SparkSession, path: str, schema: T.StructType = TICKETS) -> DataFrame:
    """CSV with header; bodies may hold newlines and quotes, empty cells are null.

    A multi-line CSV file is read by one task, so keep many files of moderate size
    (``write_csv`` makes one per partition) and convert large inputs to Parquet once.
    """
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def read_table(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Parquet scan; ``partitions`` deals the rows out anew, for heavy work on a few splits."""
    df = spark.read.parquet(path)
    return df if partitions is None else df.repartition(partitions)


def write_csv(df: DataFrame, path: str, cols: Sequence[str] | None = None) -> None:
    """Write the given columns with header; arrays, maps and structs become JSON text."""
    kinds = dict(df.dtypes)

    def cell(name: str) -> Column:
        nested = kinds[name].startswith(("array", "map", "struct"))
        return F.to_json(df[f"`{name}`"]).alias(name) if nested else df[f"`{name}`"]

    df.select(*[cell(c) for c in (cols or df.columns)]).write.mode("overwrite").options(
        **{k: v for k, v in CSV_OPTIONS.items() if k not in ("multiLine", "maxCharsPerColumn")}
    ).csv(path)


def require_columns(
    df: DataFrame, cols: Iterable[str], what: str = "table", list_all: bool = False
) -> DataFrame:
    """Fail at plan time if a column is absent; names the missing ones, or all required."""
    required = set(cols)
    missing = required.difference(df.columns)
    if missing and list_all:
        raise ValueError(f"{what} must contain columns: {', '.join(sorted(required))}")
    if missing:
        raise ValueError(f"{what} is missing columns: {sorted(missing)}")
    return df


def limit_rows(df: DataFrame, n: int | None, order_by: str | Sequence[str]) -> DataFrame:
    """First ``n`` rows in the given order; ``None`` keeps all."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df if n is None else df.orderBy(*keys).limit(n)


def pick_column(df: DataFrame, candidates: Sequence[str], default_last: bool = False) -> str:
    """First candidate present, or the table's last column if that is allowed."""
    for name in candidates:
        if name in df.columns:
            return name
    if default_last:
        return df.columns[-1]
    raise ValueError(f"none of {list(candidates)} is a column")


def intent_frame(df: DataFrame) -> DataFrame:
    """Utterance and intent columns of a chat dataset, renamed to ``text`` and ``intent``."""
    text = pick_column(df, ["instruction", "utterance"])
    intent = pick_column(df, ["intent"], default_last=True)
    return df.select(F.col(text).alias("text"), F.col(intent).alias("intent"))


def decode_label_id(df: DataFrame, col: str, names: Sequence[str], out: str) -> DataFrame:
    return df.withColumn(out, F.get(label_array(names), F.col(col)))
