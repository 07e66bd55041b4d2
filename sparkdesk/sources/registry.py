"""Fitted models on disk and the registry table that describes them."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdesk.session import path_exists

REGISTRY = T.StructType(
    [
        T.StructField("target", T.StringType(), False),
        T.StructField("model_type", T.StringType()),
        T.StructField("artifact", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("dataset", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no model at {path}")
    return PipelineModel.load(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Latest entry per target of the registry table; empty if there is no table yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], REGISTRY)
    return latest_entries(spark.read.schema(REGISTRY).parquet(path))


def append_registry(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def latest_entries(entries: DataFrame, *order: str) -> DataFrame:
    """The newest row of each target, by ``updated_at`` and any further order columns."""
    newest = F.max_by(
        F.struct(*[c for c in entries.columns if c not in order]),
        F.struct("updated_at", *order),
    )
    return entries.groupBy("target").agg(newest.alias("e")).select("e.*")


def upsert_registry(old: DataFrame, new: DataFrame) -> DataFrame:
    """New entries replace old ones of the same target; at equal times the new one wins."""
    return latest_entries(
        old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1))),
        "is_new",
    )


def clean_metrics(metrics: Column, prefix: str = "eval_", digits: int = 4) -> Column:
    """Metrics whose names start with the prefix, without it, rounded."""
    kept = F.map_filter(metrics, lambda k, v: k.startswith(prefix) & v.isNotNull())
    named = F.transform_keys(kept, lambda k, v: F.replace(k, F.lit(prefix), F.lit("")))
    return F.transform_values(named, lambda k, v: F.round(v, digits))
