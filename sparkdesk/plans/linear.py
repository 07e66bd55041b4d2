"""Linear classifiers over sparse features: one coefficient matrix per model.

Decision values of all labels, and of several models, come out of a single pass that multiplies a
batch of sparse rows with the matrices in NumPy. The length of a plan depends neither on the
number of labels nor on the vocabulary.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdesk.functions.decode import decode_single, sigmoid_scores, softmax_scores
from sparkdesk.operators.features import sparse_column, tfidf_transform
from sparkdesk.sources.registry import load_model, save_model

# Numbers of one intermediate product in a task.
CELLS = 1 << 21


def sparse_products(
    indices: pa.ListArray, values: pa.ListArray, matrix: np.ndarray, intercepts: np.ndarray
) -> pa.ListArray:
    """Rows (indices, values) times a matrix (index, label), plus the intercepts."""
    sizes = np.asarray(indices.value_lengths(), np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    index = indices.flatten().to_numpy(zero_copy_only=False)
    value = values.flatten().to_numpy(zero_copy_only=False)
    out = np.tile(intercepts, (len(sizes), 1))
    most = max(1, CELLS // max(1, len(intercepts)))
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + most, side="right")) - 1)
        part = slice(starts[at], starts[end])
        filled = np.flatnonzero(sizes[at:end])
        if len(filled):
            terms = matrix[index[part]] * value[part][:, None]
            out[at + filled] += np.add.reduceat(terms, starts[at:end][filled] - starts[at], axis=0)
        at = end
    offsets = np.arange(len(sizes) + 1, dtype=np.int32) * len(intercepts)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))


@dataclass
class LinearModel:
    """Feature pipeline, label names, and for each label a row of coefficients and an intercept.

    An infinite intercept stands for a label without a classifier, whose score is constant.
    """

    features: PipelineModel
    labels: list[str]
    coefficients: np.ndarray
    intercepts: np.ndarray

    def shares(self, margins: Column) -> Column:
        """Decision values as scores in [0, 1]."""
        raise NotImplementedError

    def chosen(self, margins: Column) -> Column:
        """The predicted label of decision values, or the list of them."""
        return decode_single(margins, self.labels)["label"]

    def scores(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` plus an array with one score per label."""
        return decision_values(df, {out: self}).withColumn(out, self.shares(F.col(out)))

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        """``df`` plus the prediction."""
        found = decision_values(df, {"_margins": self})
        return found.withColumn(out, self.chosen(F.col("_margins"))).drop("_margins")

    def save(self, path: str) -> None:
        save_model(self.features, f"{path}/features")
        rows = [
            (i, label, float(self.intercepts[i]), self.coefficients[i].tolist())
            for i, label in enumerate(self.labels)
        ]
        SparkSession.getActiveSession().createDataFrame(
            rows, "position int, label string, intercept double, coefficients array<double>"
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearModel:
        features = load_model(spark, f"{path}/features")
        rows = spark.read.parquet(f"{path}/labels").orderBy("position").toArrow()
        flat = rows["coefficients"].combine_chunks().flatten().to_numpy()
        return cls(
            features,
            rows["label"].to_pylist(),
            flat.reshape(rows.num_rows, -1),
            rows["intercept"].to_numpy(),
        )


@dataclass
class SingleLabelModel(LinearModel):
    """One label per row, scored by softmax."""

    def shares(self, margins: Column) -> Column:
        return softmax_scores(margins)


@dataclass
class MultiLabelModel(LinearModel):
    """Any number of labels per row, each scored by its own sigmoid."""

    @property
    def constant(self) -> dict[str, float]:
        """Scores of the labels that all or no training rows had."""
        return {x: float(b > 0) for x, b in zip(self.labels, self.intercepts) if np.isinf(b)}

    def shares(self, margins: Column) -> Column:
        return sigmoid_scores(margins)

    def chosen(self, margins: Column) -> Column:
        names = F.array(*[F.lit(x) for x in self.labels])
        hits = F.transform(self.shares(margins), lambda s, i: F.when(s > 0.5, F.get(names, i)))
        return F.array_compact(hits)


@dataclass
class OneVsRestModel(SingleLabelModel):
    """One label per row: the largest decision value of binary classifiers."""

    def scores(self, df: DataFrame, out: str) -> DataFrame:
        return decision_values(df, {out: self})


def decision_values(df: DataFrame, models: Mapping[str, LinearModel]) -> DataFrame:
    """``df`` plus one array of decision values per model, by the models' names.

    Matrices are shipped to the tasks: labels x features numbers, which the driver held when the
    model was fitted or loaded.
    """
    kept, parts = df.columns, []
    for i, model in enumerate(models.values()):
        out = model.features.stages[-1].getOutputCol()
        present = out in df.columns
        df = tfidf_transform(model.features, df)
        vector = sparse_column(df, out)
        df = df.withColumn(f"_sparse_{i}", F.struct(vector["indices"], vector["values"]))
        df = df if present else df.drop(out)
        parts.append(f"_sparse_{i}")
    stored = [(np.ascontiguousarray(m.coefficients.T), m.intercepts) for m in models.values()]
    shipped = df.sparkSession.sparkContext.broadcast(stored)
    names = list(models)
    kind = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in names])

    @F.arrow_udf(kind)
    def margins(rows: pa.Array) -> pa.Array:
        found = []
        for sparse, (matrix, intercepts) in zip(rows.flatten(), shipped.value):
            indices, values = sparse.flatten()
            found.append(sparse_products(indices, values, matrix, intercepts))
        return pa.StructArray.from_arrays(found, names)

    scored = df.select(*[F.col(f"`{c}`") for c in kept], margins(F.struct(*parts)).alias("_found"))
    rest = [F.col(f"`{c}`") for c in kept if c not in names]
    return scored.select(*rest, *[F.col("_found")[n].alias(n) for n in names])
