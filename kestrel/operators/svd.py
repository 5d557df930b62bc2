"""M3 and M4 as pipeline stages: truncated singular value decomposition without centring, and scaling.

One pass: the Gramian of the vectors with a constant 1 appended is summed by a tree aggregate, so
that squares, column sums and the number of rows come together.  Only that matrix, (d + 1)² numbers
for vectors of d components, reaches the driver, where its eigenvectors are the right singular
vectors.  The model projects rows inside the JVM and can be a stage of a saved pipeline.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.common import _py2java
from pyspark.ml.feature import PCAModel, StandardScalerModel, VectorAssembler
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Svd:
    """Right singular vectors (d, k), singular values and the share of variance each component retains."""
    components: np.ndarray
    singular_values: np.ndarray
    variance_ratio: np.ndarray

    @property
    def variance_retained(self) -> float:
        return float(self.variance_ratio.sum())


def decompose(df: DataFrame, column: str, k: int) -> Svd:
    """The ``k`` largest singular triplets of the rows' matrix (all, if it has fewer columns)."""
    rows = VectorAssembler(inputCols=[column, "__one"], outputCol="__row", handleInvalid="skip").transform(
        df.where(F.col(column).isNotNull()).select(column, F.lit(1.0).alias("__one"))).select("__row")
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "__row")).computeGramianMatrix().toArray()
    n, sums, gram = gram[-1, -1], gram[-1, :-1], gram[:-1, :-1]
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1][:k]
    v = vectors[:, order]
    # The sign of a component is free: its largest entry is made positive.
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    mean = sums / n
    spread = np.einsum("ik,ij,jk->k", v, gram, v) / n - (mean @ v) ** 2
    total = np.trace(gram) / n - mean @ mean
    return Svd(v, np.sqrt(np.maximum(values[order], 0)), np.maximum(spread, 0) / total if total > 0 else np.zeros(len(order)))


class TruncatedSVD(Estimator):
    """Pipeline stage: ``decompose`` on ``input_col``, projections in ``output_col``; the fitted model has ``svd``."""

    def __init__(self, k: int, input_col: str, output_col: str):
        super().__init__()
        self.k, self.input_col, self.output_col = k, input_col, output_col

    def _fit(self, dataset: DataFrame) -> PCAModel:
        svd = decompose(dataset, self.input_col, self.k)
        d, k = svd.components.shape
        sc = dataset.sparkSession.sparkContext
        # Spark's projection stage multiplies by a matrix and centres nothing: it is the projection needed here.
        java = sc._jvm.org.apache.spark.ml.feature.PCAModel(
            self.uid, _py2java(sc, DenseMatrix(d, k, svd.components.ravel(order="F").tolist())), _py2java(sc, DenseVector(svd.variance_ratio.tolist())))
        model = PCAModel(java)
        model._set(k=k, inputCol=self.input_col, outputCol=self.output_col)
        model.svd = svd
        return model


class PopulationScaler(Estimator):
    """M4 as a pipeline stage: (x − mean) / population std of each component, std 0 → 1 (Q20)."""

    def __init__(self, input_col: str, output_col: str):
        super().__init__()
        self.input_col, self.output_col = input_col, output_col

    def _fit(self, dataset: DataFrame) -> StandardScalerModel:
        s = dataset.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(self.input_col)).alias("s")).first()["s"]
        std = np.sqrt(s["variance"].toArray() * (s["count"] - 1) / max(s["count"], 1))
        sc = dataset.sparkSession.sparkContext
        java = sc._jvm.org.apache.spark.ml.feature.StandardScalerModel(
            self.uid, _py2java(sc, DenseVector(np.where(std > 0, std, 1.0).tolist())), _py2java(sc, DenseVector(s["mean"].toArray().tolist())))
        model = StandardScalerModel(java)
        model._set(withMean=True, withStd=True, inputCol=self.input_col, outputCol=self.output_col)
        return model
