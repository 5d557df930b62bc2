"""Model training and batch scoring with Spark ML.

Learners are distributed Spark ML estimators (L-BFGS / tree aggregation), so the training
matrix is never collected.  Class imbalance uses a weight column derived from A3.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCAModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .svd import PopulationScaler, TruncatedSVD


def with_class_weights(df: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    """A3 → M7: positives weighted by negatives/positives, 1 if there are none (a scalar subquery)."""
    w = df.agg(F.try_divide(F.count_if(F.col(label) == 0).cast("double"), F.count_if(F.col(label) == 1)).alias("w")).scalar()
    return df.withColumn(weight, F.when(F.col(label) == 1, F.coalesce(w, F.lit(1.0))).otherwise(F.lit(1.0)))


def feature_stages(vec_col: str, tabular: Sequence[str], k: int, output: str = "features") -> list:
    """M3 (uncentred truncated SVD to k) and M4 (standard scaling of the tabular columns) fused by M5.

    The scaler is fitted with the pipeline, on the training rows; std 0 counts as 1.
    """
    stages = [TruncatedSVD(k, vec_col, "reduced")]
    if tabular:
        stages += [VectorAssembler(inputCols=list(tabular), outputCol="tabular", handleInvalid="keep"),
                   PopulationScaler("tabular", "scaled")]
    return [*stages, VectorAssembler(inputCols=["reduced", *(["scaled"] if tabular else [])], outputCol=output, handleInvalid="keep")]


def training_pipeline(vec_col: str, tabular: Sequence[str], k: int = 16, reg: float = 0.01) -> Pipeline:
    """M3 + M4 → M5 (fuse) → M7 (weighted logistic regression)."""
    return Pipeline(stages=[*feature_stages(vec_col, tabular, k),
                            LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                                               regParam=reg, maxIter=50, probabilityCol="probability")])


def variance_retained(model) -> float:
    """M3: share of the vectors' variance that a fitted pipeline's projection keeps."""
    return float(next(s for s in model.stages if isinstance(s, PCAModel)).explainedVariance.toArray().sum())


def score(model, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Transform → P(toxic) → thresholded prediction → folded confidence."""
    out = model.transform(df).withColumn("p_toxic", vector_to_array("probability")[1])
    return out.withColumns({
        "prediction": (F.col("p_toxic") >= threshold).cast("int"),
        "confidence": F.greatest(F.col("p_toxic"), 1 - F.col("p_toxic"))})


def feature_names(k: int, tabular: Sequence[str] = ()) -> list[str]:
    """Names of the fused features, in their order."""
    return [*(f"svd_{i}" for i in range(k)), *tabular]


def feature_importance(model, names: Sequence[str], n: int = 20) -> DataFrame | None:
    """M14 + O8: the ``n`` most important features of a fitted model or pipeline (a bounded top-k).

    Tree models: their importances.  Linear models: mean |coefficient| over the classes.  Others: None.
    """
    from pyspark.sql import SparkSession
    last = model.stages[-1] if hasattr(model, "stages") else model
    if hasattr(last, "featureImportances"):
        found = last.featureImportances.toArray()
    elif hasattr(last, "coefficientMatrix"):
        found = np.abs(last.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(last, "coefficients"):
        found = np.abs(last.coefficients.toArray())
    else:
        return None
    rows = [(names[i] if i < len(names) else f"f{i}", float(x)) for i, x in enumerate(found)]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(n)


coefficient_importance = feature_importance


def embeddings_frame(emb: DataFrame) -> DataFrame:
    """Embeddings table → (vec_id, vector, label % 2) for training."""
    return emb.select("vec_id", array_to_vector("embedding").alias("vec"), (F.col("label") % 2).alias("label"))


def _f2_on(pred: DataFrame, threshold: float = 0.5) -> float:
    """F2 of a scored frame (one aggregate; a single scalar comes back)."""
    from .ml import classification_metrics
    return float(classification_metrics(pred, threshold, "label", "p_toxic").first()["f2_score"])


def _learner(kind: str, params: dict):
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    common = dict(featuresCol="features", labelCol="label", weightCol="weight")
    if kind == "logistic":
        return LogisticRegression(probabilityCol="probability", maxIter=50, **common, **params)
    if kind == "random_forest":
        return RandomForestClassifier(seed=42, **common, **params)
    if kind == "gbt":
        return GBTClassifier(seed=42, **common, **params)
    raise ValueError(kind)


SEARCH_SPACE = {
    "logistic": {"regParam": [0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5]},
    "random_forest": {"numTrees": [20, 50], "maxDepth": [3, 5, 8]},
    "gbt": {"maxIter": [20, 50], "maxDepth": [2, 3, 4]},
}


def reduced_once(train: DataFrame, *others: DataFrame, vec_col: str = "vec", k: int = 16, tabular: Sequence[str] = ()) -> list[DataFrame]:
    """M3–M5 fitted on ``train`` once; all frames with their ``features``, kept until unpersisted."""
    model = Pipeline(stages=feature_stages(vec_col, tabular, k)).fit(train)
    made = [c for c in ("reduced", "tabular", "scaled", vec_col)]
    return [model.transform(df).drop(*made).persist() for df in (train, *others)]


ROWS_TO_A_TASK = 20_000
FITS_AT_ONCE = 4    # of one model type; small fits mostly wait for the scheduler


def at_once(spark, most: int, run: Callable, items: Sequence) -> list:
    """``run`` of every item, up to ``most`` at a time in threads that submit Spark jobs; results in the items' order."""
    with ThreadPool(processes=max(1, min(most, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(run), items, chunksize=1)


def in_few_tasks(df: DataFrame) -> DataFrame:
    """A kept frame in as many partitions as its rows ask for, at most those it has: an iteration is a job over them."""
    return df.coalesce(max(1, -(-df.count() // ROWS_TO_A_TASK)))


def search(train: DataFrame, val: DataFrame, kind: str) -> tuple[dict, float, object]:
    """M8: every setting of ``SEARCH_SPACE[kind]`` fitted on ``train``; the one of largest F2 on the validation split.

    Both frames come from ``reduced_once``.  Each fit is a distributed Spark ML fit, a few of them at once;
    only its F2 (a scalar) reaches the driver.  Ties go to the setting declared first.  Only the
    boosted trees, whose rounds are many small jobs, are fitted on few partitions: forests draw their bags by
    partition, and a logistic fit whose penalty leaves no weight has scores of one half within rounding.
    """
    import itertools
    val = in_few_tasks(val)
    train = in_few_tasks(train) if kind == "gbt" else train
    space = SEARCH_SPACE[kind]
    best = (None, -1.0, None)
    settings = [dict(zip(space, combo)) for combo in itertools.product(*space.values())]
    learners = [_learner(kind, params) for params in settings]
    for params, model in zip(settings, at_once(train.sparkSession, FITS_AT_ONCE, lambda learner: learner.fit(train), learners)):
        f2 = _f2_on(score(model, val))
        if f2 > best[1]:
            best = (params, f2, model)
    return best


def tournament(train: DataFrame, val: DataFrame, test: DataFrame, kinds=("logistic", "random_forest", "gbt"),
               tabular: Sequence[str] = ()) -> DataFrame:
    """M15 + O9: search each model type's whole space, all types at once, skip failures, rank survivors by test F2 (all failed → error)."""
    from .ml import best_threshold, threshold_sweep
    spark = train.sparkSession
    kept = train, val, test = reduced_once(train, val, test, tabular=tabular)

    def searched(kind: str) -> tuple:
        try:
            params, val_f2, model = search(train, val, kind)
            val_scored = score(model, val).select("label", F.col("p_toxic").alias("score"))
            thr = float(best_threshold(threshold_sweep(val_scored)).first()["threshold"])
            test_f2 = _f2_on(score(model, test), thr)
            return kind, str(params), val_f2, thr, test_f2, None
        except Exception as e:  # noqa: BLE001 — a failing model type is skipped, as in the original
            return kind, None, None, None, None, f"{type(e).__name__}: {str(e)[:200]}"
    rows = at_once(spark, len(kinds), searched, kinds)
    for df in kept:
        df.unpersist()
    if all(r[-1] is not None for r in rows):
        raise RuntimeError("every model type failed")
    board = spark.createDataFrame(rows, "model string, params string, val_f2 double, threshold double, "
                                        "test_f2 double, error string")
    from pyspark.sql import Window
    w = Window.orderBy(F.desc_nulls_last("test_f2"), "model")  # a handful of rows, one per model type
    return board.withColumn("rank", F.row_number().over(w))
