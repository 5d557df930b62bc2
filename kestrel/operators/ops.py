"""Service and experiment analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Latency bucket upper bounds in seconds, the histogram watched by the service.
LATENCY_BUCKETS = [0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5]


def request_counts(requests: DataFrame) -> DataFrame:
    """Requests per (method, endpoint, status)."""
    return requests.groupBy("method", "endpoint", "status").agg(F.count(F.lit(1)).alias("n"))


def latency_histogram(df: DataFrame, col: str, buckets: Sequence[float] = LATENCY_BUCKETS,
                      by: Sequence[str] = ()) -> DataFrame:
    """Cumulative ``le`` buckets (+Inf), sum and count — one aggregate, then unpivot."""
    aggs = [F.count_if(F.col(col) <= b).alias(f"le_{i}") for i, b in enumerate(buckets)]
    aggs += [F.count(F.col(col)).alias("le_inf"), F.sum(col).alias("sum"), F.count(F.col(col)).alias("count")]
    g = df.groupBy(*by).agg(*aggs)
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{i}").alias("n")) for i, b in enumerate(buckets)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("le_inf").alias("n")))
    return g.select(*by, "sum", "count", F.explode(F.array(*rows)).alias("b")).select(*by, "b.le", "b.n", "sum", "count")


def prediction_counters(preds: DataFrame, version: str = "model_version") -> DataFrame:
    """Toxic / non-toxic counts and mean confidence per model version."""
    return preds.groupBy(version).agg(F.count_if(F.col("prediction") == 1).alias("toxic"),
                                      F.count_if(F.col("prediction") != 1).alias("non_toxic"),
                                      F.avg("confidence").alias("mean_confidence"))


def run_table(long: DataFrame) -> DataFrame:
    """Pivot the run long table (from ``read_runs``) to one row per run."""
    meta = (long.filter(F.col("kind") == "meta")
            .groupBy("run_id").pivot("key", ["run_name", "status", "start_time", "end_time"]).agg(F.first("value")))
    parent = (long.filter((F.col("kind") == "tags") & (F.col("key") == "mlflow.parentRunId"))
              .select("run_id", F.col("value").alias("parent_run_id")))
    f2 = (long.filter((F.col("kind") == "metrics") & F.col("key").isin("f2_score", "test_f2_score"))
          .groupBy("run_id").agg(F.max(F.col("value").cast("double")).alias("f2")))
    out = meta.join(parent, "run_id", "left").join(f2, "run_id", "left")
    return out.withColumn("duration_s", (F.col("end_time").cast("long") - F.col("start_time").cast("long")) / 1000.0)


def leaderboard(runs: DataFrame) -> DataFrame:
    """Per parent run the best child by F2, plus trial and failure counts."""
    kids = runs.filter(F.col("parent_run_id").isNotNull())
    return kids.groupBy("parent_run_id").agg(
        F.max_by("run_id", F.col("f2")).alias("best_run"), F.max("f2").alias("best_f2"),
        F.count(F.lit(1)).alias("trials"), F.count_if(F.col("status") == "4").alias("failed"),
        F.sum("duration_s").alias("total_duration_s"))
