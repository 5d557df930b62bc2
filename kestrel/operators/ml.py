"""Data side of training and evaluation (M3–M13, M16) as Spark plans.

Metrics are computed from small histograms instead of repeated scans: the threshold sweep
reduces every row to its threshold bucket once (≤ 101 buckets), and ROC-AUC / average
precision reduce rows to one per distinct score, whose running sums are split into score ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running_sums


# --- M6: exact stratified split with bounded tasks --------------------------------------

def stratified_split(df: DataFrame, label: str, id_col: str, seed: str = "42",
                     fractions: Sequence[float] = (0.70, 0.15, 0.15)) -> DataFrame:
    """M6: deterministic stratified split with exact per-class proportions.

    Rows are ordered inside their class by ``md5(id ‖ seed)``; position ``pos`` (0-based) in
    that order decides the split: train if 100·pos < 70·n, val if < 85·n, else test.  The
    position is computed as a two-phase prefix count so no class is ever one task: the hash
    prefix buckets each class, bucket sizes (a small table) give offsets, and a row number
    inside (class, bucket) finishes the job.
    """
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(seed)))
    # Bucket = first three hex digits (4096 buckets); bucket order agrees with full key order.
    d = df.withColumn("__k", key).withColumn("__b", F.conv(F.substring("__k", 1, 3), 16, 10).cast("int"))
    sizes = d.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__bn"))
    wo = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"__off": F.coalesce(F.sum("__bn").over(wo), F.lit(0)),
                               "__n": F.sum("__bn").over(Window.partitionBy(label))})
    sizes = sizes.select(F.col(label).alias("__l"), F.col("__b").alias("__sb"), "__bn", "__off", "__n")
    # Null-safe: rows without a label are a stratum of their own.
    d = d.join(sizes, d[label].eqNullSafe(F.col("__l")) & (F.col("__b") == F.col("__sb"))).drop("__l", "__sb")
    wl = Window.partitionBy(label, "__b").orderBy("__k", id_col)
    pos = F.col("__off") + F.row_number().over(wl) - 1
    d = d.withColumn("__pos", pos)
    a, b = int(round(fractions[0] * 100)), int(round((fractions[0] + fractions[1]) * 100))
    split = (F.when(F.col("__pos") * 100 < F.col("__n") * a, "train")
             .when(F.col("__pos") * 100 < F.col("__n") * b, "val").otherwise("test"))
    return d.withColumn("split", split).drop("__k", "__b", "__bn", "__off", "__n", "__pos")


# --- M9/M10: threshold sweep and metrics -------------------------------------------------

def threshold_bucket(p: Column, lo: int = 10, hi: int = 89) -> Column:
    """Largest integer percent k with k/100 ≤ p (same double comparison as p >= k/100), clamped."""
    k0 = F.floor(p * 100)
    k1 = (F.when((k0 + 1) / F.lit(100.0) <= p, k0 + 1)
          .when(k0 / F.lit(100.0) > p, k0 - 1).otherwise(k0))
    return F.least(F.greatest(k1, F.lit(lo - 1)), F.lit(hi)).cast("int")


def _fbeta(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    b2 = beta * beta
    den = (1 + b2) * tp + b2 * fn + fp
    return F.when(den > 0, (1 + b2) * tp / den).otherwise(F.lit(0.0))


def threshold_sweep(scores: DataFrame, label: str = "label", score: str = "score",
                    lo: int = 10, hi: int = 89, beta: float = 2.0) -> DataFrame:
    """M9: precision, recall, F1 and F-beta at thresholds lo/100 … hi/100 (integer percents, Q21).

    One pass builds a histogram of (bucket, positives, negatives); predicted-positive counts
    at threshold k are suffix sums over buckets ≥ k — an ordered window over ≤ 81 rows.
    """
    h = scores.groupBy(threshold_bucket(F.col(score), lo, hi).alias("k")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    grid = scores.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("k"))
    g = grid.join(h, "k", "full").fillna(0, ["pos", "neg"])
    w = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy()
    g = g.withColumns({"tp": F.sum("pos").over(w), "fp": F.sum("neg").over(w), "P": F.sum("pos").over(tot)})
    g = g.filter(F.col("k").between(lo, hi))
    fn = F.col("P") - F.col("tp")
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    rec = F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(F.lit(0.0))
    return g.select((F.col("k") / F.lit(100.0)).alias("threshold"), F.col("tp").cast("bigint").alias("tp"),
                    F.col("fp").cast("bigint").alias("fp"), prec.alias("precision"), rec.alias("recall"),
                    _fbeta(F.col("tp"), F.col("fp"), fn, 1.0).alias("f1"),
                    _fbeta(F.col("tp"), F.col("fp"), fn, beta).alias("f_beta"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """M9: the first threshold reaching the maximum F-beta (argmax-first)."""
    return sweep.orderBy(F.desc("f_beta"), F.asc("threshold")).limit(1)


def classification_metrics(scores: DataFrame, threshold: float = 0.5, label: str = "label",
                           score: str = "score", drop_tolerance: float | None = None,
                           baseline_f2: float | None = None) -> DataFrame:
    """F1, F2, precision, recall, accuracy in one aggregate (0 on empty denominators)."""
    pred = F.col(score) >= threshold
    y = F.col(label) == 1
    c = scores.agg(F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
                   F.count_if(~pred & y).alias("fn"), F.count_if(~pred & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    out = c.select(
        _fbeta(tp, fp, fn, 2.0).alias("f2_score"), _fbeta(tp, fp, fn, 1.0).alias("f1_score"),
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)).alias("precision"),
        F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0)).alias("recall"),
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"))
    if baseline_f2 is not None:
        tol = 0.05 if drop_tolerance is None else drop_tolerance
        out = out.withColumn("performance_drop", F.lit(baseline_f2) - F.col("f2_score") > tol)
    return out


def _score_groups(scores: DataFrame, label: str, score: str) -> DataFrame:
    return scores.groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def roc_auc(scores: DataFrame, label: str = "label", score: str = "score", **ranges) -> DataFrame:
    """ROC-AUC with ties (trapezoid = Mann–Whitney), over one row per distinct score, range by range."""
    g = running_sums(_score_groups(scores, label, score), [], "s", {"neg_below": "neg"}, inclusive=False, **ranges)
    below = F.coalesce("neg_below", F.lit(0))
    return g.agg(F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") / 2.0)), F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def average_precision(scores: DataFrame, label: str = "label", score: str = "score", **ranges) -> DataFrame:
    """Step-wise AP = Σ (R_n − R_{n−1}) · P_n over distinct scores, highest first, range by range."""
    g = running_sums(_score_groups(scores, label, score), [], "s", {"tp": "pos", "fp": "neg"}, descending=True, **ranges)
    # Σ (pos/P) · precision = (1/P) · Σ pos · precision: P comes out of the same aggregate.
    return g.agg(F.try_divide(F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))), F.sum("pos"))
                 .alias("avg_precision"))


def confusion_matrix(scores: DataFrame, threshold: float = 0.5, label: str = "label",
                     score: str = "score") -> DataFrame:
    """rows = true label, columns = predicted 0/1."""
    pred = F.col(score) >= threshold
    return scores.groupBy(F.col(label).alias("label")).agg(F.count_if(~pred).alias("pred_0"),
                                                           F.count_if(pred).alias("pred_1"))


# --- M4/M5/M7: scaling, assembly, training ----------------------------------------------

def standard_scale(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """M4: (x − mean) / population std, std 0 → 1 (Q20); the statistics are one scalar subquery."""
    st = df.agg(F.struct(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                         *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).alias("s")).scalar()
    d = df.withColumn("__s", st)
    out = {}
    for i, c in enumerate(cols):
        s = F.col(f"__s.s_{i}")
        out[c + suffix] = (F.col(c) - F.col(f"__s.m_{i}")) / F.when(s > 0, s).otherwise(F.lit(1.0))
    return d.withColumns(out).drop("__s")


def promotion(versions: DataFrame, score: str = "f2", version: str = "version") -> DataFrame:
    """A version becomes Production iff its score is strictly above every earlier one.

    The latest promoted version is Production, everything else Archived.
    """
    w = Window.orderBy(version).rowsBetween(Window.unboundedPreceding, -1)
    d = versions.withColumn("__best_before", F.max(score).over(w))
    d = d.withColumn("promoted", F.col("__best_before").isNull() | (F.col(score) > F.col("__best_before")))
    last = Window.orderBy(F.desc(version))
    d = d.withColumn("__rank", F.sum(F.col("promoted").cast("int")).over(last.rowsBetween(Window.unboundedPreceding, 0)))
    stage = F.when(F.col("promoted") & (F.col("__rank") == 1), "Production").otherwise("Archived")
    return d.withColumn("stage", stage).drop("__best_before", "__rank")
