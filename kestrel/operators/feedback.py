"""Active-learning candidate selection and labelling bookkeeping.

The selection is one declarative plan: lookback filter (pushed into the Parquet scan),
priority score, anti-join against already-labelled hashes, in-batch dedupe, then a top-k.
Unlike the original (limit 2·n, then anti-join, then first n — Q18) dedupe and anti-join
happen *before* the limit, so the batch is always full when enough candidates exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .history import first_per_key
from ..functions.text import micros


def lookback(df: DataFrame, as_of, days: int, ts: str = "ts") -> DataFrame:
    """Strict ``ts > as_of − days``; a plain comparison so Parquet min/max pruning applies."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return df.filter(F.col(ts) > cutoff)


def priority_score(report_count: Column, action: Column, severity: Column, confidence: Column,
                   min_reports: int = 2, uncertainty: float = 0.3) -> Column:
    """Reports ≥ 2 → 100, FLAGGED_REVIEW → 80, UNCERTAIN → 60, |p − .5| < .3 → 40, else 20."""
    return (F.when(report_count >= min_reports, 100)
            .when(action == "FLAGGED_REVIEW", 80)
            .when(severity == "UNCERTAIN", 60)
            .when(F.abs(confidence - 0.5) < uncertainty, 40)
            .otherwise(20))


def score_candidates(log: DataFrame, as_of, days: int = 7, min_len: int = 10) -> DataFrame:
    """P11 + P12 + P14: recent, non-trivial messages with their priority and text hash."""
    recent = lookback(log, as_of, days)
    return (recent.filter(F.col("message").isNotNull() & (F.length("message") > min_len))
            .withColumns({
                "priority_score": priority_score(F.col("report_count"), F.col("action_taken"),
                                                 F.col("severity"), F.col("confidence")),
                "text_hash": F.md5(F.col("message")),
            }))


def not_labelled(df: DataFrame, labelled_hashes: DataFrame, key: str = "text_hash") -> DataFrame:
    """Rows whose hash is not among the labelled hashes (left anti join; AQE may broadcast)."""
    return df.join(labelled_hashes.select(key).distinct(), key, "left_anti")


def select_candidates(log: DataFrame, labelled_hashes: DataFrame, as_of, n: int = 100,
                      days: int = 7, min_priority: int | None = None, seed: str = "42") -> DataFrame:
    """O2 (+P15): the ``n`` best unlabelled candidates, newest first inside a priority.

    In-batch duplicates keep their newest row.  ``shuffle_key`` reproduces "random order inside
    equal priority" deterministically from the hash and a seed.
    """
    scored = score_candidates(log, as_of, days)
    if min_priority is not None:
        scored = scored.filter(F.col("priority_score") >= min_priority)
    fresh = not_labelled(scored, labelled_hashes)
    newest = first_per_key(fresh, "text_hash", [(micros("ts"), False), (F.col("msg_id"), False)])
    top = newest.orderBy(F.col("priority_score").desc(), F.col("ts").desc(), F.col("msg_id").desc()).limit(n)
    return top.withColumn("shuffle_key", F.md5(F.concat(F.col("text_hash"), F.lit(seed))))


def candidate_stats(cands: DataFrame) -> DataFrame:
    """Counts by priority, by action and by report count in one GROUPING SETS aggregate."""
    dims = ["priority_score", "action_taken", "report_count"]
    # The grouping flag tells the sets apart, also for groups whose own value is null.
    dimension = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in dims])
    return cands.groupingSets([[c] for c in dims], *dims).agg(F.count(F.lit(1)).alias("n"), dimension.alias("dimension"))


def report_counts(log: DataFrame) -> DataFrame:
    """Rows and summed reports per (user, message)."""
    return log.groupBy("user_id", "message").agg(F.count(F.lit(1)).alias("n_rows"),
                                                 F.sum("report_count").cast("bigint").alias("reports"))


USER_REPORT = "USER_REPORT"


def with_user_reports(log: DataFrame) -> DataFrame:
    """``report_count`` = USER_REPORT rows about the same user and message, on every row of the log."""
    reports = log.filter(F.col("severity") == USER_REPORT).groupBy(F.col("user_id").alias("__u"), F.col("message").alias("__m")).agg(
        F.count(F.lit(1)).alias("__n"))
    j = log.drop("report_count").join(reports, F.col("user_id").eqNullSafe(F.col("__u")) & F.col("message").eqNullSafe(F.col("__m")), "left")
    return j.withColumn("report_count", F.coalesce("__n", F.lit(0)).cast("bigint")).drop("__u", "__m", "__n")


def mark_reviewed(log: DataFrame, reviewed: DataFrame, as_of, keys=("user_id", "message")) -> DataFrame:
    """Set action HUMAN_REVIEWED and a review time on rows whose keys were labelled.

    A left join on the distinct reviewed keys; the result is a new snapshot, nothing is
    updated in place.
    """
    keys = list(keys)
    flag = reviewed.select(*keys).distinct().withColumn("__reviewed", F.lit(True))
    j = log.join(flag, keys, "left")
    hit = F.coalesce(F.col("__reviewed"), F.lit(False))
    # Rows not reviewed now keep the time of an earlier session.
    earlier = F.col("review_timestamp") if "review_timestamp" in log.columns else F.lit(None).cast("timestamp_ntz")
    return j.withColumns({
        "action_taken": F.when(hit, F.lit("HUMAN_REVIEWED")).otherwise(F.col("action_taken")),
        "review_timestamp": F.when(hit, F.lit(as_of).cast("timestamp_ntz")).otherwise(earlier),
    }).drop("__reviewed")


def labelling_audit(labels: DataFrame, session_id: str, as_of, label: str = "verified_label") -> DataFrame:
    """K9: one audit row — session, number of labels and the label distribution as a map.

    The map holds one entry per distinct label value (a handful), built from a grouped count;
    rows without a label count in ``num_labels`` only.
    """
    dist = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return dist.agg(
        F.sum("n").alias("num_labels"),
        F.map_from_entries(F.collect_list(F.when(F.col(label).isNotNull(), F.struct(F.col(label), F.col("n"))))).alias("label_distribution"),
    ).select(F.lit(as_of).cast("timestamp_ntz").alias("timestamp"), F.lit(session_id).alias("session_id"),
             "num_labels", "label_distribution")
