"""Service counters over the scored messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ops as O
from ..sources.tables import messages, with_views
from . import register

BOUNDS = [0.25, 0.5, 0.75, 0.9]


@register("a13_value_histogram", with_views("""
SELECT m.label, b.le, CAST(count(*) FILTER (WHERE m.confidence <= b.upper) AS BIGINT) AS n,
       round(sum(m.confidence), 6) AS sum, CAST(count(m.confidence) AS BIGINT) AS count
FROM messages m
CROSS JOIN (VALUES ('0.25', 0.25), ('0.5', 0.5), ('0.75', 0.75), ('0.9', 0.9), ('+Inf', 1e300)) b(le, upper)
GROUP BY m.label, b.le""", "messages"))
def a13_value_histogram(spark, sf_dir):
    """Cumulative buckets, sum and count of the scores per label (the service's latency histogram)."""
    h = O.latency_histogram(messages(spark, sf_dir), "confidence", BOUNDS, ["label"])
    return h.withColumn("sum", F.round("sum", 6))


@register("a14_prediction_counters", with_views("""
SELECT channel_id, CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS toxic,
       CAST(count(*) FILTER (WHERE label <> 1) AS BIGINT) AS non_toxic, round(avg(confidence), 9) AS mean_confidence
FROM messages GROUP BY channel_id""", "messages"))
def a14_prediction_counters(spark, sf_dir):
    """Toxic and other predictions and mean confidence, here per channel."""
    m = messages(spark, sf_dir).withColumn("prediction", F.col("label"))
    return O.prediction_counters(m, "channel_id").withColumn("mean_confidence", F.round("mean_confidence", 9))


@register("a12_request_counts", with_views("""
SELECT upper(event_type) AS method, '/channel/' || CAST(channel_id % 5 AS VARCHAR) AS endpoint, CASE WHEN label = 1 THEN 500 ELSE 200 END AS status,
       CAST(count(*) AS BIGINT) AS n
FROM messages GROUP BY ALL""", "messages"))
def a12_request_counts(spark, sf_dir):
    """Requests per method, endpoint and status, with the messages taken for requests."""
    m = messages(spark, sf_dir).select(F.upper("event_type").alias("method"),
                                       F.concat(F.lit("/channel/"), (F.col("channel_id") % 5).cast("string")).alias("endpoint"),
                                       F.when(F.col("label") == 1, 500).otherwise(200).alias("status"))
    return O.request_counts(m)
