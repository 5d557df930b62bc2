"""History feature queries (H1–H11, E1) over the ``messages`` view of ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..sources.tables import messages, with_views
from . import register

W7 = 7 * H.US_PER_DAY
W30 = 30 * H.US_PER_DAY

_USER_COLS = ["user_7d_msg_count", "user_7d_bad_count", "user_30d_msg_count", "user_30d_bad_count",
              "user_msg_velocity", "user_bad_ratio_7d", "user_bad_ratio_30d", "user_toxicity_trend"]


def _user_windows(spark, sf_dir):
    m = messages(spark, sf_dir).select("msg_id", "user_id", "ts", "label")
    lab = F.col("label").cast("bigint")
    d = H.trailing_counts_multi(m, "user_id", "ts", [(W7, {"user_7d_bad_count": lab}, "user_7d_msg_count"),
                                                     (W30, {"user_30d_bad_count": lab}, "user_30d_msg_count")])
    r7 = F.when(F.col("user_7d_msg_count") > 0, F.col("user_7d_bad_count") / F.col("user_7d_msg_count"))
    r30 = F.when(F.col("user_30d_msg_count") > 0, F.col("user_30d_bad_count") / F.col("user_30d_msg_count"))
    return d.select("msg_id", "user_id", "user_7d_msg_count", "user_7d_bad_count", "user_30d_msg_count",
                    "user_30d_bad_count",
                    (F.col("user_7d_msg_count") / F.lit(7.0)).alias("user_msg_velocity"),
                    F.coalesce(r7, F.lit(0.0)).alias("user_bad_ratio_7d"),
                    F.coalesce(r30, F.lit(0.0)).alias("user_bad_ratio_30d"),
                    F.coalesce(r7 - r30, F.lit(0.0)).alias("user_toxicity_trend"))


_USER_SQL = with_views("""
WITH w AS (
  SELECT msg_id, user_id,
         CAST(count(*) OVER w7 AS BIGINT) AS user_7d_msg_count,
         CAST(coalesce(sum(label) OVER w7, 0) AS BIGINT) AS user_7d_bad_count,
         CAST(count(*) OVER w30 AS BIGINT) AS user_30d_msg_count,
         CAST(coalesce(sum(label) OVER w30, 0) AS BIGINT) AS user_30d_bad_count
  FROM messages
  WINDOW w7 AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING),
         w30 AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 2592000000000 PRECEDING AND 1 PRECEDING)
)
SELECT msg_id, user_id, user_7d_msg_count, user_7d_bad_count, user_30d_msg_count, user_30d_bad_count,
       user_7d_msg_count / 7.0 AS user_msg_velocity,
       coalesce(CAST(user_7d_bad_count AS DOUBLE) / nullif(user_7d_msg_count, 0), 0.0) AS user_bad_ratio_7d,
       coalesce(CAST(user_30d_bad_count AS DOUBLE) / nullif(user_30d_msg_count, 0), 0.0) AS user_bad_ratio_30d,
       coalesce(CAST(user_7d_bad_count AS DOUBLE) / nullif(user_7d_msg_count, 0)
                - CAST(user_30d_bad_count AS DOUBLE) / nullif(user_30d_msg_count, 0), 0.0) AS user_toxicity_trend
FROM w""", "messages")


@register("h1_user_7d", _USER_SQL)
def h1_user_7d(spark, sf_dir):
    """H1–H5: user 7d/30d counts, velocity, ratios and trend."""
    return _user_windows(spark, sf_dir)


@register("h1_user_7d_prefix", _USER_SQL)
def h1_user_7d_prefix(spark, sf_dir):
    """H1–H5 under the query's earlier name; the split plan is now the only one."""
    return _user_windows(spark, sf_dir)


@register("h6_channel_24h", with_views("""
SELECT msg_id, channel_id,
       CAST(count(*) OVER w AS BIGINT) AS channel_24h_msg_count,
       CAST(coalesce(sum(label) OVER w, 0) AS BIGINT) AS channel_24h_bad_count,
       coalesce(CAST(sum(label) OVER w AS DOUBLE) / nullif(count(*) OVER w, 0), 0.0) AS channel_toxicity_ratio
FROM messages
WINDOW w AS (PARTITION BY channel_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING)
""", "messages"))
def h6_channel_24h(spark, sf_dir):
    """H6: channel 24h message and bad counts and toxicity ratio."""
    m = messages(spark, sf_dir).select("msg_id", "channel_id", "ts", "label")
    d = H.trailing_counts(m, "channel_id", "ts", H.US_PER_DAY,
                          {"channel_24h_bad_count": F.col("label")}, "channel_24h_msg_count")
    return d.select("msg_id", "channel_id", "channel_24h_msg_count", "channel_24h_bad_count",
                    F.coalesce(F.when(F.col("channel_24h_msg_count") > 0,
                                      F.col("channel_24h_bad_count") / F.col("channel_24h_msg_count")),
                               F.lit(0.0)).alias("channel_toxicity_ratio"))


def e1_sql(keep_ts: bool = False) -> str:
    """E1 oracle SQL; ``keep_ts`` also returns the event time (used by the serving oracles)."""
    ts = " ts," if keep_ts else ""
    return with_views(f"""
WITH f AS (
  SELECT msg_id, user_id, channel_id, label,{ts}
         CAST(count(*) OVER w7 AS BIGINT) AS user_7d_msg_count,
         CAST(coalesce(sum(label) OVER w7, 0) AS BIGINT) AS user_7d_bad_count,
         CAST(count(*) OVER w30 AS BIGINT) AS user_30d_msg_count,
         CAST(coalesce(sum(label) OVER w30, 0) AS BIGINT) AS user_30d_bad_count,
         CAST(count(*) OVER wc AS BIGINT) AS channel_24h_msg_count,
         CAST(coalesce(sum(label) OVER wc, 0) AS BIGINT) AS channel_24h_bad_count,
         (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, msg_id)) / 3600000000.0 AS gap,
         CAST(row_number() OVER (PARTITION BY user_id, channel_id ORDER BY ts, msg_id) AS BIGINT) AS user_channel_msg_count
  FROM messages
  WINDOW w7 AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING),
         w30 AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 2592000000000 PRECEDING AND 1 PRECEDING),
         wc AS (PARTITION BY channel_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING)
)
SELECT msg_id, user_id, channel_id, label,{ts}
       user_7d_msg_count, user_7d_bad_count, user_30d_msg_count, user_30d_bad_count,
       user_7d_msg_count / 7.0 AS user_msg_velocity,
       coalesce(CAST(user_7d_bad_count AS DOUBLE) / nullif(user_7d_msg_count, 0), 0.0) AS user_bad_ratio_7d,
       coalesce(CAST(user_30d_bad_count AS DOUBLE) / nullif(user_30d_msg_count, 0), 0.0) AS user_bad_ratio_30d,
       coalesce(CAST(user_7d_bad_count AS DOUBLE) / nullif(user_7d_msg_count, 0)
                - CAST(user_30d_bad_count AS DOUBLE) / nullif(user_30d_msg_count, 0), 0.0) AS user_toxicity_trend,
       channel_24h_msg_count, channel_24h_bad_count,
       coalesce(CAST(channel_24h_bad_count AS DOUBLE) / nullif(channel_24h_msg_count, 0), 0.0) AS channel_toxicity_ratio,
       coalesce(gap, 24.0) AS hours_since_last_msg,
       user_channel_msg_count,
       CAST(user_channel_msg_count <= 3 AS INTEGER) AS is_new_to_channel
FROM f""", "messages")


_E1_SQL = e1_sql()

E1_COLS = ["msg_id", "user_id", "channel_id", "label", "user_7d_msg_count", "user_7d_bad_count",
           "user_30d_msg_count", "user_30d_bad_count", "user_msg_velocity", "user_bad_ratio_7d",
           "user_bad_ratio_30d", "user_toxicity_trend", "channel_24h_msg_count", "channel_24h_bad_count",
           "channel_toxicity_ratio", "hours_since_last_msg", "user_channel_msg_count", "is_new_to_channel"]


@register("e1_feature_build", _E1_SQL)
def e1_feature_build(spark, sf_dir):
    """H1–H8 in one job, every key split by time bucket."""
    m = messages(spark, sf_dir).select("msg_id", "user_id", "channel_id", "ts", "label")
    return H.user_channel_features(m).select(*E1_COLS)


@register("e1_feature_build_auto", _E1_SQL)
def e1_feature_build_auto(spark, sf_dir):
    """H1–H8 under the query's earlier name; there is no hot-key routing any more."""
    return e1_feature_build(spark, sf_dir)


@register("h7_gap_hours", with_views("""
SELECT msg_id, user_id,
       coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, msg_id)) / 3600000000.0,
                24.0) AS hours_since_last_msg
FROM messages""", "messages"))
def h7_gap_hours(spark, sf_dir):
    """H7: hours since the user's previous message, 24 for the first."""
    from ..functions.text import micros
    m = messages(spark, sf_dir).select("msg_id", "user_id", "ts")
    d = H.previous_ts_us(m, ["user_id"], "ts", "msg_id", "prev_us")
    gap = (micros("ts") - F.col("prev_us")) / F.lit(float(H.US_PER_HOUR))
    return d.select("msg_id", "user_id", F.coalesce(gap, F.lit(24.0)).alias("hours_since_last_msg"))


@register("h8_user_channel_rank", with_views("""
SELECT msg_id, user_id, channel_id,
       CAST(row_number() OVER (PARTITION BY user_id, channel_id ORDER BY ts, msg_id) AS BIGINT) AS user_channel_msg_count,
       CAST(row_number() OVER (PARTITION BY user_id, channel_id ORDER BY ts, msg_id) <= 3 AS INTEGER) AS is_new_to_channel
FROM messages""", "messages"))
def h8_user_channel_rank(spark, sf_dir):
    """H8: running message number per (user, channel) and the new-to-channel flag."""
    m = messages(spark, sf_dir).select("msg_id", "user_id", "channel_id", "ts")
    d = H.running_number(m, ["user_id", "channel_id"], "ts", "msg_id", "user_channel_msg_count")
    return d.select("msg_id", "user_id", "channel_id", "user_channel_msg_count",
                    (F.col("user_channel_msg_count") <= 3).cast("int").alias("is_new_to_channel"))


@register("h10_user_batch_stats", with_views("""
SELECT msg_id, user_id,
       CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS user_msg_count,
       avg(CAST(label AS DOUBLE)) OVER (PARTITION BY user_id) AS user_toxic_rate
FROM messages""", "messages"))
def h10_user_batch_stats(spark, sf_dir):
    """Batch per-user count and toxic rate mapped back onto each row."""
    m = messages(spark, sf_dir).select("msg_id", "user_id", "label")
    return H.group_stats_onto_rows(m, "user_id").select("msg_id", "user_id", "user_msg_count",
                                                        "user_toxic_rate")


@register("h11_latest_per_user", with_views("""
SELECT user_id, msg_id, channel_id, label, confidence
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, msg_id DESC) AS rn FROM messages)
WHERE rn = 1""", "messages"))
def h11_latest_per_user(spark, sf_dir):
    """Latest message per user, deterministic tie-break on msg_id."""
    m = messages(spark, sf_dir).select("user_id", "msg_id", "channel_id", "label", "confidence", "ts")
    return H.latest_per_key(m, "user_id", "ts", "msg_id").select("user_id", "msg_id", "channel_id",
                                                                 "label", "confidence")
