"""Moderation queries: severity and strikes (P16–P20, H9), stats (A1), profiles (A11), pending (O1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import moderation as M
from ..sources.tables import action_log, messages, with_views
from . import register

AS_OF = "2024-01-31 00:00:00"


def _sev_sql(prior: str) -> str:
    return f"""CASE WHEN hard_term = 1 THEN 'HIGH'
                 WHEN label = 0 THEN 'SAFE'
                 WHEN p >= 0.45 AND p <= 0.55 THEN 'UNCERTAIN'
                 WHEN {prior} >= 2 AND p > 0.70 THEN 'HIGH'
                 WHEN {prior} >= 2 AND p > 0.60 THEN 'MEDIUM'
                 WHEN p > 0.90 THEN 'HIGH'
                 WHEN p > 0.75 THEN 'MEDIUM'
                 ELSE 'LOW' END"""


# Independent oracle: the sequential per-user fold as a recursive CTE, one message per step.
_WALK_CTES = f"""
WITH RECURSIVE base AS (
  SELECT msg_id, user_id, hard_term, label, greatest(confidence, 1 - confidence) AS p,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, msg_id) AS rn
  FROM messages),
walk AS (
  SELECT user_id, rn, msg_id, CAST(0 AS BIGINT) AS prior, {_sev_sql('0')} AS sev
  FROM base WHERE rn = 1
  UNION ALL
  SELECT b.user_id, b.rn, b.msg_id, np, sev2 FROM (
    SELECT b.*, w.prior + CASE WHEN w.sev IN ('MEDIUM', 'HIGH') THEN 1 ELSE 0 END AS np
    FROM walk w JOIN base b ON b.user_id = w.user_id AND b.rn = w.rn + 1) b
  CROSS JOIN LATERAL (SELECT {_sev_sql('b.np')} AS sev2)
),
strikes AS (
  SELECT msg_id, user_id, prior AS prior_violations, sev AS severity,
         CASE WHEN sev = 'UNCERTAIN' THEN 'FLAGGED_REVIEW'
              WHEN sev = 'LOW' THEN 'WARN_SOFT'
              WHEN sev = 'MEDIUM' THEN 'DELETE_STRIKE_' || CAST(prior + 1 AS VARCHAR)
              WHEN sev = 'HIGH' AND prior + 1 = 1 THEN 'DELETE_WARN_HIGH'
              WHEN sev = 'HIGH' AND prior + 1 = 2 THEN 'TIMEOUT_10M'
              WHEN sev = 'HIGH' THEN 'TIMEOUT_24H_ESCALATE' END AS action_taken
  FROM walk)"""

_STRIKES_SQL = with_views(_WALK_CTES + "\nSELECT * FROM strikes", "messages")


def _strikes(spark, sf_dir):
    m = messages(spark, sf_dir)
    scored = m.select("msg_id", "user_id", "ts", "hard_term",
                      (F.col("label") == 1).alias("is_toxic"),
                      M.fold_confidence(F.col("confidence")).alias("confidence"))
    return M.strike_history(scored)


@register("h9_strike_history", _STRIKES_SQL)
def h9_strike_history(spark, sf_dir):
    """H9 + P17 + P18 + P19: prior strikes, severity and action for every message."""
    return _strikes(spark, sf_dir).select("msg_id", "user_id", "prior_violations", "severity", "action_taken")


@register("h9_strike_history_prefix", _STRIKES_SQL)
def h9_strike_history_prefix(spark, sf_dir):
    """H9 under the query's earlier name; the split plan is now the only one."""
    return h9_strike_history(spark, sf_dir)


@register("a11_user_profiles", with_views(_WALK_CTES + """
SELECT s.user_id,
       CAST(count(*) FILTER (WHERE severity IN ('MEDIUM', 'HIGH')) AS BIGINT) AS violations,
       min(m.ts) FILTER (WHERE severity IN ('MEDIUM', 'HIGH')) AS first_offense_time,
       max(m.ts) FILTER (WHERE severity IN ('MEDIUM', 'HIGH')) AS last_offense_time,
       CAST(count(*) FILTER (WHERE severity = 'SAFE') AS BIGINT) AS n_safe,
       CAST(count(*) FILTER (WHERE severity = 'UNCERTAIN') AS BIGINT) AS n_uncertain,
       CAST(count(*) FILTER (WHERE severity = 'LOW') AS BIGINT) AS n_low,
       CAST(count(*) FILTER (WHERE severity = 'MEDIUM') AS BIGINT) AS n_medium,
       CAST(count(*) FILTER (WHERE severity = 'HIGH') AS BIGINT) AS n_high
FROM strikes s JOIN messages m USING (msg_id)
GROUP BY s.user_id""", "messages"))
def a11_user_profiles(spark, sf_dir):
    """Per-user violations, first/last offense and severity counts from the strike history."""
    return M.user_profiles(_strikes(spark, sf_dir))


@register("a1_moderation_stats", with_views(f"""
SELECT CAST(count(*) AS BIGINT) AS total_violations,
       CAST(count(DISTINCT user_id) AS BIGINT) AS unique_users,
       CAST(coalesce(sum(CASE WHEN action_taken ILIKE 'DELETE%' THEN 1 ELSE 0 END), 0) AS BIGINT) AS deleted_messages,
       CAST(coalesce(sum(CASE WHEN action_taken ILIKE 'TIMEOUT%' THEN 1 ELSE 0 END), 0) AS BIGINT) AS timeouts,
       CAST(coalesce(sum(CASE WHEN severity = 'UNCERTAIN' OR action_taken = 'FLAGGED_REVIEW' THEN 1 ELSE 0 END), 0) AS BIGINT) AS pending_review
FROM action_log WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""", "action_log"))
def a1_moderation_stats(spark, sf_dir):
    """A1: moderation totals over the last 7 days before as_of."""
    return M.moderation_stats(action_log(spark, sf_dir), AS_OF, 7)


@register("o1_pending_reviews", with_views("""
SELECT user_id, message, confidence AS score, ts, CAST(to_json(map(['channel_id'], [CAST(channel_id AS VARCHAR)])) AS VARCHAR) AS metadata
FROM action_log WHERE severity = 'UNCERTAIN' OR action_taken = 'FLAGGED_REVIEW'
ORDER BY ts DESC, msg_id DESC LIMIT 50""", "action_log"))
def o1_pending_reviews(spark, sf_dir):
    """O1: the 50 newest messages awaiting review, metadata encoded as JSON."""
    top = M.pending_reviews(action_log(spark, sf_dir), 50)
    return top.select("user_id", "message", F.col("confidence").alias("score"), "ts",
                      F.to_json(F.create_map(F.lit("channel_id"), F.col("channel_id").cast("string"))).alias("metadata"))


@register("k7_action_log_rows", with_views("""
SELECT msg_id, user_id, substring(message, 1, 500) AS message, confidence AS toxicity_score, severity, action_taken,
       CAST(to_json(map(['channel_id'], [CAST(channel_id AS VARCHAR)])) AS VARCHAR) AS metadata
FROM action_log WHERE severity <> 'SAFE'""", "action_log"))
def k7_action_log_rows(spark, sf_dir):
    """K7 projection: the rows an action-log append writes (500-char message, JSON metadata)."""
    log = action_log(spark, sf_dir).filter(F.col("severity") != "SAFE")
    return log.select("msg_id", "user_id", F.substring("message", 1, 500).alias("message"),
                      F.col("confidence").alias("toxicity_score"), "severity", "action_taken",
                      F.to_json(F.create_map(F.lit("channel_id"), F.col("channel_id").cast("string"))).alias("metadata"))


@register("p20_fallback_scores", with_views("""
SELECT msg_id, hard_term = 1 AS is_toxic, CAST(CASE WHEN hard_term = 1 THEN 0.95 ELSE 0.0 END AS DOUBLE) AS confidence,
       greatest(confidence, 1 - confidence) AS folded_confidence,
       CAST(label AS BIGINT) AS prediction
FROM messages""", "messages"))
def p20_fallback_scores(spark, sf_dir):
    """P16 casts, P17 folding and P20 rule fallback for every message."""
    m = messages(spark, sf_dir)
    fb = M.fallback_score(F.col("hard_term") == 1)
    return m.select("msg_id", fb["is_toxic"].alias("is_toxic"), fb["confidence"].alias("confidence"),
                    M.fold_confidence(F.col("confidence")).alias("folded_confidence"),
                    F.col("label").cast("bigint").alias("prediction"))
