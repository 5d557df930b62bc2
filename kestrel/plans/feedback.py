"""Active-learning queries: candidate selection (O2, J1, P11–P15), stats (A9, A15), P22, K9."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feedback as FB
from ..sources.tables import action_log, texts, with_views
from . import register

AS_OF = "2024-01-31 00:00:00"
PREV_SESSION = "2024-01-24 00:00:00"


def _labelled(log):
    """Hashes sent to review in earlier sessions: flagged messages at or before the last cutoff."""
    return (log.filter((F.col("ts") <= F.lit(PREV_SESSION).cast("timestamp_ntz"))
                       & (F.col("action_taken") == "FLAGGED_REVIEW"))
            .select(F.md5("message").alias("text_hash")))


def _candidates(spark, sf_dir, n=100, min_priority=None):
    log = action_log(spark, sf_dir)
    return FB.select_candidates(log, _labelled(log), AS_OF, n=n, min_priority=min_priority)


def _cand_ctes(min_priority: int | None = None, limit: int | None = 100) -> str:
    prio = f"WHERE priority_score >= {min_priority}" if min_priority is not None else ""
    lim = f"LIMIT {limit}" if limit is not None else ""
    return f"""
WITH scored0 AS (
  SELECT *, md5(message) AS text_hash,
         CASE WHEN report_count >= 2 THEN 100 WHEN action_taken = 'FLAGGED_REVIEW' THEN 80
              WHEN severity = 'UNCERTAIN' THEN 60 WHEN abs(confidence - 0.5) < 0.3 THEN 40 ELSE 20 END AS priority_score
  FROM action_log
  WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND message IS NOT NULL AND length(message) > 10),
scored AS (SELECT * FROM scored0 {prio}),
labelled AS (SELECT DISTINCT md5(message) AS text_hash FROM action_log
             WHERE ts <= TIMESTAMP '{PREV_SESSION}' AND action_taken = 'FLAGGED_REVIEW'),
fresh AS (SELECT * FROM scored WHERE text_hash NOT IN (SELECT text_hash FROM labelled)),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY ts DESC, msg_id DESC) AS rn
                          FROM fresh) WHERE rn = 1),
cands AS (SELECT * FROM newest ORDER BY priority_score DESC, ts DESC, msg_id DESC {lim})"""


_CAND_CTES = _cand_ctes()


@register("o2_candidates", with_views(_CAND_CTES + """
SELECT msg_id, user_id, message, CAST(priority_score AS INTEGER) AS priority_score, text_hash,
       md5(text_hash || '42') AS shuffle_key
FROM cands""", "action_log"))
def o2_candidates(spark, sf_dir):
    """O2 + J1 + P11/P12/P14: the 100 best unlabelled review candidates of the last 7 days."""
    return _candidates(spark, sf_dir).select("msg_id", "user_id", "message", "priority_score",
                                             "text_hash", "shuffle_key")


@register("p15_priority_filter", with_views(_cand_ctes(min_priority=40, limit=None) + """
SELECT msg_id, CAST(priority_score AS INTEGER) AS priority_score FROM cands""", "action_log"))
def p15_priority_filter(spark, sf_dir):
    """Every unlabelled candidate at or above priority 40 (no batch size limit)."""
    log = action_log(spark, sf_dir)
    scored = FB.score_candidates(log, AS_OF, 7).filter(F.col("priority_score") >= 40)
    fresh = FB.not_labelled(scored, _labelled(log))
    from ..operators.history import first_per_key
    from ..functions.text import micros
    newest = first_per_key(fresh, "text_hash", [(micros("ts"), False), (F.col("msg_id"), False)])
    return newest.select("msg_id", "priority_score")


@register("a9_candidate_stats", with_views(_CAND_CTES + """
SELECT CAST(priority_score AS INTEGER) AS priority_score, action_taken, CAST(report_count AS INTEGER) AS report_count,
       CAST(count(*) AS BIGINT) AS n,
       CASE WHEN grouping(priority_score) = 0 THEN 'priority_score'
            WHEN grouping(report_count) = 0 THEN 'report_count' ELSE 'action_taken' END AS dimension
FROM cands GROUP BY GROUPING SETS ((priority_score), (action_taken), (report_count))""", "action_log"))
def a9_candidate_stats(spark, sf_dir):
    """Candidate counts by priority, action and report count (one GROUPING SETS aggregate)."""
    return FB.candidate_stats(_candidates(spark, sf_dir))


@register("a15_report_counts", with_views("""
SELECT user_id, message, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(report_count) AS BIGINT) AS reports
FROM action_log GROUP BY user_id, message""", "action_log"))
def a15_report_counts(spark, sf_dir):
    """Rows and reports per (user, message)."""
    return FB.report_counts(action_log(spark, sf_dir))


_REPORTED = """WITH l AS (SELECT user_id, message, CASE WHEN action_taken IS NULL AND severity = 'SAFE' AND confidence < 0.1 THEN 'USER_REPORT'
  ELSE severity END AS severity, msg_id FROM action_log)"""


@register("a15_user_reports", with_views(_REPORTED + """
SELECT msg_id, CAST(count(*) FILTER (WHERE severity = 'USER_REPORT') OVER (PARTITION BY user_id, message) AS BIGINT) AS report_count
FROM l""", "action_log"))
def a15_user_reports(spark, sf_dir):
    """Reports counted from the log's USER_REPORT rows (here: its quietest safe rows) onto every row."""
    log = action_log(spark, sf_dir)
    quiet = F.col("action_taken").isNull() & (F.col("severity") == "SAFE") & (F.col("confidence") < 0.1)
    log = log.withColumn("severity", F.when(quiet, F.lit(FB.USER_REPORT)).otherwise(F.col("severity")))
    return FB.with_user_reports(log).select("msg_id", "report_count")


@register("p22_mark_reviewed", with_views(_CAND_CTES + f"""
SELECT a.msg_id,
       CASE WHEN r.user_id IS NOT NULL THEN 'HUMAN_REVIEWED' ELSE a.action_taken END AS action_taken,
       CASE WHEN r.user_id IS NOT NULL THEN TIMESTAMP '{AS_OF}' END AS review_timestamp
FROM action_log a LEFT JOIN (SELECT DISTINCT user_id, message FROM cands) r
  ON a.user_id = r.user_id AND a.message = r.message""", "action_log"))
def p22_mark_reviewed(spark, sf_dir):
    """The action log with this session's candidates marked HUMAN_REVIEWED."""
    log = action_log(spark, sf_dir)
    cands = FB.select_candidates(log, _labelled(log), AS_OF, n=100)
    return FB.mark_reviewed(log, cands, AS_OF).select("msg_id", "action_taken", "review_timestamp")


@register("k9_labelling_audit", with_views(f"""
SELECT TIMESTAMP '{AS_OF}' AS timestamp, 'b1c2d3e4' AS session_id, CAST(sum(n) AS BIGINT) AS num_labels,
       CAST(to_json(map_from_entries(list(struct_pack(k := label, v := n) ORDER BY label))) AS VARCHAR) AS label_distribution
FROM (SELECT label, count(*) AS n FROM texts WHERE label IS NOT NULL GROUP BY label)""", "texts"))
def k9_labelling_audit(spark, sf_dir):
    """K9: audit row for the labelled texts — count and label distribution."""
    lab = texts(spark, sf_dir).filter(F.col("label").isNotNull())
    out = FB.labelling_audit(lab, "b1c2d3e4", AS_OF, label="label")
    return out.withColumn("label_distribution",
                          F.to_json(F.map_from_entries(F.array_sort(F.map_entries("label_distribution")))))
