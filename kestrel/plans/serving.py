"""Feature-serving queries: publish (J3/K6), lookups (J2, J4, J5), delete (O10), TTL (O11), as-of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import serving as S
from ..operators.history import user_channel_features
from ..sources.tables import action_log, messages, texts, with_views
from . import register
from .history import e1_sql

AS_OF = "2024-01-31 00:00:00"
FEATS = ["user_bad_ratio_7d", "user_bad_ratio_30d", "user_toxicity_trend", "hours_since_last_msg", "is_new_to_channel"]


def _features(spark, sf_dir):
    m = messages(spark, sf_dir).select("msg_id", "user_id", "channel_id", "ts", "label")
    return user_channel_features(m)


def _store(spark, sf_dir):
    return S.publish(_features(spark, sf_dir), "user_toxicity", "prod", "user_id", "ts", "msg_id", FEATS,
                     AS_OF, ttl_days=3)


_STORE_SQL = f"""WITH e1 AS ({e1_sql(keep_ts=True)}),
store AS (
  SELECT 'user_toxicity' AS feature_group, 'prod' AS version, user_id AS entity_id, ts AS event_ts,
         {', '.join(FEATS)}, TIMESTAMP '{AS_OF}' AS synced_at, TIMESTAMP '{AS_OF}' + INTERVAL 3 DAY AS expires_at
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, msg_id DESC) AS rn FROM e1) WHERE rn = 1)"""


@register("j3_publish_features", _STORE_SQL + "\nSELECT * FROM store")
def j3_publish_features(spark, sf_dir):
    """J3 + K6: latest history features per user published as feature group user_toxicity/prod."""
    return _store(spark, sf_dir)


@register("k6_publish_stats", with_views("""
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(DISTINCT user_id) AS BIGINT) AS synced,
       CAST(count(*) FILTER (WHERE user_id IS NULL) AS BIGINT) AS failed,
       (count(*) - count(*) FILTER (WHERE user_id IS NULL)) / count(*) AS success_rate
FROM messages""", "messages"))
def k6_publish_stats(spark, sf_dir):
    """K6: publish statistics — rows, entities synced, rows failed (null key), rate."""
    return S.publish_stats(messages(spark, sf_dir), "user_id")


@register("j2_point_lookup", _STORE_SQL + f"""
SELECT entity_id, {', '.join(FEATS[:3])} FROM store WHERE entity_id = 7""")
def j2_point_lookup(spark, sf_dir):
    """Selected online features of one user (empty when absent)."""
    return S.lookup(_store(spark, sf_dir), "user_toxicity", "prod", 7, FEATS[:3])


@register("j4_batch_lookup", with_views(_STORE_SQL + f"""
SELECT t.doc_id, t.user_id, {', '.join('s.' + f for f in FEATS)}
FROM texts t LEFT JOIN store s ON s.entity_id = t.user_id""", "texts"))
def j4_batch_lookup(spark, sf_dir):
    """Each text's author features; every request row is kept."""
    req = texts(spark, sf_dir).select("doc_id", "user_id")
    return S.batch_lookup(req, _store(spark, sf_dir), "user_toxicity", "prod", "user_id", FEATS)


@register("j5_enrich_defaults", with_views(_STORE_SQL + f"""
SELECT t.doc_id, t.user_id,
       coalesce(s.user_bad_ratio_7d, 0.0) AS user_bad_ratio_7d, coalesce(s.user_bad_ratio_30d, 0.0) AS user_bad_ratio_30d,
       coalesce(s.user_toxicity_trend, 0.0) AS user_toxicity_trend,
       coalesce(s.hours_since_last_msg, 24.0) AS hours_since_last_msg, coalesce(s.is_new_to_channel, 1) AS is_new_to_channel
FROM texts t LEFT JOIN store s ON s.entity_id = t.user_id""", "texts"))
def j5_enrich_defaults(spark, sf_dir):
    """Each text enriched with its author's online features, defaults (0, 0, 0, 24, 1) when absent."""
    req = texts(spark, sf_dir).select("doc_id", "user_id")
    return S.enrich(req, _store(spark, sf_dir), "user_toxicity", "prod", "user_id").select("doc_id", "user_id", *FEATS)


@register("o10_o11_versions_ttl", _STORE_SQL + f""",
v0 AS (SELECT * REPLACE ('v0' AS version) FROM store)
SELECT version, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(*) FILTER (WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}') AS BIGINT) AS n_fresh
FROM (SELECT * FROM store UNION ALL SELECT * FROM v0) WHERE NOT (feature_group = 'user_toxicity' AND version = 'v0')
GROUP BY version""")
def o10_o11_versions_ttl(spark, sf_dir):
    """O10 drop a version; O11 count rows still fresh at as_of (TTL 3 days after last event)."""
    store = _store(spark, sf_dir)
    both = store.unionByName(store.withColumn("version", F.lit("v0")))
    kept = S.drop_version(both, "user_toxicity", "v0")
    fresh = S.fresh(kept, AS_OF).groupBy("version").agg(F.count(F.lit(1)).alias("n_fresh"))
    return kept.groupBy("version").agg(F.count(F.lit(1)).alias("n_rows")).join(fresh, "version", "left") \
        .select("version", "n_rows", F.coalesce("n_fresh", F.lit(0)).alias("n_fresh"))


_ASOF_SQL = with_views("""
SELECT m.msg_id, m.user_id, a.severity AS last_severity, a.action_taken AS last_action
FROM messages m ASOF LEFT JOIN (SELECT user_id, ts, severity, action_taken FROM action_log WHERE severity <> 'SAFE') a
  ON m.user_id = a.user_id AND m.ts > a.ts""", "action_log")


def _asof(spark, sf_dir):
    m = messages(spark, sf_dir).select("msg_id", "user_id", "ts")
    a = action_log(spark, sf_dir).filter(F.col("severity") != "SAFE").select(
        "user_id", "ts", F.col("severity").alias("last_severity"), F.col("action_taken").alias("last_action"))
    return S.asof_join(m, a, "user_id", "ts", "ts", ["last_severity", "last_action"]).select(
        "msg_id", "user_id", "last_severity", "last_action")


@register("j6_asof_last_action", _ASOF_SQL)
def j6_asof_last_action(spark, sf_dir):
    """For every message, the user's latest non-SAFE moderation action strictly before it."""
    return _asof(spark, sf_dir)


@register("j6_asof_last_action_prefix", _ASOF_SQL)
def j6_asof_last_action_prefix(spark, sf_dir):
    """J6 under the query's earlier name; the split plan is now the only one."""
    return _asof(spark, sf_dir)
