"""Ingestion queries: validated batch (P1–P7, O4, H10), merge-dedupe (O5, P8, P9), quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest as I
from ..operators.history import group_stats_onto_rows
from ..sources.tables import texts, with_views
from . import register

T0 = "2024-01-15 00:00:00"
T1 = "2024-01-31 00:00:00"

BATCH_COLS = ["doc_id", "user_id", "text_hash", "label", "label_source", "ingested_at", "msg_len", "word_count",
              "caps_ratio", "exclamation_count", "slur_count", *I.HISTORY_DEFAULT_NAMES,
              "user_msg_count_total", "user_toxicity_rate"]


def batch(spark, sf_dir):
    """The labelled-log batch: texts whose label is the human verification."""
    raw = texts(spark, sf_dir).withColumnRenamed("label", "verified_label")
    b = I.require_columns(raw, ["text", "user_id", "doc_id"])
    b = I.length_filter(b, "text", 3, 5000)
    b = I.resolve_labels(b, "dataset")
    b = I.add_ingested_at(b, T1)
    b = I.ensure_hash(b)
    b = I.dedupe_first(b, "text_hash", [(F.col("doc_id"), True)])
    fc = T.feature_columns("text")
    b = b.withColumns({k: fc[k] for k in ["msg_len", "word_count", "caps_ratio", "exclamation_count", "slur_count"]})
    b = I.fill_missing_history(b)
    b = group_stats_onto_rows(b, "user_id", "label", "user_msg_count_total", "user_toxicity_rate")
    return b.select(*BATCH_COLS)


_BATCH_CTE = f"""
WITH b0 AS (SELECT * FROM texts WHERE length(text) >= 3 AND length(text) <= 5000 AND label IS NOT NULL),
b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY doc_id) AS rn FROM b0) WHERE rn = 1),
batch AS (
  SELECT doc_id, user_id, text_hash, CAST(label AS INTEGER) AS label, 'human' AS label_source,
         TIMESTAMP '{T1}' AS ingested_at,
         CAST(length(text) AS BIGINT) AS msg_len,
         CAST(len(list_filter(regexp_split_to_array(text, '[{T.lx.WS_CLASS}]+'), lambda w: w <> '')) AS BIGINT) AS word_count,
         CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) / length(text) ELSE 0.0 END AS caps_ratio,
         CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS exclamation_count,
         CAST({' + '.join(f"(CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END)" for w in T.lx.BAD_WORDS)} AS BIGINT) AS slur_count,
         0.0 AS user_bad_ratio_7d, 0.0 AS user_bad_ratio_30d, 0.0 AS user_toxicity_trend,
         CAST(0 AS BIGINT) AS user_msg_count_7d, 0.0 AS channel_toxicity_ratio, 1.0 AS hours_since_last_msg,
         CAST(0 AS INTEGER) AS is_new_to_channel, CAST(0 AS BIGINT) AS user_report_count,
         CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS user_msg_count_total,
         avg(CAST(label AS DOUBLE)) OVER (PARTITION BY user_id) AS user_toxicity_rate
  FROM b1)"""


def _dbl(sql: str) -> str:
    # DuckDB types bare decimal literals as DECIMAL; the Spark side is DOUBLE.
    for name in ["user_bad_ratio_7d", "user_bad_ratio_30d", "user_toxicity_trend", "channel_toxicity_ratio"]:
        sql = sql.replace(f"0.0 AS {name}", f"CAST(0.0 AS DOUBLE) AS {name}")
    return sql.replace("1.0 AS hours_since_last_msg", "CAST(1.0 AS DOUBLE) AS hours_since_last_msg")


_BATCH_CTE = _dbl(_BATCH_CTE)


@register("i1_ingest_batch", with_views(_BATCH_CTE + "\nSELECT * FROM batch", "texts"))
def i1_ingest_batch(spark, sf_dir):
    """P1–P7 + O4 + F + H10: validate, label, dedupe and featurize one labelled batch."""
    return batch(spark, sf_dir)


def _master(spark, sf_dir):
    return (texts(spark, sf_dir).select("doc_id", "user_id", "channel_id", "text_hash", "label", "source")
            .withColumn("ingested_at", F.lit(T0).cast("timestamp_ntz")))


def _merged(spark, sf_dir):
    m = _master(spark, sf_dir)
    return I.merge_dedupe(m, batch(spark, sf_dir), "text_hash", [(F.col("doc_id"), False)])


_MERGE_CTE = _BATCH_CTE + f""",
master AS (SELECT doc_id, user_id, channel_id, text_hash, label, source, TIMESTAMP '{T0}' AS ingested_at, 0 AS is_new
           FROM texts),
newb AS (SELECT doc_id, user_id, CAST(0 AS BIGINT) AS channel_id, text_hash, label, CAST(NULL AS VARCHAR) AS source,
                ingested_at, 1 AS is_new FROM batch),
merged AS (SELECT * EXCLUDE (rn, is_new) FROM (
  SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY is_new DESC, doc_id DESC) AS rn
  FROM (SELECT * FROM master UNION ALL SELECT * FROM newb)) WHERE rn = 1)"""


@register("o5_merge_dedupe", with_views(_MERGE_CTE + "\nSELECT * FROM merged", "texts"))
def o5_merge_dedupe(spark, sf_dir):
    """O5 + O6 + P8/P9: master ∪ aligned batch, newest version per text hash."""
    return _merged(spark, sf_dir)


@register("a10_ingest_summary", with_views(_MERGE_CTE + """
SELECT (SELECT count(*) FROM master) AS master_size_before, (SELECT count(*) FROM batch) AS new_samples,
       (SELECT count(*) FROM merged) AS master_size_after,
       (SELECT count(*) FROM master) + (SELECT count(*) FROM batch) - (SELECT count(*) FROM merged) AS duplicates_removed""",
                                              "texts"))
def a10_ingest_summary(spark, sf_dir):
    """A10: rows before, new, after and duplicates removed."""
    return I.merge_summary(_master(spark, sf_dir), batch(spark, sf_dir))


@register("a2_class_distribution", with_views("""
SELECT label, CAST(count(*) AS BIGINT) AS n, count(*) / sum(count(*)) OVER () AS share
FROM texts GROUP BY label""", "texts"))
def a2_class_distribution(spark, sf_dir):
    """A2: normalized class counts (unlabelled texts form their own null class)."""
    return I.class_distribution(texts(spark, sf_dir), "label")


@register("a3_pos_weight", with_views("""
SELECT CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) / count(*) FILTER (WHERE label = 1) AS pos_weight
FROM texts WHERE label IS NOT NULL""", "texts"))
def a3_pos_weight(spark, sf_dir):
    """A3: positive-class weight (negatives / positives) over the labelled texts."""
    t = texts(spark, sf_dir).filter(F.col("label").isNotNull())
    return I.positive_weight(t, "label")


_NUMERIC = ["doc_id", "user_id", "label", "msg_len", "word_count", "caps_ratio", "exclamation_count", "slur_count",
            *I.HISTORY_DEFAULT_NAMES, "user_msg_count_total", "user_toxicity_rate"]
_KEYF = ["msg_len", "caps_ratio", "slur_count"]


def _quality_sql() -> str:
    cols = BATCH_COLS
    q = ", ".join(f"quantile_cont({c}, 0.99) AS q_{c}" for c in _KEYF)
    aggs = ["count(*) AS n"]
    aggs += [f"count(*) FILTER (WHERE {c} IS NULL) AS null__{c}" for c in cols]
    aggs += [f"max({c}) - min({c}) AS rng__{c}" for c in _NUMERIC]
    aggs += [f"count(*) FILTER (WHERE {c} > q_{c}) AS out__{c}" for c in _KEYF]
    parts = [f"SELECT 'null_ratio_mean' AS \"check\", CAST(NULL AS VARCHAR) AS \"column\", "
             f"CAST(({' + '.join(f'null__{c}' for c in cols)}) AS DOUBLE) / (n * {len(cols)}) AS value, "
             f"CAST(0.3 AS DOUBLE) AS threshold FROM s"]
    parts += [f"SELECT 'column_null_ratio', '{c}', CAST(null__{c} AS DOUBLE) / n, CAST(0.2 AS DOUBLE) FROM s" for c in cols]
    parts += [f"SELECT 'value_range', '{c}', CAST(rng__{c} AS DOUBLE), CAST(0.0 AS DOUBLE) FROM s" for c in _NUMERIC]
    parts += [f"SELECT 'q99', '{c}', CAST(q_{c} AS DOUBLE), CAST(NULL AS DOUBLE) FROM q" for c in _KEYF]
    parts += [f"SELECT 'outlier_share', '{c}', CAST(out__{c} AS DOUBLE) / n, CAST(0.05 AS DOUBLE) FROM s" for c in _KEYF]
    parts += ["SELECT 'minority_ratio', 'label', min(k) / sum(k), CAST(0.1 AS DOUBLE) FROM "
              "(SELECT CAST(count(*) AS DOUBLE) AS k FROM batch GROUP BY label)"]
    body = "\nUNION ALL ".join(parts)
    return with_views(_BATCH_CTE + f""",
q AS (SELECT {q} FROM batch),
s AS (SELECT {', '.join(aggs)} FROM batch, q),
r AS ({body})
SELECT "check", "column", round(value, 9) AS value, threshold,
       coalesce(CASE WHEN "check" = 'minority_ratio' THEN value < threshold
                     WHEN "check" = 'value_range' THEN value = threshold
                     WHEN "check" = 'q99' THEN false
                     ELSE value > threshold END, false) AS failed
FROM r""", "texts")


@register("a8_quality_report", _quality_sql())
def a8_quality_report(spark, sf_dir):
    """Null ratios, constant columns, q99 outliers and class balance as check rows."""
    rep = I.quality_report(batch(spark, sf_dir), "label")
    return rep.withColumn("value", F.round("value", 9))


@register("p4_sample_gate", with_views(_BATCH_CTE + """
SELECT CAST(count(*) AS BIGINT) AS n, count(*) >= 10 AS passed FROM batch""", "texts"))
def p4_sample_gate(spark, sf_dir):
    """The validated batch must hold at least 10 rows to be ingested (one status row)."""
    return I.sample_gate(batch(spark, sf_dir), 10)


_SOURCES = ("documents", "conversations", "benchmark")


@register("s4_union_sources", """
SELECT 'documents' AS origin, md5(text) AS text_hash, doc_id, lang, CAST(NULL AS BIGINT) AS conv_id, CAST(NULL AS VARCHAR) AS role,
       CAST(NULL AS BIGINT) AS item_id FROM documents
UNION ALL SELECT 'conversations', md5(text), NULL, NULL, conv_id, role, NULL FROM conversations
UNION ALL SELECT 'benchmark', md5(text), NULL, NULL, NULL, NULL, item_id FROM benchmark""")
def s4_union_sources(spark, sf_dir):
    """Three sources of different columns in one frame, aligned by name, missing columns null."""
    from ..sources.files import union_frames
    from ..sources.tables import read_table
    keep = ("doc_id", "lang", "conv_id", "role", "item_id")
    frames = []
    for name in _SOURCES:
        df = read_table(spark, sf_dir, name)
        frames.append(df.select(F.lit(name).alias("origin"), F.md5("text").alias("text_hash"),
                                *[F.col(c).cast("bigint") if c.endswith("_id") else F.col(c) for c in df.columns if c in keep]))
    return union_frames(frames).select("origin", "text_hash", *keep)


@register("p7_null_fill", with_views("""
SELECT doc_id, CAST(coalesce(label, 0) AS INTEGER) AS label, CAST(coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE length(text) END, 0) AS BIGINT) AS msg_len,
       CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS source FROM texts""", "texts"))
def p7_null_fill(spark, sf_dir):
    """Nulls of numeric columns become 0, text columns keep theirs."""
    t = texts(spark, sf_dir).select("doc_id", F.col("label").cast("int").alias("label"),
                                    F.when(F.col("doc_id") % 3 != 0, F.length("text").cast("bigint")).alias("msg_len"),
                                    F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"))
    return I.fill_numeric(t)


@register("p8_common_columns", with_views("""
SELECT 'ref' AS side, doc_id, label, text_hash FROM texts WHERE CAST(substring(source, 4) AS INTEGER) < 10
UNION ALL SELECT 'cur', doc_id, label, text_hash FROM texts WHERE CAST(substring(source, 4) AS INTEGER) >= 10""", "texts"))
def p8_common_columns(spark, sf_dir):
    """Reference and current data of different columns, both projected onto the shared ones."""
    t = texts(spark, sf_dir)
    is_ref = F.substring("source", 4, 10).cast("int") < 10
    ref = t.filter(is_ref).select("doc_id", "channel_id", "label", "text_hash")
    cur = t.filter(~is_ref).select("user_id", "text_hash", "doc_id", "label")
    ref, cur = I.common_columns(ref, cur)
    return ref.withColumn("side", F.lit("ref")).unionByName(cur.withColumn("side", F.lit("cur"))).select("side", "doc_id", "label", "text_hash")


@register("p16_cast_features", with_views("""
SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS msg_len, CAST(coalesce(label, 0) AS BIGINT) AS is_new_to_channel,
       CAST(user_id AS DOUBLE) AS hours_since_last_msg, CAST(0 AS DOUBLE) AS user_bad_ratio_7d FROM texts""", "texts"))
def p16_cast_features(spark, sf_dir):
    """The model's columns cast by their declared sets (bigint or double), 0 where null or absent."""
    from ..operators.scoring import cast_features
    t = texts(spark, sf_dir).select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("string").alias("msg_len"),
                                    F.col("label").cast("double").alias("is_new_to_channel"), F.col("user_id").alias("hours_since_last_msg"))
    return cast_features(t, ["msg_len", "is_new_to_channel", "hours_since_last_msg", "user_bad_ratio_7d"], ["msg_len", "is_new_to_channel"])
