"""Parquet table scans and the canonical views the operators work on.

The driver's test data is a set of Parquet files (``<sf_dir>/<name>.parquet``).  The
moderation operators expect messages, an action log and labelled texts; the three views
below derive them from ``events`` and ``documents``/``labels`` exactly as FIXTURES.md §2 states,
so the DuckDB oracle can build the same rows with plain SQL (see ``VIEW_SQL``).

All views are lazy projections over the scans: Catalyst prunes unused columns and pushes
filters through them into the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


def _confidence(value: Column) -> Column:
    # Deterministic pseudo-score in [0, 1] with two decimals.
    return (F.round(value * 100).cast("bigint") % 101).cast("double") / F.lit(100.0)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages without text: (msg_id, user_id, channel_id, ts, label, hard_term, confidence)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("msg_id"),
        F.col("user_id"),
        (F.col("event_id") % 50).alias("channel_id"),
        F.col("ts"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
        F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("hard_term"),
        _confidence(F.col("value")).alias("confidence"),
        F.col("event_type"),
        F.col("props"),
    )


def action_log_from(msgs: DataFrame) -> DataFrame:
    """Action log (F-6/F-7) derived from messages."""
    lab = F.col("label") == 1
    conf = F.col("confidence")
    band = conf.between(0.45, 0.55)
    severity = (F.when(lab & (conf >= 0.9), "HIGH")
                .when(lab & (conf > 0.75), "MEDIUM")
                .when(band, "UNCERTAIN")
                .when(lab, "LOW")
                .otherwise("SAFE"))
    action = (F.when(lab & (conf >= 0.95), "TIMEOUT_10M")
              .when(lab & (conf >= 0.9), "DELETE_WARN_HIGH")
              .when(lab & (conf > 0.75), "DELETE_STRIKE_1")
              .when(band, "FLAGGED_REVIEW")
              .when(lab, "WARN_SOFT"))
    return msgs.select(
        "msg_id", "user_id",
        F.concat(F.lit("channel "), F.col("channel_id").cast("string"), F.lit(" said "),
                 F.col("event_type"), F.lit(" "), F.col("props")).alias("message"),
        "confidence", "channel_id", "ts",
        severity.alias("severity"),
        action.alias("action_taken"),
        F.when(F.col("msg_id") % 97 == 0, 2).otherwise(0).alias("report_count"),
    )


def action_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return action_log_from(messages(spark, sf_dir))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts: documents left-joined with labels (label null when unlabelled)."""
    d = read_table(spark, sf_dir, "documents")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return (d.join(lab, "doc_id", "left")
            .select("doc_id", (F.col("doc_id") % 100).alias("user_id"),
                    (F.col("doc_id") % 20).alias("channel_id"), "text",
                    F.md5(F.col("text")).alias("text_hash"), "label", "source", "lang"))


# The same three views as DuckDB SQL, used as CTEs by the oracle queries.
VIEW_SQL = {
    "messages": """
        SELECT event_id AS msg_id, user_id, event_id % 50 AS channel_id, ts,
               CASE WHEN event_type = 'error'  THEN 1 ELSE 0 END AS label,
               CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS hard_term,
               CAST(CAST(round(value*100) AS BIGINT) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
               event_type, props
        FROM events""",
    "action_log": """
        SELECT msg_id, user_id,
               concat('channel ', CAST(channel_id AS VARCHAR), ' said ', event_type, ' ', props) AS message,
               confidence, channel_id, ts,
               CASE WHEN label=1 AND confidence >= 0.9  THEN 'HIGH'
                    WHEN label=1 AND confidence >  0.75 THEN 'MEDIUM'
                    WHEN confidence BETWEEN 0.45 AND 0.55 THEN 'UNCERTAIN'
                    WHEN label=1 THEN 'LOW' ELSE 'SAFE' END AS severity,
               CASE WHEN label=1 AND confidence >= 0.95 THEN 'TIMEOUT_10M'
                    WHEN label=1 AND confidence >= 0.9  THEN 'DELETE_WARN_HIGH'
                    WHEN label=1 AND confidence >  0.75 THEN 'DELETE_STRIKE_1'
                    WHEN confidence BETWEEN 0.45 AND 0.55 THEN 'FLAGGED_REVIEW'
                    WHEN label=1 THEN 'WARN_SOFT' END AS action_taken,
               CASE WHEN msg_id % 97 = 0 THEN 2 ELSE 0 END AS report_count
        FROM messages""",
    "texts": """
        SELECT d.doc_id, d.doc_id % 100 AS user_id, d.doc_id % 20 AS channel_id, d.text,
               md5(d.text) AS text_hash, l.toxic AS label, d.source, d.lang
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs it needs (dependencies resolved in order)."""
    order = []
    deps = {"action_log": ["messages"]}
    for n in names:
        for d in deps.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in order)
    body = sql.lstrip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
