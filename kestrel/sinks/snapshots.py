"""Table and file sinks (K1–K5, K8).

The master table is never overwritten in place (Spark cannot overwrite a path it is reading):
each write goes to ``<root>/snapshot=<id>`` and older snapshots stay as backups (K3) until
retention removes them.  Readers pick the highest complete snapshot — a directory holding the
``_SUCCESS`` marker that Spark writes last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def snapshot_ids(spark: SparkSession, root: str) -> list[int]:
    fs, p, jvm = _fs(spark, root)
    if not fs.exists(p):
        return []
    ids = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("snapshot=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            ids.append(int(name.split("=", 1)[1]))
    return sorted(ids)


def next_snapshot_id(spark: SparkSession, root: str) -> int:
    """An id above every complete snapshot (a folder left by a failed write is written anew)."""
    return max(snapshot_ids(spark, root), default=-1) + 1


def write_snapshot(df: DataFrame, root: str, snapshot_id: int, fmt: str = "parquet") -> str:
    """K1: write a complete new snapshot; re-running the same id rewrites the same directory."""
    path = f"{root.rstrip('/')}/snapshot={snapshot_id}"
    df.write.mode("overwrite").format(fmt).save(path)
    return path


def latest_snapshot(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame | None:
    ids = snapshot_ids(spark, root)
    if not ids:
        return None
    return spark.read.format(fmt).load(f"{root.rstrip('/')}/snapshot={ids[-1]}")


def retain(spark: SparkSession, root: str, keep_last: int) -> list[int]:
    """K3: keep the newest ``keep_last`` snapshots as backups, delete older ones; returns deleted ids."""
    ids = snapshot_ids(spark, root)
    fs, p, jvm = _fs(spark, root)
    gone = ids[:-keep_last] if keep_last > 0 else []
    for i in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(p, f"snapshot={i}"), True)
    return gone


def append_json(df: DataFrame, path: str) -> None:
    """K2/K5: append records as JSON lines (one part file per task)."""
    df.write.mode("append").json(path)


def write_latest_json(df: DataFrame, latest_path: str, history_path: str) -> None:
    """K5: overwrite the latest metrics document and append it to the history table."""
    df.coalesce(1).write.mode("overwrite").json(latest_path)
    df.write.mode("append").json(history_path)


def write_top_csv(df: DataFrame, path: str, by: str, n: int = 20) -> None:
    """K8: the top ``n`` rows by ``by`` as one CSV with a header (a top-k, bounded)."""
    from pyspark.sql import functions as F
    df.orderBy(F.desc(by)).limit(n).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def archive_options(archive_dir: str) -> dict:
    """K4: file-source options that move consumed log files to an archive after each batch."""
    return {"cleanSource": "archive", "sourceArchiveDir": archive_dir}
