"""Spark session construction and shared-folder handling.

Every job in the library takes a ``SparkSession`` from the caller.  This module only builds
one for tests, the bench and local runs, with the settings the operators assume:

* UTC session time zone (all event times are naive timestamps, see FIXTURES.md),
* adaptive execution with partition coalescing and skew-join splitting,
* no web UI.

Checkpoints and intermediate tables go to the folder the cluster names in
``spark.checkpoint.dir``.  A local folder is only chosen when that setting is unset *and* the
master is local (tests); on a cluster an unset folder is an error, never a machine-local path.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Row-level parquet filtering stays off; row-group pruning by min/max is what scales.
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str | None = None, app: str = "kestrel",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Create (or fetch) a session with the library defaults.

    ``master`` None sets no master, so that ``spark-submit`` or the cluster's settings decide;
    tests, the bench and the scripts name a local one.
    """
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
        spark.conf.set(k, conf[k])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, choosing a local one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    local = tempfile.mkdtemp(prefix="kestrel-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
