"""A master table cut into buckets by a hash prefix of its key, with versions that share untouched buckets.

Layout under ``root``: ``data/version=<id>/bucket=<prefix>/…`` holds the buckets that version ``id`` wrote;
``manifests/snapshot=<id>`` lists, for every bucket, the version whose files hold it.  A merge reads and
writes only the buckets that the new rows fall into; all others are carried over by the manifest and
their files are never touched.  A version exists once its manifest is complete, so a merge that dies leaves the table
as it was, and repeating it gives the same rows.  Manifests have a row per bucket, however large the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import first_per_key
from ..operators.ingest import merge_dedupe
from .snapshots import _fs, latest_snapshot, next_snapshot_id, snapshot_ids, write_snapshot

#: Hex digits of the hash that name a bucket: 256 buckets.
PREFIX = 2


def bucket_of(key: str, prefix: int = PREFIX) -> Column:
    """First hex digits of the key's hash; a null key has the bucket of the empty string."""
    return F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, prefix)


def _places(spark: SparkSession, root: str) -> dict[str, int]:
    """Bucket → version that holds it, of the newest complete version."""
    found = latest_snapshot(spark, f"{root}/manifests")
    return {r["bucket"]: r["version"] for r in found.collect()} if found is not None else {}


def _read(spark: SparkSession, root: str, places: dict[str, int], like=None) -> DataFrame | None:
    if not places:
        return None
    paths = [f"{root}/data/version={v}/bucket={b}" for b, v in sorted(places.items())]
    reader = spark.read if like is None else spark.read.schema(like)
    return reader.parquet(*paths)


def read_master(spark: SparkSession, root: str, buckets: Sequence[str] | None = None) -> DataFrame | None:
    """The newest complete version (or only some of its buckets); None before the first merge."""
    places = _places(spark, root)
    return _read(spark, root, {b: v for b, v in places.items() if buckets is None or b in set(buckets)})


def merge_into(new: DataFrame, root: str, key: str = "text_hash", order: Sequence[tuple[Column, bool]] = (), prefix: int = PREFIX) -> dict:
    """O5 into the master at ``root``: the newest version per key, new rows first, ``order`` deciding among them.

    ``new`` is read twice, for its buckets and for its rows.  Returns the version written, its
    buckets and the number of buckets carried over; a batch without rows writes nothing.
    """
    spark = new.sparkSession
    places = _places(spark, root)
    touched = {r["b"] for r in new.select(bucket_of(key, prefix).alias("b")).distinct().collect()}  # at most 16 ** prefix
    if not touched:
        return {"version": None, "touched": [], "carried": len(places)}
    whole = _read(spark, root, places)
    held = _read(spark, root, {b: v for b, v in places.items() if b in touched}, whole.schema if whole is not None else None)
    if whole is None:
        merged = first_per_key(new, key, order).select(*new.columns)
    else:
        held = held if held is not None else spark.createDataFrame([], whole.schema)
        merged = merge_dedupe(held, new, key, order)
    version = next_snapshot_id(spark, f"{root}/manifests")
    # One exchange on the bucket's key part, so that a bucket has few files and a hot one several.
    (merged.withColumn("bucket", bucket_of(key, prefix)).repartition(F.col("bucket"), F.pmod(F.xxhash64(key), F.lit(4)))
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/version={version}"))
    places |= dict.fromkeys(touched, version)
    rows = spark.createDataFrame(sorted(places.items()), "bucket string, version int").coalesce(1)
    write_snapshot(rows, f"{root}/manifests", version)
    return {"version": version, "touched": sorted(touched), "carried": len(places) - len(touched)}


def retain_versions(spark: SparkSession, root: str, keep_last: int) -> list[int]:
    """K3: forget all but the newest ``keep_last`` versions; data folders that none of them refers to are deleted."""
    ids = snapshot_ids(spark, f"{root}/manifests")
    kept, gone = ids[-keep_last:], ids[:-keep_last]
    used = {r["version"] for i in kept for r in spark.read.parquet(f"{root}/manifests/snapshot={i}").select("version").distinct().collect()}
    fs, path, jvm = _fs(spark, root)
    for i in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(path, f"manifests/snapshot={i}"), True)
    dropped = [i for i in range(max(ids, default=-1) + 1) if i not in used]
    for i in dropped:
        fs.delete(jvm.org.apache.hadoop.fs.Path(path, f"data/version={i}"), True)
    return dropped
