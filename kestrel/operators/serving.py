"""Feature serving as tables.

A feature group is a table with one row per (feature_group, version, entity_id), written
partitioned by group and version so a point lookup prunes to one partition and a version
delete is a partition drop.  Publishing takes the latest row per entity with the
aggregate-based ``first_per_key`` (map-side reduced, skew-safe).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import micros
from .history import first_per_key

SERVING_DEFAULTS = {"user_bad_ratio_7d": 0.0, "user_bad_ratio_30d": 0.0, "user_toxicity_trend": 0.0,
                    "hours_since_last_msg": 24.0, "is_new_to_channel": 1}


def publish(df: DataFrame, group: str, version: str, entity: str, ts: str, tie: str,
            features: Sequence[str], as_of, ttl_days: int | None = None) -> DataFrame:
    """Latest row per entity → (feature_group, version, entity_id, event_ts, features, synced_at, expires_at).

    Rows with a null entity are not published (see ``publish_stats``).  ``expires_at`` is the
    time of publishing plus the TTL (O11).
    """
    keyed = df.filter(F.col(entity).isNotNull())
    latest = first_per_key(keyed, entity, [(micros(ts), False), (F.col(tie), False)],
                           columns=[ts, tie, *features])
    out = latest.select(F.lit(group).alias("feature_group"), F.lit(version).alias("version"),
                        F.col(entity).alias("entity_id"), F.col(ts).alias("event_ts"), *features,
                        F.lit(as_of).cast("timestamp_ntz").alias("synced_at"))
    exp = F.col("synced_at") + F.make_dt_interval(F.lit(ttl_days)) if ttl_days is not None else F.lit(None)
    return out.withColumn("expires_at", exp.cast("timestamp_ntz"))


def publish_stats(df: DataFrame, entity: str) -> DataFrame:
    """K6: total rows, distinct entities synced, rows failed (null key) and the sync rate."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(entity).alias("synced"),
                  F.count_if(F.col(entity).isNull()).alias("failed")).withColumn(
        "success_rate", F.when(F.col("total") > 0, (F.col("total") - F.col("failed")) / F.col("total")))


def lookup(store: DataFrame, group: str, version: str, entity_id, fields: Sequence[str] | None = None) -> DataFrame:
    """One entity's features (all or selected); an empty result means absent."""
    hit = store.filter((F.col("feature_group") == group) & (F.col("version") == version)
                       & (F.col("entity_id") == F.lit(entity_id)))
    return hit.select("entity_id", *(fields or [c for c in store.columns
                                                 if c not in ("feature_group", "version", "entity_id")]))


def batch_lookup(requests: DataFrame, store: DataFrame, group: str, version: str, key: str,
                 fields: Sequence[str]) -> DataFrame:
    """Every request row kept, features null when the entity is missing.

    Plain left join: AQE turns it into a broadcast join when the store partition is small at
    run time and keeps a shuffle join otherwise, so no unchecked broadcast.
    """
    part = store.filter((F.col("feature_group") == group) & (F.col("version") == version))
    return requests.join(part.select(F.col("entity_id").alias(key), *fields), key, "left")


def enrich(requests: DataFrame, store: DataFrame, group: str, version: str, key: str,
           defaults: dict = SERVING_DEFAULTS) -> DataFrame:
    """Fetched values override request values; absent everywhere → defaults.

    One left join of the requests (a batch or a stream) with the store partition, so on a
    stream it is a stream–static join.
    """
    fields = list(defaults)
    part = store.filter((F.col("feature_group") == group) & (F.col("version") == version))
    fetched = part.select(F.col("entity_id").alias(key), *[F.col(f).alias(f"__f_{f}") for f in fields])
    j = requests.join(fetched, key, "left")
    cols = {}
    for f, dflt in defaults.items():
        req = F.col(f) if f in requests.columns else F.lit(None)
        cols[f] = F.coalesce(F.col(f"__f_{f}"), req, F.lit(dflt))
    return j.withColumns(cols).drop(*[f"__f_{f}" for f in fields])


def drop_version(store: DataFrame, group: str, version: str) -> DataFrame:
    """The store without one (group, version); on disk this is a partition drop."""
    return store.filter(~((F.col("feature_group") == group) & (F.col("version") == version)))


def fresh(store: DataFrame, as_of) -> DataFrame:
    """Rows whose expiry lies after ``as_of`` (null expiry never expires)."""
    return store.filter(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of).cast("timestamp_ntz")))


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
              values: Sequence[str], strict: bool = True,
              bucket_us: int = 24 * 3_600_000_000) -> DataFrame:
    """Each left row gets the latest right row of the same key strictly before it.

    Union both sides, order by (time, side) within (key, time bucket) and carry the last right row
    forward; the last right row of all earlier buckets comes from a small per-(key, bucket) table
    and enters the bucket as its first row.  No range join, and a busy key is many tasks.  Ties
    put left rows first when strict; null keys match null keys.
    """
    lcols = left.columns
    l_side, r_side = (0, 1) if strict else (1, 0)
    rtype = right.select(F.struct(*values).alias("s")).schema["s"].dataType
    l = left.select(*lcols, F.col(left_ts).alias("__t"), F.lit(l_side).alias("__side"),
                    F.lit(None).cast(rtype).alias("__r"))
    r = right.select(*[F.col(key) if c == key else F.lit(None).cast(left.schema[c].dataType).alias(c)
                       for c in lcols],
                     F.col(right_ts).alias("__t"), F.lit(r_side).alias("__side"), F.struct(*values).alias("__r"))
    # The whole right row travels as one struct, so a null field never borrows an older value.
    u = l.unionByName(r)
    u = u.withColumn("__b", F.floor(micros("__t") / F.lit(bucket_us)))
    is_r = F.col("__r").isNotNull()
    per = u.groupBy(key, "__b").agg(
        F.max_by(F.when(is_r, F.col("__r")), F.when(is_r, F.struct("__t", "__side"))).alias("__r"))
    earlier = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(key, "__b", F.last("__r", ignorenulls=True).over(earlier).alias("__r"), F.lit(-1).alias("__side"))
    local = (Window.partitionBy(key, "__b").orderBy(F.col("__side") >= 0, "__t", "__side")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (u.unionByName(carry, allowMissingColumns=True)
            .withColumn("__last", F.last("__r", ignorenulls=True).over(local))
            .filter(F.col("__side") == l_side).select(*lcols, *[F.col(f"__last.{v}").alias(v) for v in values]))


def write_feature_group(store: DataFrame, root: str) -> None:
    """K6 on disk: Parquet partitioned by (feature_group, version); only the partitions written
    are replaced (dynamic partition overwrite), so publishing one version leaves the others."""
    spark = store.sparkSession
    prev = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        store.write.mode("overwrite").partitionBy("feature_group", "version").parquet(root)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev)


def delete_version_on_disk(spark, root: str, group: str, version: str) -> int:
    """O10 on disk: drop one (group, version) partition directory; returns the rows it held."""
    path = f"{root.rstrip('/')}/feature_group={group}/version={version}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return 0
    n = spark.read.parquet(path).count()
    fs.delete(p, True)
    return n
