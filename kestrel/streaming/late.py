"""Late rows of a stream: kept aside instead of dropped, and merged later.

Windowed aggregates of Structured Streaming drop rows behind the watermark.  Here every micro-batch is
split by a watermark that the job keeps itself: rows at or after it go to the live table, the
others to a late table, both as hourly partial sums under the batch's number.  The
watermark after batch ``e`` is written under ``e`` before any table, and batch ``e`` is always split by
the one kept under ``e - 1``: a batch that is repeated after a failure is split the same way and
overwrites its own partitions, so no row is lost or counted twice.  Reading both tables together gives the counts
over all rows, whatever their order of arrival.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import micros
from ..operators.ops import LATENCY_BUCKETS

HOUR_US = 3_600_000_000


def _rows_at(spark: SparkSession, path: str, schema) -> DataFrame | None:
    from ..sinks.snapshots import _fs
    fs, p, _ = _fs(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(p) else None


_WATERMARKS = "epoch BIGINT, watermark BIGINT"


def kept_watermark(spark: SparkSession, root: str, before_epoch: int) -> int | None:
    """Watermark (µs) that earlier batches left behind; None before the first."""
    found = _rows_at(spark, f"{root}/watermarks", _WATERMARKS)
    if found is None:
        return None
    return found.filter(F.col("epoch") < before_epoch).agg(F.max("watermark")).first()[0]  # one number


def _overwrite(df: DataFrame, path: str, epoch: int) -> None:
    (df.withColumn("epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path))


def route_late(root: str, summarize: Callable[[DataFrame], DataFrame], ts: str = "ts", delay_us: int = HOUR_US):
    """``foreachBatch`` handler: ``summarize`` of the timely rows to ``root/live``, of the late ones to ``root/late``.

    ``summarize`` returns additive partial sums.  A row without a time is timely.  The batch is read once for its newest time and once
    for each table.
    """
    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        at = micros(ts)
        batch = batch.persist()
        try:
            mark = kept_watermark(spark, root, epoch)
            newest = batch.agg(F.max(at)).first()[0]                     # one number
            ahead = max((x for x in (mark, None if newest is None else newest - delay_us) if x is not None), default=None)
            if ahead is not None:
                _overwrite(spark.createDataFrame([(ahead,)], "watermark BIGINT"), f"{root}/watermarks", epoch)
            late = F.coalesce(at < F.lit(mark), F.lit(False)) if mark is not None else F.lit(False)
            _overwrite(summarize(batch.filter(~late)), f"{root}/live", epoch)
            _overwrite(summarize(batch.filter(late)), f"{root}/late", epoch)
        finally:
            batch.unpersist()
    return handle


def hourly_sums(keys: Sequence[str] = ("user_id",), ts: str = "ts", label: str = "label") -> Callable[[DataFrame], DataFrame]:
    """(keys, hour, n, bad) of a batch."""
    def summarize(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys, F.date_trunc("hour", F.col(ts).cast("timestamp")).cast("timestamp_ntz").alias("hour")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col(label), F.lit(0)).cast("bigint")).alias("bad"))
    return summarize


def latency_sums(value: str, keys: Sequence[str] = (), ts: str = "ts", buckets: Sequence[float] = LATENCY_BUCKETS) -> Callable[[DataFrame], DataFrame]:
    """Live latency histogram: per key and hour one row for each bound ``le`` (and +Inf) with count and sum."""
    def summarize(rows: DataFrame) -> DataFrame:
        v = F.col(value)
        under = [F.struct(F.lit(str(b)).alias("le"), (v <= b).cast("bigint").alias("hit")) for b in buckets]
        cells = F.array(*under, F.struct(F.lit("+Inf").alias("le"), F.lit(1).cast("bigint").alias("hit")))
        hour = F.date_trunc("hour", F.col(ts).cast("timestamp")).cast("timestamp_ntz").alias("hour")
        return (rows.filter(v.isNotNull()).select(*keys, hour, v.alias("v"), F.explode(cells).alias("c")).groupBy(*keys, "hour", "c.le")
                .agg(F.sum("c.hit").alias("n"), F.sum("v").alias("total")))
    return summarize


def totals(spark: SparkSession, root: str, keys: Sequence[str], sums: Sequence[str], late: bool = True) -> DataFrame:
    """Sums of the live table, with the late rows merged in unless ``late`` is False."""
    both = spark.read.parquet(f"{root}/live")
    if late:
        both = both.unionByName(spark.read.parquet(f"{root}/late"))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def merge_late(spark: SparkSession, root: str, keys: Sequence[str], sums: Sequence[str], path: str) -> None:
    """Write the merged table of all rows that arrived so far to ``path`` (a new folder)."""
    totals(spark, root, keys, sums).write.mode("errorifexists").parquet(path)


def late_share(spark: SparkSession, root: str, n: Column | str = "n") -> DataFrame:
    """(timely, late): how many rows went to either table."""
    live = spark.read.parquet(f"{root}/live").agg(F.coalesce(F.sum(n), F.lit(0)).alias("x")).scalar()
    return spark.read.parquet(f"{root}/late").agg(F.coalesce(F.sum(n), F.lit(0)).alias("late")).select(live.alias("timely"), "late")
