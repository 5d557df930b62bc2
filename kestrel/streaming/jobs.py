"""Structured Streaming jobs.

The live path of the pipeline handles one chat message at a time.  Here it is one streaming
query over a message source: stateless features (X2) and stream–static enrichment (X3) are the
batch expressions unchanged; the per-user strike counter (X4) is keyed state; counters (X6)
and hourly user aggregates (X7) are watermarked tumbling windows; ingestion (X8) merges each
micro-batch into the master snapshot inside ``foreachBatch``.

Late data policy: watermark 1 hour.  Rows later than that are dropped by the windowed
aggregations here; ``late`` keeps them in a table of their own and merges them later.  X4 processes rows in arrival order, sorted by event time inside each
micro-batch, and flags rows older than the user's last processed event.  A micro-batch is bounded
by the source's ``maxFilesPerTrigger``; X4 shuffles only ids, times and two verdicts per message.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions.text import micros
from ..operators import moderation as M
from ..operators import serving as S

MESSAGE_SCHEMA = (
    "msg_id BIGINT, user_id BIGINT, channel_id BIGINT, ts TIMESTAMP_NTZ, label INT, hard_term INT, "
    "confidence DOUBLE, text STRING")


def message_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str = MESSAGE_SCHEMA,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """File-source stream with a declared schema (no inference on streams)."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


def featurize(stream: DataFrame, text: str = "text", hard_terms=None) -> DataFrame:
    """The batch text features, cleaner and hard-term flag on a streaming DataFrame."""
    return stream.withColumns({**T.feature_columns(text),
                               "clean_text": T.clean_text(text),
                               "has_hard_term": T.has_hard_term(text, hard_terms)})


def enrich_stream(stream: DataFrame, store: DataFrame, key: str = "user_id") -> DataFrame:
    """stream–static left join with the online feature table, defaults when absent."""
    return S.enrich(stream, store, "user_toxicity", "prod", key)


# --- X4: per-user strike state ---------------------------------------------------------------

STRIKE_OUT = ("msg_id BIGINT, user_id BIGINT, at BIGINT, prior_violations BIGINT, severity STRING, "
              "strike_after BIGINT, first_offense BIGINT, last_offense BIGINT, late BOOLEAN")
STRIKE_STATE = "violations BIGINT, first_offense BIGINT, last_offense BIGINT, seen BIGINT"
HISTORY_STATE = "at BIGINT, severity STRING"
STRIKES = ("MEDIUM", "HIGH")
#: Keyed state with lists needs the state store that keeps them outside the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _running_violations(held: int, base: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    """Violations held before each message; ``base``/``repeat``: is it one under either regime."""
    before = held + np.cumsum(base) - base
    again = before >= 2
    more = (repeat & again).astype("int64")
    return np.where(again, max(held, 2) + np.cumsum(more) - more, before)


def _offenses(at: np.ndarray, struck: np.ndarray, held: int) -> np.ndarray:
    """Latest offense time up to and including each message (0: none yet)."""
    return np.maximum.accumulate(np.concatenate([[held], np.where(struck, at, 0)]))[1:]


class StrikeProcessor(StatefulProcessor):
    """Per user: the counter as value state, the severities since the last reset as list state.

    Rows come in Arrow batches; each is folded on its own, in time order, over the counter so far, and its strikes are
    appended to the list.  Neither a user's rows nor their history are ever held together.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counter = handle.getValueState("counter", STRIKE_STATE)
        self.history = handle.getListState("history", HISTORY_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(int(v) for v in self.counter.get()) if self.counter.exists() else (0, 0, 0, 0)
        for pdf in rows:
            if len(pdf):
                state, out = self._fold(state, pdf.sort_values(["at", "msg_id"], kind="stable", ignore_index=True))
                yield from out
        self.counter.update(state)

    def _fold(self, state: tuple, rows: pd.DataFrame) -> tuple[tuple, list[pd.DataFrame]]:
        """A batch over the stored counter, in closed form from one reset to the next."""
        held, first, last, seen = state
        out = []
        for part in np.split(np.arange(len(rows)), np.flatnonzero(rows["is_reset"])):
            if not len(part):
                continue
            span = rows.iloc[part]
            if span["is_reset"].iloc[0]:
                held = 0
                self.history.clear()
                span = span.iloc[1:]
            if span.empty:
                continue
            base, repeat = (span[c].isin(STRIKES).to_numpy() for c in ("base", "repeat"))
            prior = _running_violations(held, base.astype("int64"), repeat)
            verdict = np.where(prior >= 2, span["repeat"], span["base"])
            struck = np.where(prior >= 2, repeat, base)
            at = span["at"].to_numpy()
            latest = _offenses(at, struck, last)
            if not first and struck.any():
                first = int(at[struck][0])
            if struck.any():
                self.history.appendList([(int(t), str(v)) for t, v in zip(at[struck], verdict[struck])])
            out.append(pd.DataFrame({
                "msg_id": span["msg_id"], "user_id": span["user_id"], "at": at, "prior_violations": prior,
                "severity": verdict, "strike_after": prior + struck,
                "first_offense": np.where(latest > 0, first, 0), "last_offense": latest, "late": at < seen}))
            held, last = int(prior[-1] + struck[-1]), int(latest[-1])
        return (held, first, last, max(seen, int(rows["at"].max()))), out

    def close(self) -> None:
        pass


def strike_stream(stream: DataFrame, reset: str | None = None) -> DataFrame:
    """Keyed per-user strike counter (no state TTL: strikes never expire).

    A message's severity is one of two verdicts, below or from two strikes on.  Both are columns
    (``moderation.severity``); the state holds the counter, the first and last offense, the newest time
    seen and the list of severities since the last reset (``strike_histories``).  ``reset`` names a boolean column that
    marks admin resets: they clear the counter and the list, leave the offense times and yield no row.  A null flag
    counts as false; a message without a time sorts first, as if of 1970.  A user's rows are put in time
    order within each Arrow batch of a micro-batch (``spark.sql.execution.arrow.maxRecordsPerBatch`` rows); a row older
    than one already folded is flagged as late.  The session's state store is set to ``STATE_STORE``.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    hard = F.coalesce(F.col("hard_term").cast("boolean"), F.lit(False))
    toxic = F.coalesce(F.col("label") == 1, F.lit(False))
    p = M.fold_confidence(F.col("confidence"))
    judged = stream.select(
        "msg_id", "user_id", F.coalesce(micros("ts"), F.lit(0)).alias("at"),
        M.severity(hard, toxic, p, F.lit(0)).alias("base"), M.severity(hard, toxic, p, F.lit(2)).alias("repeat"),
        (F.coalesce(F.col(reset).cast("boolean"), F.lit(False)) if reset else F.lit(False)).alias("is_reset"))
    out = judged.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=StrikeProcessor(), outputStructType=STRIKE_OUT, outputMode="append", timeMode="None")

    def time(col: str):
        return F.when(F.col(col) > 0, F.timestamp_micros(F.col(col)).cast("timestamp_ntz"))
    return out.select("msg_id", "user_id", time("at").alias("ts"), "prior_violations", "severity",
                      M.action(F.col("severity"), F.col("strike_after")).alias("action_taken"), "strike_after",
                      time("first_offense").alias("first_offense_time"),
                      time("last_offense").alias("last_offense_time"), "late")


def strike_histories(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(user_id, ts, severity) of every user's strikes since their last reset, read from a query's state."""
    state = (spark.read.format("statestore").option("stateVarName", "history").option("flattenCollectionTypes", "true").load(checkpoint))
    return state.select(F.col("key.user_id").alias("user_id"), F.timestamp_micros("list_element.at").cast("timestamp_ntz").alias("ts"),
                        F.col("list_element.severity").alias("severity"))


# --- X5–X8 ------------------------------------------------------------------------------------

def append_sink(df: DataFrame, path: str, checkpoint: str, fmt: str = "json"):
    """Continuous append to an event/action log with a checkpoint (exactly-once files)."""
    return df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def _event_time(stream: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP; naive times are read as UTC (the session zone)."""
    return stream.withColumn("event_time", F.col(ts).cast("timestamp"))


def live_counters(stream: DataFrame, ts: str = "ts", every: str = "5 seconds", watermark: str = "1 hour") -> DataFrame:
    """X6 (A12–A14 live): per window and label — messages, toxic count, mean confidence."""
    return (_event_time(stream, ts).withWatermark("event_time", watermark)
            .groupBy(F.window("event_time", every).alias("w"), "label")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("hard_term").alias("hard_terms"),
                 F.avg("confidence").alias("mean_confidence"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "label", "n", "hard_terms",
                    "mean_confidence"))


def hourly_user_counts(stream: DataFrame, ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """Hourly tumbling (user, hour) message and bad counts; a 7-day ratio is the sum of the last 168."""
    return (_event_time(stream, ts).withWatermark("event_time", watermark)
            .groupBy("user_id", F.window("event_time", "1 hour").alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad"))
            .select("user_id", F.col("w.start").cast("timestamp_ntz").alias("hour"), "n", "bad"))


def trailing_from_hourly(hourly: DataFrame, as_of, hours: int = 168) -> DataFrame:
    """X7 read side: per user, messages and bad ratio over the last ``hours`` hourly rows."""
    lo = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(hours))
    recent = hourly.filter((F.col("hour") >= lo) & (F.col("hour") < F.lit(as_of).cast("timestamp_ntz")))
    return recent.groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn(
        "bad_ratio", F.when(F.col("n") > 0, F.col("bad") / F.col("n")))


def dedupe_stream(stream: DataFrame, key: str = "text_hash", ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """X8 raw side: drop duplicate hashes seen within the watermark."""
    return _event_time(stream, ts).withWatermark("event_time", watermark).dropDuplicatesWithinWatermark([key])


def ingest_batches(master_path: str, key: str = "text_hash", order_col: str = "ts",
                   prepare: Callable[[DataFrame], DataFrame] | None = None):
    """``foreachBatch`` handler merging each micro-batch into the master.

    The master is cut into buckets by a hash of the key (``sinks.hashed``): a batch reads and rewrites the buckets its rows
    fall into, a new version carries all others over.  ``prepare`` turns raw rows into master rows.  The batch is
    deduped even when there is no master yet.  Versions only grow, whatever the stream's own batch
    ids are, and nothing is overwritten while it is read; a replayed batch merges to the same rows.
    """
    from ..sinks.hashed import merge_into

    def handle(batch: DataFrame, epoch_id: int) -> None:
        new = prepare(batch) if prepare else batch
        new = new.persist()
        try:
            merge_into(new, master_path, key, [(micros(order_col), False)])
        finally:
            new.unpersist()
    return handle


def ingest_logs(master_path: str, report_path: str, as_of=None, min_rows: int = 10, key: str = "text_hash"):
    """X8 with its whole pipeline: each micro-batch of log rows is prepared, checked and merged.

    ``ingest.prepare_batch`` (P1–P3, P5, P6, O4, features) and the gates (P4 sample gate, A4–A8 quality verdict) decide; a batch that fails
    a gate is not merged.  One report row per batch is appended to ``report_path`` under its epoch: status, sizes of batch and
    master, duplicates removed (A10).  ``as_of`` fixes the ingestion time; by default it is the batch's newest ``ts``.
    """
    from ..operators import ingest as I
    from ..sinks.hashed import merge_into, read_master

    def handle(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        time = as_of or batch.agg(F.max("ts")).first()[0]
        new = I.prepare_batch(batch, time).persist()
        try:
            n = new.count()
            before = read_master(spark, master_path)
            had = before.count() if before is not None else 0
            status = "too_few" if n < min_rows else "quality_failed" if I.quality_failed(new) else "merged"
            if status == "merged":
                merge_into(new, master_path, key, [(micros("ts"), False)])
            now = read_master(spark, master_path)
            has = now.count() if now is not None else 0
            row = [(status, n, had, has, had + n - has if status == "merged" else 0)]
            (spark.createDataFrame(row, "status string, new_samples bigint, master_size_before bigint, master_size_after bigint, duplicates_removed bigint")
             .withColumn("epoch", F.lit(epoch_id).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("epoch").parquet(report_path))
        finally:
            new.unpersist()
    return handle
