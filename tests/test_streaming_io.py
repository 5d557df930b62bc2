"""Streaming parity with the batch twins, file sources and snapshot sinks."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from kestrel.operators import moderation as M
from kestrel.sinks import hashed as HM
from kestrel.sinks import snapshots as K
from kestrel.sources import files as S
from kestrel.sources.tables import messages
from kestrel.streaming import jobs as X


def _stream_dir(spark, parts=3):
    """Messages of sf0.001 cut into several files = several micro-batches (one file per trigger)."""
    d = tempfile.mkdtemp(prefix="kestrel-stream-")
    m = messages(spark, SF001).select("msg_id", "user_id", "channel_id", "ts", "label", "hard_term", "confidence",
                                      F.lit("hello there").alias("text"))
    m = m.withColumn("__part", F.hour("ts") % parts)
    for i in range(parts):
        m.filter(F.col("__part") == i).drop("__part").coalesce(1).write.parquet(f"{d}/in/p{i}")
    return d


def _run(query_df, spark, name, checkpoint):
    q = (query_df.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)


def test_strike_stream_equals_batch_when_in_order(spark):
    d = _stream_dir(spark, parts=1)
    stream = X.message_stream(spark, f"{d}/in/*", max_files_per_trigger=1)
    got = _run(X.strike_stream(stream), spark, "strikes_stream", f"{d}/ck")
    m = messages(spark, SF001)
    batch = M.strike_history(m.select("msg_id", "user_id", "ts", "hard_term", (F.col("label") == 1).alias("is_toxic"),
                                      M.fold_confidence(F.col("confidence")).alias("confidence")))
    a = {r["msg_id"]: (r["prior_violations"], r["severity"], r["action_taken"]) for r in got.collect()}
    b = {r["msg_id"]: (r["prior_violations"], r["severity"], r["action_taken"]) for r in batch.collect()}
    assert a == b


def test_strike_stream_flags_late_rows(spark):
    d = _stream_dir(spark, parts=3)
    stream = X.message_stream(spark, f"{d}/in/*", max_files_per_trigger=1)
    got = _run(X.strike_stream(stream), spark, "strikes_late", f"{d}/ck")
    n = messages(spark, SF001).count()
    assert got.count() == n
    assert got.filter("late").count() > 0  # later files hold earlier events


def test_strike_stream_resets_and_offense_times(spark):
    import datetime as dt
    d = tempfile.mkdtemp(prefix="kestrel-resets-")
    t0 = dt.datetime(2024, 1, 1)
    flags = [(0.8, False), (0.95, False), (0.62, False), (0.5, True), (0.62, False), (0.8, False)]
    rows = [(i, 7, 0, t0 + dt.timedelta(minutes=i), 1, 0, p, "x", r) for i, (p, r) in enumerate(flags)]
    schema = X.MESSAGE_SCHEMA + ", is_reset BOOLEAN"
    for part in (rows[:2], rows[2:]):  # two micro-batches: the counter crosses them
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{d}/in")
    stream = X.message_stream(spark, f"{d}/in", schema=schema, max_files_per_trigger=1)
    got = _run(X.strike_stream(stream, "is_reset"), spark, "strikes_reset", f"{d}/ck").orderBy("msg_id").collect()
    at = [t0 + dt.timedelta(minutes=i) for i in range(6)]
    assert [(r["msg_id"], r["prior_violations"], r["severity"], r["action_taken"]) for r in got] == [
        (0, 0, "MEDIUM", "DELETE_STRIKE_1"), (1, 1, "HIGH", "TIMEOUT_10M"), (2, 2, "MEDIUM", "DELETE_STRIKE_3"),
        (4, 0, "LOW", "WARN_SOFT"), (5, 0, "MEDIUM", "DELETE_STRIKE_1")]
    assert [(r["first_offense_time"], r["last_offense_time"]) for r in got] == [
        (at[0], at[0]), (at[0], at[1]), (at[0], at[2]), (at[0], at[2]), (at[0], at[5])]  # a reset keeps the times
    assert [tuple(r) for r in X.strike_histories(spark, f"{d}/ck").collect()] == [(7, at[5], "MEDIUM")]  # since the reset


def test_strike_state_of_a_busy_user_in_many_arrow_batches(spark):
    import datetime as dt
    d = tempfile.mkdtemp(prefix="kestrel-busy-")
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, 1 if i % 10 else 2, 0, t0 + dt.timedelta(seconds=i), int(i % 3 == 0), int(i % 50 == 0), (i * 37 % 100) / 100, "x") for i in range(900)]
    for at in range(0, 900, 300):
        spark.createDataFrame(rows[at: at + 300], X.MESSAGE_SCHEMA).coalesce(1).write.mode("append").parquet(f"{d}/in")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = _run(X.strike_stream(X.message_stream(spark, f"{d}/in", max_files_per_trigger=1)), spark, "strikes_busy", f"{d}/ck").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    batch = spark.createDataFrame(rows, X.MESSAGE_SCHEMA).withColumns(
        {"is_toxic": F.col("label") == 1, "confidence": M.fold_confidence(F.col("confidence"))})
    want = M.strike_history(batch).select("msg_id", "prior_violations", "severity", "action_taken").toPandas().sort_values("msg_id", ignore_index=True)
    assert got[want.columns].sort_values("msg_id", ignore_index=True).astype(str).equals(want.astype(str))
    kept = X.strike_histories(spark, f"{d}/ck").toPandas().sort_values(["user_id", "ts"])
    struck = got[got.severity.isin(X.STRIKES)].sort_values(["user_id", "ts"])
    assert kept.severity.tolist() == struck.severity.tolist() and kept.user_id.tolist() == struck.user_id.tolist()


def test_ingest_first_batch_new_checkpoint_and_replay(spark):
    import datetime as dt
    d = tempfile.mkdtemp(prefix="kestrel-ingest-")
    t0 = dt.datetime(2024, 1, 1)
    batch = lambda *rows: spark.createDataFrame(
        [(h, t0 + dt.timedelta(hours=n), v) for h, n, v in rows], "text_hash string, ts timestamp_ntz, v int")
    handle = X.ingest_batches(f"{d}/m", prepare=lambda b: b.filter("v > 0"))
    held = lambda: {r["text_hash"]: r["v"] for r in HM.read_master(spark, f"{d}/m").collect()}
    handle(batch(("a", 0, 1), ("a", 1, 2), ("b", 0, 3), ("z", 0, 0)), 0)
    assert held() == {"a": 2, "b": 3} and HM.read_master(spark, f"{d}/m").count() == 2
    handle(batch(("c", 0, 4)), 0)  # a new checkpoint restarts the stream's batch ids
    assert held() == {"a": 2, "b": 3, "c": 4}
    handle(batch(("c", 0, 4)), 0)  # the same batch again
    assert held() == {"a": 2, "b": 3, "c": 4} and K.snapshot_ids(spark, f"{d}/m/manifests") == [0, 1, 2]


def test_featurize_and_counters_stream(spark):
    d = _stream_dir(spark, parts=2)
    stream = X.message_stream(spark, f"{d}/in/*")
    feats = _run(X.featurize(stream), spark, "feats_stream", f"{d}/ck1")
    assert feats.filter("word_count = 2 AND NOT has_hard_term").count() == feats.count() > 0
    live = _run(X.live_counters(X.message_stream(spark, f"{d}/in/*"), every="1 hour"), spark, "live_stream", f"{d}/ck3")
    assert live.count() > 0 and live.filter("mean_confidence < 0 OR mean_confidence > 1").count() == 0
    hourly = _run(X.hourly_user_counts(X.message_stream(spark, f"{d}/in/*")), spark, "hourly_stream", f"{d}/ck2")
    total = hourly.agg(F.sum("n")).first()[0]
    # Windows still open at the end of the stream stay in state (append mode), so ≤ all rows.
    assert 0 < total <= messages(spark, SF001).count()


def test_ingest_foreach_batch_snapshots(spark):
    d = _stream_dir(spark, parts=2)
    stream = X.message_stream(spark, f"{d}/in/*", max_files_per_trigger=1).withColumn(
        "text_hash", F.md5(F.col("user_id").cast("string")))
    q = (stream.writeStream.foreachBatch(X.ingest_batches(f"{d}/master", "text_hash", "ts"))
         .option("checkpointLocation", f"{d}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    ids = K.snapshot_ids(spark, f"{d}/master/manifests")
    assert len(ids) == 2
    latest = HM.read_master(spark, f"{d}/master")
    assert latest.count() == messages(spark, SF001).select("user_id").distinct().count()
    K.write_snapshot(latest, f"{d}/backup", 0)
    K.write_snapshot(latest, f"{d}/backup", 1)
    assert K.retain(spark, f"{d}/backup", 1) == [0] and K.latest_snapshot(spark, f"{d}/backup").count() == latest.count()


def test_sources(spark):
    d = tempfile.mkdtemp(prefix="kestrel-src-")
    with open(f"{d}/c.csv", "w") as fh:
        fh.write('Message,Label\n"hello, ""friend""\nsecond line",0\nyou idiot,1\n')
    c = S.read_corpus_csv(spark, f"{d}/c.csv").collect()
    assert c[0]["text"] == 'hello, "friend"\nsecond line' and c[1]["label"] == 1
    with open(f"{d}/log.jsonl", "w") as fh:
        fh.write('{"text": "a", "prediction": 1}\n{broken\n{"text": "b", "verified_label": 0}\n')
    schema = "text string, prediction int, verified_label int"
    from pyspark.sql.types import StructType
    good, bad = S.read_jsonl(spark, f"{d}/log.jsonl", StructType.fromDDL(schema))
    assert good.count() == 2 and bad.count() == 1
    u = S.union_sources(spark, [f"{d}/log.jsonl", f"{d}/missing.jsonl"], StructType.fromDDL(schema))
    assert u.count() == 2
    with open(f"{d}/api.log", "w") as fh:
        fh.write("2024-01-01 10:00:00,123 - api - INFO - POST /predict - Status: 200 - Duration: 0.015s\n"
                 "2024-01-01 10:00:01,000 - api - ERROR - boom\nTraceback (most recent call last):\n  x\n"
                 "2024-01-01 10:00:02,500 - api - INFO - GET / - Status: 200 - Duration: 0.002s\n")
    log = S.read_service_log(spark, f"{d}/api.log")
    assert log.filter("is_continuation").count() == 2
    assert log.filter("is_continuation").select("entry_no").distinct().count() == 1
    req = S.requests_from_log(log)
    from kestrel.operators import ops
    assert {r["endpoint"]: r["n"] for r in ops.request_counts(req).collect()} == {"/predict": 1, "/": 1}
    hist = {r["le"]: r["n"] for r in ops.latency_histogram(req, "duration_s").collect()}
    assert hist["0.01"] == 1 and hist["0.025"] == 2 and hist["+Inf"] == 2


def test_run_tree(spark):
    d = tempfile.mkdtemp(prefix="kestrel-runs-")
    for rid, parent, f2, status in [("p1", None, None, "3"), ("c1", "p1", 0.8, "3"), ("c2", "p1", 0.9, "3"),
                                    ("c3", "p1", None, "4")]:
        os.makedirs(f"{d}/{rid}/metrics")
        os.makedirs(f"{d}/{rid}/tags")
        with open(f"{d}/{rid}/meta.yaml", "w") as fh:
            fh.write(f"run_name: {rid}\nstatus: {status}\nstart_time: 1000\nend_time: 3000\n")
        if parent:
            with open(f"{d}/{rid}/tags/mlflow.parentRunId", "w") as fh:
                fh.write(parent)
        if f2 is not None:
            with open(f"{d}/{rid}/metrics/f2_score", "w") as fh:
                fh.write(f"1700000000000 {f2} 0\n")
    from kestrel.operators import ops
    runs = ops.run_table(S.read_runs(spark, d))
    lb = ops.leaderboard(runs).first()
    assert lb["best_run"] == "c2" and lb["trials"] == 3 and lb["failed"] == 1 and lb["total_duration_s"] == 6.0


def test_stream_static_enrichment_and_append_sink(spark):
    from kestrel.operators import serving as SV
    d = _stream_dir(spark, parts=1)
    store = spark.createDataFrame([("user_toxicity", "prod", 8, 0.5, 0.4, 0.1, 2.0, 0)],
                                  "feature_group string, version string, entity_id long, user_bad_ratio_7d double, "
                                  "user_bad_ratio_30d double, user_toxicity_trend double, hours_since_last_msg double, "
                                  "is_new_to_channel int")
    enriched = X.enrich_stream(X.message_stream(spark, f"{d}/in/*"), store)
    q = (X.append_sink(enriched.select("msg_id", "user_id", "user_bad_ratio_7d", "is_new_to_channel"),
                       f"{d}/out", f"{d}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.json(f"{d}/out")
    assert out.count() == messages(spark, SF001).count()
    assert {r["user_bad_ratio_7d"] for r in out.filter("user_id = 8").collect()} == {0.5}
    assert {r["is_new_to_channel"] for r in out.filter("user_id <> 8").collect()} == {1}


def test_sinks_and_counters(spark):
    from kestrel.operators import ops, serving as SV
    d = tempfile.mkdtemp(prefix="kestrel-sink-")
    df = spark.createDataFrame([("v1", 1, 0.9), ("v1", 0, 0.7), ("v2", 1, 0.8)],
                               "model_version string, prediction int, confidence double")
    K.append_json(df, f"{d}/log")
    K.append_json(df, f"{d}/log")
    assert spark.read.json(f"{d}/log").count() == 6
    K.write_latest_json(df.limit(1), f"{d}/latest", f"{d}/history")
    K.write_latest_json(df.limit(1), f"{d}/latest", f"{d}/history")
    assert spark.read.json(f"{d}/latest").count() == 1 and spark.read.json(f"{d}/history").count() == 2
    K.write_top_csv(df, f"{d}/top", "confidence", 2)
    top = spark.read.option("header", True).csv(f"{d}/top").collect()
    assert [float(r["confidence"]) for r in top] == [0.9, 0.8]
    c = {r["model_version"]: (r["toxic"], r["non_toxic"]) for r in ops.prediction_counters(df).collect()}
    assert c == {"v1": (1, 1), "v2": (1, 0)}
    store = spark.createDataFrame([("g", "v0", 1), ("g", "v1", 1), ("g", "v1", 2)],
                                  "feature_group string, version string, entity_id int")
    SV.write_feature_group(store, f"{d}/fg")
    SV.write_feature_group(store.filter("version = 'v1'").limit(1), f"{d}/fg")  # replaces v1 only
    assert spark.read.parquet(f"{d}/fg").count() == 2
    assert SV.delete_version_on_disk(spark, f"{d}/fg", "g", "v0") == 1
    assert spark.read.parquet(f"{d}/fg").count() == 1


def test_coefficient_importance(spark):
    from kestrel.operators import training as TR
    from kestrel.sources.tables import read_table
    emb = TR.with_class_weights(TR.embeddings_frame(read_table(spark, SF001, "embeddings")))
    model = TR.training_pipeline("vec", [], k=4).fit(emb)
    imp = TR.coefficient_importance(model, [f"pc{i}" for i in range(4)], n=3).collect()
    assert len(imp) == 3 and imp[0]["importance"] >= imp[-1]["importance"]


def test_bot_tables_and_small_operators(spark):
    import datetime as dt
    from kestrel.operators import ingest as I
    d = tempfile.mkdtemp(prefix="kestrel-bot-")
    users = spark.createDataFrame([("1", 2, None, None, '["MEDIUM", "HIGH"]', None), ("2", 0, None, None, None, None)],
                                  S.USERS_SCHEMA)
    users.write.parquet(f"{d}/users")
    u = {r["user_id"]: r["severity_history"] for r in S.read_users(spark, f"{d}/users").collect()}
    assert u == {"1": ["MEDIUM", "HIGH"], "2": []}
    logs = spark.createDataFrame([(1, "1", "m", 0.9, "HIGH", "DELETE_WARN_HIGH", dt.datetime(2024, 1, 1),
                                   '{"channel_id": "42"}')], S.LOGS_SCHEMA)
    logs.write.parquet(f"{d}/logs")
    r = S.read_action_log(spark, f"{d}/logs").first()
    assert r["channel_id"] == "42" and r["confidence"] == 0.9 and r["review_timestamp"] is None
    df = spark.createDataFrame([(None, 1.5, "a"), (2, None, None)], "a int, b double, c string")
    filled = I.fill_numeric(df).collect()
    assert filled[0]["a"] == 0 and filled[1]["b"] == 0.0 and filled[1]["c"] is None  # Q3: text stays null
    x, y = I.common_columns(df, spark.createDataFrame([(1, "z")], "d int, c string"))
    assert x.columns == ["c"] and y.columns == ["c"]
    gate = I.sample_gate(df, 10).first()
    assert gate["n"] == 2 and not gate["passed"]


def test_stream_dedupe_within_watermark(spark):
    d = _stream_dir(spark, parts=1)
    s = X.message_stream(spark, f"{d}/in/*").withColumn("text_hash", F.md5(F.col("user_id").cast("string")))
    out = _run(X.dedupe_stream(s, "text_hash").select("msg_id", "text_hash"), spark, "dedupe_stream", f"{d}/ck")
    # Every user's hash is kept once per watermark horizon; never more rows than input.
    n_users = messages(spark, SF001).select("user_id").distinct().count()
    assert n_users <= out.count() <= messages(spark, SF001).count()
    assert out.select("text_hash").distinct().count() == n_users


def test_trailing_from_hourly_matches_brute_force(spark):
    import datetime as dt
    rows = [(1, dt.datetime(2024, 1, 1, h % 24) + dt.timedelta(days=h // 24), h % 2) for h in range(0, 200, 3)]
    hourly = spark.createDataFrame([(u, t, 1, b) for u, t, b in rows], "user_id long, hour timestamp_ntz, n long, bad long")
    as_of = dt.datetime(2024, 1, 9, 0)
    got = X.trailing_from_hourly(hourly, as_of.strftime("%Y-%m-%d %H:%M:%S")).first()
    lo = as_of - dt.timedelta(hours=168)
    inside = [b for _, t, b in rows if lo <= t < as_of]
    assert got["n"] == len(inside) and got["bad"] == sum(inside)
    assert got["bad_ratio"] == sum(inside) / len(inside)
