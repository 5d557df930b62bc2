"""The hash-bucketed master and the late-row tables."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from kestrel.operators import ingest as I
from kestrel.sinks import hashed as HM
from kestrel.sinks import snapshots as K
from kestrel.streaming import jobs as X
from kestrel.streaming import late as L

T0 = dt.datetime(2024, 1, 1)


def files_under(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names}


def batch(spark, rows):
    return spark.createDataFrame([(h, T0 + dt.timedelta(hours=n), v) for h, n, v in rows], "text_hash string, ts timestamp_ntz, v int")


def held(spark, root):
    return {r["text_hash"]: r["v"] for r in HM.read_master(spark, root).collect()}


def test_merge_touches_only_its_buckets_and_replays(spark, tmp_path):
    root, order = str(tmp_path / "m"), [(F.unix_micros(F.col("ts").cast("timestamp")), False)]
    assert HM.read_master(spark, root) is None
    first = HM.merge_into(batch(spark, [(f"k{i}", 0, i) for i in range(200)] + [(None, 0, -1), (None, 1, -2)]), root, "text_hash", order)
    want = {f"k{i}": i for i in range(200)} | {None: -2}
    assert held(spark, root) == want and first["carried"] == 0
    before = files_under(root + "/data")
    small = batch(spark, [("k7", 2, 700), ("new", 2, 1)])
    done = HM.merge_into(small, root, "text_hash", order)
    want |= {"k7": 700, "new": 1}
    assert held(spark, root) == want
    assert len(done["touched"]) <= 2 and done["carried"] >= len(first["touched"]) - 2
    assert before.items() <= files_under(root + "/data").items()               # nothing that was there was written again
    written = {p.split("bucket=")[1][:2] for p in files_under(root + "/data/version=1") if "bucket=" in p}
    assert written == set(done["touched"])
    HM.merge_into(small, root, "text_hash", order)                             # the same batch again
    assert held(spark, root) == want and K.snapshot_ids(spark, root + "/manifests") == [0, 1, 2]
    assert HM.merge_into(small.limit(0), root, "text_hash", order)["version"] is None
    assert set(held(spark, root)) == set(want) and {r["text_hash"] for r in HM.read_master(spark, root, done["touched"]).collect()} >= {"k7", "new"}
    assert HM.retain_versions(spark, root, 1) == [1] and held(spark, root) == want   # version 0 still holds the carried buckets


def test_an_unfinished_merge_leaves_the_master_as_it_was(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "m")
    HM.merge_into(batch(spark, [("a", 0, 1)]), root)
    monkeypatch.setattr(HM, "write_snapshot", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        HM.merge_into(batch(spark, [("a", 1, 2)]), root)
    monkeypatch.undo()
    assert held(spark, root) == {"a": 1}
    HM.merge_into(batch(spark, [("a", 1, 2)]), root)
    assert held(spark, root) == {"a": 2}


def test_ingest_logs_runs_the_whole_pipeline(spark, tmp_path):
    def logs(n, start=0, label=lambda i: i % 3 == 0):
        rows = [(f"message number {start + i}", f"u{i % 4}", T0 + dt.timedelta(minutes=i), int(label(i)), None) for i in range(n)]
        return spark.createDataFrame(rows + rows[:2], "text string, user_id string, ts timestamp_ntz, verified_label int, prediction int")
    root, report = str(tmp_path / "m"), str(tmp_path / "r")
    handle = X.ingest_logs(root, report)
    handle(logs(40), 0)
    handle(logs(5), 1)                                    # too few
    handle(logs(50, label=lambda i: 0), 2)                # one class: its share is 1, not below the minimum
    handle(logs(60, 30, lambda i: i == 0), 3)             # the minority is below a tenth
    handle(logs(40), 0)                                   # replay of the first batch
    rows = {r["epoch"]: r for r in spark.read.parquet(report).collect()}
    assert [rows[e]["status"] for e in range(4)] == ["merged", "too_few", "merged", "quality_failed"]
    assert rows[0]["new_samples"] == 40 and rows[2]["master_size_after"] == 50 and rows[2]["duplicates_removed"] == 40
    master = HM.read_master(spark, root)
    assert master.count() == 50 and {"text_hash", "ingested_at", "msg_len", "user_bad_ratio_7d", "user_toxicity_rate"} <= set(master.columns)
    assert master.filter("user_msg_count_total > 0 AND word_count = 3 AND label_source = 'human'").count() == 50


def test_prepare_batch_contract(spark):
    with pytest.raises(I.MissingColumns):
        I.prepare_batch(spark.createDataFrame([("x",)], "text string"), T0)


def messages(n=400, seed=3):
    rng = random.Random(seed)
    rows = [(i, f"u{rng.randrange(5)}", T0 + dt.timedelta(minutes=i), i % 4 == 0, rng.random() * 3) for i in range(n)]
    return [(i, u, t, int(b), v if i % 9 else None) for i, u, t, b, v in rows]


MESSAGES = "msg_id long, user_id string, ts timestamp_ntz, label int, seconds double"


@pytest.mark.parametrize("summarize, keys, sums", [
    (L.hourly_sums(), ["user_id", "hour"], ["n", "bad"]), (L.latency_sums("seconds"), ["hour", "le"], ["n", "total"])])
def test_no_row_is_lost_between_live_and_late(spark, tmp_path, summarize, keys, sums):
    rows = messages()
    order = sorted(range(len(rows)), key=lambda i: i + random.Random(i).choice([0, 0, 0, 150, 300]))   # some arrive hours late
    parts = [[rows[i] for i in order[at: at + 80]] for at in range(0, len(order), 80)] + [[]]
    root = str(tmp_path / "t")
    handle = L.route_late(root, summarize)
    frames = [spark.createDataFrame(p, MESSAGES) for p in parts]
    for epoch, frame in enumerate(frames):
        handle(frame, epoch)
    snapshot = sorted(map(str, spark.read.parquet(root + "/late").collect()))
    handle(frames[3], 3)                                  # a batch repeated after a failure is split as before
    assert sorted(map(str, spark.read.parquet(root + "/late").collect())) == snapshot and snapshot
    got = {tuple(r[k] for k in keys): [r[s] for s in sums] for r in L.totals(spark, root, keys, sums).collect()}
    want = {tuple(r[k] for k in keys): [r[s] for s in sums] for r in summarize(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    live = L.totals(spark, root, keys, sums, late=False)
    assert live.agg(F.sum("n")).first()[0] < sum(w[0] for w in want.values())
    L.merge_late(spark, root, keys, sums, str(tmp_path / "merged"))
    assert spark.read.parquet(str(tmp_path / "merged")).count() == len(want)
    counted = L.late_share(spark, root).first()
    assert counted["timely"] + counted["late"] == sum(w[0] for w in want.values()) and counted["late"] > 0


def test_late_rows_in_a_running_stream(spark, tmp_path):
    rows = messages(200)
    for part, chosen in enumerate((rows[100:], rows[:100])):                   # the first hours arrive last
        spark.createDataFrame(chosen, MESSAGES).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
        os.utime(next(p for p in files_under(tmp_path / f"in/p{part}") if p.endswith(".parquet")), (1e9 + part, 1e9 + part))
    stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    root = str(tmp_path / "t")
    q = (stream.writeStream.foreachBatch(L.route_late(root, L.hourly_sums())).option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    counted = L.late_share(spark, root).first()
    assert counted["timely"] + counted["late"] == 200 and counted["late"] > 0


def test_merge_summary_equals_the_merge(spark):
    master = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "text_hash string, v int")
    new = spark.createDataFrame([("b", 5), ("c", 6), (None, 7)], "text_hash string, v int")
    merged = I.merge_dedupe(master, new, "text_hash", [(F.col("v"), False)])
    assert I.merge_summary(master, new).first() == I.ingestion_summary(master, new, merged).first()
    assert I.merge_summary(master.limit(0), new.limit(0)).first()["master_size_after"] == 0
