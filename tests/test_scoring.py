"""The packaged scorer on tables and streams, and service logs read in many blocks."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from kestrel.operators import embedding as EM
from kestrel.operators import scoring as SC
from kestrel.sources import files as S

T0 = dt.datetime(2024, 1, 1)
MESSAGES = "msg_id long, user_id string, text string, ts timestamp_ntz, label int"


@pytest.fixture(scope="module")
def messages(spark):
    rows = []
    for i in range(120):
        bad = i % 3 == 0
        text = f"you stupid idiot {i}" if bad else f"have a calm and pleasant day {i}"
        rows.append((i, None if i == 5 else f"u{i % 4}", None if i == 7 else text * (20 if i == 9 else 1), T0 + dt.timedelta(minutes=i), int(bad)))
    return spark.createDataFrame(rows, MESSAGES)


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame([("user_toxicity", "prod", "u0", 0.9, 0.1, 0.2, 3.0, 0), ("user_toxicity", "old", "u1", 0.7, 0.0, 0.0, 1.0, 0)],
                                 "feature_group string, version string, entity_id string, user_bad_ratio_7d double, user_toxicity_trend double, "
                                 "channel_toxicity_ratio double, hours_since_last_msg double, is_new_to_channel int")


@pytest.fixture(scope="module")
def scorer(messages, store):
    learner = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=0.01)
    return SC.train_scorer(messages, "v7", learner, store, k=8)


def test_features_are_enriched_cast_and_complete(scorer, messages, store):
    f = {r["msg_id"]: r for r in scorer.features(messages, store).collect()}
    assert f[4]["user_bad_ratio_7d"] == 0.9 and f[1]["user_bad_ratio_7d"] == 0.0 and f[1]["hours_since_last_msg"] == 24.0
    assert f[5]["features_enriched"] is False and f[4]["features_enriched"] is True and f[7]["msg_len"] == 0
    kinds = dict(scorer.features(messages, store).dtypes)
    assert kinds["msg_len"] == "bigint" and kinds["is_new_to_channel"] == "bigint" and kinds["caps_ratio"] == "double"
    assert len(f) == 120


def test_batch_and_stream_rows_are_equal(spark, scorer, messages, store, tmp_path):
    batch = scorer.log_rows(messages, store, "ts")
    assert batch.columns == list(SC.LOG_COLUMNS)
    messages.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (scorer.log_rows(stream, store, "ts").writeStream.format("json").option("path", str(tmp_path / "log"))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    live = spark.read.schema(batch.schema).json(str(tmp_path / "log"))
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows.withColumn("confidence", F.round("confidence", 9)).collect())
    assert key(live) == key(batch) and live.count() == 120


def test_scores_log_rows_and_saved_scorer(spark, scorer, messages, store, tmp_path):
    got = {r["msg_id"]: r for r in scorer.score(messages, store).collect()}
    assert np.mean([got[i]["prediction"] == int(i % 3 == 0) for i in got]) > 0.95
    assert all(r["confidence"] >= 0.5 and r["confidence"] == max(r["p_toxic"], 1 - r["p_toxic"]) for r in got.values())
    log = {r["timestamp"]: r for r in scorer.log_rows(messages, store, "ts").collect()}
    assert len(log["2024-01-01T00:09:00.000000"]["text"]) == 253 and log["2024-01-01T00:00:00.000000"]["model_version"] == "v7"
    scorer.save(str(tmp_path / "s"))
    again = {r["msg_id"]: r["p_toxic"] for r in SC.Scorer.load(spark, str(tmp_path / "s")).score(messages, store).collect()}
    assert all(again[i] == pytest.approx(got[i]["p_toxic"]) for i in got)
    assert scorer.score(messages.limit(0), store).count() == 0


def test_cast_features(spark):
    df = spark.createDataFrame([("3", None)], "a string, b double")
    assert SC.cast_features(df, ["a", "b", "c"], ["a", "c"]).first().asDict() == {"a": 3, "b": 0.0, "c": 0}


def test_encoder_sees_whole_texts_in_chunks(spark):
    texts = ["abcdefgh" * 5 + "z", "", None, "xy"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = EM.embed_with_model(df, "t", lambda: lambda ts: np.array([[len(t), t.count("z")] for t in ts], float), 2, batch_size=3, chunk_chars=10)
    rows = {r["id"]: r["embedding"] for r in got.collect()}
    assert rows[0] == pytest.approx([(4 * 100 + 1) / 41, 1 / 41]) and rows[1] == [0, 0] and rows[3] == [2, 0]


def test_service_log_in_many_blocks_equals_one_block(spark, tmp_path):
    lines = ["loose line before any entry"]
    for i in range(400):
        lines.append(f"2024-01-01 00:{i // 60:02d}:{i % 60:02d},{i % 1000:03d} - api - INFO - entry {i}")
        lines += [f"  trace {i} {j} " + "x" * (i % 50) for j in range(i % 7 if i != 200 else 90)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.log").write_text("2024-01-02 00:00:00,000 - api - WARN - alone\nmore\n")
    want, own = [], None
    for line in lines:
        own = line.rsplit(" - ", 1)[1] if " - api - " in line else own
        want.append((line, own))
    for size in (128 << 20, 512):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            log = S.read_service_log(spark, str(tmp_path / "*.log"))
            own = log.filter("NOT is_continuation").select("file", "entry_no", F.col("message").alias("m"))
            got = log.join(own, ["file", "entry_no"], "left").filter(F.col("file").endswith("a.log"))
            assert sorted((r["line"], str(r["m"])) for r in got.collect()) == sorted((x, str(m)) for x, m in want)
            entries = S.log_entries(log)
            text = {r["message"].split("\n")[0]: r["message"] for r in entries.collect()}
            assert entries.count() == 402 and text["alone"] == "alone\nmore" and len(text["entry 200"].split("\n")) == 91
            assert text["entry 13"].split("\n")[1:] == [x for x in lines if x.startswith("  trace 13 ")]
            if size == 512:
                assert spark.read.text(str(tmp_path / "a.log")).rdd.getNumPartitions() > 20
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
