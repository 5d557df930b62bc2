"""Steps that were mended for time and memory at size: what they must not do again, and that their rows stay."""

import re
import threading

import pytest
from pyspark.sql import functions as F

from kestrel.functions import folding, text as TX
from kestrel.operators import drift as D
from kestrel.operators import history as H


def _optimized(df) -> str:
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().optimizedPlan().toString())


def test_fits_of_a_search_overlap(spark, monkeypatch):
    from kestrel.operators import training as TR
    both = threading.Barrier(2, timeout=60)

    class Learner:
        def __init__(self, params):
            self.params = params

        def fit(self, train):
            both.wait()     # goes on only when another fit runs
            return self.params
    monkeypatch.setattr(TR, "_learner", lambda kind, params: Learner(params))
    monkeypatch.setattr(TR, "score", lambda model, val: model)
    monkeypatch.setattr(TR, "_f2_on", lambda model, threshold=0.5: {20: .2, 50: .7}[model["maxIter"]])
    params, f2, _ = TR.search(spark.range(1), spark.range(1), "gbt")
    assert f2 == .7 and params == {"maxIter": 50, "maxDepth": 2}   # ties go to the setting declared first


def test_folding_needs_few_passes_and_folds_every_character(spark):
    df = spark.createDataFrame([(c, f) for c, f in folding.fold_table().items()], "c string, want string")
    got = df.select("c", "want", TX.ascii_fold(F.concat(F.lit("<"), "c", F.lit("ß"), "c", F.lit(">"))).alias("got"))
    assert [r["c"] for r in got.collect() if r["got"] != f"<{r['want']}ss{r['want']}>"] == []
    assert _optimized(got).count("regexp_replace") <= 4
    odd = spark.createDataFrame([("a b c\x1c\x85 D\t0",), ("",), (None,)], "t string")
    assert [r["c"] for r in odd.select(TX.clean_text("t").alias("c")).collect()] == ["abcdo", "", ""]


def test_token_lookups_do_not_sort_occurrences(spark):
    texts = spark.createDataFrame([(1, "ref", "a a b"), (2, "ref", "b c"), (3, "cur", "A x")], "id long, side string, text string")
    lexicon = spark.createDataFrame([("a", 0.5), ("x", -1.25)], "word string, weight double")
    vocab = D.vocabulary(texts, "id", "text", 2)
    for df in (D.token_descriptors(texts, "id", "text", lexicon), D.oov_share(texts, "id", "text", vocab), D.lexicon_score(texts, "id", "text", lexicon)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and not re.search(r"hashpartitioning\(id#\d+L?, (side#\d+, )?token", plan)
    assert {r["id"]: r["oov_share"] for r in D.oov_share(texts, "id", "text", vocab).collect()} == {1: 0.0, 2: 0.5, 3: 0.5}


def test_a_word_counts_once_for_an_id_that_repeats(spark):
    rows = [(1, "kind word", 0), (1, "kind kind other", 0), (2, "bad", 1), (2, "bad", 1), (None, "word", 0), (None, "word", 0), (3, "word", 1), (3, "x", None)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    lexicon = D.lexicon_from_labels(df, "id", "text", "label", 1)
    assert {r["word"]: float(r["weight"]) for r in lexicon.collect()} == {
        "kind": .25, "other": .25, "bad": -.333333, "word": round(2 / 4 - 1 / 3, 6)}
    assert "hashpartitioning(id" in (plan := lexicon._jdf.queryExecution().executedPlan().toString()) and "__rows" in plan


def test_branches_of_drift_statistics_read_one_count_table(spark):
    long = spark.range(100).select(F.when(F.col("id") % 2 == 0, "ref").otherwise("cur").alias("side"), F.lit("x").alias("feature"),
                                   F.col("id").cast("double").alias("value"))
    lines = re.sub(r"_(common_expr|aggregateexpression)(_\d+)?", "X", _optimized(D.drift_statistics(long))).split("\n")
    below = set()
    for i, line in enumerate(lines):
        if "Aggregate [feature, value]" in line or "Aggregate [x, value]" in line:
            below.add(lines[i + 1].lstrip(" :+-") + "".join(x for x in lines[i + 1:i + 3] if "xxhash64" in x))
    assert len(below) <= 1 and "xxhash64" not in "".join(below)


@pytest.mark.parametrize("task_bytes", [64, 1 << 20])
def test_history_is_dealt_by_size(spark, monkeypatch, task_bytes):
    rows = [(i, i % 5 or None, i % 3, f"2024-01-{1 + i % 9:02d} 0{i % 7}:00:00", i % 2) for i in range(60)]
    m = spark.createDataFrame(rows, "msg_id long, user_id long, channel_id long, t string, label int").select(
        "msg_id", "user_id", "channel_id", F.col("t").cast("timestamp_ntz").alias("ts"), "label").coalesce(1)
    want = sorted(map(str, H.user_channel_features(m).collect()))
    monkeypatch.setattr(H, "TASK_BYTES", task_bytes)
    monkeypatch.setattr(H, "_tasks_for", lambda df: 9) if task_bytes == 64 else None
    df = H.user_channel_features(m)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert ("REPARTITION_BY_NUM" in plan) == (task_bytes == 64)
    assert sorted(map(str, df.collect())) == want


def test_tasks_follow_the_size_of_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(200_000).write.parquet(path)
    assert H._tasks_for(spark.read.parquet(path)) is None                      # the session's own number is enough
    monkeypatch.setattr(H, "TASK_BYTES", 1 << 12)
    found = H._tasks_for(spark.read.parquet(path))
    assert found and found > int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(H, "MOST_TASKS", 7)
    assert H._tasks_for(spark.read.parquet(path)) == 7


def test_tasks_are_not_merged_when_the_session_has_more(spark, tmp_path, monkeypatch):
    """With more partitions in the session than the size asks for, adaptive execution merged them to one a core."""
    path = str(tmp_path / "m")
    spark.range(40_000, numPartitions=1).select(F.col("id").alias("msg_id"), (F.col("id") % 97).alias("user_id"), (F.col("id") % 7).alias("channel_id"),
                                                F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), F.lit(1).alias("label")).write.parquet(path)
    m = spark.read.parquet(path)
    want = sorted(map(str, H.user_channel_features(m).collect()))
    size = int(m._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    monkeypatch.setattr(H, "TASK_BYTES", size // 30)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = H.user_channel_features(m)
        assert 30 <= H._tasks_for(m) <= 31 and df.rdd.getNumPartitions() == H._tasks_for(m)
        assert sorted(map(str, df.collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_small_frames_take_few_tasks(spark, monkeypatch):
    from kestrel.operators import training as TR
    kept = spark.range(0, 100, 1, 4)
    assert TR.in_few_tasks(kept).rdd.getNumPartitions() == 1
    monkeypatch.setattr(TR, "ROWS_TO_A_TASK", 40)
    assert TR.in_few_tasks(kept).rdd.getNumPartitions() == 3 and TR.in_few_tasks(kept.limit(0)).count() == 0
