"""Value ranges, prefix sums, percentiles by selection and what is built on them, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from kestrel.operators import drift as D
from kestrel.operators import ingest as I
from kestrel.operators import ml as ML
from kestrel.operators import ordered as O
from kestrel.plans import load_all

SPLITS = [(1 << 16, 4096), (20, 4096), (3, 16)]


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.lognormal(0, 2, 3000), rng.integers(0, 20, 2000), [1e300, -1e300, -0.0, 0.0]])
    pdf = pd.DataFrame({"feature": np.where(rng.random(len(x)) < .5, "a", "b"), "value": x})
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("range_rows, most", SPLITS)
def test_running_sums_and_percentiles(values, range_rows, most):
    pdf, df = values
    how = {"range_rows": range_rows, "most": most}
    g = df.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    probs = [0.0, 0.01, 0.5, 0.987, 1.0]
    got = O.percentiles(g, ["feature"], "value", "n", probs, **how).toPandas()
    sums = O.running_sums(g, ["feature"], "value", {"c": "n"}, **how).toPandas()
    for f in "ab":
        mine = got[got.feature == f].sort_values("p").percentile
        assert np.allclose(mine, np.quantile(pdf[pdf.feature == f].value, probs), rtol=1e-13)
        s = sums[sums.feature == f].sort_values("value")
        assert (s.c == s.n.cumsum()).all()
    whole = df.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    down = O.running_sums(whole, [], "value", {"c": "n"}, inclusive=False, descending=True, **how).toPandas().sort_values("value", ascending=False)
    assert (down.c.fillna(0) == down.n.cumsum() - down.n).all()
    ranges = O.with_ranges(whole, [], "value", ["n"], **how).groupBy(O.RANGE).count().toPandas()
    assert len(ranges) <= most and (range_rows > 1000 or len(ranges) > 10)
    assert range_rows != 20 or ranges["count"].max() < 300          # ranges stay short however the values lie


def test_ranges_do_not_depend_on_partitions(values):
    _, df = values
    g = df.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    a, b = (O.with_ranges(x, ["feature"], "value", ["n"], range_rows=10).sort("feature", "value").toPandas() for x in (g, g.repartition(7)))
    assert a.equals(b)


def test_percentile_of_a_million_distinct_values(spark):
    n = 1_000_000
    df = spark.range(n).select((F.pmod(F.col("id") * 7919, F.lit(n)) / 8.0).alias("value"))
    g = df.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    got = O.percentiles(g, [], "value", "n", [0.25, 0.99], range_rows=4096).toPandas().sort_values("p")
    assert np.allclose(got.percentile, np.quantile(np.arange(n) / 8, [0.25, 0.99]), rtol=1e-13)


def test_empty_groups(spark):
    g = spark.createDataFrame([], "feature string, value double, n long")
    assert O.percentiles(g, ["feature"], "value", "n", [0.5]).count() == 0
    assert O.running_sums(g, [], "value", {"c": "n"}).count() == 0
    one = spark.createDataFrame([("a", 2.0, 5)], "feature string, value double, n long")
    assert O.percentiles(one, ["feature"], "value", "n", [0.5]).first()["percentile"] == 2.0


@pytest.mark.parametrize("range_rows", [1 << 16, 5])
def test_scores_in_ranges(spark, range_rows):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 400), rng.integers(0, 150, 400) / 150
    df = spark.createDataFrame(pd.DataFrame({"label": y, "score": s}))
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    assert ML.roc_auc(df, range_rows=range_rows).first()["roc_auc"] == pytest.approx(auc)
    ap = sum((y[s == v] == 1).sum() / y.sum() * (y[s >= v] == 1).mean() for v in np.unique(s))
    assert ML.average_precision(df, range_rows=range_rows).first()["avg_precision"] == pytest.approx(ap)


def test_psi_bins_are_honoured(spark):
    rng = np.random.default_rng(5)
    ref, cur = rng.normal(0, 1, 500), rng.normal(.4, 1, 400)
    long = D.unpivot(*(spark.createDataFrame([(float(x),) for x in v], "x double") for v in (ref, cur)), ["x"])
    for bins in (5, 10, 20):
        edges = np.histogram(ref, bins=bins)[1]
        r, c = (np.histogram(v, bins=edges)[0] / len(v) + 1e-10 for v in (ref, cur))
        want = pytest.approx(float(np.sum((c - r) * np.log(c / r))), rel=1e-9)
        assert D.psi(long, bins=bins).first()["psi"] == want
        assert D.drift_statistics(long, bins=bins).first()["psi"] == want


def test_data_quality_and_missing_values(spark):
    rows = [(float(i % 7) if i % 5 else None, "t" if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, t string")
    q = {r["side"]: r for r in D.data_quality(D.unpivot(df, df.limit(0), ["x"], keep_nulls=True)).collect()}
    x = np.array([r[0] for r in rows if r[0] is not None])
    assert list(q) == ["ref"] and (q["ref"]["n"], q["ref"]["missing"], q["ref"]["distinct_values"]) == (48, 12, 7)
    assert np.allclose([q["ref"][c] for c in ("q25_value", "median_value", "q75_value", "mean_value", "std_value")],
                       [*np.quantile(x, [.25, .5, .75]), x.mean(), x.std()])
    m = {(r["side"], r["column"]): (r["missing"], r["missing_share"]) for r in D.missing_values(df, df.limit(0), ["x", "t"]).collect()}
    assert m == {("ref", "x"): (12, .2), ("ref", "t"): (20, 1 / 3), ("cur", "x"): (0, None), ("cur", "t"): (0, None)}


def test_quality_report_of_an_empty_batch_and_nulls(spark):
    df = spark.createDataFrame([(1, None, 2.0), (0, None, 3.0)], "label int, empty string, msg_len double")
    rep = {(r["check"], r["column"]): (r["value"], r["failed"]) for r in I.quality_report(df, "label", ("msg_len",)).collect()}
    assert rep[("column_null_ratio", "empty")] == (1.0, True) and rep[("null_ratio_mean", None)] == (pytest.approx(1 / 3), True)
    assert rep[("q99", "msg_len")] == (pytest.approx(2.99), False) and rep[("outlier_share", "msg_len")] == (.5, True)
    empty = I.quality_report(df.limit(0), "label", ("msg_len",)).collect()
    assert len(empty) == len(rep) and not any(r["failed"] for r in empty)


def test_token_descriptors(spark):
    texts = spark.createDataFrame([(1, "ref", "a a b"), (2, "ref", "b c"), (3, "cur", "A x"), (4, "cur", None)], "id long, side string, text string")
    lexicon = spark.createDataFrame([("a", 0.5), ("x", -1.25)], "word string, weight double")
    got = {r["id"]: (r["oov_share"], r["lexicon_score"]) for r in D.token_descriptors(texts, "id", "text", lexicon).collect()}
    assert got == {1: (0.0, 1.0), 2: (0.5, 0.0), 3: (0.5, -0.75), 4: (0.0, 0.0)}
    labelled = spark.createDataFrame([(1, "kind word", 0), (2, "bad word", 1), (3, "bad", 1), (4, "word", None)], "id long, text string, label int")
    assert {r["word"]: float(r["weight"]) for r in D.lexicon_from_labels(labelled, "id", "text", "label", 2).collect()} == {"word": .5, "bad": -1.0}


def test_drift_runs_history_and_repeated_append(spark, tmp_path):
    ref = spark.createDataFrame([(float(i % 50), float(i % 3), i % 2) for i in range(600)], "x double, y double, label int")
    same, moved = ref, ref.withColumn("x", F.col("x") + 60).withColumn("y", F.col("y") * 9)
    rows = ref.withColumns({"side": F.lit("ref"), "runs": F.array(F.lit("r1"), F.lit("r2"), F.lit("r3"))})
    for df, own in ((same, ["r1"]), (moved, ["r2", "r3"])):
        rows = rows.unionByName(df.withColumns({"side": F.lit("cur"), "runs": F.array(*map(F.lit, own))}))
    runs = D.drift_runs(rows, ["x", "y"])
    path = str(tmp_path / "runs")
    for _ in range(2):                                                # a run that is appended again replaces itself
        D.append_runs(runs.filter("run <> 'r3'"), path)
    D.append_runs(runs.filter("run = 'r3'"), path)
    kept = spark.read.parquet(path)
    assert kept.count() == 3
    h = {r["run"]: r for r in D.drift_history(kept.withColumn("run_time", F.col("run"))).collect()}
    one = D.feature_drift(ref, moved, ["x", "y"]).agg(F.max("psi").alias("p"), F.max("ks_statistic").alias("k")).first()
    assert h["r2"]["max_psi"] == pytest.approx(one["p"]) and h["r2"]["max_ks"] == pytest.approx(one["k"])
    assert [h[r]["drift_share"] for r in ("r1", "r2", "r3")] == [0.0, 1.0, 1.0]
    assert [h[r]["change"] for r in ("r1", "r2", "r3")] == [None, 1.0, 0.0] and [h[r]["drift_streak"] for r in ("r1", "r2", "r3")] == [0, 1, 2]
    assert h["r3"]["trend"] == pytest.approx(np.polyfit([1, 2, 3], [0, 1, 1], 1)[0]) and h["r2"]["drifted_features"] == ["x", "y"]


def test_plans_use_no_percentile_buffer(spark):
    reg = load_all()
    for name in ("a8_quality_report", "d11_data_quality", "d1_ks", "d12_dataset_drift", "m11_roc_auc"):
        plan = reg[name].build(spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert "percentile(" not in plan and "percentile_approx" not in plan, name
