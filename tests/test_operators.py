"""Hand-made fixtures for the quirks and brute-force checks of the operators."""

import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.functions import lexicons as lx
from kestrel.functions import text as T
from kestrel.operators import drift as D
from kestrel.operators import history as H
from kestrel.operators import ingest as I
from kestrel.operators import ml as ML
from kestrel.operators import moderation as M
from kestrel.operators import serving as S

T0 = dt.datetime(2024, 1, 1)


def _msgs(spark, rows):
    return spark.createDataFrame(rows, "msg_id long, user_id long, channel_id long, ts timestamp_ntz, label int")


# --- text features against a plain-Python definition ------------------------------------------

def py_features(text):
    text = "" if text is None else str(text)
    if not text:
        return dict(msg_len=0, word_count=0, caps_ratio=0.0, exclamation_count=0, question_count=0,
                    ellipsis_count=0, personal_pronoun_count=0, char_repetition=0, all_caps_words=0, slur_count=0)
    low = text.lower()
    return dict(msg_len=len(text), word_count=len(text.split()),
                caps_ratio=sum(c.isupper() for c in text) / len(text),
                exclamation_count=text.count("!"), question_count=text.count("?"), ellipsis_count=text.count("..."),
                personal_pronoun_count=sum(w in lx.PERSONAL_PRONOUNS for w in low.split()),
                char_repetition=len(re.findall(r"(.)\1{2,}", low)),
                all_caps_words=sum(w.isupper() and len(w) > 1 for w in text.split()),
                slur_count=sum(w in low for w in lx.BAD_WORDS))


EDGE_TEXTS = [None, "", "   ", "...", "......", "nooo way!!", "YOU are SO dumb... u r", "Émile ÉCOLE À l'été",
              "tab\tsep\nnew nbsp", "😀😀😀 hi", "I HATE THIS", "a\n\n\nb", "ur you're your yours",
              "KILLER killer ki ll", "x" * 20 + " AB CD e"]


def test_text_features_match_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGE_TEXTS)], "id int, text string")
    got = {r["id"]: r.asDict() for r in T.text_features(df, "text").collect()}
    for i, t in enumerate(EDGE_TEXTS):
        exp = py_features(t)
        for k, v in exp.items():
            assert got[i][k] == pytest.approx(v), (t, k, got[i][k], v)


def test_clean_and_hard_terms(spark):
    df = spark.createDataFrame([("r e t @ r d",), ("Rétard",), ("hello",), (None,)], "text string")
    out = df.select(T.clean_text("text").alias("c"), T.has_hard_term("text").alias("h")).collect()
    assert out[0]["c"] == "retard" and out[0]["h"]
    assert out[1]["c"] == "retard" and out[1]["h"]
    assert not out[2]["h"] and out[3]["c"] == ""


def test_alt_features_token_level(spark):
    df = spark.createDataFrame([("You are TRASHY garbage, destroyer!! 😀",)], "text string")
    r = df.select(*[c.alias(n) for n, c in T.alt_feature_columns("text").items()]).first()
    assert r["slur_count"] == 2 and r["threat_count"] == 1 and r["emoji_count"] == 1
    assert r["personal_pronoun_count"] == 1 and r["all_caps_words"] == 1


# --- windows ---------------------------------------------------------------------------------

def brute_window(rows, width):
    out = {}
    for mid, uid, _, ts, _ in rows:
        inside = [r for r in rows if r[1] == uid and ts - width <= r[3] < ts]
        out[mid] = (len(inside), sum(r[4] for r in inside))
    return out


def test_ties_and_window_ends(spark):
    # Three messages at the same instant and one exactly 7 days later (Q1).
    rows = [(1, 1, 0, T0, 1), (2, 1, 0, T0, 0), (3, 1, 0, T0, 1), (4, 1, 0, T0 + dt.timedelta(days=7), 0),
            (5, 1, 0, T0 + dt.timedelta(days=7, microseconds=1), 0)]
    df = _msgs(spark, rows)
    out = H.trailing_counts(df, "user_id", "ts", 7 * H.US_PER_DAY, {"bad": F.col("label")}, "cnt",
                            bucket_us=H.US_PER_DAY)
    got = {r["msg_id"]: (r["cnt"], r["bad"]) for r in out.collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (3, 2), 5: (1, 0)}


def test_trailing_counts_random(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        user = rng.choice([1, 1, 1, 1, 2, 3])  # user 1 is hot
        ts = T0 + dt.timedelta(hours=rng.randint(0, 24 * 20))  # many ties on the hour
        rows.append((i, user, 0, ts, rng.randint(0, 1)))
    df = _msgs(spark, rows)
    exp = brute_window(rows, dt.timedelta(days=7))
    for bucket in (6 * H.US_PER_HOUR, 30 * H.US_PER_DAY):
        out = H.trailing_counts(df, "user_id", "ts", 7 * H.US_PER_DAY, {"bad": F.col("label")}, "cnt",
                                bucket_us=bucket)
        got = {r["msg_id"]: (r["cnt"], r["bad"]) for r in out.collect()}
        assert got == exp, bucket


def test_history_null_keys_repeated_ids_and_a_busy_key(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):  # nine rows in ten are one user's; some users are null; ids repeat
        user = 1 if rng.random() < 0.9 else rng.choice([None, 2])
        rows.append((i // 2, user, rng.choice([0, None]), T0 + dt.timedelta(hours=rng.randint(0, 24 * 50), seconds=i),
                     rng.randint(0, 1)))
    rows.append((999, 1, 0, None, 1))  # a row without a time has no history and adds to none
    df = _msgs(spark, rows)

    def trailing(col, row, days):
        back = [r for r in rows if r[3] and row[3] and r[col] == row[col]
                and row[3] - dt.timedelta(days=days) <= r[3] < row[3]]
        return len(back), sum(r[4] for r in back)

    def earlier(row, *cols):
        return [r for r in rows if r[3] and all(r[c] == row[c] for c in cols) and r[3] < row[3]]
    got = sorted((tuple(r) for r in H.user_channel_features(df).select(
        "ts", "msg_id", "user_7d_msg_count", "user_7d_bad_count", "user_30d_msg_count", "user_30d_bad_count",
        "channel_24h_msg_count", "channel_24h_bad_count", "user_channel_msg_count", "hours_since_last_msg")
        .collect() if r["ts"]), key=lambda r: r[0])
    exp = []
    for r in (r for r in rows if r[3]):
        prev = [x[3] for x in earlier(r, 1)]
        gap = (r[3] - max(prev)) / dt.timedelta(hours=1) if prev else 24.0
        # the row without a time sorts first, so it is counted in the running number of (1, 0)
        number = len(earlier(r, 1, 2)) + 1 + (r[1] == 1 and r[2] == 0)
        exp.append((r[3], r[0], *trailing(1, r, 7), *trailing(1, r, 30), *trailing(2, r, 1), number, gap))
    exp.sort(key=lambda r: r[0])
    assert [g[:-1] for g in got] == [e[:-1] for e in exp]
    assert [g[-1] for g in got] == pytest.approx([e[-1] for e in exp])
    out = H.trailing_counts(df, "user_id", "ts", H.US_PER_DAY, {}, "cnt")
    assert out.count() == len(rows) and out.filter("ts IS NULL").first()["cnt"] == 0
    stats = {r["user_id"]: r["user_msg_count"] for r in H.group_stats_onto_rows(df, "user_id").collect()}
    assert stats == {u: sum(r[1] == u for r in rows) for u in (1, 2, None)}


def test_trend_zero_when_7d_empty(spark):
    # Q2: 30-day history but an empty 7-day window → trend 0, gap default 24 for the first message.
    rows = [(1, 1, 0, T0, 1), (2, 1, 0, T0 + dt.timedelta(days=10), 0)]
    out = {r["msg_id"]: r for r in H.user_channel_features(_msgs(spark, rows)).collect()}
    assert out[2]["user_7d_msg_count"] == 0 and out[2]["user_30d_msg_count"] == 1
    assert out[2]["user_toxicity_trend"] == 0.0 and out[2]["user_bad_ratio_30d"] == 1.0
    assert out[1]["hours_since_last_msg"] == 24.0 and out[2]["hours_since_last_msg"] == 240.0


def test_first_per_key_skew_safe(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (1, 9, "c"), (2, 1, "d")], "k int, t int, v string")
    got = {r["k"]: r["v"] for r in H.first_per_key(df, "k", [(F.col("t"), False)]).collect()}
    assert got == {1: "c", 2: "d"}


# --- strikes ---------------------------------------------------------------------------------

def fold(rows):
    """Sequential reference: rows = [(id, hard, toxic, p, reset)] in time order for one user."""
    count, out = 0, {}
    for mid, hard, toxic, p, reset in rows:
        if reset:
            count = 0
            continue
        sev = expected_severity(hard, toxic, p, count)
        prior = count
        if sev in ("MEDIUM", "HIGH"):
            count += 1
        out[mid] = (prior, sev)
    return out


# Expected severity by confidence: below two strikes, from two strikes on.
EXPECTED = {.46: ("UNCERTAIN", "UNCERTAIN"), .5: ("UNCERTAIN", "UNCERTAIN"), .55: ("UNCERTAIN", "UNCERTAIN"),
            .58: ("LOW", "LOW"), .62: ("LOW", "MEDIUM"), .65: ("LOW", "MEDIUM"), .72: ("LOW", "HIGH"),
            .8: ("MEDIUM", "HIGH"), .91: ("HIGH", "HIGH"), .95: ("HIGH", "HIGH")}


def expected_severity(hard, toxic, p, prior):
    return "HIGH" if hard else EXPECTED[p][prior >= 2] if toxic else "SAFE"


def test_strike_closed_form_equals_fold(spark):
    rng = random.Random(3)
    rows, exp = [], {}
    for user in range(30):
        seq = []
        for j in range(rng.randint(1, 25)):
            mid = user * 100 + j
            reset = rng.random() < 0.05
            seq.append((mid, rng.random() < 0.05, rng.random() < 0.6, rng.choice([.46, .5, .55, .58, .62, .65, .72, .8, .91, .95]), reset))
        exp.update(fold(seq))
        for k, (mid, hard, toxic, p, reset) in enumerate(seq):
            rows.append((mid, user, T0 + dt.timedelta(minutes=k), hard, toxic, p, reset))
    df = spark.createDataFrame(rows, "msg_id long, user_id long, ts timestamp_ntz, hard_term boolean, "
                                     "is_toxic boolean, confidence double, is_reset boolean")
    for bucket in (3 * 60_000_000, 24 * 3_600_000_000):
        out = M.strike_history(df, reset="is_reset", bucket_us=bucket)
        got = {r["msg_id"]: (r["prior_violations"], r["severity"]) for r in out.collect()}
        assert got == exp, bucket


def test_severity_borders(spark):
    df = spark.createDataFrame([(.45,), (.55,), (.60,), (.61,), (.71,)], "p double")
    sev = [r[0] for r in df.select(M.severity(F.lit(False), F.lit(True), F.col("p"), F.lit(2))).collect()]
    assert sev == ["UNCERTAIN", "UNCERTAIN", "LOW", "MEDIUM", "HIGH"]
    folded = df.select(M.fold_confidence(F.col("p")).alias("f")).collect()
    assert all(r["f"] >= 0.5 for r in folded)


# --- drift -----------------------------------------------------------------------------------

def test_psi_and_ks_against_numpy(spark):
    rng = np.random.default_rng(1)
    ref = rng.normal(0, 1, 300)
    cur = np.concatenate([rng.normal(0.5, 1.2, 250), [10.0, -10.0]])  # two values outside the range
    r = spark.createDataFrame([(float(x),) for x in ref], "x double")
    c = spark.createDataFrame([(float(x),) for x in cur], "x double")
    long = D.unpivot(r, c, ["x"])
    edges = np.histogram(ref, bins=10)[1]
    rd = np.histogram(ref, bins=edges)[0] / len(ref) + 1e-10
    cd = np.histogram(cur, bins=edges)[0] / len(cur) + 1e-10
    assert D.psi(long).first()["psi"] == pytest.approx(float(np.sum((cd - rd) * np.log(cd / rd))), rel=1e-9)
    allv = np.sort(np.concatenate([ref, cur]))
    ks = np.max(np.abs(np.searchsorted(np.sort(ref), allv, "right") / len(ref)
                       - np.searchsorted(np.sort(cur), allv, "right") / len(cur)))
    assert D.ks_statistic(long).first()["ks_statistic"] == pytest.approx(ks)
    assert D.ks_statistic(long, range_rows=16).first()["ks_statistic"] == pytest.approx(ks)
    same = D.unpivot(r, r, ["x"])
    assert D.psi(same).first()["psi"] == pytest.approx(0.0, abs=1e-12)


def test_constant_reference_psi(spark):
    r = spark.createDataFrame([(3.0,)] * 10, "x double")
    c = spark.createDataFrame([(3.0,)] * 5 + [(3.2,)] * 5, "x double")
    rd = np.histogram([3.0] * 10, bins=10)[0] / 10 + 1e-10
    cd = np.histogram([3.0] * 5 + [3.2] * 5, bins=np.histogram([3.0] * 10, bins=10)[1])[0] / 10 + 1e-10
    assert D.psi(D.unpivot(r, c, ["x"])).first()["psi"] == pytest.approx(float(np.sum((cd - rd) * np.log(cd / rd))))


def test_label_shift_missing_class(spark):
    r = spark.createDataFrame([(0,), (0,), (1,)], "label int")
    c = spark.createDataFrame([(0,), (2,)], "label int")
    assert D.label_shift(r, c).first()["label_shift"] == pytest.approx(abs(0.5 - 2 / 3))
    assert D.label_shift(r, c, missing_as_zero=True).first()["label_shift"] == pytest.approx(0.5)


# --- ML --------------------------------------------------------------------------------------

def test_threshold_sweep_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), rng.choice([round(rng.random(), 2), 0.21, 0.5, 0.89, 0.1])) for _ in range(500)]
    df = spark.createDataFrame(rows, "label int, score double")
    sw = {round(r["threshold"], 2): r for r in ML.threshold_sweep(df).collect()}
    assert len(sw) == 80
    for k in range(10, 90):
        t = k / 100
        tp = sum(1 for y, p in rows if p >= t and y == 1)
        fp = sum(1 for y, p in rows if p >= t and y != 1)
        fn = sum(1 for y, p in rows if p < t and y == 1)
        f2 = 5 * tp / (5 * tp + 4 * fn + fp) if tp + fn + fp else 0.0
        assert sw[t]["tp"] == tp and sw[t]["fp"] == fp and sw[t]["f_beta"] == pytest.approx(f2)


def test_auc_ap(spark):
    rows = [(1, .9), (0, .8), (1, .8), (0, .3), (1, .3), (0, .1)]
    df = spark.createDataFrame(rows, "label int, score double")
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert ML.roc_auc(df).first()["roc_auc"] == pytest.approx(auc)
    # AP steps at .9 (P=1,R=1/3), .8 (P=2/3,R=2/3), .3 (P=3/5,R=1)
    ap = 1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5
    assert ML.average_precision(df).first()["avg_precision"] == pytest.approx(ap)
    for b in (2, 4):
        assert ML.roc_auc(df, range_rows=b).first()["roc_auc"] == pytest.approx(auc)
        assert ML.average_precision(df, range_rows=b).first()["avg_precision"] == pytest.approx(ap)


def test_split_proportions(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    out = ML.stratified_split(df, "label", "id").groupBy("label", "split").count().collect()
    got = {(r["label"], r["split"]): r["count"] for r in out}
    assert got[(1, "train")] == 140 and got[(1, "val")] == 30 and got[(1, "test")] == 30
    assert got[(0, "train")] == 560 and got[(0, "val")] == 120 and got[(0, "test")] == 120


def test_promotion_rule(spark):
    # Registered history: v2 tied v1 and was archived, v3 promoted.
    df = spark.createDataFrame([(1, 0.90487), (2, 0.90487), (3, 0.90681)], "version int, f2 double")
    got = {r["version"]: r["stage"] for r in ML.promotion(df).collect()}
    assert got == {1: "Archived", 2: "Archived", 3: "Production"}


# --- ingestion and serving -------------------------------------------------------------------

def test_label_resolution_modes(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", None, 0), ("c", -1, None)],
                               "text string, verified_label int, prediction int")
    ds = I.resolve_labels(df, "dataset").collect()
    assert sorted(r["text"] for r in ds) == ["a", "c"]  # Q4: prediction-only row dropped, −1 kept (Q5)
    pr = {r["text"]: r["label_source"] for r in I.resolve_labels(df, "per_row").collect()}
    assert pr == {"a": "human", "b": "model", "c": "human"}


def test_merge_dedupe_idempotent(spark):
    master = spark.createDataFrame([("h1", 1, "old"), ("h2", 2, "keep")], "text_hash string, id int, v string")
    new = spark.createDataFrame([("h1", 3, "new"), ("h3", 4, "add")], "text_hash string, id int, v string")
    once = I.merge_dedupe(master, new, "text_hash", [(F.col("id"), False)])
    twice = I.merge_dedupe(once, new, "text_hash", [(F.col("id"), False)])
    a = sorted(map(tuple, once.collect()))
    assert a == sorted(map(tuple, twice.collect()))
    assert dict((r[0], r[2]) for r in a) == {"h1": "new", "h2": "keep", "h3": "add"}


def test_null_hash_not_collapsed(spark):
    df = spark.createDataFrame([("x", None), ("y", None)], "text string, text_hash string")
    assert I.ensure_hash(df).select("text_hash").distinct().count() == 2


def test_enrich_defaults(spark):
    store = spark.createDataFrame([("user_toxicity", "prod", 1, 0.5, 0.4, 0.1, 2.0, 0)],
                                  "feature_group string, version string, entity_id long, user_bad_ratio_7d double, "
                                  "user_bad_ratio_30d double, user_toxicity_trend double, hours_since_last_msg double, "
                                  "is_new_to_channel int")
    req = spark.createDataFrame([(1,), (2,)], "user_id long")
    got = {r["user_id"]: r for r in S.enrich(req, store, "user_toxicity", "prod", "user_id").collect()}
    assert got[1]["user_bad_ratio_7d"] == 0.5 and got[1]["is_new_to_channel"] == 0
    assert got[2]["hours_since_last_msg"] == 24.0 and got[2]["is_new_to_channel"] == 1


def test_quality_report_flags(spark):
    df = spark.createDataFrame([(i % 20 == 0 and 1 or 0, 5, float(i)) for i in range(100)],
                               "label int, const int, msg_len double")
    rep = {(r["check"], r["column"]): r["failed"] for r in I.quality_report(df, "label", ("msg_len",)).collect()}
    assert rep[("value_range", "const")] and rep[("minority_ratio", "label")]
    assert not rep[("outlier_share", "msg_len")]


def test_oov_and_lexicon(spark):
    ref = spark.createDataFrame([(1, "the cat sat"), (2, "the cat ran")], "id int, text string")
    cur = spark.createDataFrame([(3, "The dog sat the")], "id int, text string")
    vocab = D.vocabulary(ref, "id", "text", 2)
    assert sorted(r[0] for r in vocab.collect()) == ["cat", "the"]
    assert D.oov_share(cur, "id", "text", vocab).first()["oov_share"] == pytest.approx(0.5)
    lex = spark.createDataFrame([("the", 0.5), ("dog", -1.0)], "word string, weight double")
    assert D.lexicon_score(cur, "id", "text", lex).first()["lexicon_score"] == pytest.approx(0.0)


def test_bot_and_dm_filter(spark):
    df = spark.createDataFrame([(1, False, 10), (2, True, 10), (3, False, None)], "id int, author_is_bot boolean, guild_id long")
    assert [r["id"] for r in M.human_guild_messages(df).collect()] == [1]


def test_training_pipeline_scores(spark):
    from kestrel.plans.ml import m7_train_score
    out = m7_train_score(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert rows and all(r["confidence"] >= 0.5 for r in rows)


def test_asof_strict_ties_and_buckets(spark):
    left = spark.createDataFrame([(1, 1, T0), (2, 1, T0 + dt.timedelta(minutes=5)), (3, 1, T0 + dt.timedelta(days=3)),
                                  (4, 2, T0)], "id int, k int, ts timestamp_ntz")
    right = spark.createDataFrame([(1, T0, "a"), (1, T0 + dt.timedelta(minutes=1), "b"), (1, T0 + dt.timedelta(days=2), None)],
                                  "k int, ts timestamp_ntz, v string")
    for bucket in (60_000_000, 24 * 3_600_000_000):
        out = S.asof_join(left, right, "k", "ts", "ts", ["v"], bucket_us=bucket)
        got = {r["id"]: r["v"] for r in out.collect()}
        # id 1 ties with "a" (strict → nothing); id 3 sees the newer right row whose v is null.
        assert got == {1: None, 2: "b", 3: None, 4: None}, bucket


def test_embeddings_and_cache(spark):
    import tempfile
    from kestrel.operators import embedding as EM
    df = spark.createDataFrame([(1, "Hello world"), (2, "hello   WORLD"), (3, None), (4, "other words")],
                               "id int, text string")
    h = {r["id"]: r["embedding"] for r in EM.embed_hashing(df, "text", 16).collect()}
    assert h[1] == h[2] and len(h[1]) == 16 and abs(sum(x * x for x in h[1]) - 1) < 1e-5
    assert sum(h[3]) == 0

    def loader():
        def encode(texts):
            return np.array([[len(t), t.count("o")] for t in texts], dtype=float)
        return encode
    m = {r["id"]: r["embedding"] for r in EM.embed_with_model(df, "text", loader, dim=2, batch_size=3).collect()}
    assert m[4] == [11.0, 2.0] and m[3] == [0.0, 0.0]
    path = tempfile.mkdtemp(prefix="kestrel-emb-") + "/cache"

    def emb(x):
        return EM.embed_with_model(x, "text", loader, dim=2)
    first = EM.cached_embeddings(spark, df, path, "toy-v1", emb)
    assert first.count() == 4
    n_cache = spark.read.parquet(path).count()
    second = EM.cached_embeddings(spark, df, path, "toy-v1", emb)
    assert spark.read.parquet(path).count() == n_cache  # nothing re-embedded
    assert sorted(map(str, first.orderBy("id").collect())) == sorted(map(str, second.orderBy("id").collect()))


def test_chi2_survival_against_tables(spark):
    # Tabulated χ² critical values at 5 % and 1 %, and exact closed forms for dof 2.
    rows = [(3.841459, 1.0, 0.05), (5.991465, 2.0, 0.05), (11.070498, 5.0, 0.05), (18.307038, 10.0, 0.05),
            (6.634897, 1.0, 0.01), (43.772972, 30.0, 0.05), (0.5, 2.0, math.exp(-0.25)), (40.0, 2.0, math.exp(-20))]
    df = spark.createDataFrame(rows, "x double, k double, p double")
    for r in df.select("p", D.chi2_sf(F.col("x"), F.col("k")).alias("q")).collect():
        assert r["q"] == pytest.approx(r["p"], rel=1e-5)
    lg = spark.range(1).select(D.lgamma(F.lit(5.0)).alias("a"), D.lgamma(F.lit(0.5)).alias("b")).first()
    assert lg["a"] == pytest.approx(math.log(24)) and lg["b"] == pytest.approx(math.log(math.sqrt(math.pi)))


def test_tournament_leaderboard(spark):
    from kestrel.plans.ml import m15_tournament
    board = m15_tournament(spark, "/root/testdata/sf0.001").collect()
    assert [r["rank"] for r in sorted(board, key=lambda r: r["rank"])] == [1, 2, 3]
    ok = [r for r in board if r["error"] is None]
    assert ok and all(0.0 <= r["test_f2"] <= 1.0 for r in ok)


def test_search_fits_every_declared_setting(spark, monkeypatch):
    from kestrel.operators import training as TR
    from pyspark.ml.functions import array_to_vector
    rows = [(i, [float(i % 7), float(i % 5), float(i % 3)], i % 2) for i in range(60)]
    df = TR.with_class_weights(spark.createDataFrame(rows, "vec_id long, v array<double>, label int")
                               .select("vec_id", array_to_vector("v").alias("vec"), "label"))
    train, val = TR.reduced_once(df, df, k=2)
    assert train.storageLevel.useMemory and val.storageLevel.useMemory
    fitted, marks = [], iter([0.1, 0.2, 0.3, 0.4, 0.3, 0.2, 0.1, 0.9])
    learner = TR._learner
    monkeypatch.setattr(TR, "_learner", lambda kind, params: fitted.append(params) or learner(kind, params))
    monkeypatch.setattr(TR, "_f2_on", lambda scored, threshold=0.5: next(marks))
    params, f2, _ = TR.search(train, val, "logistic")
    space = TR.SEARCH_SPACE["logistic"]
    assert len(fitted) == 8 and {tuple(p.values()) for p in fitted} == {(a, b) for a in space["regParam"] for b in space["elasticNetParam"]}
    assert f2 == 0.9 and params == fitted[-1]


def test_chi2_survival_at_many_degrees_of_freedom(spark):
    # References: the series of P(s, x) in 60-digit decimals.
    rows = [
        (20000.0, 20000.0, 0.4986701916600448),
        (20400.0, 20000.0, 0.023287322133598805),
        (19700.0, 20000.0, 0.93373876636026),
        (200000.0, 200000.0, 0.4995794778896348),
        (200500.0, 200000.0, 0.2144820796553828),
        (201500.0, 200000.0, 0.008969901996309764),
        (199000.0, 200000.0, 0.9432581767872077),
        (203000.0, 200000.0, 1.173684513722169e-06),
        (101.0, 99.0, 0.4252386445229945),
        (2000000.0, 2000000.0, 0.4998670192391274),
        (2003000.0, 2000000.0, 0.06686110423589776),
    ]
    df = spark.createDataFrame(rows, "x double, k double, p double")
    for r in df.select("x", "k", "p", D.chi2_sf(F.col("x"), F.col("k")).alias("q")).collect():
        assert r["q"] == pytest.approx(r["p"], rel=1e-7), r


def test_degenerate_inputs_do_not_raise(spark):
    # All-negative labels (M9–M12) and an empty current side (drift) under ANSI division rules.
    neg = spark.createDataFrame([(0, .2), (0, .7)], "label int, score double")
    assert ML.roc_auc(neg).first()["roc_auc"] is None
    assert ML.average_precision(neg).first()["avg_precision"] is None
    m = ML.classification_metrics(neg).first()
    assert m["f2_score"] == 0.0 and m["recall"] == 0.0 and m["accuracy"] == 0.5
    assert all(r["tp"] == 0 for r in ML.threshold_sweep(neg).collect())
    ref = spark.createDataFrame([(1.0, 0), (2.0, 1)], "x double, label int")
    cur = spark.createDataFrame([], "x double, label int")
    fd = D.feature_drift(ref, cur, ["x"]).collect()
    assert len(fd) == 1 and fd[0]["n_cur"] == 0
    assert D.label_shift(ref, cur).first()["label_shift"] is None


def test_chi_square_takes_null_as_one_category_and_empty_sides(spark):
    from kestrel.operators import drift as DR
    ref = spark.createDataFrame([("a",)] * 6 + [(None,)] * 4, "c string")
    cur = spark.createDataFrame([("a",)] * 5 + [(None,)] * 5, "c string")
    r = DR.chi_square(ref, cur, "c").first()
    assert r["dof"] == 1 and abs(r["chi2_statistic"] - 20 * (6 * 5 - 4 * 5) ** 2 / (11 * 9 * 10 * 10)) < 1e-9
    assert DR.chi_square(ref, cur.limit(0), "c").first()["chi2_statistic"] is None


def test_second_review_session_keeps_earlier_times(spark):
    from kestrel.operators import feedback as FB
    log = spark.createDataFrame([(1, "x", "A"), (2, "y", "B")], "user_id long, message string, action_taken string")
    one = FB.mark_reviewed(log, log.where("user_id = 1"), "2024-01-01 00:00:00")
    two = {r["user_id"]: r for r in FB.mark_reviewed(one, log.where("user_id = 2"), "2024-02-01 00:00:00").collect()}
    assert two[1]["review_timestamp"].month == 1 and two[2]["review_timestamp"].month == 2


def test_audit_null_label_map_payload_and_null_strata(spark):
    from kestrel.operators import feedback as FB
    from kestrel.operators import history as H
    from kestrel.operators import ml as ML
    labels = spark.createDataFrame([(1,), (1,), (None,)], "verified_label int")
    row = FB.labelling_audit(labels, "s", "2024-01-01 00:00:00").first()
    assert row["num_labels"] == 3 and row["label_distribution"] == {1: 2}
    maps = spark.createDataFrame([(1, 1, {"a": 1}), (1, 2, {"b": 2})], "k long, t long, m map<string,int>")
    assert H.first_per_key(maps, "k", [(maps["t"], False)]).first()["m"] == {"b": 2}
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(100)], "doc_id long, label int")
    assert ML.stratified_split(rows, "label", "doc_id").count() == 100


def test_session_sets_no_master_unless_asked(monkeypatch):
    from kestrel import session
    seen = {}

    class Builder:
        def appName(self, _): return self
        def master(self, m): seen["master"] = m; return self
        def config(self, k, v): seen[k] = v; return self
        def getOrCreate(self): raise KeyboardInterrupt

    monkeypatch.setattr(session, "SparkSession", type("S", (), {"builder": Builder()}))
    with pytest.raises(KeyboardInterrupt):
        session.build_session()
    assert "master" not in seen and seen["spark.ui.enabled"] == "false"


def test_folding_of_look_alikes(spark):
    from kestrel.functions import folding, text as TX
    cases = {"ｈａｔｅ": "hate", "løser": "loser", "straße": "strasse", "кill": "kill", "k\u200bi\u0301ll": "kill", "𝓴𝖎𝐥𝟏": "kili", "ﬂat Ｆ": "flatf",
             "Щука": "shchuka", "ΑΒΓ": "abg", "h😀a—t’e": "ha--t'e", "ⓗⓐⓣⓔ": "hate", "日本": "日本", "": "", "x\u00a0y": "xy", "Æø": "aeo"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, "")], "t string, want string")
    got = df.select("t", "want", TX.clean_text("t").alias("got"), TX.has_hard_term("t", ["hate", "loser", "(x"]).alias("hard")).collect()
    assert [(r["t"], r["got"]) for r in got] == [(r["t"], r["want"]) for r in got]
    assert [r["t"] for r in got if r["hard"]] == ["ｈａｔｅ", "løser", "ⓗⓐⓣⓔ"]
    assert TX.clean_text and all(f.isascii() for f in folding.fold_table().values())


def test_candidate_stats_with_null_values(spark):
    from kestrel.operators import feedback as FB
    rows = spark.createDataFrame([(None, "A", 1), (10, None, None), (10, "A", 1)], "priority_score int, action_taken string, report_count int")
    got = {(r["dimension"], r["priority_score"], r["action_taken"], r["report_count"]): r["n"] for r in FB.candidate_stats(rows).collect()}
    assert got == {("priority_score", None, None, None): 1, ("priority_score", 10, None, None): 2, ("action_taken", None, "A", None): 2,
                   ("action_taken", None, None, None): 1, ("report_count", None, None, 1): 2, ("report_count", None, None, None): 1}


def test_first_per_key_with_text_and_time_keys(spark):
    rows = spark.createDataFrame([(1, "b", 1, "x"), (1, "a", 2, "y"), (1, "b", 3, "z"), (None, "q", 4, "n"), (2, None, 5, "m")], "k long, s string, i long, v string")
    down = {r["k"]: r["v"] for r in H.first_per_key(rows, "k", [(F.col("s"), False), (F.col("i"), False)]).collect()}
    up = {r["k"]: r["v"] for r in H.first_per_key(rows, "k", [(F.col("s"), True), (F.col("i"), True)]).collect()}
    assert down == {1: "z", None: "n", 2: "m"} and up == {1: "y", None: "n", 2: "m"}


def test_user_reports_are_rows(spark):
    from kestrel.operators import feedback as FB
    log = spark.createDataFrame([(1, "u", "m", "LOW"), (2, "u", "m", "USER_REPORT"), (3, "u", "m", "USER_REPORT"), (4, "u", None, "USER_REPORT"),
                                 (5, "v", "m", None)], "id long, user_id string, message string, severity string")
    assert {r["id"]: r["report_count"] for r in FB.with_user_reports(log).collect()} == {1: 2, 2: 2, 3: 2, 4: 1, 5: 0}


def test_truncated_svd_equals_numpy(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from kestrel.operators import svd as SVD
    from kestrel.operators import training as TR
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (200, 6)) * [5, 3, 2, 1, .5, .1] + 2.0
    df = spark.createDataFrame([(i, [float(v) for v in row], float(i % 7), 3.0, i % 2) for i, row in enumerate(x)],
                               "id long, a array<double>, t double, const double, label int").withColumn("vec", array_to_vector("a"))
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    got = SVD.decompose(df, "vec", 3)
    assert np.allclose(got.singular_values, s[:3], rtol=1e-9) and np.allclose(np.abs(got.components.T), np.abs(vt[:3]), atol=1e-6)
    ratio = (x @ vt[:3].T).var(axis=0) / x.var(axis=0).sum()
    assert np.allclose(got.variance_ratio, ratio, atol=1e-9) and SVD.decompose(df, "vec", 6).variance_retained == pytest.approx(1.0)
    model = Pipeline(stages=TR.feature_stages("vec", ["t", "const"], 3)).fit(df)
    assert TR.variance_retained(model) == pytest.approx(ratio.sum())
    model.write().overwrite().save(str(tmp_path / "m"))
    out = PipelineModel.load(str(tmp_path / "m")).transform(df).orderBy("id").select(vector_to_array("features").alias("f")).toPandas()["f"]
    f = np.array(out.tolist())
    assert np.allclose(np.abs(f[:, :3]), np.abs(x @ vt[:3].T), atol=1e-6)
    t = np.array([i % 7 for i in range(200)], float)
    assert np.allclose(f[:, 3], (t - t.mean()) / t.std()) and not f[:, 4].any()


def test_importances_of_trees_and_linear_models(spark):
    from pyspark.ml.functions import array_to_vector
    from kestrel.operators import training as TR
    rows = [(i, [float(i % 2), float((i * 7) % 5)], i % 2) for i in range(80)]
    df = TR.with_class_weights(spark.createDataFrame(rows, "id long, a array<double>, label int").withColumn("features", array_to_vector("a")))
    for kind in ("logistic", "random_forest", "gbt"):
        params = {"logistic": {"regParam": 0.01}, "random_forest": {"numTrees": 3}, "gbt": {"maxIter": 2}}[kind]
        top = TR.feature_importance(TR._learner(kind, params).fit(df), ["signal", "noise"], 1).collect()
        assert [r["feature"] for r in top] == ["signal"]
    assert TR.feature_importance(object(), []) is None
