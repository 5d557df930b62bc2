"""Training-data and evaluation queries (M4, M6, M9–M13) on messages (label, confidence as score)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ml as ML
from ..sources.tables import messages, with_views
from . import register


def _scores(spark, sf_dir):
    return messages(spark, sf_dir).select("msg_id", "label", F.col("confidence").alias("score"))


@register("m6_stratified_split", with_views("""
SELECT msg_id, label,
       CASE WHEN 100 * pos < 70 * n THEN 'train' WHEN 100 * pos < 85 * n THEN 'val' ELSE 'test' END AS split
FROM (SELECT msg_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(msg_id AS VARCHAR) || '42'), msg_id) - 1 AS pos,
             count(*) OVER (PARTITION BY label) AS n FROM messages)""", "messages"))
def m6_stratified_split(spark, sf_dir):
    """M6: exact 70/15/15 stratified split, seed 42, with bounded tasks."""
    m = messages(spark, sf_dir).select("msg_id", "label")
    return ML.stratified_split(m, "label", "msg_id").select("msg_id", "label", "split")


_SWEEP_SQL = with_views("""
WITH s AS (SELECT label, confidence AS score FROM messages),
t AS (SELECT k, k / 100.0 AS thr FROM range(10, 90) r(k)),
c AS (SELECT k, CAST(count(*) FILTER (WHERE score >= CAST(k AS DOUBLE) / 100 AND label = 1) AS BIGINT) AS tp,
             CAST(count(*) FILTER (WHERE score >= CAST(k AS DOUBLE) / 100 AND label <> 1) AS BIGINT) AS fp,
             count(*) FILTER (WHERE label = 1) AS P
      FROM t, s GROUP BY k),
m AS (SELECT CAST(k AS DOUBLE) / 100 AS threshold, tp, fp,
             CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
             CASE WHEN P > 0 THEN tp / P ELSE 0.0 END AS recall,
             CASE WHEN 2 * tp + (P - tp) + fp > 0 THEN 2.0 * tp / (2 * tp + (P - tp) + fp) ELSE 0.0 END AS f1,
             CASE WHEN 5 * tp + 4 * (P - tp) + fp > 0 THEN 5.0 * tp / (5 * tp + 4 * (P - tp) + fp) ELSE 0.0 END AS f_beta
      FROM c)""", "messages")


def _dbl(sql: str) -> str:
    return sql.replace("ELSE 0.0 END", "ELSE CAST(0.0 AS DOUBLE) END")


@register("m9_threshold_sweep", _dbl(_SWEEP_SQL + "\nSELECT threshold, tp, fp, round(precision, 12) AS precision, "
                                     "round(recall, 12) AS recall, round(f1, 12) AS f1, round(f_beta, 12) AS f_beta FROM m"))
def m9_threshold_sweep(spark, sf_dir):
    """M9: precision/recall/F1/F2 at the 80 thresholds .10 … .89 from one histogram pass."""
    sw = ML.threshold_sweep(_scores(spark, sf_dir))
    return sw.select("threshold", "tp", "fp", *[F.round(c, 12).alias(c) for c in ["precision", "recall", "f1", "f_beta"]])


@register("m9_best_threshold", _dbl(_SWEEP_SQL + "\nSELECT threshold, round(f_beta, 12) AS f_beta FROM m "
                                    "ORDER BY f_beta DESC, threshold ASC LIMIT 1"))
def m9_best_threshold(spark, sf_dir):
    """M9: argmax-first F2 threshold."""
    best = ML.best_threshold(ML.threshold_sweep(_scores(spark, sf_dir)))
    return best.select("threshold", F.round("f_beta", 12).alias("f_beta"))


@register("m10_metrics", _dbl(with_views("""
SELECT round(CASE WHEN 5 * tp + 4 * fn + fp > 0 THEN 5.0 * tp / (5 * tp + 4 * fn + fp) ELSE 0.0 END, 12) AS f2_score,
       round(CASE WHEN 2 * tp + fn + fp > 0 THEN 2.0 * tp / (2 * tp + fn + fp) ELSE 0.0 END, 12) AS f1_score,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 12) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 12) AS recall,
       round((tp + tn) / (tp + fp + fn + tn), 12) AS accuracy
FROM (SELECT count(*) FILTER (WHERE confidence >= 0.5 AND label = 1) AS tp,
             count(*) FILTER (WHERE confidence >= 0.5 AND label <> 1) AS fp,
             count(*) FILTER (WHERE confidence < 0.5 AND label = 1) AS fn,
             count(*) FILTER (WHERE confidence < 0.5 AND label <> 1) AS tn FROM messages)""", "messages")))
def m10_metrics(spark, sf_dir):
    """F2, F1, precision, recall, accuracy at threshold .5."""
    m = ML.classification_metrics(_scores(spark, sf_dir), 0.5)
    return m.select(*[F.round(c, 12).alias(c) for c in m.columns])


_AUC_SQL = with_views("""
SELECT round((sum(r) FILTER (WHERE label = 1) - P * (P + 1) / 2.0) / (P * N), 12) AS roc_auc
FROM (SELECT label, rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1) / 2.0 AS r,
             count(*) FILTER (WHERE label = 1) OVER () AS P, count(*) FILTER (WHERE label <> 1) OVER () AS N
      FROM messages)
GROUP BY P, N""", "messages")


@register("m11_roc_auc", _AUC_SQL)
def m11_roc_auc(spark, sf_dir):
    """ROC-AUC with tied scores (oracle: Mann–Whitney average ranks)."""
    return ML.roc_auc(_scores(spark, sf_dir)).select(F.round("roc_auc", 12).alias("roc_auc"))


@register("m11_roc_auc_prefix", _AUC_SQL)
def m11_roc_auc_prefix(spark, sf_dir):
    """M11 with score ranges of about 4 distinct scores each: the split that continuous scores get."""
    return ML.roc_auc(_scores(spark, sf_dir), range_rows=4).select(
        F.round("roc_auc", 12).alias("roc_auc"))


_AP_SQL = with_views("""
SELECT round(sum(pos / P * tp / (tp + fp)), 12) AS avg_precision FROM (
  SELECT pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS P FROM (
    SELECT confidence AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
    FROM messages GROUP BY confidence)
  WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""", "messages")


@register("m12_avg_precision", _AP_SQL)
def m12_avg_precision(spark, sf_dir):
    """Step-wise average precision (not interpolated)."""
    return ML.average_precision(_scores(spark, sf_dir)).select(F.round("avg_precision", 12).alias("avg_precision"))


@register("m12_avg_precision_prefix", _AP_SQL)
def m12_avg_precision_prefix(spark, sf_dir):
    """M12 with score ranges of about 4 distinct scores each."""
    return ML.average_precision(_scores(spark, sf_dir), range_rows=4).select(
        F.round("avg_precision", 12).alias("avg_precision"))


@register("m13_confusion_matrix", with_views("""
SELECT label, CAST(count(*) FILTER (WHERE confidence < 0.5) AS BIGINT) AS pred_0,
       CAST(count(*) FILTER (WHERE confidence >= 0.5) AS BIGINT) AS pred_1
FROM messages GROUP BY label""", "messages"))
def m13_confusion_matrix(spark, sf_dir):
    """Confusion matrix at threshold .5."""
    return ML.confusion_matrix(_scores(spark, sf_dir), 0.5)


@register("m4_standard_scale", with_views("""
SELECT msg_id, round((confidence - avg(confidence) OVER ()) / CASE WHEN stddev_pop(confidence) OVER () > 0
                                                            THEN stddev_pop(confidence) OVER () ELSE 1 END, 9) AS confidence_z
FROM messages""", "messages"))
def m4_standard_scale(spark, sf_dir):
    """M4: standard scaling with population std (Q20)."""
    m = messages(spark, sf_dir).select("msg_id", "confidence")
    z = ML.standard_scale(m, ["confidence"], "_z")
    return z.select("msg_id", F.round("confidence_z", 9).alias("confidence_z"))


TABULAR = ["msg_len", "caps_ratio", "slur_count", "word_count"]


def _training_rows(spark, sf_dir):
    """Vectors with label and the tabular features of the text of the same id (0 where there is none), split by M6."""
    from ..functions import text as T
    from ..operators import training as TR
    from ..sources.tables import read_table
    fc = T.feature_columns("text")
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), *[fc[c].cast("double").alias(c) for c in TABULAR])
    emb = TR.embeddings_frame(read_table(spark, sf_dir, "embeddings")).join(d, "vec_id", "left").fillna(0.0, TABULAR)
    return ML.stratified_split(emb, "label", "vec_id")


@register("m7_train_score")
def m7_train_score(spark, sf_dir):
    """M3 + M4 + M5 + M7 + M17: SVD and scaled tabular columns fused, weighted logistic regression, test split scored.

    Rows-only check (learned weights have no SQL oracle); metrics M10–M13 apply to the output.
    """
    from ..operators import training as TR
    split = _training_rows(spark, sf_dir)
    train = TR.with_class_weights(split.filter(F.col("split") == "train"))
    model = TR.training_pipeline("vec", TABULAR, k=16).fit(train)
    return TR.score(model, split.filter(F.col("split") == "test")).select("vec_id", "label", "prediction", "confidence")


@register("m3_variance_retained", """
WITH x AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT i, avg(CAST(x AS DOUBLE)) AS mean, var_pop(CAST(x AS DOUBLE)) AS var FROM x GROUP BY i)
SELECT CAST((SELECT count(*) FROM embeddings) AS BIGINT) AS n, round(sum(var), 6) AS total_variance,
       CAST(1.0 AS DOUBLE) AS variance_retained FROM m""")
def m3_variance_retained(spark, sf_dir):
    """M3: the vectors' total variance, all of it retained by as many components as columns (projected and measured)."""
    from ..operators.svd import TruncatedSVD
    from ..operators import training as TR
    from ..sources.tables import read_table
    from pyspark.ml.functions import vector_to_array
    emb = TR.embeddings_frame(read_table(spark, sf_dir, "embeddings"))
    model = TruncatedSVD(64, "vec", "z").fit(emb)
    z = model.transform(emb).select(F.posexplode(vector_to_array("z")).alias("i", "z"))
    per = z.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.var_pop("z").alias("v"))
    return per.agg(F.max("n").alias("n"), F.round(F.sum("v"), 6).alias("total_variance"),
                   F.round(F.lit(model.svd.variance_retained), 6).alias("variance_retained"))


@register("m17_batch_scoring")
def m17_batch_scoring(spark, sf_dir):
    """A packaged scorer learnt from the labelled texts; every text featurized, enriched, scored, folded and logged (rows-only)."""
    from pyspark.ml.classification import LogisticRegression
    from ..operators.scoring import train_scorer
    from ..sources.tables import texts
    t = texts(spark, sf_dir).select("doc_id", "user_id", "text", "label")
    learner = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=0.01, maxIter=50)
    return train_scorer(t, "v1", learner).log_rows(t.drop("label"))


@register("m1_embed_documents")
def m1_embed_documents(spark, sf_dir):
    """M1: 64-d hashed, L2-normalised embedding of every whole document (native encoder; rows-only)."""
    from ..operators.embedding import embed_hashing
    from ..sources.tables import read_table
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return embed_hashing(d, "text", 64).select("doc_id", F.size("embedding").alias("dim"),
                                              F.aggregate("embedding", F.lit(0.0),
                                                          lambda a, x: a + x * x).alias("norm_sq"))


@register("m15_tournament")
def m15_tournament(spark, sf_dir):
    """M8 + M15 + O9: whole-space search per model type on the embeddings, leaderboard by test F2 (rows-only)."""
    from ..operators import training as TR
    split = _training_rows(spark, sf_dir).persist()  # split once, for all fits
    train = TR.with_class_weights(split.filter(F.col("split") == "train"))
    board = TR.tournament(train, split.filter(F.col("split") == "val"), split.filter(F.col("split") == "test"), tabular=TABULAR)
    split.unpersist()
    return board
