"""Drift queries (D1–D11, D13, D14): texts of sources src0–9 (reference) against src10–19 (current)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as T
from ..operators import drift as D
from ..sources.tables import messages, texts, with_views
from . import register
from .text import _sum_contains, _tokens

FEATURES = ["msg_len", "caps_ratio", "slur_count", "word_count"]
R9 = 9  # decimals kept for statistics built from floating sums


def _sides(spark, sf_dir):
    fc = T.feature_columns("text")
    t = texts(spark, sf_dir).withColumns({f: fc[f] for f in FEATURES})
    is_ref = F.substring("source", 4, 10).cast("int") < 10
    return t.filter(is_ref), t.filter(~is_ref)


_FEAT_CTE = f"""
WITH f AS (
  SELECT CASE WHEN CAST(substring(source, 4) AS INTEGER) < 10 THEN 'ref' ELSE 'cur' END AS side, label, lang,
         CAST(length(coalesce(text, '')) AS DOUBLE) AS msg_len,
         CASE WHEN length(coalesce(text, '')) > 0
              THEN length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) / length(text) ELSE 0.0 END AS caps_ratio,
         CAST({_sum_contains("lower(coalesce(text, ''))", lx.BAD_WORDS)} AS DOUBLE) AS slur_count,
         CAST(len({_tokens("coalesce(text, '')")}) AS DOUBLE) AS word_count
  FROM texts),
long AS (SELECT side, feature, value FROM (UNPIVOT f ON msg_len, caps_ratio, slur_count, word_count
                                           INTO NAME feature VALUE value) WHERE value IS NOT NULL),
n AS (SELECT feature, count(*) FILTER (WHERE side = 'ref') AS n_ref, count(*) FILTER (WHERE side = 'cur') AS n_cur
      FROM long GROUP BY feature),
g AS (SELECT feature, value, count(*) FILTER (WHERE side = 'ref') AS r, count(*) FILTER (WHERE side = 'cur') AS c
      FROM long GROUP BY feature, value),
ks AS (SELECT feature, max(abs(cr / n_ref - cc / n_cur)) AS ks_statistic, any_value(n_ref) AS n_ref,
              any_value(n_cur) AS n_cur
       FROM (SELECT *, sum(r) OVER w AS cr, sum(c) OVER w AS cc FROM g
             WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
       JOIN n USING (feature) GROUP BY feature),
ksp AS (SELECT *, CASE WHEN lam < 0.2 THEN 1.0 ELSE least(greatest(2.0 * list_sum(list_transform(range(1, 101),
                     lambda k: pow(-1.0, k - 1) * exp(CAST(-2.0 AS DOUBLE) * k * k * lam * lam))), 0.0), 1.0) END AS ks_p_value
        FROM (SELECT *, ks_statistic * sqrt(n_ref * n_cur / (n_ref + n_cur)) AS lam FROM ks)),
st AS (SELECT feature, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi
       FROM (SELECT feature, min(value) AS mn, max(value) AS mx FROM long WHERE side = 'ref' GROUP BY feature)),
b0 AS (SELECT l.*, lo, hi, (hi - lo) / CAST(10 AS DOUBLE) AS step,
              CAST(floor((value - lo) * (CAST(10 AS DOUBLE) / (hi - lo))) AS BIGINT) AS i0
       FROM long l JOIN st USING (feature)),
b1 AS (SELECT *, CASE WHEN i0 = 10 THEN 9 ELSE i0 END AS i1 FROM b0),
b2 AS (SELECT feature, side, CASE WHEN NOT (value >= lo AND value <= hi) THEN NULL
                                  WHEN value < CASE WHEN i1 = 10 THEN hi ELSE i1 * step + lo END THEN i1 - 1
                                  WHEN value >= CASE WHEN i1 + 1 = 10 THEN hi ELSE (i1 + 1) * step + lo END AND i1 <> 9 THEN i1 + 1
                                  ELSE i1 END AS bin
       FROM b1),
cnt AS (SELECT feature, bin, count(*) FILTER (WHERE side = 'ref') AS r, count(*) FILTER (WHERE side = 'cur') AS c
        FROM b2 WHERE bin IS NOT NULL GROUP BY feature, bin),
psi AS (SELECT feature, sum((cc - rr) * ln(cc / rr)) AS psi FROM (
          SELECT n.feature, coalesce(r, 0) / n_ref + 1e-10 AS rr, coalesce(c, 0) / n_cur + 1e-10 AS cc
          FROM n CROSS JOIN range(0, 10) t(bin) LEFT JOIN cnt ON cnt.feature = n.feature AND cnt.bin = t.bin)
        GROUP BY feature),
ms AS (SELECT feature, avg(value) FILTER (WHERE side = 'ref') AS ref_mean, avg(value) FILTER (WHERE side = 'cur') AS cur_mean
       FROM long GROUP BY feature),
fd AS (SELECT feature, ks_statistic, ks_p_value, psi, ref_mean, cur_mean,
              abs(cur_mean - ref_mean) / (ref_mean + 1e-10) AS mean_shift,
              (ks_p_value < 0.05) OR (psi > 0.2) AS drifted
       FROM ksp JOIN psi USING (feature) JOIN ms USING (feature)),
ld AS (SELECT max(abs(c.s - r.s)) AS label_shift FROM
         (SELECT label, count(*) / sum(count(*)) OVER () AS s FROM f WHERE side = 'ref' AND label IS NOT NULL GROUP BY label) r
         JOIN (SELECT label, count(*) / sum(count(*)) OVER () AS s FROM f WHERE side = 'cur' AND label IS NOT NULL GROUP BY label) c
         USING (label))"""

_DRIFT_SQL = with_views(_FEAT_CTE, "texts")


def _q(body: str) -> str:
    return _DRIFT_SQL + "\n" + body


def _with_sides(spark, sf_dir):
    side = F.when(F.substring("source", 4, 10).cast("int") < 10, D.REF).otherwise(D.CUR)
    return texts(spark, sf_dir).withColumn("side", side)


def _tagged(spark, sf_dir):
    """Texts with their features and a side column: both sides in one read."""
    fc = T.feature_columns("text")
    return _with_sides(spark, sf_dir).withColumns({f: fc[f] for f in FEATURES})


def _long(spark, sf_dir):
    return D.unpivot_sides(_tagged(spark, sf_dir), FEATURES)


@register("d1_ks", _q("SELECT feature, ks_statistic, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur FROM ks"))
def d1_ks(spark, sf_dir):
    """Two-sample KS statistic per text feature."""
    return D.ks_statistic(_long(spark, sf_dir))


@register("d1_ks_prefix", _q("SELECT feature, ks_statistic, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur FROM ks"))
def d1_ks_prefix(spark, sf_dir):
    """D1 with value ranges of about 64 distinct values each: the split that large inputs get."""
    return D.ks_statistic(_long(spark, sf_dir), range_rows=64)


@register("d2_ks_pvalue", _q(f"SELECT feature, round(ks_p_value, {R9}) AS ks_p_value, ks_p_value < 0.05 AS ks_drifted FROM ksp"))
def d2_ks_pvalue(spark, sf_dir):
    """Asymptotic KS p-value and the 5 % drift flag."""
    out = D.ks_test(_long(spark, sf_dir))
    return out.select("feature", F.round("ks_p_value", R9).alias("ks_p_value"), "ks_drifted")


@register("d4_psi", _q(f"SELECT feature, round(psi, {R9}) AS psi FROM psi"))
def d4_psi(spark, sf_dir):
    """PSI on 10 equal-width reference bins."""
    return D.psi(_long(spark, sf_dir)).select("feature", F.round("psi", R9).alias("psi"))


@register("d5_d6_feature_drift", _q(f"""
SELECT feature, ks_statistic, round(ks_p_value, {R9}) AS ks_p_value, round(psi, {R9}) AS psi,
       round(ref_mean, {R9}) AS ref_mean, round(cur_mean, {R9}) AS cur_mean, round(mean_shift, {R9}) AS mean_shift, drifted
FROM fd"""))
def d5_d6_feature_drift(spark, sf_dir):
    """D5 mean shift + D6 verdict (KS drifted or PSI > .2), with D1/D2/D4 alongside."""
    fd = D.drift_statistics(_long(spark, sf_dir))
    return fd.select("feature", "ks_statistic", *[F.round(c, R9).alias(c) for c in
                                                  ["ks_p_value", "psi", "ref_mean", "cur_mean", "mean_shift"]],
                     "drifted")


@register("d7_label_shift", _q(f"SELECT round(label_shift, {R9}) AS label_shift, label_shift > 0.15 AS label_drifted FROM ld"))
def d7_label_shift(spark, sf_dir):
    """D7 + J9: label distribution shift over classes present on both sides."""
    ref, cur = _sides(spark, sf_dir)
    ls = D.label_shift(ref, cur, "label")
    return ls.select(F.round("label_shift", R9).alias("label_shift"), "label_drifted")


@register("d8_d13_drift_summary", _q("""
SELECT CAST(count(*) AS BIGINT) AS n_features,
       CAST(count(*) FILTER (WHERE drifted) + (SELECT CAST(label_shift > 0.15 AS INTEGER) FROM ld) AS BIGINT) AS n_drifted,
       array_to_string(list_sort(list(feature) FILTER (WHERE drifted)
                                 || CASE WHEN (SELECT label_shift > 0.15 FROM ld) THEN ['label_distribution'] ELSE [] END), ',') AS drifted_features,
       (count(*) FILTER (WHERE drifted) + (SELECT CAST(label_shift > 0.15 AS INTEGER) FROM ld)) / greatest(count(*), 1) AS drift_share,
       (count(*) FILTER (WHERE drifted) + (SELECT CAST(label_shift > 0.15 AS INTEGER) FROM ld)) / greatest(count(*), 1) > 0.3 AS overall_drift_detected,
       CASE WHEN (count(*) FILTER (WHERE drifted) + (SELECT CAST(label_shift > 0.15 AS INTEGER) FROM ld)) / greatest(count(*), 1) > 0.3
            THEN 'retrain_recommended' ELSE 'no_action_needed' END AS recommendation
FROM fd"""))
def d8_d13_drift_summary(spark, sf_dir):
    """D8 drift share and overall flag (label counted in the numerator, Q13) and D13 advice."""
    ref, cur = _sides(spark, sf_dir)
    s = D.drift_summary(D.drift_statistics(_long(spark, sf_dir)), D.label_shift(ref, cur, "label"))
    return s.withColumn("drifted_features", F.array_join("drifted_features", ","))


@register("d3_chi_square", _q("""
SELECT round(sum(pow(o_ref - e_ref, 2) / e_ref + pow(o_cur - e_cur, 2) / e_cur), 9) AS chi2_statistic,
       CAST(count(*) - 1 AS BIGINT) AS dof
FROM (SELECT *, (o_ref + o_cur) * n_ref / (n_ref + n_cur) AS e_ref, (o_ref + o_cur) * n_cur / (n_ref + n_cur) AS e_cur
      FROM (SELECT *, sum(o_ref) OVER () AS n_ref, sum(o_cur) OVER () AS n_cur FROM (
              SELECT lang, count(*) FILTER (WHERE side = 'ref') AS o_ref, count(*) FILTER (WHERE side = 'cur') AS o_cur
              FROM f GROUP BY lang)))"""))
def d3_chi_square(spark, sf_dir):
    """D3 + J8: χ² homogeneity of the language mix between the two sides."""
    ref, cur = _sides(spark, sf_dir)
    c = D.chi_square(ref, cur, "lang")
    return c.select(F.round("chi2_statistic", 9).alias("chi2_statistic"), F.col("dof").cast("bigint").alias("dof"))


@register("d9_quick_drift", _q(f"""
SELECT feature, round(change, {R9}) AS change, threshold, change > threshold AS drifted FROM (
  SELECT 'label' AS feature, abs(avg(label) FILTER (WHERE side = 'cur') - avg(label) FILTER (WHERE side = 'ref')) AS change,
         CAST(0.1 AS DOUBLE) AS threshold FROM f
  UNION ALL
  SELECT feature, abs(avg(value) FILTER (WHERE side = 'cur') - avg(value) FILTER (WHERE side = 'ref'))
                  / (avg(value) FILTER (WHERE side = 'ref') + 1e-8), CAST(0.3 AS DOUBLE)
  FROM long WHERE feature IN ('msg_len', 'caps_ratio', 'slur_count') GROUP BY feature)"""))
def d9_quick_drift(spark, sf_dir):
    """Batch-vs-master label-rate change (> .1) and relative mean change (> .3) on three features."""
    ref, cur = _sides(spark, sf_dir)
    q = D.quick_drift(ref, cur, ["msg_len", "caps_ratio", "slur_count"])
    return q.select("feature", F.round("change", R9).alias("change"), "threshold", "drifted")


@register("d11_data_quality", _q(f"""
SELECT side, feature, CAST(count(value) AS BIGINT) AS n, CAST(count(*) - count(value) AS BIGINT) AS missing,
       round((count(*) - count(value)) / count(*), {R9}) AS missing_share, CAST(count(DISTINCT value) AS BIGINT) AS distinct_values,
       min(value) AS min_value, max(value) AS max_value,
       round(avg(value), {R9}) AS mean_value, round(stddev_pop(value), {R9}) AS std_value,
       round(quantile_cont(value, 0.25), {R9}) AS q25_value, round(quantile_cont(value, 0.5), {R9}) AS median_value,
       round(quantile_cont(value, 0.75), {R9}) AS q75_value
FROM ({" UNION ALL ".join(f"SELECT side, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM f" for c in [*FEATURES, "label"])})
GROUP BY side, feature"""))
def d11_data_quality(spark, sf_dir):
    """Per side and feature — rows, missing, distinct, min, max, mean, population std, exact quartiles."""
    dq = D.data_quality(D.unpivot_sides(_tagged(spark, sf_dir), [*FEATURES, "label"], keep_nulls=True))
    return dq.withColumns({c: F.round(c, R9) for c in ("missing_share", "mean_value", "std_value", *D.QUARTILES.values())})


_MISSING_COLUMNS = ["text", "lang", "source", "label", "user_id"]


@register("d11_missing_values", with_views(f"""
WITH s AS (SELECT CASE WHEN CAST(substring(source, 4) AS INTEGER) < 10 THEN 'ref' ELSE 'cur' END AS side, * FROM texts)
""" + "\nUNION ALL ".join(f"""SELECT side, '{c}' AS "column", CAST(count(*) - count({c}) AS BIGINT) AS missing,
  round((count(*) - count({c})) / count(*), {R9}) AS missing_share FROM s GROUP BY side""" for c in _MISSING_COLUMNS), "texts"))
def d11_missing_values(spark, sf_dir):
    """Missing values of text, categorical and numeric columns on either side."""
    ref, cur = _sides(spark, sf_dir)
    return D.missing_values(ref, cur, _MISSING_COLUMNS).withColumn("missing_share", F.round("missing_share", R9))


@register("d14_drift_history", with_views(f"""
SELECT day, n, toxic_rate, prev_rate, toxic_rate - prev_rate AS rate_change
FROM (SELECT day, n, toxic_rate, lag(toxic_rate) OVER (ORDER BY day) AS prev_rate FROM (
        SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS n, avg(CAST(label AS DOUBLE)) AS toxic_rate
        FROM messages GROUP BY CAST(ts AS DATE)))""", "messages"))
def d14_drift_history(spark, sf_dir):
    """Daily label-rate history with the change against the previous run (one row per day)."""
    m = messages(spark, sf_dir)
    daily = m.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"),
                                                          F.avg(F.col("label").cast("double")).alias("toxic_rate"))
    # One row per day: the ordered window runs over the small daily table only.
    w = Window.orderBy("day")
    return daily.withColumn("prev_rate", F.lag("toxic_rate").over(w)).withColumn(
        "rate_change", F.col("toxic_rate") - F.col("prev_rate"))


NATIVE_DESCRIPTORS = ["msg_len", "non_letter_pct", "has_trigger_word", "emphasis"]
DESCRIPTORS = [*NATIVE_DESCRIPTORS, "oov_share", "lexicon_score"]

def lexicon_table(spark, sf_dir):
    """The sentiment stand-in's lexicon: words of at least 5 labelled reference texts."""
    t = _with_sides(spark, sf_dir)
    return D.lexicon_from_labels(t.filter(F.col("side") == D.REF), "doc_id", "text", "label", 5)


_TOKEN_CTE = f"""
WITH d AS (SELECT doc_id, CASE WHEN CAST(substring(source, 4) AS INTEGER) < 10 THEN 'ref' ELSE 'cur' END AS side,
                  coalesce(text, '') AS text FROM texts),
tok AS (SELECT doc_id, side, unnest({_tokens("lower(text)")}) AS token FROM d),
vocab AS (SELECT token FROM tok WHERE side = 'ref' GROUP BY token HAVING count(*) >= 2),
held AS (SELECT DISTINCT doc_id, token, label FROM tok JOIN texts USING (doc_id) WHERE side = 'ref' AND label IS NOT NULL),
sizes AS (SELECT count(*) FILTER (WHERE label = 0) AS clean, count(*) FILTER (WHERE label = 1) AS toxic
  FROM texts JOIN d USING (doc_id) WHERE d.side = 'ref'),
lexicon AS (SELECT token AS word, CAST(round(CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) / any_value(clean)
  - CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) / any_value(toxic), 6) AS DECIMAL(18, 6)) AS weight
  FROM held, sizes GROUP BY token HAVING count(*) >= 5),
td AS (SELECT d.doc_id, d.side, coalesce(oov, 0.0) AS oov_share, coalesce(CAST(score AS DOUBLE), 0.0) AS lexicon_score FROM d LEFT JOIN (
  SELECT doc_id, CAST(count(*) FILTER (WHERE v.token IS NULL) AS DOUBLE) / count(*) AS oov, sum(weight) AS score
  FROM tok LEFT JOIN vocab v ON v.token = tok.token LEFT JOIN lexicon l ON l.word = tok.token GROUP BY doc_id) x ON x.doc_id = d.doc_id)"""


@register("f22_oov_share", with_views(_TOKEN_CTE + f"\nSELECT doc_id, round(oov_share, {R9}) AS oov_share FROM td WHERE doc_id IN (SELECT doc_id FROM tok)", "texts"))
def f22_oov_share(spark, sf_dir):
    """share of each text's tokens that the reference side's vocabulary (two or more occurrences) lacks."""
    t = _with_sides(spark, sf_dir)
    vocab = D.vocabulary(t.filter(F.col("side") == D.REF), "doc_id", "text", 2)
    return D.oov_share(t, "doc_id", "text", vocab).withColumn("oov_share", F.round("oov_share", R9))


@register("f23_lexicon_score", with_views(_TOKEN_CTE + "\nSELECT doc_id, lexicon_score FROM td WHERE doc_id IN (SELECT doc_id FROM tok JOIN lexicon ON word = token)", "texts"))
def f23_lexicon_score(spark, sf_dir):
    """weighted-lexicon score of every text that holds a lexicon word (re-aimed sentiment)."""
    found = D.lexicon_score(texts(spark, sf_dir), "doc_id", "text", lexicon_table(spark, sf_dir))
    return found.withColumn("lexicon_score", F.col("lexicon_score").cast("double"))


_DESC_SELECT = f"""CAST(length(coalesce(text, '')) AS DOUBLE) AS msg_len,
         CASE WHEN length(coalesce(text, '')) > 0
              THEN length(regexp_replace(text, '[\\p{{L}}{lx.WS_CLASS}]', '', 'g')) * 100.0 / length(text)
              ELSE 0.0 END AS non_letter_pct,
         CAST(len(list_intersect({_tokens("lower(coalesce(text, ''))")}, [{', '.join("'" + w + "'" for w in lx.TRIGGER_WORDS)}])) > 0 AS DOUBLE) AS has_trigger_word,
         CAST(regexp_matches(coalesce(text, ''), '[!?]{{2,}}') AS DOUBLE) AS emphasis,
         td.oov_share, td.lexicon_score
  FROM texts JOIN td USING (doc_id)),"""


def _descriptor_sql() -> str:
    a = _FEAT_CTE.index("CAST(length(coalesce(text, '')) AS DOUBLE) AS msg_len,")
    b = _FEAT_CTE.index("FROM texts),") + len("FROM texts),")
    body = _FEAT_CTE[:a] + _DESC_SELECT + _FEAT_CTE[b:]
    body = body.replace("ON msg_len, caps_ratio, slur_count, word_count", "ON " + ", ".join(DESCRIPTORS))
    body = _TOKEN_CTE + "," + body.replace("\nWITH f AS", "\nf AS", 1)
    return with_views(body, "texts") + f"""
SELECT feature, round(ks_statistic, {R9}) AS ks_statistic, round(psi, {R9}) AS psi, drifted FROM fd"""


@register("d10_descriptor_drift", _descriptor_sql())
def d10_descriptor_drift(spark, sf_dir):
    """Text-descriptor drift — length, non-letter share, trigger words, emphasis, OOV share and sentiment through KS and PSI.

    The token descriptors come from one pass over (text, token) counts and are folded into the same
    (side, feature, value) table as the others.
    """
    t = _with_sides(spark, sf_dir)
    native = t.select("side", T.msg_len("text").cast("double").alias("msg_len"), T.non_letter_pct("text").alias("non_letter_pct"),
                      T.has_trigger_word("text").cast("double").alias("has_trigger_word"),
                      T.emphasis("text").cast("double").alias("emphasis"))
    by_token = D.token_descriptors(t, "doc_id", "text", lexicon_table(spark, sf_dir))
    long = native.unpivot("side", NATIVE_DESCRIPTORS, "feature", "value").unionByName(
        by_token.unpivot("side", ["oov_share", "lexicon_score"], "feature", "value"))
    fd = D.drift_statistics(long)
    return fd.select("feature", F.round("ks_statistic", R9).alias("ks_statistic"), F.round("psi", R9).alias("psi"), "drifted")


# Upper tail of χ² as 1 - P, P by its series with the logarithm of the gamma function.
_CHI2_SF = """1.0 - list_sum(list_transform(range(0, 600), lambda i:
  exp((dof / 2.0 + i) * ln(x / 2.0) - x / 2.0 - lgamma(dof / 2.0 + i + 1.0))))"""


def _dataset_drift_sql() -> str:
    def chi(column: str) -> str:
        return f"""SELECT '{column}' AS "column", sum(pow(o_ref - e_ref, 2) / e_ref + pow(o_cur - e_cur, 2) / e_cur) AS x, count(*) - 1 AS dof
FROM (SELECT *, (o_ref + o_cur) * n_ref / (n_ref + n_cur) AS e_ref, (o_ref + o_cur) * n_cur / (n_ref + n_cur) AS e_cur
      FROM (SELECT *, sum(o_ref) OVER () AS n_ref, sum(o_cur) OVER () AS n_cur FROM (
              SELECT {column}, count(*) FILTER (WHERE side = 'ref') AS o_ref, count(*) FILTER (WHERE side = 'cur') AS o_cur
              FROM f GROUP BY {column})))"""
    return _q(f""", chi AS ({chi("lang")} UNION ALL {chi("label")}),
tests AS (SELECT feature AS "column", 'ks' AS test, ks_statistic AS statistic, ks_p_value AS p_value FROM ksp
  UNION ALL SELECT "column", 'chi2', x, CASE WHEN x <= 0 THEN 1.0 ELSE {_CHI2_SF} END FROM chi)
SELECT "column", test, round(statistic, {R9}) AS statistic, round(p_value, {R9}) AS p_value, p_value < 0.05 AS drifted,
       avg(CAST(p_value < 0.05 AS DOUBLE)) OVER () AS drift_share, avg(CAST(p_value < 0.05 AS DOUBLE)) OVER () > 0.3 AS dataset_drift
FROM tests""")


@register("d12_dataset_drift", _dataset_drift_sql())
def d12_dataset_drift(spark, sf_dir):
    """All-column drift — KS on the numeric text features, χ² on language and label, dataset verdict."""
    ref, cur = _sides(spark, sf_dir)
    out = D.dataset_drift(ref, cur, FEATURES, ["lang", "label"])
    return out.withColumns({"statistic": F.round("statistic", R9), "p_value": F.round("p_value", R9)})


#: Three runs made of slices of the current side's sources, with their times.
RUNS = {"run-1": ("2024-01-08 00:00:00", 10, 12), "run-2": ("2024-01-15 00:00:00", 13, 15), "run-3": ("2024-01-22 00:00:00", 16, 19)}


def _runs_sql() -> str:
    cases = " ".join(f"WHEN no BETWEEN {lo} AND {hi} THEN '{run}'" for run, (_, lo, hi) in RUNS.items())
    times = ", ".join(f"('{run}', TIMESTAMP '{t}')" for run, (t, _, _) in RUNS.items())
    body = _FEAT_CTE[_FEAT_CTE.index("long AS ("):]
    f = _FEAT_CTE[:_FEAT_CTE.index("long AS (")].replace("\nWITH f AS (", "\nWITH times(run, run_time) AS (VALUES " + times + "),\nf0 AS (").replace(
        "AS side, label, lang,", "AS side, CAST(substring(source, 4) AS INTEGER) AS no, label, lang,")
    f += f"""f AS (SELECT run, f0.* EXCLUDE (no) FROM f0 JOIN times ON side = 'ref' UNION ALL
  SELECT CASE {cases} END AS run, * EXCLUDE (no) FROM f0 WHERE side = 'cur'),
"""
    # The same statistics keyed by (run, feature): both columns stand for the feature throughout.
    body = (body.replace("UNPIVOT f ON", "UNPIVOT (SELECT * EXCLUDE (label, lang) FROM f) ON").replace("SELECT side, feature, value FROM (UNPIVOT", "SELECT side, run || '/' || feature AS feature, value FROM (UNPIVOT"))
    body = body[:body.index("ld AS (")]
    label = """lc AS (SELECT run, label, CAST(count(*) FILTER (WHERE side = 'ref') AS DOUBLE) AS r, CAST(count(*) FILTER (WHERE side = 'cur') AS DOUBLE) AS c
  FROM f WHERE label IS NOT NULL GROUP BY run, label),
ls AS (SELECT run, max(d) AS label_shift FROM (SELECT run, r, c, abs(c / sum(c) OVER w - r / sum(r) OVER w) AS d FROM lc WINDOW w AS (PARTITION BY run))
  WHERE r > 0 AND c > 0 GROUP BY run),
per AS (SELECT split_part(feature, '/', 1) AS run, max(n_cur) AS current_samples, count(*) AS n_features,
  count(*) FILTER (WHERE drifted) AS n_drifted, max(ks_statistic) AS max_ks, max(psi) AS max_psi,
  array_to_string(list_sort(list(split_part(feature, '/', 2)) FILTER (WHERE drifted)), ',') AS drifted_features
  FROM fd JOIN n USING (feature) GROUP BY 1),
runs AS (SELECT per.*, run_time, label_shift, coalesce(label_shift > 0.15, false) AS label_drifted,
  (n_drifted + CAST(coalesce(label_shift > 0.15, false) AS INTEGER)) / greatest(n_features, 1) AS drift_share
  FROM per JOIN times USING (run) LEFT JOIN ls USING (run)),
h AS (SELECT *, row_number() OVER w AS run_no, lag(drift_share) OVER w AS previous FROM runs WINDOW w AS (ORDER BY run_time, run))"""
    return with_views(f + body + label, "texts") + f"""
SELECT run, run_time, CAST(current_samples AS BIGINT) AS current_samples, CAST(n_features AS BIGINT) AS n_features,
  CAST(n_drifted AS BIGINT) AS n_drifted, round(max_ks, {R9}) AS max_ks, round(max_psi, {R9}) AS max_psi, coalesce(drifted_features, '') AS drifted_features,
  round(label_shift, {R9}) AS label_shift, label_drifted, round(drift_share, {R9}) AS drift_share, drift_share > 0.3 AS overall_drift_detected,
  CAST(run_no AS INTEGER) AS run_no, round(previous, {R9}) AS previous,
  round(regr_slope(drift_share, run_no) OVER s, {R9}) AS trend, round(drift_share - previous, {R9}) AS change,
  CAST(run_no - max(CASE WHEN drift_share > 0.3 THEN 0 ELSE run_no END) OVER s AS INTEGER) AS drift_streak
FROM h WINDOW s AS (ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@register("d14_drift_runs", _runs_sql())
def d14_drift_runs(spark, sf_dir):
    """Three drift runs over slices of the current side, with change, trend and streak from run to run."""
    no = F.substring("source", 4, 10).cast("int")
    own = F.array().cast("array<string>")
    for run, (_, lo, hi) in RUNS.items():
        own = F.when(no.between(lo, hi), F.array(F.lit(run))).otherwise(own)
    every = F.array(*[F.lit(run) for run in RUNS])
    found = D.drift_runs(_tagged(spark, sf_dir).withColumn("runs", F.when(F.col("side") == D.REF, every).otherwise(own)), FEATURES)
    time = F.lit(None).cast("timestamp_ntz")
    for run, (t, _, _) in RUNS.items():
        time = F.when(F.col("run") == run, F.lit(t).cast("timestamp_ntz")).otherwise(time)
    h = D.drift_history(found.withColumn("run_time", time)).withColumn("drifted_features", F.array_join("drifted_features", ","))
    return h.withColumns({c: F.round(c, R9) for c in ("max_ks", "max_psi", "label_shift", "drift_share", "previous", "trend", "change")})
