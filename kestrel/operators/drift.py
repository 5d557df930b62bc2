"""Drift detection between a reference and a current data set.

Both sides are unpivoted into ``(side, feature, value)`` and reduced once to a count table, one row per
(feature, distinct value) with its rows on either side.  Every statistic is derived from that
table; running sums and percentiles over its values are split into ranges (``ordered``), so no
task holds a whole feature.  Per-feature statistics are tiny tables joined back with a
broadcast whose size is the number of features (times runs), fixed when the plan is built.  Nothing here
starts a job while a plan is built.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import percentiles, running_sums

REF, CUR = "ref", "cur"
EPS_PSI = 1e-10
N_BINS = 10
FEATURE = ("feature",)


def unpivot(ref: DataFrame, cur: DataFrame, features: Sequence[str], keep_nulls: bool = False) -> DataFrame:
    """(side, feature, value) over both data sets; nulls are dropped, as the tests do, unless kept."""
    def one(df, side):
        d = df.select(*[F.col(f).cast("double").alias(f) for f in features]).withColumn("side", F.lit(side))
        return d.unpivot("side", list(features), "feature", "value")
    both = one(ref, REF).unionByName(one(cur, CUR))
    return both if keep_nulls else both.filter(F.col("value").isNotNull())


def unpivot_sides(df: DataFrame, features: Sequence[str], keep_nulls: bool = False, ids: Sequence[str] = ("side",)) -> DataFrame:
    """(ids, feature, value) of one frame whose ``side`` column tells reference from current: one read for both."""
    long = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(list(ids), list(features), "feature", "value")
    return long if keep_nulls else long.filter(F.col("value").isNotNull())


def _is(side: str) -> Column:
    return F.col("side") == side


def value_counts(long: DataFrame, by: Sequence[str] = FEATURE) -> DataFrame:
    """The one pass over rows: (feature, value) → rows on the reference (r) and current (c) side."""
    return long.groupBy(*by, "value").agg(F.count_if(_is(REF)).alias("r"), F.count_if(_is(CUR)).alias("c"))


def _counts(x: DataFrame) -> DataFrame:
    return x if "r" in x.columns else value_counts(x)


def side_counts(x: DataFrame, by: Sequence[str] = FEATURE) -> DataFrame:
    return _counts(x).groupBy(*by).agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))


def _cdf_gap() -> Column:
    return F.abs(F.try_divide(F.col("cr"), F.col("n_ref")) - F.try_divide(F.col("cc"), F.col("n_cur")))


def ks_statistic(long: DataFrame, by: Sequence[str] = FEATURE, **ranges) -> DataFrame:
    """Two-sample KS statistic, the largest gap of the two distribution functions.

    Running sums are taken range by range over the distinct values (``ordered.running_sums``).
    """
    g = _counts(long)
    d = running_sums(g, by, "value", {"cr": "r", "cc": "c"}, **ranges).join(F.broadcast(side_counts(g, by)), list(by))
    return d.groupBy(*by).agg(F.max(_cdf_gap()).alias("ks_statistic"), F.first("n_ref").alias("n_ref"),
                              F.first("n_cur").alias("n_cur"))


def kolmogorov_sf(lam: Column, terms: int = 100) -> Column:
    """Asymptotic Kolmogorov survival function 2 Σ (−1)^(k−1) exp(−2 k² λ²), clipped to [0, 1]."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(F.lit(-2.0) * k * k * lam * lam))
    p = F.lit(2.0) * series
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def ks_test(long: DataFrame, alpha: float = 0.05) -> DataFrame:
    """D1 + D2: statistic, asymptotic p-value and drift flag.

    The p-value uses the limiting distribution with λ = D·√(n·m/(n+m)); exact small-sample
    p-values are not reproduced (SURVEY §7.4).
    """
    ks = ks_statistic(long)
    en = F.try_divide(F.col("n_ref") * F.col("n_cur"), F.col("n_ref") + F.col("n_cur"))
    lam = F.col("ks_statistic") * F.sqrt(en)
    return ks.withColumn("ks_p_value", kolmogorov_sf(lam)).withColumn("ks_drifted", F.col("ks_p_value") < alpha)


def _bin_of(v: Column, lo: Column, hi: Column, bins: int = N_BINS) -> Column:
    """NumPy's equal-width bin of ``v`` on [lo, hi] (last bin right-closed); null outside."""
    step = (hi - lo) / F.lit(float(bins))

    def edge(i: Column) -> Column:
        return F.when(i == bins, hi).otherwise(i * step + lo)

    idx0 = F.floor((v - lo) * (F.lit(float(bins)) / (hi - lo)))
    i = F.when(idx0 == bins, bins - 1).otherwise(idx0)
    fixed = F.when(v < edge(i), i - 1).when((v >= edge(i + 1)) & (i != bins - 1), i + 1).otherwise(i)
    return F.when((v >= lo) & (v <= hi), fixed).cast("int")


def _feature_stats(g: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per feature: rows and sums of both sides and the reference's range (constant v → [v − .5, v + .5])."""
    is_r = F.col("r") > 0
    st = g.groupBy(*by).agg(
        F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"),
        F.min(F.when(is_r, F.col("value"))).alias("mn"), F.max(F.when(is_r, F.col("value"))).alias("mx"),
        F.sum(F.col("value") * F.col("r")).alias("sr"), F.sum(F.col("value") * F.col("c")).alias("sc"))
    return st.withColumns({"lo": F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")),
                           "hi": F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx"))}).drop("mn", "mx")


_SIDES = ("n_ref", "n_cur", "sr", "sc")


def _psi_term() -> Column:
    """A bin's share of PSI (ε = 1e-10, quirk Q14); null for the values outside all bins."""
    r = F.try_divide(F.col("rb"), F.col("n_ref")) + EPS_PSI
    c = F.try_divide(F.col("cb"), F.col("n_cur")) + EPS_PSI
    return F.when(F.col("bin").isNotNull(), (c - r) * F.log(c / r))


def psi(long: DataFrame, bins: int = N_BINS, by: Sequence[str] = FEATURE) -> DataFrame:
    """Population stability index per feature on ``bins`` equal-width bins of the reference's range.

    Bins empty on both sides add exactly 0, so no grid of bins is made.
    """
    g = _counts(long)
    d = g.join(F.broadcast(_feature_stats(g, by)), list(by))
    d = d.withColumn("bin", _bin_of(F.col("value"), F.col("lo"), F.col("hi"), bins))
    per_bin = d.groupBy(*by, "bin").agg(F.sum("r").alias("rb"), F.sum("c").alias("cb"), F.first("n_ref").alias("n_ref"),
                                        F.first("n_cur").alias("n_cur"))
    return per_bin.groupBy(*by).agg(F.coalesce(F.sum(_psi_term()), F.lit(0.0)).alias("psi"))


def mean_shift(long: DataFrame, eps: float = 1e-10, by: Sequence[str] = FEATURE) -> DataFrame:
    """|mean_cur − mean_ref| / (mean_ref + ε)."""
    m = _feature_stats(_counts(long), by)
    m = m.select(*by, F.try_divide("sr", "n_ref").alias("ref_mean"), F.try_divide("sc", "n_cur").alias("cur_mean"))
    return m.withColumn("mean_shift", F.try_divide(F.abs(F.col("cur_mean") - F.col("ref_mean")), F.col("ref_mean") + eps))


def drift_statistics(long: DataFrame, by: Sequence[str] = FEATURE, psi_threshold: float = 0.2, alpha: float = 0.05,
                     bins: int = N_BINS, **ranges) -> DataFrame:
    """D1–D6 fused: one row per feature with KS, PSI, means, mean shift and the verdict.

    ``long`` is (side, feature, value) or its count table.  Per-feature totals and the reference's range
    are one small aggregate, broadcast; running sums give the gap of the distribution functions and the
    same rows are binned; a (feature, bin) aggregate and then a per-feature one finish
    both statistics.
    """
    g = long if "r" in long.columns else value_counts(long, by)
    d = running_sums(g, by, "value", {"cr": "r", "cc": "c"}, **ranges).join(F.broadcast(_feature_stats(g, by)), list(by))
    d = d.withColumns({"kd": _cdf_gap(), "bin": _bin_of(F.col("value"), F.col("lo"), F.col("hi"), bins)})
    per_bin = d.groupBy(*by, "bin").agg(F.sum("r").alias("rb"), F.sum("c").alias("cb"), F.max("kd").alias("kd"),
                                        *[F.first(c).alias(c) for c in _SIDES])
    out = per_bin.groupBy(*by).agg(F.max("kd").alias("ks_statistic"), F.sum(_psi_term()).alias("psi"),
                                   *[F.first(c).alias(c) for c in _SIDES])
    en = F.try_divide(F.col("n_ref") * F.col("n_cur"), F.col("n_ref") + F.col("n_cur"))
    out = out.withColumns({"ks_p_value": kolmogorov_sf(F.col("ks_statistic") * F.sqrt(en)),
                           "ref_mean": F.try_divide("sr", "n_ref"), "cur_mean": F.try_divide("sc", "n_cur")})
    out = out.withColumns({"ks_drifted": F.col("ks_p_value") < alpha,
                           "mean_shift": F.try_divide(F.abs(F.col("cur_mean") - F.col("ref_mean")), F.col("ref_mean") + 1e-10)})
    return out.withColumn("drifted", F.col("ks_drifted") | (F.col("psi") > psi_threshold)).drop("sr", "sc")


def feature_drift(ref: DataFrame, cur: DataFrame, features: Sequence[str], psi_threshold: float = 0.2,
                  alpha: float = 0.05, bins: int = N_BINS) -> DataFrame:
    """D1–D6 of the named columns of two data sets (``drift_statistics``)."""
    return drift_statistics(unpivot(ref, cur, features), FEATURE, psi_threshold, alpha, bins)


QUARTILES = {0.25: "q25_value", 0.5: "median_value", 0.75: "q75_value"}


def data_quality(long: DataFrame, by: Sequence[str] = ("side", "feature"), **ranges) -> DataFrame:
    """Per side and feature — rows, missing, distinct, min, max, mean, population std and exact quartiles.

    ``long`` comes from ``unpivot(..., keep_nulls=True)``.  Quartiles are found by selection over value
    ranges, the variance around the mean by a second look at the count table.
    """
    g = long.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("k"))
    v, k = F.col("value"), F.col("k")
    st = g.groupBy(*by).agg(
        F.sum(F.when(v.isNotNull(), k).otherwise(0)).alias("n"), F.sum(F.when(v.isNull(), k).otherwise(0)).alias("missing"),
        F.count("value").alias("distinct_values"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.sum(v * k).alias("__s"))
    st = st.withColumns({"mean_value": F.try_divide("__s", "n"),
                         "missing_share": F.try_divide(F.col("missing"), F.col("n") + F.col("missing"))}).drop("__s")
    held = g.filter(v.isNotNull())
    around = (held.join(F.broadcast(st.select(*by, F.col("mean_value").alias("__m"), F.col("n").alias("__n"))), list(by))
              .groupBy(*by).agg(F.sqrt(F.sum(k * (v - F.col("__m")) * (v - F.col("__m"))) / F.first("__n")).alias("std_value")))
    q = percentiles(held, by, "value", "k", list(QUARTILES), **ranges)
    q = q.groupBy(*by).agg(*[F.max(F.when(F.col("p") == p, F.col("percentile"))).alias(name) for p, name in QUARTILES.items()])
    # One row per (side, feature) on every side of these joins.
    return st.join(around, list(by), "left").join(q, list(by), "left").select(
        *by, "n", "missing", "missing_share", "distinct_values", "min_value", "max_value", "mean_value", "std_value", *QUARTILES.values())


def missing_values(ref: DataFrame, cur: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values of any columns, per side and column: (side, column, missing, missing_share)."""
    def one(df, side):
        m = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"m_{i}") for i, c in enumerate(columns)])
        cells = [F.struct(F.lit(c).alias("column"), F.col(f"m_{i}").alias("missing"), F.try_divide(f"m_{i}", "n").alias("missing_share"))
                 for i, c in enumerate(columns)]
        return m.select(F.lit(side).alias("side"), F.explode(F.array(*cells)).alias("x")).select("side", "x.*")
    return one(ref, REF).unionByName(one(cur, CUR))


def label_shift(ref: DataFrame, cur: DataFrame, label: str = "label", threshold: float = 0.15,
                missing_as_zero: bool = False) -> DataFrame:
    """D7 + J9: max |share_cur − share_ref| over classes present on both sides (Q12)."""
    def dist(df, name):
        # Grouped to one row per class first; the total is a window over those few rows.
        d = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("k"))
        return d.select(label, (F.col("k") / F.sum("k").over(Window.partitionBy())).alias(name))
    how = "full" if missing_as_zero else "inner"
    j = dist(ref, "ref_share").join(dist(cur, "cur_share"), label, how)
    diff = F.abs(F.coalesce(F.col("cur_share"), F.lit(0.0)) - F.coalesce(F.col("ref_share"), F.lit(0.0)))
    return j.agg(F.max(diff).alias("label_shift")).withColumn("label_drifted", F.col("label_shift") > threshold)


def drift_summary(feat: DataFrame, lab: DataFrame | None, share_threshold: float = 0.3) -> DataFrame:
    """D8 + D13: drift share (label counted in the numerator only, Q13), overall flag, advice."""
    s = feat.agg(F.count(F.lit(1)).alias("n_features"), F.count_if("drifted").alias("n_drifted"),
                 F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("feature")))).alias("drifted_features"))
    if lab is not None:
        s = s.unionByName(lab.select(F.lit(0).cast("bigint").alias("n_features"),
                                     F.col("label_drifted").cast("int").cast("bigint").alias("n_drifted"),
                                     F.when(F.col("label_drifted"), F.array(F.lit("label_distribution")))
                                     .otherwise(F.array().cast("array<string>")).alias("drifted_features")))
        s = s.agg(F.sum("n_features").alias("n_features"), F.sum("n_drifted").alias("n_drifted"),
                  F.array_sort(F.flatten(F.collect_list("drifted_features"))).alias("drifted_features"))
    share = F.col("n_drifted") / F.greatest(F.col("n_features"), F.lit(1))
    return s.withColumn("drift_share", share).withColumns({
        "overall_drift_detected": F.col("drift_share") > share_threshold,
        "recommendation": F.when(F.col("drift_share") > share_threshold, "retrain_recommended")
                           .otherwise("no_action_needed")})


def chi_square_columns(ref: DataFrame, cur: DataFrame, columns: Sequence[str]) -> DataFrame:
    """D3 (+J8): two-sample homogeneity χ² of categorical columns: (column, chi2_statistic, dof) (Q23).

    All columns go through one count table.  Null is a category of its own, on whichever side it
    occurs.  An empty side has no expected counts: the statistic is null then.
    """
    def one(df, side):
        d = df.select(F.lit(side).alias("side"), *[F.col(c).cast("string").alias(c) for c in columns])
        return d.unpivot("side", list(columns), "column", "v")
    t = one(ref, REF).unionByName(one(cur, CUR)).groupBy("column", "v").agg(
        F.count_if(_is(REF)).alias("o_ref"), F.count_if(_is(CUR)).alias("o_cur"))
    tot = t.groupBy("column").agg(F.sum("o_ref").alias("n_ref"), F.sum("o_cur").alias("n_cur"))  # one row per column
    j = t.join(F.broadcast(tot), "column")
    n = F.col("n_ref") + F.col("n_cur")
    row = F.col("o_ref") + F.col("o_cur")
    e_ref, e_cur = F.try_divide(row * F.col("n_ref"), n), F.try_divide(row * F.col("n_cur"), n)
    term = F.try_divide(F.pow(F.col("o_ref") - e_ref, 2), e_ref) + F.try_divide(F.pow(F.col("o_cur") - e_cur, 2), e_cur)
    return j.groupBy("column").agg(F.sum(term).alias("chi2_statistic"), (F.count(F.lit(1)) - 1).alias("dof"))


def chi_square(ref: DataFrame, cur: DataFrame, column: str) -> DataFrame:
    """D3 on one column: statistic and degrees of freedom."""
    return chi_square_columns(ref, cur, [column]).drop("column")


def quick_drift(ref: DataFrame, cur: DataFrame, features: Sequence[str], label: str = "label",
                label_threshold: float = 0.1, mean_threshold: float = 0.3, eps: float = 1e-8) -> DataFrame:
    """Batch-vs-master label-rate change and relative mean change per feature, one union-aggregate."""
    u = (ref.select(F.lit(REF).alias("side"), F.col(label).cast("double").alias(label), *features)
         .unionByName(cur.select(F.lit(CUR).alias("side"), F.col(label).cast("double").alias(label), *features)))
    aggs = []
    for f in [label, *features]:
        aggs += [F.avg(F.when(_is(REF), F.col(f))).alias(f"r__{f}"), F.avg(F.when(_is(CUR), F.col(f))).alias(f"c__{f}")]
    m = u.agg(*aggs)
    rows = [F.struct(F.lit(label).alias("feature"), F.abs(F.col(f"c__{label}") - F.col(f"r__{label}")).alias("change"),
                     F.lit(label_threshold).alias("threshold"))]
    rows += [F.struct(F.lit(f).alias("feature"),
                      (F.abs(F.col(f"c__{f}") - F.col(f"r__{f}")) / (F.col(f"r__{f}") + eps)).alias("change"),
                      F.lit(mean_threshold).alias("threshold")) for f in features]
    out = m.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumn("drifted", F.col("change") > F.col("threshold"))


def _words(df: DataFrame, keys: Sequence[str], text: str, distinct: bool = False, name: str = "token") -> DataFrame:
    """(keys, ``name``): lower-cased tokens of whole texts, a row for each occurrence, or for each token of a row."""
    from ..functions.lexicons import WS_CLASS_ASCII, WS_CLASS_JAVA
    low = df.select(*keys, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__low"))
    # Most texts are ASCII, where the class is one table look-up a character.
    words = F.when(F.length("__low") == F.octet_length("__low"), F.split("__low", f"[{WS_CLASS_ASCII}]+")).otherwise(
        F.split("__low", f"[{WS_CLASS_JAVA}]+"))
    return low.select(*keys, F.explode(F.array_distinct(words) if distinct else words).alias(name)).filter(F.col(name) != "")


def tokens(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Lower-cased tokens of whole texts, one row per (id, token) occurrence."""
    return _words(df, [id_col], text)


def vocabulary(ref: DataFrame, id_col: str, text: str, min_count: int = 2) -> DataFrame:
    """vocabulary = tokens of the reference side seen at least ``min_count`` times."""
    return (tokens(ref, id_col, text).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_count).select("token"))


def oov_share(df: DataFrame, id_col: str, text: str, vocab: DataFrame) -> DataFrame:
    """per text, share of tokens outside the vocabulary; texts without tokens have no row.

    Occurrences are exchanged once, on the token, and looked up in a hash table of that part of the
    vocabulary, so they are not sorted; adaptive execution splits the part of a frequent token.
    """
    j = tokens(df, id_col, text).join(vocab.withColumn("__in", F.lit(1)).hint("shuffle_hash"), "token", "left")
    return j.groupBy(id_col).agg((F.count_if(F.col("__in").isNull()) / F.count(F.lit(1))).alias("oov_share"))


def lexicon_score(df: DataFrame, id_col: str, text: str, lexicon: DataFrame) -> DataFrame:
    """F23 (re-aimed sentiment): sum of (word, weight) lexicon weights over a text's tokens."""
    j = tokens(df, id_col, text).join(lexicon.withColumnRenamed("word", "token").hint("shuffle_hash"), "token", "inner")
    return j.groupBy(id_col).agg(F.sum("weight").alias("lexicon_score"))


def lexicon_from_labels(texts: DataFrame, id_col: str, text: str, label: str, min_texts: int = 5) -> DataFrame:
    """a (word, weight) lexicon from labelled texts, for words that at least ``min_texts`` of them hold.

    Weight: share of the clean texts that hold the word less the share of the toxic ones, to six decimals.
    A word counts once for each (id, label).  Rows are exchanged whole to see which ids repeat; only the
    words of those are compared across rows, all others are distinct within their row already.
    """
    known = texts.filter(F.col(label).isNotNull())
    sizes = known.agg(F.struct(F.count_if(F.col(label) == 0).alias("clean"), F.count_if(F.col(label) == 1).alias("toxic")).alias("s")).scalar()
    rows = known.select(id_col, label, text).withColumn("__rows", F.count(F.lit(1)).over(Window.partitionBy(id_col, label)))
    once = _words(rows.filter(F.col("__rows") == 1), [label], text, True, "word")
    again = _words(rows.filter(F.col("__rows") > 1), [id_col, label], text, True, "word").distinct()
    per = once.unionByName(again.drop(id_col)).groupBy("word").agg(
        F.count_if(F.col(label) == 0).alias("clean"), F.count_if(F.col(label) == 1).alias("toxic"), F.count(F.lit(1)).alias("n"))
    share = [F.coalesce(F.try_divide(F.col(c), F.col(f"__sizes.{c}")), F.lit(0.0)) for c in ("clean", "toxic")]
    return (per.filter(F.col("n") >= min_texts).withColumn("__sizes", sizes)
            .select("word", F.round(share[0] - share[1], 6).cast("decimal(18,6)").alias("weight")))


def token_descriptors(texts: DataFrame, id_col: str, text: str, lexicon: DataFrame, min_count: int = 2) -> DataFrame:
    """F22 + F23 of both sides in one pass: (id, side, oov_share, lexicon_score), a row for every text.

    ``texts`` has a ``side`` column; ids are unique.  Weights are taken to six decimals and summed exactly, so
    that equal texts score alike.  The vocabulary (tokens of the reference side seen at least
    ``min_count`` times) and the lexicon are one table of token facts, looked up once for every
    occurrence (as in ``oov_share``).  A text without tokens has share and score 0.
    """
    known = _words(texts.filter(_is(REF)), [], text).groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    zero = F.lit(0).cast("decimal(18,6)")
    facts = known.select("token", F.lit(1).alias("known"), zero.alias("weight")).unionByName(
        lexicon.select(F.col("word").alias("token"), F.lit(0).alias("known"), F.col("weight").cast("decimal(18,6)").alias("weight")))
    facts = facts.groupBy("token").agg(F.max("known").alias("known"), F.sum("weight").cast("decimal(18,6)").alias("weight"))
    one = F.lit(1).cast("long")
    seen = _words(texts, [id_col, "side"], text).join(facts.hint("shuffle_hash"), "token", "left").select(
        id_col, "side", one.alias("k"), F.when(F.col("known") == 1, 0).otherwise(one).alias("out"), F.coalesce("weight", zero).alias("w"))
    every = texts.select(id_col, "side", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("out"), zero.alias("w"))
    return seen.unionByName(every).groupBy(id_col, "side").agg(
        F.coalesce(F.try_divide(F.sum("out"), F.sum("k")), F.lit(0.0)).alias("oov_share"), F.sum("w").cast("double").alias("lexicon_score"))


# --- χ² p-values without scipy: regularized upper incomplete gamma as column expressions -----

# Lanczos approximation (g = 7, nine coefficients) — standard published constants.
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
            -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6,
            1.5056327351493116e-7]


def lgamma(x: Column) -> Column:
    """log Γ(x) for x ≥ 0.5 (Lanczos)."""
    z = x - 1
    a = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], start=1):
        a = a + F.lit(c) / (z + i)
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(a)


def _log_pref(s: Column, x: Column) -> Column:
    """log(x^s e^-x / Γ(s)); for large s by Stirling's series, whose parts do not cancel."""
    mu = (x - s) / s
    inv = F.lit(1.0) / s
    stirling = (-s * (mu - F.log1p(mu)) + 0.5 * F.log(s / (2 * math.pi))
                - inv / 12 + inv * inv * inv / 360 - inv * inv * inv * inv * inv / 1260)
    return F.when(s < 50, -x + s * F.log(x) - lgamma(s)).otherwise(stirling)


def gamma_q(s: Column, x: Column) -> Column:
    """Q(s, x) = Γ(s, x) / Γ(s): series for x < s + 1, Lentz continued fraction otherwise.

    Both need about √s steps: the n-th term is at most exp(-n²/2s), so that with 300 + 10√s of
    them what is left out is below the precision of a double at any s.
    """
    pref = F.exp(_log_pref(s, x))
    seq = F.sequence(F.lit(1).cast("long"), F.lit(300).cast("long") + F.ceil(10 * F.sqrt(s)))
    series = F.aggregate(seq, F.struct((F.lit(1.0) / s).alias("term"), (F.lit(1.0) / s).alias("sum")),
                         lambda acc, n: F.struct((acc["term"] * x / (s + n)).alias("term"),
                                                 (acc["sum"] + acc["term"] * x / (s + n)).alias("sum")))
    p_series = series["sum"] * pref
    tiny = F.lit(1e-300)

    def step(acc, i):
        an = -i * (i - s)
        b = acc["b"] + 2
        d = an * acc["d"] + b
        d = F.when(F.abs(d) < 1e-300, tiny).otherwise(d)
        c = b + an / acc["c"]
        c = F.when(F.abs(c) < 1e-300, tiny).otherwise(c)
        d = F.lit(1.0) / d
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))
    b0 = x + 1 - s
    cf = F.aggregate(seq, F.struct(b0.alias("b"), (F.lit(1.0) / tiny).alias("c"), (F.lit(1.0) / b0).alias("d"),
                                   (F.lit(1.0) / b0).alias("h")), step)
    q = F.when(x < s + 1, F.lit(1.0) - p_series).otherwise(cf["h"] * pref)
    return F.when(x <= 0, F.lit(1.0)).otherwise(F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)))


def chi2_sf(stat: Column, dof: Column) -> Column:
    """Survival function of the χ² distribution."""
    return gamma_q(dof / 2.0, stat / 2.0)


def dataset_drift(ref: DataFrame, cur: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                  alpha: float = 0.05, share_threshold: float = 0.3) -> DataFrame:
    """Per column — KS for numeric, χ² homogeneity for categorical — with p-values and a
    dataset verdict (share of drifted columns above the threshold) on every row."""
    parts = []
    if numeric:
        ks = feature_drift(ref, cur, numeric, alpha=alpha)  # the fused one-pass KS
        parts.append(ks.select(F.col("feature").alias("column"), F.lit("ks").alias("test"),
                               F.col("ks_statistic").alias("statistic"), F.col("ks_p_value").alias("p_value")))
    if categorical:
        x = chi_square_columns(ref, cur, categorical)
        parts.append(x.select("column", F.lit("chi2").alias("test"), F.col("chi2_statistic").alias("statistic"),
                              chi2_sf(F.col("chi2_statistic"), F.col("dof").cast("double")).alias("p_value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("drifted", F.col("p_value") < alpha)
    everything = Window.partitionBy()  # over the per-column result (one row per column)
    share = F.avg(F.col("drifted").cast("double")).over(everything)
    return out.withColumns({"drift_share": share, "dataset_drift": share > share_threshold})


# --- D14: drift over runs ---------------------------------------------------------------------

def drift_runs(rows: DataFrame, features: Sequence[str], label: str = "label", runs: str = "runs",
               psi_threshold: float = 0.2, alpha: float = 0.05, share_threshold: float = 0.3,
               label_threshold: float = 0.15) -> DataFrame:
    """One summary row per run, each run's data against the same reference, in one read.

    ``rows`` has a ``side`` column and in ``runs`` the array of the runs that a row counts for: all of them for a row of the
    reference, its own for a current one.  All runs go through one count table keyed by (run, feature).
    """
    wide = rows.withColumns({"run": F.explode(runs), "__label": F.col(label)})
    g = unpivot_sides(wide, [*features, "__label"], ids=("run", "side"))
    by = ("run", "feature")
    g = value_counts(g, by)
    fd = drift_statistics(g.filter(F.col("feature") != "__label"), by, psi_threshold, alpha)
    per_run = fd.groupBy("run").agg(
        F.max("n_cur").alias("current_samples"), F.count(F.lit(1)).alias("n_features"), F.count_if("drifted").alias("n_drifted"),
        F.max("ks_statistic").alias("max_ks"), F.max("psi").alias("max_psi"),
        F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("feature")))).alias("drifted_features"))
    in_run = Window.partitionBy("run")                              # one row per class and run
    lab = g.filter(F.col("feature") == "__label").withColumns(
        {"__r": F.try_divide(F.col("r"), F.sum("r").over(in_run)), "__c": F.try_divide(F.col("c"), F.sum("c").over(in_run))})
    lab = lab.filter((F.col("r") > 0) & (F.col("c") > 0)).groupBy("run").agg(F.max(F.abs(F.col("__c") - F.col("__r"))).alias("label_shift"))
    out = per_run.join(lab, "run", "left").withColumn("label_drifted", F.coalesce(F.col("label_shift") > label_threshold, F.lit(False)))
    out = out.withColumn("drift_share", (F.col("n_drifted") + F.col("label_drifted").cast("int")) / F.greatest(F.col("n_features"), F.lit(1)))
    return out.withColumn("overall_drift_detected", F.col("drift_share") > share_threshold)


def drift_history(runs: DataFrame, run_time: str = "run_time", score: str = "drift_share", run: str = "run") -> DataFrame:
    """Runs in order of time with the change against the run before, the trend and the streak.

    Trend: least-squares slope of ``score`` over the numbers of the runs so far.  Streak: how many runs in
    succession, up to this one, found drift.  One row per run: the ordered windows are over a small table.
    """
    w = Window.orderBy(run_time, run)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = runs.withColumn("run_no", F.row_number().over(w))
    d = d.withColumns({
        "previous": F.lag(score).over(w),
        "trend": F.regr_slope(F.col(score), F.col("run_no").cast("double")).over(so_far),
        "__calm": F.max(F.when(~F.col("overall_drift_detected"), F.col("run_no")).otherwise(0)).over(so_far)})
    return d.withColumns({"change": F.col(score) - F.col("previous"), "drift_streak": F.col("run_no") - F.col("__calm")}).drop("__calm")


def append_runs(summary: DataFrame, path: str, run: str = "run") -> None:
    """Add runs to the table of runs at ``path``, one partition a run; a repeated run replaces itself."""
    summary.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)
