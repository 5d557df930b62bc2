"""Log ingestion: validate, label, featurize, check quality, merge-dedupe.

Every step is a lazy DataFrame transform; the only plan-time decisions are the ones the
original makes on column presence (required columns, label source, master alignment),
which here inspect ``df.columns`` / ``df.schema`` and never touch the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .history import first_per_key
from .ordered import percentiles


class MissingColumns(ValueError):
    """A required column is absent."""


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Plan-time contract on the input schema."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing required columns: {missing}")
    return df


def length_filter(df: DataFrame, text: str = "text", lo: int = 3, hi: int = 5000) -> DataFrame:
    """Keep texts with lo ≤ length ≤ hi."""
    n = F.length(F.col(text))
    return df.filter((n >= lo) & (n <= hi))


def resolve_labels(df: DataFrame, mode: str = "dataset") -> DataFrame:
    """Choose the label source and record it in ``label_source`` (quirk Q4).

    ``dataset``: when a ``verified_label`` column exists every row without one is dropped,
    even if it has a prediction; otherwise predictions are used.  ``per_row``: human label
    when present, else the model's.
    """
    has_v, has_p = "verified_label" in df.columns, "prediction" in df.columns
    if not (has_v or has_p):
        raise MissingColumns("need verified_label or prediction")
    if mode == "per_row" and has_v and has_p:
        v, p = F.col("verified_label"), F.col("prediction")
        return (df.filter(v.isNotNull() | p.isNotNull())
                .withColumns({"label": F.coalesce(v, p).cast("int"),
                              "label_source": F.when(v.isNotNull(), "human").otherwise("model")}))
    src, name = ("verified_label", "human") if has_v else ("prediction", "model")
    return (df.filter(F.col(src).isNotNull())
            .withColumns({"label": F.col(src).cast("int"), "label_source": F.lit(name)}))


def sample_gate(df: DataFrame, minimum: int = 10) -> DataFrame:
    """One status row — number of rows and whether the minimum is met."""
    return df.agg(F.count(F.lit(1)).alias("n")).withColumn("passed", F.col("n") >= minimum)


def add_ingested_at(df: DataFrame, as_of) -> DataFrame:
    """P5: ingestion time as a literal (every operator takes ``as_of``; no ``now()``)."""
    return df.withColumn("ingested_at", F.lit(as_of).cast("timestamp_ntz"))


# FIXED VALUES: the history columns a log may lack and the value each gets then.
HISTORY_DEFAULTS = {
    "user_bad_ratio_7d": 0.0, "user_bad_ratio_30d": 0.0, "user_toxicity_trend": 0.0, "user_msg_count_7d": 0,
    "channel_toxicity_ratio": 0.0, "hours_since_last_msg": 1.0, "is_new_to_channel": 0, "user_report_count": 0,
}
HISTORY_DEFAULT_NAMES = list(HISTORY_DEFAULTS)
_COUNTS = ("user_msg_count_7d", "user_report_count")


def fill_missing_history(df: DataFrame, defaults: Mapping[str, float] = HISTORY_DEFAULTS) -> DataFrame:
    """Add absent history columns with their default."""
    add = {c: F.lit(v).cast("bigint") if c in _COUNTS else F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(add) if add else df


def fill_numeric(df: DataFrame, value=0) -> DataFrame:
    """Fill nulls in numeric columns only (text stays null, quirk Q3)."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.fillna(value, subset=num) if num else df


def common_columns(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Project both sides onto their shared columns (in ``a``'s order)."""
    shared = [c for c in a.columns if c in set(b.columns)]
    return a.select(*shared), b.select(*shared)


def align_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Master column order and types; absent string columns → null, others → 0."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(0).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def dedupe_first(df: DataFrame, key: str | Sequence[str], order: Sequence[tuple[Column, bool]]) -> DataFrame:
    """Keep the first row per key (aggregate form, skew-safe)."""
    return first_per_key(df, key, order)


def ensure_hash(df: DataFrame, text: str = "text", col: str = "text_hash") -> DataFrame:
    """Q6: a null hash would collapse all such rows into one; compute md5(text) instead."""
    if col in df.columns:
        return df.withColumn(col, F.coalesce(F.col(col), F.md5(F.col(text))))
    return df.withColumn(col, F.md5(F.col(text)))


def merge_dedupe(master: DataFrame, new: DataFrame, key: str | Sequence[str],
                 order: Sequence[tuple[Column, bool]] = ()) -> DataFrame:
    """Master ∪ aligned new batch; per key the new side wins, then ``order`` decides.

    Re-running the same batch is idempotent: the batch's rows win again and equal themselves.
    """
    aligned = align_to(new, master.schema)
    both = master.withColumn("__is_new", F.lit(0)).unionByName(aligned.withColumn("__is_new", F.lit(1)))
    picked = first_per_key(both, key, [(F.col("__is_new"), False), *order])
    return picked.drop("__is_new")


# --- quality checks ----------------------------------------------------------------------

def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """A2: share of rows per class (group sizes over the grand total, one small shuffle)."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(_all()))


def _all():
    from pyspark.sql import Window
    return Window.partitionBy(F.lit(0))


def positive_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """A3: negatives / positives, the positive-class weight."""
    return df.agg(F.try_divide(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("pos_weight"))


def quality_report(df: DataFrame, label: str = "label", key_features=("msg_len", "caps_ratio", "slur_count"),
                   max_null_ratio: float = 0.3, col_null_ratio: float = 0.2, minority_min: float = 0.1,
                   outlier_share: float = 0.05, **ranges) -> DataFrame:
    """Every check as a row (check, column, value, threshold, failed).

    One pass over the batch: its cells become one count table with a row per (column, null or not,
    value); only key features and the label keep their values there, any other column has at
    most two rows.  Null ratios, value ranges, class balance, the exact q99 (selection over value ranges)
    and the rows above it all come from that table.
    """
    cols = df.columns
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    feats = [c for c in key_features if c in cols]
    none = F.lit(None).cast("double")

    def cell(kind, c):
        number = F.col(c).cast("double") if c in numeric else none
        return F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("column"), F.col(c).isNull().alias("empty"),
                        (F.col(c).cast("double") if kind == "key" else F.col(c).cast("string").cast("double") if kind == "class" else none).alias("value"),
                        number.alias("number"))
    cells = [cell("key" if c in feats else "any", c) for c in cols] + [cell("class", label)]
    s = (df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").groupBy("kind", "column", "empty", "value")
         .agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("lo"), F.max("number").alias("hi")))
    # Every branch refers to all three aggregates, so that they share one exchange.
    s = s.filter(F.col("n") + F.coalesce(F.col("hi") - F.col("lo"), F.lit(0.0)) > 0)
    null = F.lit(None).cast("string")

    def rows(frame, check, value, threshold, column=None):
        return frame.select(F.lit(check).alias("check"), (F.col("column") if column is None else column).alias("column"),
                            value.cast("double").alias("value"), F.lit(threshold).cast("double").alias("threshold"))

    per = s.filter(F.col("kind") != "class").groupBy("column").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("empty"), F.col("n")).otherwise(0)).alias("nulls"),
        (F.max("hi") - F.min("lo")).alias("range"))
    held = s.filter((F.col("kind") == "key") & ~F.col("empty"))
    q99 = percentiles(held, ["column"], "value", "n", [0.99], **ranges).select("column", F.col("percentile").alias("q99"))
    total = per.select("column", F.col("n").alias("all"))
    above = (held.join(F.broadcast(q99), "column").groupBy("column")
             .agg(F.sum(F.when(F.col("value") > F.col("q99"), F.col("n")).otherwise(0)).alias("out"), F.first("q99").alias("q99"))
             .join(F.broadcast(total), "column"))
    classes = s.filter(F.col("kind") == "class")
    # An empty batch has no cells: its checks have null values and do not fail.
    names = df.sparkSession.createDataFrame([(c, c in numeric, c in feats) for c in cols], "column string, numeric boolean, key boolean")
    per = names.join(per, "column", "left").join(above.select("column", "out", "q99"), "column", "left")
    out = rows(per.agg(F.try_divide(F.sum("nulls"), F.sum("n")).alias("v")), "null_ratio_mean", F.col("v"), max_null_ratio, null)
    checks = F.array(
        F.struct(F.lit("column_null_ratio").alias("check"), F.try_divide("nulls", "n").alias("value"), F.lit(float(col_null_ratio)).alias("threshold"), F.lit(True).alias("on")),
        F.struct(F.lit("value_range").alias("check"), F.col("range").alias("value"), F.lit(0.0).alias("threshold"), F.col("numeric").alias("on")),
        F.struct(F.lit("q99").alias("check"), F.col("q99").alias("value"), none.alias("threshold"), F.col("key").alias("on")),
        F.struct(F.lit("outlier_share").alias("check"), F.try_divide(F.coalesce("out", F.lit(0)), F.col("n")).alias("value"), F.lit(float(outlier_share)).alias("threshold"), F.col("key").alias("on")))
    each = per.select("column", F.explode(checks).alias("x")).filter("x.on").select("x.check", "column", "x.value", "x.threshold")
    minority = rows(classes.agg(F.try_divide(F.min("n"), F.sum("n")).alias("v")), "minority_ratio", F.col("v"), minority_min, F.lit(label))
    out = out.unionByName(each).unionByName(minority)
    failed = (F.when(F.col("check") == "minority_ratio", F.col("value") < F.col("threshold"))
              .when(F.col("check") == "value_range", F.col("value") == F.col("threshold"))
              .when(F.col("check") == "q99", F.lit(False))
              .otherwise(F.col("value") > F.col("threshold")))
    return out.withColumn("failed", F.coalesce(failed, F.lit(False)))


def prepare_batch(raw: DataFrame, as_of, text: str = "text", user: str = "user_id", lo: int = 3, hi: int = 5000) -> DataFrame:
    """The ingestion pipeline for raw log rows: P1 contract, P2 lengths, P3 labels, P5 time, hash, O4 first per hash, features,
    P6 history defaults and H10 user statistics; numeric nulls become 0 (P7)."""
    from ..functions.text import feature_columns
    from .history import group_stats_onto_rows
    b = length_filter(require_columns(raw, [text, user]), text, lo, hi)
    b = ensure_hash(add_ingested_at(resolve_labels(b), as_of), text)
    by_time = [(F.unix_micros(F.col("ts").cast("timestamp")), False)] if "ts" in raw.columns else [(F.xxhash64(text, user), True)]
    b = dedupe_first(b, "text_hash", by_time)
    b = fill_missing_history(b.withColumns(feature_columns(text)))
    return fill_numeric(group_stats_onto_rows(b, user, "label", "user_msg_count_total", "user_toxicity_rate"))


#: Checks whose failure keeps a batch out; the others are warnings.
BLOCKING = ("null_ratio_mean", "minority_ratio")


def quality_failed(batch: DataFrame, blocking: Sequence[str] = BLOCKING, **limits) -> bool:
    """Whether a blocking check of the quality report failed (one small aggregate)."""
    return quality_report(batch, **limits).filter(F.col("check").isin(*blocking) & F.col("failed")).limit(1).count() > 0


def merge_summary(master: DataFrame, new: DataFrame, key: str = "text_hash") -> DataFrame:
    """A10 without merging: the merge keeps one row per key (null is one key), so its size is the number of keys.

    Each side is read once, for its key; one aggregate per key, then one row.
    """
    both = master.select(key, F.lit(0).alias("__new")).unionByName(new.select(key, F.lit(1).alias("__new")))
    per = both.groupBy(key).agg(F.count_if(F.col("__new") == 0).alias("m"), F.count_if(F.col("__new") == 1).alias("n"))
    out = per.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("master_size_before"), F.coalesce(F.sum("n"), F.lit(0)).alias("new_samples"),
                  F.count(F.lit(1)).alias("master_size_after"))
    return out.withColumn("duplicates_removed", F.col("master_size_before") + F.col("new_samples") - F.col("master_size_after"))


def ingestion_summary(master: DataFrame, new: DataFrame, merged: DataFrame) -> DataFrame:
    """A10: new rows, master size before and after, duplicates removed — one aggregate, one row."""
    tagged = (master.select(F.lit(0).alias("__s")).unionByName(new.select(F.lit(1).alias("__s")))
              .unionByName(merged.select(F.lit(2).alias("__s"))))
    out = tagged.agg(F.count_if(F.col("__s") == 0).alias("master_size_before"),
                     F.count_if(F.col("__s") == 1).alias("new_samples"),
                     F.count_if(F.col("__s") == 2).alias("master_size_after"))
    return out.withColumn("duplicates_removed",
                          F.col("master_size_before") + F.col("new_samples") - F.col("master_size_after"))
