"""File scans with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CORPUS_SCHEMA = "Message STRING, Label INT"


def read_corpus_csv(spark: SparkSession, path: str) -> DataFrame:
    """Corpus CSV (Message, Label) → (text, label); quoted fields may span lines."""
    df = (spark.read.schema(CORPUS_SCHEMA).option("header", True).option("multiLine", True)
          .option("escape", '"').csv(path))
    return df.withColumnsRenamed({"Message": "text", "Label": "label"})


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str,
               corrupt_col: str = "_corrupt_record") -> tuple[DataFrame, DataFrame]:
    """S3: JSON lines, tolerant: returns (good rows, quarantined raw lines).

    A missing path yields two empty DataFrames instead of an error.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    full = StructType(list(schema.fields))
    if corrupt_col not in full.fieldNames():
        full = full.add(corrupt_col, "string")
    # Text lines parsed with from_json: malformed lines keep their raw text in the corrupt column.
    try:
        lines = spark.read.text(path)
    except Exception as e:  # noqa: BLE001 — Spark raises AnalysisException for absent paths
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
        lines = spark.createDataFrame([], "value string")
    parsed = (lines.filter(F.trim("value") != "")
              .select(F.from_json("value", full, {"mode": "PERMISSIVE",
                                                   "columnNameOfCorruptRecord": corrupt_col}).alias("r"))
              .select("r.*"))
    good = parsed.filter(F.col(corrupt_col).isNull()).drop(corrupt_col)
    bad = parsed.filter(F.col(corrupt_col).isNotNull()).select(corrupt_col)
    return good, bad


def union_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of sources of different columns, aligned by name; a column that a source lacks is null there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def union_sources(spark: SparkSession, paths: Sequence[str], schema: StructType | str) -> DataFrame:
    """Union of every readable source, columns aligned by name (missing → null)."""
    found = [read_jsonl(spark, p, schema)[0] for p in paths]
    return union_frames(found) if found else read_jsonl(spark, "/nonexistent-path", schema)[0]


LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),(\d{3}) - (\S+) - (\w+) - (.*)$"
REQUEST = r"^(\w+) (\S+) - Status: (\d+) - Duration: ([0-9.]+)s$"


def read_service_log(spark: SparkSession, path: str) -> DataFrame:
    """``ts - logger - level - message`` lines; continuation lines attach to their entry.

    A large file is read in many blocks (splits of ``spark.sql.files.maxPartitionBytes``).  Within its
    block, a continuation takes the last timestamped line before it; the entry that a block ends in, one row
    per block, is carried into the next block as one more row.  So a file is as many tasks as it has blocks,
    and lines are exchanged once, on (file, block).  ``line_no`` grows along a block.
    """
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
                                       F.col("_metadata.file_block_start").alias("block"),
                                       F.monotonically_increasing_id().alias("line_no"))
    ts = F.regexp_extract("line", LOG_LINE, 1)
    d = raw.withColumns({
        "ts": F.when(ts != "", F.try_to_timestamp(F.concat(ts, F.lit("."), F.regexp_extract("line", LOG_LINE, 2)))
                     .cast("timestamp_ntz")),
        "logger": F.regexp_extract("line", LOG_LINE, 3), "level": F.regexp_extract("line", LOG_LINE, 4),
        "message": F.regexp_extract("line", LOG_LINE, 5)})
    d = d.withColumns({"entry_no": F.when(F.col("ts").isNotNull(), F.col("line_no")), "__row": F.lit(1)})
    ends = d.groupBy("file", "block").agg(F.max("entry_no").alias("entry_no"))          # lines are numbered along a block
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file", "block", F.last("entry_no", ignorenulls=True).over(before).alias("entry_no"), F.lit(0).alias("__row"))
    inside = Window.partitionBy("file", "block").orderBy("__row", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    both = d.unionByName(carried, allowMissingColumns=True)
    both = both.withColumn("entry_no", F.last("entry_no", ignorenulls=True).over(inside)).filter(F.col("__row") == 1)
    return both.drop("__row", "block").withColumn("is_continuation", F.col("ts").isNull())


def log_entries(log: DataFrame) -> DataFrame:
    """One row per entry with its continuation lines joined to the message in their order.

    Lines before a file's first entry have none and form one row without a time.
    """
    first = F.min_by(F.struct("ts", "logger", "level", "message"), "line_no").alias("e")
    rest = F.array_sort(F.collect_list(F.when(F.col("is_continuation"), F.struct("line_no", "line")))).alias("rest")
    g = log.groupBy("file", "entry_no").agg(first, rest)
    lines = F.concat(F.when(F.col("e.ts").isNotNull(), F.array("e.message")).otherwise(F.array().cast("array<string>")), F.col("rest.line"))
    return g.select("file", "entry_no", "e.ts", "e.logger", "e.level", F.array_join(lines, "\n").alias("message"))


def requests_from_log(log: DataFrame) -> DataFrame:
    """Request lines → (ts, method, endpoint, status, duration_s)."""
    m = F.col("message")
    return (log.filter(~F.col("is_continuation") & m.rlike(REQUEST))
            .select("ts", F.regexp_extract(m, REQUEST, 1).alias("method"),
                    F.regexp_extract(m, REQUEST, 2).alias("endpoint"),
                    F.regexp_extract(m, REQUEST, 3).cast("int").alias("status"),
                    F.regexp_extract(m, REQUEST, 4).cast("double").alias("duration_s")))


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """An experiment-run tree as a long table (run_id, kind, key, value).

    ``<root>/<run_id>/{metrics,params,tags}/<key>`` files hold one value each (metrics:
    ``"<ms> <value> <step>"``); ``meta.yaml`` lines become kind ``meta``.
    """
    files = (spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(root)
             .select(F.col("value"), F.col("_metadata.file_path").alias("path")))
    parts = F.split(F.col("path"), "/")
    n = F.size(parts)
    d = files.select(F.element_at(parts, n).alias("key"), F.element_at(parts, n - 1).alias("kind"),
                     F.element_at(parts, n - 2).alias("run_id_if_nested"),
                     F.element_at(parts, n - 1).alias("run_id_if_meta"), "value")
    is_meta = F.col("key") == "meta.yaml"
    meta = (d.filter(is_meta).select(F.col("run_id_if_meta").alias("run_id"),
                                     F.explode(F.split(F.trim("value"), "\n")).alias("line"))
            .select("run_id", F.lit("meta").alias("kind"),
                    F.trim(F.split("line", ":").getItem(0)).alias("key"),
                    F.trim(F.regexp_extract("line", r"^[^:]*:\s*(.*)$", 1)).alias("value")))
    vals = (d.filter(~is_meta & F.col("kind").isin("metrics", "params", "tags"))
            .select(F.col("run_id_if_nested").alias("run_id"), "kind", "key",
                    F.when(F.col("kind") == "metrics", F.split(F.trim("value"), " ").getItem(1))
                    .otherwise(F.trim("value")).alias("value")))
    return vals.unionByName(meta)


# The bot's two tables with declared schemas; JSON text columns decode to typed columns.
USERS_SCHEMA = ("user_id STRING, violations INT, last_offense_time TIMESTAMP_NTZ, first_offense_time TIMESTAMP_NTZ, "
                "severity_history STRING, account_created TIMESTAMP_NTZ")
LOGS_SCHEMA = ("id BIGINT, user_id STRING, message STRING, toxicity_score DOUBLE, severity STRING, "
               "action_taken STRING, timestamp TIMESTAMP_NTZ, metadata STRING")


def read_users(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """User-state table; ``severity_history`` JSON text → array<string>."""
    df = spark.read.schema(USERS_SCHEMA).format(fmt).load(path)
    return df.withColumn("severity_history", F.coalesce(F.from_json("severity_history", "array<string>"),
                                                        F.array().cast("array<string>")))


def read_action_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S5/F-7: action log; ``metadata`` JSON → map, plus the candidate-query view columns
    (confidence, channel_id from metadata, report_count from the USER_REPORT rows, review_timestamp)."""
    from ..operators.feedback import with_user_reports
    df = spark.read.schema(LOGS_SCHEMA).format(fmt).load(path)
    meta = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return with_user_reports(df.withColumns({"metadata": meta, "confidence": F.col("toxicity_score"),
                                             "channel_id": meta["channel_id"],
                                             "review_timestamp": F.lit(None).cast("timestamp_ntz")}))
