"""One packaged scorer for raw messages, the same for tables and streams.

A scorer is a fitted pipeline (embedding projected by SVD, tabular columns scaled, both fused, a
classifier) with the settings around it.  Scoring a frame of raw messages is one projection after another and at most one
left join: text features, enrichment from the online feature table, casts by the declared column sets,
prediction, folded confidence, log row.  Nothing in it aggregates, so a stream takes the same path as a table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import feature_columns, truncate_text
from .embedding import embed_hashing
from .moderation import fold_confidence
from .serving import SERVING_DEFAULTS, enrich
from .training import feature_stages, with_class_weights

TEXT_FEATURES = ("msg_len", "caps_ratio", "slur_count", "personal_pronoun_count")
LOG_COLUMNS = ("timestamp", "user_id", "text", "prediction", "confidence", "model_version", "processing_time_ms", "features_enriched")


def cast_features(df: DataFrame, names: Sequence[str], integers: Sequence[str]) -> DataFrame:
    """The model's columns in their declared types — bigint or double, 0 where absent or null."""
    cols = {}
    for c in names:
        kind = "bigint" if c in integers else "double"
        cols[c] = F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)) if c in df.columns else F.lit(0).cast(kind)
    return df.withColumns(cols)


@dataclass(frozen=True)
class Scorer:
    """A fitted pipeline and what it needs to score raw messages."""
    model: PipelineModel
    version: str
    threshold: float = 0.5
    dim: int = 64
    group: str = "user_toxicity"
    tabular: tuple[str, ...] = (*TEXT_FEATURES, *SERVING_DEFAULTS)
    integers: tuple[str, ...] = field(default=("msg_len", "slur_count", "personal_pronoun_count", "is_new_to_channel"))

    def features(self, messages: DataFrame, store: DataFrame | None = None) -> DataFrame:
        """Messages with text features, enrichment (defaults without a store), casts and the embedding."""
        fc = feature_columns("text")
        d = messages.withColumns({c: fc[c] for c in TEXT_FEATURES})
        held = {c: v for c, v in SERVING_DEFAULTS.items() if store is not None and c in store.columns}
        if held:
            d = enrich(d, store, self.group, "prod", "user_id", held)
        d = d.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in d.columns else F.lit(v) for c, v in SERVING_DEFAULTS.items() if c not in held})
        d = d.withColumn("features_enriched", F.col("user_id").isNotNull() if store is not None else F.lit(False))
        d = cast_features(d, self.tabular, self.integers).withColumn("__text", F.col("text"))  # the encoder fills null texts
        d = embed_hashing(d, "__text", self.dim, "__embedding")
        return d.withColumn("vec", array_to_vector("__embedding")).drop("__embedding", "__text")

    def score(self, messages: DataFrame, store: DataFrame | None = None) -> DataFrame:
        """Messages with ``p_toxic``, ``prediction``, folded ``confidence`` and ``features_enriched``."""
        out = self.model.transform(self.features(messages, store))
        p = vector_to_array("probability")[1]
        out = out.withColumn("p_toxic", p).withColumns({
            "prediction": (F.col("p_toxic") >= self.threshold).cast("int"), "confidence": fold_confidence(F.col("p_toxic"))})
        return out.select(*messages.columns, *[c for c in ("p_toxic", "prediction", "confidence", "features_enriched")])

    def log_rows(self, messages: DataFrame, store: DataFrame | None = None, time: str | None = None) -> DataFrame:
        """F-3 log rows; ``time`` names the column of the request's time (null without one).  A row has no processing time of its own."""
        at = F.date_format(F.col(time).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if time else F.lit(None).cast("string")
        return self.score(messages, store).select(
            at.alias("timestamp"), F.col("user_id").cast("string").alias("user_id"), truncate_text("text", 250).alias("text"), "prediction",
            "confidence", F.lit(self.version).alias("model_version"), F.lit(None).cast("double").alias("processing_time_ms"), "features_enriched")

    def save(self, path: str) -> None:
        """The pipeline under ``path/model`` and the settings as one JSON row under ``path/settings``."""
        self.model.write().overwrite().save(f"{path}/model")
        settings = {k: getattr(self, k) for k in ("version", "threshold", "dim", "group", "tabular", "integers")}
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Scorer:
        s = json.loads(spark.read.text(f"{path}/settings").first()[0])
        return Scorer(PipelineModel.load(f"{path}/model"), s["version"], s["threshold"], s["dim"], s["group"], tuple(s["tabular"]), tuple(s["integers"]))


def train_scorer(labelled: DataFrame, version: str, classifier, store: DataFrame | None = None, k: int = 16, threshold: float = 0.5,
                 label: str = "label", **settings) -> Scorer:
    """Fit a scorer on labelled raw messages (text, user_id, label); ``classifier`` takes features, label and weight columns."""
    blank = Scorer(PipelineModel([]), version, threshold, **settings)
    rows = with_class_weights(blank.features(labelled.filter(F.col(label).isNotNull()), store), label)
    model = Pipeline(stages=[*feature_stages("vec", blank.tabular, k), classifier]).fit(rows)
    return Scorer(model, version, threshold, **settings)
