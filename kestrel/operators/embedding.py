"""Text embeddings and the embedding cache.

The default encoder is native: tokens → feature hashing → L2 normalisation (Spark ML
``RegexTokenizer``/``HashingTF``/``Normalizer``), so no Python runs on executors.  A trained
encoder plugs in through ``embed_with_model``: an Arrow ``mapInPandas`` that loads the model
once per task and encodes batches, the only place where per-row Python is unavoidable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicons import WS_CLASS_JAVA


def embed_hashing(df: DataFrame, text: str = "text", dim: int = 64, out: str = "embedding") -> DataFrame:
    """M1 (native default): hashed bag of lower-cased tokens, L2-normalised, as array<float>."""
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="__tok", pattern=f"[{WS_CLASS_JAVA}]+", toLowercase=True),
        HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=dim),
        Normalizer(inputCol="__tf", outputCol="__vec", p=2.0)])
    src = df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    model = pipe.fit(src)  # stateless stages: fitting reads no data
    return (model.transform(src).withColumn(out, vector_to_array("__vec", "float32"))
            .drop("__tok", "__tf", "__vec"))


def embed_with_model(df: DataFrame, text: str, load_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
                     dim: int, batch_size: int = 32, chunk_chars: int | None = None,
                     out: str = "embedding") -> DataFrame:
    """Pluggable encoder, loaded once per task, applied to batches of ``batch_size`` texts.

    ``load_encoder()`` returns ``encode(list[str]) -> ndarray[n, dim]``.  For an encoder with a fixed context,
    ``chunk_chars`` cuts each whole text into pieces of at most that length; a text's vector is the
    mean of its pieces' vectors weighted by their lengths.
    """
    schema = f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, `{out}` array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load_encoder()
        for pdf in batches:
            texts = pdf[text].fillna("").astype(str).tolist()
            pieces = [(i, t[at: at + chunk_chars] if chunk_chars else t)
                      for i, t in enumerate(texts) for at in (range(0, max(len(t), 1), chunk_chars) if chunk_chars else (0,))]
            total, weight = np.zeros((len(texts), dim)), np.zeros(len(texts))
            for i in range(0, len(pieces), batch_size):
                part = pieces[i: i + batch_size]
                v = np.asarray(encode([t for _, t in part]), dtype=np.float32).reshape(-1, dim)
                at, w = np.array([j for j, _ in part]), np.array([max(len(t), 1) for _, t in part], float)
                np.add.at(total, at, v * w[:, None])
                np.add.at(weight, at, w)
            yield pdf.assign(**{out: list((total / np.maximum(weight, 1)[:, None]).astype(np.float32))})
    return df.mapInPandas(run, schema)


def cached_embeddings(spark: SparkSession, texts: DataFrame, cache_path: str, encoder_id: str,
                      embed: Callable[[DataFrame], DataFrame], text: str = "text",
                      key: str = "text_hash") -> DataFrame:
    """M2: embed only texts missing from the cache for this encoder, append them, return all.

    The cache is a Parquet table keyed by (text_hash, encoder_id); misses are found with a
    left-anti join, so each distinct text is encoded once per encoder across runs.
    """
    # Null text hashes as the empty string so it is cached like any other text (no null keys).
    h = F.md5(F.coalesce(F.col(text), F.lit("")))
    keyed = texts.withColumn(key, F.coalesce(F.col(key), h) if key in texts.columns else h)
    try:
        cache = spark.read.parquet(cache_path).filter(F.col("encoder_id") == encoder_id)
    except Exception as e:  # noqa: BLE001 — first run: no cache yet
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
        cache = None
    distinct = keyed.groupBy(key).agg(F.first(text).alias(text))
    misses = distinct if cache is None else distinct.join(cache.select(key), key, "left_anti")
    new = embed(misses).select(key, F.lit(encoder_id).alias("encoder_id"), "embedding")
    new.write.mode("append").parquet(cache_path)
    full = spark.read.parquet(cache_path).filter(F.col("encoder_id") == encoder_id).select(key, "embedding")
    return keyed.join(full, key, "left")
