"""Helpers shared by the training-data operators.

Texts reach Python as Arrow batches (``mapInArrow``).  Words are cut and dictionary-encoded by
Arrow kernels, so per-word Python work is done once per distinct word of a slice and mapped
back with integer gathers; a slice holds a bounded number of text bytes whatever the rows are.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.session import scratch_path
from kestrel.sources.tables import read_table  # noqa: F401

#: Text bytes handled at once in a Python worker.
SLICE_BYTES = 6 << 20


def stash(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts the lineage for good."""
    spark = df.sparkSession
    path = f"{scratch_path(spark, 'llm')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a looked-up table that may be sent to every task; beyond it, the look-up is a shuffled join.
BROADCAST_ROWS, SALTS = 20_000, 64


def attach(rows: DataFrame, table: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` left-joined to ``table`` (one row for each value of ``key``, null included).

    The table is counted: a small one is broadcast.  A large one is repeated under ``SALTS`` salts
    and joined on (key, salt), the rows' salt being a hash of column ``spread``, so that a key
    with a third of all rows is dealt to many tasks.
    """
    other = table.withColumnRenamed(key, "__key")
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(other), F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    salted = other.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = rows.withColumn("__own", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return left.join(salted, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__own") == F.col("__salt")), "left").drop("__key", "__salt", "__own")


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` text bytes; a longer text is a run of its own."""
    lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(lens):
        return
    total = np.cumsum(lens)
    start = 0
    while start < len(lens):
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(start, end - start)
        pa.default_memory_pool().release_unused()  # a worker's memory is shared with the JVM's
        start = end


def words_of(texts: pa.Array, lower: str | None = "ascii") -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text (null: none).

    Returns the code of every word, the distinct words, and the ``n + 1`` starts of the rows.
    ``lower``: "ascii" folds A-Z only, "utf8" folds all letters, None folds nothing.
    """
    texts = pc.fill_null(texts, "")
    if lower == "ascii":
        texts = pc.ascii_lower(texts)
    elif lower == "utf8":
        texts = pc.utf8_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    codes, vocab = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
    empty = pc.index(vocab, "").as_py() if len(vocab) else -1
    if empty >= 0:  # leading and trailing white space
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
        codes = codes - (codes > empty)
        vocab = pa.concat_arrays([vocab.slice(0, empty), vocab.slice(empty + 1)])
    return codes, vocab, offsets


def gather_lists(flat: np.ndarray, starts: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists ``flat[starts[i]:starts[i+1]]`` for ``i`` in ``take``, concatenated, with their ``n + 1`` starts."""
    lens = np.diff(starts)[take]
    out = np.zeros(len(take) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    index = np.repeat(starts[:-1][take] - out[:-1], lens)
    index += np.arange(out[-1], dtype=index.dtype)
    return flat[index], out


def byte_view(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary array and their ``n + 1`` starts."""
    values = values.cast(pa.binary()) if not pa.types.is_binary(values.type) else values
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = values.buffers()
    starts = np.frombuffer(off, np.int32)[values.offset: values.offset + len(values) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0]: starts[-1]], starts - starts[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (vectorised)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``raw[starts[i]:ends[i]]``, any lengths."""
    out = np.full(len(starts), 0x51ED270B, np.uint64) + mix64((ends - starts).astype(np.uint64))
    lens = ends - starts
    for i in np.nonzero(lens > 64)[0]:
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i]: ends[i]].tobytes(), digest_size=8).digest(), "little")
    live = np.nonzero((lens > 0) & (lens <= 64))[0]
    at = 0
    while len(live):
        pos = starts[live] + at
        out[live] = mix64((out[live] ^ raw[pos].astype(np.uint64)) * _BASE)
        at += 1
        live = live[ends[live] - starts[live] > at]
    return out


def list_array(flat: pa.Array, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), flat)


