"""Operator 8: token ids in canonical length-limited Huffman files.

Method.  Ids are counted over all documents; package-merge gives code lengths of at most 16
bits and the canonical codes follow from the lengths alone.  Documents go to shards by ranges of
doc_id and are written in that order as independent blocks: the codes of a block's documents,
each beginning at a whole byte, and the bit offset of every ``CHECKPOINT`` ids of a document.
Reading a block needs nothing but the code lengths: one 16-bit table look-up per id, carried out
for all checkpoints of the block at once.

The file format is a Parquet folder ``blocks`` (one row a block) and a folder ``codebook`` (id,
length), so it can be written and read wherever Spark can.

Defined results: a null or empty text has only the end id; a null doc_id sorts first; rows that
repeat a doc_id are kept, in any order among themselves; an empty table gives files without
blocks and an empty result.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.bpe import load_bpe
from kestrel.llm.common import byte_view, stash, text_slices
from kestrel.session import scratch_path

MAX_BITS = 16
CHECKPOINT = 512
BLOCK_BYTES = 1 << 20
#: Bytes of 16-bit ids handled at once in a Python worker.
ID_BYTES = 2 << 20
BLOCK_SCHEMA = ("shard int, block int, token_start long, doc_ids array<long>, n_tokens array<long>, "
                "checkpoints array<long>, payload binary")


def token_table(docs: DataFrame, vocab_path: str, end_id: int | None) -> DataFrame:
    """(doc_id, ids): ids of every whole text as little-endian 16-bit integers, the end id after them."""
    def run(batches):
        bpe = load_bpe(vocab_path)
        for batch in batches:
            for part in text_slices(batch, "text"):
                flat, starts = bpe.encode_texts(part.column("text"))
                if end_id is not None:
                    n = len(starts) - 1
                    out = np.full(len(flat) + n, end_id, np.uint16)
                    keep = np.ones(len(out), bool)
                    keep[starts[1:] + np.arange(n)] = False
                    out[keep] = flat
                    flat, starts = out, starts + np.arange(n + 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), binary_lists(flat.astype("<u2"), starts)], ["doc_id", "ids"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def binary_lists(flat: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One binary value per list of fixed-width numbers."""
    offsets = pa.py_buffer((starts * flat.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(flat))])


def uint16_lists(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The reverse of ``binary_lists`` for 16-bit numbers: all of them and the starts."""
    raw, starts = byte_view(values)
    return np.frombuffer(raw.tobytes(), "<u2"), starts // 2


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each 16-bit id occurs in all documents (65,536 numbers, whatever the input)."""
    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for part in text_slices(batch, "ids", ID_BYTES):
                total += np.bincount(uint16_lists(part.column("ids"))[0], minlength=1 << 16)
        ids = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids])], ["id", "n"])
    rows = tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << 16, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that do not occur."""
    used = np.nonzero(counts)[0]
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit in {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used]
    level, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        level = both[order]
        is_leaf.append(order < len(leaves))
    lengths = np.zeros(len(used), np.int64)
    take = 2 * len(used) - 2
    for flags in reversed(is_leaf):
        n_leaves = int(flags[:take].sum())
        lengths[:n_leaves] += 1
        take = 2 * (take - n_leaves)
    out[used] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id); unused ids get 0."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        size = lengths[order].astype(np.int64)
        # Left-aligned codes are the running sum of 2^(MAX_BITS - length).
        aligned = np.concatenate([[0], np.cumsum(1 << (MAX_BITS - size))[:-1]])
        codes[order] = aligned >> (MAX_BITS - size)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit window: the id whose code it begins with, and the code's length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (MAX_BITS - lengths[order].astype(np.int64))
    symbol, size = np.zeros(1 << MAX_BITS, np.uint16), np.ones(1 << MAX_BITS, np.uint8)
    end = int(span.sum())
    symbol[:end], size[:end] = np.repeat(order, span), np.repeat(lengths[order], span)
    return symbol, size


def huffman_pack(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of each list, each list from a whole byte on.

    Returns the bytes, the lists' byte starts, the bit offsets (from the list's start) of every
    ``CHECKPOINT`` ids and the lists' checkpoint starts.
    """
    size = lengths[flat].astype(np.int64)
    before = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(size, out=before[1:])
    n_bytes = (np.diff(before[starts]) + 7) // 8
    byte_starts = np.zeros(len(starts), np.int64)
    np.cumsum(n_bytes, out=byte_starts[1:])
    shift = np.repeat(8 * byte_starts[:-1] - before[starts[:-1]], np.diff(starts))
    pos = before[:-1] + shift
    word = codes[flat].astype(np.int64) << (24 - size - (pos & 7))
    at, total = pos >> 3, int(byte_starts[-1])
    out = np.zeros(total + 2, np.float64)
    for k in range(3):  # codes never share a bit, so adding them is or-ing them
        out += np.bincount(at + k, weights=(word >> (16 - 8 * k)) & 255, minlength=total + 2)[: total + 2]
    n = np.diff(starts)
    n_marks = (n + CHECKPOINT - 1) // CHECKPOINT
    mark_starts = np.zeros(len(starts), np.int64)
    np.cumsum(n_marks, out=mark_starts[1:])
    owner = np.repeat(np.arange(len(n)), n_marks)
    index = starts[:-1][owner] + CHECKPOINT * (np.arange(mark_starts[-1]) - mark_starts[:-1][owner])
    return out[:total].astype(np.uint8), byte_starts, pos[index] - 8 * byte_starts[:-1][owner], mark_starts


def huffman_unpack(payload: np.ndarray, bits: np.ndarray, n: np.ndarray, symbol: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decode runs of ``n`` ids that begin at the bit offsets ``bits``, all runs side by side."""
    data = np.concatenate([payload, np.zeros(4, np.uint8)])
    starts = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=starts[1:])
    out = np.zeros(int(starts[-1]), np.uint16)
    order = np.argsort(-n, kind="stable")
    pos, to, left = bits[order].copy(), starts[:-1][order], n[order]
    for step in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -step, side="left"))  # runs with more than step ids come first
        p = pos[:live]
        at = p >> 3
        window = (data[at].astype(np.uint32) << 16) | (data[at + 1].astype(np.uint32) << 8) | data[at + 2]
        window = (window >> (8 - (p & 7)).astype(np.uint32)) & 0xFFFF
        out[to[:live] + step] = symbol[window]
        p += size[window]
    return out


def write_token_files(tokens: DataFrame, path: str, shards: int | None = None) -> None:
    """Write (doc_id, ids) tables as token files under ``path``, in ascending doc_id order."""
    spark = tokens.sparkSession
    lengths = code_lengths(count_ids(tokens))
    used = np.nonzero(lengths)[0]
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = tokens.approxQuantile("doc_id", [k / shards for k in range(1, shards)], 0.25 / shards) if shards > 1 else []
    cuts = np.unique(np.array(cuts, np.float64)).astype(np.int64)
    lengths_v, codes_v = lengths, canonical_codes(lengths)

    def pack(batches):
        for batch in (part for whole in batches for part in text_slices(whole, "ids", ID_BYTES)):
            flat, starts = uint16_lists(batch.column("ids"))
            ids = batch.column("doc_id")
            shard = np.where(ids.is_null(), 0, np.searchsorted(cuts, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), side="right"))
            payload, byte_starts, marks, mark_starts = huffman_pack(flat, starts, lengths_v, codes_v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), ids, pa.array(np.diff(starts)), binary_lists(marks, mark_starts), binary_lists(payload, byte_starts)],
                ["shard", "doc_id", "n", "marks", "payload"])

    def blocks(batches):
        yield from _blocks(batches)

    (tokens.select("doc_id", "ids").mapInArrow(pack, "shard int, doc_id long, n long, marks binary, payload binary")
        .repartitionById(shards, "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"))
        .mapInArrow(blocks, BLOCK_SCHEMA)
        .write.option("compression", "uncompressed").parquet(f"{path}/blocks"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gather sorted documents into blocks; a block never spans shards."""
    shard, block, token_start, held = None, 0, 0, []
    size = 0

    def close():
        nonlocal block, token_start, held, size
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        payload, byte_starts = byte_view(table.column("payload"))
        marks, mark_at = byte_view(table.column("marks"))
        marks = np.frombuffer(marks.tobytes(), np.int64) + np.repeat(8 * byte_starts[:-1], np.diff(mark_at) // 8)
        n = table.column("n").to_numpy()
        wrap = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        row = pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([token_start], pa.int64()), wrap(table.column("doc_id")),
             wrap(pa.array(n)), wrap(pa.array(marks)), pa.array([payload.tobytes()], pa.binary())],
            ["shard", "block", "token_start", "doc_ids", "n_tokens", "checkpoints", "payload"])
        block, token_start, held, size = block + 1, token_start + int(n.sum()), [], 0
        return row

    for batch in batches:
        shards = batch.column("shard").to_numpy()
        total = np.cumsum(np.diff(byte_view(batch.column("payload"))[1]))
        at = 0
        while at < len(shards):
            if shard != shards[at]:
                if held:
                    yield close()
                shard, block, token_start = int(shards[at]), 0, 0
            base = int(total[at - 1]) if at else 0
            end = max(at + 1, min(int(np.searchsorted(shards, shard, side="right")), int(np.searchsorted(total, base + BLOCK_BYTES - size, side="right"))))
            held.append(batch.slice(at, end - at))
            size += int(total[end - 1]) - base
            at = end
            if size >= BLOCK_BYTES:
                yield close()
    if held:
        yield close()


def read_token_files(spark: SparkSession, path: str, emit: str = "ids") -> DataFrame:
    """(doc_id, start, n_tokens, ids or ids_crc32) of every document in the files under ``path``.

    ``start`` counts the ids of all documents before it.  ``emit`` "ids" returns the ids as
    array<int>, "crc32" the checksum of the ids as little-endian 32-bit integers.
    """
    lengths = np.zeros(1 << 16, np.uint8)
    for r in spark.read.schema("id int, length int").parquet(f"{path}/codebook").collect():
        lengths[r["id"]] = r["length"]
    symbol, size = decode_table(lengths)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    sums = (blocks.select("shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
            .groupBy("shard").agg(F.sum("n").alias("n")).collect())  # one row a shard
    base, total = {}, 0
    for r in sorted(sums, key=lambda r: r["shard"]):
        base[r["shard"]] = total
        total += r["n"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in ("doc_ids", "n_tokens", "checkpoints")}
                n = row["n_tokens"].values.to_numpy()
                payload = np.frombuffer(batch.column("payload")[i].as_buffer(), np.uint8)
                n_marks = (n + CHECKPOINT - 1) // CHECKPOINT
                last = np.cumsum(n_marks) - 1
                runs = np.full(int(n_marks.sum()), CHECKPOINT, np.int64)
                some = n > 0
                runs[last[some]] = (n - 1)[some] % CHECKPOINT + 1
                ids = huffman_unpack(payload, row["checkpoints"].values.to_numpy(), runs, symbol, size)
                at = np.concatenate([[0], np.cumsum(n)])
                first = base[batch.column("shard")[i].as_py()] + batch.column("token_start")[i].as_py()
                if emit == "ids":
                    value = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                else:
                    wide = ids.astype("<u4")
                    value = pa.array([zlib.crc32(wide[a:b]) for a, b in zip(at[:-1], at[1:])], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values, pa.array(at[:-1] + first), pa.array(n), value],
                    ["doc_id", "start", "n_tokens", "ids" if emit == "ids" else "ids_crc32"])

    kind = "ids array<int>" if emit == "ids" else "ids_crc32 long"
    return blocks.mapInArrow(run, f"doc_id long, start long, n_tokens long, {kind}")


def write_and_read(docs: DataFrame, vocab_path: str, end_id: int, emit: str = "crc32") -> DataFrame:
    """Encode, write token files to the shared scratch folder, and read them back."""
    spark = docs.sparkSession
    tokens = stash(token_table(docs, vocab_path, end_id), "tokens")
    path = f"{scratch_path(spark, 'llm')}/token-files-{uuid.uuid4().hex}"
    write_token_files(tokens, path)
    return read_token_files(spark, path, emit)
