"""Operator 3: packing along a space-filling curve.

Method.  Each document's ids are hashed into signed buckets and projected to a few dimensions by
a fixed random matrix (a sum of one small vector per id).  The projections, standardised over
all documents, are cut into cells, and the cells' Hilbert key orders the documents by a range
sort.  Documents are laid end to end along the curve and cut every ``length`` ids, so only the
very last sequence needs padding.  Positions come from a prefix sum in two steps, within the
range partitions and over their totals; ties of a key are broken by row, so a large group of
copies is spread over partitions like any other rows.

Defined results: a null or empty text has only the end id; repeated rows are packed each for
itself; an empty table gives no piece.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from math import erf

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.bpe import load_bpe
from kestrel.llm.common import mix64, stash, text_slices
from kestrel.llm.token_files import ID_BYTES, binary_lists, uint16_lists

DIMS, BITS = 4, 12
BUCKETS = 1024


def projection(size: int = 1 << 16) -> np.ndarray:
    """The small vector of each id: its bucket's row of a fixed Gaussian matrix, with the id's sign."""
    h = mix64(np.arange(size, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
    matrix = np.random.default_rng(20240229).standard_normal((BUCKETS, DIMS)).astype(np.float32)
    sign = np.where((h >> np.uint64(63)).astype(bool), np.float32(1), np.float32(-1))
    return matrix[(h % np.uint64(BUCKETS)).astype(np.int64)] * sign[:, None]


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of integer cells (rows of ``dims`` numbers below 2^bits) on the Hilbert curve."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections, coarsest first
        low = q - 1
        for i in range(len(x)):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(x[i] & q, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for xi in x:
            key = (key << 1) | (((xi ^ flip) >> bit) & 1)
    return key


def _vectors(docs: DataFrame, vocab_path: str, end_id: int) -> DataFrame:
    """(uid, doc_id, n, ids, p0..): one row a document."""
    names = [f"p{i}" for i in range(DIMS)]

    def run(batches):
        bpe, table = load_bpe(vocab_path), projection()
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in text_slices(batch, "text"):
                flat, starts = bpe.encode_texts(part.column("text"))
                n = len(starts) - 1
                ids = np.full(len(flat) + n, end_id, np.uint16)
                keep = np.ones(len(ids), bool)
                keep[starts[1:] + np.arange(n)] = False
                ids[keep] = flat
                starts = starts + np.arange(n + 1)
                size = np.diff(starts)
                sums = np.stack([np.add.reduceat(table[:, i][ids], starts[:-1]) for i in range(DIMS)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + n)), part.column("doc_id"), pa.array(size), binary_lists(ids.astype("<u2"), starts),
                     *(pa.array((sums[:, i] / size).astype(np.float64)) for i in range(DIMS))],
                    ["uid", "doc_id", "n", "ids", *names])
                uid += n
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "uid long, doc_id long, n long, ids binary, " + ", ".join(f"{x} double" for x in names)))


def _positions(rows: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(uid, part, local start) along the curve, and the ids before each part."""
    names = [f"p{i}" for i in range(DIMS)]
    stats = rows.select(*[f(x).alias(f"{k}{x}") for x in names for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([stats["m" + x] or 0.0 for x in names])
    spread = np.array([stats["s" + x] or 1.0 for x in names])
    grid = np.array([0.5 * (1 + erf(z / 2 ** 0.5)) for z in np.linspace(-6, 6, 4097)])

    def keys(batches):
        for batch in batches:
            p = np.stack([batch.column(x).to_numpy() for x in names], axis=1)
            z = (p - mean) / spread
            cells = (np.interp(z, np.linspace(-6, 6, 4097), grid) * ((1 << BITS) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("n"), pa.array(hilbert_key(cells, BITS))], ["uid", "n", "key"])

    def prefix(batches):
        at = 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("part"), pa.array(ends - n), pa.array(n)], ["uid", "part", "local", "n"])
            at = int(ends[-1]) if len(ends) else at

    ordered = (rows.select("uid", "n", *names).mapInArrow(keys, "uid long, n long, key long")
               .repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "uid")
               .sortWithinPartitions("key", "uid").withColumn("part", F.spark_partition_id()))
    placed = stash(ordered.mapInArrow(prefix, "uid long, part int, local long, n long"), "curve")
    base, total = {}, 0
    for r in sorted(placed.groupBy("part").agg(F.sum("n").alias("n")).collect()):  # one row a partition
        base[r["part"]] = total
        total += r["n"]
    return placed.select("uid", "part", "local"), base


def pack_documents(docs: DataFrame, vocab_path: str, end_id: int = 2, length: int = 4096, emit: str = "ids") -> DataFrame:
    """Pieces of all documents: (doc_id, start, length, doc_tokens, sequence_id, offset, ids or ids_crc32).

    ``emit`` "ids" returns each piece's ids as array<int>, "crc32" their checksum as little-endian
    32-bit integers.
    """
    rows = stash(_vectors(docs, vocab_path, end_id), "packing")
    places, base = _positions(rows)

    def cut(batches):
        for batch in (part for whole in batches for part in text_slices(whole, "ids", ID_BYTES)):
            ids, starts = uint16_lists(batch.column("ids"))
            n = np.diff(starts)
            first = np.array([base[p] for p in batch.column("part").to_pylist()], np.int64) + batch.column("local").to_numpy()
            pieces = (first + n - 1) // length - first // length + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[doc] // length + nth
            begin = np.maximum(first[doc], sequence * length)
            end = np.minimum(first[doc] + n[doc], (sequence + 1) * length)
            start, size = begin - first[doc], end - begin
            at = starts[:-1][doc] + start
            wide = ids.astype("<u4")
            if emit == "ids":  # a document's pieces follow one another, so the ids need no gathering
                value = pa.ListArray.from_arrays(pa.array(np.concatenate([at, [len(ids)]]), pa.int32()), pa.array(ids.astype(np.int32)))
            else:
                value = pa.array([zlib.crc32(wide[a: a + s]) for a, s in zip(at, size)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(n[doc]), pa.array(sequence),
                 pa.array(begin - sequence * length), value],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids" if emit == "ids" else "ids_crc32"])

    kind = "ids array<int>" if emit == "ids" else "ids_crc32 long"
    return (rows.select("uid", "doc_id", "ids").join(places, "uid").select("doc_id", "ids", "part", "local")
            .mapInArrow(cut, f"doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, {kind}"))
