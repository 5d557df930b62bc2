"""Vectors as whole numbers, and exact sums of them, for the two operators that cluster them.

A component x becomes floor(scale * x).  Vectors with a component of ``LIMIT`` or more after that
take no part: squared distances of such vectors would not fit a long.  All arithmetic is on
64-bit integers, so results do not depend on the order in which tasks end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.vector_blocks import matrix

#: Components are below this in size; squared distances over 64 of them are below 2^62.
LIMIT = 1 << 27
#: Rows handled at once in a Python worker.
ROWS = 4096


def whole_vectors(vectors: DataFrame, scale: int, dims: Column | int, *keep: str) -> DataFrame:
    """(``keep`` columns, v array<int>) of the vectors of ``dims`` finite components."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(*keep, x.alias("v")).where(F.size("v") == dims)
    rows = rows.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LIMIT / scale)))
    return rows.withColumn("v", F.transform("v", lambda c: F.floor(c * float(scale)).cast("int")))


def each_slice(batches: Iterator[pa.RecordBatch], column: str = "v") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of at most ``ROWS`` rows with their vectors as an int64 matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, matrix(pa.chunked_array([part.column(column)])).astype(np.int64)


def summed(rows: DataFrame, width: int, add: Callable[[np.ndarray, pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """``width`` exact totals over all rows: ``add(totals, slice, vectors)`` adds a slice's share.

    A task sends one row for each of its non-zero totals, so what is shuffled and collected is
    bounded by ``width``, not by the rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(width, np.int64)
        for part, vectors in each_slice(batches):
            add(totals, part, vectors)
        at = np.nonzero(totals)[0]
        yield pa.record_batch({"slot": pa.array(at, pa.int64()), "total": pa.array(totals[at], pa.int64())})

    out = np.zeros(width, np.int64)
    for slot, total in rows.mapInArrow(run, "slot long, total long").groupBy("slot").agg(F.sum("total")).collect():
        out[slot] = total
    return out
