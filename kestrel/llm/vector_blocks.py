"""Blocks of vectors against blocks of queries, for the two vector searches.

Rows are dealt to blocks of bounded size by a hash of their id and place, so no id or vector,
however often it occurs, makes a block large.  Every block of candidates meets every block of
queries in one task; each pair returns at most ``k`` rows a query, and the best of those are the
answer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, QUERIES = 4096, 1024


def usable(vectors: DataFrame, nonzero: bool = False) -> DataFrame:
    """(vec_id, embedding as array<double>) of the rows that take part.

    Left out: null ids; vectors null, empty, of another length than most, holding null or
    non-finite components, or (``nonzero``) of zeros only.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id IS NOT NULL AND size(embedding) > 0")
    rows = rows.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    if nonzero:
        rows = rows.where(F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("embedding") == (sizes[0]["d"] if sizes else 0))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Equal-length lists as a matrix."""
    flat = pa.chunked_array([c.flatten() for c in column.chunks], column.type.value_type)
    return flat.to_numpy().reshape(len(column), -1)


def search_blocks(rows: DataFrame, is_query: Column, k: int, score_type: str,
                  search: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """(query_id, rank, vec_id, score): ``search(query ids, queries, ids, vectors)`` on every pair of blocks.

    ``search`` returns positions of queries and candidates and the scores, at most ``k`` a query.
    """
    sized = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    n_blocks, q_blocks = -(-sized["n"] // CANDIDATES) or 1, -(-sized["q"] // QUERIES) or 1
    place = F.xxhash64("vec_id", F.monotonically_increasing_id())
    all_of = lambda n: F.explode(F.array(*[F.lit(i) for i in range(n)]) if n <= 64 else F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = (rows.withColumn("c", F.pmod(place, F.lit(n_blocks)).cast("int")).withColumn("q", all_of(q_blocks))
                  .select("c", "q", "vec_id", "embedding"))
    queries = (rows.where(is_query).dropDuplicates(["vec_id"]).withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int"))
               .withColumn("cb", all_of(n_blocks)).select("cb", "qb", F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], kind)})
        ids, query_ids = right.column("vec_id").to_numpy(), left.column("query_id").to_numpy()
        order = np.argsort(ids, kind="stable")      # so that ties go to the smaller id by position
        q, c, s = search(query_ids, matrix(left.column("query")), ids[order], matrix(right.column("embedding"))[order])
        return pa.table({"query_id": pa.array(query_ids[q], pa.int64()), "vec_id": pa.array(ids[order][c], pa.int64()), "score": pa.array(s, kind)})

    kind = pa.int64() if score_type == "long" else pa.float64()
    found = queries.groupBy("cb", "qb").cogroup(candidates.groupBy("c", "q")).applyInArrow(run, f"query_id long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest scores, ties to the smaller position."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.nonzero(scores > cut)[0]
        return np.concatenate([above, np.nonzero(scores == cut)[0][: k - len(above)]])
    return np.arange(len(scores))
