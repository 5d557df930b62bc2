"""Operator 10: approximate nearest neighbours by collision counting.

Method.  Inner product is turned into distance by one more component that gives all vectors of
a block the same length.  ``HASHES`` random projections, one number each, are kept as sorted
arrays, and with them every vector's place in each array.  A query opens a window around its own
projection in every array: its ends are found by bisection, for all queries of a block at once, and a
vector collides where its place lies between them.  Virtual rehashing widens all windows by a factor
``WIDEN`` a level.  Vectors that reach ``COLLISIONS`` are candidates; a query takes the narrowest level at which
there are enough of them (k and ``SHARE`` of the block; the search for it starts from the level of
the query before), and they are verified with exact inner products in double precision.  All rows
are indexed; the projections are fixed random numbers, so nothing is fitted.

Every query still meets every block, so the work grows with queries times rows.

Defined results: vectors null, zero, with null or non-finite components, of another length than
most, or without id take no part; fewer than k candidates are all returned; rows that repeat a
vec_id are one query and never their own candidate, and else each a candidate; an empty table
gives an empty result.  Only id and vector are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from kestrel.llm.vector_blocks import best_of, search_blocks, usable

HASHES, COLLISIONS = 64, 51
SHARE, WIDEN, FIRST_WINDOW = 0.12, 1.12, 0.6


def projections(dims: int) -> np.ndarray:
    """``HASHES`` fixed random directions, orthogonal in runs of ``dims``."""
    rng = np.random.default_rng(977)
    runs = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(-(-HASHES // dims))]
    return np.concatenate(runs, axis=1)[:, :HASHES]


class CollisionIndex:
    """Sorted projections of one block's vectors, and the windows of its queries at every level used."""

    def __init__(self, vectors: np.ndarray, queries: np.ndarray):
        n, dims = vectors.shape
        square = (vectors ** 2).sum(axis=1)
        longest = np.sqrt(square.max())
        axes = projections(dims + 1)
        spots = np.concatenate([vectors, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], axis=1) @ axes
        order = np.argsort(spots, axis=0, kind="stable").T
        self.lists = np.take_along_axis(spots.T, order, axis=1)
        self.kind = np.uint16 if n < 1 << 16 else np.uint32
        self.place = np.empty((HASHES, n), self.kind)
        self.place[np.arange(HASHES)[:, None], order] = np.arange(n, dtype=self.kind)
        self.spread = float(spots.std()) or 1.0
        # A query is scaled to the vectors' length: that changes no order of its inner products.
        size = np.linalg.norm(queries, axis=1, keepdims=True)
        self.centre = (queries * (longest / np.maximum(size, 1e-300))) @ axes[:dims]
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.offset, self.hit = np.empty((HASHES, n), self.kind), np.empty((HASHES, n), bool)

    def window(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First place and width of every query's window in every array."""
        if level not in self.windows:
            half = FIRST_WINDOW * self.spread * WIDEN ** level
            low, high = (np.stack([self.lists[j].searchsorted(self.centre[:, j] + end) for j in range(HASHES)], axis=1) for end in (-half, half))
            self.windows[level] = low.astype(self.kind), (high - low).astype(self.kind)
        return self.windows[level]

    def candidates(self, query: int, level: int) -> np.ndarray:
        """Which vectors reach ``COLLISIONS``.  Places before a window wrap around and are above its width."""
        low, width = self.window(level)
        np.subtract(self.place, low[query][:, None], out=self.offset)
        np.less(self.offset, width[query][:, None], out=self.hit)
        return np.add.reduce(self.hit.view(np.uint8), axis=0, dtype=np.uint8) >= COLLISIONS


def collision_search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """About the top k of every query among one block's vectors."""
    index = CollisionIndex(vectors, queries)
    wanted = min(len(vectors), k + 1 + int(SHARE * len(vectors)))
    out_q, out_c, out_s, level = [], [], [], 0
    for i in range(len(queries)):
        reached = index.candidates(i, level)
        if np.count_nonzero(reached) >= wanted:
            while level and np.count_nonzero(fewer := index.candidates(i, level - 1)) >= wanted:
                reached, level = fewer, level - 1
        while np.count_nonzero(reached) < wanted:
            level += 1
            reached = index.candidates(i, level)
        chosen = np.nonzero(reached)[0]
        chosen = chosen[ids[chosen] != query_ids[i]]
        scores = vectors[chosen] @ queries[i]
        top = best_of(scores, k)
        out_q.append(np.full(len(top), i))
        out_c.append(chosen[top])
        out_s.append(scores[top])
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each query row."""
    def search(query_ids, queries, ids, block):
        return collision_search(query_ids, queries, ids, block, k)
    return search_blocks(usable(vectors, nonzero=True), is_query, k, "double", search)
