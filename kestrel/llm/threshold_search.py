"""Operator 7: exact top-k inner products by Fagin's threshold algorithm.

Method.  In every block the candidates are sorted once along each dimension.  A query reads all
lists in parallel, from the top where its component is positive and from the bottom where it is
negative.  Vectors seen in any list are scored exactly; the query stops when its k-th best score
is above the score that the components at the current depth would give together, which no unseen
vector can exceed.  On a tie with that bound it reads on, since an unseen vector of smaller id
could tie.  The depth grows by ``GROWTH``, so a list's head is read many rows at a time.

Components are whole numbers (floor(scale * x)), scores are exact.

Defined results: vectors null, with null or non-finite components, of another length than most,
or without id take no part; fewer than k candidates are all returned; rows that repeat a vec_id
are one query and never their own candidate, and else each a candidate; an empty table gives an
empty result.  Only id and vector are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from kestrel.llm.vector_blocks import best_of, search_blocks, usable

FIRST_DEPTH, GROWTH = 32, 2.0


def threshold_search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """Top k of every query among one block's vectors (whole numbers); the depth each query read to is not kept."""
    n, dims = vectors.shape
    order = np.argsort(vectors, axis=0, kind="stable")
    lists = np.take_along_axis(vectors, order, axis=0)             # ascending along each dimension
    depth_up = np.empty((dims, n), np.int32)
    depth_up[np.arange(dims)[:, None], order.T] = np.arange(n)
    by_sign = np.concatenate([depth_up, n - 1 - depth_up])         # rows: dimension read upwards, then downwards
    exact = vectors.astype(np.float64)                             # whole numbers below 2^53
    out_q, out_c, out_s = [], [], []
    for i, q in enumerate(queries):
        used = np.nonzero(q)[0]
        first = by_sign[used + dims * (q[used] > 0)].min(axis=0) if len(used) else np.zeros(n, np.int32)
        weight = q.astype(np.float64)
        own = ids == query_ids[i]
        found, scores = np.zeros(0, np.int64), np.zeros(0)
        depth, before = FIRST_DEPTH, 0
        while True:
            depth = min(depth, n)
            new = np.nonzero((first >= before) & (first < depth) & ~own)[0]
            found = np.concatenate([found, new])
            scores = np.concatenate([scores, exact[new] @ weight])
            if len(found) > k:
                by_id = np.argsort(found, kind="stable")
                found, scores = found[by_id], scores[by_id]
                top = best_of(scores, k)
                found, scores = found[top], scores[top]
            if depth == n:
                break
            at = np.where(q > 0, n - depth, depth - 1)
            bound = float((lists[at, np.arange(dims)].astype(np.float64) * weight).sum())
            if len(found) >= k and scores.min() > bound:
                break
            before, depth = depth, int(depth * GROWTH)
        out_q.append(np.full(len(found), i))
        out_c.append(found)
        out_s.append(scores)
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s).astype(np.int64)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of floor(scale * x) for each query row."""
    def search(query_ids, queries, ids, block):
        whole = lambda x: np.floor(scale * x).astype(np.int64)
        return threshold_search(query_ids, whole(queries), ids, whole(block), k)
    return search_blocks(usable(vectors), is_query, k, "long", search)
