"""Operator 11: vector code compression with memoised grid cells.

Method.  Vectors of whole numbers are cut into equal parts; each part position has a codebook,
learnt by rounds of assigning every part to its nearest entry and moving entries to the floor of
their parts' mean.  To find the nearest entry, a part is put into a coarse grid cell
(components divided by ``cell``), and the cell is hashed.  For a cell met for the first time,
every entry gets the least and the greatest squared distance it can have to a point of the cell's
box; entries whose least distance exceeds another's greatest are dominated everywhere in the box
and can win for none of its points.  The survivors are remembered as a bit mask under the cell's
hash, and parts that fall into a known cell are compared exactly with the survivors alone.
Survivors include every entry that could tie, so results equal a full search.  A remembered mask
is used only if the remembered cell is the same, not just its hash.  A task's memo holds at most
``MEMO`` cells a part position and starts anew when full; that bounds memory and changes no result.

Codebooks are the only state between rounds (entries x components numbers); sums are exact.

Defined results: left out are vectors that are null, empty, hold null or non-finite components
or components of 2^27 or more after scaling, or whose length is not the most frequent one among
those that ``parts`` divides (ties: the shorter).  Rows without id take part and come last among
the starts; repeated ids are separate rows, started in order of their vectors.  With fewer rows
than entries, codebooks are as small as the rows are few.  An empty table gives an empty result.
Rows with null labels are one group.  Only id, vector and label are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import attach, mix64, stash
from kestrel.llm.integer_vectors import each_slice, summed, whole_vectors

CELL, MEMO = 256, 1 << 15


class CellMemo:
    """Surviving entries of the grid cells of one part position."""

    def __init__(self, entries: np.ndarray, cell: int = CELL, memo: int = MEMO):
        self.entries, self.cell, self.memo = entries, cell, memo
        self._forget()

    def _forget(self) -> None:
        self.keys, self.masks = np.zeros(0, np.uint64), np.zeros((0, len(self.entries)), bool)
        self.cells = np.zeros((0, self.entries.shape[1]), np.int64)

    def survivors(self, cells: np.ndarray) -> np.ndarray:
        """Which entries are not dominated across each cell's box."""
        low = (cells * self.cell)[:, None]
        high = low + self.cell - 1
        below, above = low - self.entries, self.entries - high
        least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=2)
        most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=2)
        return least <= most.min(axis=1, keepdims=True)

    def _hash(self, cells: np.ndarray) -> np.ndarray:
        key = np.zeros(len(cells), np.uint64)
        for column in cells.T:
            key = mix64((key ^ column.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))
        return key

    def masks_of(self, parts: np.ndarray) -> np.ndarray:
        """Survivors for each part, from memory where its cell is known."""
        cells = parts // self.cell
        key = self._hash(cells)
        keys, first, back = np.unique(key, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        same = known.copy()
        same[known] = (self.cells[at[known]] == cells[first[known]]).all(axis=1)
        masks = np.empty((len(keys), len(self.entries)), bool)
        masks[same] = self.masks[at[same]]
        masks[~same] = self.survivors(cells[first[~same]])
        new = ~known
        if len(self.keys) + new.sum() > self.memo:
            self._forget()
        if new.any() and new.sum() <= self.memo:
            joined = np.concatenate([self.keys, keys[new]])
            order = np.argsort(joined, kind="stable")
            self.keys = joined[order]
            self.cells = np.concatenate([self.cells, cells[first[new]]])[order]
            self.masks = np.concatenate([self.masks, masks[new]])[order]
        out = masks[back]
        clash = (cells != cells[first][back]).any(axis=1)     # another cell with the same hash in this slice
        out[clash] = self.survivors(cells[clash])
        return out

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part (ties: lower), squared distance, exact distances taken."""
        masks = self.masks_of(parts)
        row, entry = np.nonzero(masks)
        found = np.full((len(parts), len(self.entries)), np.iinfo(np.int64).max)
        found[row, entry] = ((parts[row] - self.entries[entry]) ** 2).sum(axis=1)
        best = found.argmin(axis=1)
        return best, found[np.arange(len(parts)), best], masks.sum(axis=1)


def _memos(codebooks: np.ndarray, cell: int) -> list[CellMemo]:
    return [CellMemo(book, cell) for book in codebooks]


def learn_codebooks(rows: DataFrame, parts: int, entries: int, rounds: int, cell: int) -> np.ndarray:
    """Codebooks (part, entry, component) after ``rounds`` rounds over all rows."""
    starts = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not starts:
        return np.zeros((parts, 0, 1), np.int64)
    books = np.array([r["v"] for r in starts], np.int64).reshape(len(starts), parts, -1).transpose(1, 0, 2)
    width = books.shape[2] + 1                              # an entry's sums, then its count
    for _ in range(rounds):
        memos: list[CellMemo] = []

        def add(totals: np.ndarray, _batch: pa.RecordBatch, vectors: np.ndarray, books=books, memos=memos) -> None:
            if not memos:
                memos.extend(_memos(books, cell))
            view = totals.reshape(parts, books.shape[1], width)
            for p, piece in enumerate(np.split(vectors, parts, axis=1)):
                best, _, _ = memos[p].nearest(piece)
                np.add.at(view[p], best, np.concatenate([piece, np.ones((len(piece), 1), np.int64)], axis=1))

        totals = summed(rows, books.shape[0] * books.shape[1] * width, add).reshape(parts, -1, width)
        count = totals[..., -1:]
        books = np.where(count > 0, totals[..., :-1] // np.maximum(count, 1), books)
    return books


def encode_vectors(rows: DataFrame, codebooks: np.ndarray, cell: int) -> DataFrame:
    """(vec_id, label, code, error, evaluated) of every row; ``evaluated``: exact distances taken."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = _memos(codebooks, cell)
        for part, vectors in each_slice(batches):
            found = [memo.nearest(piece) for memo, piece in zip(memos, np.split(vectors, len(memos), axis=1))]
            codes = np.stack([best for best, _, _ in found], axis=1)
            digits = np.array([f"{e:02x}" for e in range(codebooks.shape[1])])
            text = digits[codes].tolist()
            yield pa.record_batch({"vec_id": part.column("vec_id"), "label": part.column("label"),
                                   "code": pa.array(["".join(t) for t in text], pa.string()),
                                   "error": pa.array(sum(d for _, d, _ in found), pa.int64()),
                                   "evaluated": pa.array(sum(n for _, _, n in found), pa.int64())})

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {kind}, code string, error long, evaluated long")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
             cell: int = CELL) -> tuple[DataFrame, np.ndarray]:
    """Codes of every vector (see ``encode_vectors``), written to the scratch folder, and the codebooks."""
    if "label" not in vectors.columns:
        vectors = vectors.withColumn("label", F.lit(None).cast("int"))
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    size = F.size("embedding")
    sizes = source.where((size > 0) & (size % parts == 0)).groupBy(size.alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = stash(whole_vectors(source, scale, sizes[0]["d"] if sizes else 0, "vec_id", "label").where(F.size("v") > 0), "op11-vectors")
    books = learn_codebooks(rows, parts, entries, rounds, cell)
    return stash(encode_vectors(rows, books, cell), "op11-codes"), books


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed_with_errors(vectors: DataFrame, **how) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256, evaluated) of every vector that takes part."""
    codes, books = compress(vectors, **how)
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    return (attach(codes, by_label, "label", "vec_id").withColumn("codebooks_sha256", F.lit(codebook_digest(books)))
            .select("vec_id", "code", "error", "label_error", "codebooks_sha256", "evaluated"))
