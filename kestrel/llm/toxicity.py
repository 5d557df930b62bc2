"""Operator 2: toxic spans by a linear-chain conditional random field.

Method.  Tokens are words; a token's features are its trimmed, lower-cased form and its first
four, five and six bytes, hashed.  Labels exist for documents only, so token labels are derived
from the training sample: features that occur in significantly more toxic than clean documents,
and a greedy cover of the toxic documents left over.  A two-state chain over whole texts is
trained on them by exact gradients (forward-backward).  Texts lie in rows of ``RUN`` tokens, and
messages pass from row to row both ways.  Forward-backward marginals of every token give the offending spans; a document's score is its largest
marginal.

The model is fitted on a bounded sample: at most ``TOXIC_DOCS`` toxic and ``CLEAN_DOCS`` clean
labelled documents, those of smallest hashed id.  Everything else reads all rows.

Defined results: a null or empty text has score 0; rows that repeat score alike; without toxic
or without clean training rows every score is 0; rows of ``labels`` without a label or id are
not learnt from; an empty table gives an empty result.  Of the documents only id and text are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import byte_view, hash_spans, mix64, text_slices, words_of

TOXIC_DOCS, CLEAN_DOCS = 1500, 3000
#: Weights nearer to zero than this are left out of the fitted model.
LEAST_WEIGHT = 0.02
PREFIXES = (4, 5, 6)
RUN = 64
#: Tokens handled at once in training; only codes and distinct (document, feature) pairs are kept of the others.
BLOCK_TOKENS = 1 << 18
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _LETTER[_c] = True


def token_features(vocab: pa.Array) -> np.ndarray:
    """Hashed features of distinct lower-cased words, one row each; 0 stands for none."""
    raw, at = byte_view(vocab)
    start, end = at[:-1].copy(), at[1:].copy()
    for edge, step in ((start, 1), (end, -1)):
        live = np.nonzero(end > start)[0]
        while len(live):
            live = live[~_LETTER[raw[edge[live] - (step < 0)]]]
            edge[live] += step
            live = live[end[live] > start[live]]
    out = np.zeros((len(vocab), 1 + len(PREFIXES)), np.uint64)
    some = end > start
    out[some, 0] = hash_spans(raw, start[some], end[some])
    for k, n in enumerate(PREFIXES, 1):
        long = np.nonzero(end - start >= n)[0]
        code = np.full(len(long), n, np.uint64)
        for i in range(n):
            code = (code << np.uint64(8)) | raw[start[long] + i].astype(np.uint64)
        out[long, k] = mix64(code)
    return out


@dataclass
class Chain:
    """Emission weights of the toxic state by feature (ascending keys), its bias, and 2x2 transition scores."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    trans: np.ndarray

    def marginals(self, emission: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probability of the toxic state of every token; ``starts``: of the texts in the flat array."""
        grid, where, head = _runs(emission, starts)
        return chained(grid, np.isfinite(grid), self.trans, head)[0][where]

    def tag(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of every text, every token's marginal, and the starts of the texts' tokens."""
        codes, vocab, starts = words_of(texts, "utf8")
        score, p = np.zeros(len(starts) - 1), np.zeros(len(codes), np.float32)
        if len(codes) and np.isfinite(self.bias):
            p = self.marginals(self.emissions(token_features(vocab))[codes], starts)
            some = np.diff(starts) > 0
            score[some] = np.maximum.reduceat(p, starts[:-1][some])
        return np.clip(score, 0, 1), p, starts

    def emissions(self, features: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(features), self.bias, np.float32)
        at = np.minimum(np.searchsorted(self.keys, features), len(self.keys) - 1)
        return (np.where(self.keys[at] == features, self.weights[at], 0).sum(axis=1) + self.bias).astype(np.float32)


def _runs(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Lay texts out as rows of at most ``RUN`` tokens, padded with -inf; each token's cell, and which rows begin a text."""
    n = np.diff(starts)
    rows = (n + RUN - 1) // RUN
    first = np.cumsum(rows) - rows
    place = np.arange(len(values)) - np.repeat(starts[:-1], n)
    cell = (np.repeat(first, n) + place // RUN, place % RUN)
    grid = np.full((int(rows.sum()), RUN), -np.inf, np.float32)
    grid[cell] = values
    head = np.zeros(len(grid), bool)
    head[first[n > 0]] = True
    return grid, cell, head


def row_messages(grid: np.ndarray, live: np.ndarray, trans: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Messages into the rows of texts of several rows: forward (nan: the row begins a text) and backward.

    A row is a 2x2 product of its tokens' steps, made for all rows at once; the messages then go
    from row to row, for all texts at once.
    """
    t = np.exp(trans)
    long = ~head
    long[:-1] |= ~head[1:]
    at = np.nonzero(long)[0]
    phi = np.exp(np.clip(np.where(live[at], grid[at], 0), -30, 30)).astype(np.float64)
    begins = head[at]
    step = np.where(begins, np.eye(2)[:, :, None], t[:, :, None])
    step[:, 1] *= phi[:, 0]
    for k in range(1, grid.shape[1]):
        to0 = step[:, 0] * t[0, 0] + step[:, 1] * t[1, 0]
        to1 = (step[:, 0] * t[0, 1] + step[:, 1] * t[1, 1]) * phi[:, k]
        total = (to0 + to1).sum(axis=0)
        use = live[at, k]
        step[:, 0], step[:, 1] = np.where(use, to0 / total, step[:, 0]), np.where(use, to1 / total, step[:, 1])
    first = np.nonzero(begins)[0]
    rows = np.diff(np.append(first, len(at)))
    order = np.argsort(-rows, kind="stable")
    first, rows = first[order], rows[order]
    enter, leave = np.full((2, len(grid)), np.nan), np.ones((2, len(grid)))
    most = int(rows[0])
    active = np.searchsorted(-rows, -np.arange(most))       # texts with more than so many rows
    a = np.ones((2, len(rows)))
    for j in range(most - 1):
        a = a[:, :active[j + 1]]
        m = step[:, :, first[:active[j + 1]] + j]
        a = a[0] * m[0] + a[1] * m[1]
        a /= a.sum(axis=0)
        enter[:, at[first[:active[j + 1]] + j + 1]] = a
    b = np.ones((2, len(rows)))
    for j in range(most - 1, 0, -1):
        m = step[:, :, first[:active[j]] + j]
        back = m[:, 0] * b[0, :active[j]] + m[:, 1] * b[1, :active[j]]
        b[:, :active[j]] = back / back.sum(axis=0)
        leave[:, at[first[:active[j]] + j - 1]] = b[:, :active[j]]
    return enter, leave


def chained(grid: np.ndarray, live: np.ndarray, trans: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``forward_backward`` of one chain over each whole text; a row that is not ``head`` goes on where the row above ends."""
    return forward_backward(grid, live, trans, *(() if head.all() else row_messages(grid, live, trans, head)))


def forward_backward(grid: np.ndarray, live: np.ndarray, trans: np.ndarray, enter: np.ndarray | None = None,
                     leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 per cell and expected transitions (2x2), for all rows at once.

    ``enter`` and ``leave``: messages from the row above (nan: none) and from the row below.
    """
    phi = np.exp(np.clip(np.where(live, grid, 0), -30, 30)).astype(np.float64)
    t = np.exp(trans)
    rows, width = grid.shape
    alpha = np.zeros((width, 2, rows))
    a0, a1 = np.ones(rows), phi[:, 0].copy() if width else np.ones(rows)
    if enter is not None:
        on = ~np.isnan(enter[0])
        a0 = np.where(on, enter[0] * t[0, 0] + enter[1] * t[1, 0], a0)
        a1 = np.where(on, (enter[0] * t[0, 1] + enter[1] * t[1, 1]) * phi[:, 0], a1)
    for k in range(width):
        if k:
            b0, b1 = a0 * t[0, 0] + a1 * t[1, 0], (a0 * t[0, 1] + a1 * t[1, 1]) * phi[:, k]
            a0, a1 = np.where(live[:, k], b0, a0), np.where(live[:, k], b1, a1)
        total = a0 + a1
        a0, a1 = a0 / total, a1 / total
        alpha[k, 0], alpha[k, 1] = a0, a1
    out = np.zeros((rows, width), np.float32)
    moves = np.zeros((2, 2))
    b0, b1 = (np.ones(rows), np.ones(rows)) if leave is None else leave
    for k in range(width - 1, -1, -1):
        p0, p1 = alpha[k, 0] * b0, alpha[k, 1] * b1
        out[:, k] = np.where(live[:, k], p1 / (p0 + p1), 0)
        if not k and enter is None:
            break
        e1 = phi[:, k] * b1
        before = alpha[k - 1] if k else enter
        c00, c01 = before[0] * t[0, 0] * b0, before[0] * t[0, 1] * e1
        c10, c11 = before[1] * t[1, 0] * b0, before[1] * t[1, 1] * e1
        total = c00 + c01 + c10 + c11
        use = live[:, k] if k else on
        for i, j, c in ((0, 0, c00), (0, 1, c01), (1, 0, c10), (1, 1, c11)):
            moves[i, j] += (c / total)[use].sum()
        n0, n1 = t[0, 0] * b0 + t[0, 1] * e1, t[1, 0] * b0 + t[1, 1] * e1
        total = n0 + n1
        b0, b1 = np.where(use, n0 / total, b0), np.where(use, n1 / total, b1)
    return out, moves


def _blocks(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of texts of about ``BLOCK_TOKENS`` tokens; a longer text is a run of its own."""
    out, a = [], 0
    while a < len(starts) - 1:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + BLOCK_TOKENS, side="right")) - 1)
        out.append((a, b))
        a = b
    return out


def toxic_features(starts: np.ndarray, codes: np.ndarray, features: np.ndarray, toxic: np.ndarray, size: int) -> np.ndarray:
    """Which features (below ``size``, 0: none) mark toxic tokens, from the documents' words and labels.

    A feature's toxic documents count as often as the words before it differ, so that copies of
    one toxic document do not make all of its words suspicious.
    """
    docs, found, contexts = [], [], []
    for a, b in _blocks(starts):    # a document is in one block, so pairs are distinct over all blocks
        c, n = codes[starts[a]: starts[b]], np.diff(starts[a: b + 1])
        doc = np.repeat(np.arange(a, b), n)
        before = np.roll(c, 1).astype(np.int64)
        before[(starts[a:b] - starts[a])[n > 0]] = -1
        bad = toxic[doc]
        own, near = [], []
        for column in features.T:
            f = column[c].astype(np.int64)
            own.append(np.unique(doc * size + f))
            near.append(np.unique((before[bad] + 1) * size + f[bad]))
        pair = np.unique(np.concatenate(own))
        pair = pair[pair % size > 0]
        docs.append((pair // size).astype(np.int32))
        found.append((pair % size).astype(np.int32))
        contexts.append(np.unique(np.concatenate(near)))
    d, f = np.concatenate(docs), np.concatenate(found)
    del docs, found
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    misses = np.bincount(f[~toxic[d]], minlength=size)
    places = np.unique(np.concatenate(contexts)) % size
    hits = np.minimum(np.bincount(f[toxic[d]], minlength=size), np.bincount(places, minlength=size))
    share = n_toxic / (n_toxic + n_clean)
    rare = misses * n_toxic <= 0.02 * hits * n_clean
    # Chance that so many of its documents are toxic without any tie to toxicity.
    mark = rare & (hits >= 3) & (hits * np.log10(share) < -5)
    covered = np.zeros(len(toxic), bool)
    covered[d[mark[f]]] = True
    while True:
        open_ = toxic[d] & ~covered[d]
        gain = np.where(rare & (hits >= 3), np.bincount(f[open_], minlength=size), 0)
        best = int(gain.argmax())
        if gain[best] < 3:
            return mark
        mark[best] = True
        covered[d[f == best]] = True


def fit_chain(texts: pa.Array, toxic: np.ndarray, rounds: int = 60) -> Chain:
    """Train the chain on sampled texts and their document labels."""
    nothing = Chain(np.zeros(0, np.uint64), np.zeros(0, np.float32), -np.inf, np.zeros((2, 2)))
    codes, vocab, starts = words_of(texts, "utf8")
    if not toxic.any() or toxic.all() or not len(codes):
        return nothing
    keys, features = np.unique(np.concatenate([[np.uint64(0)], token_features(vocab).ravel()]), return_inverse=True)
    features, size = features[1:].reshape(len(vocab), -1).astype(np.int32), len(keys)
    words = len(vocab)
    del texts, vocab
    mark = toxic_features(starts, codes, features, toxic, size)
    gold = mark[features].any(axis=1)[codes] & np.repeat(toxic, np.diff(starts))
    if not gold.any():
        return nothing
    same = np.ones(len(codes) + 1, bool)
    same[starts] = False            # no transition into a text's first token
    same = same[1:-1]
    seen = np.array([[((gold[:-1] == i) & (gold[1:] == j) & same).sum() for j in (0, 1)] for i in (0, 1)], np.float64)
    seen_f = np.bincount(features.ravel(), weights=np.repeat(np.bincount(codes[gold], minlength=words), features.shape[1]), minlength=size)
    # Parameters: feature weights, the bias, and the transitions; Adam on the exact gradient.
    theta = np.zeros(size + 5)
    theta[size] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = len(codes)
    for step in range(1, rounds + 1):
        e = (theta[features].sum(axis=1) + theta[size]).astype(np.float32)
        moves, by_word = np.zeros((2, 2)), np.zeros(words)
        for a, b in _blocks(starts):
            c = codes[starts[a]: starts[b]]
            grid, cell, head = _runs(e[c], starts[a: b + 1] - starts[a])
            p, some = chained(grid, np.isfinite(grid), theta[size + 1:].reshape(2, 2), head)
            moves += some
            by_word += np.bincount(c, weights=p[cell], minlength=words)
        grad = np.zeros_like(theta)
        grad[:size] = seen_f - np.bincount(features.ravel(), weights=np.repeat(by_word, features.shape[1]), minlength=size)
        grad[size] = gold.sum() - by_word.sum()
        grad[size + 1:] = (seen - moves).ravel()
        grad = grad / n * 100 - 1e-4 * theta
        grad[0] = 0  # the index that stands for no feature
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += 0.25 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
    keep = np.abs(theta[:size]) >= LEAST_WEIGHT
    return Chain(keys[keep], theta[:size][keep].astype(np.float32), float(theta[size]), theta[size + 1:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, learn_from: Column) -> Chain:
    """Fit on a bounded sample of the labelled documents for which ``learn_from`` (over doc_id) holds."""
    labelled = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(learn_from).distinct()
    picks = [labelled.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
             for k, most in ((1, TOXIC_DOCS), (0, CLEAN_DOCS))]
    # At most TOXIC_DOCS + CLEAN_DOCS rows are broadcast.
    sample = (docs.select("doc_id", "text").join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id")
              .dropDuplicates(["doc_id", "toxic"]).orderBy("doc_id", "toxic").toArrow())
    texts = sample.column("text").combine_chunks()
    texts = texts if isinstance(texts, pa.Array) else pa.array([], pa.string())
    return fit_chain(texts, sample.column("toxic").to_numpy() == 1)


def tag_documents(docs: DataFrame, chain: Chain, spans: bool = True) -> DataFrame:
    """(doc_id, score, spans): spans are the character offsets of tokens more likely toxic than not."""
    kept = chain

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                score, p, starts = kept.tag(part.column("text"))
                columns = [part.column("doc_id"), pa.array(score)]
                if spans:
                    found = [[] for _ in score]
                    for i in np.nonzero(score >= 0.5)[0]:
                        own = p[starts[i]: starts[i + 1]]
                        for k, hit in enumerate(WORD.finditer(part.column("text")[i].as_py())):
                            if own[k] >= 0.5:
                                found[i].append({"start": hit.start(), "end": hit.end(), "probability": float(own[k])})
                    columns.append(pa.array(found, SPANS))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "spans"][: len(columns)])

    kind = "doc_id long, score double" + ", spans array<struct<start:int,end:int,probability:double>>" * spans
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))


def score_toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column, spans: bool = False) -> DataFrame:
    """Train on the labelled rows that ``learn_from`` admits and score every document."""
    return tag_documents(docs, train(docs, labels, learn_from), spans)


def drop_toxic(docs: DataFrame, chain: Chain, threshold: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``."""
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield part.filter(pa.array(chain.tag(part.column("text"))[0] < threshold))
    return docs.mapInArrow(run, docs.schema)
