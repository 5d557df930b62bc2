"""Operator 9: hashed maximum-entropy language model with a class-factored softmax.

Method.  A token's slot is one of the ``HEAD`` most frequent training words, the end, or one of
``TAILS`` buckets of all other words by their ending.  The model is
P(class | history) P(slot | class, history) P(word | slot): two softmax factors over ``CLASSES``
classes of ``CLASSES`` slots, with weights of hashed n-gram and skip features (the words one, two
and three back, and the last two together), and add-one relative frequencies within a bucket,
one of whose events is "any unknown word".  In a history every word that occurs at least
``OWN_FROM`` times in training stands for itself, rarer ones for their bucket.  The feature
tables grow with the root of the number of such words, so what is learnt grows with the corpus.

Training.  Weights start from the slots' frequencies and are trained on every training document,
each in one of ``ROUNDS`` synchronous rounds.  A round deals its documents by hash to shards of
about ``SHARD_TOKENS`` tokens; one task takes gradient steps over a shard in id order, and the
mean of the shards' updates, weighted by tokens, is applied.  Shards and their order depend on
the documents alone, so the scores do not depend on the cluster or on how the input is split.

Counts.  Texts are read once, in chunks of bounded size.  A chunk's distinct words and its
documents' word codes are written; words are counted over all chunks (combined per chunk first,
so a frequent word is a few rows), joined back to the chunks' words, and only numbers meet the
documents again.  Neither vocabulary nor counts pass through the driver; it holds the head
words, the bucket totals and the weights.

Defined results: a null or empty text is the end alone; rows that repeat score alike; a null
doc_id is not held out; without training documents every word is unknown and scores stay finite;
an empty table gives an empty result.  Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import mix64, stash, text_slices, words_of

CLASSES = 32
SLOTS = CLASSES * CLASSES
TAILS = 256
HEAD = SLOTS - TAILS - 1
END = HEAD                      # the end's slot; buckets follow it
FAR = 1 << 40                   # stands before a text's first token
OWN_FROM, MARKS = 16, 1 << 22   # words counted so often have a mark of their own above the slot's ten bits
WIDE, NARROW = 8192, 1024       # least feature rows of the class factor and of the slot factor
OWN_WORDS = 4096                # words with a mark that the least tables are meant for
CHUNK_BYTES = 12 << 20
ROUNDS = 3
STEP_TOKENS = 16384
CACHE_TOKENS = 2048             # tokens whose factors are computed at once
EXP_SAFE = 60.0                 # exp of single precision and sums of CLASSES of them are finite and not 0 within this
SHARD_TOKENS = 3_000_000
BLOCK = 1 << 16                 # weights to a block when updates are summed
FAN_IN = 64                     # updates of a block that one group sums


def table_rows(own_words: int) -> tuple[int, int]:
    """Feature rows of both factors: powers of two that grow with the root and the fourth root of the words."""
    doublings = max(0.0, np.log2(max(1, own_words) / OWN_WORDS))
    return WIDE << int(np.ceil(doublings / 2)), NARROW << int(np.ceil(doublings / 4))


@dataclass
class Weights:
    """Feature weights and biases of both factors."""

    a: np.ndarray       # (wide, CLASSES)
    a0: np.ndarray      # (CLASSES,)
    b: np.ndarray       # (narrow * CLASSES, CLASSES): feature row and class, slot within it
    b0: np.ndarray      # (CLASSES, CLASSES)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.a, self.a0, self.b, self.b0)])

    @classmethod
    def from_flat(cls, v: np.ndarray, wide: int = WIDE, narrow: int = NARROW) -> Weights:
        shapes = ((wide, CLASSES), (CLASSES,), (narrow * CLASSES, CLASSES), (CLASSES, CLASSES))
        at, out = 0, []
        for s in shapes:
            n = int(np.prod(s))
            out.append(v[at: at + n].reshape(s).astype(np.float32))
            at += n
        return cls(*out)


def slot_place() -> tuple[np.ndarray, np.ndarray]:
    """Class of each slot and its place there: slots are dealt out, so classes mix frequent and rare ones."""
    s = np.arange(SLOTS)
    return s % CLASSES, s // CLASSES


def features(w: Weights, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature rows of every token: four for the class factor, two for the slot factor."""
    n = len(codes)
    place = np.arange(n) - np.repeat(starts[:-1], np.diff(starts))
    back = []
    for k in (1, 2, 3):
        x = np.full(n, FAR, np.uint64)
        x[place >= k] = codes[np.nonzero(place >= k)[0] - k]
        back.append(x)
    keys = [x + np.uint64((k + 1) << 48) for k, x in enumerate(back)] + [mix64(back[0]) + back[1]]
    h = [mix64(k) for k in keys]
    wide = np.stack([(x % np.uint64(len(w.a))).astype(np.int32) for x in h], axis=1)
    narrow = np.stack([((x >> np.uint64(32)) % np.uint64(len(w.b) // CLASSES)).astype(np.int32) for x in h[:2]], axis=1)
    return wide, narrow


def _softmax(z: np.ndarray) -> np.ndarray:
    """Softmax of the rows, in place; the rows' maxima are taken off only where exp could overflow or vanish."""
    if z.max(initial=0.0) > EXP_SAFE or z.min(initial=0.0) < -EXP_SAFE:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z *= (1 / (z @ np.ones(z.shape[1], z.dtype)))[:, None]
    return z


def _rows_sum(table: np.ndarray, index: np.ndarray, out: np.ndarray, row: np.ndarray) -> None:
    """Sum of the table rows that each token's features name, into ``out``; all indexes are within the table."""
    table.take(index[:, 0], axis=0, out=out, mode="clip")
    for k in range(1, index.shape[1]):
        out += table.take(index[:, k], axis=0, out=row[:len(out)], mode="clip")


def _factors(w: Weights, wide: np.ndarray, narrow: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of both factors and the rows of the slot factor, in blocks that stay in the processor's cache."""
    rows = narrow * CLASSES + cls[:, None]
    pa_, pb = (np.empty((len(cls), CLASSES), np.float32) for _ in range(2))
    row = np.empty((CACHE_TOKENS, CLASSES), np.float32)
    for i in range(0, len(cls), CACHE_TOKENS):
        at = slice(i, i + CACHE_TOKENS)
        za, zb = pa_[at], pb[at]
        _rows_sum(w.a, wide[at], za, row)
        _rows_sum(w.b, rows[at], zb, row)
        za += w.a0
        zb += w.b0.take(cls[at], axis=0, out=row[:len(zb)], mode="clip")
        _softmax(za)
        _softmax(zb)
    return pa_, pb, rows


def log10_slots(w: Weights, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 probability of every token's slot (its code's low bits) given the codes before it."""
    out = np.zeros(len(codes))
    wide, narrow = features(w, codes, starts)
    class_of, place_in = slot_place()
    slots = codes % SLOTS
    for i in range(0, len(slots), STEP_TOKENS):
        s = slots[i: i + STEP_TOKENS]
        cls, place = class_of[s], place_in[s]
        pa_, pb, _ = _factors(w, wide[i: i + STEP_TOKENS], narrow[i: i + STEP_TOKENS], cls)
        at = np.arange(len(s))
        out[i: i + STEP_TOKENS] = np.log10(np.maximum(pa_[at, cls], 1e-30).astype(np.float64)) + np.log10(np.maximum(pb[at, place], 1e-30).astype(np.float64))
    return out


def _order(keys: np.ndarray, size: int) -> np.ndarray:
    """Stable order of keys below ``size``: by their low 16 bits, then by the next, each by radix."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    for shift in range(16, int(size - 1).bit_length(), 16):
        order = order[np.argsort((keys >> shift).astype(np.uint16)[order], kind="stable")]
    return order


def _add_rows(index: np.ndarray, values: np.ndarray, size: int, room: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sum ``values`` into the table rows that ``index`` (tokens by features) names: the touched rows, in any order, and their sums.

    Neighbours among the values of a row are added pair by pair until one is left, so every step is a few
    operations on whole rows; rows that are done leave.  ``room``: three buffers of half as many rows as ``index`` has
    numbers, to be used again and again.
    """
    flat = index.T.ravel()
    if room is None:
        room = np.empty((3, len(flat) // 2, values.shape[1]), values.dtype)
    order = _order(flat, size)
    sorted_ = flat[order]
    start = np.nonzero(np.diff(sorted_, prepend=-1))[0]
    left, to = np.diff(start, append=len(flat)), sorted_[start]     # values left to each row, and the row
    touched, sums, filled = np.empty_like(to), np.empty((len(to), values.shape[1]), values.dtype), 0
    take, source, level = np.tile(np.arange(len(values)), index.shape[1])[order], values, 0
    while len(to):
        done = left == 1
        gone = start[done]
        touched[filled: filled + len(gone)] = to[done]
        source.take(take[gone], axis=0, out=sums[filled: filled + len(gone)], mode="clip")
        filled += len(gone)
        more = ~done
        to, start, left = to[more], start[more], left[more]
        half = left >> 1
        ends = np.cumsum(half)
        n = int(ends[-1]) if len(ends) else 0
        at = np.arange(n) * 2 + np.repeat(start - 2 * (ends - half), half)     # first place of every pair
        pairs = source.take(take[at], axis=0, out=room[level % 2, :n], mode="clip")
        pairs += source.take(take[at + 1], axis=0, out=room[2, :n], mode="clip")
        odd = np.nonzero(left & 1)[0]       # the value without a partner joins the row's last pair
        pairs[ends[odd] - 1] += source.take(take[start[odd] + left[odd] - 1], axis=0)
        take, source, start, left, level = np.arange(n), pairs, ends - half, half, level + 1
    return touched, sums


def _add_few(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sum of ``values`` by ``index`` for a table of few rows, all of them."""
    order = _order(index, size)
    ends = np.cumsum(np.bincount(index, minlength=size))
    held = values.take(order, axis=0)
    return np.stack([held[a:b].sum(axis=0) for a, b in zip([0, *ends[:-1]], ends)])


def _step(table: np.ndarray, acc: np.ndarray, touched: np.ndarray, total: np.ndarray, rate: float) -> None:
    """One Adagrad step on the touched rows, each named once; a row's coordinates share a pace."""
    now = acc[touched] + np.einsum("ij,ij->i", total, total) / total.shape[1]
    acc[touched] = now
    total *= (rate / np.sqrt(now))[:, None]
    whole = np.dtype((np.void, total.itemsize * total.shape[1]))      # a row as one value, which is quicker to put back
    held = np.empty((CACHE_TOKENS, total.shape[1]), total.dtype)
    for i in range(0, len(touched), CACHE_TOKENS):
        at = touched[i: i + CACHE_TOKENS]
        rows = table.take(at, axis=0, out=held[:len(at)], mode="clip")
        rows -= total[i: i + CACHE_TOKENS]
        table.view(whole)[at, 0] = rows.view(whole)[:, 0]


def train_share(w: Weights, docs: Iterator[tuple[np.ndarray, np.ndarray]], rate: float) -> tuple[Weights, int]:
    """Adagrad steps over one shard's documents, from the shared weights; new weights and tokens seen."""
    w = Weights(w.a.copy(), w.a0.copy(), w.b.copy(), w.b0.copy())
    ga, gb, g0 = (np.full(len(x), 1e-2, np.float32) for x in (w.a, w.b, w.b0))
    class_of, place_in = slot_place()
    room = np.empty((3, STEP_TOKENS * 2, CLASSES), np.float32)      # enough for the class factor's four features
    seen = 0
    for codes, starts in docs:
        wide, narrow = features(w, codes, starts)
        slots = codes % SLOTS
        seen += len(slots)
        for i in range(0, len(slots), STEP_TOKENS):
            s = slots[i: i + STEP_TOKENS]
            n = len(s)
            cls, place = class_of[s], place_in[s]
            f = wide[i: i + n]
            da, db, rows = _factors(w, f, narrow[i: i + n], cls)
            row = np.arange(n) * CLASSES
            da.ravel()[row + cls] -= 1
            db.ravel()[row + place] -= 1
            for table, acc, index, grad in ((w.a, ga, f, da), (w.b, gb, rows, db)):
                touched, total = _add_rows(index, grad, len(table), room)
                total /= index.shape[1]
                _step(table, acc, touched, total, rate)
            _step(w.b0, g0, np.arange(CLASSES), _add_few(cls, db, CLASSES), 0.02 * rate)
            w.a0 -= 0.02 * da.mean(axis=0)
    return w, seen


def _planes(numbers: np.ndarray, pack: zstandard.ZstdCompressor) -> bytes:
    """Unsigned numbers below 2^32, compressed byte plane by byte plane."""
    return pack.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _from_planes(data: bytes, opener: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(opener.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _tail(word: Column) -> Column:
    """Slot of a word outside the head: a bucket by its last two characters."""
    return F.pmod(F.xxhash64(F.right(word, F.lit(2))), F.lit(TAILS)) + (END + 1)


def _code(word: Column, count: Column, head: Column) -> Column:
    """A word's code: its slot, and above it the mark of a word outside the head that is counted often enough."""
    mark = F.when(head.isNull() & (count >= OWN_FROM), F.pmod(F.xxhash64(word), F.lit(MARKS - 1)) + 1).otherwise(F.lit(0))
    return F.coalesce(head.cast("long"), _tail(word)) + mark * SLOTS


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each run, whatever stands before it, so that a text's sum is the same in any chunk."""
    out = np.zeros(len(starts) - 1, values.dtype)
    some = np.diff(starts) > 0
    if some.any():
        out[some] = np.add.reduceat(values, starts[:-1][some])
    return out


CHUNKS = ("chunk long, local int, word string, cnt long, doc_ids array<long>, lens array<int>, "
          "held array<boolean>, codes binary")


def _chunks(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row for each distinct word of a chunk, and one with the chunk's documents as word codes."""
    def run(batches):
        chunk = TaskContext.get().partitionId() << 24
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in text_slices(batch, "text", CHUNK_BYTES):
                codes, vocab, starts = words_of(part.column("text"), "ascii")
                n = np.diff(starts)
                held = part.column("held").to_numpy(zero_copy_only=False).astype(bool)
                counts = np.bincount(codes[~np.repeat(held, n)], minlength=len(vocab))
                k = len(vocab)
                nothing = lambda t: pa.nulls(k, t)
                lists = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
                if k:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k, chunk)), pa.array(np.arange(k), pa.int32()), vocab, pa.array(counts.astype(np.int64)),
                         *map(nothing, lists), nothing(pa.binary())], NAMES)
                one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk]), *(pa.nulls(1, t) for t in (pa.int32(), pa.string(), pa.int64())),
                     one(part.column("doc_id")), one(pa.array(n, pa.int32())), one(pa.array(held)),
                     pa.array([_planes(codes, pack)], pa.binary())], NAMES)
                chunk += 1
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held")).mapInArrow(run, CHUNKS)


NAMES = [x.split()[0] for x in CHUNKS.split(", ")]
CODED = ("doc_id long, held boolean, n_tokens long, n_known long, base double, within double, codes binary")


def _coded(chunks: DataFrame, counted: DataFrame, tail_size: np.ndarray, total: int, distinct: int, ends: int) -> DataFrame:
    """Per document: counts, base score, log10 within buckets, and the codes of its tokens."""
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        local = right.column("local").to_numpy()
        c, code = np.zeros(len(local), np.int64), np.zeros(len(local), np.int64)
        c[local], code[local] = right.column("c").to_numpy(), right.column("code").to_numpy()
        slot = code % SLOTS
        base = np.log10((c + 1) / (total + distinct + 1))
        in_tail = slot > END
        within = np.zeros(len(c))
        within[in_tail] = np.log10((c[in_tail] + 1) / tail_size[slot[in_tail] - END - 1])
        opener, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        out = []
        for r in range(left.num_rows):
            codes = _from_planes(left.column("codes")[r].as_py(), opener)
            n = left.column("lens")[r].values.to_numpy().astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(n)])
            base_sum, within_sum, known = (_sums(x[codes], starts) for x in (base, within, (c > 0).astype(np.int64)))
            spread = code[codes]
            packed = [_planes(spread[a:b], pack) for a, b in zip(starts[:-1], starts[1:])]
            out.append(pa.table([left.column("doc_ids")[r].values, left.column("held")[r].values, pa.array(n + 1),
                                 pa.array(known + (ends > 0)), pa.array(base_sum + np.log10((ends + 1) / (total + distinct + 1))),
                                 pa.array(within_sum), pa.array(packed, pa.binary())], names=CODED_NAMES))
        return pa.concat_tables(out)

    return (chunks.where("codes IS NOT NULL").select("chunk", "doc_ids", "lens", "held", "codes").groupBy("chunk")
            .cogroup(counted.groupBy("of")).applyInArrow(run, CODED))


CODED_NAMES = [x.split()[0] for x in CODED.split(", ")]


def _code_batches(batches, opener, size: int = 400_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Documents with their codes, the end included, in runs of bounded size."""
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        ends = np.cumsum(n)
        at = 0
        while at < len(n):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            part = batch.slice(at, stop - at)
            starts = np.concatenate([[0], np.cumsum(n[at:stop])])
            codes = np.full(int(starts[-1]), END, np.int64)
            for i, z in enumerate(part.column("codes").to_pylist()):
                codes[starts[i]: starts[i + 1] - 1] = _from_planes(z, opener)
            yield part, codes, starts
            at = stop


def _joined_runs(runs: Iterator[tuple[np.ndarray, np.ndarray]], size: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same documents in runs of at least ``size`` tokens, wherever the batches were cut."""
    held, tokens = [], 0
    for codes, starts in runs:
        for i in range(len(starts) - 1):
            held.append(codes[starts[i]: starts[i + 1]])
            tokens += len(held[-1])
            if tokens >= size:
                yield np.concatenate(held), np.concatenate([[0], np.cumsum([len(x) for x in held])])
                held, tokens = [], 0
    if held:
        yield np.concatenate(held), np.concatenate([[0], np.cumsum([len(x) for x in held])])


CHANGE = "part long, block int, seen long, change binary"


def _summing(kind: type) -> Callable[[pa.Table], pa.Table]:
    """Sums a block's updates in the order of their parts: a shard's change (half precision) times its tokens, or sums of such."""
    def summed(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        opener, total = zstandard.ZstdDecompressor(), 0.0
        for z, seen in zip(table.column("change").to_pylist(), table.column("seen").to_pylist()):
            total = total + np.frombuffer(opener.decompress(z), kind).astype(np.float64) * (seen if kind is np.float16 else 1)
        packed = zstandard.ZstdCompressor(level=1).compress(total.astype(np.float32).tobytes())
        return pa.table({"part": pa.array([table.column("part")[0].as_py() // FAN_IN], pa.int64()), "block": table.column("block")[:1],
                         "seen": pa.array([sum(table.column("seen").to_pylist())], pa.int64()), "change": pa.array([packed], pa.binary())})
    return summed


def _train(coded: DataFrame, now: np.ndarray, wide: int, narrow: int, tokens: int) -> np.ndarray:
    """Synchronous rounds over shards; each document takes part in one round.  ``now``: the flat weights, changed in place."""
    spark = coded.sparkSession
    shards = max(1, -(-tokens // (ROUNDS * SHARD_TOKENS)))
    place = F.xxhash64("doc_id", "n_tokens", "n_known")
    for step in range(ROUNDS):
        share = (coded.where("NOT held").where(F.pmod(place, F.lit(ROUNDS)) == step)
                 .select(F.pmod(F.xxhash64(place), F.lit(shards)).cast("int").alias("shard"), "doc_id", "n_tokens", "n_known", "codes")
                 .repartitionById(shards, F.col("shard")).sortWithinPartitions("doc_id", "n_tokens", "n_known", "codes"))
        shared = spark.sparkContext.broadcast(now)
        rate = 0.3 / (1 + step)

        def run(batches):
            opener, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
            first = next(batches, None)
            if first is None:
                return
            shard = first.column("shard")[0].as_py()        # a partition is one shard
            runs = ((codes, at) for _, codes, at in _code_batches(chain([first], batches), opener))
            new, seen = train_share(Weights.from_flat(shared.value, wide, narrow), _joined_runs(runs), rate)
            change = (new.flat() - shared.value).astype(np.float16)
            for block, at in enumerate(range(0, len(change), BLOCK)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int64()), pa.array([block], pa.int32()), pa.array([seen], pa.int64()),
                     pa.array([pack.compress(change[at: at + BLOCK].tobytes())], pa.binary())], ["part", "block", "seen", "change"])

        rows, groups, kind = share.mapInArrow(run, CHANGE), shards, np.float16
        while kind is np.float16 or groups > 1:
            rows = rows.groupBy((F.col("part") / FAN_IN).cast("long"), "block").applyInArrow(_summing(kind), CHANGE)
            groups, kind = -(-groups // FAN_IN), np.float32
        opener = zstandard.ZstdDecompressor()
        for r in rows.collect():        # one row a block of the weights
            at = slice(r["block"] * BLOCK, (r["block"] + 1) * BLOCK)
            now[at] += np.frombuffer(opener.decompress(r["change"]), np.float32) / np.float32(r["seen"])
        shared.destroy()        # the driver's copy goes as well
    return now


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), learnt where ``held_out`` is false."""
    chunks = stash(_chunks(docs, held_out), "lm-chunks")
    words = chunks.where("word IS NOT NULL").select("chunk", "local", "word", "cnt")
    counts = stash(words.where("cnt > 0").groupBy("word").agg(F.sum("cnt").alias("c")), "lm-counts")
    ends = chunks.where("codes IS NOT NULL").select(
        F.size(F.filter("held", lambda h: ~h)).alias("n")).agg(F.sum("n").alias("n")).first()["n"] or 0
    head = counts.orderBy(F.desc("c"), "word").limit(HEAD).select("word").collect()
    head = docs.sparkSession.createDataFrame([(r["word"], i) for i, r in enumerate(head)], "word string, head int")
    by_slot = (counts.join(F.broadcast(head), "word", "left")      # at most HEAD rows are broadcast
               .groupBy(F.coalesce(F.col("head").cast("long"), _tail(F.col("word"))).alias("slot"))
               .agg(F.sum("c").alias("c"), F.count("*").alias("v"), F.count_if(F.col("head").isNull() & (F.col("c") >= OWN_FROM)).alias("own")).collect())        # at most one row a slot
    mass, kinds = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    for r in by_slot:
        mass[r["slot"]], kinds[r["slot"]] = r["c"], r["v"]
    mass[END] = ends
    total, distinct = int(mass.sum()), int(kinds.sum()) + (ends > 0)
    tail_size = (mass + kinds + 1)[END + 1:]
    counted = (words.join(counts.select("word", "c"), "word", "left").join(F.broadcast(head), "word", "left")
               .select(F.col("chunk").alias("of"), "local", F.coalesce("c", F.lit(0)).alias("c"),
                       _code(F.col("word"), F.col("c"), F.col("head")).alias("code")))
    coded = stash(_coded(chunks, counted, tail_size, total, distinct, ends), "lm-coded")
    # The weights start from the slots' relative frequencies.
    cls, place = slot_place()
    events = mass.astype(np.float64)
    events[END + 1:] += kinds[END + 1:] + 1
    events = np.maximum(events, 0.5)
    grid = np.zeros((CLASSES, CLASSES))
    grid[cls, place] = events
    wide, narrow = table_rows(sum(r["own"] for r in by_slot))
    start = Weights(np.zeros((wide, CLASSES), np.float32), np.log(grid.sum(axis=1) / grid.sum()).astype(np.float32),
                    np.zeros((narrow * CLASSES, CLASSES), np.float32), np.log(grid / grid.sum(axis=1, keepdims=True)).astype(np.float32)).flat()
    model = docs.sparkSession.sparkContext.broadcast(_train(coded, start, wide, narrow, total))

    def run(batches):
        w = Weights.from_flat(model.value, wide, narrow)
        opener = zstandard.ZstdDecompressor()
        for part, codes, starts in _code_batches(batches, opener):
            sums = np.add.reduceat(log10_slots(w, codes, starts), starts[:-1])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held"), part.column("n_tokens"), part.column("n_known"),
                 pa.array(np.full(len(sums), total)), part.column("base"), pa.array(sums + part.column("within").to_numpy())],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
