"""Operator 4: MinHash near-duplicates with tensored banding.

Method.  A document's set is its distinct word shingles.  Two small collections of half keys,
each the hash of ``HALF`` minhashes, are computed per set; every combination of a half key of
the first and one of the second collection is the key of one of ``LEFT * RIGHT`` tables, so 32
minhashes serve 64 tables of four.  A pair at similarity s is found with probability
(1 - (1 - s^2)^8)^2: 0.9994 at 0.8 and 0.99999 at 0.9.

Candidates are verified on full sets.  Equal sets are one class from the start.  Round one
verifies each member of a bucket against the bucket's smallest class.  For the classes of buckets
that still hold several components, the shingles that none of the others has are counted: two
sets of sizes nx, ny with ux, uy such shingles share at most min(nx - ux, ny - uy) and together
have at least max(nx + uy, ny + ux), an exact bound that rules out almost all pairs of copies of
one text that differ too much.  Round two verifies against each bucket's class with the fewest
such shingles.  Round three compares, for the buckets of one such class together, every member
outside its component with all members, in blocks of bounded size inside tasks: no pairs are
emitted but links.  So no link inside a bucket goes untested but those whose ends are already connected.
Components come from alternating large-star and small-star steps over the confirmed links.

Skew: aggregates are combined map-side; joins on a hot set, bucket or representative have one
row per key on the other side, which adaptive execution splits; only candidates' texts move.

Defined results: a document without words (or text) has an empty set and is linked with
nothing; with fewer words than the shingle's, the whole sequence is its only shingle.  Rows with
a null doc_id are linked with nothing, have a null component and are kept.  Repeated rows share
their class; a doc_id that stands for several texts goes, row by row, with each text's class.
An empty table gives an empty result.  Only the id and the text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import byte_view, hash_spans, mix64, stash, text_slices, words_of

HALF, LEFT, RIGHT = 2, 8, 8
HASHES = HALF * (LEFT + RIGHT)
#: Members of a block pair in the last round.
MINOR, ALL = 256, 1024
SEEDS = np.random.default_rng(4711).integers(1, 2 ** 63, (HASHES, 2), dtype=np.uint64)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, concatenated, and the ``n + 1`` starts."""
    codes, vocab, starts = words_of(texts, "ascii")
    n = np.diff(starts)
    raw, at = byte_view(vocab)
    h = hash_spans(raw, at[:-1], at[1:])[codes] if len(vocab) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - starts[:-1][doc]
    short = np.minimum(n, width)                        # words in each of the text's shingles
    first = place <= (n - short)[doc]                   # words that begin a shingle
    begin, owner = np.nonzero(first)[0], doc[first]
    value = np.full(len(begin), 0x2545F491, np.uint64) + short[owner].astype(np.uint64)
    for k in range(width):
        use = k < short[owner]
        value[use] = mix64(value[use] * np.uint64(0x9E3779B97F4A7C15) ^ h[begin[use] + k])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(np.bincount(owner[keep], minlength=len(n)), out=out[1:])
    return value[keep], out


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, d1, d2, left, right): set size, 128-bit set digest, half keys of both collections."""
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                flat, starts = shingle_sets(part.column("text"), width)
                n = np.diff(starts)
                some = np.nonzero(n)[0]
                at = starts[:-1][some]
                digest = np.zeros((2, len(n)), np.uint64)
                low = np.zeros((len(n), HASHES), np.uint64)
                if len(some):
                    for i, salt in enumerate((0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)):
                        digest[i, some] = np.add.reduceat(mix64(flat ^ np.uint64(salt)), at)
                    for k in range(HASHES):
                        low[some, k] = np.minimum.reduceat((flat ^ SEEDS[k, 0]) * (SEEDS[k, 1] | np.uint64(1)), at)
                halves = np.full((len(n), LEFT + RIGHT), 17, np.uint64) + np.arange(LEFT + RIGHT, dtype=np.uint64)
                for k in range(HALF):
                    halves = mix64(halves * np.uint64(0xD6E8FEB86659FD93) ^ low[:, k::HALF])
                fixed = lambda a: pa.ListArray.from_arrays(
                    pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(np.ascontiguousarray(a).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), *(pa.array(d.view(np.int64)) for d in digest), fixed(halves[:, :LEFT]),
                     fixed(halves[:, LEFT:])],
                    ["doc_id", "n", "d1", "d2", "left", "right"])
    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, left array<long>, right array<long>")


def _packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, z): compressed texts, so that less is shuffled."""
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([pack.compress((t or "").encode()) for t in part.column("text").to_pylist()], pa.binary())],
                    ["doc_id", "z"])
    return docs.mapInArrow(run, "doc_id long, z binary")


def _unpack(values: pa.Array) -> pa.Array:
    opener = zstandard.ZstdDecompressor()
    return pa.array([opener.decompress(z.as_py()) for z in values], pa.binary()).cast(pa.string())


def _texts_of(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(cid, n, d1, d2, z): the compressed text of each class in ``ids``, written to the shared folder."""
    sets = ids.join(classes.select("cid", "n", "d1", "d2"), "cid")
    return stash(_packed_texts(docs).join(sets, F.col("doc_id") == F.col("cid")).select("cid", "n", "d1", "d2", "z"), "candidates")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the threshold."""
    side = lambda x: texts.select(F.col("cid").alias(x), F.col("z").alias(f"z{x}"), F.col("n").alias(f"n{x}"))
    # Sorted by b on the way out of the last join: a representative's set is made once a run.
    both = pairs.join(side("a"), "a").join(side("b").hint("merge"), "b")

    def run(batches):
        last = (None, None, None)
        for batch in batches:
            for part in text_slices(batch, "za", 2 << 20):
                flat, starts = shingle_sets(_unpack(part.column("za")), width)
                b, nb, zb = part.column("b").to_pylist(), part.column("nb").to_pylist(), part.column("zb")
                keep = np.zeros(len(b), bool)
                for i in range(len(b)):
                    if last[:2] != (b[i], nb[i]):
                        last = (b[i], nb[i], shingle_sets(_unpack(zb.slice(i, 1)), width)[0])
                    x, y = flat[starts[i]: starts[i + 1]], last[2]
                    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        continue
                    where = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    common = int((y[where] == x).sum())
                    keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep))
    return both.select("a", "b", "nb", "za", "zb").mapInArrow(run, "a long, b long").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of the edges (a, b) but the labels themselves.

    Alternating large-star and small-star steps; every round is written to the shared folder.
    """
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = stash(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                    .unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = tuple(now.agg(F.count("u"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = state


def _alone(texts: DataFrame, width: int) -> DataFrame:
    """(cid, alone): how many of a class's shingles no other of these classes has."""
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "z", 1 << 20):
                flat, starts = shingle_sets(_unpack(part.column("z")), width)
                owner = np.repeat(part.column("cid").to_numpy(), np.diff(starts))
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(flat.view(np.int64))], ["cid", "h"])
    shingles = texts.select("cid", "z").mapInArrow(run, "cid long, h long")
    return (shingles.groupBy("h").agg(F.min("cid").alias("cid"), F.max("cid").alias("most")).where("cid = most")
            .groupBy("cid").agg(F.count("*").alias("alone")))


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, cid, label) of the buckets that hold more than one component."""
    held = (members.select("key", "cid").join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left")
            .select("key", "cid", F.coalesce("label", "cid").alias("label")))
    open_ = held.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    return held.join(open_.select("key"), "key")


def _possible(percent: int):
    """Whether sets of nx and ny shingles, ux and uy of them in no other set, can reach the threshold."""
    common = F.least(F.col("nx") - F.col("ux"), F.col("ny") - F.col("uy"))
    union = F.greatest(F.col("nx") + F.col("uy"), F.col("ny") + F.col("ux"))
    return F.lit(100) * common >= F.lit(percent) * union


def _links_in_groups(groups: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between a group's ``main`` component and its other members, and among these.

    ``groups``: (y, cid, label, main), the buckets of one central class y taken together.  The
    members outside the main component meet all members block by block, a task holding at most
    about MINOR of the former and ALL of the latter; their exact overlaps come from an inverted
    list of the block.  One link is returned for each class and component it is linked with.
    """
    sizes = (groups.groupBy("y").agg(F.count_if(F.col("label") != F.col("main")).alias("m"), F.count("*").alias("k")).where("m > 0")
             .select("y", F.ceil(F.col("m") / MINOR).alias("mb"), F.ceil(F.col("k") / ALL).alias("kb")))
    rows = groups.join(sizes, "y").join(texts.select("cid", "z"), "cid")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    minor = (rows.where(F.col("label") != F.col("main")).withColumn("i", F.pmod(F.xxhash64("cid"), F.col("mb"))).withColumn("j", upto("kb"))
             .select("y", "i", "j", "cid", "label", "z"))
    every = (rows.withColumn("j", F.pmod(F.xxhash64("cid", F.lit(7)), F.col("kb"))).withColumn("i", upto("mb"))
             .select(F.col("y").alias("y2"), F.col("i").alias("i2"), F.col("j").alias("j2"),
                     F.col("cid").alias("c2"), F.col("label").alias("l2"), F.col("z").alias("z2")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            flat, starts = shingle_sets(_unpack(right.column("z2")), width)
            size = np.diff(starts)
            owner = np.repeat(np.arange(len(size)), size)
            order = np.argsort(flat, kind="stable")
            values, first = np.unique(flat[order], return_index=True)
            owners, first = owner[order], np.append(first, len(flat))
            ids, labels = right.column("c2").to_numpy(), right.column("l2").to_numpy()
            own, at = shingle_sets(_unpack(left.column("z")), width)
            for r, (cid, label) in enumerate(zip(left.column("cid").to_pylist(), left.column("label").to_pylist())):
                x = own[at[r]: at[r + 1]]
                where = np.minimum(np.searchsorted(values, x), len(values) - 1)
                where = where[values[where] == x] if len(values) else where[:0]
                n = first[where + 1] - first[where]
                ends = np.cumsum(n)
                index = np.repeat(first[where] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
                common = np.bincount(owners[index], minlength=len(size))
                hit = np.nonzero((100 * common >= percent * (len(x) + size - common)) & (labels != label))[0]
                _, one = np.unique(labels[hit], return_index=True)
                a += [cid] * len(one)
                b += ids[hit[one]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return minor.groupBy("y", "i", "j").cogroup(every.groupBy("y2", "i2", "j2")).applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    ``width``: words in a shingle; ``percent``: least similarity of a link, 100 |A∩B| / |A∪B|.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stash(_signatures(docs, width), "signatures")
    live = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = stash(live.groupBy("d1", "d2").agg(
        F.min("doc_id").alias("cid"), *(F.first(c).alias(c) for c in ("n", "left", "right"))), "classes")
    keys = classes.select("cid", F.explode(F.flatten(F.transform(
        "left", lambda x: F.transform("right", lambda y: F.xxhash64(x, y))))).alias("key"))
    buckets = keys.groupBy("key").agg(F.min("cid").alias("rep"), F.max("cid").alias("most")).where("rep <> most")
    members = stash(keys.join(buckets.select("key", "rep"), "key"), "members")
    first = members.where("cid <> rep").select(F.col("cid").alias("a"), F.col("rep").alias("b")).distinct()
    ends = first.select(F.col("a").alias("cid")).unionByName(first.select(F.col("b").alias("cid"))).distinct()
    labels = connected_components(_verified(first, _texts_of(ends, classes, docs), width, percent))

    held = stash(_open_buckets(members, labels), "open")
    texts = _texts_of(held.select("cid").distinct(), classes, docs)
    sizes = stash(texts.select("cid", "n").join(_alone(texts, width), "cid", "left").select("cid", "n", F.coalesce("alone", F.lit(0)).alias("u")), "sizes")
    joined = held.select("key", "cid").join(sizes, "cid")
    central = joined.groupBy("key").agg(F.min(F.struct("u", "cid", "n")).alias("y")).select("key", F.col("y.cid").alias("y"), F.col("y.u").alias("uy"), F.col("y.n").alias("ny"))
    central = stash(central, "central")

    def labelled(rows: DataFrame, labels: DataFrame, x: str) -> DataFrame:
        return (rows.join(labels.select(F.col("node").alias(x), F.col("label").alias("l" + x)), x, "left")
                .withColumn("l" + x, F.coalesce("l" + x, x)))

    def tested(pairs: DataFrame) -> DataFrame:
        found = _verified(pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), texts, width, percent)
        return connected_components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(found))

    sized = held.select("key", F.col("cid").alias("x"), F.col("label").alias("lx")).join(sizes.select(F.col("cid").alias("x"), F.col("n").alias("nx"), F.col("u").alias("ux")), "x")
    labels = tested(labelled(sized.join(central, "key").where(_possible(percent) & (F.col("x") != F.col("y"))), labels, "y").where("lx <> ly"))

    held = _open_buckets(held.select("key", "cid"), labels).join(labelled(central.select("key", "y"), labels, "y"), "key")
    groups = stash(held.select("y", "cid", "label", F.col("ly").alias("main")).distinct(), "groups")
    labels = connected_components(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
                                  .unionByName(_links_in_groups(groups, texts, width, percent)))
    named = (classes.select("d1", "d2", "cid").join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left")
             .select("d1", "d2", F.coalesce("label", "cid").alias("label")))
    return (signed.select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("label")).otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without the near copies: one document of each component stays."""
    kept = near_duplicates(docs, width, percent).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    found = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    # Rows that repeat an id with the same text are one document.
    return found.withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text"]).select(*docs.columns)
