"""Vector codes, centroids and WARC archives against brute force, odd tables and damaged files."""

import hashlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from kestrel.llm import centroids, common, registry, vector_codes, warc

VECTORS = "vec_id long, embedding array<double>, label string, v int, g int, slot int"


def rows_of(vectors, ids=None, labels=None):
    ids = range(len(vectors)) if ids is None else ids
    labels = [None if i % 5 == 0 else f"l{i % 3}" for i in range(len(vectors))] if labels is None else labels
    return [(i, None if v is None else [None if c is None else float(c) for c in v], lab, 7, 7, 7) for i, v, lab in zip(ids, vectors, labels)]


BAD = [None, [], [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [0.0] * 15, [1e300] + [0.0] * 15]


def lloyd(vectors, starts, rounds):
    """Plain rounds in Python integers; ties to the lower index, empty centres stay."""
    centres = [list(map(int, s)) for s in starts]
    vectors = [list(map(int, v)) for v in vectors]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
        return d.index(min(d)), min(d)
    for _ in range(rounds):
        own = [nearest(v)[0] for v in vectors]
        for c in range(len(centres)):
            mine = [v for v, o in zip(vectors, own) if o == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return [nearest(v) for v in vectors], centres


def test_codes_equal_brute_force_with_ties_copies_and_bad_rows(spark):
    rng = np.random.default_rng(4)
    vectors = np.concatenate([rng.integers(-40, 40, (90, 16)) / 128, np.repeat(rng.integers(-3, 3, (2, 16)) / 8, 40, axis=0), np.zeros((5, 16))])
    ids = rng.permutation(len(vectors)) - 3
    frame = spark.createDataFrame(rows_of([*vectors, *BAD], [*ids.tolist(), *range(900, 900 + len(BAD))]), VECTORS).repartition(5)
    got = {r["vec_id"]: r for r in vector_codes.compressed_with_errors(frame, parts=4, entries=6, rounds=3).collect()}
    assert set(got) == set(ids.tolist())
    whole = np.floor(4096 * vectors).astype(int)
    order = np.argsort(ids)
    error, code, flat = np.zeros(len(ids), int), [""] * len(ids), []
    for p in range(4):
        piece = whole[:, 4 * p: 4 * p + 4]
        found, books = lloyd(piece, piece[order][:6], 3)
        flat += [x for book in books for x in book]
        for i, (entry, d) in enumerate(found):
            code[i] += f"{entry:02x}"
            error[i] += d
    labels = [r[2] for r in rows_of(vectors)]
    for i, vec in enumerate(ids.tolist()):
        assert (got[vec]["code"], got[vec]["error"]) == (code[i], error[i])
        assert got[vec]["label_error"] == sum(e for e, lab in zip(error, labels) if lab == labels[i])
        assert got[vec]["codebooks_sha256"] == hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()
    assert sum(r["evaluated"] for r in got.values()) < 6 * 4 * len(ids)


@pytest.mark.parametrize("cell", [1, 7, 64, 100000])
def test_cell_memo_equals_full_search_at_any_cell_and_memory(cell):
    rng = np.random.default_rng(cell)
    parts = np.concatenate([rng.integers(-200, 200, (500, 3)), rng.integers(-2, 2, (300, 3)) * 50])
    entries = np.concatenate([rng.integers(-200, 200, (9, 3)), np.full((3, 3), 50)])        # equal entries tie
    want = ((parts[:, None] - entries) ** 2).sum(axis=2)
    for memory in (1, 40, 100000):
        memo = vector_codes.CellMemo(entries, cell, memory)
        for _ in range(2):
            for at in range(0, len(parts), 100):
                best, distance, taken = memo.nearest(parts[at: at + 100])
                assert (best == want[at: at + 100].argmin(axis=1)).all() and (distance == want[at: at + 100].min(axis=1)).all()
                assert (taken >= 1).all()
        assert len(memo.keys) <= memory


def test_cell_memo_survives_equal_hashes(monkeypatch):
    monkeypatch.setattr(vector_codes.CellMemo, "_hash", lambda self, cells: np.full(len(cells), 9, np.uint64))
    rng = np.random.default_rng(0)
    parts, entries = rng.integers(-99, 99, (400, 2)), rng.integers(-99, 99, (8, 2))
    memo = vector_codes.CellMemo(entries, 5)
    for at in range(0, 400, 50):
        best, _, _ = memo.nearest(parts[at: at + 50])
        assert (best == ((parts[at: at + 50, None] - entries) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_codes_of_few_and_no_rows(spark):
    few = spark.createDataFrame(rows_of([[0.5] * 16, [0.25] * 16, [0.5] * 16], [4, None, 4]), VECTORS)
    got = vector_codes.compressed_with_errors(few).collect()
    assert sorted((r["vec_id"] or 0, r["code"], r["error"]) for r in got) == [(0, "02" * 8, 0), (4, "00" * 8, 0), (4, "00" * 8, 0)]
    none = few.where("vec_id > 99")
    assert vector_codes.compressed_with_errors(none).count() == 0 and centroids.clustered_with_inertia(none).count() == 0
    assert vector_codes.compressed_with_errors(spark.createDataFrame(rows_of(BAD[:3]), VECTORS)).count() == 0
    assert vector_codes.compressed_with_errors(few.drop("label")).count() == 3


def test_centroids_equal_brute_force_with_ties_copies_and_bad_rows(spark):
    rng = np.random.default_rng(8)
    vectors = np.concatenate([rng.normal(0, 0.4, (80, 16)), np.repeat(rng.normal(0, 1, (1, 16)), 50, axis=0), rng.normal(3, 0.1, (40, 16))])
    ids = rng.permutation(len(vectors)) * 3
    frame = spark.createDataFrame(rows_of([*vectors, *BAD], [*ids.tolist(), *range(900, 900 + len(BAD))]), VECTORS).repartition(6)
    got = {r["vec_id"]: r for r in centroids.clustered_with_inertia(frame, dims=16, centroids=7).collect()}
    assert set(got) == set(ids.tolist())
    whole = np.floor(64 * vectors).astype(int)
    order = sorted(range(len(ids)), key=lambda i: hashlib.sha256(f"1:{ids[i]}".encode()).hexdigest())
    found, centres = lloyd(whole, whole[order[:7]], 3)
    for i, vec in enumerate(ids.tolist()):
        r = got[vec]
        assert (r["cluster"], r["distance"]) == found[i]
        assert r["inertia"] == sum(d for _, d in found) and r["cluster_inertia"] == sum(d for c, d in found if c == found[i][0])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[found[i][0]])).encode()).hexdigest()


def test_pivot_bounds_lose_no_tie_and_save_distances():
    rng = np.random.default_rng(2)
    centres = np.concatenate([rng.integers(-5000, 5000, (12, 6)), np.zeros((2, 6), int)])     # two equal centroids
    vectors = np.concatenate([centres[rng.integers(0, 14, 600)] + rng.integers(-40, 40, (600, 6)), np.repeat(centres, 3, axis=0)])
    pivots = centres[:5]
    best, distance, taken = centroids.assign(vectors, centroids.distances(vectors, pivots), centres, centroids.distances(centres, pivots))
    want = ((vectors[:, None] - centres) ** 2).sum(axis=2)
    assert (best == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()
    assert taken.mean() < 3


def test_large_components_stay_exact():
    big = np.array([[2 ** 27 - 1, -(2 ** 27) + 1], [2 ** 27 - 2, -(2 ** 27) + 1]])
    best, distance, _ = centroids.assign(big, centroids.distances(big, big), big, centroids.distances(big, big))
    assert best.tolist() == [0, 1] and distance.tolist() == [0, 0]


def test_attach_small_and_salted_agree(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else i % 3) for i in range(200)], "id long, k int")
    table = rows.groupBy("k").agg(F.count("*").alias("n"))
    small = sorted(common.attach(rows, table, "k", "id").collect(), key=lambda r: r["id"])
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(common.attach(rows, table, "k", "id").collect(), key=lambda r: r["id"]) == small
    assert all(r["n"] == sum(s["k"] == r["k"] for s in small) for r in small)


# -- archives ---------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, archive string, path string, id string, digest string, problem string"
LONG, OTHER = "é<p>" * 300, "Z" * 1000
ODD_PAGES = [(1, "http://a/ü?x=%20%41 y\r\nEvil: 1", LONG), (2, None, LONG), (9, "", LONG), (9, "again", LONG), (None, "n", LONG), (4, "u", None), (5, "u", ""),
             (6, "u", "Z" * 999), (7, "u", "Z" * 999), (8, "u", OTHER), (10, "u", OTHER), (None, "z", "Q" * 3000), (None, "z", "Q" * 3000),
             (11, "u", "a\r\n\r\nWARC/1.1\r\n\x00" * 5), (12, "long", "x y z " * 600_000)]


def expected(page_id, html):
    raw = (html or "").encode()
    last = max((p for p, _, h in ODD_PAGES if h == html and p is not None), default=None)
    revisit = len(raw) >= 1000 and last is not None and page_id != last
    return len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last if revisit else None


def test_archives_round_trip_odd_pages(spark):
    pages = spark.createDataFrame([(*p, "a", "b", "c", "d", "e") for p in ODD_PAGES], PAGES).repartition(2)
    rows = warc.archive_round_trip(pages, payloads=True).collect()
    assert all(r["problem"] is None for r in rows)
    got = sorted((str(r["id"]), str(r["target_uri"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to_id"])) for r in rows)
    want = [(str(p), str(u), *expected(p, h)) for p, u, h in ODD_PAGES]
    assert got == sorted((*w[:5], str(w[5])) for w in want)
    for r in rows:
        assert r["payload"] is None if r["record_type"] == "revisit" else hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]
    assert warc.archive_round_trip(pages.where("page_id < 0")).count() == 0


def test_query_names_problems_and_salted_links_agree(spark, monkeypatch):
    pages = spark.createDataFrame([(*p, "a", "b", "c", "d", "e") for p in ODD_PAGES], PAGES)
    plain = sorted(map(str, warc.archive_round_trip(pages).select("id", "record_type", "refers_to_id").collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(str, warc.archive_round_trip(pages).select("id", "record_type", "refers_to_id").collect())) == plain
    monkeypatch.setattr(registry, "read_table", lambda *_: pages)
    broken = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda *a: broken(*a).withColumn("problem", F.lit("bad")))
    with pytest.raises(Exception, match="bad"):
        registry.op13_warc(spark, "").collect()


def sample_archive(n=40, dictionary=True):
    records = []
    for i in range(n):
        payload = (f"<html><body>page {i} " + "common text of every page " * (i + 1)).encode()
        records.append(warc.record_bytes(f"{warc.ID_PREFIX}{i}", f"http://h/{i}", payload, hashlib.sha1(payload).hexdigest(), None, "2020-01-01T00:00:00Z"))
    made = warc.train_dictionary(records) if dictionary else None
    packer = zstandard.ZstdCompressor(write_checksum=True, **({"dict_data": made} if made else {}))
    return records, warc.dictionary_frame(made), [packer.compress(r) for r in records], made


@pytest.mark.parametrize("dictionary", [True, False])
def test_frames_and_dictionary(dictionary):
    records, head, frames, made = sample_archive(dictionary=dictionary)
    assert (made is not None) == dictionary == bool(head)
    assert [r for _, r, _ in warc.read_frames(head + b"".join(frames))] == records
    gaps = warc.EMPTY_FRAME.encode().join(frames)                 # skippable frames between records are passed over
    assert [r for _, r, _ in warc.read_frames(head + gaps)] == records
    if made:                                                      # the dictionary may also be stored as it is
        raw = made.as_bytes()
        plain = warc.DICTIONARY_FRAME.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw
        assert [r for _, r, _ in warc.read_frames(plain + b"".join(frames))] == records
        assert all(p for _, _, p in warc.read_frames(b"".join(frames)))       # without it nothing decodes
    streamed = zstandard.ZstdCompressor().compressobj()                   # a frame without content size
    odd = streamed.compress(records[0]) + streamed.flush()
    assert [r for _, r, _ in warc.read_frames(odd + odd)] == [records[0]] * 2


def test_damaged_archives_are_reported():
    records, head, frames, _ = sample_archive()
    place = len(head) + len(frames[0])
    bad = bytearray(head + b"".join(frames))
    bad[place + len(frames[1]) - 1] ^= 255                        # checksum of the second frame
    found = list(warc.read_frames(bytes(bad)))
    assert len(found) == len(records) and [i for i, f in enumerate(found) if f[2]] == [1] and found[1][0] == place
    cut = list(warc.read_frames(head + frames[0] + frames[1][:-3]))
    assert cut[0][1] == records[0] and "cut off" in cut[1][2] and len(cut) == 2
    assert [p for _, _, p in warc.read_frames(head + frames[0] + b"junk")][1] == "no frame"
    assert "dictionary" in list(warc.read_frames(warc.DICTIONARY_FRAME.to_bytes(4, "little") + b"\x08\0\0\0" + b"\x28\xb5\x2f\xfdxxxx"))[0][2]


@pytest.mark.parametrize("old, new, problem", [
    (b"WARC/1.1", b"WARD/1.1", "version"), (b"WARC-Date: ", b"WARC-Dote: ", "missing header warc-date"), (b"WARC-Type: response\r\n", b"", "missing header warc-type"),
    (b"page 3 ", b"page 4 ", "block digest"), (b"page 3 ", b"page 33 ", "Content-Length"), (b"WARC-Date: ", b"nonsense\r\nWARC-Date: ", "no header line"),
    (b"\r\n\r\nHTTP", b"\r\nHTTP", "no header line|header|block"), (b"msgtype=response\r\nContent-Length: ", b"msgtype=response\r\nContent-Length: -", "no length"),
    (b"WARC-Block-Digest: sha1:", b"WARC-Block-Digest: sha1:!", "malformed"), (b"WARC-Block-Digest: sha1:", b"WARC-Block-Digest: md4:", "unknown digest")])
def test_invalid_records_are_refused(old, new, problem):
    record = sample_archive(8)[0][3]
    assert warc.parse_record(record)["payload"].startswith(b"<html><body>page 3 ") and old in record
    with pytest.raises(ValueError, match=problem):
        warc.parse_record(record.replace(old, new, 1))


def test_payload_length_and_digest_are_checked_without_block_digest():
    payload = b"p" * 50
    record = warc.record_bytes("urn:x", None, payload, hashlib.sha1(payload).hexdigest(), None, "d")
    head = record.index(b"WARC-Block-Digest")
    bare = record[:head] + record[record.index(b"Content-Type: application"):]
    assert warc.parse_record(bare)["payload"] == payload
    with pytest.raises(ValueError, match="payload digest"):
        warc.parse_record(bare.replace(b"pp", b"pq", 1))
    with pytest.raises(ValueError, match="payload of 50"):
        warc.parse_record(bare.replace(b"Content-Length: 50", b"Content-Length: 51", 1))
    folded = bare.replace(b"WARC-Date: d", b"WARC-Date: d\r\n  e", 1)
    assert warc.parse_record(folded)["date"] == "d e"
