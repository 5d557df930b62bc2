"""Operator 13: WARC archives compressed by zstd, one frame a record, with a dictionary up front.

Writing.  Every task trains a dictionary on its first records (at most ``SAMPLE_ROWS`` records
and ``SAMPLE_BYTES`` bytes; too few to train on: no dictionary) and packs its records into archives
of about ``ARCHIVE_BYTES``.  An archive starts with the dictionary in a skippable frame; each record
is a frame of its own, with checksum and size.  Archives are written by Spark's text sink, one to a
file, so that any store Spark reaches will do and lost tasks are repeated safely; the sink's line
end is an empty skippable frame.  Of records with equal payloads of ``LEAST`` bytes or more, the
one with the largest id carries the payload, the others are revisit records that refer to it.

Reading.  The dictionary is loaded from the leading skippable frame (itself compressed or not); the
archive is walked frame by frame and each frame decoded to exactly one record.  Checked are the
version line, the mandatory headers, the header syntax, Content-Length against the block, the end of
the record, the block digest, and for HTTP blocks the length and digest of the payload.  A record
that fails has the reason in ``problem``; a damaged frame whose end cannot be found ends its archive
with one such row.

Defined results: null payloads are empty; null urls have no WARC-Target-URI and read back as
null; control characters and ``%`` in urls are percent-encoded in the header and decoded on reading.
Rows with a null id are written without an id and read back with a null one; they carry the
payload only if no equal row has an id, and all of them then do, as do all rows that share the
largest id.  Repeated rows are separate records.  A record longer than an archive has one of its own;
no payload is cut.  An empty table gives an empty result.  Only id, url and payload are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import attach, stash
from kestrel.session import scratch_path

LEAST = 1000
ARCHIVE_BYTES = 8 << 20
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 2 << 20, 32 << 10

# Fixed values of the file formats.
VERSION = b"WARC/1.1"
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE_FRAMES = range(0x184D2A50, 0x184D2A60)
ZSTD_FRAME = 0xFD2FB528
EMPTY_FRAME = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-record-id", "content-length", "warc-date", "warc-type")

ID_PREFIX = "urn:kestrel:record:"
RECORD = ("archive string, frame long, record_id string, record_type string, target_uri string, date string, payload_digest string, "
          "payload_bytes long, refers_to string, payload binary, problem string")


# -- records ----------------------------------------------------------------------------------

def _in_header(value: str) -> str:
    return re.sub(r"[%\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _from_header(value: str) -> str:
    return re.sub(r"%(25|[01][0-9A-F]|20|7F)", lambda m: chr(int(m[1], 16)), value)


def _base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def record_bytes(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record; with ``refers_to`` a revisit record, which holds the HTTP header but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + _in_header(uri))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: " + REVISIT_PROFILE]
    lines += ["WARC-Payload-Digest: " + _base32(digest), "WARC-Block-Digest: " + _base32(hashlib.sha1(block).hexdigest()),
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"\r\n".join([VERSION, "\r\n".join(lines).encode(), b"", block, b"", b""])


def _headers(raw: bytes) -> dict[str, str]:
    """Header lines by lower-case name; a line that starts with white space continues the last."""
    found: dict[str, str] = {}
    name = None
    for line in raw.decode("utf-8").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.lower()
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9a-z-]+", name):
            raise ValueError(f"no header line: {line[:80]!r}")
        if name in found and name in MANDATORY:
            raise ValueError(f"repeated header {name}")
        found[name] = value.strip(" \t")
    return found


def _length(value: str) -> int:
    if not re.fullmatch(r"[0-9]+", value):
        raise ValueError(f"no length: {value[:40]!r}")
    return int(value)


def _hex_of(digest: str) -> str:
    kind, _, value = digest.partition(":")
    if kind != "sha1":
        raise ValueError(f"unknown digest {kind[:20]!r}")
    try:
        return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()
    except ValueError:
        raise ValueError("malformed digest") from None


def parse_record(raw: bytes) -> dict:
    """Fields of one WARC record; raises ValueError where header, length or digest do not hold."""
    version, _, rest = raw.partition(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", version):
        raise ValueError("no WARC version line")
    head, gap, body = rest.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("header without end")
    fields = _headers(head)
    if missing := [name for name in MANDATORY if not fields.get(name)]:
        raise ValueError(f"missing header {missing[0]}")
    size = _length(fields["content-length"])
    if len(body) != size + 4 or body[size:] != b"\r\n\r\n":
        raise ValueError(f"block of {max(len(body) - 4, 0)} bytes, Content-Length {size}")
    block = body[:size]
    if "warc-block-digest" in fields and hashlib.sha1(block).hexdigest() != _hex_of(fields["warc-block-digest"]):
        raise ValueError("block digest differs")
    kind = fields["warc-type"]
    uri = fields.get("warc-target-uri")
    out = {"record_id": fields["warc-record-id"].strip("<>"), "record_type": kind, "target_uri": None if uri is None else _from_header(uri),
           "date": fields["warc-date"], "payload_digest": _hex_of(fields["warc-payload-digest"]) if "warc-payload-digest" in fields else None,
           "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None, "payload": block, "payload_bytes": size}
    if kind == "revisit" and out["refers_to"] is None and "warc-refers-to-target-uri" not in fields:
        raise ValueError("revisit refers to nothing")
    if fields.get("content-type", "").startswith("application/http"):
        first, gap, payload = block.partition(b"\r\n\r\n")
        status, _, lines = first.partition(b"\r\n")
        if not gap or not status.startswith(b"HTTP/"):
            raise ValueError("no HTTP header")
        http = _headers(lines) if lines else {}
        out["payload_bytes"] = _length(http["content-length"]) if "content-length" in http else len(payload)
        out["payload"] = payload if kind == "response" else None
        if kind == "response" and out["payload_bytes"] != len(payload):
            raise ValueError(f"payload of {len(payload)} bytes, Content-Length {out['payload_bytes']}")
    elif kind == "revisit":
        out["payload"] = None
    if kind == "response" and out["payload_digest"] and hashlib.sha1(out["payload"]).hexdigest() != out["payload_digest"]:
        raise ValueError("payload digest differs")
    return out


# -- archives ---------------------------------------------------------------------------------

def train_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary for records like the samples; None if they are too few or too small for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples) if len(samples) > 7 else None
    except zstandard.ZstdError:
        return None


def dictionary_frame(dictionary: zstandard.ZstdCompressionDict | None) -> bytes:
    """The skippable frame that leads an archive; empty without a dictionary."""
    if dictionary is None:
        return b""
    content = zstandard.ZstdCompressor(level=9).compress(dictionary.as_bytes())
    return DICTIONARY_FRAME.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


def frame_end(data: memoryview, at: int) -> int:
    """End of the zstd or skippable frame at ``at``; raises ValueError if there is none."""
    magic = int.from_bytes(data[at: at + 4], "little")
    if magic in SKIPPABLE_FRAMES and at + 8 <= len(data):
        end = at + 8 + int.from_bytes(data[at + 4: at + 8], "little")
    elif magic == ZSTD_FRAME:
        try:
            end = at + zstandard.frame_header_size(data[at: at + 18])
            checked = zstandard.get_frame_parameters(data[at: at + 18]).has_checksum
        except zstandard.ZstdError as e:
            raise ValueError(f"damaged frame header: {e}") from None
        last = 0
        while not last:
            if end + 3 > len(data):
                raise ValueError("frame is cut off")
            block = int.from_bytes(data[end: end + 3], "little")
            last, kind, size = block & 1, block >> 1 & 3, block >> 3
            if kind == 3:
                raise ValueError("damaged block header")
            end += 3 + (1 if kind == 1 else size)
        end += 4 * checked
    else:
        raise ValueError("no frame")
    if end > len(data):
        raise ValueError("frame is cut off")
    return end


def read_frames(content: bytes) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(place, record, problem) of each record frame; a problem has no record."""
    data, at, decoder = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        try:
            end = frame_end(data, at)
        except ValueError as e:
            yield at, None, str(e)
            return
        magic = int.from_bytes(data[at: at + 4], "little")
        if magic == DICTIONARY_FRAME and at == 0:
            held = bytes(data[8:end])
            try:
                if held[:4] == ZSTD_FRAME.to_bytes(4, "little"):
                    held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            except zstandard.ZstdError as e:
                yield at, None, f"damaged dictionary: {e}"
                return
        elif magic == ZSTD_FRAME:
            try:
                yield at, decoder.decompressobj().decompress(data[at:end]), None
            except zstandard.ZstdError as e:
                yield at, None, f"damaged frame: {e}"
        at = end


def _archives(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    """Batches of (id, uri, payload, digest, refers_to) as archives, one to a row."""
    def records() -> Iterator[bytes]:
        for batch in batches:
            columns = [batch.column(c) for c in ("id", "uri", "payload", "digest", "refers_to")]
            for i in range(batch.num_rows):
                key, uri, payload, digest, refers = (c[i].as_py() for c in columns)
                yield record_bytes(_record_id(key, uri, digest), uri, payload, digest, refers and ID_PREFIX + refers, date)

    def row(parts: list[bytes]) -> pa.RecordBatch:
        return pa.record_batch({"archive": pa.array([b"".join(parts)], pa.binary())})

    source, sample, size = records(), [], 0
    for record in source:
        sample.append(record)
        size += len(record)
        if len(sample) >= SAMPLE_ROWS or size >= SAMPLE_BYTES:
            break
    dictionary = train_dictionary([s[: zstandard.BLOCKSIZE_MAX] for s in sample])
    how = {} if dictionary is None else {"dict_data": dictionary}
    packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, **how)
    head = dictionary_frame(dictionary)
    parts, size = [head], len(head)
    for records_ in (sample, source):
        for record in records_:
            parts.append(packer.compress(record))
            size += len(parts[-1])
            if size >= ARCHIVE_BYTES:
                yield row(parts)
                parts, size = [head], len(head)
    if len(parts) > 1:
        yield row(parts)


def _record_id(key: str | None, uri: str | None, digest: str) -> str:
    """The id of a row, or for rows without one a digest of what they hold."""
    if key is not None:
        return ID_PREFIX + key
    return "urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_URL, f"{uri} {digest}"))


def write_archives(pages: DataFrame, path: str, id_column: str, uri_column: str, payload_column: str,
                   least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for every row to archives in the folder ``path``.

    Payloads are not shuffled unless the table of repeated payloads is too large to be broadcast.
    """
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(uri_column).cast("string").alias("uri"),
                        F.coalesce(F.col(payload_column).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    repeated = (rows.where(F.octet_length("payload") >= least).groupBy("digest")
                .agg(F.max("id").alias("carrier"), F.count("*").alias("n")).where("n > 1 AND carrier IS NOT NULL").select("digest", "carrier"))
    linked = attach(rows, stash(repeated, "warc-repeated"), "digest", "id").withColumn(
        "refers_to", F.when(F.col("carrier").isNotNull() & ~F.col("id").eqNullSafe(F.col("carrier")) & (F.octet_length("payload") >= least),
                            F.col("carrier").cast("string")))
    linked = linked.select(F.col("id").cast("string").alias("id"), "uri", "payload", "digest", "refers_to")
    archives = linked.mapInArrow(lambda batches: _archives(batches, date), "archive binary")
    archives.select(F.col("archive").cast("string")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row a record of the archives under ``path`` (columns: ``RECORD``); ``payloads`` False leaves them null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, content = batch.column("path")[i].as_py(), batch.column("content")[i].as_py()
                rows, size = [], 0
                for place, raw, problem in read_frames(content):
                    fields = {}
                    if raw is not None:
                        try:
                            fields = parse_record(raw)
                        except ValueError as e:
                            problem = str(e)
                    if not payloads:
                        fields["payload"] = None
                    rows.append({"archive": name, "frame": place, "problem": problem} | fields)
                    size += len(fields.get("payload") or b"") + 500
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([pa.field(name, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[kind])
                        for name, kind in (column.split() for column in RECORD.split(", "))])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, RECORD)


def id_in(column: str) -> Column:
    """The row id in a record id or reference; null if it holds none."""
    return F.when(F.col(column).startswith(ID_PREFIX), F.substr(column, F.lit(len(ID_PREFIX) + 1)).cast("long"))


def archive_round_trip(pages: DataFrame, id_column: str = "page_id", uri_column: str = "url", payload_column: str = "html",
                       payloads: bool = False) -> DataFrame:
    """All rows written to archives in the scratch folder and read back: ``RECORD`` with the ids as longs."""
    spark = pages.sparkSession
    path = f"{scratch_path(spark, 'llm')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, id_column, uri_column, payload_column)
    return read_archives(spark, path, payloads).withColumns({"id": id_in("record_id"), "refers_to_id": id_in("refers_to")})
