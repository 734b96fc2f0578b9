"""WARC archives with one Zstandard frame per record and a shared dictionary.

An archive begins with a skippable frame that holds the dictionary (itself
compressed). Every record is a frame of its own. Spark's text writer writes
the frames, so files appear only when their task has committed; its line end
is an empty skippable frame, which readers pass over.

Nulls and empty payloads are records of 0 bytes. Of rows with the same payload
the one with the least page id is the response and the others revisit it; rows
that repeat this id are all responses. Rows without an id revisit one that has
one. Other columns are not read.
"""

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import work_dir
from .common import arrow_map, stored

#: Magic numbers of skippable frames (little-endian) and of the frame that holds a dictionary.
SKIPPABLE, DICTIONARY = range(0x184D2A50, 0x184D2A60), 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
#: An empty skippable frame, the writer's line end.
LINE_END = struct.pack("<II", 0x184D2A50, 0)
VERSION = b"WARC/1.1"
MUST_HAVE = ("warc-type", "warc-record-id", "warc-date", "content-length")


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def train_dictionary(samples: list[bytes], size=1 << 16) -> bytes:
    """A dictionary from sample records; empty where there is too little to learn from."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor().compress(dictionary)
    return struct.pack("<II", DICTIONARY, len(packed)) + packed


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record: HTTP headers, and for a response the payload too."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        VERSION, b"WARC-Type: " + (b"revisit" if revisit else b"response"), f"WARC-Record-ID: <urn:page:{page_id}>".encode(),
        f"WARC-Date: {date}".encode(), b"WARC-Target-URI: " + " ".join((url or "").split()).encode(),
        f"WARC-Payload-Digest: sha1:{digest}".encode(), f"WARC-Block-Digest: sha1:{digest32(hashlib.sha1(block).digest())}".encode(),
        b"Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>".encode()]
    lines.append(f"Content-Length: {len(block)}".encode())
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


class BadRecord(ValueError):
    """A record or archive that breaks the format."""


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, frame) of an archive's frames, skippable ones included; a frame's end follows from its blocks' headers."""
    at = 0
    while at < len(data):
        if len(data) < at + 8:
            raise BadRecord("truncated frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            end = at + 8 + size
        elif magic == ZSTD_MAGIC:
            end = at + zstandard.frame_header_size(data[at:at + 18])
            last = False
            while not last:
                if len(data) < end + 3:
                    raise BadRecord("truncated block")
                head = int.from_bytes(data[end:end + 3], "little")
                last, kind = head & 1, head >> 1 & 3
                end += 3 + (1 if kind == 1 else head >> 3)
            end += 4 * (data[at + 4] >> 2 & 1)  # checksum
        else:
            raise BadRecord("no frame")
        if end > len(data):
            raise BadRecord("truncated frame")
        yield at, data[at:end]
        at = end


def read_dictionary(frame: bytes) -> bytes:
    body = frame[8:]
    if body[:4] == struct.pack("<I", ZSTD_MAGIC):
        body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 27)
    return body


def headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name.strip() != name:
            raise BadRecord("malformed header")
        out[name.decode().lower()] = value.strip().decode()
    return out


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record, with version, headers, lengths and digests checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise BadRecord("no WARC version")
    found = headers(lines[1:])
    if missing := [h for h in MUST_HAVE if h not in found]:
        raise BadRecord(f"missing {missing[0]}")
    if not found["content-length"].isdigit() or len(rest) != int(found["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadRecord("wrong length")
    block = rest[:-4]
    if "warc-block-digest" in found and found["warc-block-digest"] != f"sha1:{digest32(hashlib.sha1(block).digest())}":
        raise BadRecord("wrong block digest")
    return found, block


def payload_of(found: dict[str, str], block: bytes) -> tuple[int, bytes]:
    """(payload's full length, payload) of a record; a revisit holds none."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    http = headers(head.split(b"\r\n")[1:])
    if not gap or not http.get("content-length", "").isdigit():
        raise BadRecord("malformed HTTP headers")
    size = int(http["content-length"])
    if found["warc-type"] == "response":
        if len(payload) != size:
            raise BadRecord("wrong payload length")
        if found.get("warc-payload-digest") != f"sha1:{digest32(hashlib.sha1(payload).digest())}":
            raise BadRecord("wrong payload digest")
    return size, payload


def read_archive(data: bytes) -> Iterator[tuple[int, dict[str, str] | None, bytes, str | None]]:
    """(offset, headers, block, fault) per record frame; a faulty record does not stop the ones after it."""
    unpack = zstandard.ZstdDecompressor()
    try:
        for offset, frame in frames(data):
            magic = struct.unpack_from("<I", frame)[0]
            if magic in SKIPPABLE:
                if magic == DICTIONARY and offset == 0:
                    dictionary = read_dictionary(frame)
                    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else unpack
                continue
            try:
                found, block = parse(unpack.decompress(frame, allow_extra_data=False))
                yield offset, found, block, None
            except (BadRecord, zstandard.ZstdError, UnicodeDecodeError) as fault:
                yield offset, None, b"", str(fault)
    except BadRecord as fault:
        yield len(data), None, b"", str(fault)


def _written(batches: Iterator[pa.RecordBatch], dictionary: bytes, date: str, level: int) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=level, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    lead = [dictionary_frame(dictionary)]
    for batch in batches:
        rows = zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True)
        out, size = lead, 0
        for row in rows:
            page_id, url, payload, sha1, refers_to = (v.as_py() for v in row)
            out.append(pack.compress(record(page_id, url, payload, digest32(bytes.fromhex(sha1)), refers_to, date)))
            size += len(out[-1])
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
        lead = []


def write_archives(pages: DataFrame, path: str, id_col="page_id", url_col="url", payload_col="html", least=0,
                   date="2024-01-01T00:00:00Z", samples=256, sample_bytes=1 << 14, level=3) -> None:
    """Write a record per row, one archive per partition of Spark's.

    Payloads of fewer than `least` bytes are never revisits. The dictionary
    is learned from the first `sample_bytes` of at most `samples` payloads,
    those with the least digests.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    slim = stored(rows.select("page_id", "digest", F.octet_length("payload").cast("long").alias("size")), "digests")
    same = slim.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    again = slim.join(same.select("digest", "first_id"), "digest").filter("size >= %d AND first_id IS NOT NULL AND NOT (page_id <=> first_id)" % least)
    again = again.select("page_id", "digest", F.col("first_id").alias("refers_to")).distinct()
    picked = rows.select("digest", F.substring("payload", 1, sample_bytes).alias("payload")).orderBy("digest").limit(samples)
    dictionary = train_dictionary([bytes(r.payload) for r in picked.toLocalIterator() if r.payload])
    key = [F.col("a.page_id").eqNullSafe(F.col("b.page_id")), F.col("a.digest") == F.col("b.digest")]
    full = rows.alias("a").join(again.alias("b"), key, "left").select("a.page_id", "a.url", "a.payload", "a.digest", "b.refers_to")
    written = arrow_map(full, lambda it: _written(it, dictionary, date, level), "frame binary")
    written.select(F.col("frame").cast("string")).write.option("lineSep", LINE_END.decode("ascii")).text(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["archive", "offset", "record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload", "fault"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            path, rows, size = path.as_py(), [], 0
            for offset, found, block, fault in read_archive(content.as_py()):
                row = (path, offset, None, None, None, None, None, None, None, fault)
                if not fault:
                    try:
                        length, payload = payload_of(found, block)
                        row = (path, offset, found["warc-record-id"], found["warc-type"], found.get("warc-target-uri"),
                               found.get("warc-payload-digest", "").removeprefix("sha1:"), length, found.get("warc-refers-to"),
                               payload if found["warc-type"] == "response" else None, None)
                    except (BadRecord, UnicodeDecodeError) as broken:
                        row = (*row[:-1], str(broken))
                rows.append(row)
                size += len(block)
                if size > 1 << 23:
                    yield flush(rows)
                    rows, size = [], 0
            if rows:
                yield flush(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives: archive, offset, record_id, record_type, target_uri, payload_digest,
    payload_bytes, refers_to, payload (null for revisits), fault (why a record was refused, else null)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return arrow_map(files, _read, "archive string, offset long, record_id string, record_type string, target_uri string, "
                     "payload_digest string, payload_bytes long, refers_to string, payload binary, fault string")


def page_number(uri):
    """The integer id in a record id of this module."""
    return F.expr(f"try_cast(regexp_extract({uri}, '^<urn:page:(-?[0-9]+)>$', 1) AS bigint)")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Records read back from archives that were written from `pages`."""
    path = work_dir(pages.sparkSession, "archives")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)
