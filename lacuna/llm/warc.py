"""WARC archives in Zstandard, written and read back.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a dictionary; then every record is one frame
compressed with it, so records can be read one by one. The dictionary is trained on the first records of its archive
(`TRAINED_BYTES` at most). The reader loads the dictionary, decodes frame after frame, and checks the
version line, the header lines, Content-Length, the record's end, and block and payload digests.

Archives are rows (archive, data): Spark's own writers put them into the shared folder of whatever kind, and
`write_files` writes them out as .warc.zst files where the folder is one that Python can open.

Of rows with equal payloads of at least `least` bytes, that with the largest page_id is the response and the others
revisit it. Cases: null html is an empty payload; repeated rows with the largest page_id are all responses; a missing
page_id is smaller than all others; a missing url is an empty one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import cut

DICTIONARY_MAGIC = 0x184D2A5D
ARCHIVES = "archive string, data binary"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORDS_FULL = RECORDS + ", url string, payload binary"
#: Bytes of records in an archive, about, and of those that its dictionary is trained on.
ARCHIVE_BYTES = 8 << 20
TRAINED_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10
#: Bytes of an archive that the reader feeds to a frame at a time.
FED_BYTES = 8 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    block = _HTTP if revisit else _HTTP + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + (url or "").encode("unicode_escape").decode(),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {_digest(payload)}",
        f"WARC-Block-Digest: {_digest(block)}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_archive(records: list[bytes]) -> bytes:
    samples, held = [], 0
    for r in records:
        if held >= TRAINED_BYTES:
            break
        samples.append(r)
        held += len(r)
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:  # too few or too equal samples
        trained = b""
    dictionary = trained or b"".join(samples)[:DICTIONARY_BYTES]
    compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)), dictionary, *map(compressor.compress, records)])


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one per frame."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise ValueError("the dictionary frame is cut off")
    dictionary = data[8 : 8 + size]
    if dictionary[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        one, parts = decompressor.decompressobj(), []
        while not one.eof and at < len(data):  # in slices: what a frame leaves over is copied
            piece = view[at : at + FED_BYTES]
            parts.append(one.decompress(piece))
            at += len(piece)
        if not one.eof:
            raise ValueError("the last frame is cut off")
        at -= len(one.unused_data)
        yield b"".join(parts)


def decode_record(record: bytes) -> dict:
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    named = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line!r}")
        named[name.strip().lower()] = value.strip()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in named:
            raise ValueError(f"no {need}")
    n = int(named["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not fit the record")
    block = rest[:n]
    if _digest(block) != named.get("warc-block-digest", _digest(block)):
        raise ValueError("the block's digest does not fit")
    kind = named["warc-type"]
    payload = block.partition(b"\r\n\r\n")[2]
    if kind == "response" and (_digest(payload) != named["warc-payload-digest"] or len(payload) != int(named["x-payload-length"])):
        raise ValueError("the payload does not fit its digest or length")
    number = lambda x: int(x) if x else None
    return {
        "page_id": number(named["x-page-id"]),
        "payload_bytes": int(named["x-payload-length"]),
        "payload_digest": base64.b32decode(named["warc-payload-digest"].removeprefix("sha1:")).hex(),
        "record_type": kind,
        "refers_to": number(named.get("x-refers-to-page-id")) if kind == "revisit" else None,
        "url": named["warc-target-uri"].encode().decode("unicode_escape"),
        "payload": payload if kind == "response" else None,
    }


def mark_revisits(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, response): response is the page_id to revisit, null for responses."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    again = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "last")
    again, _ = cut(again, "warc-copies")
    joined = rows.join(again, "digest", "left")
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("response"))


def build_archives(marked: DataFrame) -> DataFrame:
    """Rows (archive, data): each task's records in archives of about ARCHIVE_BYTES."""

    def run(batches):
        held, size, n = [], 0, 0
        part = TaskContext.get().partitionId()

        def flush():
            nonlocal held, size, n
            out = pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{n:06d}.warc.zst"]), pa.array([build_archive(held)], pa.binary())], names=["archive", "data"])
            held, size, n = [], 0, n + 1
            return out

        for b in batches:
            for page, url, payload, response in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                held.append(encode_record(page, url, payload.as_py(), response, response is not None))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return marked.mapInArrow(run, ARCHIVES)


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of every archive; a bad archive or record fails the read."""
    schema = RECORDS_FULL if with_payload else RECORDS
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        for b in batches:
            for data in b.column(0):
                rows = []
                for record in frames(data.as_py()):
                    rows.append(decode_record(record))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], t) for x, t in zip(names, types)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], t) for x, t in zip(names, types)], names=names)

    return archives.select("data").mapInArrow(run, schema)


def write_files(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as a file of a folder that all executors can open; a retried task replaces its files. Returns (archive, bytes)."""

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            names, sizes = b.column(0).to_pylist(), []
            for name, data in zip(names, b.column(1)):
                raw = data.as_py()
                with open(at := f"{folder}/.{name}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(raw)
                os.replace(at, f"{folder}/{name}")
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], names=["archive", "bytes"])

    return archives.mapInArrow(run, "archive string, bytes long")


def round_trip(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", with_payload: bool = False) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads these back."""
    stored, _ = cut(build_archives(mark_revisits(pages, least, id_col, url_col, html_col)), "warc")
    return read_archives(stored, with_payload)
