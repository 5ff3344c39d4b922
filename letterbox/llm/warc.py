"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from letterbox.llm._common import cut, new_path, partitions, slices
from letterbox.llm._files import read_file, write_file

#: the skippable frame that holds a dictionary, and the magic of a Zstandard frame
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: equal payloads of fewer bytes are all stored in full
LEAST = 1000
#: a dictionary of this size is fitted on at most so many bytes of the payloads at hand
DICTIONARY, SAMPLE = 16 << 10, 2 << 20
#: payload bytes after which an archive file is closed
FILE_BYTES = 64 << 20


def dictionary(payloads: list[bytes]) -> bytes:
    """A trained dictionary, or where there is too little to train on, the sample's start as a raw one."""
    sample, size = [], 0
    for x in payloads:
        if x and size < SAMPLE:
            sample.append(x[: SAMPLE - size])
            size += len(sample[-1])
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(256, size // 10)), sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(sample)[:DICTIONARY]


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, name: str, least: int = LEAST) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, and so the length, but not the payload.

    The one response of a payload that is stored once is named after it, so that revisits can refer to it.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    sha1 = hashlib.sha1(payload).digest()
    stored = f"payload:{sha1.hex()}:{len(payload)}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_urn(stored if kind == 'response' and len(payload) >= least else name)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {_line(url) if url else 'urn:x-unknown'}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"WARC-X-Page-ID: {page_id}")
    if kind == "revisit":
        head.append(f"WARC-Refers-To: {_urn(stored)}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"WARC-X-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes], words: bytes) -> bytes:
    """Skippable frame with the dictionary, then a frame for each record."""
    known = zstandard.ZstdCompressionDict(words) if words else None
    write = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True, write_content_size=True).compress
    return b"".join([struct.pack("<II", SKIPPABLE, len(words)), words, *map(write, records)])


def unpack(data: bytes) -> Iterator[bytes]:
    """The records of an archive; the dictionary may itself be a Zstandard frame."""
    at, known = 0, None
    if len(data) >= 8:
        magic, size = struct.unpack_from("<II", data)
        if magic == SKIPPABLE:
            words, at = data[8 : 8 + size], 8 + size
            if len(words) < size:
                raise ValueError("the dictionary frame is cut short")
            if words[:4] == struct.pack("<I", FRAME):
                words = zstandard.ZstdDecompressor().decompress(words)
            known = zstandard.ZstdCompressionDict(words) if words else None
    engine = zstandard.ZstdDecompressor(dict_data=known)
    view = memoryview(data)
    while at < len(data):
        one = engine.decompressobj()
        parts, here = [], at
        while not one.eof:
            if here >= len(data):
                raise ValueError("the last frame is cut short")
            step = view[here : here + (1 << 16)]
            parts.append(one.decompress(step))
            here += len(step)
        at = here - len(one.unused_data)
        if out := b"".join(parts):
            yield out


def parse(raw: bytes) -> dict:
    """Headers and payload of a record; raises ValueError where lengths, digest or form do not hold."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"bad header line {line!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not hold")
    http, mark, payload = rest[:-4].partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    if not mark or not http.startswith(b"HTTP/") or size is None:
        raise ValueError("no HTTP header block")
    sha1 = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
    if fields["warc-type"] == "revisit":
        if payload:
            raise ValueError("a revisit with a payload")
    elif len(payload) != int(size[1]) or hashlib.sha1(payload).digest() != sha1:
        raise ValueError("the payload's length or digest does not hold")
    return {"fields": fields, "payload": payload, "payload_bytes": int(size[1]), "payload_digest": sha1.hex()}


def deduplicate(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html (null: empty), record_type, refers_to.

    Of equal payloads of at least ``least`` bytes the largest page_id is the response (null below all; of
    repeated rows, one). Payloads are equal when SHA-256 and length agree. Other columns are not read.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"))
    rows = rows.withColumns({"_key": F.unhex(F.sha2("html", 256)), "_size": F.octet_length("html")})
    found = rows.select("page_id", "_key", "_size").filter(F.col("_size") >= least).groupBy("_key", F.col("page_id").alias("_page")).agg(F.count("*").alias("_n"))
    best = found.groupBy("_key").agg(F.max(F.struct(F.col("_page").isNotNull(), "_page", "_n")).alias("best"), F.sum("_n").alias("_all"))
    best = cut(best.filter("_all > 1").select("_key", F.col("best._page").alias("_keep"), F.col("best._n").alias("_ties")), "payloads")
    out = rows.join(best.withColumn("_copy", F.lit(True)), "_key", "left")
    first = F.col("page_id").eqNullSafe(F.col("_keep"))
    if not best.filter("_ties > 1").isEmpty():
        first = first & (F.row_number().over(Window.partitionBy("_key", "page_id").orderBy("url")) == 1)
    again = F.coalesce(F.col("_copy"), F.lit(False)) & ~first
    return out.select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_keep")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Write what ``deduplicate`` gives; returns the table of files (path, n), itself in the shared folder."""
    spark = records.sparkSession
    folder = folder or new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            words = dictionary([x[2] for x in held])
            data = pack([record(*x, f"{part}/{number}/{k}/{x[0]}") for k, x in enumerate(held)], words)
            path = write_file(folder, f"{part:06d}-{number:06d}.warc.zst", data)
            return pa.RecordBatch.from_pydict({"path": [path], "n": pa.array([len(held)], pa.int64())})

        for batch in slices(batches):
            for page, url, html, kind, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((page, url, html.encode(), kind, refers))
                size += len(held[-1][2])
                if size >= FILE_BYTES:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    return cut(records.mapInArrow(run, "path string, n long"), "archives")


def read_archives(files: DataFrame) -> DataFrame:
    """Every record of the archives in column path: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload, error.

    A record that does not hold, or the rest of an archive that cannot be decoded, is a row of record_type
    ``damaged`` with an error and nothing else; other records of the archive are read on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("error", pa.string())]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], [k for k, _ in kinds])

        def damaged(error: Exception) -> tuple:
            return (None, None, None, "damaged", None, None, None, str(error))

        def row(raw: bytes) -> tuple:
            try:
                x = parse(raw)
                f = x["fields"]
                page, refers = (int(f[k]) if k in f else None for k in ("warc-x-page-id", "warc-x-refers-to-page-id"))
            except (ValueError, KeyError) as error:
                return damaged(error)
            return (page, x["payload_bytes"], x["payload_digest"], f["warc-type"], refers, f.get("warc-target-uri"), x["payload"], None)

        def rows_of(path: str) -> Iterator[tuple]:
            try:
                for raw in unpack(read_file(path)):
                    yield row(raw)
            except (ValueError, zstandard.ZstdError) as error:
                yield damaged(error)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for one in rows_of(path):
                    rows.append(one)
                    size += len(one[6] or b"")
                    if len(rows) >= 1000 or size >= 1 << 24:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    paths = files.select("path").repartition(partitions(files.sparkSession))
    return paths.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, error string")
