"""WARC archives: writing them as one gzip stream, giving each record its own member, reading by offset.

A crawler's archive compressed as a whole can only be read from its start. ``normalise`` inflates such a
stream once, record by record, writes every record as a gzip member of its own and puts the offsets into a
sidecar file, by which ``read_records`` seeks.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm import storage
from tieout.llm.common import scratch_folder, slices, whole_text, write_scratch

#: Equal payloads below this many bytes are stored again.
LEAST_REVISIT = 1000
#: An archive is closed when its records hold this many bytes.
ARCHIVE_BYTES = 16 << 20
_READ = 1 << 20
_ID = "urn:x-page:"

NAMES = "archive string, records long"
INDEXED = "archive string, index string, records long"
RECORD = ("archive string, offset long, length long, page_id long, url string, record_type string, refers_to long, "
          "payload_bytes long, payload_digest string, payload binary")


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Columns ``page_id, url, html, digest, refers_to``: of equal payloads the largest ``page_id`` is kept.

    ``refers_to`` is null for pages stored in full. Null html is empty. Rows repeated with the kept id are
    all stored in full; pages without an id refer to one that has an id, or are stored in full.
    """
    rows = pages.select("page_id", "url", whole_text("html").alias("html")).withColumn(
        "digest", F.when(F.octet_length("html") >= least, F.sha1(F.encode("html", "UTF-8"))))
    kept = rows.where("digest is not null").groupBy("digest").agg(
        F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(kept, "digest", "left").select(
        "page_id", "url", "html",
        F.when(F.col("page_id").eqNullSafe(F.col("kept")), None).otherwise(F.col("kept")).alias("refers_to"))


def _record(page_id, url, html, refers_to) -> bytes:
    payload = html.encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = "" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{_ID}{name}>", "WARC-Date: 1970-01-01T00:00:00Z",
            "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        clean = re.sub(r"[\x00-\x20\x7F%]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {clean}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages as archives that are one gzip stream each; gives their names and record counts.

    An empty table gives no archive. Columns other than ``page_id, url, html`` do not count.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = squeeze = None
        records = size = 0
        for batch in slices(batches):
            for row in batch.to_pylist():
                if out is None:
                    name = storage.new_name(folder, ".warc.gz")
                    out, squeeze, records, size = storage.create(name), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                record = _record(row["page_id"], row["url"], row["html"], row["refers_to"])
                out.write(squeeze.compress(record))
                records, size = records + 1, size + len(record)
                if size >= archive_bytes:
                    out.write(squeeze.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pylist([{"archive": name, "records": records}])
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            yield pa.RecordBatch.from_pylist([{"archive": name, "records": records}])

    return write_scratch(with_revisits(pages).mapInArrow(write, NAMES), "warc-archives")


def inflate(source) -> Iterator[bytes]:
    """The bytes of a gzip file, piece by piece; members one after another are read through."""
    inflater, begun = zlib.decompressobj(31), False
    while data := source.read(_READ):
        while data:
            begun = True
            yield inflater.decompress(data)
            data = inflater.unused_data
            if inflater.eof:
                inflater, begun = zlib.decompressobj(31), False
    if begun:
        raise ValueError("the gzip stream ends too early")


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole WARC records of a stream, each with the two line ends that close it."""
    held = bytearray()
    pieces = iter(pieces)

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while held or more():
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if not held:
            return
        length = re.search(rb"(?im)^Content-Length:\s*(\d+)", held[: max(end, 0)])
        if end < 0 or length is None or not held.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        size = end + 4 + int(length[1]) + 4
        while len(held) < size and more():
            pass
        if len(held) < size:
            raise ValueError("the last WARC record is cut off")
        yield bytes(held[:size])
        del held[:size]


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives so that every record is a gzip member, with offsets in a file beside each.

    Takes any table with a column ``archive`` of names, holds one record in memory at a time and gives
    ``archive, index, records``. A damaged archive raises.
    """
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for old in batch.column("archive").to_pylist():
                name = storage.new_name(folder, ".warc.gz")
                index, at, records = f"{name}.index", 0, 0
                with storage.open_random(old) as source, storage.create(name) as out, storage.create(index) as side:
                    for record in split_records(inflate(source)):
                        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = squeeze.compress(record) + squeeze.flush()
                        out.write(member)
                        side.write(json.dumps({"offset": at, "length": len(member)}).encode() + b"\n")
                        at, records = at + len(member), records + 1
                yield pa.RecordBatch.from_pylist([{"archive": name, "index": index, "records": records}])

    dealt = storage.one_task_per_file(archives.select("archive"))
    return write_scratch(dealt.mapInArrow(rewrite, INDEXED), "warc-members")


def _header(head: bytes, name: str) -> str | None:
    found = re.search(rf"(?im)^{name}:[ \t]*(.*?)\r?$".encode(), head)
    return found[1].decode() if found else None


def _page(text: str | None) -> int | None:
    number = (text or "").removeprefix(f"<{_ID}").removesuffix(">")
    return int(number) if number else None


def parse_record(record: bytes) -> dict:
    """Fields of one record; a response whose payload differs from its digest raises."""
    head, _, block = record[:-4].partition(b"\r\n\r\n")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = _header(head, "WARC-Type"), base64.b32decode(_header(head, "WARC-Payload-Digest")[5:])
    if kind == "response" and hashlib.sha1(payload).digest() != digest:
        raise ValueError("a payload differs from its digest")
    url = _header(head, "WARC-Target-URI")
    return {
        "page_id": _page(_header(head, "WARC-Record-ID")), "record_type": kind,
        "url": url and re.sub(r"%(0[0-9A-F]|1[0-9A-F]|20|25|7F)", lambda m: chr(int(m[1], 16)), url),
        "refers_to": _page(_header(head, "WARC-Refers-To")), "payload_bytes": int(_header(http, "Content-Length")),
        "payload_digest": digest.hex(), "payload": payload if kind == "response" else None,
    }


def read_records(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of normalised archives, each read at its offset of the sidecar index."""
    schema = pa.schema([
        ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()),
        ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with storage.open_random(row["index"]) as side:
                    entries = [json.loads(line) for line in side.read().splitlines()]
                with storage.open_random(row["archive"]) as source:
                    rows = []
                    for entry in entries:
                        source.seek(entry["offset"])
                        record = zlib.decompress(source.read(entry["length"]), 31)
                        rows.append({"archive": row["archive"], **entry, **parse_record(record)})
                        if not payloads:
                            rows[-1]["payload"] = None
                        if len(rows) == 64:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return storage.one_task_per_file(archives.select("archive", "index")).mapInArrow(read, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as monolithic archives, normalise those, and read the records back."""
    folder = scratch_folder(pages.sparkSession, "warc")
    return read_records(normalise(write_archives(pages, f"{folder}/whole"), f"{folder}/members"), payloads=False)
