"""WARC archives compressed record by record with a Zstandard dictionary.

An archive file starts with a skippable frame that holds the dictionary, built from
the first records it archives; then each record is a frame of its own, the first of
them a warcinfo. Of records with equal payloads one is a response and the others
revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from typing import BinaryIO
from urllib.parse import quote, unquote

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vcspark.operators.skew import salted_join
from vcspark.sources.shared import new_shared_path, save_shared

DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20
ARCHIVE_BYTES = 64 << 20
_READ = 1 << 20
_RESPONSE = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Printable ASCII but %, space and what would end a header line.
_SAFE = "".join(map(chr, range(33, 127))).replace("%", "")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha256: bytes, copy: int = 0) -> str:
    """A record's id, the same in every run: from its page, the SHA-256 of its payload and, of rows that repeat both, a number."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha256.hex()}:{copy}')}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def info_bytes(name: str, date: str) -> bytes:
    block = b"software: vcspark\r\nformat: WARC File Format 1.1\r\n"
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, sha1: str, sha256: bytes, size: int, refers_to: int | None, date: str, copy: int = 0) -> bytes:
    """One WARC record: a response with its payload, or (payload None) a revisit of another page's record."""
    fields = [("WARC-Type", "revisit" if payload is None else "response"), ("WARC-Record-ID", record_id(page_id, sha256, copy)), ("WARC-Date", date)]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=_SAFE)))
    fields += [("WARC-Payload-Digest", f"sha1:{sha1}"), ("X-Payload-Length", str(size))]
    if payload is None:
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", record_id(refers_to, sha256)), ("X-Refers-To-Page-ID", str(refers_to))]
        return _record(fields, b"")
    return _record([*fields, ("Content-Type", "application/http; msgtype=response")], _RESPONSE % len(payload) + payload)


def parse_record(data: bytes) -> dict[str, object]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    if fields["WARC-Type"] == "warcinfo":
        return {"record_type": "warcinfo"}
    block = rest[: int(fields["Content-Length"])]
    number = lambda name: int(fields[name]) if name in fields else None
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    url = fields.get("WARC-Target-URI")
    return {"page_id": number("X-Page-ID"), "record_id": fields["WARC-Record-ID"], "url": None if url is None else unquote(url), "record_type": fields["WARC-Type"], "payload": payload, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": int(fields["X-Payload-Length"]), "refers_to": number("X-Refers-To-Page-ID")}


def _dictionary(samples: list[bytes]) -> bytes:
    """A dictionary built from records; empty if there is too little to learn from."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8)), samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Writes one archive file: records are held until there are ``SAMPLE_BYTES`` for the dictionary, then each goes out at once."""

    def __init__(self, out: BinaryIO) -> None:
        self.out, self.records, self.written = out, 0, 0
        self._held: list[bytes] = []
        self._size = 0
        self._packer: zstandard.ZstdCompressor | None = None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self._packer is None:
            self._held.append(record)
            self._size += len(record)
            if self._size >= SAMPLE_BYTES:
                self._open()
        else:
            self._write(self._packer.compress(record))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _open(self) -> None:
        trained = _dictionary(self._held)
        if trained:
            self._write(struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained)
        self._packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        for record in self._held:
            self._write(self._packer.compress(record))
        self._held.clear()

    def finish(self) -> None:
        if self._packer is None:
            self._open()


def read_archive(stream: BinaryIO) -> Iterator[dict[str, object]]:
    """The records of one archive file, a buffer at a time; frames that are skippable and no dictionary are passed over."""
    data, trained, ended = b"", None, False

    def fill(least: int) -> bool:
        nonlocal data, ended
        while len(data) < least and not ended:
            more = stream.read(_READ)
            ended = not more
            data += more
        return len(data) >= least

    while fill(4):
        magic = struct.unpack_from("<I", data)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            fill(8)
            size = struct.unpack_from("<I", data, 4)[0]
            if magic == DICTIONARY_MAGIC:
                fill(8 + size)
                trained = zstandard.ZstdCompressionDict(data[8 : 8 + size])
                data = data[8 + size :]
            else:
                left, data = 8 + size - len(data), data[8 + size :]
                while left > 0:
                    left -= len(stream.read(min(left, _READ))) or left
            continue
        reader = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
        at = 0
        while len(data) - at >= 4 and struct.unpack_from("<I", data, at)[0] & 0xFFFFFFF0 != 0x184D2A50:
            frame, record = reader.decompressobj(), []
            piece, at = data[at : at + (1 << 16)], at + (1 << 16)
            while True:
                record.append(frame.decompress(piece))
                if frame.eof:
                    break
                piece, at = data[at : at + _READ], at + _READ
                if not piece:
                    data, at = stream.read(_READ), 0
                    if not data:
                        raise ValueError("archive ends within a record")
                    piece, at = data, len(data)
            at = min(at, len(data)) - len(frame.unused_data)
            yield parse_record(b"".join(record))
        data = data[at:]


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, sha1, sha256, size, refers_to, copies): what each page's record is to be.

    Payloads are equal if length, SHA-1 and SHA-256 are. Of equal payloads of at least
    ``least_bytes`` bytes, that with the largest page_id (null is the smallest) is the
    response, refers_to null; others revisit it. ``copies`` counts the rows that share
    page_id and payload.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    sha = F.unhex(F.sha2(payload, 256))
    digests = save_shared(pages.select("page_id", sha.alias("sha256"), F.unhex(F.sha1(payload)).alias("sha1"), F.length(payload).cast("long").alias("size")), "warc-digests")
    equal = ["sha256", "sha1", "size"]
    groups = save_shared(digests.groupBy(*equal).agg(F.max("page_id").alias("response"), F.count("*").alias("n")), "warc-groups")
    same = digests.groupBy("page_id", *equal).agg(F.count("*").alias("copies"))
    planned = salted_join(same, groups, equal, "n", "page_id")
    refers = F.when((F.col("size") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    planned = planned.select(F.col("page_id").alias("__id"), F.col("sha256").alias("__sha"), "sha1", "size", "copies", refers.alias("refers_to"))
    hashed = pages.withColumn("sha256", sha)
    return hashed.join(planned, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("sha256") == F.col("__sha"))).drop("__id", "__sha")


def _store(folder: str) -> tuple[object, str]:
    """pyarrow's file system and the path in it of a folder's URI or path."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def write_warc(planned: DataFrame, folder: str | None = None, limit: int = ARCHIVE_BYTES, date: str | None = None) -> DataFrame:
    """Write archive files under ``folder``, a URI that all executors reach; (path, records), a saved table that lists them.

    A file is closed once it has ``limit`` bytes. Its name is new for every attempt of
    a task, so a lost or repeated attempt leaves a file that the table doesn't list,
    and never a record twice. Without ``folder``, one is made in the shared folder.
    """
    folder = folder or new_shared_path(planned.sparkSession, "warc")
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(folder)
        store.create_dir(root)

        def records() -> Iterator[bytes]:
            for part in parts:
                for page_id, url, html, sha1, sha256, size, refers_to, copy in zip(part.page_id, part.url, part.html, part.sha1, part.sha256, part["size"], part.refers_to, part["copy"]):
                    page_id, refers_to = (None if pd.isna(i) else int(i) for i in (page_id, refers_to))
                    payload = (html or "").encode() if refers_to is None else None
                    yield record_bytes(page_id, url, payload, base64.b32encode(sha1).decode(), sha256, int(size), refers_to, date, int(copy))

        for name, n in write_archives(records(), store, root, limit, date):
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [n]})

    copy = F.when(F.col("copies") > 1, F.monotonically_increasing_id() + 1).otherwise(0)
    rows = planned.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "sha1", "sha256", "size", F.col("refers_to").cast("string").alias("refers_to"), copy.alias("copy"))
    return save_shared(rows.mapInPandas(run, "path string, records long"), "warc-files")


def write_archives(records: Iterable[bytes], store: object, root: str, limit: int, date: str) -> Iterator[tuple[str, int]]:
    """Archive files of about ``limit`` bytes at most, one record at least: name and number of records of each, warcinfo left out."""
    writer = out = None
    name = ""
    for record in records:
        if writer is None:
            name = f"{uuid.uuid4().hex}.warc.zst"
            out = store.open_output_stream(f"{root}/{name}", compression=None)  # the archive is compressed already
            writer = ArchiveWriter(out)
            writer.add(info_bytes(name, date))
        writer.add(record)
        if writer.written >= limit:
            writer.finish()
            out.close()
            yield name, writer.records - 1
            writer = None
    if writer is not None:
        writer.finish()
        out.close()
        yield name, writer.records - 1


def read_warc(files: DataFrame) -> DataFrame:
    """The records of all archives but warcinfo: page_id, record_id, url, record_type, payload, payload_digest, payload_bytes, refers_to.

    ``files`` lists archive files in a column ``path``, as ``write_warc`` returns them.
    A file is read a buffer at a time. A response's digest and size are taken from the
    payload that was read and must agree with its header.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path in part.path:
                store, name = _store(path)
                rows: list[dict[str, object]] = []
                held = 0
                with store.open_input_stream(name, compression=None) as stream:
                    for record in read_archive(stream):
                        if record["record_type"] == "warcinfo":
                            continue
                        payload = record["payload"]
                        if payload is not None and (payload_digest(payload), len(payload)) != (record["payload_digest"], record["payload_bytes"]):
                            raise ValueError(f"payload of page {record['page_id']} differs from its digest")
                        rows.append(record)
                        held += len(payload or b"")
                        if held > 4 << 20 or len(rows) >= 5000:
                            yield pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})

    spread = files.select("path").repartition(F.col("path"))
    return spread.mapInPandas(run, "page_id long, record_id string, url string, record_type string, payload binary, payload_digest string, payload_bytes long, refers_to long")


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write every row's record (page_id, url, html), read the archives back: page_id, url, record_type, payload_digest, payload_bytes, refers_to.

    Null html is an empty payload, a null url is left out of the header. Rows that
    share page_id and payload are one page: each is written, with the same decision
    and an id of its own; revisits then name the page of their response, but an id
    that none of its copies has. Other columns are not read.
    """
    planned = plan_records(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), least_bytes)
    return read_warc(write_warc(planned)).drop("payload", "record_id")
