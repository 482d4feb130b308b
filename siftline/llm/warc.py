"""WARC archives: one gzip member per record, written and read in bounded memory.

Records go to files below a shared folder. The reader takes a file in order: it decompresses member by member
and piece by piece, finds a record's end by its content length, and verifies digests while it reads.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.session import stage, work_folder

_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 20
#: Longest header block accepted.
_HEADER = 1 << 20


@dataclass(frozen=True)
class Archives:
    """``file_bytes``: a file is closed once it is this long. Equal payloads of at least ``least_revisit`` bytes
    are written once, and referred to by revisit records."""

    file_bytes: int = 256 << 20
    least_revisit: int = 0
    level: int = 6
    date: str = "1970-01-01T00:00:00Z"


def base32_digest(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(record_id: str | None) -> int | None:
    value = (record_id or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, revisit: bool, refers_to: int | None, date: str) -> bytes:
    """The bytes of a response or revisit record. Line ends and other controls in the URL are percent-encoded."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _record_id(page_id),
        "WARC-Date": date,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{base32_digest(sha1)}",
        "WARC-Block-Digest": f"sha1:{base32_digest(hashlib.sha1(block).digest())}",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        fields["WARC-Target-URI"] = "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)
    if revisit:
        fields["WARC-Profile"] = _PROFILE
        fields["WARC-Refers-To"] = _record_id(refers_to)
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return _VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _write(folder: str, params: Archives):
    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        out, path, n, size = None, None, 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{path}.open", compression=None)
                content = record(
                    row["page_id"], row["url"], row["payload"], bytes.fromhex(row["sha1"]), row["revisit"], row["refers_to"], params.date
                )
                member = zlib.compressobj(params.level, zlib.DEFLATED, 31)
                content = member.compress(content) + member.flush()
                out.write(content)
                n, size = n + 1, size + len(content)
                if size >= params.file_bytes:
                    out.close()
                    store.move(f"{path}.open", path)
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            store.move(f"{path}.open", path)
            done.append((path, n, size))
        paths, counts, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
            ["path", "records", "bytes"],
        )

    return run


def write_archives(pages: DataFrame, params: Archives = Archives(), folder: str | None = None) -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html)``; returns the files: ``path, records, bytes``.

    The payload is ``html`` in UTF-8; null is empty. Of records with equal payloads of at least ``least_revisit`` bytes
    that with the smallest page_id is a response and the others revisit it; all rows with that page_id are
    responses. A row without page_id revisits a row with an id, and is a response if there is none. A null URL gives no
    target. Other columns are ignored.

    ``folder`` must be one that all executors reach (a new one below ``spark.checkpoint.dir`` if not given). A task
    names its files at random and its list of files counts only if the task succeeds, so those of a failed or
    repeated task are never read.
    """
    spark = pages.sparkSession
    folder = folder or work_folder(spark, "warc")
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    smallest = rows.where(F.col("size") >= params.least_revisit).groupBy("sha1", "size").agg(F.min("page_id").alias("first"))
    shared = rows.join(smallest, ["sha1", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    shared = shared.select(
        "page_id", "url", "payload", "sha1", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to")
    )
    return stage(shared.mapInArrow(_write(folder, params), "path string, records long, bytes long"), "warc-files")


class _Member:
    """The bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, file, rest: bytes):
        self.file, self.rest = file, rest
        self.inflate = zlib.decompressobj(31)
        self.ready = bytearray()

    def fill(self) -> bool:
        """Decompress some more; false at the member's end."""
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail or self.rest or self.file.read(_CHUNK)
        if not self.inflate.unconsumed_tail:
            self.rest = b""
        if not data:
            raise ValueError("the archive ends within a record")
        self.ready += self.inflate.decompress(data, _CHUNK)
        if self.inflate.eof:
            self.rest = self.inflate.unused_data or self.rest
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.ready.find(mark)) < 0:
            if len(self.ready) > _HEADER or not self.fill():
                raise ValueError("no end of a record's header")
        head = bytes(self.ready[:at])
        del self.ready[: at + len(mark)]
        return head

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.ready and not self.fill():
                raise ValueError("a record is shorter than its content length")
            part = bytes(self.ready[:size])
            del self.ready[: len(part)]
            size -= len(part)
            yield part


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _read_record(member: _Member, with_payload: bool) -> dict:
    fields = _fields(member.until(b"\r\n\r\n"))
    length = int(fields["content-length"])
    block, payload = hashlib.sha1(), hashlib.sha1()
    kept, http, in_payload, size = [], bytearray(), False, 0
    for part in member.take(length):
        block.update(part)
        if not in_payload:
            http += part
            end = http.find(b"\r\n\r\n")
            if end < 0:
                continue
            part, in_payload = bytes(http[end + 4 :]), True
            del http[end:]
        payload.update(part)
        size += len(part)
        if with_payload:
            kept.append(part)
    ended = b"".join(member.take(4)) == b"\r\n\r\n"
    while ended and not member.ready and member.fill():
        pass
    if not ended or member.ready:
        raise ValueError("a record's end is not where its content length says")
    if fields["warc-block-digest"] != f"sha1:{base32_digest(block.digest())}":
        raise ValueError("block digest differs")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if revisit:
        size = next(int(v) for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")) if k.lower() == "content-length")
    elif digest != base32_digest(payload.digest()):
        raise ValueError("payload digest differs")
    return {
        "page_id": _page_id(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": _page_id(fields.get("warc-refers-to")),
        "payload": b"".join(kept) if with_payload and not revisit else None,
    }


def read_records(file, with_payload: bool = True) -> Iterator[dict]:
    """The records of an open archive in order; ValueError where it is damaged or a digest differs."""
    rest = b""
    while rest := rest or file.read(_CHUNK):
        member = _Member(file, rest)
        yield _read_record(member, with_payload)
        rest = member.rest


_ROW = pa.schema(
    {
        "page_id": pa.int64(),
        "url": pa.string(),
        "payload_bytes": pa.int64(),
        "payload_digest": pa.string(),
        "record_type": pa.string(),
        "refers_to": pa.int64(),
        "payload": pa.binary(),
    }
)


def _read(folder: str, with_payload: bool):
    def run(batches):
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as file:
                    try:
                        for row in read_records(file, with_payload):
                            rows.append(row)
                            size += 200 + len(row["payload"] or b"")
                            if size > 4 * _CHUNK:
                                yield pa.RecordBatch.from_pylist(rows, _ROW)
                                rows, size = [], 0
                    except (ValueError, KeyError, zlib.error) as error:
                        raise ValueError(f"{path}: {error}") from error
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ROW)

    return run


def read_archives(files: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the files of ``files(path)``, one file per task: ``page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, payload``.

    ``folder`` names the file system of the paths. Payload and block digests are verified; a damaged archive stops the job.
    ``payload`` is null for revisits, and everywhere unless ``with_payload``: then only hash states are held.
    """
    n = max(1, files.count())
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return files.select("path").repartition(n).mapInArrow(_read(folder, with_payload), schema)
