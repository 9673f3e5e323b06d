"""Operator 3: WARC archives, written and read record by record.

Each record is a gzip member of its own. The reader goes through an archive in small steps with an incremental zlib
decompressor, frames each record by its Content-Length and verifies its digests. Archives are rows of a table (name and
content), so any store that Spark writes can hold them; export_files and read_files are the way to and from .warc.gz
files.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import bounded, materialise, read_table

MIN_REVISIT_BYTES = 1000
#: An archive is closed when it has so many bytes.
ARCHIVE_BYTES = 16 << 20
#: Groups of equal payloads that are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 200_000
STEP = 1 << 16
DATE = "2024-01-01T00:00:00Z"
NAME = "urn:page:"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A record as a gzip member: a response, or if refers_to is given a revisit, whose block has the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: <{NAME}{'' if page is None else page}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + quote(url or "", safe="!#$%&'()*+,/:;=?@[]~"), "Content-Type: application/http;msgtype=response",
        f"WARC-Block-Digest: {_sha1(block)}", f"WARC-Payload-Digest: {_sha1(payload)}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{NAME}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(content: bytes) -> Iterator[tuple[int, bytes, str | None]]:
    """Offset, data and fault (null if none) of each gzip member; what follows a fault isn't read."""
    view, at = memoryview(content), 0
    while at < len(view):
        start, unpacker, parts = at, zlib.decompressobj(31), []
        try:
            while not unpacker.eof and at < len(view):
                step = view[at : at + STEP]
                parts.append(unpacker.decompress(step))
                at += len(step) - len(unpacker.unused_data)
        except zlib.error as fault:
            yield start, b"".join(parts), f"gzip: {fault}"
            return
        yield start, b"".join(parts), None if unpacker.eof else "gzip: the archive ends inside a member"


def _headers(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines)}


def _page(name: str) -> int | None:
    return _whole(name.removeprefix(f"<{NAME}").removesuffix(">"))


def _whole(text: str) -> int | None:
    """A whole number of ASCII digits that fits 64 bits; null for anything else."""
    digits = text.removeprefix("-")
    return int(text) if digits.isascii() and digits.isdigit() and len(digits) < 19 else None


def _digest(text: str, data: bytes | None = None) -> tuple[str | None, bool]:
    """A labelled SHA-1 digest as hex, in base 32 or hex, or null; and whether it contradicts data. Other algorithms can't."""
    kind, _, value = text.partition(":")
    found = None
    if kind.lower() == "sha1":
        try:
            found = (bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())).hex()
        except ValueError:
            return None, data is not None
    own = None if data is None else hashlib.sha1(data).hexdigest()
    return found or own, own is not None and found is not None and found != own


def parse(data: bytes) -> dict:
    """The fields of one record; fault names what is wrong with it.

    Digests of SHA-1 are checked, in base 32 or hex; those of other algorithms aren't. The HTTP length isn't held against
    the payload, as it may be that of an encoded body.
    """
    out: dict = dict.fromkeys(FIELDS)
    head, mark, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    warc = _headers(lines)
    length = _whole(warc.get("content-length", ""))
    if not mark or not first.startswith(b"WARC/") or length is None or length < 0:
        return out | {"fault": "no WARC header"}
    block = rest[:length]
    out |= {"record_type": warc.get("warc-type"), "page_id": _page(warc.get("warc-record-id", "")), "refers_to": _page(warc.get("warc-refers-to", "")), "url": warc.get("warc-target-uri")}
    if len(block) < length or rest[length:] != b"\r\n\r\n":
        return out | {"fault": "length"}
    if "warc-block-digest" in warc and _digest(warc["warc-block-digest"], block)[1]:
        return out | {"fault": "block digest"}
    http, _, payload = block.partition(b"\r\n\r\n")
    size = _whole(_headers(http.split(b"\r\n")[1:]).get("content-length", ""))
    digest = warc.get("warc-payload-digest", "")
    if out["record_type"] == "response":
        out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
        if digest and _digest(digest, payload)[1]:
            return out | {"fault": "payload digest"}
    elif digest:
        out |= {"payload_bytes": size, "payload_digest": _digest(digest)[0]}
    return out


FIELDS = {
    "page_id": pa.int64(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(), "fault": pa.string(),
}


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """A row for each archive: archive (its name), content and records.

    Of records with equal payloads of at least MIN_REVISIT_BYTES, that with the largest page_id is the response and the
    others revisit it; a row with that page_id again, or with a null one in a group of nulls, is a response too. Null
    html is an empty payload. A null url is an empty one. Repeated rows are records of their own; an empty table gives
    no archive. Other columns aren't read.
    """
    spark = pages.sparkSession
    inner = pages.select(F.col(f"`{page_id}`").cast("long").alias("page"), F.col(f"`{url}`").cast("string").alias("url"), F.encode(F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    keyed = inner.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    groups = keyed.where(F.col("size") >= MIN_REVISIT_BYTES).groupBy("digest", "size").agg(F.max("page").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = materialise(groups, "groups")
    # The groups' number is known here: up to BROADCAST_GROUPS take 20 MB, and beyond that both sides are shuffled.
    joined = keyed.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, ["digest", "size"], "left")
    chosen = joined.select("page", "url", "payload", F.when(~F.col("first").eqNullSafe(F.col("page")), F.col("first")).alias("refers_to"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{task:06d}-{number:06d}.warc.gz"]), pa.array([b"".join(parts)], pa.binary()), pa.array([len(parts)], pa.int64())], ["archive", "content", "records"])

        for batch in bounded(batches, "payload"):
            for row in zip(*(batch.column(c) for c in ("page", "url", "payload", "refers_to")), strict=True):
                parts.append(record(*(x.as_py() for x in row)))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield closed()
                    number, parts, size = number + 1, [], 0
        if parts:
            yield closed()

    return chosen.mapInArrow(run, "archive string, content binary, records bigint")


def read_records(archives: DataFrame, payload: bool = False) -> DataFrame:
    """A row for each record of the archives (columns archive and content), with its offset, FIELDS and fault.

    payload leaves the payloads in. An archive cut short or damaged gives the records before the damage and a row with
    the fault; a record with odd headers or digests gives a row with a fault or nulls, never an error. null or empty
    content gives none. A record of any length is one row; offset is the place of its member in the whole file.
    """
    archives = archives if "start" in archives.columns else archives.withColumn("start", F.lit(0).cast("long"))
    fields = {"archive": pa.string(), "offset": pa.int64()} | {k: t for k, t in FIELDS.items() if payload or k != "payload"}
    schema = ", ".join(f"{k} { {pa.int64(): 'bigint', pa.string(): 'string', pa.binary(): 'binary'}[t] }" for k, t in fields.items())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, start in zip(batch.column("archive"), batch.column("content"), batch.column("start").to_pylist(), strict=True):
                rows, size = [], 0
                for offset, data, fault in members(content.as_py() or b""):
                    found = dict.fromkeys(FIELDS) | {"fault": fault} if fault else parse(data)
                    rows.append({"archive": name.as_py(), "offset": start + offset} | found)
                    size += len(data)
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in fields.items()], list(fields))
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in fields.items()], list(fields))

    return archives.select("archive", "content", "start").mapInArrow(run, schema)


def export_files(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as a file in a folder that all executors mount; a row for each with its path and bytes.

    A file appears under its name only when it is whole, so a task that runs again replaces it by the same.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                path = os.path.join(folder, name)
                part = f"{path}.{TaskContext.get().taskAttemptId()}"
                with open(part, "wb") as out:
                    out.write(content.as_py())
                os.replace(part, path)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(content.as_py())], pa.int64())], ["path", "bytes"])

    return archives.select("archive", "content").mapInArrow(run, "path string, bytes bigint")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Archives from .warc.gz files in any store that Spark reads, each whole in a row: for files under 1 GB."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def read_large_files(spark: SparkSession, folder: str, pieces: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of any size in a folder that all executors mount, as rows of whole members of about so many bytes.

    A task goes through a file in steps, as the reader does, and cuts it where a member ends. start is a row's place in
    its file. What follows damage is the file's last row, in which read_records finds the fault.
    """
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(path: str, held: bytearray, start: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([bytes(held)], pa.binary()), pa.array([start], pa.int64())], ["archive", "content", "start"])

        for batch in batches:
            for path in batch.column("path").to_pylist():
                with open(path, "rb") as source:
                    held, start, unpacker, sound = bytearray(), 0, zlib.decompressobj(31), True
                    while step := source.read(STEP):
                        while step and sound:
                            try:
                                unpacker.decompress(step)
                            except zlib.error:
                                sound = False
                                break
                            used = len(step) - len(unpacker.unused_data)
                            held += step[:used]
                            step = step[used:]
                            if unpacker.eof:
                                unpacker = zlib.decompressobj(31)
                                if len(held) >= pieces:
                                    yield row(path, held, start)
                                    start, held = start + len(held), bytearray()
                        if not sound:
                            held += step
                            break
                    if held:
                        yield row(path, held, start)

    return files.mapInArrow(cut, "archive string, content binary, start bigint")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialise(write_archives(read_table(spark, sf_dir, "pages")), "archives")
    return read_records(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("fault").isNull().alias("verified"))


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN first END AS refers_to, TRUE AS verified FROM g
"""
