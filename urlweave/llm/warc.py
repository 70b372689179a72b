"""WARC archives: written one gzip member a record, read back in byte ranges.

Writing. A task writes its rows to one archive in a folder that all machines share; the file takes its final name
only when it is whole, and the name and bytes depend on the partition alone, so a repeated task replaces its own file.
Of records with equal payloads the one with the smallest page id is a response, the others are revisits that
refer to it and hold no payload. Which rows those are is found on (id, digest) alone.

Reading. Archives are cut into byte ranges, a row each. A task looks in its range for gzip's magic bytes. A candidate
is a record only if the member's first bytes decode to a WARC version line, the whole member decodes with its
checksum, and a member or the file's end follows: so neither chance nor a compressed record inside a payload
counts. The record that starts inside a range belongs to it, even if it ends beyond; from a true record on, members
follow each other.

Defined cases: a null html is an empty payload; empty payloads are equal to each other; payloads of fewer bytes than
``min_bytes`` are always responses; rows that repeat id and payload each are a record, and all rows with the
smallest id of their payload are responses; a null id is last in order and can be referred to only by no one, so
its group's rows with null ids refer to the smallest id, or are responses if there is none; control characters
in URLs are percent-encoded in headers, a null URL is written as an empty one; an empty table gives no archives
and an empty result; further columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_dir, ship, stage, table

#: Bytes of a reading task.
RANGE_BYTES = 32 << 20

#: Bytes that a reading task asks for at once.
READ_BYTES = 1 << 20

LEVEL = 4

MAGIC = b"\x1f\x8b\x08"

RECORD_SCHEMA = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary, archive string, start bigint"


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder or file given as a URI or a path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), re.sub("^file:", "", uri))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn)
    return int(found[1]) if found else None


def _safe(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_safe(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=LEVEL, mtime=0) as f:
        f.write(raw)
    return out.getvalue()


def parse(raw: bytes) -> dict:
    """A decoded member's fields."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    is_revisit = fields["warc-type"] == "revisit"
    size = int(declared[1]) if is_revisit and declared else len(payload)
    return {"page_id": _page(fields.get("warc-record-id", "")), "url": fields.get("warc-target-uri", ""), "record_type": fields["warc-type"], "payload_bytes": size, "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": _page(fields.get("warc-refers-to", "")) if is_revisit else None, "payload": None if is_revisit else payload}


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, root = filesystem(folder)
        name, part = f"{root}/part-{task.partitionId():06d}.warc.gz", f"{root}/.part-{task.partitionId():06d}-{task.taskAttemptId()}"
        out, size, count = None, 0, 0
        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(batch.column(k) for k in range(5)), strict=True):
                payload = (html.as_py() or "").encode()
                raw = record(page_id.as_py(), url.as_py(), payload, base32_sha1(payload), refers_to.as_py(), bool(revisit.as_py()))
                if out is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(part)
                out.write(raw)
                size, count = size + len(raw), count + 1
        if out is not None:
            out.close()
            files.move(part, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], names=["archive", "bytes", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write page_id, url, html as archives in ``folder``; the staged manifest: archive, bytes, records."""
    ship(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sha = F.unhex(F.sha1(payload))
    digests = stage(pages.select("page_id", F.octet_length(payload).cast("bigint").alias("size"), sha.alias("digest")), "payload_digests")
    long = digests.where(F.col("size") >= min_bytes)
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    revisits = long.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first").distinct()
    # By id, not by payload: copies of one payload lie in different partitions.
    laid = pages.withColumn("_sha", sha).join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_digest")), "left")
    rows = laid.select("page_id", "url", "html", F.col("first").alias("refers_to"), F.col("_digest").isNotNull().alias("revisit"))
    return stage(rows.mapInArrow(_writer(folder), "archive string, bytes bigint, records bigint"), "manifest")


class Archive:
    """An archive's bytes from some offset on, read in pieces."""

    def __init__(self, files, path: str, size: int):
        self.file, self.size = files.open_input_file(path), size

    def at(self, start: int, length: int) -> bytes:
        return self.file.read_at(max(0, min(length, self.size - start)), start)

    def member(self, start: int) -> tuple[bytes, int] | None:
        """(decoded bytes, end) of the member at ``start`` if it is a whole WARC record and is followed by another or the end."""
        decoder = zlib.decompressobj(31)
        out, place, step = [], start, 1 << 14
        try:
            while not decoder.eof:
                piece = self.at(place, step)
                if not piece:
                    return None
                out.append(decoder.decompress(piece))
                place += len(piece)
                if sum(map(len, out[:2])) >= 5 and len(out) <= 2 and not b"".join(out).startswith(b"WARC/"):
                    return None
                step = READ_BYTES
        except zlib.error:
            return None
        end = place - len(decoder.unused_data)
        raw = b"".join(out)
        if not raw.startswith(b"WARC/") or end < self.size and self.at(end, 3) != MAGIC:
            return None
        return raw, end

    def records(self, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
        """(start, decoded bytes) of the records that start in [start, stop)."""
        while start < stop:
            found = self.member(start) if self.at(start, 3) == MAGIC else None
            if found:
                yield start, found[0]
                start = found[1]
            else:
                start = self.next_magic(start + 1, stop)

    def next_magic(self, start: int, stop: int) -> int:
        while start < stop:
            piece = self.at(start, min(READ_BYTES, stop - start) + len(MAGIC) - 1)
            at = piece.find(MAGIC)
            if at >= 0:
                return start + at
            start += READ_BYTES
        return stop


def _reader(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(folder)
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
        rows: list[tuple] = []
        held = 0

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return out

        for batch in batches:
            for path, size, start, stop in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                archive = Archive(files, path, size)
                for at, raw in archive.records(start, stop):
                    got = parse(raw)
                    if got["payload"] is not None and base32_sha1(got["payload"]) != got["payload_digest"]:
                        raise ValueError(f"{path} at {at}: the payload's digest differs")
                    if not with_payload:
                        got["payload"] = None
                    rows.append((*got.values(), path, at))
                    held += len(got["payload"] or b"") + 200
                    if held > 8 << 20:
                        yield told()
                        held = 0
        if rows:
            yield told()

    return run


def read_archives(manifest: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of the manifest's archives, read in ranges of ``range_bytes``."""
    spark = manifest.sparkSession
    ship(spark)
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(range_bytes).cast("bigint"))
    ranges = manifest.where("bytes > 0").select("archive", "bytes", F.explode(starts).alias("start"))
    ranges = ranges.withColumn("stop", F.least(F.col("bytes"), F.col("start") + range_bytes))
    spread = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "archive", "start")
    return spread.mapInArrow(_reader(folder, with_payload), RECORD_SCHEMA)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record tells after a round trip through archives."""
    folder = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex[:8]}"
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
