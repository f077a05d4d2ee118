"""WARC archives with revisit resolution.

Headers (id, payload digest, payload length) are shuffled by digest; the smallest id of a group of equal payloads is
the original. Records join that answer and are written as gzip members with fresh headers: originals as `response`,
the others as `revisit` records that name the original and carry no payload. Files are written under a name of their
own and listed in a manifest, a written table, which alone is trusted when archives are read; so a task that runs
again leaves nothing that is read twice. Readers stream a file record by record.

The group of a digest is found by a partial aggregation, and the join's two sides are tables, whose hot keys Spark
splits, so a digest that a third of all records share falls on no single task.

Nulls: a null payload is empty; payloads under MIN_REVISIT bytes are always responses. A record with a null id revisits
a known original or is a response. A null url has no target header. Rows that repeat an id with its payload are responses each. Empty tables
give an empty manifest. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, prepare, table, written

MIN_REVISIT = 100
#: A file is closed when it has this many bytes.
FILE_BYTES = 64 << 20
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = 0x7175617272798000 << 64  # upper half of record ids
NO_ID = 0x7175617272798001 << 64
INFO = b"software: quarry\r\nformat: WARC File Format 1.1\r\n"

MANIFEST = "path string, n_records long, n_bytes long"
RECORD = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"


def record_urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=NO_ID if page_id is None else SPACE | page_id & (1 << 64) - 1)}>"


def id_of_urn(urn: str) -> int | None:
    n = uuid.UUID(urn[10:-1]).int
    if n >> 64 << 64 == NO_ID:
        return None
    low = n & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def info_bytes(name: str, date: str) -> bytes:
    """The record that opens a file."""
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(INFO)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + INFO + b"\r\n\r\n"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; the payload's own digest and length are always in its headers."""
    block = HTTP_HEAD + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_urn(page_id)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {''.join(x for x in url if x >= ' ')}"] if url else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {length}",
        *([f"WARC-Refers-To: {record_urn(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def resolved(records: DataFrame) -> DataFrame:
    """records (page_id, url, payload) with payload_digest, payload_bytes, refers_to and revisit."""
    payload = F.coalesce(F.col("payload"), F.lit(b"").cast("binary"))
    r = records.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    r = r.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    headers = r.where(F.col("payload_bytes") >= MIN_REVISIT).select("page_id", "payload_digest")
    groups = headers.groupBy(F.col("payload_digest").alias("_digest")).agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    shared = written(groups.where("_n > 1 AND _first IS NOT NULL").select("_digest", "_first"), "digests")
    revisit = F.coalesce(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.lit(False))
    out = r.join(shared, r["payload_digest"] == shared["_digest"], "left")
    return out.select(*r.columns, F.when(revisit, F.col("_first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(rows: DataFrame, folder: str, date: str | None = None) -> DataFrame:
    """Writes resolved records under folder; returns the manifest as a written table. All headers bear one date, that
    of the call, so a task that runs again writes the same. Every file opens with a warcinfo record."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        context, out, done = TaskContext.get(), None, []
        name = f"part-{context.partitionId() if context else 0:05d}-{uuid.uuid4().hex}"
        n = size = 0

        def close() -> None:
            nonlocal out, n, size
            if out is not None:
                out.close()
                done.append((f"{base}/{name}-{len(done):04d}.warc.gz", n, size))
            out, n, size = None, 0, 0

        for b in batches:
            for i, url, payload, digest, length, refers, revisit in zip(*(b.column(c).to_pylist() for c in range(7))):
                if out is None:
                    out = fs.open_output_stream(f"{base}/{name}-{len(done):04d}.warc.gz", compression=None)
                    member = gzip_member(info_bytes(f"{name}-{len(done):04d}.warc.gz", date))
                    out.write(member)
                    size += len(member)
                member = gzip_member(record_bytes(i, url, b"" if revisit else payload, digest, length, refers, revisit, date))
                out.write(member)
                n += 1
                size += len(member)
                if size >= FILE_BYTES:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "n_records", "n_bytes"])

    cols = rows.select("page_id", "url", F.when(F.col("revisit"), F.lit(b"").cast("binary")).otherwise(F.col("payload")).alias("payload"), "payload_digest", "payload_bytes", "refers_to", "revisit")
    return written(cols.mapInArrow(run, MANIFEST), "manifest")


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip stream, whose members may hold one record or many."""
    buffer, inflate, ended = bytearray(), zlib.decompressobj(31), False

    def more() -> bool:
        nonlocal inflate, ended
        while not ended:
            data = stream.read(1 << 20)
            if not data:
                ended = True
                buffer.extend(inflate.flush())
                return True
            while data:
                buffer.extend(inflate.decompress(data))
                data = inflate.unused_data
                if inflate.eof:
                    inflate = zlib.decompressobj(31)
            return True
        return False

    at = 0
    while True:
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if bytes(buffer[at:]).strip():
                    raise ValueError("the archive ends inside a record")
                return
        lines = bytes(buffer[at:end]).decode("utf-8", "replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, size = end + 4, int(head["content-length"])
        while len(buffer) < start + size + 4:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield head, bytes(buffer[start : start + size])
        at = start + size + 4
        if at > 1 << 20:
            del buffer[:at]
            at = 0


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """RECORD rows of the files in the manifest; a response whose payload has another digest than its header fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for head, block in records_of(stream):
                        if head["warc-type"] == "warcinfo":
                            continue
                        digest, length = head["warc-payload-digest"].removeprefix("sha256:"), int(head["x-payload-length"])
                        kind, payload, refers = head["warc-type"], None, None
                        if kind == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{path}: {head['warc-record-id']} has another payload than its headers say")
                        else:
                            refers = id_of_urn(head["warc-refers-to"])
                        rows.append((id_of_urn(head["warc-record-id"]), kind, refers, head.get("warc-target-uri"), length, digest, payload if payloads else None))
                        held += len(block) if payloads else 0
                        if len(rows) >= 2000 or held > 16 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    files = manifest.select("path")
    return files.repartition(max(1, min(4096, manifest.count()))).mapInArrow(run, RECORD)


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    folder = new_path(spark, "archives")
    manifest = write_archives(resolved(pages), folder)
    return read_archives(manifest, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
