"""WARC archives written from and read as a chunked record table."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import shared_path, stored, text_or_empty, with_hot

CHUNK = 1 << 18  # payload bytes of a chunk row
FILE = 1 << 28  # bytes after which a task begins another archive
SMALL = 100  # payloads below this are never revisits

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-page:"


def plan(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, url, payload, size, digest, record_type, refers_to) of every row.

    Of equal payloads of SMALL bytes or more the smallest page_id is the
    response and all others revisit it; rows that repeat that page_id are
    responses too, as is every smaller payload. Null payloads count as empty; a
    null page_id is a response only where no other id has its payload.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text_or_empty(payload).cast("binary").alias("payload"))
    rows = rows.withColumns({"size": F.length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    found = rows.where(F.col("size") >= SMALL).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    groups = stored(found.where("n > 1"), "payloads")
    rows = with_hot(rows, groups, "digest", "n", rows.count())
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    kind = F.when(revisit, "revisit").otherwise("response").alias("record_type")
    return rows.select("page_id", "url", "payload", "size", "digest", kind, F.when(revisit, F.col("first")).alias("refers_to"))


def chunks(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of ``records`` in order: all columns but the payload, chunk_no, last and chunk.

    A revisit has one chunk without bytes. A record's chunks follow one another
    in its partition, so a consumer holds one chunk at a time.
    """
    held = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("size"))
    top = F.greatest(F.ceil(held / chunk), F.lit(1)).cast("int") - 1
    out = records.withColumn("top", top).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("top"))))
    piece = F.expr(f"CASE WHEN record_type = 'revisit' THEN X'' ELSE substring(payload, chunk_no * {chunk} + 1, {chunk}) END")
    keep = [c for c in records.columns if c != "payload"]
    return out.select(*keep, "chunk_no", (F.col("chunk_no") == F.col("top")).alias("last"), piece.alias("chunk"))


def _head(row: dict) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["size"]
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", f"<{RECORD_ID}{row['page_id']}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join((row["url"] or "").split())),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    length = len(http)
    if row["record_type"] == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{RECORD_ID}{row['refers_to']}>"), ("X-Payload-Length", row["size"])]
    else:
        length += row["size"]
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in [*fields, ("Content-Length", length)])]
    return b"\r\n".join(lines) + b"\r\n\r\n" + http


def write_archives(records: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """Writes ``records`` (as of plan) as gzipped archives in ``folder``; returns the manifest (path, records), stored.

    Each record is a gzip member, streamed from its chunk rows with its digest
    carried along and compared with the header's at the end. Names are unique to
    a task's attempt; only files that the manifest names count, so a lost
    executor's leftovers are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, path, count, packed = None, "", 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path, count = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(path, compression=None)
                if row["chunk_no"] == 0:
                    packed, seen = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha256()
                    out.write(packed.compress(_head(row)))
                seen.update(row["chunk"])
                out.write(packed.compress(row["chunk"]))
                if row["last"]:
                    if row["record_type"] != "revisit" and seen.hexdigest() != row["digest"]:
                        raise ValueError(f"payload of page {row['page_id']} changed while it was written")
                    out.write(packed.compress(b"\r\n\r\n") + packed.flush())
                    count += 1
                    if out.tell() >= FILE:
                        out.close()
                        yield pa.record_batch([pa.array([path]), pa.array([count], pa.int64())], names=["path", "records"])
                        out = None
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([path]), pa.array([count], pa.int64())], names=["path", "records"])

    return stored(chunks(records, chunk).mapInArrow(run, "path string, records long"), "manifest")


class _Bytes:
    """Reads a gzipped file forward: lines, and bytes in pieces."""

    def __init__(self, source, chunk: int):
        self.source, self.chunk, self.buffer, self.z = source, chunk, b"", zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            data = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            data = data or self.source.read(self.chunk)
            if not data:
                return False
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            if got := self.z.decompress(data, self.chunk):
                self.buffer += got
                return True

    def line(self) -> bytes | None:
        while b"\r\n" not in self.buffer:
            if not self._more():
                return None
        found, _, self.buffer = self.buffer.partition(b"\r\n")
        return found

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self._more():
                raise ValueError("the archive ends within a record")
            piece, self.buffer = self.buffer[: min(n, self.chunk)], self.buffer[min(n, self.chunk) :]
            n -= len(piece)
            yield piece


def _fields(source: _Bytes) -> dict[str, str]:
    out = {}
    while line := source.line():
        k, _, v = line.decode().partition(": ")
        out[k.lower()] = v
    return out


def _page(uri: str | None) -> int | None:
    tail = (uri or "<>")[1:-1].removeprefix(RECORD_ID)
    return int(tail) if tail.lstrip("-").isdigit() else None


COLUMNS = "page_id long, url string, record_type string, refers_to long, chunk_no int, last boolean, payload_bytes long, payload_digest string"


def read_archives(manifest: DataFrame, folder: str, payload: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of all archives: COLUMNS, and ``chunk`` if ``payload``.

    ``payload_bytes`` and ``payload_digest`` are carried over a record's chunks,
    so its last row has those of the whole payload, compared with the header's;
    a revisit has its response's from its own header. Archives are read in
    parallel, a chunk at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        names, rows, held = [c.split()[0] for c in COLUMNS.split(", ")], [], 0
        types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in COLUMNS.split(", ")]

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=False)]
            return pa.record_batch(arrays + ([pa.array(columns[-1], pa.binary())] if payload else []), names=names + ["chunk"] * payload)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(path, compression=None) as f:
                    source = _Bytes(f, chunk)
                    while source.line() is not None:
                        h = _fields(source)
                        http = _fields(source)
                        base = (_page(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], _page(h.get("warc-refers-to")))
                        digest, seen, n = h["warc-payload-digest"].partition(":")[2], hashlib.sha256(), 0
                        size = 0 if h["warc-type"] == "revisit" else int(http["content-length"])
                        for number, piece in enumerate(source.pieces(size) if size else [b""]):
                            seen.update(piece)
                            n += len(piece)
                            last = n == size
                            if last and size and seen.hexdigest() != digest:
                                raise ValueError(f"the digest of {h['warc-record-id']} does not fit")
                            if payload or last:
                                known = (int(h["x-payload-length"]), digest) if h["warc-type"] == "revisit" else (n, seen.hexdigest())
                                rows.append((*base, number, last, *known, *([piece] if payload else [])))
                                held += 200 + len(piece) * payload
                            if held > 1 << 24:
                                yield out()
                                rows, held = [], 0
                        if source.line() != b"" or source.line() != b"":
                            raise ValueError(f"{h['warc-record-id']} does not end where it should")
        if rows:
            yield out()

    files = manifest.select("path")
    files = files.repartition(max(1, min(manifest.count(), 4096)))
    return files.mapInArrow(run, COLUMNS + ", chunk binary" * payload)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every row, from archives written and read back.

    Empty and null payloads are responses without bytes, very long ones travel
    in chunks. Repeated rows are records of their own; an empty table gives an
    empty table; other columns are not read.
    """
    folder = shared_path(pages.sparkSession, "archives")
    manifest = write_archives(plan(pages, page_id, url, payload), folder)
    rows = read_archives(manifest, folder, payload=False).where("last")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
