"""WARC archives through a chunked record table.

Payloads travel as rows of record and chunk number: the writer's input holds each
record's gzip member in chunks of at most ``CHUNK`` bytes of payload, each with the
digest so far, and the reader gives back one row a chunk in the same way.  A record's
last chunk carries its full digest, which must be the one in its headers.

Writing takes three steps: digest every payload (built-in functions); find the
smallest id of each payload that occurs more than once; chunk the rows, of revisits
the headers alone, and append the chunks of each task to archive files in the shared
folder, a new file every ``FILE_BYTES``.  Payloads that occur once don't move between
tasks.  File names hold the task attempt, and only files of attempts that reached the
written manifest are read, so retried tasks do no harm.

Defined results: every row gives a record, repeated rows and rows that share an id
with other payloads too; a null payload is an empty one; of equal payloads rows with
the smallest id are responses and all others revisit it, a null id among them, which
is a response where no row with an id has its payload; an empty table gives no
archive; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import shared_dir, with_maybe, written

CHUNK = 1 << 20
FILE_BYTES = 64 << 20
#: Payloads of fewer bytes are always responses.
MIN_BYTES = 0

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DATE = "2000-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 SHA-1 of a binary column, by built-in functions: five hex digits are four symbols."""
    digits = F.sha1(data)
    group = lambda g: F.conv(F.substring(digits, 5 * g + 1, 5), 16, 10).cast("int")
    symbol = lambda v, k: F.substring(F.lit(_BASE32), F.shiftright(v, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*(symbol(group(g), k) for g in range(8) for k in range(4)))


def _source(pages: DataFrame) -> DataFrame:
    """page_id, url, data, digest (hex), size of every row."""
    url = F.coalesce(F.col("url").cast("string"), F.lit("")) if "url" in pages.columns else F.lit("")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("data"))
    return rows.select("page_id", "url", "data", F.sha1("data").alias("digest"), F.octet_length("data").cast("long").alias("size"))


def firsts(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """digest, size, first: the smallest id of each payload of several rows."""
    rows = _source(pages).select("page_id", "digest", "size").where(F.col("size") >= min_bytes)
    rows = rows.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    return rows.where("n > 1 AND first IS NOT NULL").drop("n")


def planned(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, digest, size, refers_to, data (null for revisits) of every row."""
    first = written(firsts(pages, min_bytes))
    key = lambda c: F.xxhash64(c).alias("__key")
    rows = with_maybe(_source(pages).withColumn("__key", key("digest")), first.select(key("digest")), "__key", "__maybe").drop("__key")
    alone = rows.where("NOT __maybe").drop("__maybe").withColumn("first", F.lit(None).cast("long"))
    rows = alone.unionByName(rows.where("__maybe").drop("__maybe").join(first, ["digest", "size"], "left").select(*alone.columns))
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    refers = F.when(revisit, F.col("first"))
    return rows.select("page_id", "url", "digest", "size", refers.alias("refers_to"), F.when(~revisit, F.col("data")).alias("data"))


def _name(page: int | None, digest: str) -> str:
    return f"<urn:page:{'none' if page is None else page}:{digest}>"


def _headers(kind: str, page: int | None, url: str, digest: str, size: int, refers_to: int | None) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_name(page, digest)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to, digest)}"]
    lines.append(f"Content-Length: {0 if refers_to is not None else size}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _chunks(page: int | None, url: str, digest: str, size: int, refers_to: int | None, data) -> Iterator[tuple[int, str, bytes]]:
    """chunk, digest so far, bytes of the archive: a record's gzip member."""
    squeeze, sha = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha1()
    so_far = lambda: base64.b32encode(sha.digest()).decode()
    out = squeeze.compress(_headers("response" if refers_to is None else "revisit", page, url, digest, size, refers_to))
    view, chunk = memoryview(data if data is not None else b""), 0
    for at in range(0, len(view), CHUNK):
        part = view[at : at + CHUNK]
        sha.update(part)
        out += squeeze.compress(part)
        if at + CHUNK < len(view):
            yield chunk, so_far(), out
            out, chunk = b"", chunk + 1
    if refers_to is None and so_far() != digest:
        raise ValueError(f"page {page}: the payload isn't that of its digest")
    yield chunk, digest, out + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


_CHUNK_ROWS = pa.schema([("page_id", pa.int64()), ("chunk", pa.int64()), ("digest", pa.string()), ("data", pa.binary())])


def chunk_rows(rows: DataFrame) -> DataFrame:
    """page_id, chunk, digest (so far), data: every row of :func:`planned` as chunks of its archive record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            held = 0
            for k in range(batch.num_rows):
                page, url, digest, size, refers_to = (batch.column(c)[k].as_py() for c in range(5))
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                for chunk, so_far, data in _chunks(page, url, digest, size, refers_to, batch.column(5)[k].as_buffer()):
                    made.append((page, chunk, so_far, data))
                    held += len(data)
                    if held > 8 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*made, strict=True), _CHUNK_ROWS, strict=True)], schema=_CHUNK_ROWS)
                        made, held = [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*made, strict=True), _CHUNK_ROWS, strict=True)], schema=_CHUNK_ROWS)

    return rows.mapInArrow(run, "page_id long, chunk long, digest string, data binary")


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path there; Hadoop's names of the object store are Arrow's ``s3``."""
    path = re.sub(r"^s3[an]://", "s3://", path)
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives and return their manifest: path, records, bytes."""
    folder = (folder or shared_dir(pages.sparkSession) + "/warc").rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = _store(folder)
        store.create_dir(root)
        made: list[tuple[str, int, int]] = []
        out, name, records, size = None, "", 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                made.append((f"{folder}/{name}", records, size))
                out = None

        for batch in batches:
            for chunk, data in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                if out is None or (chunk == 0 and size >= file_bytes):
                    close()
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(made):04d}.warc.gz"
                    out, records, size = store.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None), 0, 0
                out.write(data.as_buffer())
                size += data.as_buffer().size
                records += chunk == 0
        close()
        path, n, b = zip(*made, strict=True) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(n, pa.int64()), pa.array(b, pa.int64())], names=["path", "records", "bytes"])

    return written(chunk_rows(planned(pages, min_bytes)).mapInArrow(run, "path string, records long, bytes long"))


class _Records:
    """Records of a stream of gzip members, each as headers and then blocks of its content."""

    def __init__(self, stream, block: int = 1 << 16):
        self.stream, self.block, self.raw, self.text, self.inflate = stream, block, b"", bytearray(), None

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(self.block)
        if not self.raw:
            return False
        if self.inflate is None:
            self.inflate = zlib.decompressobj(31)
        self.text += self.inflate.decompress(self.raw, CHUNK)
        self.raw = self.inflate.unconsumed_tail
        if self.inflate.eof:
            self.raw, self.inflate = self.inflate.unused_data, None
        return True

    def take(self, n: int) -> bytes:
        """Up to ``n`` bytes of content, at least one unless the file ends."""
        while not self.text and self._more():
            pass
        got = bytes(self.text[:n])
        del self.text[:n]
        return got

    def headers(self) -> dict[str, str] | None:
        while (end := self.text.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.text.strip():
                    raise ValueError("the archive ends inside a record's headers")
                return None
        head = self.text[:end].decode().split("\r\n")
        del self.text[: end + 4]
        if not head[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {head[0][:40]!r}")
        return dict(line.split(": ", 1) for line in head[1:])


def read(manifest: DataFrame, payloads: bool = True, chunk: int = CHUNK) -> DataFrame:
    """page_id, chunk, last, record_type, refers_to, url, declared_digest, declared_bytes, bytes, digest, data: a row a chunk.

    ``digest`` is of the record's content up to and with this chunk.  Without ``payloads`` the data stay null.
    """
    ddl = "page_id long, chunk long, last boolean, record_type string, refers_to long, url string, declared_digest string, declared_bytes long, bytes long, digest string, data binary"
    schema = pa.schema(
        [("page_id", pa.int64()), ("chunk", pa.int64()), ("last", pa.bool_()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]
        + [("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string()), ("data", pa.binary())]
    )
    page_of = lambda s: None if (page := s.split(":")[2]) == "none" else int(page)

    def of_file(path: str) -> Iterator[tuple]:
        store, at = _store(path)
        with store.open_input_stream(at, compression=None) as stream:
            records = _Records(stream)
            while (h := records.headers()) is not None:
                left, sha, k, seen = int(h["Content-Length"]), hashlib.sha1(), 0, 0
                fixed = (h["WARC-Type"], page_of(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None, unquote(h["WARC-Target-URI"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"]))
                while True:
                    part = bytearray()
                    while left and len(part) < chunk:
                        got = records.take(min(left, chunk - len(part)))
                        if not got:
                            raise ValueError(f"{path} ends inside a record")
                        part += got
                        left -= len(got)
                    sha.update(part)
                    seen += len(part)
                    yield (page_of(h["WARC-Record-ID"]), k, left == 0, *fixed, seen, base64.b32encode(sha.digest()).decode(), bytes(part) if payloads else None)
                    k += 1
                    if not left:
                        break
                end = b""
                while len(end) < 4:
                    got = records.take(4 - len(end))
                    if not got:
                        break
                    end += got
                if end != b"\r\n\r\n":
                    raise ValueError(f"{path}: a record isn't closed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                for row in of_file(path):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if held >= 8 * CHUNK or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    spark = manifest.sparkSession
    files = manifest.select("path").repartition(max(spark.sparkContext.defaultParallelism, 1) * 4, "path")
    return files.mapInArrow(run, ddl)


def report(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives.

    A response's figures are those of the content read; a revisit has no content and gives those it declares.
    """
    got = read(write(pages, min_bytes=min_bytes), payloads=False).where("last")
    response = F.col("record_type") == "response"
    return got.select(
        "page_id",
        F.when(response, F.col("bytes")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
