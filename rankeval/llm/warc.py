"""WARC archives of pages, written by tasks and read back record by record (operator 10)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankeval.llm.storage import commit, locate, task_file
from rankeval.sources.staging import stage

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long"
ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
WINDOW = 16 + zlib.MAX_WBITS  # zlib's sign for a gzip member


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, WINDOW)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member: a response with the payload, or a revisit without it."""
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _uri(page_id)),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [("WARC-Refers-To", _uri(refers_to)), ("WARC-Profile", REVISIT)]
    return _member(fields, HTTP % len(payload) + (b"" if revisit else payload))


def write(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_bytes: int = 100, file_bytes: int = 64 << 20,
) -> DataFrame:
    """One record per row; one row per archive (``MANIFEST``), kept in the checkpoint folder.

    Of equal payloads of ``least_bytes`` or more, the one with the smallest id is a response and the others revisit it.
    The smallest id per digest comes from partial minima, so a payload that a third of all pages share is no large group;
    the join back splits large partitions.  Tasks write member after member and start a new archive after ``file_bytes``.
    A null html is an empty payload, a null url an empty one; null ids are written and are responses where no other id has
    their payload; of repeated rows of the smallest id each is a response.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.length("payload")})
    first = rows.where(F.col("size") >= least_bytes).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"))
    key = F.when(F.col("size") >= least_bytes, F.col("digest"))
    rows = rows.join(first, key == F.col("d"), "left").drop("d", "size")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held, size = 0, [], 0

        def close():
            nonlocal files, held, size
            written = commit(uri := f"{folder}/{task_file(files, 'warc.gz')}", held)
            row = pa.RecordBatch.from_pydict({"file": [uri], "records": [len(held)], "bytes": [written]})
            files, held, size = files + 1, [], 0
            return row

        for batch in batches:
            for page, url, payload, digest, to in zip(*(c.to_pylist() for c in batch.columns)):
                revisit = to is not None and to != page
                held.append(record(page, url, payload, digest, to, revisit))
                size += len(held[-1])
                if size >= file_bytes:
                    yield close()
        if held:
            yield close()

    return stage(rows.select("page_id", "url", "payload", "digest", "first").mapInArrow(task, MANIFEST))


class Stream:
    """The decompressed bytes of one gzip member after the other, a bounded piece of the archive at a time."""

    def __init__(self, source, piece: int = 1 << 18):
        self.source, self.piece, self.raw, self.plain, self.codec = source, piece, b"", bytearray(), None

    def member(self) -> bool:
        """Begin the next member; False at the end of the archive."""
        if not self.raw:
            self.raw = self.source.read(self.piece)
        self.codec, self.plain = zlib.decompressobj(WINDOW), bytearray()
        return bool(self.raw)

    def _more(self) -> None:
        if self.codec.eof:
            raise EOFError("a record ends before its content length")
        data = self.codec.unconsumed_tail or self.raw or self.source.read(self.piece)
        if not data:
            raise EOFError("an archive ends inside a record")
        self.plain += self.codec.decompress(data, self.piece)
        if self.codec.eof:
            self.raw = self.codec.unused_data
        elif not self.codec.unconsumed_tail:
            self.raw = b""
        else:
            self.raw = self.codec.unconsumed_tail

    def until(self, mark: bytes) -> bytes:
        at = -1
        while (at := self.plain.find(mark)) < 0:
            self._more()
        out = bytes(self.plain[: at + len(mark)])
        del self.plain[: at + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.plain) < n:
            self._more()
        out = bytes(self.plain[:n])
        del self.plain[:n]
        return out

    def close_member(self) -> None:
        if self.exactly(4) != b"\r\n\r\n" or self.plain:
            raise ValueError("a record does not end after its content length")
        while not self.codec.eof:
            self._more()  # checks the member's CRC and length
        if self.plain:
            raise ValueError("a member holds more than one record")


def _fields(head: bytes) -> dict[str, str]:
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return dict(line.split(": ", 1) for line in lines if line)


def records(source) -> Iterator[tuple]:
    """The records of one archive in ``ROWS``'s columns, framed by content length, digests verified."""
    stream = Stream(source)
    page = lambda uri: int(uri[len("<urn:page:") : -1]) if uri != "<urn:page:>" else None
    while stream.member():
        fields = _fields(stream.until(b"\r\n\r\n"))
        block = stream.exactly(int(fields["Content-Length"]))
        stream.close_member()
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
        payload, size, to = None, int(fields["X-Payload-Length"]), None
        if kind == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not have its digest")
        else:
            to = page(fields["WARC-Refers-To"])
        yield page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, kind, to, payload


def read(manifest: DataFrame, batch_bytes: int = 4 << 20) -> DataFrame:
    """All records of the archives of a manifest, each archive read from start to end by one task."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in ROWS.split(", ")]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = locate(uri)
                out, size = [], 0
                with fs.open_input_stream(path, compression=None) as source:
                    for row in records(source):
                        out.append(row)
                        size += 200 + len(row[-1] or b"")
                        if size >= batch_bytes:
                            yield batch_of(out)
                            out, size = [], 0
                if out:
                    yield batch_of(out)

    n = max(1, manifest.count())
    return manifest.select("file").repartitionByRange(n, "file").mapInArrow(task, ROWS)
