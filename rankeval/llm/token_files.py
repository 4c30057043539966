"""Token ids in binary files: documents compressed one by one with a shared dictionary (operator 1).

A file holds consecutive documents in ascending id order:

    magic | SHA-256 of the dictionary | id width | number of documents
    ids (int64) | null flags of the ids | token counts (uint64) | frame offsets (uint64, one more) | frames

One frame is one document's ids, little-endian, compressed by zstandard with the dictionary that lies beside the files
under its hash.  A reader of a single short document reads the index and one frame.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from rankeval.llm.encoding import encoder, runs
from rankeval.llm.storage import commit, locate, task_file
from rankeval.sources.staging import stage

MAGIC = b"TOKZ1\n"
HEAD = struct.Struct("<6s32sBQ")
MANIFEST = "file string, file_no long, n_docs long, n_tokens long, n_bytes long"
ROWS = "doc_id long, start long, n_tokens long, ids binary"


def train_dictionary(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    samples: int = 1000, sample_chars: int = 8192, size: int = 65536,
) -> bytes:
    """A zstandard dictionary trained on the serialized ids of at most ``samples`` pieces of ``sample_chars`` characters, those
    with the smallest hash of id and place among all pieces of all whole texts: together at most ``samples`` x ``sample_chars``
    characters.  Empty where the samples are too few to train on.

    The sample only shapes the dictionary; every document is written in full whatever it holds.
    """
    text = F.col(text_col)
    places = F.explode(F.sequence(F.lit(0), F.expr(f"(length(`{text_col}`) - 1) div {sample_chars}").cast("int"))).alias("p")
    placed = docs.where(F.length(text) > 0).select(F.col(id_col).alias("i"), text.alias("t"), places)
    hashed = placed.select(F.xxhash64("i", "p").alias("h"), "t", "p")
    last = hashed.select("h").orderBy("h").limit(samples).agg(F.max("h")).first()[0]
    if last is None:
        return b""
    # the hash is chosen first, so that no more pieces than asked for are sent
    piece = F.substring("t", F.col("p") * sample_chars + 1, F.lit(sample_chars)).alias("t")
    rows = hashed.where(F.col("h") <= last).select("h", piece).orderBy("h", "t").limit(samples).collect()
    ids = encoder(tokenizer).encode([r["t"] for r in rows], end_id)
    try:
        return zstandard.train_dictionary(size, ids).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(cls, dictionary: bytes, **more):
    return cls(dict_data=zstandard.ZstdCompressionDict(dictionary), **more) if dictionary else cls(**more)


def _serialize(docs: list[tuple[int | None, int, bytes]], width: int, digest: bytes) -> Iterator[bytes]:
    n = len(docs)
    yield HEAD.pack(MAGIC, digest, width, n)
    yield np.array([d if d is not None else 0 for d, _, _ in docs], "<i8").tobytes()
    yield np.array([d is None for d, _, _ in docs], "u1").tobytes()
    yield np.array([t for _, t, _ in docs], "<u8").tobytes()
    yield np.concatenate([[0], np.cumsum([len(f) for _, _, f in docs])]).astype("<u8").tobytes()
    for _, _, frame in docs:
        yield frame


def write(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    file_bytes: int = 16 << 20, level: int = 3, dictionary: bytes | None = None,
) -> DataFrame:
    """Encode every text and write the files; one row per file (``MANIFEST``), kept in the checkpoint folder.

    Rows are range-partitioned and sorted by id, so file numbers ascend with ids; a partition writes as many files
    as its bytes need and holds one at a time.  A null text is an empty one, a null id comes first, repeated rows
    are written as often as they occur, an empty table gives no file.
    """
    if dictionary is None:
        dictionary = train_dictionary(docs, tokenizer, end_id, id_col, text_col)
    digest = hashlib.sha256(dictionary).digest()
    commit(f"{folder}/{digest.hex()}.dict", [dictionary])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files, held, size = TaskContext.get().partitionId(), 0, [], 0
        enc, packer = encoder(tokenizer), _codec(zstandard.ZstdCompressor, dictionary, level=level)
        width = 2 if enc.code == "H" else 4

        def close():
            nonlocal files, held, size
            number = (part << 24) + files
            written = commit(uri := f"{folder}/{task_file(files, 'tok')}", _serialize(held, width, digest))
            row = pa.RecordBatch.from_pydict({
                "file": [uri], "file_no": [number], "n_docs": [len(held)], "n_tokens": [sum(t for _, t, _ in held)],
                "n_bytes": [written],
            })
            files, held, size = files + 1, [], 0
            return row

        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for a, b in runs(texts):
                for doc, data in zip(ids[a:b], enc.encode(texts[a:b], end_id)):
                    frame = packer.compress(data)
                    held.append((doc, len(data) // width, frame))
                    size += len(frame)
                    if size >= file_bytes:
                        yield close()
        if held:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stage(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(task, MANIFEST))


class TokenFile:
    """One file: its index, and single documents by position or id."""

    def __init__(self, source, dictionary: bytes):
        self.source, self.at = source, HEAD.size
        magic, digest, self.width, n = HEAD.unpack(source.read(HEAD.size))
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token file of this dictionary")
        self.ids, nulls = self._array("<i8", n), self._array("u1", n)
        self.nulls, self.counts, self.offsets = nulls.astype(bool), self._array("<u8", n), self._array("<u8", n + 1)
        self.codec = _codec(zstandard.ZstdDecompressor, dictionary)

    def _array(self, kind: str, n: int) -> np.ndarray:
        data = self.source.read(np.dtype(kind).itemsize * n)
        self.at += len(data)
        return np.frombuffer(data, kind)

    def document(self, i: int) -> np.ndarray:
        lo, hi = int(self.offsets[i]), int(self.offsets[i + 1])
        self.source.seek(self.at + lo)
        return np.frombuffer(self.codec.decompress(self.source.read(hi - lo)), f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> np.ndarray | None:
        known = int(self.nulls.sum())  # null ids come first
        i = known + int(np.searchsorted(self.ids[known:], doc_id))
        return self.document(i) if i < len(self.ids) and self.ids[i] == doc_id else None


def _dictionary(folder: str, digest: str) -> bytes:
    fs, path = locate(f"{folder}/{digest}.dict")
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def open_file(uri: str):
    """The file and its dictionary, found by the hash in the head."""
    fs, path = locate(uri)
    source = fs.open_input_file(path)
    digest = HEAD.unpack(source.read(HEAD.size))[1].hex()
    source.seek(0)
    return TokenFile(source, _dictionary(uri.rsplit("/", 1)[0], digest))


def read(spark: SparkSession, manifest: DataFrame, batch_bytes: int = 4 << 20) -> DataFrame:
    """The documents of all files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids``
    (little-endian unsigned 32-bit).  Starts are running sums over the files, one row each, added to those inside."""
    first = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    n = max(1, manifest.count())
    files = manifest.select("file", "file_no", F.coalesce(F.sum("n_tokens").over(first), F.lit(0)).alias("base"))
    files = files.repartitionByRange(n, "file_no")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = open_file(row["file"])
                start, out, size = row["base"], [], 0
                for i, doc in enumerate(tokens.ids):
                    ids = tokens.document(i)
                    if len(ids) != tokens.counts[i]:
                        raise ValueError(f"{row['file']}: document {i} has {len(ids)} ids, not {tokens.counts[i]}")
                    out.append((None if tokens.nulls[i] else int(doc), start, len(ids), ids.tobytes()))
                    start += len(ids)
                    size += 4 * len(ids)
                    if size >= batch_bytes:
                        yield _rows(out)
                        out, size = [], 0
                if out:
                    yield _rows(out)
                tokens.source.close()

    return files.mapInArrow(task, ROWS)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*out)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())],
        names=["doc_id", "start", "n_tokens", "ids"],
    )
