"""Packing documents into sequences of a fixed capacity by reciprocal-capacity classes (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rankeval.llm.encoding import CACHED_WORDS, encoder, runs

ROWS = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
HARMONIC = 64  # classes 1, 2, ... up to here; then powers of two


class Packer:
    """Fills sequences of one worker.

    Class k takes pieces of at most capacity / k tokens and puts exactly k of them in a sequence.  Up to ``HARMONIC``
    every k is a class, above it only powers of two.  A document gives pieces of the whole capacity and a rest; a rest
    that would leave more than a sixteenth of its share empty first gives the exact share of the next class, and so on.
    Sequences that are open at the end are laid end to end and cut at the capacity; the last cut has lengths that are
    powers of two, so it needs no padding.  Held: the open pieces, fewer than k per class, at most one capacity each.
    """

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list] = {}

    def _class(self, n: int) -> int:
        k = self.capacity // n
        return k if k <= HARMONIC else 1 << (k.bit_length() - 1)

    def _fits(self, n: int) -> bool:
        k = self._class(n)
        return n * k * 16 >= self.capacity * 15 or k >= HARMONIC or k == self.capacity

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        total, at = len(ids), 0
        while at < total:
            n = min(total - at, self.capacity)
            if not self._fits(n):
                n = self.capacity // (self._class(n) + 1)
            k = self._class(n)
            held = self.open.setdefault(k, [])
            held.append((doc, at, ids[at : at + n], total))
            at += n
            if len(held) == k:
                yield from self._close(held)
                self.open[k] = []

    def _close(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc, at, ids, total in pieces:
            yield doc, at, len(ids), total, self.next_id, offset, ids.astype("<u4").tobytes()
            offset += len(ids)
        self.next_id += 1

    def finish(self) -> Iterator[tuple]:
        line = [p for k in sorted(self.open) for p in self.open[k]]
        left = sum(len(p[2]) for p in line)
        room, pieces = 0, []
        for doc, at, ids, total in line:
            while len(ids):
                if not room:
                    room = size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                    left -= size
                pieces.append((doc, at, ids[:room], total))
                n = len(pieces[-1][2])
                at, ids, room = at + n, ids[n:], room - n
                if not room:
                    yield from self._close(pieces)
                    pieces = []
        self.open = {}


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text",
    cached_words: int = CACHED_WORDS,
) -> DataFrame:
    """Sequences of at most ``capacity`` tokens: one row per piece with its ``ids`` (little-endian unsigned 32-bit).

    Every partition fills its own sequences, so nothing is shuffled; sequence ids are the partition's number times
    2^40 and up.  The scan's splits are the same whenever the table is read with the same settings, so a lost task
    gives the same pieces again.  A null or empty text is a document of the end token alone; repeated ids are packed
    as often as they occur, a null id stays null; an empty table gives no row.  ``cached_words``: words that a worker keeps
    with their ids (about 200 bytes each); it changes the speed alone.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer, cached_words), Packer(capacity, TaskContext.get().partitionId() << 40)
        kind = "<u2" if enc.code == "H" else "<u4"
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for a, b in runs(texts):
                found = zip(ids[a:b], enc.encode(texts[a:b], end_id))
                yield from _batch([p for doc, data in found for p in packer.add(doc, np.frombuffer(data, kind))])
        yield from _batch(list(packer.finish()))

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(task, ROWS)


def _batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        *numbers, ids = zip(*rows)
        names = [c.split()[0] for c in ROWS.split(", ")]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), pa.array(ids, pa.binary())], names=names)
