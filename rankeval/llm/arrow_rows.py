"""Whole rows through Arrow, a few texts at a time: what a task holds in Python is bounded by characters, not by rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

SLICE_BYTES = 1 << 21


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """``(start, stop)`` of consecutive texts with about so many bytes, a longer one alone."""
    ends = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + size, side="right")) - 1)
        yield start, min(stop, len(texts))
        start = stop


def mapped(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], more: Mapping[str, T.DataType] | None = None) -> DataFrame:
    """``mapInArrow`` over rows of all columns, whatever their names hold, to the same columns and ``more`` behind them.  Batches carry
    the columns by place; names are given back afterwards."""
    own = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)]
    own += [T.StructField(f"c{len(own) + i}", t) for i, t in enumerate((more or {}).values())]
    return df.toDF(*[f.name for f in own[: len(df.columns)]]).mapInArrow(task, T.StructType(own)).toDF(*df.columns, *(more or {}))


def keep(df: DataFrame, text_col: str, test: Callable[[list[str | None]], Sequence[bool]]) -> DataFrame:
    """The rows whose text passes, all columns as they are."""
    at = df.columns.index(text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(np.asarray(test(part.column(at).to_pylist()), bool)))

    return mapped(df, task)


def rewrite(df: DataFrame, text_col: str, change: Callable[[str | None], str | None]) -> DataFrame:
    """The rows with another text."""
    at = df.columns.index(text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                text = pa.array([change(t) for t in part.column(at).to_pylist()], batch.column(at).type)
                columns = [text if i == at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return mapped(df, task)


def fresh(name: str, taken: Sequence[str]) -> str:
    """A column name that is not taken, by any spelling of its case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
