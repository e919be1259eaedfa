"""Helpers for operators that work on Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Characters of text that are taken up at a time within a batch, however many rows it has.
SLICE_CHARS = 2_000_000


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` characters each; a longer text has a range of its own."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


#: Rows of an Arrow batch that are taken up at a time, so that few texts are Python strings at once.
ROWS = 500


def _release() -> None:
    """Gives memory that is free back to the system: a worker stays for later tasks, beside others in its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str, rows: int | None = ROWS) -> DataFrame:
    """``mapInArrow`` over batches of at most ``rows`` rows (None: as they come), with memory released at a task's end."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                if rows is None:
                    yield batch
                else:
                    for i in range(0, batch.num_rows, rows):
                        yield batch.slice(i, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(parts(batches))
        finally:
            _release()

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType | str) -> DataFrame:
    """``arrow_map`` of a function from batch to batch."""
    return arrow_map(df, lambda batches: map(work, batches), schema)


def texts_of(batch: pa.RecordBatch, column: int) -> list[str]:
    """A column's strings, null as the empty text."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]
