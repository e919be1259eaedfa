"""Sequential folds over ordered rows of a key, for operators whose state depends on the row before.

Rows are dealt by key and sorted within the partition (a sort that spills), then
streamed through Arrow batches: a task holds one key's state, never its rows, so a
key with a third of all rows costs time but no memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def fold(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    start: Callable[[tuple], Any],
    step: Callable[[Any, dict], tuple[Any, dict | None]],
    schema: str | StructType,
    finish: Callable[[tuple, Any], dict | None] | None = None,
) -> DataFrame:
    """Rows that ``step(state, row)`` returns beside the new state, and ``finish(key, state)`` at a key's end."""
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        state = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                now = tuple(row[k] for k in keys)
                if now != key:
                    if key is not None and finish and (last := finish(key, state)):
                        out.append(last)
                    key, state = now, start(now)
                state, found = step(state, row)
                if found is not None:
                    out.append(found)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if key is not None and finish and (last := finish(key, state)):
            yield pa.RecordBatch.from_pylist([last], schema=arrow)

    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).mapInArrow(work, kind)
