"""Arrow batches as byte buffers, for the operators that read whole texts in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of an Arrow batch of texts. The default of 10,000 holds tens of MB on both sides of each worker's pipe.
ROWS = 1_000


def small_batches(docs: DataFrame) -> DataFrame:
    """docs, with its session's Arrow batches bounded to ROWS rows."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ROWS:
        conf.set(key, str(ROWS))
    return docs


def _trim() -> None:
    """Gives freed memory back: workers live on between tasks, and glibc keeps freed arrays otherwise."""
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """[a, b) for runs of whole texts with about `most` bytes; a longer text is a run of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end
        at = end


def pieces(batch: pa.RecordBatch, column: str, most: int = 500_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of whole rows with about `most` bytes of text; null counts as empty.

    A text longer than `most` is a piece of its own. bytes is the UTF-8 of the texts without gaps.
    """
    text = batch.column(batch.schema.get_field_index(column))
    if text.null_count:
        text = text.fill_null("")
    text = text.cast(pa.large_binary())
    n = len(text)
    if not n:
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    for at, end in runs(offsets, most):
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
    _trim()


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of values (small integers or booleans) over each [offsets[i], offsets[i+1])."""
    run = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=run[1:])
    return run[offsets[1:]] - run[offsets[:-1]]
