"""Small helpers over Arrow batches inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PART_BYTES = 4 << 20


def parts(batch: pa.RecordBatch, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of about ``most`` bytes, so that a worker's memory stays small."""
    rows = max(1, int(batch.num_rows * most // max(batch.nbytes, 1)))
    for begin in range(0, batch.num_rows, rows):
        yield batch.slice(begin, rows)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of ``column`` one after another, and where each begins
    and the last ends. A null is an empty text."""
    wide = column.cast(pa.large_string()).fill_null("")
    _, places, data = wide.buffers()
    at = np.frombuffer(places, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]
