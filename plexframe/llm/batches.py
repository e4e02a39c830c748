"""Arrow batch plumbing shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Text bytes that one call of a kernel gets at most (a longer single text goes alone).
SLICE_BYTES = 8 << 20


#: What operators keep in a worker between tasks: owner -> how to let go of it.
KEPT: dict[str, Callable[[], None]] = {}


def lean(owner: str = "") -> None:
    """Lets go of what other operators than ``owner`` keep in this worker, and makes it give freed memory back.

    Large arrays get pages of their own, Arrow allocates like the rest.

    Without it the C library raises its own threshold with every large
    array freed, and a reused worker keeps the most that it ever held.
    """
    import ctypes

    for name, forget in KEPT.items():
        if name != owner:
            forget()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)
    pa.set_memory_pool(pa.system_memory_pool())


def tidy(run: Callable, owner: str = "") -> Callable:
    """The same task function, after which its worker gives back what it held: idle workers stay small."""

    def wrapped(batches):
        lean(owner)
        yield from run(batches)
        lean(owner)

    return wrapped


def text_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text_col: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch by rows so that each part holds about ``most`` bytes of text."""
    _, offsets = text_views(batch.column(text_col))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = max(start + 1, min(end, batch.num_rows))
        yield batch.slice(start, end - start)
        start = end


def clash_free(schema: T.StructType, added: Iterable[str]) -> list[T.StructField]:
    """Input fields that the added ones don't replace (names compare without case)."""
    taken = {a.lower() for a in added}
    return [f for f in schema.fields if f.name.lower() not in taken]


def with_batches(df: DataFrame, text_col: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], added: T.StructType, most: int = SLICE_BYTES, owner: str = "") -> DataFrame:
    """Appends the columns ``added``; columns of the same names in ``df`` are replaced.

    ``make`` runs once per task and returns the kernel: record batch -> {column: values}.
    """
    kept = clash_free(df.schema, added.fieldNames())
    schema = T.StructType([*kept, *added.fields])
    arrow, names = to_arrow_schema(schema), [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for whole in batches:
            for batch in slices(whole, text_col, most):
                new = kernel(batch)
                columns = [batch.column(x) for x in names]
                columns += [_array(new[f.name], arrow.field(f.name).type) for f in added.fields]
                columns = [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=arrow.names)

    return df.mapInArrow(tidy(run, owner), schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return pa.array(values, type=kind)
