"""Plain Python over Arrow batches, a few rows at a time.

Spark sends batches of up to 10,000 rows or 64 MB. As Python objects, with all that is made of them,
these take many times their bytes; so only a slice of a batch is ever held as objects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the columns handled at once; a longer single row forms a slice of its own.
SLICE_BYTES = 1 << 20


def slices(columns: tuple[pa.Array, ...], at: int, n: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of slices of the rows from ``at`` on, halved until they are small enough."""
    if n > 1 and sum(c.slice(at, n).nbytes for c in columns) > SLICE_BYTES:
        yield from slices(columns, at, n // 2)
        yield from slices(columns, at + n // 2, n - n // 2)
    elif n:
        yield at, n


def by_rows(run: Callable, kind: pa.DataType, batches: Iterator[pa.Array | tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """run's value for each row of the batches' columns, as arrays of the kind, one a slice; null where the first column is."""
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        for at, n in slices(columns, 0, len(columns[0])):
            rows = zip(*(c.slice(at, n).to_pylist() for c in columns), strict=True)
            yield pa.array([None if row[0] is None else run(*row) for row in rows], kind)


def lists(values: np.ndarray, sizes: np.ndarray, null: pa.Array | None = None) -> pa.Array:
    """An array of lists of 32-bit numbers, one after another in ``values``."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32, copy=False)), mask=null)


def code_points(batches: Iterator[pa.Array], eos: int | None = None) -> Iterator[pa.Array]:
    """The code points of each text. With an end token each list ends with it, and a null text gives it alone."""
    for batch in batches:
        for at, n in slices((batch,), 0, len(batch)):
            part = batch.slice(at, n)
            texts = pc.fill_null(part, "")
            sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            code = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.int32)
            if eos is None:
                yield lists(code, sizes, part.is_null())
            else:
                yield lists(np.insert(code, np.cumsum(sizes), eos), sizes + 1)


def from_code_points(batches: Iterator[pa.Array], zero: int = 0) -> Iterator[pa.Array]:
    """The texts of lists of code points; a code point of 0 becomes ``zero``."""
    for batch in batches:
        for at, n in slices((batch,), 0, len(batch)):
            part = batch.slice(at, n)
            code = pc.list_flatten(part).to_numpy(zero_copy_only=False).astype(np.uint32)
            code[code == 0] = zero
            sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            whole, end = code.tobytes().decode("utf-32-le", "replace"), np.cumsum(sizes)
            yield pa.array([whole[e - k : e] if known else None for e, k, known in zip(end.tolist(), sizes.tolist(), part.is_valid().to_pylist(), strict=True)], pa.string())
