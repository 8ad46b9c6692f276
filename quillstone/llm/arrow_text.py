"""Texts of Arrow batches as bounded slices, bytes and numbers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in order, cut so that a slice has at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def release() -> None:
    """Give memory that nothing holds back to the system: a worker lives on between tasks, beside those of other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only the GNU library has it
        pass


def with_column(batch: pa.RecordBatch, name: str, values) -> pa.RecordBatch:
    """The batch with one more column at its end."""
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64, up to n; kept for the next call of the process."""
    if not _powers or len(_powers[0]) <= n:
        size = max(2 * n, 1 << 17)
        _powers.clear()
        for base in (_BASE, _INVERSE):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers.append(np.multiply.accumulate(row))
    return _powers


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes modulo 2^64; see ``span_hashes``."""
    powers = _power_tables(len(data))[0]
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit number for each span of bytes, the same for equal bytes anywhere.

    An odd base modulo 2^64 tells spans of up to 512 bytes apart as well as random numbers do.
    """
    h = (prefix[ends] - prefix[starts]) * _power_tables(len(prefix))[1][starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def bytes_list(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]
