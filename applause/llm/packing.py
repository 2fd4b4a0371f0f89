"""Batches in small steps, and number arrays and word lists as compressed bytes for columns that travel."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa


ROWS_PER_STEP = 256  # rows handled at a time, which bounds a task's memory


def steps(batches: Iterator[pa.RecordBatch], rows: int = ROWS_PER_STEP) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def give_back() -> None:
    """Return freed memory to the system: a worker process outlives its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def kept(key: Hashable, make: Callable):
    """One value for a worker process, which outlives the functions that travel to it for every task."""
    shelf = vars(sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker"))).setdefault("values", {})
    if key not in shelf:
        shelf[key] = make()
    return shelf[key]


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def restored(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def packed(values: np.ndarray) -> bytes:
    return squeezed(np.ascontiguousarray(values).tobytes())


def unpacked(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(restored(data), dtype)


def packed_words(words: Iterable[str]) -> bytes:
    """Words without line feeds, at least one."""
    return squeezed("\n".join(words).encode("utf-8", "surrogatepass"))


def unpacked_words(data: bytes) -> list[str]:
    return restored(data).decode("utf-8", "surrogatepass").split("\n")
